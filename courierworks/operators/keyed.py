"""Per-key helpers that stay balanced when one key holds a large share of the rows.

A window over a whole key is one task per key. The helpers here cut a key's history into time
buckets, work inside (key, bucket), and pass what crosses a bucket border through a small table with
one row per (key, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierworks.session import checkpoint, stage

SEGMENTS = 256  # windows that the history of a very large key is cut into


def time_bucket(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("long")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first `n` rows of every key. Spark limits each key before the shuffle, so hot keys stay cheap."""
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= F.lit(n))
    return kept if rank else kept.drop(name)


def latest_by(df: DataFrame, keys: list[str], ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The newest row of every key; rows without a time come last, `tie` (ascending) decides equal times."""
    order = [F.col(ts).desc_nulls_last()] + ([F.col(tie).asc()] if tie else [])
    return top_per_key(df, keys, order, 1)


def first_by(df: DataFrame, keys: list[str], ts: str = "ts", tie: str | None = None) -> DataFrame:
    order = [F.col(ts).asc_nulls_last()] + ([F.col(tie).asc()] if tie else [])
    return top_per_key(df, keys, order, 1)


def dedupe_keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in `order`."""
    return top_per_key(df, keys, order, 1)


def with_previous(df: DataFrame, key: str, ts: str, tie: str, columns: list[str], prefix: str = "prev_",
                  bucket_seconds: int = 3600) -> DataFrame:
    """Each row with `columns` of the row before it in its key, ordered by (`ts`, `tie`).

    The lag runs inside (key, time bucket); only the first row of a bucket reads the seam table,
    which holds the last row of every bucket.
    """
    rows = df.withColumn("__bucket", time_bucket(ts, bucket_seconds))
    last = rows.groupBy(key, "__bucket").agg(
        F.max_by(F.struct(*columns), F.struct(ts, tie)).alias("__last")
    )
    seam = last.withColumn("__seam", F.lag("__last").over(Window.partitionBy(key).orderBy("__bucket"))).drop("__last")
    inside = Window.partitionBy(key, "__bucket").orderBy(ts, tie)
    joined = rows.join(seam, [key, "__bucket"], "left").withColumn("__row", F.row_number().over(inside))
    for name in columns:
        joined = joined.withColumn(
            prefix + name, F.when(F.col("__row") == 1, F.col(f"__seam.{name}")).otherwise(F.lag(name).over(inside))
        )
    return joined.drop("__bucket", "__seam", "__row")


def asof_left(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, tie: str,
              columns: list[str], prefix: str = "", hot_rows: int = 1_000_000) -> DataFrame:
    """Every left row with `columns` of the newest right row of its key at or before its time.

    Both sides are stacked and the newest right row is carried forward by one window per key, so each side is read and shuffled once. A
    key with more than `hot_rows` rows is cut at its own sampled quantiles of time into up to `SEGMENTS` windows of about equal size; what
    a segment starts with, the last right row of the segments before, is one row each. The keys are counted by a pass over the key column
    alone. At equal times right rows sort before left rows, and of right rows the largest `tie` is the newest. Rows without key or time
    match nothing.
    """
    names = left.columns
    known = right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull())
    counts = left.select(key).unionByName(known.select(key)).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    hot, cuts = counts.where(F.col("__n") > hot_rows).select(key), None
    if not hot.isEmpty():
        hot = checkpoint(hot)
        times = left.select(key, F.unix_micros(left_ts).alias("__at")).unionByName(known.select(key, F.unix_micros(right_ts).alias("__at")))
        shares = [(i + 1) / SEGMENTS for i in range(SEGMENTS - 1)]
        cuts = stage(join_checked(times, hot, [key]).groupBy(key).agg(F.percentile_approx("__at", shares, 10 * SEGMENTS).alias("__cuts")))

    def segmented(df: DataFrame) -> DataFrame:
        lost = F.pmod(F.xxhash64("__ts"), F.lit(SEGMENTS)).cast("int")  # keyless rows are spread
        if cuts is None:
            return df.withColumn("__segment", F.when(F.col(key).isNull(), lost).otherwise(F.lit(0)))
        passed = F.size(F.filter("__cuts", lambda c: c < F.unix_micros("__ts")))
        return join_checked(df, cuts, [key], "left").withColumn("__segment", F.when(F.col(key).isNull(), lost).otherwise(F.coalesce(
            F.when(F.col("__cuts").isNotNull(), passed), F.lit(0)))).drop("__cuts")

    ours = left.select(
        F.col(key), F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast("string").alias("__tie"), F.struct(*names).alias("__left"))
    theirs = known.select(
        F.col(key), F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.col(tie).cast("string").alias("__tie"), F.struct(*columns).alias("__value"))
    inside = Window.partitionBy(key, "__segment").orderBy("__ts", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = segmented(ours.unionByName(theirs, allowMissingColumns=True)).withColumn("__seen", F.last("__value", ignorenulls=True).over(inside)).where("__side = 1")
    if cuts is not None:
        ends = segmented(join_checked(theirs, hot, [key])).groupBy(key, "__segment").agg(F.max_by("__value", F.struct("__ts", "__tie")).alias("__end"))
        every = cuts.select(key, F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("__segment"))
        before = Window.partitionBy(key).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.join(ends, [key, "__segment"], "left").withColumn("__carry", F.last("__end", ignorenulls=True).over(before)).drop("__end")
        seen = join_checked(seen, carried, [key, "__segment"], "left").withColumn("__seen", F.coalesce("__seen", "__carry"))
    return seen.select(*[F.col(f"__left.{n}").alias(n) for n in names], *[F.col(f"__seen.{c}").alias(prefix + c) for c in columns])


def is_small(df: DataFrame, max_rows: int = 50_000) -> bool:
    """Whether a side has at most `max_rows` rows; reads no more than one row past the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def row_hash(df: DataFrame) -> Column:
    """Hash of a whole row. Unlike a running number it is the same when a lost task runs again."""
    return F.xxhash64(*[f.name for f in df.schema.fields if not f.dataType.simpleString().startswith("map")])


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", max_rows: int = 50_000,
                 salts: int = 16) -> DataFrame:
    """Equi-join whose right side is broadcast only when its size was checked.

    Otherwise the rows of a hot key are spread over `salts` sub-keys and the right side is repeated
    once per salt. Only for 'inner', 'left', 'left_anti' and 'left_semi'.
    """
    if is_small(right, max_rows):
        return left.join(F.broadcast(right), on, how)
    spread = left.withColumn("__salt", F.pmod(row_hash(left), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "__salt"], how).drop("__salt")


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict, bins: int = 2048, nulls_first: bool = False) -> DataFrame:
    """Exact order statistics per key without gathering a key's values in one task.

    `ranks` maps a result column to a function from the row count (a column) to a zero-based rank. Equal values are counted first,
    combined before the shuffle, so a frequent value is one row from then on; the counts are written once and all further passes read
    them. Equal-width bins find where the wanted ranks lie, and only those bins are ordered. The result also carries the count in `n`.
    NULL values do not count, or with `nulls_first` count as smaller than all others.
    """
    on = keys or ["__all"]
    rows = df.select(*keys, F.col(value).alias("__v")) if keys else df.select(F.lit(1).alias("__all"), F.col(value).alias("__v"))
    counted = stage(rows.groupBy(*on, "__v").agg(F.count("*").alias("__m")))
    some = F.col("__v").isNotNull()
    edges = counted.groupBy(*on).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.coalesce(F.sum(F.when(some, F.col("__m"))), F.lit(0)).alias("__some"),
                                     F.sum("__m").alias("__whole"))
    n = F.col("__whole") if nulls_first else F.col("__some")
    skip = F.col("__whole") - F.col("__some") if nulls_first else F.lit(0)
    wanted = [f"__k_{name}" for name in ranks]
    edges = edges.where(n > 0).select(*on, "__lo", "__hi", n.alias("n"), *[(fn(n) - skip).cast("long").alias(f"__k_{name}") for name, fn in ranks.items()])
    width = F.col("__hi") - F.col("__lo")
    bin_of = F.when(
        width > 0, F.least(F.floor((F.col("__v") - F.col("__lo")) / width * F.lit(float(bins))), F.lit(bins - 1))
    ).otherwise(F.lit(0)).cast("int")
    binned = join_checked(counted.where(some), edges, on).withColumn("__bin", bin_of).select(*on, "__bin", "__v", "__m", *wanted)
    counts = binned.groupBy(*on, "__bin").agg(F.sum("__m").alias("__c"), *[F.first(c).alias(c) for c in wanted])
    before = F.sum("__c").over(Window.partitionBy(*on).orderBy("__bin")) - F.col("__c")
    holds = F.lit(False)
    for k in wanted:
        holds = holds | ((F.col(k) >= F.col("__before")) & (F.col(k) < F.col("__before") + F.col("__c")))
    holding = counts.withColumn("__before", before).where(holds).select(*on, "__bin", "__before")
    inside = Window.partitionBy(*on, "__bin").orderBy("__v")
    placed = join_checked(binned, holding, [*on, "__bin"]).withColumn("__end", F.col("__before") + F.sum("__m").over(inside)).withColumn(
        "__start", F.col("__end") - F.col("__m"))
    picked = placed.groupBy(*on).agg(
        *[F.max(F.when((F.col(f"__k_{name}") >= F.col("__start")) & (F.col(f"__k_{name}") < F.col("__end")),
                       F.col("__v"))).alias(name) for name in ranks])
    return edges.select(*on, "n").join(picked, on, "left").select(*keys, "n", *ranks)


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """Quantile per key with linear interpolation between the two neighbouring order statistics."""
    position = lambda n: F.lit(float(q)) * (n - F.lit(1))
    both = order_statistics(df, keys, value, {
        "__low": lambda n: F.floor(position(n)), "__high": lambda n: F.ceil(position(n))})
    share = position(F.col("n")) - F.floor(position(F.col("n")))
    return both.select(*keys, (F.col("__low") + (F.col("__high") - F.col("__low")) * share).alias(name))


def nearest_rank(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                 index: str = "ceil") -> DataFrame:
    """Nearest-rank percentiles: the sorted value number ceil(q * n), or floor(q * n) with index='floor'."""
    turn = F.ceil if index == "ceil" else F.floor
    rank = lambda q: lambda n: F.greatest(turn(n * F.lit(int(round(q * 100))) / F.lit(100)) - 1, F.lit(0))
    return order_statistics(df, keys, value, {name: rank(q) for name, q in quantiles.items()})
