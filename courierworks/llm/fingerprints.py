"""SimHash fingerprints in DataFrame operations only: weighted term votes, and block tables for all neighbours within a Hamming radius.

A term is a word with its follower, its weight their length. Every occurrence votes with its weight for or against each of 64 bits. The votes
of bits j and j + 32 share one long (32 bits each), so a fingerprint is 32 sums in one hash aggregate, combined in the task that reads the
text. No Python runs here.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierworks.llm.common import stage

RADIUS = 3
BLOCKS = 5  # any two fingerprints within the radius agree on at least BLOCKS - RADIUS whole blocks
SPACE = " \t\n\r\f\v"


def terms(text: Column) -> Column:
    """array<struct<h, w>>: hash and weight of every word with its follower (the last word stands alone)."""
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
    followers = F.when(F.size(words) > 1, F.slice(words, F.lit(2), F.size(words))).otherwise(F.array().cast("array<string>"))
    return F.zip_with(words, followers, lambda a, b: F.struct(
        F.xxhash64(a, b).alias("h"), F.least(F.length(a) + F.coalesce(F.length(b), F.lit(0)), F.lit(31)).cast("long").alias("w")))


def voted(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys` and `fp` (long) of each group of equal keys; rows of one group must hold one text. A text without words has fingerprint 0."""
    rows = texts.select(*keys, F.explode_outer(terms(F.col(text))).alias("t")).select(*keys, F.col("t.h").alias("h"), F.coalesce(F.col("t.w"), F.lit(0)).alias("w"))
    lanes = [F.sum(F.col("w") * F.shiftrightunsigned(F.col("h"), j).bitwiseAND(F.lit((1 << 32) + 1))).alias(f"v{j}") for j in range(32)]
    sums = rows.groupBy(*keys).agg(F.sum("w").alias("all"), *lanes)
    fp = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(F.col(f"v{j}"), 32)
        for bit, votes in ((j, low), (j + 32, high)):
            value = (1 << bit) if bit < 63 else -(1 << 63)
            fp = fp.bitwiseOR(F.when(votes * 2 > F.col("all"), F.lit(value)).otherwise(F.lit(0)).cast("long"))
    return sums.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints, 0 to 1."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def text_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def successors(ids: DataFrame, parts: int) -> DataFrame:
    """doc_id, next_id: the next larger id, the smallest after the last. Ranges are sorted apart; one row per range joins their ends."""
    ranged = stage(ids.where("doc_id IS NOT NULL").distinct().repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))  # one row per range, a bounded number
    order = Window.orderBy("part")
    ends = firsts.select(F.col("part").alias("p"), F.lead("first").over(order).alias("after"), F.min("first").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("smallest"))
    return inside.join(F.broadcast(ends), F.col("part") == F.col("p")).select("doc_id", F.coalesce("next_id", "after", "smallest").alias("next_id"))


def masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Bit masks of the block tables: every choice of blocks - radius blocks, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    out = [sum(chosen) for chosen in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def within_radius(fingerprints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fp, near: for each distinct query fingerprint, the number of rows of `fingerprints` within the radius (itself included).

    Both tables have a column fp. Equal fingerprints are counted before they are laid into the tables; a pair is taken in the first table
    in which it meets, so it is counted once.
    """
    tables = masks(blocks, radius)

    def laid(df: DataFrame, name: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(i).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(tables)])
        return df.withColumn("x", F.explode(rows)).select("*", F.col("x.t").alias(f"{name}_t"), F.col("x.k").alias(f"{name}_k")).drop("x")

    base = laid(fingerprints.groupBy("fp").agg(F.count("*").alias("copies")).withColumnRenamed("fp", "b"), "b")
    asked = laid(queries.select(F.col("fp").alias("a")).distinct(), "a")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(tables)])
    pairs = asked.join(base, (F.col("a_t") == F.col("b_t")) & (F.col("a_k") == F.col("b_k")) & (F.bit_count(apart) <= radius) & (first == F.col("a_t")))
    return pairs.groupBy(F.col("a").alias("fp")).agg(F.sum("copies").alias("near"))


def fingerprint_documents(docs: DataFrame, every: int = 50) -> DataFrame:
    """Fingerprints of every text and of its edited text, and what they are near to.

    The edited text has its last quarter (floor(n_chars / 4) code points) replaced by the beginning of the next document's text. Columns:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_docs (for ids divisible by `every`: other
    documents within the Hamming radius; else null). Null texts count as empty; a text without words has fingerprint zero; repeated equal rows
    give one row; of several texts of one id, the one whose needed part is smallest is the next text; rows without an id have no
    next document (their last quarter goes, near_next is null); an empty table gives none; other columns are ignored.
    """
    parts = max(8, docs.sparkSession.sparkContext.defaultParallelism)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    following = successors(texts.select("doc_id"), parts)
    sized = texts.select("doc_id", F.floor(F.char_length("text") / 4).cast("int").alias("need"))
    wanted = sized.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("need").alias("need")).join(following, "doc_id").select(F.col("doc_id").alias("asker"), "next_id", "need")
    # Both joins read the texts with an id, dealt out by id: one exchange serves both. The id needs a name of its own: an alias that keeps the
    # name goes on one side of the self-join only, and the two exchanges then differ.
    placed = texts.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("own"), "text")
    prefixes = (placed.join(wanted, F.col("own") == F.col("next_id"))
                .select("asker", "next_id", F.struct(F.expr("substring(text, 1, need)").alias("prefix"), F.xxhash64("text").alias("hash")).alias("part"))
                .groupBy("asker").agg(F.min("next_id").alias("next_id"), F.min("part").alias("part")))
    together = placed.join(prefixes, F.col("own") == F.col("asker"), "left").select(F.col("own").alias("doc_id"), "text", "next_id", "part")
    together = together.unionByName(texts.where("doc_id IS NULL"), allowMissingColumns=True)
    edited = (together.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
              .withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - cut)"), F.coalesce(F.expr("substring(part.prefix, 1, cut)"), F.lit(""))))
              .select("doc_id", "n_chars", F.xxhash64("text").alias("hash"), F.sha2("edited", 256).alias("edited_sha256"), "next_id", F.col("part.hash").alias("next_hash"),
                      F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))).alias("version"))
              .select("*", "version.kind", "version.body").drop("version"))
    keys = ["doc_id", "n_chars", "hash", "edited_sha256", "next_id", "next_hash"]
    marks = stage(voted(edited, [*keys, "kind"], "body").groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp")))
    nexts = marks.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("n_id"), F.col("hash").alias("n_hash"), F.col("fp").alias("next_fp")).dropDuplicates(["n_id", "n_hash"])
    near = within_radius(marks.select("fp"), marks.where(F.col("doc_id") % every == 0).select("fp"))
    asked = F.when(F.col("doc_id") % every == 0, F.col("fp"))
    return (marks.join(nexts, (F.col("next_id") == F.col("n_id")) & (F.col("next_hash") == F.col("n_hash")), "left")
            .withColumn("asked", asked).join(near.withColumnRenamed("fp", "near_fp"), F.col("asked") == F.col("near_fp"), "left")
            .select("doc_id", "n_chars", "edited_sha256", text_of(F.col("fp")).alias("fingerprint"), text_of(F.col("edited_fp")).alias("edited_fingerprint"),
                    likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
                    (F.col("near") - 1).alias("near_docs")))
