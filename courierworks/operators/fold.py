"""Ordered folds: a state carried from row to row within a key, for rules a window cannot express.

`array_fold` folds sorted arrays of a key and time segment with built-in expressions; what it cannot settle goes row by row through
`ordered_fold`. There rows are shuffled by key, sorted, and read as a stream of Arrow batches with one state in memory, so
no group is ever collected. Keys with very many rows are cut into time segments that run in parallel:
each segment starts from the state the one before it ended with, which is first guessed by running
every segment from an empty state. Where the guess proves right for all segments of a key, its result
is exact; keys where it does not are run again with wider segments, at last with one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from courierworks.operators.keyed import join_checked, time_bucket
from courierworks.session import checkpoint, stage

# A step takes the state (a list of floats, or None at the start of a key) and the row's values, and
# gives the row's outputs and the new state.
Step = Callable[[list[float] | None, tuple], tuple[tuple, list[float] | None]]


def _values(column: pa.Array, missing: float | None) -> list:
    """The values of a column; missing numbers as `missing`."""
    number = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
    if column.null_count == 0 and number:
        return column.to_numpy(zero_copy_only=False).tolist()
    values = column.to_pylist()
    return [missing if x is None else x for x in values] if number and missing is not None else values


def _runs(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(values of `columns`, first row, row after the last) of each run of rows that are equal in them."""
    arrays = [batch.column(c) for c in columns]
    places = [np.array(a.to_pylist(), object) if a.null_count else a.to_numpy(zero_copy_only=False) for a in arrays]
    changes = [np.flatnonzero(p[1:] != p[:-1]) + 1 for p in places]
    starts = np.unique(np.concatenate([[0], *changes])).tolist()
    for low, high in zip(starts, [*starts[1:], batch.num_rows]):
        yield tuple(p[low] for p in places), low, high


def _runner(step: Step, key: str, inputs: list[str], ids: list[str], outputs: T.StructType, exits: bool, missing: float | None):
    """A task's work: rows in order, as Arrow batches; `ids` go through as they are, only `inputs` become Python values.

    With time segments the rows have __segment, __kind and __state, and those of kind 0 carry the state that a segment starts with.
    """
    types = [to_arrow_type(field.dataType) for field in outputs.fields]

    def ends(key_type: pa.DataType, done: list[tuple]) -> pa.RecordBatch:
        keys, segments, states = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(segments, pa.int64()), pa.array(states, pa.list_(pa.float64()))], [key, "__segment", "__state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, key_type = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = "__segment" in batch.schema.names
            key_type = batch.schema.field(key).type
            kinds = batch.column("__kind").to_numpy(zero_copy_only=False) if cut else None
            rows = list(zip(*(_values(batch.column(c), missing) for c in inputs)))
            done, made = [], []
            for place, low, high in _runs(batch, [key, "__segment"] if cut else [key]):
                if place != current:
                    if exits and current is not None:
                        done.append((*current, state))
                    current, state = place, None
                while cut and low < high and kinds[low] == 0:
                    state, low = batch.column("__state")[low].as_py(), low + 1
                for row in rows[low:high]:
                    result, state = step(state, row)
                    if not exits:
                        made.append(result)
            if exits:
                if done:
                    yield ends(key_type, done)
            elif made:
                kept = batch if len(made) == batch.num_rows else batch.filter(pa.array(kinds != 0))
                columns = [pa.array(column, kind, from_pandas=True) for column, kind in zip(zip(*made), types)]
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in [key, *ids]), *columns], [key, *ids, *outputs.names])
        if exits and current is not None:
            yield ends(key_type, [(*current, state)])

    return run


def ordered_fold(rows: DataFrame, key: str, ts: str, tie: str, inputs: list[str], ids: list[str], step: Step,
                 outputs: T.StructType, hot_rows: int = 5_000_000, segment_seconds: int = 3600,
                 widen: int = 24, missing: float | None = math.nan) -> DataFrame:
    """Fold every key in the order (`ts`, `tie`) and return key, `ids` and the step's outputs per row.

    `inputs` are the columns a step reads; a missing number comes to it as `missing`. Rows that are equal in `ts` and `tie` go by their
    inputs. Keys with more than `hot_rows` rows run in segments.
    """
    wanted = list(dict.fromkeys([key, ts, tie, *inputs, *ids]))
    rows = rows.select(*wanted)
    key_type = rows.schema[key].dataType
    exit_schema = T.StructType([T.StructField(key, key_type), T.StructField("__segment", T.LongType()),
                                T.StructField("__state", T.ArrayType(T.DoubleType()))])
    out_schema = T.StructType([rows.schema[c] for c in [key, *(c for c in ids if c != key)]] + list(outputs.fields))
    order = list(dict.fromkeys([ts, tie, *inputs]))

    def placed(df: DataFrame, seconds: int) -> DataFrame:
        return df.withColumns({"__segment": F.coalesce(time_bucket(ts, seconds), F.lit(-(1 << 62))), "__kind": F.lit(1),
                               "__state": F.lit(None).cast("array<double>")})

    def run(df: DataFrame, exits: bool) -> DataFrame:
        cut = ["__segment"] if "__segment" in df.columns else []
        ordered = df.repartition(key, *cut).sortWithinPartitions(key, *cut, *(["__kind"] if cut else []), *order)
        return ordered.mapInArrow(_runner(step, key, inputs, [c for c in ids if c != key], outputs, exits, missing), exit_schema if exits else out_schema)

    def with_entries(df: DataFrame, exits: DataFrame) -> DataFrame:
        previous = F.lag("__state").over(Window.partitionBy(key).orderBy("__segment"))
        entries = exits.select(key, "__segment", previous.alias("__state")).withColumn("__kind", F.lit(0))
        return df.unionByName(entries, allowMissingColumns=True)

    hot = rows.groupBy(key).count().where(F.col("count") > hot_rows).select(key)
    hot = checkpoint(hot)
    if hot.isEmpty():
        return run(rows, exits=False)
    result = run(join_checked(rows, hot, [key], "left_anti"), exits=False)
    pending, seconds = join_checked(rows, hot, [key], "left_semi"), segment_seconds
    span = pending.agg((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))).alias("us")).first()["us"] or 0
    while seconds * 1_000_000 < span:
        cut = placed(pending, seconds)
        guess = checkpoint(run(cut, exits=True))
        started = with_entries(cut, guess)
        proof = run(started, exits=True).withColumnRenamed("__state", "__proved")
        wrong = checkpoint(guess.join(proof, [key, "__segment"]).where(
            ~F.col("__state").eqNullSafe(F.col("__proved"))).select(key).distinct())
        result = result.unionByName(run(started, exits=False).join(F.broadcast(wrong), key, "left_anti")
                                    if wrong.count() <= 50_000 else
                                    run(started, exits=False).join(wrong, key, "left_anti"))
        if wrong.isEmpty():
            return result
        pending, seconds = join_checked(pending, wrong, [key], "left_semi"), seconds * widen
    return result.unionByName(run(pending, exits=False))


@dataclass(frozen=True)
class Rule:
    """A step as column expressions: `update(state, row)` gives a struct of the new state and the row's outputs.

    `state` is the type of the state, NULL before the first row of a key; `row` has the inputs as fields.
    """

    state: T.StructType
    update: Callable[[Column, Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_fold(rows: DataFrame, key: str, ts: str, tie: str, inputs: list[str], ids: list[str], step: Step, rule: Rule, outputs: T.StructType,
               segment_seconds: int = 3600, max_segment: int = 20_000, **python) -> DataFrame:
    """`ordered_fold` by built-in expressions: the rows of a key and time segment are one sorted array, folded in the row.

    A key's segments run in parallel. Each starts with the state that the one before it ends with when it starts from nothing; a run from there proves
    the guess, since the first segment's is true and each true end makes the next one true. Keys whose proof fails, because an early state
    is carried through whole segments, and keys with more than `max_segment` rows in a segment are folded row by row (`ordered_fold` with
    the options `python`), so no array outgrows that bound.
    """
    carried = list(dict.fromkeys([ts, tie, *inputs, *ids]))
    rows = rows.select(key, *[c for c in carried if c != key])
    carried = [c for c in carried if c != key]
    step_by_step = lambda df: ordered_fold(df, key, ts, tie, inputs, ids, step, outputs, **python)
    placed = rows.withColumn("__segment", F.coalesce(time_bucket(ts, segment_seconds), F.lit(-(1 << 62))))
    sizes = placed.groupBy(key, "__segment").agg(F.count("*").alias("__n")).groupBy(key).agg(F.max("__n").alias("__most"), F.count("*").alias("__segments"))
    most = sizes.agg(F.max("__most"), F.max("__segments")).first()
    rest = None
    if (most[0] or 0) > max_segment:
        wide = checkpoint(sizes.where(F.col("__most") > max_segment).select(key))
        rest = step_by_step(join_checked(rows, wide, [key], "left_semi"))
        placed = join_checked(placed, wide, [key], "left_anti")
    arrays = placed.groupBy(key, "__segment").agg(F.sort_array(F.collect_list(F.struct(*carried))).alias("__rows"))
    result_type = T.StructType([T.StructField("state", rule.state), T.StructField("out", T.ArrayType(outputs))])

    def folded(entry: Column, keep: bool) -> Column:
        start = F.struct(entry.cast(rule.state).alias("state"), F.array().cast(T.ArrayType(outputs)).alias("out")).cast(result_type)
        merge = lambda acc, row: let(rule.update(acc["state"], row), lambda new: F.struct(
            new["state"].cast(rule.state).alias("state"), (F.array_append(acc["out"], new["out"].cast(outputs)) if keep else acc["out"]).alias("out")))
        return F.aggregate("__rows", start, merge)

    def opened(df: DataFrame) -> DataFrame:
        names = [f.name for f in outputs.fields]
        each = df.select(key, F.explode(F.arrays_zip(F.col("__rows").alias("row"), F.col("__done.out").alias("out"))).alias("at"))
        return each.select(key, *[F.col(f"at.row.{c}").alias(c) for c in ids if c != key], *[F.col(f"at.out.{n}").alias(n) for n in names])

    nothing = F.lit(None).cast(rule.state)
    if (most[1] or 0) <= 1:
        result = opened(arrays.withColumn("__done", folded(nothing, True)))
    else:
        arrays = stage(arrays)
        guess = stage(arrays.select(key, "__segment", folded(nothing, False)["state"].alias("__end")))
        entries = guess.withColumn("__entry", F.lag("__end").over(Window.partitionBy(key).orderBy("__segment")))
        proof = stage(arrays.join(entries, [key, "__segment"]).withColumn("__done", folded(F.col("__entry"), True)))
        wrong = checkpoint(proof.where(~F.col("__done.state").eqNullSafe(F.col("__end"))).select(key).distinct())
        if wrong.isEmpty():
            result = opened(proof)
        else:
            result = opened(join_checked(proof, wrong, [key], "left_anti")).unionByName(step_by_step(join_checked(rows, wrong, [key], "left_semi")))
    return result if rest is None else result.unionByName(rest)
