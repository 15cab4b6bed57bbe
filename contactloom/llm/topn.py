"""The N best rows of every group, however many rows a group has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows a task keeps before it leaves out those that cannot be bounds.
KEPT_ROWS = 1_000_000
#: Groups whose bound is broadcast.
MOST_BOUNDS = 1 << 16


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """One number per row; equal numbers for equal rows, nulls included."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        encoded = pc.dictionary_encode(column, null_encoding="encode")
        code = code * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    return code


def _best(rows: pa.Table, keys: list[str], n: int) -> tuple[pa.Table, np.ndarray]:
    """The n best different rows of each group by score and then by tie, in that order, and where the n-th ones are.

    left_out of an n-th row is the number of all rows of its group that were left out.
    """
    code = _codes([rows[k].combine_chunks() for k in keys])
    score, tie, out = (rows[c].to_numpy() for c in ("score", "tie", "left_out"))
    order = np.lexsort((tie, -score, code))
    code, score, tie, out = code[order], score[order], tie[order], out[order]
    # none of no rows: a partition can end just where its bounds went out
    again = np.r_[False, (code[1:] == code[:-1]) & (score[1:] == score[:-1]) & (tie[1:] == tie[:-1])][: len(code)]
    gone = np.zeros(code.max(initial=-1) + 1, np.int64)
    np.add.at(gone, code, out)
    order, code = order[~again], code[~again]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
    size = np.diff(np.r_[first, len(code)])
    place = np.arange(len(code)) - np.repeat(first, size)
    gone[code[first]] += np.maximum(size - n, 0)
    kept = place < n
    last = place[kept] == n - 1
    left_out = np.where(last, gone[code[kept]], 0)
    best = rows.take(pa.array(order[kept]))
    at = best.schema.get_field_index("left_out")
    # with the same schema as before, as what is kept is put together with later batches
    return best.set_column(at, best.schema.field(at), pa.array(left_out)), np.flatnonzero(last)


def lower_bounds(rows: DataFrame, group: list[str], n: int) -> DataFrame:
    """(group, bound, left_out) of (group, score, tie): a row of the group that at least n different rows equal or beat.

    Each partition's own n-th best row is such a bound; of a group's bounds the best is taken. left_out is
    the number of rows that the partitions know to be worse.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        waiting = 0
        for batch in batches:
            kept.append(pa.Table.from_batches([batch]))
            waiting += batch.num_rows
            if waiting > KEPT_ROWS:
                best, at = _best(pa.concat_tables(kept), group, n)
                if best.num_rows > KEPT_ROWS // 2:
                    # too many groups to keep them all: their bounds go out, and the rest of the partition is searched anew
                    yield from best.take(pa.array(at)).combine_chunks().to_batches()
                    best = best.slice(0, 0)
                kept, waiting = [best], best.num_rows
        if kept:
            best, at = _best(pa.concat_tables(kept), group, n)
            yield from best.take(pa.array(at)).combine_chunks().to_batches()

    counted = rows.select(*group, "score", "tie", F.lit(0).cast("long").alias("left_out"))
    local = counted.mapInArrow(run, f"{kinds}, score double, tie bigint, left_out bigint")
    # of two rows the one with the smaller tie is better, which the complement turns round
    return local.groupBy(*group).agg(
        F.max(F.struct("score", F.bitwise_not("tie").alias("last"))).alias("bound"), F.sum("left_out").alias("left_out")
    )


def within_bounds(rows: DataFrame, group: list[str], n: int, most: int = MOST_BOUNDS) -> DataFrame:
    """The rows (group, score, tie, ...) without those below the bound of their group.

    The bounds of the `most` groups that have most rows below it are broadcast, which bounds their size.
    A bound beyond these could only meet its rows by moving them, as the ranking does anyway: they stay.
    """
    found = lower_bounds(rows, group, n).where("left_out > 0").orderBy(F.desc("left_out"), *group).limit(most)
    bounds = found.select(*(F.col(k).alias(f"b_{k}") for k in group), "bound")
    same = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in group]
    score, tie = F.col("score"), F.bitwise_not("tie")
    reaches = (score > F.col("bound.score")) | ((score == F.col("bound.score")) & (tie >= F.col("bound.last")))
    return rows.join(F.broadcast(bounds), same, "left").where(F.col("bound").isNull() | reaches).select(*rows.columns)


def top_n(df: DataFrame, group: list[str], score: str, tie: str, n: int = 5, most_bounds: int = MOST_BOUNDS) -> DataFrame:
    """The rows that are among the first n of their group by score descending, then tie ascending, with `place`.

    Local n-th best rows bound what can be among the first; rows below their group's bound leave
    before the shuffle, so a group of millions arrives as a few rows. Groups without a bound keep all
    rows, so the result is the same whatever `most_bounds` is.

    Rows with null or NaN score are left out. Null group values form groups of their own. A row that
    repeats another's group, score and tie is the same row and comes out once; ties beyond that cannot
    occur. tie must be an integer column; rows without one are left out. A column `place` is replaced. Groups with fewer rows give all; an empty table gives none.
    """
    # other columns travel as one, so that their names cannot clash with those used here
    keys = [f"g{i}" for i in range(len(group))]
    others = [c for c in df.columns if c not in (*group, tie, "place")]
    # a score that is a double anyway is not carried twice
    rest = [c for c in others if c != score or df.schema[c].dataType.simpleString() != "double"]
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(tie).isNotNull()).select(
        *(F.col(c).alias(k) for c, k in zip(group, keys)),
        F.col(score).cast("double").alias("score"),
        F.col(tie).cast("long").alias("tie"),
        F.struct(*(rest or [F.lit(0).cast("tinyint").alias("_")])).alias("row"),
    )
    kept = within_bounds(rows, keys, n, most_bounds)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("tie"))
    placed = kept.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= n).dropDuplicates([*keys, "place"])
    of = dict(zip(group, map(F.col, keys))) | {tie: F.col("tie").cast(df.schema[tie].dataType)}
    whole = lambda c: of[c] if c in of else F.col("row").getField(c) if c in rest else F.col("score")
    return placed.select(*(whole(c).alias(c) for c in df.columns if c != "place"), "place")
