"""Contacts as a stream of read pairs: (chrom1, pos1, chrom2, pos2, ts, read_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(reads: DataFrame, late: str = "10 minutes", key: str = "read_id", ts: str = "ts") -> DataFrame:
    """Each read once; repeats within `late` of it are dropped, and rows later than that are ignored."""
    return reads.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def binned(reads: DataFrame, resolution: int, every: str = "1 hour", late: str | None = "10 minutes", ts: str = "ts") -> DataFrame:
    """(start, chrom1, bin1, chrom2, bin2, cnt): contact counts per time window, in the upper triangle.

    With output mode append, a window comes out when the watermark has passed its end; the counts of all
    windows of a cell add up to its count in the batch operator. After once, which sets the watermark,
    late is None.
    """
    if late:
        reads = reads.withWatermark(ts, late)
    a, b = F.struct("chrom1", F.expr(f"pos1 div {resolution}").alias("bin")), F.struct("chrom2", F.expr(f"pos2 div {resolution}").alias("bin"))
    first = F.least(F.struct(a["chrom1"].alias("c"), a["bin"].alias("b")), F.struct(b["chrom2"].alias("c"), b["bin"].alias("b")))
    second = F.greatest(F.struct(a["chrom1"].alias("c"), a["bin"].alias("b")), F.struct(b["chrom2"].alias("c"), b["bin"].alias("b")))
    cells = reads.dropna(subset=["chrom1", "pos1", "chrom2", "pos2"]).select(
        ts, first["c"].alias("chrom1"), first["b"].alias("bin1"), second["c"].alias("chrom2"), second["b"].alias("bin2")
    )
    return cells.groupBy(F.window(ts, every).alias("_w"), "chrom1", "bin1", "chrom2", "bin2").agg(F.count(F.lit(1)).alias("cnt")).select(
        F.col("_w.start").alias("start"), "chrom1", "bin1", "chrom2", "bin2", "cnt"
    )


def bursts(events: DataFrame, key: str, gap: str = "5 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """(key, start, end, n): runs of events of a key with gaps below `gap`: one-dimensional clusters in time."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("_w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n"
    )
