"""Synthetic contigs: breaking, splitting and joining of sequences."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.operators.ranking import buckets_for, hash_bucket, spread, with_rank
from contactloom.session import cut

#: so many pieces of refused pairs, at most, go to the last matching as long as random orders still join many
FEW = 20_000


def broken(contigs: DataFrame, size: int, legacy: bool = False) -> DataFrame:
    """(chrom, piece, start, end): contigs cut into even pieces of about `size` bases; shorter ones give none.

    A contig of n bases has n div size pieces of n div (n div size) bases, the last with what is left.
    legacy loses the last base and, if the pieces divide the contig evenly, the last piece.
    """
    whole = contigs.dropna(subset=["chrom", "length"]).where(F.col("length") >= size)
    cut = whole.withColumn("_step", F.expr(f"length div (length div {size})"))
    if legacy:
        # limits are 0, step, 2 step, ... below the length, the last of them replaced by length - 1
        limits = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.col("_step"))
        cut = cut.withColumn("_limits", limits).withColumn("_n", F.size("_limits") - 1).where("_n > 0")
        rows = cut.select("chrom", "length", "_step", "_n", F.posexplode(F.slice("_limits", 1, F.col("_n"))).alias("piece", "start"))
        last = F.col("length") - 1
    else:
        cut = cut.withColumn("_n", F.expr(f"length div {size}").cast("int"))
        rows = cut.select("chrom", "length", "_step", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("piece"))
        rows = rows.withColumn("start", F.col("piece") * F.col("_step"))
        last = F.col("length")
    end = F.when(F.col("piece") == F.col("_n") - 1, last).otherwise(F.col("start") + F.col("_step"))
    return rows.select("chrom", F.col("piece").cast("long").alias("piece"), F.col("start").cast("long").alias("start"), end.cast("long").alias("end"))


def split_sequences(fasta: DataFrame, separator: str = "NNN") -> DataFrame:
    """(name, piece, seq): scaffolds split at every separator from left to right, empty pieces dropped.

    piece counts the pieces of a scaffold that stay, from 1.
    """
    parts = F.filter(F.split("seq", F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E"))), lambda s: s != "")
    return fasta.where("seq is not null").select("name", F.posexplode(parts).alias("_i", "seq")).select(
        "name", (F.col("_i") + 1).cast("long").alias("piece"), "seq"
    )


def reverse_complement(seq: Column) -> Column:
    """The reverse complement in upper case; null for a sequence with letters other than A, C, G, T and N."""
    upper = F.upper(seq)
    return F.when(upper.rlike("^[ACGTN]*$"), F.translate(F.reverse(upper), "ACGT", "TGCA"))


def last_pairs(pieces: list[tuple[str, int]], least: int, most: int) -> list[tuple[tuple[str, int], tuple[str, int]]]:
    """Pairs of (chrom, start), such that no two pieces that are left could be joined.

    First pieces of different contigs: in the order of the contigs a piece meets the one half of all further
    on, and only the contig with more than half of the pieces meets itself. Its refused pieces then meet the
    next free one that is far enough away.
    """
    pieces = sorted(pieces)
    half = len(pieces) // 2
    pairs, left = [], pieces[half : len(pieces) - half]
    for a, b in zip(pieces[:half], pieces[len(pieces) - half :], strict=True):
        if a[0] != b[0]:
            pairs.append((a, b))
        else:
            left += [a, b]
    left.sort()
    used, at = [False] * len(left), 0
    for i, (_, start) in enumerate(left):
        if used[i]:
            continue
        at = max(at, i + 1)
        while at < len(left) and (used[at] or left[at][1] - start < max(least, 1)):
            at += 1
        if at < len(left) and left[at][1] - start <= most:
            used[i] = used[at] = True
            pairs.append((left[i], left[at]))
    return pairs


def _last_pairs(least: int, most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """last_pairs of the pieces of one round, for applyInPandas."""

    def made(pieces: pd.DataFrame) -> pd.DataFrame:
        found = last_pairs(list(zip(pieces["chrom"], pieces["start"].astype(int), strict=True)), least, most)
        rows = [(pieces["round"].iloc[0], k, *a, *b) for k, (a, b) in enumerate(found, 1)]
        return pd.DataFrame(rows, columns=["round", "_k", "chrom1", "start1", "chrom2", "start2"])

    return made


def chimeras(contigs: DataFrame, half: int, rounds: int = 1, least: int = 0, most: int = 5_000_000, seed: int = 7) -> DataFrame:
    """(name, round, chrom1, start1, chrom2, start2, inverted): joins of two pieces of `half` bases each.

    Pieces begin every half bases of contigs that are long enough. In every round the pieces are put in
    a random order (by a hash, so that it is the same in every run), neighbours of it are joined, and no
    piece is used twice. Two pieces of one contig are joined only if they are `least` to `most` apart; the
    pieces of refused pairs are ordered anew among themselves. When few are left, or most are refused as they
    are of one contig, last_pairs joins what can be joined, one round in a task: at the end no two pieces
    are left that could be joined. A quarter of the joins inverts the second piece.
    """
    whole = contigs.dropna(subset=["chrom", "length"]).select("chrom", "length")
    pieces = (
        spread(whole, F.lit(0), F.col("length") - half, half, "start").drop("length")
        .withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    )
    apart = F.abs(F.col("start1") - F.col("start2"))
    allowed = (F.col("chrom1") != F.col("chrom2")) | apart.between(max(least, 1), most)
    columns = ["round", "_k", "chrom1", "start1", "chrom2", "start2"]
    made, left, count, attempt = [], pieces, pieces.count(), 0
    while count > FEW:
        hashed = left.withColumn("_h", F.xxhash64("chrom", "start", "round", F.lit(seed), F.lit(attempt)))
        hashed = hashed.withColumn("_b", hash_bucket(F.col("_h"), buckets_for(count)))
        ranked = with_rank(hashed, ["round"], "_b", [F.col("_h"), F.col("chrom"), F.col("start")], "_rank")
        one = F.struct("_rank", "chrom", "start")
        pair = ranked.groupBy("round", F.expr("(_rank + 1) div 2").alias("_k")).agg(F.min(one).alias("a"), F.max(one).alias("b"))
        pair = pair.select(
            "round", "_k", F.col("a.chrom").alias("chrom1"), F.col("a.start").alias("start1"), F.col("b.chrom").alias("chrom2"), F.col("b.start").alias("start2"),
        )
        # read twice: for the joins and for what is refused; a last odd piece meets itself
        pair = cut(pair.withColumn("_ok", allowed))
        made.append(pair.where("_ok").select(F.lit(attempt).alias("_attempt"), *columns))
        ends = F.array_distinct(F.array(*(F.struct(F.col(f"chrom{i}").alias("chrom"), F.col(f"start{i}").alias("start")) for i in (1, 2))))
        left = pair.where(~F.col("_ok")).select("round", F.explode(ends).alias("_p")).select("_p.chrom", "_p.start", "round")
        before, count, attempt = count, left.count(), attempt + 1
        if count > 0.9 * before:
            break
    last = left.groupBy("round").applyInPandas(_last_pairs(least, most), "round int, _k long, chrom1 string, start1 long, chrom2 string, start2 long")
    joined = last.select(F.lit(attempt).alias("_attempt"), *columns)
    for part in made:
        joined = joined.union(part)
    return joined.select(
        F.format_string("sim_%d_%d_%d", "round", "_attempt", "_k").alias("name"), "round", "chrom1", "start1", "chrom2", "start2",
        (F.pmod(F.xxhash64("chrom1", "start2"), F.lit(4)) == 0).alias("inverted"),
    )


def chimera_alignments(made: DataFrame, half: int) -> DataFrame:
    """The true alignments of chimeras: two rows each, (Q_name, Q_len, Q_start, Q_end, Strand, T_name)."""
    part = lambda a, b, chrom, strand: F.struct(
        F.lit(a).cast("long").alias("Q_start"), F.lit(b).cast("long").alias("Q_end"), strand.alias("Strand"), F.col(chrom).alias("T_name")
    )
    back = F.when(F.col("inverted"), "-").otherwise("+")
    both = F.array(part(0, half, "chrom1", F.lit("+")), part(half, 2 * half, "chrom2", back))
    return made.select(F.col("name").alias("Q_name"), F.lit(2 * half).cast("long").alias("Q_len"), F.explode(both).alias("_p")).select("Q_name", "Q_len", "_p.*")


def chimera_sequences(made: DataFrame, fasta: DataFrame, half: int) -> DataFrame:
    """(name, seq): both pieces of each chimera, the second as reverse complement if inverted."""
    piece = lambda seq, start: F.substring(F.upper(seq), F.col(start).cast("int") + 1, F.lit(half))
    one = fasta.select(F.col("name").alias("chrom1"), F.col("seq").alias("_s1"))
    two = fasta.select(F.col("name").alias("chrom2"), F.col("seq").alias("_s2"))
    second = piece(F.col("_s2"), "start2")
    return made.join(one, "chrom1").join(two, "chrom2").select(
        "name", F.concat(piece(F.col("_s1"), "start1"), F.when(F.col("inverted"), reverse_complement(second)).otherwise(second)).alias("seq")
    )
