"""Records that are, exactly or almost, in an evaluation split and in the training split."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.functions import names
from contactloom.operators.pairing import paired
from contactloom.session import cut, small

TRAIN, EVALUATION = "train", ("val", "test")
#: Cells of a rolling hash, hashes of a window, and the fingerprints that a chain has at least.
GRAM, WINDOW, LEAST_SEEDS = 9, 6, 2
#: With an image of which less than this part is no padding, one fingerprint is enough.
TIGHT = 0.6
#: From this part of its windows on, stretches of one value count as an image's own.
FLAT_WINDOWS = 0.25
#: Cells that both images must have, and the part of them that must be equal.
LEAST_CELLS, LEAST_EQUAL = 150, (9, 10)
#: Images with at most this part of positive cells have a fingerprint for each of these.
SPARSE = 0.3
#: The classes of a fingerprint that has more of them are dealt to several tasks.
MOST_CLASSES = 1000
#: Parts by which fingerprints are counted first, and words of 64 bits that tell which records are candidates.
MOST_PARTS, WORDS = 1 << 20, 1 << 18

_NONE = np.iinfo(np.uint64).max


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly, in place."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _values(cells: np.ndarray) -> np.ndarray:
    return cells.astype(np.int64).astype(np.uint64) + np.uint64(2)


def fingerprints(lines: np.ndarray) -> np.ndarray:
    """The winnowed fingerprints of the lines of each image (images, lines, cells): (images, lines, windows), 0 for none.

    A rolling hash runs over the GRAM-cell stretches of a line, and the least hash of every WINDOW
    neighbouring ones is kept. As images are compared cell by cell, line number and position go into the
    hash, so that only stretches at the same place meet. Stretches with padding are left out. Those of
    one value tell least: a window has one only where it has no other, and only in images with many such
    windows; elsewhere unlike images would meet in them.
    """
    n, count, cells = lines.shape
    grams = max(cells - GRAM + 1, 0)
    window = min(WINDOW, grams)
    if not n or not grams:
        return np.zeros((n, count, 0), np.uint64)
    # rows and columns of an image share their numbers, so a transposed image has the same fingerprints
    number = (np.arange(count) % cells).astype(np.uint64)
    value = _values(lines)
    base, top = np.uint64(0x100000001B3), np.uint64(pow(0x100000001B3, GRAM - 1, 1 << 64))
    padded = np.cumsum(np.concatenate([np.zeros((n, count, 1), np.int16), lines < 0], 2), 2, dtype=np.int16)
    changes = np.cumsum(np.concatenate([np.zeros((n, count, 1), np.int16), lines[:, :, 1:] != lines[:, :, :-1]], 2), 2, dtype=np.int16)
    rolling = np.zeros((n, count), np.uint64)
    hashes = np.empty((n, count, grams), np.uint64)
    for i in range(cells):
        if i >= GRAM:
            rolling -= value[:, :, i - GRAM] * top
        rolling = rolling * base + value[:, :, i]
        start = i - GRAM + 1
        if start < 0:
            continue
        h = _mix(rolling + _mix(number * np.uint64(64) + np.uint64(start + 1)))
        # the first bit is for stretches of one value
        h >>= np.uint64(1)
        h |= (changes[:, :, i] == changes[:, :, start]).astype(np.uint64) << np.uint64(63)
        h[padded[:, :, i + 1] > padded[:, :, start]] = _NONE
        hashes[:, :, start] = h
    least = hashes[:, :, : grams - window + 1].copy()
    for k in range(1, window):
        np.minimum(least, hashes[:, :, k : grams - window + 1 + k], out=least)
    least[least == _NONE] = 0
    flat = least >> np.uint64(63) == 1
    least[flat & (flat.mean((1, 2)) < FLAT_WINDOWS)[:, None, None]] = 0
    return least


def _digest(images: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each image (images, rows, columns): the less of those of the image and, if square, its transposition."""
    n, rows, columns = images.shape
    cells = _values(images.reshape(n, -1))
    # a random factor for each place, so that a hash is one product with all cells
    factors = _mix(np.arange(1, 2 * rows * columns + 3, dtype=np.uint64)) | np.uint64(1)
    ways = [factors[:-2].reshape(rows, columns, 2)]
    if rows == columns:
        ways.append(ways[0].transpose(1, 0, 2))
    one, *other = (cells @ np.ascontiguousarray(way).reshape(-1, 2) + factors[-2:] for way in ways)
    for two in other:
        less = (two[:, 0] < one[:, 0]) | (two[:, 0] == one[:, 0]) & (two[:, 1] < one[:, 1])
        one[less] = two[less]
    return one


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The images of a column by their number of cells, as (images, rows, columns), and where they are; null cells are padding.

    Numbers that are no square make one row.
    """
    sizes = column.value_lengths().fill_null(0).to_numpy()
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        cells = column.take(pa.array(at)).flatten().fill_null(-1).to_numpy()
        side = isqrt(size)
        shape = (side, side) if side * side == size else (1, size)
        yield cells.reshape(len(at), *shape).astype(np.int32, copy=False), at


def _seeds(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(image, fingerprint) of all fingerprints of square images: even ones from winnowing, odd ones for single cells."""
    n, side, _ = images.shape
    turned = np.ascontiguousarray(images.transpose(0, 2, 1))
    even = (images == turned).all((1, 2))
    rows, prints = [], []
    for mask in (even, ~even):
        at = np.flatnonzero(mask)
        if len(at):
            lines = images[at] if even[at[0]] else np.concatenate([images[at], turned[at]], 1)
            found = fingerprints(lines).reshape(len(at), -1)
            # an image that is not symmetric has twice the lines; of their fingerprints the half with an even hash is kept
            kept = (found != 0) & (True if even[at[0]] else (found >> np.uint64(40)) & np.uint64(1) == 0)
            rows.append(np.repeat(at, kept.sum(1)))
            prints.append(found[kept] << np.uint64(1))
    # nearly empty images: every positive cell, with its place regardless of transposition
    positive = images > 0
    few = np.flatnonzero(positive.sum((1, 2)) <= SPARSE * side * side)
    at, r, c = np.nonzero(positive[few])
    rows.append(few[at])
    place = (np.minimum(r, c) * side + np.maximum(r, c)).astype(np.uint64)
    prints.append(_mix(_values(images[few[at], r, c]) * np.uint64(1 << 20) + place) << np.uint64(1) | np.uint64(1))
    return np.concatenate(rows), (np.concatenate(prints) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def classified(images: DataFrame) -> DataFrame:
    """(sample_id, split, source, class) of every record of the three splits with a positive cell.

    class is the same for images that are equal as they are or transposed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, digest = np.zeros(len(batch), bool), np.zeros((len(batch), 2), np.uint64)
            for made, at in _by_size(batch.column("x")):
                known[at] = (made > 0).any((1, 2))
                digest[at] = _digest(made)
            classes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(batch), [None, pa.py_buffer(digest.tobytes())]).cast(pa.binary())
            whole = pa.RecordBatch.from_arrays([*batch.columns[:3], classes], ["sample_id", "split", "source", "class"])
            yield whole.filter(pa.array(known))

    rows = _with_image(images).select(F.col("sample_id").cast("long"), "split", "source", "x")
    return rows.mapInArrow(run, "sample_id long, split string, source string, class binary")


def fingerprinted(images: DataFrame) -> DataFrame:
    """(id, side, filled, valid, prints) of every record of the three splits.

    prints are the fingerprints of rows and columns, and of single positive cells where these are few;
    filled is the number of positive cells and valid that of cells without padding. An image that is no square, or too small to share LEAST_CELLS
    cells with another, has none and side 0: it equals only its exact copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            side, filled, valid = (np.zeros(n, np.int32) for _ in range(3))
            rows, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
            for made, at in _by_size(batch.column("x")):
                filled[at], valid[at] = (made > 0).sum((1, 2)), (made >= 0).sum((1, 2))
                if made.shape[1] == made.shape[2] and made[0].size >= LEAST_CELLS:
                    side[at] = made.shape[1]
                    where, found = _seeds(made)
                    rows.append(at[where])
                    prints.append(found)
            each = np.unique(np.concatenate(rows).astype(np.uint64) << np.uint64(32) | np.concatenate(prints).astype(np.uint64))
            ends = np.searchsorted(each >> np.uint64(32), np.arange(n + 1, dtype=np.uint64)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((each & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(side), pa.array(filled), pa.array(valid), lists], ["id", "side", "filled", "valid", "prints"]
            )

    rows = _with_image(images).select(F.col("sample_id").cast("long").alias("id"), "x")
    return rows.mapInArrow(run, "id long, side int, filled int, valid int, prints array<int>")


def _in_split(images: DataFrame) -> DataFrame:
    return images.where(F.col("split").isin(TRAIN, *EVALUATION))


def _with_image(images: DataFrame) -> DataFrame:
    return _in_split(images).where(F.col("x").isNotNull())


def compared(pairs: DataFrame) -> DataFrame:
    """Adds to rows with images xa and xb of equal size: cells (both have), equal, turned; for the better of both ways round.

    A way round with LEAST_CELLS common cells is better than one without, then the larger equal part.
    """
    keep = [c for c in pairs.columns if c not in ("xa", "xb")]
    fields = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = np.zeros((3, len(batch)), np.int64)
            for (a, at), (b, _) in zip(_by_size(batch.column("xa")), _by_size(batch.column("xb")), strict=True):
                for turned, other in enumerate((b, b.transpose(0, 2, 1))):
                    both = (a >= 0) & (other >= 0)
                    cells, equal = both.sum((1, 2)), (both & (a == other)).sum((1, 2))
                    enough, before = cells >= LEAST_CELLS, best[0, at] >= LEAST_CELLS
                    # as shares, compared without division
                    more = equal * np.maximum(best[0, at], 1) > best[1, at] * np.maximum(cells, 1)
                    better = (enough & ~before) | ((enough == before) & more)
                    best[:, at[better]] = np.array([cells, equal, np.full(len(at), turned)])[:, better]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array(v) for v in best[:2]), pa.array(best[2] == 1)], [*keep, "cells", "equal", "turned"]
            )

    return pairs.select(*keep, "xa", "xb").mapInArrow(run, f"{fields}, cells long, equal long, turned boolean")


def hot_prints(prints: DataFrame, total: int, most: int = MOST_CLASSES) -> DataFrame | None:
    """(print): those of more than `most` rows of prints (print, ...); None if there are none.

    Prints are first counted by a hash of theirs, which moves few rows; only those of full parts are
    counted one by one. total is the number of rows, about.
    """
    parts = 1 << min(max(4 * total // max(most, 1), 1).bit_length(), MOST_PARTS.bit_length() - 1)
    part = F.pmod(F.hash("print"), F.lit(parts))
    full = prints.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_p")
    counted = prints.withColumn("_p", part).join(F.broadcast(full), "_p", "left_semi").groupBy("print").agg(F.count(F.lit(1)).alias("_n"))
    hot = cut(counted.where(F.col("_n") > most).select("print"))
    return None if hot.isEmpty() else hot


def chained(classes: DataFrame, most: int = MOST_CLASSES) -> DataFrame:
    """(id_a, id_b): all pairs of a class in train and another held out that share a chain of fingerprints.

    classes is (id, train, held, side, filled, valid, prints). A chain is LEAST_SEEDS winnowed
    fingerprints, one where little of an image is no padding, or as many single cells as two nearly empty
    images must share.

    No fingerprint is left out. One of more than `most` classes is dealt to several tasks by the number
    of its classes in train; all pairs of its classes come out, as they may share another one.
    """
    cells = F.col("side") * F.col("side")
    own = classes.select("id", "train", "held", (F.col("valid") < cells * TIGHT).alias("tight"), F.explode("prints").alias("print"))
    rows = classes.agg(F.sum(F.size("prints"))).first()[0] or 0
    hot = hot_prints(own, rows, most)

    def sides(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
        return (
            prints.where("train").select("print", F.col("id").alias("id_a"), F.col("tight").alias("_a")),
            prints.where("held").select("print", F.col("id").alias("id_b"), F.col("tight").alias("_b")),
        )

    if hot is None:
        a, b = sides(own)
        shared = a.join(b, "print")
    else:
        hot = small(hot, 200_000)
        a, b = sides(own.join(hot, "print", "left_anti"))
        shared = a.join(b, "print").unionByName(paired(*sides(own.join(hot, "print", "left_semi")), ["print"], most))
    cell = F.col("print").bitwiseAND(F.lit(1)) == 1
    met = shared.where("id_a <> id_b").groupBy("id_a", "id_b").agg(
        F.count_if(~cell).alias("seeds"), F.count_if(cell).alias("_cells"), F.max(F.col("_a") | F.col("_b")).alias("_tight")
    )
    chain = (F.col("seeds") >= LEAST_SEEDS) | F.col("_tight") & (F.col("seeds") > 0)
    met = cut(met.where(chain | (F.col("_cells") > 0)))
    # single cells tell of nearly empty images; both then have a count, and the cells that differ are a tenth at most
    counts = classes.where(F.col("filled") <= cells * SPARSE).select("id", F.when(F.col("valid") == cells, F.col("filled") - F.floor(cells / 10)).alias("need"))
    few = met.where(~chain).join(counts.select(F.col("id").alias("id_a"), F.col("need").alias("_na")), "id_a").join(
        counts.select(F.col("id").alias("id_b"), F.col("need").alias("_nb")), "id_b"
    )
    # a cell stands for itself and its mirror; with padding the counts of the common cells are not known
    few = few.where("_na is null or _nb is null or 2 * _cells >= greatest(_na, _nb)")
    return met.where(chain).select("id_a", "id_b").union(few.select("id_a", "id_b")).distinct()


def nearly_empty(classes: DataFrame) -> DataFrame:
    """(id_a, id_b): classes so nearly empty that at most a tenth of the cells can differ, whatever the positive ones are.

    They are images of one side that have together at most a tenth of its cells (and two) positive:
    without padding nearly all of them are the same image, so the pairs are no more than the result.
    """
    most = F.floor(F.col("side") * F.col("side") / 10) + 2
    few = classes.where((F.col("side") > 0) & (F.col("filled") < most))
    train = few.where("train").select("side", "filled", F.col("id").alias("id_a"))
    held = few.where("held").select("side", F.explode(F.sequence(F.lit(1), (most - F.col("filled")).cast("int"))).alias("filled"), F.col("id").alias("id_b"))
    return paired(train, held, ["side", "filled"]).where("id_a <> id_b").select("id_a", "id_b")


def classes_of(images: DataFrame, members: DataFrame) -> DataFrame:
    """(id, train, held, side, filled, valid, prints): one row per class of members (see classified); id is its least sample_id.

    Copies are told apart before fingerprints move, so only those of one record of each class do.
    """
    is_train = F.col("split") == TRAIN
    least = members.groupBy("class").agg(F.min("sample_id").alias("id"), F.max(is_train).alias("train"), F.max(~is_train).alias("held"))
    return least.drop("class").join(fingerprinted(images), "id").dropDuplicates(["id"])


def candidates(classes: DataFrame) -> DataFrame:
    """(id_a, id_b): pairs of different classes, in train and held out, whose images are compared."""
    return chained(classes).union(nearly_empty(classes)).distinct()


def _marked(ids: DataFrame, words: int = WORDS) -> DataFrame:
    """(_word, _bits): a table of 64 * words bits, one of which is set for each id; its size does not grow with the ids."""
    placed = ids.select(F.pmod(F.xxhash64("id"), F.lit(64 * words)).alias("_at"))
    return placed.groupBy(F.expr("_at div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_at % 64 as int)))").alias("_bits"))


def _in_marked(rows: DataFrame, marked: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows whose id is in the table, and few others."""
    placed = rows.withColumn("_at", F.pmod(F.xxhash64("id"), F.lit(64 * words))).withColumn("_word", F.expr("_at div 64"))
    return placed.join(F.broadcast(marked), "_word").where("getbit(_bits, cast(_at % 64 as int)) = 1").select(*rows.columns)


def image_links(images: DataFrame, classes: DataFrame, words: int = WORDS) -> DataFrame:
    """(id_a, id_b, cells, equal): classes of images that are the same image, id_a in train, id_b in val or test.

    Exact copies are one class and meet once, whatever their number. Classes that share a chain of
    fingerprints are candidates; shared ones are collinear, as each is tied to its place. Candidates are
    then extended over all cells.
    """
    found = cut(candidates(classes))
    wanted = _marked(found.select(F.col("id_a").alias("id")).union(found.select("id_b")), words)
    # most images are no candidates and stay where they are
    needed = _in_marked(_with_image(images).select(F.col("sample_id").cast("long").alias("id"), "x"), wanted, words)
    both = (
        found.join(needed.withColumnRenamed("id", "id_a").withColumnRenamed("x", "xa"), "id_a")
        .join(needed.withColumnRenamed("id", "id_b").withColumnRenamed("x", "xb"), "id_b")
        .where(F.size("xa") == F.size("xb"))
    )
    part, whole = LEAST_EQUAL
    same = compared(both).where((F.col("cells") >= LEAST_CELLS) & (F.col("equal") * whole >= F.col("cells") * part))
    return same.select("id_a", "id_b", "cells", "equal").dropDuplicates(["id_a", "id_b"])


def _names(images: DataFrame) -> DataFrame:
    """(sample_id, split, bin_size, key) of every record of the three splits that has a name."""
    return (
        _in_split(images).where(F.col("name").isNotNull() & F.col("bin_size").isNotNull())
        .select(F.col("sample_id").cast("long").alias("sample_id"), "split", "bin_size", names.same_name_key(F.col("name")).alias("key"))
        .distinct()
    )


def _linked(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records with the id of their class (sample_id, split, source, id), and the links of classes.

    Links are (id_a, id_b, coverage, by_copy): near ones, and each class that is on both sides with itself.
    """
    records = cut(classified(images))
    classes = cut(classes_of(images, records))
    near = image_links(images, classes).select("id_a", "id_b", (F.col("equal") / F.col("cells")).alias("coverage"), F.lit(False).alias("by_copy"))
    both = classes.where("train and held").select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("coverage"), F.lit(True).alias("by_copy"))
    ids = records.groupBy("class").agg(F.min("sample_id").alias("id"))
    members = paired(records.distinct(), ids, ["class"]).drop("class")
    return members, near.union(both)


def overlaps(images: DataFrame) -> DataFrame:
    """(train_id, held_id, by_copy, by_prints, by_name, coverage): all pairs of a record in train and one in val or test that are the same.

    Same image: each x has a positive cell, and one x and the other, as it is or transposed, are equal
    in all cells (by_copy), or at least 150 cells are 0 or more in both and nine tenths of these are
    equal (by_prints; coverage is their share). Same name: equal bin_size and names that are equal when
    case, white space and the order of the two ends are ignored.

    Repeated rows count as one record; null x or name matches nothing; a null or other split is in no
    split; empty tables give no rows. Pairs of copies and of equal names are expanded only here, at the
    end, and no class or name comes together in one task.
    """
    members, links = _linked(images)
    train = members.where(F.col("split") == TRAIN).select(F.col("id").alias("id_a"), F.col("sample_id").alias("train_id"))
    held = members.where(F.col("split") != TRAIN).select(F.col("id").alias("id_b"), F.col("sample_id").alias("held_id"))
    same_image = paired(train, paired(held, links, ["id_b"]), ["id_a"]).select(
        "train_id", "held_id", "by_copy", (~F.col("by_copy")).alias("by_prints"), F.lit(False).alias("by_name"), "coverage"
    )
    named = _names(images)
    same_name = paired(
        named.where(F.col("split") == TRAIN).select(F.col("sample_id").alias("train_id"), "bin_size", "key"),
        named.where(F.col("split") != TRAIN).select(F.col("sample_id").alias("held_id"), "bin_size", "key"),
        ["bin_size", "key"],
    ).select("train_id", "held_id", F.lit(False).alias("by_copy"), F.lit(False).alias("by_prints"), F.lit(True).alias("by_name"), F.lit(None).cast("double").alias("coverage"))
    ways = ("by_copy", "by_prints", "by_name", "coverage")
    return same_image.union(same_name).where("train_id <> held_id").groupBy("train_id", "held_id").agg(*(F.max(c).alias(c) for c in ways))


def overlap_pairs(images: DataFrame) -> DataFrame:
    """(sample_id_a, sample_id_b): the pairs of overlaps, smaller id first, each once."""
    return overlaps(images).select(
        F.least("train_id", "held_id").alias("sample_id_a"), F.greatest("train_id", "held_id").alias("sample_id_b")
    ).distinct()


def overlap_records(images: DataFrame) -> DataFrame:
    """One row per record of val and test: (sample_id, split, source, class_id, copies, near, named, coverage).

    class_id is the least sample_id of the images equal to its own (null without an image); copies, near
    and named are the numbers of records in train with an equal image, an almost equal one and the same name;
    coverage is the largest share of equal cells. They are counted by class and name, so no pair is listed.
    """
    members, links = _linked(images)
    in_train = members.where(F.col("split") == TRAIN).groupBy(F.col("id").alias("id_a")).agg(F.countDistinct("sample_id").alias("_n"))
    of_class = links.join(in_train, "id_a").groupBy(F.col("id_b").alias("class_id")).agg(
        F.sum(F.when(F.col("by_copy"), F.col("_n"))).alias("copies"), F.sum(F.when(~F.col("by_copy"), F.col("_n"))).alias("near"), F.max("coverage").alias("coverage")
    )
    named = _names(images)
    of_name = named.where(F.col("split") == TRAIN).groupBy("bin_size", "key").agg(F.countDistinct("sample_id").alias("_n"))
    by_name = named.where(F.col("split") != TRAIN).join(of_name, ["bin_size", "key"]).groupBy("sample_id", "split").agg(F.sum("_n").alias("named"))
    held = _in_split(images).where(F.col("split") != TRAIN).select(F.col("sample_id").cast("long").alias("sample_id"), "split", "source").distinct()
    classes = members.where(F.col("split") != TRAIN).groupBy("sample_id", "split").agg(F.min("id").alias("class_id"))
    whole = held.join(classes, ["sample_id", "split"], "left").join(of_class, "class_id", "left").join(by_name, ["sample_id", "split"], "left")
    return whole.select("sample_id", "split", "source", "class_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("copies", "near", "named")), "coverage")


def overlap_report(images: DataFrame) -> DataFrame:
    """Per split (val, test) and source: records, how many are also in train, by image and by name, and their mean coverage."""
    by_image = F.col("copies") + F.col("near") > 0
    return overlap_records(images).groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(by_image | (F.col("named") > 0)).alias("overlapping"),
        F.count_if(by_image).alias("by_image"),
        F.count_if(F.col("named") > 0).alias("by_name"),
        F.avg("coverage").alias("mean_coverage"),
    )
