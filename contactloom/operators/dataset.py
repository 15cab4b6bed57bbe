"""Operators on a dataset of images: (sample_id, name, grp, y, x, image_size, bin_size, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.functions import names
from contactloom.operators.ranking import shuffled

PADDING = -1


def latest(images: DataFrame) -> DataFrame:
    """Each record once: of rows with one sample_id the one loaded last.

    Ties are settled by the plain columns; images are not read for that, so that they can be pruned.
    """
    plain = [c for c, kind in images.dtypes if c not in ("sample_id", "loaded_at") and not kind.startswith(("array", "map", "struct"))]
    newest = Window.partitionBy("sample_id").orderBy(F.desc_nulls_last("loaded_at"), F.xxhash64(F.lit(0), *plain))
    return images.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def image_sum(x: Column) -> Column:
    """Sum of all cells as they are; null for a null image."""
    return F.aggregate(x, F.lit(0).cast("long"), lambda total, v: total + F.coalesce(v, F.lit(0)))


def load(images: DataFrame, image_size: int, bin_size: int) -> DataFrame:
    """The images of one size and resolution; an error if there are none."""
    found = images.where((F.col("image_size") == image_size) & (F.col("bin_size") == bin_size))
    if found.isEmpty():
        raise ValueError(f"no images of size {image_size} at {bin_size} bp")
    return found


def filtered(images: DataFrame, threshold: float = 0.1, absolute: int | None = None, dump: bool = True) -> DataFrame:
    """Images with more than threshold times the median sum, or more than `absolute`; with dump=False the others."""
    summed = images.where(F.col("x").isNotNull()).withColumn("_sum", image_sum(F.col("x")))
    if absolute is None:
        # sums are counted first, so that the exact median needs the different sums only
        counts = summed.groupBy(F.col("_sum").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        median = counts.agg(F.percentile("v", 0.5, F.col("n"))).first()[0]
        limit = threshold * median if median is not None else 0.0
    else:
        limit = float(absolute)
    above = F.col("_sum") > F.lit(limit)
    return summed.where(above if dump else ~above).drop("_sum")


def search(images: DataFrame, key: str, second: str | None = None) -> DataFrame:
    """Images whose name contains key, and second if given; case does not matter."""
    has = lambda k: F.contains(F.lower("name"), F.lit(k.lower()))
    return images.where(has(key) & has(second) if second else has(key))


def chosen(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """Images whose name is in wanted(name)."""
    return images.join(wanted.select("name").distinct(), "name", "left_semi")


def with_type(images: DataFrame) -> DataFrame:
    """Adds grp_type (intra or inter) and corner (C2, C3 or null), both null for a null name."""
    plain = names.plain(F.col("name"))
    return images.withColumns({
        "grp_type": F.when(names.is_inter(F.col("name")), "inter").when(F.col("name").isNotNull(), "intra"),
        "corner": F.when(plain.rlike(names.INTRA), F.concat(F.lit("C"), F.regexp_extract(plain, names.INTRA, 3))),
    })


def duplicates(images: DataFrame) -> DataFrame:
    """(sample_id, class_id, copies): images of which there are several equal ones; class_id is their least sample_id.

    Images are told apart by a 256-bit hash of all cells, which is all that moves.
    """
    digest = images.where(F.col("x").isNotNull()).select("sample_id", F.sha2(F.array_join("x", ",", "null"), 256).alias("_d"))
    digest = digest.dropDuplicates(["sample_id"])
    classes = digest.groupBy("_d").agg(F.min("sample_id").alias("class_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return digest.join(classes, "_d").select("sample_id", "class_id", "copies")


def mixed_label_groups(images: DataFrame) -> DataFrame:
    """(grp, labels): groups that hold more than one label."""
    return images.where("grp is not null and y is not null").groupBy("grp").agg(F.count_distinct("y").alias("labels")).where("labels > 1")


def fixed_groups(images: DataFrame) -> DataFrame:
    """(sample_id, name, grp): records with one name get the least group of it; a null name keeps its group."""
    least = images.where("name is not null").groupBy("name").agg(F.min("grp").alias("_g"))
    return images.join(least, "name", "left").select("sample_id", "name", F.coalesce("_g", "grp").alias("grp")).distinct()


def united(datasets: dict[str, DataFrame]) -> DataFrame:
    """All rows of several datasets with their source; groups are numbered on from one dataset to the next."""
    out, offset = None, 0
    for name, rows in datasets.items():
        part = rows.select("sample_id", "name", (F.col("grp") + offset).alias("grp"), "y", F.lit(name).alias("dataset"))
        out = part if out is None else out.union(part)
        # one number of each dataset
        offset += (rows.agg(F.max("grp")).first()[0] or 0) + 1
    return out


def histogram(values: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """(bin, low, n): equal-width bins from the least to the greatest value, the last one closed; empty bins are missing."""
    ends = values.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    if ends[0] is None:
        return values.sparkSession.createDataFrame([], "bin long, low double, n long")
    low, width = ends[0], (ends[1] - ends[0]) / bins or 1.0
    at = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    counted = values.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"), "n")


def equalised(images: DataFrame, cap: int, bins: int = 100, seed: int | None = 7, legacy: bool = False) -> DataFrame:
    """(sample_id, name, total, bin): at most `cap` images of each of `bins` equal-width bins of the image sum.

    Which ones stay is random but fixed by the seed; with seed None the first by name and sample_id
    stay. legacy drops images with the greatest sum.
    """
    summed = images.where(F.col("x").isNotNull()).select("sample_id", "name", image_sum(F.col("x")).alias("total"))
    ends = summed.agg(F.min("total").cast("double"), F.max("total").cast("double")).first()
    if ends[0] is None:
        return summed.withColumn("bin", F.lit(0).cast("long")).limit(0)
    width = (ends[1] - ends[0]) / bins or 1.0
    at = F.floor((F.col("total") - F.lit(ends[0])) / F.lit(width))
    binned = summed.withColumn("bin", F.least(at, F.lit(bins - 1)).cast("long"))
    if legacy:
        binned = binned.where(F.col("total") < F.lit(ends[1]))
    order = [F.xxhash64("name", "sample_id", F.lit(seed))] if seed is not None else []
    # the limit per bin is applied before rows move, so no bin comes together in one task
    place = F.row_number().over(Window.partitionBy("bin").orderBy(*order, F.asc_nulls_first("name"), "sample_id"))
    return binned.withColumn("_n", place).where(F.col("_n") <= cap).drop("_n")


def group_split(images: DataFrame, val: float = 0.05, test: float = 0.05, seed: int = 42) -> DataFrame:
    """(grp, y, split): the groups of each label, shuffled by the seed, in val, test and train.

    Of n groups ceil((val + test) * n) are held out, and of these the part val / (val + test), rounded up, is
    val. A group has its greatest label. Groups are told apart by their number, so a group lies in one split.
    """
    groups = images.where("grp is not null and y is not null").groupBy("grp").agg(F.max("y").alias("y"))
    sizes = groups.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
    shuffled_groups = shuffled(groups, ["y"], "grp", groups.count(), seed)
    held = F.ceil(F.col("_n") * F.lit(float(val + test)))
    first = F.ceil(held * F.lit(val / (val + test) if val + test else 0.0))
    return shuffled_groups.join(sizes, "y").select(
        "grp", "y", F.when(F.col("rank") <= first, "val").when(F.col("rank") <= held, "test").otherwise("train").alias("split")
    )


def group_split_legacy(images: DataFrame, val: float | None = None, test: float | None = None, seed: int = 42) -> DataFrame:
    """(grp, split): of all n groups, shuffled by the seed, the first int(test * n) + 1 are test, the next int(val * n) + 1 val; None gives none."""
    groups = images.where("grp is not null").select("grp").distinct().withColumn("_all", F.lit(1))
    n = groups.count()
    in_test = int(test * n) + 1 if test is not None else 0
    in_val = int(val * n) + 1 if val is not None else 0
    rank = F.col("rank")
    split = F.when(rank <= in_test, "test").when(rank <= in_test + in_val, "val").otherwise("train")
    return shuffled(groups, ["_all"], "grp", n, seed).select("grp", split.alias("split"))


def drawn(images: DataFrame, n: int = 9, seed: int = 42) -> DataFrame:
    """n records at random, without replacement; the same in every run. The n are the operator's parameter, not a limit of its own.

    Records are told apart by sample_id; the order is that of the MD5 of seed:sample_id, of which each task keeps n.
    """
    return images.dropDuplicates(["sample_id"]).withColumn("_md5", F.md5(F.concat_ws(":", F.lit(seed), F.col("sample_id").cast("string")))).orderBy("_md5", "sample_id").limit(n).drop("_md5")


def misclassified(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows (y, prob) whose label is not that of prob >= threshold; rows without either are left out."""
    return scored.where(F.col("y").isin(0, 1) & F.col("prob").isNotNull() & ~F.isnan("prob") & ((F.col("prob") >= threshold).cast("int") != F.col("y")))


def negatives(images: DataFrame) -> DataFrame:
    """Images with a breakpoint in view: y = 0."""
    return images.where("y = 0")


def quantile_markers(values: DataFrame, value: str, quantiles: tuple[float, ...] = (0.2, 0.4, 0.5, 0.6, 0.8)) -> DataFrame:
    """(quantile, marker): where a histogram is marked; exact, from counts by value."""
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.agg(F.percentile("v", F.array(*map(F.lit, quantiles)), F.col("n")).alias("_m"))
    return found.select(F.posexplode("_m").alias("_i", "marker")).select(F.element_at(F.array(*map(F.lit, quantiles)), F.col("_i") + 1).alias("quantile"), "marker")


def shared_between_splits(images: DataFrame, column: str | Column) -> DataFrame:
    """(value, splits): values of a column that occur in more than one split; empty if splits are disjoint."""
    value = F.col(column) if isinstance(column, str) else column
    rows = images.where("split is not null").select(value.alias("value"), "split").where("value is not null")
    return rows.groupBy("value").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def cropped(images: DataFrame, side: int, to: int) -> DataFrame:
    """Images cut to their first `to` rows and columns."""
    inside = lambda v, i: (i % side < to) & (i < to * side)
    return images.withColumn("x", F.filter("x", inside))


def border_masked(x: Column, side: int, k: Column | int, value: int = PADDING, at_end: bool = False) -> Column:
    """The image with its first (or last) k rows and columns set to a value."""
    k = F.lit(k) if isinstance(k, int) else k
    r, c = (lambda i: F.floor(i / side)), (lambda i: i % side)
    hit = (lambda i: (r(i) >= side - k) | (c(i) >= side - k)) if at_end else (lambda i: (r(i) < k) | (c(i) < k))
    return F.transform(x, lambda v, i: F.when(hit(i), F.lit(value)).otherwise(v))


def augmented(images: DataFrame, side: int = 20, share: float = 0.5, most: int = 7, seed: int = 7) -> DataFrame:
    """Images of which a random share get a border mask of 1 to `most` rows and columns; the same in every run."""
    h = F.xxhash64("sample_id", F.lit(seed))
    k = (F.pmod(F.shiftright(h, 20), F.lit(most)) + 1).cast("int")
    hit = F.pmod(h, F.lit(1000)) < int(share * 1000)
    return images.withColumn("x", F.when(hit, border_masked(F.col("x"), side, k)).otherwise(F.col("x")))


def minmax(x: Column, top: Column) -> Column:
    """Cells divided by top and clipped to [0, 1]; padding stays -1; with top 0 positive cells become 1."""
    scaled = lambda v: F.when(top == 0, F.when(v > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.greatest(v / top, F.lit(0.0)), F.lit(1.0)))
    return F.transform(x, lambda v: F.when(v == PADDING, F.lit(-1.0)).otherwise(scaled(v)))


def standardised(x: Column, mean: Column, std: Column, least: Column, greatest: Column) -> Column:
    """log1p, then (v - mean) / std, then to [0, 1] by the least and greatest z-score; padding stays -1; 0 where std or the range is 0."""
    z = lambda v: F.try_divide(F.log1p(v.cast("double")) - mean, std)
    return F.transform(x, lambda v: F.when(v == PADDING, F.lit(-1.0)).otherwise(F.coalesce(F.try_divide(z(v) - least, greatest - least), F.lit(0.0))))


def class_balance(images: DataFrame) -> DataFrame:
    """(split, n, positive): records with a label per split and the percentage with y = 1; null splits together."""
    labelled = images.where("y in (0, 1)").dropDuplicates(["sample_id"])
    return labelled.groupBy("split").agg(F.count(F.lit(1)).alias("n"), (F.avg("y") * 100).alias("positive"))


def top_value(images: DataFrame, q: float = 0.995) -> DataFrame:
    """(vmax): the q-quantile of all cells, at least 1."""
    cells = images.select(F.explode("x").alias("v")).groupBy(F.col("v").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(F.greatest(F.percentile("v", q, F.col("n")), F.lit(1.0)).alias("vmax"))


def renamed(rows: DataFrame, name_table: DataFrame, column: str = "contig") -> DataFrame:
    """Rows with the old name of a contig in place of its new one; names the table does not know stay.

    Names are compared plain. Of several old names the least is taken, so no row is repeated.
    """
    old = name_table.dropna().groupBy(names.plain(F.col("new")).alias("_new")).agg(F.min(names.plain(F.col("old"))).alias("_old"))
    return rows.join(old, names.plain(F.col(column)) == F.col("_new"), "left").withColumn(column, F.coalesce("_old", column)).drop("_new", "_old")


def updated(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of both, with those of new in place of old ones with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).union(new.select(*old.columns))
