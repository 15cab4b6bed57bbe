"""Text and JSON formats, read into and written from DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The twelve columns of a PAF file.
PAF = (
    "Q_name STRING, Q_len BIGINT, Q_start BIGINT, Q_end BIGINT, Strand STRING, T_name STRING, "
    "T_len BIGINT, T_start BIGINT, T_end BIGINT, N_residue BIGINT, Al_len BIGINT, Quality INT"
)


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated text without a header; columns beyond the schema are ignored."""
    return spark.read.csv(path, schema=schema, sep="\t", header=False, mode="PERMISSIVE")


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, "chrom STRING, length BIGINT")


def name_table(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, "new STRING, old STRING")


def paf(spark: SparkSession, path: str) -> DataFrame:
    """The first twelve columns of alignments."""
    return tsv(spark, path, PAF)


def low_complexity(spark: SparkSession, path: str, resolution: int) -> DataFrame:
    """(chrom, b0, b1): regions of at least two bins, in bins."""
    rows = tsv(spark, path, "chrom STRING, start_bp BIGINT, end_bp BIGINT")
    return rows.where(F.col("end_bp") - F.col("start_bp") >= 2 * resolution).select(
        "chrom", F.expr(f"start_bp div {resolution}").alias("b0"), F.expr(f"end_bp div {resolution}").alias("b1")
    )


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): name is the header up to the first white space, the lines of a record are joined.

    A record begins at a '>' at the start of a line only; lines before the first header of a file are left
    out, and a header without lines has an empty sequence. The reader splits files at these places, so
    a record is one row.
    """
    rows = spark.read.text(path, lineSep="\n>").select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i")
    )
    # what a file begins with is the first row of its first block; it keeps its '>', as no line end is before it
    begins = rows.groupBy("_file").agg(F.min(F.when(F.col("_at") == 0, F.col("_i"))).alias("_begin"))
    told = rows.join(begins, "_file")
    at_begin, headed = F.col("_i") == F.col("_begin"), F.startswith("value", F.lit(">"))
    records = told.where(~at_begin | headed).select(F.when(at_begin, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")).alias("_r")).where(F.length("_r") > 0)
    lines = F.split(F.regexp_replace("_r", "\r", ""), "\n")
    return records.select(
        F.regexp_extract(F.element_at(lines, 1), r"^(\S*)", 1).alias("name"),
        F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "").alias("seq"),
    )


def _json_maps(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(name, value) of JSON objects {name: value}: whole files, however they are laid out, or an object per line as write_json_map leaves them."""
    several = F.col("value").rlike(r"\}\s*\n\s*\{")
    parsed = spark.read.text(path, wholetext=True).select(F.explode(F.when(several, F.split("value", "\n")).otherwise(F.array("value"))).alias("_o"))
    return parsed.select(F.explode(F.from_json("_o", f"map<string,{value}>")).alias("name", "value"))


def breakpoint_json(spark: SparkSession, path: str) -> DataFrame:
    """(name, bp) of JSON objects {contig: [bp, ...]}."""
    return _json_maps(spark, path, "array<bigint>").select("name", F.explode("value").alias("bp"))


def score_json(spark: SparkSession, path: str) -> DataFrame:
    """(name, prob) of JSON objects {name: prob}."""
    return _json_maps(spark, path, "double").withColumnRenamed("value", "prob")


def part_json(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, part_id, chimeric, b0, b1) of JSON objects {contig: {part: {chimeric, range: [b0, b1]}}}."""
    parts = _json_maps(spark, path, "map<string,struct<chimeric:boolean,range:array<bigint>>>")
    each = parts.select(F.col("name").alias("chrom"), F.explode("value").alias("part_id", "_p"))
    return each.select("chrom", F.col("part_id").cast("int").alias("part_id"), "_p.chimeric", F.col("_p.range")[0].alias("b0"), F.col("_p.range")[1].alias("b1"))


def network_json(spark: SparkSession, path: str) -> DataFrame:
    """(a, oa, b, ob, prob) of JSON objects {"a|b": {"oa|ob": prob}}."""
    pairs = _json_maps(spark, path, "map<string,double>").select("name", F.explode("value").alias("ends", "prob"))
    half = lambda c, i: F.get(F.split(c, r"\|"), i)
    return pairs.select(half("name", 0).alias("a"), half("ends", 0).alias("oa"), half("name", 1).alias("b"), half("ends", 1).alias("ob"), "prob")


def metric_table(spark: SparkSession, path: str) -> DataFrame:
    """(metric, dataset, tool, value) of a table with two header rows (dataset, tool) and decimal commas."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    cells = lines.where("trim(text) <> ''").select("line", F.posexplode(F.split("text", "\t")).alias("col", "cell"))
    header = cells.where("line < 2").groupBy("col").agg(
        F.max(F.when(F.col("line") == 0, F.col("cell"))).alias("dataset"), F.max(F.when(F.col("line") == 1, F.col("cell"))).alias("tool")
    )
    body = cells.where("line >= 2")
    metric = body.where("col = 0").select("line", F.col("cell").alias("metric"))
    value = F.replace("cell", F.lit(","), F.lit(".")).try_cast("double")
    return body.where("col > 0").join(metric, "line").join(header, "col").select("metric", "dataset", "tool", value.alias("value"))


def write_lines(lines: DataFrame, path: str, column: str = "line", order: list[str] | None = None) -> None:
    """Writes a text file per partition; with order the files follow each other in that order."""
    (lines.sort(*order) if order else lines).select(column).write.mode("overwrite").text(path)


def write_fasta(sequences: DataFrame, path: str) -> None:
    write_lines(sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("line")), path)


def write_paf(alignments: DataFrame, path: str) -> None:
    """All twelve columns; those that are missing are 0."""
    named = [column.split()[0] for column in PAF.split(", ")]
    columns = [F.col(c) if c in alignments.columns else F.lit(0).alias(c) for c in named]
    alignments.select(*columns).write.mode("overwrite").csv(path, sep="\t")


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated text without a header."""
    rows.write.mode("overwrite").csv(path, sep="\t")


def write_dataset(images: DataFrame, path: str, cells: DataFrame | None = None, edited: bool = False, **metadata: str) -> None:
    """Images in Parquet by size and resolution, with a row of metadata and the time of writing beside them.

    With `cells` the contacts within contigs that the images come from are kept beside them, by resolution.
    `edited` marks a dataset that was changed after it was made, with the time of the change.
    """
    images.write.mode("overwrite").partitionBy("image_size", "bin_size").parquet(f"{path}/images")
    if cells is not None:
        cells.where("chrom1 = chrom2").write.mode("overwrite").partitionBy("resolution").parquet(f"{path}/whole")
    spark = images.sparkSession
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), F.lit(v))]
    made = F.date_format(F.current_timestamp(), "MM/dd/yyyy-HH:mm:ss")
    spark.range(1).select(F.create_map(F.lit("Edit" if edited else "CreationDate"), made, *pairs).alias("metadata")).write.mode("overwrite").parquet(f"{path}/metadata")


def _write_json(rows: DataFrame, path: str) -> None:
    """rows is (name, value). A JSON object per line; the lines together are the map, however large, as _json_maps reads it."""
    rows.select(F.to_json(F.create_map(F.col("name").cast("string"), F.col("value"))).alias("line")).write.mode("overwrite").text(path)


def write_json_map(rows: DataFrame, path: str, key: str, value: str) -> None:
    """One JSON object per row and line, {key: value}; score_json and breakpoint_json read them back."""
    _write_json(rows.select(F.col(key).alias("name"), F.col(value).alias("value")), path)


def write_breakpoint_json(rows: DataFrame, path: str) -> None:
    """(name, bp) as {contig: [bp, ...]} in order; breakpoint_json reads it back."""
    _write_json(rows.groupBy("name").agg(F.array_sort(F.collect_set("bp")).alias("value")), path)


def write_part_json(parts: DataFrame, path: str) -> None:
    """(chrom, part_id, chimeric, b0, b1) as {contig: {part: {chimeric, range}}}; part_json reads it back."""
    part = F.struct(F.col("part_id").cast("int").alias("k"), F.struct("chimeric", F.array(F.col("b0").cast("long"), F.col("b1").cast("long")).alias("range")).alias("v"))
    ordered = F.transform(F.array_sort(F.collect_list(part)), lambda p: F.struct(p["k"].cast("string"), p["v"]))
    _write_json(parts.groupBy(F.col("chrom").alias("name")).agg(F.map_from_entries(ordered).alias("value")), path)


def write_network_json(links: DataFrame, path: str, digits: int = 4) -> None:
    """(a, oa, b, ob, prob) as {"a|b": {"oa|ob": prob}}, rounded; network_json reads it back. A pair has four ends at most."""
    ends = F.struct(F.concat_ws("|", "oa", "ob"), F.round("prob", digits))
    _write_json(links.groupBy(F.concat_ws("|", "a", "b").alias("name")).agg(F.map_from_entries(F.array_sort(F.collect_set(ends))).alias("value")), path)


def write_scaffold_map(pieces: DataFrame, path: str) -> None:
    """(name, piece, contig) as scaffold, tab, its contigs in order with a blank between."""
    of = pieces.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("piece", "contig"))).alias("_c"))
    write_table(of.select("name", F.array_join(F.transform("_c", lambda c: c["contig"]), " ").alias("contigs")), path)


#: What a training log has per epoch, for training and then for validation.
LOG = ("loss", "accuracy", "precision", "recall", "weighted_f1", "macro_f1", "roc_auc", "weighted_ap", "npv")


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, train_..., val_...): tab-separated text with a header line; a log without validation has nulls there."""
    kind = ", ".join(["epoch INT", *(f"{part}_{c} DOUBLE" for part in ("train", "val") for c in LOG)])
    return spark.read.csv(path, schema=kind, sep="\t", header=False, mode="PERMISSIVE").where("epoch is not null")


def append_training_log(rows: DataFrame, path: str) -> None:
    """Appends epochs (see training_log); columns that are missing stay empty."""
    named = ["epoch", *(f"{part}_{c}" for part in ("train", "val") for c in LOG)]
    rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in named)).write.mode("append").csv(path, sep="\t")
