"""Links between contig ends: averaging, filtering, the scaffolding graph and its text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions import names
from contactloom.operators import contacts


def scored_links(samples: DataFrame) -> DataFrame:
    """(a, oa, b, ob, prob) of sample names ctgA:s-e:0|ctgB:s-e:1 with a probability; other names are left out."""
    end = lambda i: F.get(F.split("name", r"\|"), i)
    contig = lambda i: F.regexp_extract(end(i), r"^(.*):([01])$", 1)
    side = lambda i: F.when(F.regexp_extract(end(i), r"^(.*):([01])$", 2) == "0", "Start").otherwise("End")
    pairs = samples.where(F.size(F.split("name", r"\|")) == 2).where(end(0).rlike(names.END) & end(1).rlike(names.END))
    return pairs.select(
        contig(0).alias("a"), side(0).alias("oa"), contig(1).alias("b"), side(1).alias("ob"), F.col("prob")
    )


def valid(links: DataFrame) -> DataFrame:
    """Each delivered link once (by link_id), without null and NaN probabilities."""
    return links.where(F.col("prob").isNotNull() & ~F.isnan("prob")).dropDuplicates(["link_id"])


def canonical(links: DataFrame) -> DataFrame:
    """(resolution, a, b, oa, ob, prob, n): a link and its reverse are one, with the smaller contig first; prob is their mean."""
    swap = F.col("a") > F.col("b")
    swap = swap | ((F.col("a") == F.col("b")) & (F.col("oa") > F.col("ob")))
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return (
        links.select("resolution", pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("oa", "ob").alias("oa"), pick("ob", "oa").alias("ob"), "prob")
        .groupBy("resolution", "a", "b", "oa", "ob").agg(F.avg("prob").alias("prob"), F.count(F.lit(1)).alias("n"))
    )


def across_resolutions(canonical_links: DataFrame) -> DataFrame:
    """(a, b, oa, ob, prob): the mean over the resolutions that have the link."""
    return canonical_links.groupBy("a", "b", "oa", "ob").agg(F.avg("prob").alias("prob"))


def rounded(prob: Column, digits: int = 4) -> Column:
    """Rounded to so many digits; halves go up, whatever the last bit of a mean is."""
    return F.round(prob + 1e-9, digits)


def decimal(value: Column, digits: int = 4) -> Column:
    """A number with one to `digits` digits after the point, never with an exponent."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", value), r"(\.\d+?)0+$", "$1")


def strong(links: DataFrame, least: float = 0.1, digits: int = 4) -> DataFrame:
    """Links whose rounded probability is at least `least`, with that rounded value as weight."""
    return links.withColumn("weight", rounded(F.col("prob"), digits)).where(F.col("weight") >= least)


#: Type of a link and the signs of its contigs in GFA.
SIGNS = {"End-Start": ("+", "+"), "Start-Start": ("-", "+"), "End-End": ("+", "-"), "Start-End": ("-", "-")}


def edges(links: DataFrame) -> DataFrame:
    """(a, b, type, sign_a, sign_b, weight): directed edges; a Start-End link becomes End-Start with its contigs swapped."""
    swap = (F.col("oa") == "Start") & (F.col("ob") == "End")
    kind = F.when(swap, "End-Start").otherwise(F.concat_ws("-", "oa", "ob"))
    signs = F.create_map(*(F.lit(x) for k, v in SIGNS.items() for x in (k, "".join(v))))
    return (
        links.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
                     kind.alias("type"), rounded(F.col("prob")).alias("weight"))
        .withColumn("_signs", F.try_element_at(signs, F.col("type")))
        .select("a", "b", "type", F.substring("_signs", 1, 1).alias("sign_a"), F.substring("_signs", 2, 1).alias("sign_b"), "weight")
    )


def nodes(links: DataFrame, chrom_sizes: DataFrame) -> DataFrame:
    """(node, chrom): all fragments of the links, and contigs of which no fragment has a link, as chrom:0-length."""
    linked = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    named = linked.select("node", F.coalesce(names.fragment(F.col("node"))["chrom"], F.col("node")).alias("chrom"))
    left = contacts.sizes(chrom_sizes).join(named.select("chrom").distinct(), "chrom", "left_anti")
    return named.union(left.select(F.format_string("%s:0-%d", "chrom", "length").alias("node"), "chrom"))


def sliced(fragments: DataFrame, sequences: DataFrame, width: int = 1_000_000) -> DataFrame:
    """(node, seq): the bases [_s, _e) of the contig of each fragment (node, chrom, _s, _e); fragments beyond their sequence give what there is.

    Sequences (name, seq) are cut into stretches of `width` bases, and a fragment meets only those it
    covers, so a long sequence is never repeated for each of its fragments.
    """
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(width)), lambda i: F.substring(F.col("seq"), i + 1, F.lit(width)))
    pieces = sequences.where("seq is not null").select(F.col("name").alias("chrom"), F.posexplode(cuts).alias("_k", "_seq"))
    wanted = fragments.where("_e > _s").withColumn("_k", F.explode(F.sequence(F.expr(f"cast(_s div {width} as int)"), F.expr(f"cast((_e - 1) div {width} as int)"))))
    offset = F.col("_k").cast("long") * width
    start = F.greatest(F.col("_s") - offset, F.lit(0)).cast("int")
    length = F.least(F.col("_e") - offset, F.lit(width)).cast("int") - start
    parts = wanted.join(pieces, ["chrom", "_k"]).select("node", "_k", F.substring(F.col("_seq"), start + 1, length).alias("_part"))
    whole = parts.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("_k", "_part"))).alias("_parts"))
    return whole.select("node", F.array_join(F.transform("_parts", lambda p: p["_part"]), "").alias("seq"))


def gfa_lines(graph_nodes: DataFrame, graph_edges: DataFrame, sequences: DataFrame | None = None, least: float = 0.2) -> DataFrame:
    """(rank, line): the graph as GFA version 1: header, segments and links with a weight of at least `least`.

    A segment has its piece of the sequence (name, seq) in upper case, or * where there is none. rank 0,
    1 and 2 keeps the order of the sections when sorted.
    """
    header = graph_nodes.sparkSession.range(1).select(F.lit(0).alias("rank"), F.lit("H\tVN:Z:1.0").alias("line"))
    part = names.fragment(F.col("node"))
    placed = graph_nodes.select("node", "chrom", part["start"].alias("_s"), part["end"].alias("_e"))
    if sequences is None:
        seq = F.lit("*")
    else:
        placed = placed.join(sliced(placed, sequences), "node", "left")
        seq = F.coalesce(F.upper("seq"), F.lit("*"))
    length = F.coalesce(F.col("_e") - F.col("_s"), F.lit(0))
    segments = placed.select(F.lit(1).alias("rank"), F.concat_ws("\t", F.lit("S"), "node", seq, F.concat(F.lit("LN:i:"), length.cast("string"))).alias("line"))
    kept = graph_edges.where(F.col("weight") >= least)
    tied = kept.select(
        F.lit(2).alias("rank"),
        F.concat_ws("\t", F.lit("L"), "a", "sign_a", "b", "sign_b", F.lit("0M"), F.concat(F.lit("FC:i:"), decimal(F.col("weight")))).alias("line"),
    )
    return header.union(segments).union(tied)
