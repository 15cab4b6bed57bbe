"""Whole pipelines: from contacts to corrected contigs, and from corrected contigs to the scaffolding graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators import contacts, dataset, ends, links, scorer, segment, simulate, windows
from contactloom.operators import breakpoints as bp
from contactloom.operators.pairing import paired
from contactloom.operators.ranking import shuffled
from contactloom.session import cut, small

#: (key columns, x) to (key columns, prob)
Scorer = Callable[[DataFrame, str], DataFrame]


def plain_scorer(images: DataFrame, key: str) -> DataFrame:
    """The block score of each image."""
    return images.select(key, scorer.block_score(F.col("x")).alias("prob"))


def network_scorer(network: scorer.Network | None = None, top: float = 1.0) -> Scorer:
    """Scores by the network; top is 1 for normalised images, else the count that becomes 1."""
    return lambda images, key: scorer.network_scores(images, key, top=top, network=network)


def normalised(images: DataFrame, cells: DataFrame, chrom_sizes: DataFrame, half: int, q: float = 0.95) -> DataFrame:
    """Images (with resolution) divided by the quantile of the band of their resolution."""
    tops = small(contacts.diagonal_quantile(cells, chrom_sizes, half, q))
    return images.join(tops, "resolution").withColumn("x", dataset.minmax(F.col("x"), F.col("quantile"))).drop("quantile")


def corrected_contigs(
    pixels: DataFrame,
    chrom_sizes: DataFrame,
    resolution: int = 5000,
    half: int = 10,
    threshold: float = 0.05,
    smoothing: bool = False,
    least_bins: int = 20,
    regions: DataFrame | None = None,
    score: Scorer = plain_scorer,
    quantile: float | None = None,
) -> DataFrame:
    """(chrom, start, end) in bp: the parts of each contig that has windows.

    Every window along the diagonal and its turned copy are scored; where the mean is below the
    threshold, and no low-complexity region (chrom, b0, b1) excuses it, the contig is cut. With
    `quantile` (0.95, say) images are normalised by that quantile of the band before they are scored.
    A score follows from its image alone, so windows without contacts, which all have the same image,
    are scored as one: bin 0 of a contig without a name.
    """
    cells = contacts.upper(pixels.where(F.col("resolution") == resolution))
    images = windows.images(windows.window_cells(cells, chrom_sizes, half), half)
    zeros = F.array_repeat(F.lit(0), 4 * half * half).cast(images.schema["x"].dataType)
    blank = pixels.sparkSession.range(1).select(F.lit(resolution).alias("resolution"), F.lit("").alias("chrom"), F.lit(0).cast("long").alias("pos"), zeros.alias("x"))
    images = images.unionByName(blank)
    if quantile:
        images = normalised(images, cells, chrom_sizes, half, quantile)
    # the second corner is the image turned by 180 degrees, its cells in reverse
    corners = F.explode(F.array(F.struct(F.lit(2).alias("corner"), F.col("x")), F.struct(F.lit(3).alias("corner"), F.reverse("x").alias("x"))))
    named = images.select(*windows.WINDOW, corners.alias("_c")).select(*windows.WINDOW, "_c.corner", "_c.x")
    named = named.withColumn("name", F.format_string("%s_%d_C%d", "chrom", "pos", "corner"))
    scored = score(named.select("name", "x"), "name")
    parts = F.split("name", "_")
    place = scored.select(
        F.regexp_extract("name", r"^(.*)_([0-9]+)_C[23]$", 1).alias("chrom"),
        F.regexp_extract("name", r"^(.*)_([0-9]+)_C[23]$", 2).cast("long").alias("bin"),
        F.element_at(parts, -1).alias("corner"), "prob",
    )
    both = place.groupBy("chrom", "bin").agg(
        F.max(F.when(F.col("corner") == "C2", F.col("prob"))).alias("p2"), F.max(F.when(F.col("corner") == "C3", F.col("prob"))).alias("p3")
    )
    # scored once; the score of empty windows and the parts both need it
    curve = cut(segment.corner_mean(both))
    empty = curve.where("bin = 0").first()
    spans = windows.spans(chrom_sizes, blank, half).drop("resolution")
    # bins are listed one by one only where their neighbours count
    whole = segment.filled if smoothing or regions is not None else segment.stretches
    curve = whole(curve.where("bin <> 0"), spans, empty and empty.p)
    if smoothing:
        curve = segment.smoothed(curve)
    if regions is None:
        curve = curve.withColumn("masked", F.lit(False))
    else:
        curve = segment.masked(curve, regions)
    merged = segment.merged_parts(segment.runs(curve, threshold), least_bins)
    ends_of = spans.select("chrom", F.explode(F.array("first", "last")).alias("bin"))
    return segment.trimmed(merged, ends_of, contacts.sizes(chrom_sizes), resolution)


def scaffolding_graph(
    pixels: DataFrame, chrom_sizes: DataFrame, half: int = 10, least: float = 0.0, score: Scorer = plain_scorer, sequences: DataFrame | None = None,
    quantile: float | None = None, fragments: DataFrame | None = None, least_bins: int = 4,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, GFA lines) from the contacts between the ends of contigs at all resolutions of pixels.

    With `fragments` (chrom, start, end in bp; see corrected_contigs) their ends are scored, and those of
    contigs that no fragment mentions; pieces of fewer than least_bins bins have no images at that resolution.
    """
    cells = cut(contacts.upper(pixels))
    given = contacts.sizes(chrom_sizes).select("chrom", F.lit(0).cast("long").alias("start"), F.col("length").alias("end")).limit(0)
    pieces = cut(ends.fragment_pieces(given if fragments is None else fragments, chrom_sizes, cells, least_bins))
    images = ends.piece_pair_images(ends.piece_pair_cells(cells, pieces, half), pieces, half)
    if quantile:
        images = normalised(images, cells, chrom_sizes, half, quantile)
    keyed = images.withColumn("key", F.concat_ws(" ", "resolution", "name"))
    scored = score(keyed.select("key", "x"), "key").select(
        F.substring_index("key", " ", 1).cast("int").alias("resolution"), F.expr("substring(key, locate(' ', key) + 1)").alias("name"), "prob"
    )
    found = links.scored_links(scored.select("name", F.struct("resolution", "prob").alias("prob")))
    per_resolution = links.canonical(found.select("a", "oa", "b", "ob", F.col("prob.resolution").alias("resolution"), F.col("prob.prob").alias("prob")))
    merged = cut(links.across_resolutions(per_resolution))
    graph_nodes, graph_edges = links.nodes(merged, chrom_sizes), links.edges(merged)
    return graph_nodes, graph_edges, links.gfa_lines(graph_nodes, graph_edges, sequences, least)


def scaffolded(pixels: DataFrame, chrom_sizes: DataFrame, resolution: int = 5000, least: float = 0.0, score: Scorer = plain_scorer, sequences: DataFrame | None = None) -> DataFrame:
    """(rank, line): the whole run. Contigs are corrected at one resolution, the ends of their parts are scored at all, and the graph is written as GFA."""
    fragments = cut(corrected_contigs(pixels, chrom_sizes, resolution, score=score))
    return scaffolding_graph(pixels, chrom_sizes, least=least, score=score, sequences=sequences, fragments=fragments)[2]


def intra_dataset(
    pixels: DataFrame, chrom_sizes: DataFrame, resolution: int, half: int = 10, breakpoints: DataFrame | None = None, name_table: DataFrame | None = None,
    least: int = 1, only_negatives: bool = False,
) -> DataFrame:
    """(name, grp, y, x, image_size, bin_size): the images along the diagonal of every contig, both corners, as write_dataset takes them.

    y is 0 where a breakpoint (chrom, bin) is in view, else 1; a contig is a group, numbered in the order of
    the MD5 of its name. Contigs are called by name_table, if it knows them. Windows with fewer than
    `least` contacts are left out; with least 0 every position has an image.
    """
    cells = contacts.upper(pixels.where(F.col("resolution") == resolution))
    every = windows.every_position(chrom_sizes, pixels.where(F.col("resolution") == resolution), half) if least <= 0 else None
    made = windows.images(windows.window_cells(cells, chrom_sizes, half), half, every=every, least=least)
    none = cells.select(F.col("chrom1").alias("chrom"), F.col("bin1").alias("bin")).limit(0)
    labelled = lambda rows: windows.labelled(rows, none if breakpoints is None else breakpoints, half)
    # contigs are numbered by the windows they have, so that images are made once, at the end
    held = windows.with_contacts(cells, chrom_sizes, half, least) if every is None else every
    told = labelled(made)
    if only_negatives:
        told, held = dataset.negatives(told), dataset.negatives(labelled(held))
    contigs = cut(held.select("chrom").distinct())
    numbered = shuffled(contigs.withColumn("_all", F.lit(1)), ["_all"], "chrom", contigs.count(), 0, "grp").select("chrom", "grp", F.col("chrom").alias("contig"))
    called = numbered if name_table is None else dataset.renamed(numbered, name_table)
    corners = F.explode(F.array(F.struct(F.lit("C2").alias("corner"), F.col("x")), F.struct(F.lit("C3").alias("corner"), F.reverse("x").alias("x"))))
    return told.join(called, "chrom").select("contig", "pos", "grp", "y", corners.alias("_c")).select(
        F.concat_ws("_", "contig", "pos", "_c.corner").alias("name"), "grp", "y", F.col("_c.x").cast("array<int>").alias("x"),
        F.lit(half).alias("image_size"), F.lit(resolution).alias("bin_size"),
    )


def inter_dataset(
    pixels: DataFrame, chrom_sizes: DataFrame, resolution: int, half: int = 10, fragments: DataFrame | None = None, least: int = 1, least_bins: int = 4
) -> DataFrame:
    """(name, grp, y, x, image_size, bin_size): the images of all pairs of ends that touch, in both orders, as write_dataset takes them.

    Ends are those of fragments (chrom, start, end) and of contigs without any; y is 0; the images of a pair
    of pieces are a group, numbered in the order of the MD5 of both names. Pairs with fewer than `least` contacts are left out.
    """
    at = pixels.where(F.col("resolution") == resolution)
    cells = contacts.upper(at)
    given = contacts.sizes(chrom_sizes).select("chrom", F.lit(0).cast("long").alias("start"), F.col("length").alias("end")).limit(0)
    pieces = cut(ends.fragment_pieces(given if fragments is None else fragments, chrom_sizes, at, least_bins))
    made = cut(ends.piece_pair_images(ends.piece_pair_cells(cells, pieces, half, max(least, 1)), pieces, half))
    pairs = made.select("piece1", "piece2", F.concat_ws("|", "piece1", "piece2").alias("_pair")).distinct()
    numbered = shuffled(pairs.withColumn("_all", F.lit(1)), ["_all"], "_pair", pairs.count(), 0, "grp").select("piece1", "piece2", "grp")
    turned = F.concat_ws("|", F.substring_index("name", "|", -1), F.substring_index("name", "|", 1))
    orders = F.explode(F.array(F.struct("name", "x"), F.struct(turned.alias("name"), F.reverse("x").alias("x"))))
    return made.join(numbered, ["piece1", "piece2"]).select("grp", orders.alias("_o")).select(
        "_o.name", "grp", F.lit(0).alias("y"), F.col("_o.x").cast("array<int>").alias("x"), F.lit(half).alias("image_size"), F.lit(resolution).alias("bin_size")
    )


def hotspot_cells(pixels: DataFrame, chrom_sizes: DataFrame, resolution: int, half: int = 10, block: int = 1000, size: int = 100, stride: int = 125, steps: int = 10, least: int = 1) -> DataFrame:
    """(chrom1, pos1, chrom2, pos2, r, c, cnt): cells of the images where two contigs touch most.

    In the strongest windows of every pair (see contacts.hotspots) an image is placed every `steps` bins: rows r < S
    are the S bins of chrom1 from pos1 on, the others those of chrom2 from pos2 on; mirror cells are not
    repeated. Only contigs of at least S bins count, and images with at least `least` contacts between both.
    """
    at = pixels.where(F.col("resolution") == resolution)
    long = contacts.sizes(chrom_sizes).where(F.col("length") >= half * resolution)
    cells = cut(contacts.upper(at))
    between = cells.join(long.select(F.col("chrom").alias("chrom1")), "chrom1", "left_semi").join(long.select(F.col("chrom").alias("chrom2")), "chrom2", "left_semi").where("chrom1 <> chrom2")
    spots = contacts.hotspots(between, block, size, stride)
    start = lambda b, s: (F.col(b) * block + F.col(s) * stride).cast("long")
    begins = spots.select("chrom1", "chrom2", start("block1", "sub1").alias("s1"), start("block2", "sub2").alias("s2"))
    # every position lists its bins, so cells meet it by value
    along = lambda s: F.sequence(F.col(s), F.col(s) + (size - half - 1), F.lit(steps).cast("long"))
    inside = F.sequence(F.lit(0), F.lit(half - 1))
    ones = begins.withColumn("pos1", F.explode(along("s1")))
    marked = (
        ones.withColumn("r", F.explode(inside)).withColumn("bin1", F.col("pos1") + F.col("r"))
        .join(between.select("chrom1", "chrom2", F.col("bin1").cast("long").alias("bin1"), F.col("bin2").cast("long").alias("bin2"), "cnt"), ["chrom1", "chrom2", "bin1"])
        .where(F.col("bin2").between(F.col("s2"), F.col("s2") + (size - 1)))
    )
    # the positions of chrom2 that a bin lies in
    first = F.greatest(F.ceil((F.col("bin2") - F.col("s2") - (half - 1)) / steps), F.lit(0)) * steps
    last = F.least(F.floor((F.col("bin2") - F.col("s2")) / steps), F.lit((size - half - 1) // steps)) * steps
    across = marked.withColumns({"_f": first.cast("long"), "_l": last.cast("long")}).where("_f <= _l")
    across = across.withColumn("_p", F.explode(F.sequence("_f", "_l", F.lit(steps).cast("long")))).withColumn("pos2", F.col("s2") + F.col("_p"))
    across = cut(across.select("chrom1", "pos1", "chrom2", "pos2", "r", (half + F.col("bin2") - F.col("pos2")).cast("int").alias("c"), "cnt").where("cnt > 0").distinct())
    image = ["chrom1", "pos1", "chrom2", "pos2"]
    images = across.groupBy(*image).agg(F.sum("cnt").alias("_n")).where(F.col("_n") >= least).select(*image)
    near = contacts.band(cells, half - 1).where("cnt > 0").select(F.col("chrom1").alias("chrom"), F.col("bin1").cast("long").alias("lo"), F.col("bin2").cast("long").alias("hi"), "cnt")

    def own(k: int) -> DataFrame:
        chrom, pos = F.col(f"chrom{k}"), F.col(f"pos{k}")
        places = images.select(chrom.alias("chrom"), pos.alias("pos")).distinct().withColumn("lo", F.explode(F.sequence(F.col("pos"), F.col("pos") + half - 1)))
        within = places.join(near, ["chrom", "lo"]).where(F.col("hi") < F.col("pos") + half)
        shift = half * (k - 1) - F.col("pos")
        cells_of = within.select(F.col("chrom").alias(f"chrom{k}"), F.col("pos").alias(f"pos{k}"), (F.col("lo") + shift).cast("int").alias("r"), (F.col("hi") + shift).cast("int").alias("c"), "cnt")
        return paired(images, cells_of, [f"chrom{k}", f"pos{k}"]).select(*image, "r", "c", "cnt")

    return across.join(images, image, "left_semi").select(*image, "r", "c", "cnt").union(own(1)).union(own(2))


def found_breakpoints(chrom_sizes: DataFrame, half: int = 50_000, rounds: int = 1, resolution: int = 25_000) -> DataFrame:
    """(name, centre): breakpoints recovered from the alignments of simulated chimeras; all lie at their middle."""
    made = simulate.chimeras(contacts.sizes(chrom_sizes), half, rounds)
    alignments = simulate.chimera_alignments(made, half)
    return bp.clusters(bp.breakpoints(alignments), float(resolution)).select("name", "centre")
