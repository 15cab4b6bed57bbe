"""Operators against brute force and properties, on hand-sized cases with awkward rows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contactloom.functions import names
from contactloom.operators import breakpoints, contacts, dataset, ends, features, heavykeys, links, metrics, ranking, report, scorer, segment, simulate, training, windows
from contactloom.plans import pipelines

PIXEL = "resolution int, chrom1 string, bin1 int, chrom2 string, bin2 int, cnt long, extra string"
few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def pixels(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], PIXEL)


def sizes(spark, **lengths):
    return spark.createDataFrame([*lengths.items(), *list(lengths.items())[:1], ("nothing", None), (None, 5)], "chrom string, length long")


def test_upper_cells_of_dirty_rows(spark):
    rows = [(10, "b", 1, "a", 2, 3), (10, "a", 2, "b", 1, 4), (10, "a", 2, "b", 1, 4), (10, "a", 5, "a", 3, 2), (10, "a", None, "a", 3, 2), (10, "a", 1, "a", 1, None)]
    got = {tuple(r) for r in contacts.upper(pixels(spark, rows)).collect()}
    assert got == {(10, "a", 2, "b", 1, 7), (10, "a", 3, "a", 5, 2)}
    assert contacts.upper(pixels(spark, [])).count() == 0


def random_matrix(rng, n):
    m = np.triu(rng.poisson(0.7, (n, n)))
    return m + np.triu(m, 1).T


def as_rows(m, chrom="c", resolution=10):
    return [(resolution, chrom, i, chrom, j, int(m[i, j])) for i in range(len(m)) for j in range(i, len(m)) if m[i, j]]


@pytest.mark.parametrize("n", [19, 20, 25])
def test_windows_of_small_contigs(spark, n):
    m = random_matrix(np.random.default_rng(n), n)
    cells, size = contacts.upper(pixels(spark, as_rows(m))), sizes(spark, c=n * 10 + 3)
    made = {r.pos: r.x for r in windows.images(windows.window_cells(cells, size)).collect()}
    want = {p: m[p - 10 : p + 10, p - 10 : p + 10] for p in range(10, n - 9)}
    assert {p: x for p, x in made.items()} == {p: [int(v) for v in w.ravel()] for p, w in want.items() if w.any()}
    turned = {r.pos: r.x for r in windows.images(windows.rotated(windows.window_cells(cells, size))).collect()}
    assert turned == {p: x[::-1] for p, x in made.items()}
    assert {r.pos: r.total for r in windows.window_sums(cells, size).collect()} == {p: int(w.sum()) for p, w in want.items() if w.any()}


def test_quantiles_count_implied_zeros(spark):
    rng = np.random.default_rng(1)
    mats = {"a": random_matrix(rng, 31), "b": random_matrix(rng, 7)}
    rows = [r for k, m in mats.items() for r in as_rows(m, k)]
    cells, size = contacts.upper(pixels(spark, rows)), sizes(spark, a=305, b=70)
    band = np.concatenate([np.diagonal(m, k) for m in mats.values() for k in range(-10, 11)])
    for q in (0.5, 0.83, 0.95):
        assert contacts.diagonal_quantile(cells, size, 10, q).first().quantile == pytest.approx(np.quantile(band, q))
    inside = np.concatenate([m[m > 0] for m in mats.values()])
    assert contacts.nonzero_quantile(cells, 0.9).first().quantile == pytest.approx(np.quantile(inside, 0.9))


def test_coarsening_keeps_the_sum_and_binning_agrees(spark):
    rng = random.Random(2)
    reads = [("ab"[rng.randrange(2)], rng.randrange(3000), "ab"[rng.randrange(2)], rng.randrange(3000), rng.choice([0, 1024])) for _ in range(300)] + [(None, 1, "a", 2, 0)]
    df = spark.createDataFrame(reads, "chrom1 string, pos1 long, chrom2 string, pos2 long, flag int")
    binned = contacts.binned(df, [100, 200, 1000])
    totals = {r.resolution: r.n for r in binned.groupBy("resolution").agg(F.sum("cnt").alias("n")).collect()}
    assert set(totals) == {100, 200, 1000} and set(totals.values()) == {sum(1 for r in reads if r[0] and not r[4])}
    fine = contacts.coarsened(binned.where("resolution = 100"), 10)
    assert {tuple(r) for r in fine.collect()} == {tuple(r) for r in binned.where("resolution = 1000").collect()}
    with pytest.raises(ValueError):
        contacts.binned(df, [100, 150])


def fragments(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start long, end long")


def test_fragments_of_one_contig_have_images_too(spark):
    rng = np.random.default_rng(5)
    m = random_matrix(rng, 60)
    at = {"c:0-205": (0, 20), "c:205-270": (20, 27), "c:270-605": (27, 60)}
    cells, size = contacts.upper(pixels(spark, as_rows(m))), sizes(spark, c=605, alone=70, tiny=30)
    given = fragments(spark, [("c", 0, 205), ("c", 205, 270), ("c", 270, 605), ("c", 0, 205), ("c", None, 3), ("gone", 0, 20)])
    pieces = ends.fragment_pieces(given, size, cells)
    assert {(r.piece, r.bin0, r.bin1) for r in pieces.collect()} == {(k, *v) for k, v in at.items()} | {("alone:0-70", 0, 7)}
    got = {r.name: r.x for r in ends.piece_pair_images(ends.piece_pair_cells(cells, pieces), pieces).collect()}
    inside = lambda k, side: [b for b in (range(at[k][0], at[k][1]) if side == 0 else range(at[k][1] - 1, at[k][0] - 1, -1))][:10]
    want = {}
    for a in sorted(at):
        for b in sorted(at):
            for s in (0, 1):
                for t in (0, 1):
                    if a < b:
                        one, two = inside(a, s), inside(b, t)
                        bins = [one[9 - k] if 9 - k < len(one) else None for k in range(10)] + [two[k] if k < len(two) else None for k in range(10)]
                        x = [[-1 if i is None or j is None else int(m[i, j]) for j in bins] for i in bins]
                        if any(v > 0 for row in x[:10] for v in row[10:]):
                            want[f"{a}:{s}|{b}:{t}"] = [v for row in x for v in row]
    assert got == want and len(want) == 12
    strong = ends.piece_pair_cells(cells, pieces, least=40)
    sums = {n: sum(v for k, v in enumerate(x) if k // 20 < 10 <= k % 20 and v > 0) for n, x in want.items()}
    assert {f"{r.piece1}:{r.side1}|{r.piece2}:{r.side2}" for r in strong.collect()} == {n for n, v in sums.items() if v >= 40}


def test_names_of_pieces(spark):
    lines = spark.createDataFrame([("c:0-1049",), ("c:1049-2000",), ("odd",), (None,)], "line string")
    pieces = spark.createDataFrame([("c", 0, 10, 100, 2077), ("c", 10, 20, 100, 2077), ("c", 5, 20, 100, 2077), ("c", 5, 12, 100, 2077)], "chrom string, bin0 long, bin1 long, resolution int, length long")
    got = {(r.bin0, r.bin1): r.name for r in ends.named_pieces(lines, pieces).collect()}
    assert got == {(0, 10): "c:0-1049", (10, 20): "c:1049-2000", (5, 20): "c:500-2077", (5, 12): "c:500-1200"}


@pytest.mark.parametrize("na,nb", [(3, 30), (4, 9), (10, 30), (30, 3)])
def test_end_pair_images_follow_the_closed_form(spark, na, nb):
    rng = np.random.default_rng(na * 100 + nb)
    whole = random_matrix(rng, na + nb)
    a, b, ab = whole[:na, :na], whole[na:, na:], whole[:na, na:]
    rows = as_rows(a, "a") + as_rows(b, "b") + [(10, "a", i, "b", j, int(ab[i, j])) for i in range(na) for j in range(nb) if ab[i, j]]
    cells, size = contacts.upper(pixels(spark, rows)), sizes(spark, a=na * 10 + 1, b=nb * 10 + 9)
    pieces = ends.fragment_pieces(fragments(spark, []), size, cells, least_bins=1)
    got = {(r.side1, r.side2): (r.name, r.x) for r in ends.piece_pair_images(ends.piece_pair_cells(cells, pieces), pieces).collect()}
    for s1 in (0, 1):
        for s2 in (0, 1):
            at = lambda k, s1=s1, s2=s2: ((9 - k) if s1 == 0 else na - 1 - (9 - k)) if k < 10 else na + ((k - 10) if s2 == 0 else nb - 1 - (k - 10))
            inside = [9 - k < na if k < 10 else k - 10 < nb for k in range(20)]
            want = np.array([[whole[at(i), at(j)] if inside[i] and inside[j] else -1 for j in range(20)] for i in range(20)])
            touches = (want[:10, 10:] > 0).any()
            assert ((s1, s2) in got) == touches
            if touches:
                name, x = got[(s1, s2)]
                assert name == f"a:0-{na * 10 + 1}:{s1}|b:0-{nb * 10 + 9}:{s2}" and x == [int(v) for v in want.ravel()]


KEEP = {"KKK": [(0, 2)], "BBB": [], "KBBK": [(0, 1), (1, 3), (3, 3)], "BKKB": [(0, 1), (1, 3)], "KKBB": [(0, 2)], "K": [(0, 0)], "B": []}


def test_runs(spark):
    rows = [(k, i, 1.0 if c == "K" else 0.0, False) for k, v in KEEP.items() for i, c in enumerate(k)]
    rows += [("masked", i, 0.0, i < 3) for i in range(3)] + [("null", 0, None, None), ("null", 1, 1.0, None)]
    got: dict = {}
    for r in segment.runs(spark.createDataFrame(rows, "chrom string, bin long, p double, masked boolean"), 0.05).orderBy("part_id").collect():
        got.setdefault(r.chrom, []).append((r.b0, r.b1))
    assert got == {k: v for k, v in KEEP.items() if v} | {"masked": [(0, 2)], "null": [(0, 1), (1, 1)]}


def test_parts_do_not_overlap_at_the_end(spark):
    parts = spark.createDataFrame([("a", 1, 10, 30), ("a", 2, 30, 30), ("b", 1, 12, 20)], "chrom string, part_id int, b0 long, b1 long")
    curve = spark.createDataFrame([("a", 10), ("a", 30), ("b", 10), ("b", 20)], "chrom string, bin long")
    size = spark.createDataFrame([("a", 411), ("b", 305)], "chrom string, length long")
    assert {tuple(r) for r in segment.trimmed(parts, curve, size, 10).collect()} == {("a", 0, 300), ("a", 300, 411), ("b", 120, 305)}
    assert ("a", 0, 411) in {tuple(r) for r in segment.trimmed(parts, curve, size, 10, legacy=True).collect()}


def merge_by_hand(parts, least):
    parts, k = [list(p) for p in parts], 0
    while k < len(parts) - 1:
        b0, b1 = parts[k]
        if b1 - b0 >= least:
            k += 1
            continue
        if k == 0:
            parts[1][0] = b0
        else:
            middle = b0 + (b1 - b0) // 2
            parts[k - 1][1] = parts[k + 1][0] = middle
        del parts[k]
    return [tuple(p) for p in parts]


@few
@given(st.lists(st.lists(st.integers(1, 45), min_size=1, max_size=9), min_size=1, max_size=8))
def test_short_parts_merge_as_by_hand(spark, widths):
    all_parts = {"fixed": [(10, 12), (12, 40), (40, 45), (45, 90), (90, 95)]}
    for i, w in enumerate(widths):
        at = np.concatenate([[10], 10 + np.cumsum(w)]).tolist()
        all_parts[f"c{i}"] = list(zip(at[:-1], at[1:]))
    df = spark.createDataFrame([(c, a, b) for c, ps in all_parts.items() for a, b in ps], "chrom string, b0 long, b1 long")
    got: dict = {}
    for r in segment.merged_parts(df, 20).orderBy("part_id").collect():
        got.setdefault(r.chrom, []).append((r.b0, r.b1))
    assert got == {c: merge_by_hand(ps, 20) for c, ps in all_parts.items()}


def test_smoothing_and_masking(spark):
    curve = spark.createDataFrame([("a", i, float(i % 7)) for i in range(40)] + [("b", i, float(i)) for i in range(19)], "chrom string, bin long, p double")
    got = {(r.chrom, r.bin): r.p for r in segment.smoothed(curve).collect()}
    want = np.convolve([i % 7 for i in range(40)], np.ones(20) / 20, "same")
    assert all(got[("a", i)] == pytest.approx(want[i]) for i in range(40)) and got[("b", 5)] == 5
    regions = spark.createDataFrame([("a", 20, 21), ("a", None, 3)], "chrom string, b0 long, b1 long")
    masked = {r.bin for r in segment.masked(curve, regions, 5).where("masked").collect()}
    assert masked == set(range(15, 27))


def test_labels(spark):
    at = spark.createDataFrame([("a", p) for p in range(10, 31)] + [("b", 12)], "chrom string, pos long")
    labels = {(r.chrom, r.pos): r.y for r in windows.labelled(at, spark.createDataFrame([("a", 20), ("a", None)], "chrom string, bin long")).collect()}
    assert {p for (c, p), y in labels.items() if not y} == set(range(17, 24)) and labels[("b", 12)] == 1


def test_links_average_both_directions(spark):
    samples = [("A:0-9:1|B:0-9:0", 0.2), ("B:0-9:0|A:0-9:1", 0.4), ("x:y:0-3:0|z-1:0-4:0", 1.0), ("broken|name", 0.3), (None, 0.3), ("a|b|c", 0.1)]
    found = links.scored_links(spark.createDataFrame(samples, "name string, prob double")).withColumn("resolution", F.lit(5000))
    got = {(r.a, r.b, r.oa, r.ob): (round(r.prob, 6), r.n) for r in links.canonical(found).collect()}
    assert got == {("A:0-9", "B:0-9", "End", "Start"): (0.3, 2), ("x:y:0-3", "z-1:0-4", "Start", "Start"): (1.0, 1)}
    edge = links.edges(spark.createDataFrame([("A", "B", "Start", "End", 0.5), ("A", "B", "End", "End", 0.1)], "a string, b string, oa string, ob string, prob double"))
    assert {tuple(r) for r in edge.collect()} == {("B", "A", "End-Start", "+", "+", 0.5), ("A", "B", "End-End", "+", "-", 0.1)}
    graph = links.nodes(found, sizes(spark, **{"C": 7, "A": 9}))
    assert ("C:0-7", "C") in {tuple(r) for r in graph.collect()} and "A:0-9" in {r.node for r in graph.collect()}
    assert [r[0] for r in spark.createDataFrame([(v,) for v in (0.0005, 0.5, 1.0, 0.12345, 0.0)], "v double").select(links.decimal(links.rounded(F.col("v")))).collect()] == ["0.0005", "0.5", "1.0", "0.1235", "0.0"]
    parts = spark.createDataFrame([("A:2-9", "A", 2, 9), ("A:5-40", "A", 5, 40), ("A:20-30", "A", 20, 30), ("B:0-3", "B", 0, 3), ("A:4-4", "A", 4, 4)], "node string, chrom string, _s long, _e long")
    whole = "acgtacgtacgtttg"
    cut_out = {r.node: r.seq for r in links.sliced(parts, spark.createDataFrame([("A", whole), ("C", None)], "name string, seq string"), 4).collect()}
    assert cut_out == {"A:2-9": whole[2:9], "A:5-40": whole[5:40]}
    lines = [r.line for r in links.gfa_lines(graph, edge, spark.createDataFrame([("A", "acgtacgtacgt")], "name string, seq string")).orderBy("rank").collect()]
    assert lines[0].startswith("H\t") and "S\tA:0-9\tACGTACGTA\tLN:i:9" in lines and sum(x.startswith("L\t") for x in lines) == 1


@few
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30), st.integers(0, 12)), max_size=40))
def test_intervals(spark, rows):
    df = spark.createDataFrame([(q, s, s + w) for q, s, w in rows] + [(None, 1, 2), (1, 9, 3)], "q int, s int, e int")
    seen = {(q, s, s + w) for q, s, w in rows}
    want = {a for a in seen if not any(b != a and b[0] == a[0] and b[1] <= a[1] and b[2] >= a[2] for b in seen)}
    assert {tuple(r) for r in breakpoints.maximal_intervals(df).collect()} == want


def test_breakpoints_of_simulated_chimeras(spark):
    found = pipelines.found_breakpoints(sizes(spark, a=500_000, b=300_000, c=10))
    assert found.count() > 0 and {r.centre for r in found.collect()} == {50_000}
    points = spark.createDataFrame([("a", 0), ("a", 5), ("a", 11), ("a", None), ("b", 1)], "name string, bp long")
    got = {(r.name, r.low, r.high, r.n) for r in breakpoints.clusters(points, 5).collect()}
    assert got == {("a", 0, 5, 2), ("a", 11, 11, 1), ("b", 1, 1, 1)}


def test_sequences(spark):
    df = spark.createDataFrame([(f"c{n}", n) for n in (5, 15, 20, 25, 30)], "chrom string, length long")
    count = lambda legacy: {r.chrom: r["count"] for r in simulate.broken(df, 10, legacy).groupBy("chrom").count().collect()}
    assert count(True) == {"c20": 1, "c25": 2, "c30": 2} and count(False) == {"c15": 1, "c20": 2, "c25": 2, "c30": 3}
    whole = simulate.broken(df, 10).groupBy("chrom").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    assert {r.chrom: r.n for r in whole.collect()} == {"c15": 15, "c20": 20, "c25": 25, "c30": 30}
    seqs = spark.createDataFrame([("1", "AANNNCC"), ("2", "NNNNNNA"), ("3", "AANNNNCC"), ("4", None), ("5", "")], "name string, seq string")
    got = sorted(tuple(r) for r in simulate.split_sequences(seqs).collect())
    assert got == [("1", 1, "AA"), ("1", 2, "CC"), ("2", 1, "A"), ("3", 1, "AA"), ("3", 2, "NCC")]
    rc = [r[0] for r in spark.createDataFrame([("acgtn",), ("AXG",), ("",), (None,)], "s string").select(simulate.reverse_complement(F.col("s"))).collect()]
    assert rc == ["NACGT", None, "", None]


def test_chimeras_use_no_piece_twice(spark):
    fasta = spark.createDataFrame([(c, "".join(random.Random(c).choice("ACGT") for _ in range(200))) for c in "abcdef"], "name string, seq string")
    made = simulate.chimeras(fasta.select(F.col("name").alias("chrom"), F.length("seq").cast("long").alias("length")), 20, rounds=2).cache()
    for r in (1, 2):
        used = [x for row in made.where(F.col("round") == r).collect() for x in ((row.chrom1, row.start1), (row.chrom2, row.start2))]
        assert used and len(used) == len(set(used))
    assert {len(r.seq) for r in simulate.chimera_sequences(made, fasta, 20).collect()} == {40}


def test_salted_results_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [(i % 700, rng.choice([1, 1, 1, 2, None, i]), rng.choice([0, 1, None]), "x") for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, k long, v int, _salt string").repartition(6)
    got = {r.k: r for r in heavykeys.salted_aggregate(df, "k", {"v": F.col("v")}, distinct="id", share=0.05, salts=5).collect()}
    for r in df.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.sum("v").alias("s"), F.avg("v").alias("m"), F.min("v").alias("l")).collect():
        assert (got[r.k].n_rows, got[r.k].n_distinct, got[r.k].v_sum, got[r.k].v_mean, got[r.k].v_min) == (r.n, r.d, r.s, r.m, r.l)
    assert len(got) == df.select("k").distinct().count()
    assert {r.k for r in heavykeys.heavy_keys(df, "k", 0.1).collect()} == {1, 2, None}
    assert heavykeys.salted_aggregate(df.limit(0), "k", {"v": F.col("v")}).count() == 0


def test_ranks_in_buckets(spark):
    rows = [(i % 3, (i * 7919) % 1009, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, v int, id int").withColumn("b", F.floor(F.col("v") / 50))
    want = {}
    for g in range(3):
        for k, r in enumerate(sorted((v, i) for gg, v, i in rows if gg == g), 1):
            want[r[1]] = k
    assert {r.id: r.rank for r in ranking.with_rank(df, ["g"], "b", [F.col("v"), F.col("id")]).collect()} == want
    hashed = df.withColumn("h", F.xxhash64("id")).withColumn("hb", ranking.hash_bucket(F.col("h"), 9)).orderBy("h").collect()
    assert [r.hb for r in hashed] == sorted(r.hb for r in hashed) and {r.hb for r in hashed} == set(range(9))


def test_metrics_with_ties(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0, 1]), round(rng.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(rows + [(1, None), (None, 0.5), (-1, 0.5), (0, float("nan"))], "y int, prob double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    u = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    assert metrics.roc_auc(df).first().auc == pytest.approx(u / len(pos) / len(neg))
    ap, tp = 0.0, 0
    for t in sorted({p for _, p in rows}, reverse=True):
        hits = sum(1 for p in pos if p == t)
        tp += hits
        ap += hits / len(pos) * tp / sum(1 for _, p in rows if p >= t)
    assert metrics.average_precision(df).first().ap == pytest.approx(ap)
    labelled = df.withColumn("l", F.col("y").cast("string"))
    test = metrics.mann_whitney(metrics.usable(labelled), "l", "prob", "1", "0").first()
    assert test.u == pytest.approx(u) and 0 < test.p_value < 1
    # counts whose products and cubes are beyond 64 bits
    many = spark.range(8).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") / 2).cast("int").cast("double").alias("prob"))
    big = metrics.mann_whitney(many.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("l", F.col("y").cast("string")), "l", "prob", "1", "0").first()
    assert big.u == 12 * 12 / 2 and big.z < 0
    assert metrics.confusion(df.limit(0)).first().tp == 0 and metrics.scores(metrics.confusion(df.limit(0))).first().npv == 0


def test_dataset_operators_on_awkward_rows(spark):
    ddl = "sample_id long, name string, grp long, y int, x array<int>, image_size int, bin_size int, split string, loaded_at timestamp, _sum int"
    rows = [(i, f"c_{i}_C{2 + i % 2}", i // 4, 1, [i] * 4, 10, 5000, "train", None, 0) for i in range(20)]
    rows += [(50, None, None, None, None, None, None, None, None, 0), (51, "A:0-1:0|B:0-2:1", 3, -1, [7] * 4, 10, 5000, "val", None, 0), rows[3]]
    df = spark.createDataFrame(rows, ddl)
    assert dataset.latest(df).count() == 22
    assert {r.sample_id for r in dataset.duplicates(df).collect()} == {7, 51}
    assert dataset.equalised(df, 1, bins=4).groupBy("bin").count().where("count > 1").count() == 0
    assert dataset.histogram(df.select(dataset.image_sum(F.col("x")).alias("v")), "v", 4).agg(F.sum("n")).first()[0] == 22
    assert dataset.filtered(df, 0.5).count() + dataset.filtered(df, 0.5, dump=False).count() == 22
    types = {r.sample_id: (r.grp_type, r.corner) for r in dataset.with_type(df).collect()}
    assert types[50] == (None, None) and types[51] == ("inter", None) and types[3] == ("intra", "C3")
    with pytest.raises(ValueError):
        dataset.load(df, 10, 1)
    empty = df.limit(0)
    assert dataset.equalised(empty, 1).count() == 0 and dataset.histogram(empty.select(F.col("grp").alias("v")), "v").count() == 0
    image = spark.createDataFrame([([-1, 0, 31, 62],)], "x array<int>")
    assert image.select(dataset.minmax(F.col("x"), F.lit(31.0))).first()[0] == [-1.0, 0.0, 1.0, 1.0]
    assert image.select(dataset.minmax(F.col("x"), F.lit(0.0))).first()[0] == [-1.0, 0.0, 1.0, 1.0]
    assert image.select(dataset.border_masked(F.col("x"), 2, 1)).first()[0] == [-1, -1, -1, 62]


def test_splits_and_draws_of_groups(spark):
    rows = [(i, f"n{i % 40}", g, (0 if g % 3 else 1) if g is not None else None) for i, g in enumerate([*range(60), *range(60), None, None])]
    df = spark.createDataFrame(rows, "sample_id long, name string, grp long, y int")
    got = {r.grp: (r.y, r.split) for r in dataset.group_split(df, 0.1, 0.05).collect()}
    assert len(got) == 60
    for y, n in ((0, 40), (1, 20)):
        held = int(np.ceil(n * (0.1 + 0.05)))
        val = int(np.ceil(held * (0.1 / (0.1 + 0.05))))
        found = [s for k, s in got.values() if k == y]
        assert (found.count("val"), found.count("test"), len(found)) == (val, held - val, n)
    assert got != {r.grp: (r.y, r.split) for r in dataset.group_split(df, 0.1, 0.05, seed=1).collect()}
    old = [r.split for r in dataset.group_split_legacy(df, 0.1, 0.05).collect()]
    assert (old.count("test"), old.count("val"), len(old)) == (4, 7, 60)
    assert {r.split for r in dataset.group_split_legacy(df).collect()} == {"train"}
    assert dataset.group_split(df.limit(0)).count() == 0 and dataset.group_split_legacy(df.limit(0), 0.1, 0.1).count() == 0
    drawn = [r.sample_id for r in dataset.drawn(df, 9).collect()]
    assert len(set(drawn)) == 9 and drawn == [r.sample_id for r in dataset.drawn(df.repartition(7), 9).collect()]
    scored = spark.createDataFrame([(0, 0.7), (1, 0.7), (1, 0.2), (0, None), (None, 0.1), (1, float("nan"))], "y int, prob double")
    assert {tuple(r) for r in dataset.misclassified(scored).collect()} == {(0, 0.7), (1, 0.2)}
    marks = {r.quantile: r.marker for r in dataset.quantile_markers(df, "sample_id").collect()}
    assert marks == {q: pytest.approx(np.quantile(range(122), q)) for q in (0.2, 0.4, 0.5, 0.6, 0.8)}


def test_features_tell_joins_apart(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        x = rng.poisson(3, (20, 20))
        if i % 2:
            x[:10, 10:], x[10:, :10] = 0, 0
        rows.append((i, 1 - i % 2, [int(v) for v in x.ravel()]))
    df = spark.createDataFrame(rows + [(900, 1, None), (901, 1, [1, 2]), (902, None, rows[0][2]), (903, 1, [-1] * 400)], "sample_id long, y int, x array<int>")
    model = features.fitted(df.where("sample_id < 80"))
    got = {r.sample_id: r.prob for r in features.feature_scores(df, model).collect()}
    assert set(got) == {*range(120), 902, 903} and all((got[i] > 0.5) == (i % 2 == 0) for i in range(80, 120))


def test_datasets_end_in_files(spark, tmp_path):
    from contactloom.sources import formats

    m = random_matrix(np.random.default_rng(9), 40)
    df = pixels(spark, as_rows(m, "c", 10) + [(10, "c", i, "d", j, 1) for i in range(4) for j in range(30)] + as_rows(m, "d", 10))
    size, names_of = sizes(spark, c=400, d=405), spark.createDataFrame([("d", "old")], "new string, old string")
    breaks = spark.createDataFrame([("c", 20)], "chrom string, bin long")
    intra = pipelines.intra_dataset(df, size, 10, breakpoints=breaks, name_table=names_of)
    rows = {r.name: r for r in intra.collect()}
    assert set(rows) == {f"{c}_{p}_{k}" for c in ("c", "old") for p in range(10, 31) for k in ("C2", "C3")}
    assert {n for n, r in rows.items() if r.y == 0} == {f"c_{p}_{k}" for p in range(17, 24) for k in ("C2", "C3")}
    assert rows["c_15_C2"].x == [int(v) for v in m[5:25, 5:25].ravel()] and rows["c_15_C3"].x == rows["c_15_C2"].x[::-1]
    assert {r.grp for r in rows.values()} == {1, 2}
    assert pipelines.intra_dataset(df, size, 10, breakpoints=breaks, only_negatives=True).count() == 14
    inter = {r.name: r for r in pipelines.inter_dataset(df, size, 10).collect()}
    assert inter["d:0-405:1|c:0-400:0"].x == inter["c:0-400:0|d:0-405:1"].x[::-1] if "c:0-400:0|d:0-405:1" in inter else True
    assert set(inter) == {n for s, t in ((0, 0),) for n in (f"c:0-400:{s}|d:0-405:{t}", f"d:0-405:{t}|c:0-400:{s}")} and {r.grp for r in inter.values()} == {1}
    formats.write_dataset(intra, str(tmp_path / "set"), cells=contacts.upper(df), edited=True, Source="hand")
    assert spark.read.parquet(str(tmp_path / "set/images")).where("image_size = 10 and bin_size = 10").count() == len(rows)
    assert spark.read.parquet(str(tmp_path / "set/whole")).agg(F.sum("cnt")).first()[0] == 2 * int(np.triu(m).sum())
    assert set(spark.read.parquet(str(tmp_path / "set/metadata")).first().metadata) == {"Edit", "Source"}


@pytest.mark.parametrize("least,only", [(0, False), (1, False), (3, True), (9, False)])
def test_images_of_a_dataset_are_made_once(spark, least, only):
    rows = [(10, c, i, c, i + i % 4, 1 + i % 3) for c in ("c", "d", "e") for i in range(0, 60, 5)] + [(10, "f", 30, "f", 30, 1), (10, "f", 2, "g", 3, 5)]
    df, size = pixels(spark, rows), sizes(spark, c=600, d=605, e=300, f=600, g=600)
    breaks = spark.createDataFrame([("c", 20), ("f", 31)], "chrom string, bin long")
    made = pipelines.intra_dataset(df, size, 10, breakpoints=breaks, least=least, only_negatives=only)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1
    got = {r.name: (r.grp, r.y, r.x) for r in made.collect()}
    cells = contacts.upper(df)
    every = windows.every_position(size, df) if least <= 0 else None
    want = {(r.chrom, r.pos): (int((r.chrom, r.pos) not in {(c, p) for c, b in (("c", 20), ("f", 31)) for p in range(b - 3, b + 4)}), r.x)
            for r in windows.images(windows.window_cells(cells, size), every=every).collect() if sum(r.x) >= least or least <= 1}
    want = {k: v for k, v in want.items() if v[0] == 0 or not only}
    order = sorted({c for c, _ in want}, key=lambda c: hashlib.md5(f"0:{c}".encode()).hexdigest())
    assert got == {f"{c}_{p}_{k}": (order.index(c) + 1, y, x if k == "C2" else x[::-1]) for (c, p), (y, x) in want.items() for k in ("C2", "C3")}


def test_runs_of_window_sums(spark):
    rng = np.random.default_rng(12)
    m = np.triu((rng.random((300, 300)) < 0.01) * rng.integers(1, 4, (300, 300)))
    m = m + np.triu(m, 1).T
    cells, size = contacts.upper(pixels(spark, as_rows(m))), sizes(spark, c=3000, empty=1000, tiny=100)
    want = {("c", p): int(m[p - 10 : p + 10, p - 10 : p + 10].sum()) for p in range(10, 291)} | {("empty", p): 0 for p in range(10, 91)}
    for width in (7, 64, 100_000):
        runs = windows.window_sum_runs(cells, size, width=width).collect()
        got = {}
        for r in runs:
            for p in range(r.first, r.last + 1):
                assert (r.chrom, p) not in got
                got[(r.chrom, p)] = r.total
        assert got == want


def test_contig_names(spark):
    cases = {
        "lg:a-1_x_40_C2": ["lg:a-1_x"], " Sup er_3_c3 ": ["super"], "hap1:ctg:0-9:0|z.1-2:5-8:1": ["hap1:ctg", "z.1-2"], "A:0-1:0|a:4-5:1": ["a"], "odd": ["odd"], None: None, "": [""],
    }
    df = spark.createDataFrame([(k,) for k in cases], "name string").select("name", names.contigs_of(F.col("name")).alias("c"))
    assert {r.name: r.c for r in df.collect()} == cases


def test_reports(spark):
    df = spark.createDataFrame([("1-01:00:00", "3,5"), ("00:25:50", "x"), ("bad", None)], "t string, n string")
    assert [r[0] for r in df.select(report.seconds(F.col("t"))).collect()] == [90000, 1550, None]
    assert [r[0] for r in df.select(report.decimal_comma(F.col("n"))).collect()] == [3.5, None, None]
    assert [r[0] for r in df.limit(1).select(report.relative_difference(F.lit(3.0), F.lit(2.0)), report.relative_difference(F.lit(3.0), F.lit(0.0))).collect()] == ["50.00%"]


def test_network_masks_and_turns():
    net = scorer.Network(seed=1)
    rng = np.random.default_rng(0)
    x = rng.random((3, 20, 20)).astype(np.float32)
    assert net.predict(x).shape == (3,) and ((net.predict(x) > 0) & (net.predict(x) < 1)).all()
    # what is masked does not matter, and a full mask gives nothing
    a, b = x.copy(), x.copy()
    a[:, :3], b[:, :3] = -1, -5
    assert np.allclose(net.predict(a), net.predict(b))
    out, mask = net.partial(np.ones((1, 1, 4, 4), np.float32), np.zeros((1, 1, 4, 4), np.float32), np.ones((1, 1, 3, 3), np.float32))
    assert not out.any() and not mask.any()
    half = np.zeros((1, 1, 4, 4), np.float32)
    half[..., :2] = 1
    out, mask = net.partial(np.ones((1, 1, 4, 4), np.float32), half, np.ones((1, 1, 3, 3), np.float32))
    assert np.allclose(out[0, 0, 1, :3], 9) and mask[0, 0, 1].tolist() == [1, 1, 1, 0]


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    x, y = rng.random((5, 20, 20)).astype(np.float32), np.array([0, 1, 1, 0, 1])
    x[0, :3], x[1, :, :5] = -1, -1
    net = scorer.Network(seed=3).ready()

    def loss():
        p = net.predict(x).astype(float)
        p, weight = np.where(y == 1, p, 1 - p), np.where(y == 1, 1.0, 1.2)
        return (-weight * (1 - p) * np.log(p)).mean()

    got = training.gradients(net, x, y, None, 1.0, 1.0, 1.2)
    for name, w in net.weights.items():
        at = np.unravel_index(np.abs(got[name]).argmax(), w.shape)
        kept, around = w[at], []
        for step in (2e-3, -2e-3):
            w[at] = kept + step
            around.append(loss())
        w[at] = kept
        assert np.isclose(got[name][at], (around[0] - around[1]) / 4e-3, rtol=0.1, atol=2e-3), name


def blocks(n, seed):
    """Images of two kinds: contacts across the middle (1) or not (0)."""
    rng = np.random.default_rng(seed)
    x, y = rng.poisson(12, (n, 20, 20)), rng.integers(0, 2, n)
    x[y == 0, :10, 10:], x[y == 0, 10:, :10] = 0, 0
    return [(i, int(b), a.ravel().tolist()) for i, (a, b) in enumerate(zip(x, y))]


def test_training_learns(spark):
    kinds = "sample_id long, y int, x array<int>"
    rows = blocks(400, 1) + [(900, None, [1] * 400), (901, 2, [1] * 400), (902, 1, None), (903, 0, [1]), (None, 1, [None] * 400)]
    train, held = spark.createDataFrame(rows, kinds), spark.createDataFrame(blocks(100, 2), kinds)
    net = training.trained(train, epochs=5, rows_per_task=200)
    got = scorer.network_scores(held, network=net).join(held, "sample_id").select("y", "prob").collect()
    assert np.mean([(r.prob >= 0.5) == (r.y == 1) for r in got]) > 0.9
    # as a table and back
    again = training.network_of(training.weight_rows(spark, net))
    assert all(np.array_equal(w, again.weights[n]) for n, w in net.weights.items())
    # no rows change nothing; a frozen encoder keeps its weights
    start = scorer.Network(seed=4).ready()
    assert np.allclose(training.trained(train.limit(0), start, epochs=2).weights["head1"], start.weights["head1"])
    head = training.trained(train, start, epochs=1, freeze_encoder=True)
    assert np.array_equal(head.weights["first"], start.weights["first"]) and not np.array_equal(head.weights["head1"], start.weights["head1"])


def test_pipelines_with_the_network(spark):
    rng = np.random.default_rng(5)
    rows = as_rows(random_matrix(rng, 40), "a", 5000) + as_rows(random_matrix(rng, 40), "b", 5000) + [(5000, "a", 39, "b", 0, 9), (5000, "a", 38, "b", 2, 4)]
    df, size = pixels(spark, rows), sizes(spark, a=200_000, b=200_000, c=10)
    score = pipelines.network_scorer(scorer.Network(seed=2))
    parts = pipelines.corrected_contigs(df, size, threshold=0.0, score=score, quantile=0.95)
    assert {tuple(r) for r in parts.collect()} == {("a", 0, 200_000), ("b", 0, 200_000)}
    graph_nodes, graph_edges, lines = pipelines.scaffolding_graph(df, size, score=score, quantile=0.95)
    assert {r.node for r in graph_nodes.collect()} == {"a:0-200000", "b:0-200000", "c:0-10"}
    assert {(r.a, r.b, r.type) for r in graph_edges.collect()} == {("a:0-200000", "b:0-200000", "End-Start")} and lines.count() == 5


def test_pipelines_find_a_misjoin(spark):
    rng = np.random.default_rng(3)
    n = 120
    near = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    m = rng.poisson(40.0 / (1 + near))
    m[:60, 60:] = 0
    m = np.triu(m) + np.triu(m, 1).T
    got = sorted(tuple(r) for r in pipelines.corrected_contigs(pixels(spark, as_rows(m, "c", 5000)), sizes(spark, c=n * 5000 + 17), threshold=0.05).collect())
    assert got[0][1] == 0 and got[-1][2] == n * 5000 + 17 and len(got) == 2
    assert abs(got[0][2] - 60 * 5000) <= 5 * 5000 and got[0][2] == got[1][1]


def test_noncontiguous_pairs_of_contigs_of_any_length(spark):
    bins = {"short": 39, "one": 40, "two": 80, "three": 125, "long": 40 * 173 + 7}
    pairs = ends.noncontiguous_pairs(sizes(spark, **{c: n * 25_000 + 3 for c, n in bins.items()}), 25_000, 40)
    got = sorted(tuple(r) for r in pairs.collect())
    starts = {c: range(0, n - 39, 40) for c, n in bins.items()}
    assert got == sorted((c, a, a + 40, b, b + 40) for c, at in starts.items() for a in at for b in at if a < b and b != a + 40)
    ranges = ends.noncontiguous_ranges(sizes(spark, **{c: n * 25_000 + 3 for c, n in bins.items()}), 25_000, 40).collect()
    assert sorted((r.chrom, r.a0, b) for r in ranges for b in range(r.b_first, r.b_last + 1, 40)) == [(c, a, b) for c, a, _, b, _ in got]
    assert sum(r.pairs for r in ranges) == len(got)


def test_numbers_are_listed_over_ranges(spark):
    df = spark.createDataFrame([("a", 0, 25), ("b", 3, 3), ("c", 5, 4), ("d", 0, None)], "k string, lo long, hi long")
    got = sorted((r.k, r.n) for r in ranking.spread(df, F.col("lo"), F.col("hi"), 5, "n", width=2).collect())
    assert got == [("a", n) for n in range(0, 26, 5)] + [("b", 3)]


def test_windows_without_contacts_exist(spark):
    m = np.zeros((70, 70), dtype=int)
    m[:25, :25], m[50:, 50:] = 1, 2
    cells, size = contacts.upper(pixels(spark, as_rows(m))), sizes(spark, c=700, other=205, tiny=199)
    want = {("c", p): m[p - 10 : p + 10, p - 10 : p + 10] for p in range(10, 61)} | {("other", 10): np.zeros((20, 20), dtype=int)}
    sums = {(r.chrom, r.pos): r.total for r in windows.window_sums(cells, size, least=0).collect()}
    assert sums == {k: int(w.sum()) for k, w in want.items()} and 0 in sums.values()
    every = windows.every_position(size, cells)
    made = {(r.chrom, r.pos): r.x for r in windows.images(windows.window_cells(cells, size), every=every).collect()}
    assert made == {k: [int(v) for v in w.ravel()] for k, w in want.items()}


def test_filled_curve(spark):
    curve = spark.createDataFrame([("a", 12, 0.5), ("a", 15, 0.7), ("b", 10, 0.2)], "chrom string, bin long, p double")
    spans = spark.createDataFrame([("a", 10, 16), ("b", 10, 10), ("c", 10, 11)], "chrom string, first long, last long")
    runs = sorted(tuple(r) for r in segment.stretches(curve, spans, 0.0).collect())
    assert runs == [("a", 10, 11, 0.0), ("a", 12, 12, 0.5), ("a", 13, 14, 0.0), ("a", 15, 15, 0.7), ("a", 16, 16, 0.0), ("b", 10, 10, 0.2), ("c", 10, 11, 0.0)]
    flagged = lambda rows: sorted(tuple(r) for r in segment.runs(rows.withColumn("masked", F.lit(False)), 0.3, emit_trailing=True).collect())
    assert flagged(segment.stretches(curve, spans, 0.0)) == flagged(segment.filled(curve, spans, 0.0))
    got = sorted(tuple(r) for r in segment.filled(curve, spans, 0.0).collect())
    assert got == [("a", b, {12: 0.5, 15: 0.7}.get(b, 0.0)) for b in range(10, 17)] + [("b", 10, 0.2), ("c", 10, 0.0), ("c", 11, 0.0)]


def test_pipelines_cut_at_a_gap_without_contacts(spark):
    n = 200
    near = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    m = np.where(near < 25, 5, 0)
    m[75:125], m[:, 75:125] = 0, 0
    df, size = pixels(spark, as_rows(m, "c", 5000)), sizes(spark, c=n * 5000, empty=n * 5000)
    got = sorted(tuple(r) for r in pipelines.corrected_contigs(df, size).collect())
    assert len(got) == 3 and got[0][1] == 0 and got[-1][2] == n * 5000 and {r[0] for r in got} == {"c"}
    assert abs(got[1][1] - 75 * 5000) <= 10 * 5000 and abs(got[1][2] - 125 * 5000) <= 10 * 5000
    # a scorer that gives empty windows more than the threshold keeps contigs whole
    kept = pipelines.corrected_contigs(df, size, score=lambda images, key: images.select(key, F.lit(0.5).alias("prob")))
    assert sorted(tuple(r) for r in kept.collect()) == [("c", 0, n * 5000), ("empty", 0, n * 5000)]
