"""Splits that keep related records together."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.functions import names
from contactloom.operators.pairing import paired
from contactloom.operators.ranking import buckets_for, hash_bucket, with_rank
from contactloom.session import cut


def node(grp: Column, sample_id: Column) -> Column:
    """The node of a record: even for its group, odd for a record without one. Ids must lie within 62 bits."""
    return F.coalesce(F.shiftleft(grp, 1), F.shiftleft(sample_id, 1) + 1)


def original_contigs(used: DataFrame, name_table: DataFrame) -> DataFrame:
    """(contig, origin): for each name in used that name_table renames, all names it goes back to.

    Names are compared plain. From new to old as far as it goes; a joined contig goes back to several.
    Names that only lead round in circles go back to the least name of all that hang together with theirs.

    Pointers double: every round joins the names that a name has reached with what these have reached, so a
    chain of n names takes log2(n) rounds. After as many rounds as the table can need, whatever still
    goes on leads round in a circle.
    """
    table = cut(
        name_table.select(names.plain(F.col("new")).alias("new"), names.plain(F.col("old")).alias("old"))
        .where("new is not null and old is not null and new <> old")
        .distinct()
    )
    renamed = cut(table.select(F.col("new").alias("at")).distinct().withColumn("_goes_on", F.lit(True)))
    longest = max(renamed.count(), 1)
    # (new, at, goes on): what each name has reached; as long as it goes on, it is 2^k steps away
    reached = cut(table.withColumnRenamed("old", "at").join(renamed, "at", "left").select("new", "at", "_goes_on"))
    for _ in range(longest.bit_length()):
        further = reached.where("_goes_on")
        if further.isEmpty():
            break
        following = further.select("new", F.col("at").alias("_by")).join(reached.select(F.col("new").alias("_by"), "at", "_goes_on"), "_by")
        reached = cut(reached.where("_goes_on is null").union(following.select("new", "at", "_goes_on")).distinct())
    ends = reached.where("_goes_on is null").select("new", F.col("at").alias("origin"))
    lost = renamed.select(F.col("at").alias("new")).join(ends, "new", "left_anti")
    if not lost.isEmpty():
        # all their old names are lost as well
        lines = table.join(lost, "new").select("new", "old")
        number = lambda c: F.shiftrightunsigned(F.xxhash64(c), 1)
        circles = components(lines.select(number("new").alias("node"), number("old").alias("low")))
        known = lines.select("new").union(lines.select("old")).distinct().select(F.col("new"), number("new").alias("node")).join(circles, "node")
        ends = ends.union(known.join(known.groupBy("component").agg(F.min("new").alias("origin")), "component").select("new", "origin"))
    return used.select("contig").join(ends.withColumnRenamed("new", "contig"), "contig").distinct()


def ties(images: DataFrame, name_table: DataFrame) -> DataFrame:
    """(node, low): each node with the least node it shares an original contig with, once per contig."""
    contigs = (
        images.where(F.col("name").isNotNull())
        .select(node(F.col("grp"), F.col("sample_id")).alias("node"), F.explode(names.contigs_of(F.col("name"))).alias("contig"))
        .distinct()
    )
    contigs = cut(contigs)
    origins = original_contigs(contigs.select("contig").distinct(), name_table)
    shared = contigs.join(origins, "contig", "left").select("node", F.coalesce("origin", "contig").alias("origin")).distinct()
    least = shared.groupBy("origin").agg(F.min("node").alias("low"))
    return shared.join(least, "origin").select("node", "low").distinct()


#: A node with more neighbours than this takes part in no shuffle with them; there are at most 2 / HUB_SHARE such nodes.
HUB, HUB_SHARE = 50_000, 1e-5


def _with_least(edges: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """edges (hi, lo) with the column m of least (hi, m, n); the m of nodes with more than `limit` edges is broadcast."""
    hubs = least.where(F.col("n") > limit).select("hi", "m")
    if hubs.isEmpty():
        return edges.join(least.select("hi", "m"), "hi")
    others = edges.join(F.broadcast(hubs.select("hi")), "hi", "left_anti").join(least.where(F.col("n") <= limit).select("hi", "m"), "hi")
    return edges.join(F.broadcast(hubs), "hi").unionByName(others)


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(node, component): connected components; component is the least node. Nodes without an edge are missing.

    Large-star and small-star steps in turn until nothing changes: every step ties each node to the
    least of its neighbours, which is counted before rows move. The edges of a node with very many
    neighbours stay where they are and meet its least one there. Each round is written to the checkpoint folder.
    """
    now = cut(edges.select(F.greatest("node", "low").alias("hi"), F.least("node", "low").alias("lo")).where("hi <> lo").distinct())
    state, limit = None, max(hub, int(now.count() * HUB_SHARE))
    while True:
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = cut(both.groupBy("hi").agg(F.least(F.min("lo"), F.min("hi")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = cut(_with_least(both, least, limit).where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct())
        lowest = cut(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n")))
        joined = _with_least(large, lowest, limit)
        now = cut(
            joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(lowest.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def tied_pairs(groups: DataFrame, together: list[str]) -> DataFrame:
    """(grp_a, grp_b), grp_a < grp_b: all pairs of groups (together, grp) that are together; no component is one task."""
    groups = groups.select(*together, "grp").distinct()
    pairs = paired(groups.withColumnRenamed("grp", "grp_a"), groups.withColumnRenamed("grp", "grp_b"), together)
    return pairs.where("grp_a < grp_b").select("grp_a", "grp_b")


def tied_groups(images: DataFrame, name_table: DataFrame) -> DataFrame:
    """(grp_a, grp_b), grp_a < grp_b: all pairs of groups that must land in one split."""
    found = components(ties(images, name_table)).where(F.col("node").bitwiseAND(F.lit(1).cast("long")) == 0)
    return tied_pairs(found.select("component", F.shiftright("node", 1).alias("grp")), ["component"])


def tied_components(images: DataFrame, name_table: DataFrame) -> DataFrame:
    """(component, groups, lone_records, pairs): the components of several nodes, with the number of pairs of groups they make.

    component is the least node (see node). No pair is listed.
    """
    found = components(ties(images, name_table))
    is_group = F.col("node").bitwiseAND(F.lit(1).cast("long")) == 0
    counted = found.groupBy("component").agg(F.count_if(is_group).alias("groups"), F.count_if(~is_group).alias("lone_records"))
    return counted.withColumn("pairs", F.expr("groups * (groups - 1) div 2"))


def differencing(vectors: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Largest differencing of (tuples, bins, 2) weights into bins; gives the bin of each (tuple, slot).

    The two tuples whose bins differ most are combined again and again, the heaviest bin of the one with
    the lightest of the other. Weights are compared by the sum of both columns divided by scale.
    """
    n, bins, _ = vectors.shape
    weight = vectors @ (1 / np.maximum(scale, 1e-9))
    heap, parts = [], {}
    for i in range(n):
        order = np.argsort(weight[i], kind="stable")
        parts[i] = (weight[i][order], [(i, order)])
        heapq.heappush(heap, (-(weight[i].max() - weight[i].min()), i))
    slots = np.tile(np.arange(bins), (n, 1))
    following = n
    tree: dict[int, tuple] = {}
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        wa, wb = parts.pop(a)[0], parts.pop(b)[0]
        total = wa + wb[::-1]
        order = np.argsort(total, kind="stable")
        tree[following] = (a, b, order)
        parts[following] = (total[order], [])
        heapq.heappush(heap, (-(total[order][-1] - total[order][0]), following))
        following += 1
    # back down: which bin each sorted place of a node belongs to
    stack = [(heap[0][1], np.arange(bins))] if heap else []
    while stack:
        at, places = stack.pop()
        if at < n:
            slots[at][np.argsort(weight[at], kind="stable")] = places
        else:
            a, b, order = tree[at]
            unsorted = np.empty(bins, int)
            unsorted[order] = places
            stack += [(a, unsorted), (b, unsorted[::-1])]
    return slots


def balanced_bins(weights: DataFrame, bins: int = 64, tuples_per_task: int = 5_000, rows_per_bucket: int = 50_000) -> DataFrame:
    """(component, bin): components, with weights (component, w0, w1), in bins of nearly equal weight.

    Components in which y = 0 prevails and those in which y = 1 does are balanced apart, into `bins`
    bins each, so that splits can be filled for both. Components ranked by weight make tuples of one
    component per bin. A tuple of equal components adds the same to every bin and needs no choice.
    There are at most as many other tuples as different weights, whose number grows far slower than
    the rows (with N rows less than (3N)^(2/3)); these are balanced by largest differencing, in tasks
    of bounded size, whose results are balanced once more.
    """
    weights = cut(weights.withColumn("side", F.when(F.col("w1") > F.col("w0"), 1).otherwise(0)))
    total = weights.agg(F.count(F.lit(1)), F.sum("w0"), F.sum("w1")).first()
    rows, scale = total[0], np.array([float(total[1] or 0), float(total[2] or 0)])
    kinds = weights.groupBy("side", "w0", "w1").agg(F.count(F.lit(1)).alias("_n"))
    heavier = Window.partitionBy("side").orderBy(F.desc(F.col("w0") + F.col("w1")), F.desc("w0")).rowsBetween(Window.unboundedPreceding, -1)
    starts = kinds.withColumn("_start", F.coalesce(F.sum("_n").over(heavier), F.lit(0).cast("long")))
    hashed = weights.withColumn("_hash", F.xxhash64("component")).withColumn(
        "_bucket", hash_bucket(F.col("_hash"), buckets_for(rows, rows_per_bucket))
    )
    ranked = with_rank(hashed, ["side", "w0", "w1"], "_bucket", [F.col("_hash"), F.col("component")]).join(starts, ["side", "w0", "w1"])
    placed = cut(
        ranked.withColumn("_at", F.col("_start") + F.col("rank") - 1)
        .withColumn("tuple", F.floor(F.col("_at") / bins))
        .withColumn("slot", (F.col("_at") % bins).cast("int"))
        .withColumn("even", (F.col("_start") <= F.col("tuple") * bins) & (F.col("_start") + F.col("_n") >= (F.col("tuple") + 1) * bins))
        .select("component", "side", "w0", "w1", "tuple", "slot", "even")
    )

    def balance(rows: pd.DataFrame) -> pd.DataFrame:
        at, ids = pd.factorize(rows["tuple"])
        vectors = np.zeros((len(ids), bins, 2))
        vectors[at, rows["slot"], 0] = rows["w0"]
        vectors[at, rows["slot"], 1] = rows["w1"]
        return rows.assign(bin=differencing(vectors, scale)[at, rows["slot"]].astype("int32"))

    schema = "side int, part int, tuple long, slot int, w0 long, w1 long, bin int"
    uneven = placed.where("not even").select("side", "tuple", "slot", "w0", "w1")
    parts = buckets_for(uneven.select("side", "tuple").distinct().count(), tuples_per_task)
    part = F.pmod(F.xxhash64("tuple"), F.lit(parts)).cast("int")
    first = cut(uneven.select("side", part.alias("part"), "tuple", "slot", "w0", "w1").groupBy("side", "part").applyInPandas(balance, schema))
    # the bins of each part are tuples of the second stage
    merged = (
        first.groupBy("side", "part", "bin").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
        .select("side", F.lit(0).alias("part"), F.col("part").cast("long").alias("tuple"), F.col("bin").alias("slot"), "w0", "w1")
        .groupBy("side").applyInPandas(balance, schema)
        .select("side", F.col("tuple").cast("int").alias("part"), F.col("slot").alias("bin"), F.col("bin").alias("final"))
    )
    chosen = first.select("side", "part", "tuple", "slot", "bin").join(merged, ["side", "part", "bin"]).select("side", "tuple", "slot", "final")
    return placed.join(chosen, ["side", "tuple", "slot"], "left").select(
        "component", (F.coalesce("final", "slot") * 2 + F.col("side")).alias("bin")
    )


def allocate(bins: list[tuple[int, float, float]], shares: list[tuple[str, float]]) -> dict[int, str]:
    """The split of each (bin, w0, w1): whole bins, so that each split is near its share of both weights."""
    weight = np.array([[b[1], b[2]] for b in bins], float).reshape(-1, 2)
    total = np.maximum(weight.sum(0), 1)
    part = np.column_stack([weight / total, weight.sum(1) / total.sum()])
    want = np.array([s for _, s in shares])[:, None] / max(sum(s for _, s in shares), 1e-9)
    got = np.zeros((len(shares), 3))
    split = np.zeros(len(bins), int)
    for i in np.argsort(-part.sum(1), kind="stable"):
        # where it overfills least, then where most is missing
        over = np.maximum(got + part[i] - want, 0).sum(1) - np.maximum(got - want, 0).sum(1)
        missing = (got - want).sum(1) / np.maximum(want[:, 0], 1e-9)
        split[i] = np.lexsort((missing, over))[0]
        got[split[i]] += part[i]
    # then single bins move, and pairs change places, as long as it helps; a small split's error counts as its share
    error = lambda g: (((g - want[:, None, :]) ** 2) / np.maximum(want[:, None, :], 1e-9)).sum((0, 2))
    best, changed = error(got[:, None, :])[0], True
    while changed:
        changed = False
        for i in range(len(bins)):
            for s in range(len(shares)):
                old = split[i]
                if s == old:
                    continue
                others = np.r_[-1, np.flatnonzero(split == s)]
                moved = part[i] - np.where(others[:, None] < 0, 0, part[others])
                after = np.repeat(got[:, None, :], len(others), 1)
                after[old] -= moved
                after[s] += moved
                errors = error(after)
                k = int(errors.argmin())
                if errors[k] < best - 1e-12:
                    if others[k] >= 0:
                        split[others[k]] = old
                    split[i], got, best, changed = s, after[:, k], errors[k], True
    return {b[0]: shares[s][0] for b, s in zip(bins, split)}


def grouped_splits(images: DataFrame, name_table: DataFrame, targets: DataFrame, bins: int = 64) -> DataFrame:
    """(scheme, sample_id, grp, y, component, split): new splits of all records for each scheme of targets.

    All records of a group, and of groups that go back to a common original contig, directly or by a
    chain of records, are one component and land in one split. Components are balanced into `bins` bins
    of nearly equal weight, whole bins go to the splits of a scheme by its shares. y = 0 and y = 1 weigh
    alike; records with another y weigh nothing but are placed.

    Repeated rows (by sample_id) count once. A record without group and name is a component of its own.
    No record is left out. Targets with null split or share are ignored; empty tables give no rows.
    """
    labels = cut(components(ties(images, name_table)))
    records = images.groupBy("sample_id").agg(F.max("grp").alias("grp"), F.max("y").alias("y"))
    named = (
        records.withColumn("node", node(F.col("grp"), F.col("sample_id")))
        .join(labels, "node", "left")
        .select("sample_id", "grp", "y", F.coalesce("component", "node").alias("component"))
    )
    named = cut(named)
    weights = named.groupBy("component").agg(
        F.count_if(F.col("y") == 0).alias("w0"), F.count_if(F.col("y") == 1).alias("w1")
    )
    chosen = cut(balanced_bins(weights, bins))
    placed = named.join(chosen, "component")
    # as many rows as bins and as wanted splits: bounded by parameters
    filled = [(r.bin, r.w0, r.w1) for r in placed.groupBy("bin").agg(F.count_if(F.col("y") == 0).alias("w0"), F.count_if(F.col("y") == 1).alias("w1")).orderBy("bin").collect()]
    wanted: dict[str, list[tuple[str, float]]] = {}
    for r in targets.where("split is not null and share is not null").dropDuplicates(["scheme", "split"]).orderBy("scheme", F.desc("share"), "split").collect():
        wanted.setdefault(r.scheme, []).append((r.split, r.share))
    rows = [(scheme, int(b), s) for scheme, shares in wanted.items() for b, s in allocate(filled, shares).items()]
    where = images.sparkSession.createDataFrame(rows, "scheme string, bin int, split string")
    return placed.join(F.broadcast(where), "bin").select("scheme", "sample_id", "grp", "y", "component", "split")


def placed_pairs(splits: DataFrame) -> DataFrame:
    """(grp_a, grp_b), grp_a < grp_b: pairs of different groups of one component, as grouped_splits placed them.

    A pair is given if both groups are in the same split of every scheme, which no other result of grouped_splits can be.
    """
    places = F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "scheme", "split"))), "|").alias("places")
    groups = splits.where("grp is not null").groupBy("component", "grp").agg(places)
    return tied_pairs(groups, ["component", "places"])


def split_balance(images: DataFrame, name_table: DataFrame, targets: DataFrame, bins: int = 64) -> DataFrame:
    """Per scheme and split: the wanted share and the shares of records, of y = 0 and of y = 1 reached."""
    made = grouped_splits(images, name_table, targets, bins).groupBy("scheme", "split").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")
    )
    scheme = Window.partitionBy("scheme")
    of = lambda c: F.coalesce(F.try_divide(F.coalesce(c, F.lit(0)), F.sum(c).over(scheme)), F.lit(0.0))
    return targets.select("scheme", "split", "share").dropDuplicates(["scheme", "split"]).join(made, ["scheme", "split"], "left").select(
        "scheme", "split", "share", F.coalesce("records", F.lit(0)).alias("records"),
        of("records").alias("got"), of("n0").alias("got_0"), of("n1").alias("got_1"),
    )
