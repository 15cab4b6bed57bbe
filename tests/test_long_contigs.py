"""Queries over contigs whose lengths go beyond 32 bits."""

import random

import pytest

from contactloom.operators import simulate
from contactloom.plans import catalog

ROWS = [("long", 5_000_000_000), ("long2", 5_000_000_000), ("short", 600_000), ("short", 500_000), ("none", None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(ROWS, "chrom string, length long").write.parquet(str(path / "chrom_sizes.parquet"))
    return str(path)


def test_chimeras_reach_long_contigs(spark, folder):
    made = catalog.queries()["simulate_chimeras"](spark, folder)
    assert made.where("chrom1 like 'long%' or chrom2 like 'long%'").agg({"start1": "max"}).first()[0] > 2**32
    assert catalog.queries()["simulated_breakpoints"](spark, folder).count() > 100


def test_pieces_of_long_contigs(spark, folder):
    got = {r.chrom: r["count"] for r in catalog.queries()["sub_positions_all"](spark, folder).groupBy("chrom").count().collect()}
    assert got == {"long": 10_000, "long2": 10_000, "short": 1}


def all_joined(made, lengths, half, least, most):
    """No piece is used twice in a round, every pair is allowed, and no two pieces that are left could be joined."""
    ok = lambda a, b: a[0] != b[0] or max(least, 1) <= abs(a[1] - b[1]) <= most
    assert len({r.name for r in made}) == len(made)
    for k in {r.round for r in made}:
        pairs = [((r.chrom1, r.start1), (r.chrom2, r.start2)) for r in made if r.round == k]
        used = [p for pair in pairs for p in pair]
        assert len(used) == len(set(used)) and all(ok(a, b) for a, b in pairs)
        left = sorted({(c, s) for c, n in lengths.items() for s in range(0, n - half + 1, half)} - set(used))
        assert not any(ok(a, b) for i, a in enumerate(left) for b in left[i + 1 :])


@pytest.mark.parametrize("few", [0, 20, 20_000])
def test_chimeras_leave_no_pair(spark, monkeypatch, few):
    monkeypatch.setattr(simulate, "FEW", few)
    lengths = {"a": 2_000, "b": 130, "c": 60, "d": 5}
    df = spark.createDataFrame([*lengths.items()], "chrom string, length long")
    all_joined(simulate.chimeras(df, 10, 2, 20, 300).collect(), lengths, 10, 20, 300)


def test_last_pairs():
    rng = random.Random(1)
    for _ in range(200):
        pieces = {(rng.choice("aaab"[rng.randrange(4) :]), rng.randrange(40)) for _ in range(rng.randrange(25))}
        least, most = rng.randrange(6), rng.randrange(5, 20)
        pairs = simulate.last_pairs(list(pieces), least, most)
        ok = lambda a, b: a[0] != b[0] or max(least, 1) <= abs(a[1] - b[1]) <= most  # noqa: B023, E731
        used = [p for pair in pairs for p in pair]
        left = sorted(pieces - set(used))
        assert len(used) == len(set(used)) and set(used) <= pieces and all(ok(a, b) for a, b in pairs)
        assert not any(ok(a, b) for i, a in enumerate(left) for b in left[i + 1 :])
