"""Pairs within a key, however many rows it has."""

from collections import Counter

import pytest

from contactloom.operators.pairing import paired


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_same_rows_as_a_join(spark, most):
    one = [(i, "hot" if i % 3 else ["a", "b", None][i % 9 // 3], 1) for i in range(90)] + [(0, "a", 1)]
    two = [(i, ["hot", "b", None, "c"][i % 4], 2) for i in range(30)]
    left, right = (spark.createDataFrame(rows, f"{n} long, k string, _s{n} int") for n, rows in (("x", one), ("y", two)))
    got = Counter((r.x, r.y, r.k) for r in paired(left, right, ["k"], most).collect())
    assert got == Counter((a[0], b[0], a[1]) for a in one for b in two if a[1] is not None and a[1] == b[1])
    assert paired(left.limit(0), right, ["k"], most).count() == 0
