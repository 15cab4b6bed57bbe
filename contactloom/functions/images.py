"""Dense arrays from sparse cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def both_mirrors(r: str, c: str) -> Column:
    """The places (r, c) and (c, r) of a cell, the same one once."""
    place = lambda a, b: F.struct(F.col(a).alias("r"), F.col(b).alias("c"))
    return F.when(F.col(r) == F.col(c), F.array(place(r, c))).otherwise(F.array(place(r, c), place(c, r)))


def sorted_cells(index: Column, value: Column) -> Column:
    """Aggregate: the cells of a group (each index once) in order; input of dense."""
    return F.array_sort(F.collect_list(F.struct(index.cast("int").alias("i"), value.cast("long").alias("v"))))


def dense(cells: str, size: int) -> Column:
    """An array of `size` values from a column of sorted cells, 0 where there is none.

    Runs of zeros are put between the cells, so the work is linear in the array.
    """
    zero = F.lit(0).cast("long")
    before = lambda k: F.coalesce(F.get(F.col(cells), k - 1)["i"], F.lit(-1))
    run = lambda cell, k: F.concat(F.array_repeat(zero, cell["i"] - before(k) - 1), F.array(cell["v"]))
    return F.concat(F.flatten(F.transform(cells, run)), F.array_repeat(zero, F.lit(size - 1) - F.element_at(F.col(cells), -1)["i"]))
