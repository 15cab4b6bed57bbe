"""Parsing of sample and fragment names.

Intra samples are called contig_pos_C2 or contig_pos_C3, inter samples ctgA:s-e:0|ctgB:s-e:1. Contig
names may hold the separators themselves, so every pattern is anchored at the end of the name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: contig, position and corner of an intra name (lower case)
INTRA = r"^(.*)_([0-9]+)_c([23])$"
#: contig, start, end and side of one end of an inter name
END = r"^(.*):([0-9]+)-([0-9]+):([01])$"
#: contig, start and end of a fragment
FRAGMENT = r"^(.*):([0-9]+)-([0-9]+)$"


def plain(name: Column) -> Column:
    r"""The name in lower case and without any white space."""
    return F.lower(F.regexp_replace(name, r"(?U)\s+", ""))


def is_inter(name: Column) -> Column:
    """Whether a sample name is that of a pair of contig ends."""
    return F.contains(name, F.lit("|"))


def same_name_key(name: Column) -> Column:
    """Equal for names that differ in case, white space and the order of the two ends only."""
    return F.array_join(F.array_sort(F.split(plain(name), r"\|")), "|")


def contigs_of(name: Column) -> Column:
    """The contigs in a name, plain, without position, corner, range and side.

    A null name gives null; a part that fits neither pattern is taken whole.
    """
    strip_end = lambda part: F.when(part.rlike(END), F.regexp_extract(part, END, 1)).otherwise(part)
    whole = plain(name)
    intra = F.when(whole.rlike(INTRA), F.regexp_extract(whole, INTRA, 1)).otherwise(strip_end(whole))
    return F.when(is_inter(whole), F.array_distinct(F.transform(F.split(whole, r"\|"), strip_end))).when(
        whole.isNotNull(), F.array(intra)
    )


def fragment(name: Column) -> Column:
    """chrom, start and end of a fragment name; null where it does not fit."""
    return F.when(
        name.rlike(FRAGMENT),
        F.struct(
            F.regexp_extract(name, FRAGMENT, 1).alias("chrom"),
            F.regexp_extract(name, FRAGMENT, 2).cast("long").alias("start"),
            F.regexp_extract(name, FRAGMENT, 3).cast("long").alias("end"),
        ),
    )
