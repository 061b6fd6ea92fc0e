"""Expanding links between classes of exact copies without squaring large classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of up to this many exact copies are expanded into every pair of members. Larger classes
#: are linked through their representative (the smallest id), so that a text stored a million
#: times costs a million links and not their square; no link between two different texts is lost.
FULL_CLASS = 64


def _whole(n: Column, full_class: int | None) -> Column:
    """Whether a class of ``n`` members is expanded; a null limit expands all."""
    return F.lit(True) if full_class is None else n <= full_class


def expand_links(links: DataFrame, members: DataFrame, full_class: int | None = FULL_CLASS) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of members of linked classes.

    ``links`` has distinct (class_a, class_b); ``members`` has distinct (cls, id). For two classes
    of at most ``full_class`` members all pairs come out; otherwise each member is paired
    with the representative of the other class. A null ``full_class`` expands every class: exact, but the result
    grows with the square of its sizes. Empty inputs give no pairs.
    """
    sizes = members.groupBy("cls").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    a = sizes.select(F.col("cls").alias("class_a"), F.col("n").alias("na"), F.col("rep").alias("ra"))
    b = sizes.select(F.col("cls").alias("class_b"), F.col("n").alias("nb"), F.col("rep").alias("rb"))
    sized = links.join(a, "class_a").join(b, "class_b")
    small = _whole(F.col("na"), full_class) & _whole(F.col("nb"), full_class)
    ma = members.select(F.col("cls").alias("class_a"), F.col("id").alias("x"))
    mb = members.select(F.col("cls").alias("class_b"), F.col("id").alias("y"))
    full = sized.filter(small).join(ma, "class_a").join(mb, "class_b").select("x", "y")
    large = sized.filter(~small)
    left = large.join(ma, "class_a").select("x", F.col("rb").alias("y"))
    right = large.join(mb, "class_b").select(F.col("ra").alias("x"), "y")
    pairs = full.unionByName(left).unionByName(right)
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def copy_links(members: DataFrame, full_class: int | None = FULL_CLASS) -> DataFrame:
    """Pairs (id_a, id_b) inside classes of exact copies: all of a small class, a star of a large one."""
    sizes = members.groupBy("cls").agg(F.count("*").alias("n"), F.min("id").alias("rep")).filter("n > 1")
    m = members.join(sizes, "cls")
    small = m.filter(_whole(F.col("n"), full_class))
    all_pairs = small.select("cls", F.col("id").alias("id_a")).join(members.select("cls", F.col("id").alias("id_b")), "cls").filter("id_a < id_b").select("id_a", "id_b")
    star = m.filter(~_whole(F.col("n"), full_class) & (F.col("id") > F.col("rep"))).select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    return all_pairs.unionByName(star)
