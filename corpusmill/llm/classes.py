"""All pairs of the members of classes, whatever the classes' size. A large class is dealt into cells of about ``BLOCK`` members and every two
cells meet under a key of their own, so that no task has a hot class to itself; what is joined is in proportion to what comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BLOCK = 200


def _hot(members: DataFrame, block: int) -> DataFrame:
    """(cls, cells) of the classes that are dealt into more than one cell."""
    n = members.groupBy("cls").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    return n.select("cls", F.ceil(F.col("n") / block).cast("int").alias("cells"))


def _each(cells: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(cells, F.lit(1)) - 1))


def _celled(members: DataFrame, hot: DataFrame) -> DataFrame:
    """``members`` with ``cells`` and their own ``cell``."""
    own = members.join(hot, "cls", "left")
    return own.withColumn("cell", F.pmod(F.xxhash64("member"), F.coalesce("cells", F.lit(1))).cast("int"))


def inside(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: every two members of a class of the distinct rows ``members(cls, member)``."""
    own = _celled(members, _hot(members, block))
    a = own.select("cls", F.col("member").alias("a"), F.col("cell").alias("i"), _each("cells").alias("j"))
    b = own.select("cls", F.col("member").alias("b"), F.col("cell").alias("j"), _each("cells").alias("i"))
    return a.join(b, ["cls", "i", "j"]).filter("a < b").select("a", "b")


def between(links: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(x, y): for each of the ``links(a, b)`` between classes every member x of class a with every member y of class b."""
    hot = _hot(members, block)
    own = _celled(members, hot)
    for side in ("a", "b"):
        links = links.join(hot.select(F.col("cls").alias(side), F.col("cells").alias(f"{side}_cells")), side, "left")
    dealt = links.select("a", "b", "b_cells", _each("a_cells").alias("i")).select("a", "b", "i", _each("b_cells").alias("j"))
    x = own.select(F.col("cls").alias("a"), F.col("cell").alias("i"), F.col("member").alias("x"))
    y = own.select(F.col("cls").alias("b"), F.col("cell").alias("j"), F.col("member").alias("y"))
    return dealt.join(x, ["a", "i"]).join(y, ["b", "j"]).select("x", "y")
