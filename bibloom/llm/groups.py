"""Pairwise links into groups: the giant component is peeled off breadth first, the rest labelled by minimum propagation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.operators.components import propagate, shared_key_edges
from bibloom.runtime import forget, lookup, materialise, rows_of, together

#: Frontiers are followed for this many rounds times log2(vertices). A giant component of chance links is log(vertices)
#: deep; what is deeper is a chain, in which each further round would add a few vertices only.
DEPTH = 8


def group_links(edges: DataFrame, tag: str = "groups") -> DataFrame:
    """``(u, label)`` for every id of an edge; label is the least id of its component.

    1. From the vertex of the highest degree, frontiers are joined with the edges until nothing new is reached: that is
       the giant component. A level's neighbours are on the level before, the same or the next one, so a round looks at
       two levels only, and neither its plan nor its cost grows with the rounds before it. Edges carry the degrees of
       their ends; those of vertices of very high degree are spread over all tasks.
    2. Its vertices are anti-joined away. Should it be deeper than DEPTH rounds times log2(vertices), what was reached
       becomes one vertex of the rest, so that a chain of any length comes out whole.
    3. The remaining components are labelled by minimum propagation.
    Ids that occur only in pairs with themselves form a group of one. An empty input gives an empty result.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u is not null and v is not null")
    ways = materialise(e.filter("u <> v").unionByName(e.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), tag)
    alone = e.filter("u = v").select("u").distinct()
    degrees = materialise(ways.groupBy("u").agg(F.count("*").alias("n")), tag)
    top = degrees.agg(F.max_by("u", F.struct("n", -F.col("u"))).alias("u"), F.max("n").alias("n")).first()
    if top["u"] is None:
        return alone.select("u", F.col("u").alias("label"))
    total = rows_of(ways)
    both = materialise(lookup(ways, degrees.select(F.col("u").alias("v"), "n", F.col("n").alias("nv")), "v", total, spread=F.xxhash64("u")), tag)
    forget(ways)
    spark = edges.sparkSession
    levels = [materialise(spark.createDataFrame([(top["u"], top["n"])], "u long, n long").withColumn("on", F.lit(True)), tag)]
    for _ in range(math.ceil(DEPTH * math.log2(rows_of(degrees) + 1))):
        near = lookup(both, levels[-1], "u", total, spread=F.xxhash64("v")).filter("on").select(F.col("v").alias("u"), F.col("nv").alias("n")).distinct()
        fresh = materialise(near.join(together(levels[-2:]).select("u"), "u", "left_anti").withColumn("on", F.lit(True)), tag)
        if not rows_of(fresh):
            break
        levels.append(fresh)
    reached = together(levels)
    reached._bibloom_top = top["n"]
    outside = lookup(both.select("u", "v"), reached, "u", total, spread=F.xxhash64("v")).filter("on is null").select("u", "v")
    if rows_of(fresh):
        mark = reached.select(F.col("u").alias("v"), "n", F.lit(top["u"]).alias("to"))
        mark._bibloom_top = top["n"]
        outside = lookup(outside, mark, "v", total, spread=F.xxhash64("u")).select("u", F.coalesce("to", "v").alias("v"))
    else:
        outside = outside.filter("u < v")
    small = propagate(outside, tag)
    merged = small.filter(F.col("u") == top["u"]).select("label").first() if rows_of(fresh) else None
    giant = merged["label"] if merged else top["u"]
    labels = materialise(small.filter(F.col("u") != top["u"]).unionByName(reached.select("u", F.lit(giant).cast("long").alias("label"))), tag)
    least = materialise(labels.groupBy("label").agg(F.min("u").alias("least"), F.count("*").alias("n")), tag)
    out = lookup(labels, least, "label", rows_of(labels), spread=F.xxhash64("u")).select("u", F.col("least").alias("label"))
    forget(both, degrees, *levels, small)
    return out.unionByName(alone.join(labels.select("u"), "u", "left_anti").select("u", F.col("u").alias("label")))


def row_groups(rows: DataFrame, row: str, keys: list[Column]) -> DataFrame:
    """``(group_id, row_id)`` of every row in a group of two or more that share a key directly or through others.

    Null keys link nothing; rows without any key are in no group. Rows are told apart by ``row``, which must be unique.
    """
    found = group_links(shared_key_edges(rows, row, keys))
    return found.select(F.col("label").alias("group_id"), F.col("u").alias("row_id"))
