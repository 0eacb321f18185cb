"""Connected components over an edge table, by repeated minimum propagation and contraction; edges between rows that share a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.runtime import forget, lookup, materialise, rows_of


def shared_key_edges(rows: DataFrame, row: str, keys: list[Column], tag: str = "links") -> DataFrame:
    """``(u, v)``: each row and the least row that has one of its keys; rows that share nothing have no edge.

    A key of n rows costs n edges, never n². Counting is pre-aggregated, and a hot key's rows are spread over all tasks.
    """
    held = materialise(rows.select(F.col(row).cast("long").alias("u"), F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key")), tag)
    per_key = materialise(held.groupBy("key").agg(F.min("u").alias("v"), F.count("*").alias("n")).filter("n > 1"), tag)
    found = lookup(held, per_key, "key", rows_of(held), spread=F.xxhash64("u"))
    edges = materialise(found.filter("v is not null and u <> v").select("u", "v").distinct(), tag)
    forget(held, per_key)
    return edges


def propagate(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """``(u, v)`` pairs of long ids → ``(u, label)`` for every id in a pair, ``label`` being one id of its component.

    Each round every vertex takes the least of itself and its neighbours, in an order given by a hash (so that chains of
    rising ids don't pass on their minimum one step at a time), and the edge table is rewritten between the ids taken.
    The table shrinks by a constant factor a round, so about log(vertices) rounds are needed, and each ends in a written
    table. A hub's edges are spread over all tasks by their known number. Self pairs and repeated pairs are allowed; null
    ends are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u is not null and v is not null")
    cur = materialise(e.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), tag)
    maps: list[DataFrame] = []
    rank = lambda c: F.struct(F.xxhash64(F.col(c)), F.col(c).alias("id"))
    while rows_of(cur):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(rank("v")).alias("m"), F.count("*").alias("n"))
        step = materialise(least.select("u", F.least("m", rank("u")).getField("id").alias("to"), "n"), tag)
        at_u = lookup(cur, step, "u", rows_of(cur), spread=F.xxhash64("v")).select(F.col("to").alias("nu"), F.col("v").alias("u"))
        at_v = lookup(at_u, step, "u", rows_of(cur), spread=F.xxhash64("nu")).filter("nu <> to")
        new = materialise(at_v.select(F.least("nu", "to").alias("u"), F.greatest("nu", "to").alias("v")).distinct(), tag)
        forget(cur)
        cur = new
        maps.append(step)
    final: DataFrame | None = None
    used = list(maps)
    for step in reversed(maps):  # each level is a fraction of the one before it
        moves = step.filter("u <> to").select("u", "to")
        if final is not None:
            ends = moves.groupBy("to").agg(F.count("*").alias("n"))
            later = materialise(final.select(F.col("u").alias("to"), F.col("to").alias("end")).join(ends, "to"), tag)
            moves = lookup(moves, later, "to", rows_of(step), spread=F.xxhash64("u")).select("u", F.coalesce("end", "to").alias("to"))
            final = materialise(final.join(moves.select("u"), "u", "left_anti").unionByName(moves), tag)
            used += [later, final]
        else:
            final = moves
    vertices = e.select(F.explode(F.array("u", "v")).alias("u")).distinct()
    if final is None:
        return materialise(vertices.withColumn("label", F.col("u")), tag)
    out = materialise(vertices.join(final, "u", "left").select("u", F.coalesce("to", "u").alias("label")), tag)
    forget(cur, *used)
    return out
