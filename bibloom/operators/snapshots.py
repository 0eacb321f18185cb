"""What changed between full snapshots: compact key and content hashes, compared bucket by bucket in sorted arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibloom.functions import columns as C
from bibloom.operators.components import propagate, shared_key_edges
from bibloom.runtime import forget, lookup, materialise, rows_of

#: Rows of compact arrays (paper, snapshot, two hashes, least row) that a bucket holds on average: 1M x 40 bytes.
ROWS_A_BUCKET = 1 << 20


def _plain(c: Column, kind: T.DataType) -> Column:
    """A cell as text in which null, empty and filler words are the same."""
    if isinstance(kind, T.StringType):
        return F.coalesce(C.no_filler(c), F.lit(""))
    if isinstance(kind, T.StructType):
        return F.concat_ws("\x1f", *[_plain(c.getField(f.name), f.dataType) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(F.transform(c, lambda x: _plain(x, kind.elementType)), "\x1e"), F.lit(""))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("\x1f", e["key"].cast("string"), _plain(e["value"], kind.valueType))), "\x1e"), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def content(df: DataFrame, ignore: tuple[str, ...], normal: dict[str, Column]) -> Column:
    """All columns but ``ignore`` as one text, in name order; ``normal`` gives columns that have a form of their own."""
    cells = [F.coalesce(normal[f.name], F.lit("")) if f.name in normal else _plain(F.col(f"`{f.name}`"), f.dataType) for f in sorted(df.schema.fields, key=lambda f: f.name) if f.name not in ignore]
    return F.concat_ws("\x1d", *cells)


def _papers(compact: DataFrame, tag: str) -> DataFrame:
    """``compact`` with ``paper``, one row number for all rows tied by PMID or DOI, directly or through others.

    Only distinct pairs of the two identifiers, each with its least row, go into the component search. Identifiers are
    compared as they are, no hash stands for them. A pair that holds a large share of all rows is spread over all tasks.
    """
    pairs = materialise(compact.groupBy("ids").agg(F.min("row").alias("least"), F.count("*").alias("n"), F.first("pmid_k").alias("pmid_k"), F.first("doi_k").alias("doi_k")), tag)
    edges = shared_key_edges(pairs, "least", [F.concat(F.lit("p"), "pmid_k"), F.concat(F.lit("d"), "doi_k")], tag)
    labels = propagate(edges, tag)
    named = materialise(pairs.join(labels.withColumnRenamed("u", "least"), "least", "left").select("ids", "n", F.coalesce("label", "least").alias("paper")), tag)
    forget(pairs, edges, labels)
    return lookup(compact, named, "ids", rows_of(compact), spread=F.xxhash64("row"))


_CHANGES = "change_type string, row_id long, snapshot_no long, old_row_id long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a bucket as arrays; per pair of snapshots, set differences by searchsorted on the sorted papers."""
    cols = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(5)] for b in batches]
    if not cols:
        return
    key, snap, one, two, row = (np.concatenate([c[i] for c in cols]) for i in range(5))
    numbers = np.unique(snap)
    at: dict[int, tuple[np.ndarray, ...]] = {}
    for s in numbers:
        m = np.flatnonzero(snap == s)
        m = m[np.argsort(key[m], kind="stable")]
        at[int(s)] = key[m], one[m], two[m], row[m]
    none = (np.array([], dtype=np.int64),) * 4
    lo, hi = (int(numbers.min()), int(numbers.max())) if len(numbers) else (0, -1)
    for s in range(lo, hi + 2):
        ka, a1, a2, ra = at.get(s - 1, none)
        kb, b1, b2, rb = at.get(s, none)
        pos = np.searchsorted(ka, kb)
        hit = pos < len(ka)
        hit[hit] = ka[pos[hit]] == kb[hit]
        gone = np.ones(len(ka), dtype=bool)
        gone[pos[hit]] = False
        differ = np.zeros(len(kb), dtype=bool)
        differ[hit] = (a1[pos[hit]] != b1[hit]) | (a2[pos[hit]] != b2[hit])
        for kind, rows, old in (("added", rb[~hit], None), ("changed", rb[differ], ra[pos[differ]]), ("removed", ra[gone], ra[gone])):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.string()), pa.array(rows, pa.int64()), pa.array(np.full(len(rows), s, dtype=np.int64)), pa.nulls(len(rows), pa.int64()) if old is None else pa.array(old, pa.int64())], names=["change_type", "row_id", "snapshot_no", "old_row_id"])


def diff_snapshots(df: DataFrame, row: str = "row_id", snapshot: str = "snapshot_no", ignore: tuple[str, ...] = ("delivered_at",), rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """``(change_type, row_id, snapshot_no, old_row_id)`` for every snapshot against the one before.

    A paper is all rows tied by PMID or DOI; it has changed if the set of its rows' contents has, which is told by 128
    bits of hash. ``row_id`` is its least row in that snapshot, ``old_row_id`` in the one before, and both are the earlier
    one where it was removed. Rows without either identifier take no part. Papers are hashed to as many buckets as hold
    ``rows_a_bucket`` rows each, at least one for each shuffle partition. Repeated rows, null and filler cells and further
    columns are fine (further columns count as content); an empty table gives no rows. The first and the last snapshot
    bound the comparison: nothing is "added" in the first or "removed" after the last.
    """
    base = df.withColumns({"pmid_k": C.pmid_key(F.col("pmid")), "doi_k": C.doi_key(F.col("doi"))}).filter("pmid_k is not null or doi_k is not null")
    text = content(df, (row, snapshot, *ignore), {"pmid": F.col("pmid_k"), "doi": F.col("doi_k")})
    ids = F.concat_ws("\x1f", F.coalesce("pmid_k", F.lit("")), F.coalesce("doi_k", F.lit("")))
    with_text = base.select(F.col(row).cast("long").alias("row"), F.col(snapshot).cast("long").alias("snap"), text.alias("text"), ids.alias("ids"), "pmid_k", "doi_k")
    compact = materialise(with_text.select("row", "snap", F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two"), "ids", "pmid_k", "doi_k"), "snap")
    bounds = compact.agg(F.min("snap").alias("lo"), F.max("snap").alias("hi")).first()
    if bounds["lo"] is None:
        return df.sparkSession.createDataFrame([], _CHANGES)
    contents = _papers(compact, "snap").groupBy("paper", "snap", "one", "two").agg(F.min("row").alias("row"))
    mixed = [F.bit_xor(F.xxhash64(F.lit(i), "one", "two")).alias(f"x{i}") for i in (1, 2)]
    sets = contents.groupBy("paper", "snap").agg(*mixed, F.count("*").alias("n"), F.min("row").alias("row"))
    flat = sets.select("paper", "snap", *[F.xxhash64(f"x{i}", "n").alias(f"x{i}") for i in (1, 2)], "row")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows_of(compact) // rows_a_bucket))
    out = flat.repartition(parts, F.col("paper")).mapInArrow(_compare, _CHANGES)
    return out.filter((F.col("snapshot_no") > bounds["lo"]) & (F.col("snapshot_no") <= bounds["hi"]))


def changed_values(df: DataFrame, changes: DataFrame, columns: tuple[str, ...], row: str = "row_id") -> DataFrame:
    """``changes`` with the new and the old values of ``columns``: only the differing papers' rows are fetched. New values of a removed paper and old ones of an added one are null."""
    values = lambda c, prefix: df.select(F.col(row).cast("long").alias(c), *[F.col(x).alias(f"{prefix}{x}") for x in columns])
    found = changes.withColumn("_new", F.when(F.col("change_type") != "removed", F.col("row_id")))
    return found.join(values("_new", ""), "_new", "left").join(values("old_row_id", "old_"), "old_row_id", "left").drop("_new")
