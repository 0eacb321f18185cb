"""Copies that differ in form only: rolling hashes over folded code points, and a two-pointer check of what collides."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm import folding
from bibloom.runtime import lookup, materialise, rows_of

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CUT = re.compile(r"\s*(?:\|\|?|｜+|=|＝|;|；|/|／)\s*")
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿\U00020000-\U0003134F]")
_LATIN = re.compile(r"[A-Za-zＡ-Ｚａ-ｚ]")
#: Least ideographs of a Chinese form and least Latin letters of an English one; the latter may hold a few ideographs, as in （下）.
MIN_HAN, MIN_LATIN, MAX_HAN_IN_LATIN = 4, 12, 2


def form_cut(text: str) -> int:
    """Where an English form that stands before a Chinese one ends, or 0: then the order is as it stands.

    Of the separators (| = ; / and their wide or double forms) the one is taken that best parts Latin letters from
    ideographs.
    """
    han = len(_HAN.findall(text))
    latin = len(_LATIN.findall(text))
    if han < MIN_HAN or latin < MIN_LATIN:
        return 0
    best, at = 0, 0
    for m in _CUT.finditer(text):
        lh, ll = len(_HAN.findall(text, 0, m.start())), len(_LATIN.findall(text, 0, m.start()))
        for zh, en, han_in_en, cut in ((lh, latin - ll, han - lh, 0), (han - lh, ll, lh, m.end())):
            if zh >= MIN_HAN and en >= MIN_LATIN and han_in_en <= MAX_HAN_IN_LATIN and zh + en > best:
                best, at = zh + en, cut
    return at


@functools.cache
def _powers(n: int) -> np.ndarray:
    out = np.ones((2, n), dtype=np.uint64)
    for k, b in enumerate(_BASES):
        out[k, 1:] = np.cumprod(np.full(n - 1, b | 1, dtype=np.uint64), dtype=np.uint64)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling_hashes(texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2, n) polynomial hashes of the texts' folded code points, each begun with its seed, and the number hashed.

    No canonical text is made: a skipped code point adds nothing, and where an English form stands first the exponents,
    not the characters, change places.
    """
    n = len(texts)
    f, at, texts = folding.fold(texts)
    row = np.repeat(np.arange(n), np.diff(at))
    cut = np.fromiter(map(form_cut, texts), dtype=np.int64, count=n)
    kept = f != folding.SKIP
    before = np.concatenate([[0], np.cumsum(kept)])
    start, end, mid = before[at[:-1]], before[at[1:]], before[at[:-1] + cut]
    k, r = f[kept].astype(np.uint64), row[kept]
    at_kept = np.arange(len(k))
    pos = at_kept - start[r] + np.where(at_kept < mid[r], end[r] - mid[r], start[r] - mid[r]) * (cut[r] > 0)
    size = 1 << max(8, int(pos.max(initial=0) + 2).bit_length())
    p = _powers(size)
    out = np.zeros((2, n), dtype=np.uint64)
    length = end - start
    some = np.flatnonzero(length > 0)
    with np.errstate(over="ignore"):
        value = _mix(k * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
        for i in range(2):
            if len(some):
                out[i, some] = np.add.reduceat(value * p[i][pos + 1], start[some])
            out[i] = _mix(out[i] + _mix(seeds.astype(np.uint64) * np.uint64(2) + np.uint64(i)))
    return out, length


def _stream(text: str, folded: np.ndarray) -> Iterator[int]:
    cut = form_cut(text)
    for i in (*range(cut, len(text)), *range(cut)):
        if folded[i] != folding.SKIP:
            yield int(folded[i])


def same_form(a: str, b: str) -> bool:
    """Whether two texts have the same letters, digits and ideographs, by two pointers that skip all else."""
    if a == b:
        return True
    f, at, texts = folding.fold([a, b])
    p, q = _stream(texts[0], f[at[0] : at[1]]), _stream(texts[1], f[at[1] : at[2]])
    while True:
        x, y = next(p, None), next(q, None)
        if x != y:
            return False
        if x is None:
            return True


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, length = rolling_hashes(b.column(2).to_pylist(), b.column(1).to_numpy(zero_copy_only=False))
        key = pa.array([x.tobytes() for x in np.ascontiguousarray(h.T)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), key], names=["id", "year", "text", "key"]).filter(pa.array(length > 0))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = [b.column(i).to_pylist() for i in range(6)]
        same = [y == z and same_form(t, u) for t, u, y, z in zip(c[2], c[3], c[4], c[5], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same)], names=["id", "group_id", "same"])


def copy_groups(df: DataFrame, row: str = "rec_id", text: str = "title", year: str = "pub_year") -> DataFrame:
    """``(id, group_id, same)``: the rows whose hash another row has too, each checked against the group's first row.

    Null texts or years, and texts without any letter, digit or ideograph, have no copies. One pass hashes; groups are
    counted with partial aggregation; a group holding a large share of all rows is spread over all tasks when its rows
    meet its first row.
    """
    flat = df.select(F.col(row).cast("long").alias("id"), F.col(year).cast("long").alias("year"), F.col(text).alias("text")).filter("text is not null and year is not null")
    hashed = materialise(flat.mapInArrow(_hashed, "id long, year long, text string, key binary"), "copies")
    groups = materialise(hashed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "year", "text")).alias("first")).filter("n > 1"), "copies")
    met = lookup(hashed, groups, "key", rows_of(hashed), spread=F.xxhash64("id")).filter("first is not null")
    pairs = met.select("id", F.col("first.id").alias("group_id"), "text", F.col("first.text").alias("other"), "year", F.col("first.year").alias("other_year"))
    return materialise(pairs.mapInArrow(_checked, "id long, group_id long, same boolean"), "copies")


def _canonical(text: str, year: int) -> str:
    f, _, texts = folding.fold([text])
    return f"{year}:" + "".join(map(chr, _stream(texts[0], f)))


def _regroup(df: DataFrame, odd: DataFrame, row: str, text: str, year: str) -> DataFrame:
    """Rows that share a hash without being the same: grouped by their exact form. None are expected, so none are slow."""
    canon = F.udf(_canonical, "string", useArrow=True)
    rest = df.join(odd.select(F.col("id").alias(row)), row).select(F.col(row).cast("long").alias("id"), canon(F.col(text), F.col(year).cast("long")).alias("form"))
    first = rest.groupBy("form").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).filter("n > 1")
    return rest.join(first, "form").select("group_id", "id")


def found(df: DataFrame, row: str = "rec_id", text: str = "title", year: str = "pub_year") -> DataFrame:
    """``(group_id, rec_id)`` of every row that has at least one copy; group_id is the least id among the copies."""
    checked = copy_groups(df, row, text, year)
    odd = checked.filter("not same")
    good = checked.filter("same").select("group_id", "id")
    if odd.limit(1).count():
        lone = good.join(odd.select("group_id").distinct(), "group_id").groupBy("group_id").agg(F.count("*").alias("n")).filter("n = 1")
        good = good.join(lone, "group_id", "left_anti").unionByName(_regroup(df, odd, row, text, year))
    return good.withColumnRenamed("id", row)


def collapsed(df: DataFrame, row: str = "rec_id", text: str = "title", year: str = "pub_year") -> DataFrame:
    """One record for each paper, all its columns, and ``n_copies``; rows without copies, or without a key, count once."""
    groups = found(df, row, text, year)
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n_copies"))
    later = groups.filter(F.col("group_id") != F.col(row)).select(row)
    kept = df.drop("n_copies").join(later, row, "left_anti")
    return kept.join(sizes.withColumnRenamed("group_id", row), row, "left").withColumn("n_copies", F.coalesce("n_copies", F.lit(1).cast("long")))
