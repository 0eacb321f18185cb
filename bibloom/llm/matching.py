"""Entities across sources without keys: sorted neighbourhood over several sort keys, weighted similarities, one-to-one assignment."""

from __future__ import annotations

import functools
import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.functions import columns as C
from bibloom.llm import mojibake
from bibloom.llm.copies import form_cut
from bibloom.llm.folding import VARIANTS
from bibloom.operators.components import propagate
from bibloom.runtime import lookup, materialise, rows_of

#: Rows of the sorted list that each row is compared with, on either side.
WINDOW = 8
#: Ends the title in a sort key; sorts before all that folded titles hold.
AFTER = "\x01"
#: Weight of each field where both sides have it.
WEIGHTS = {"title": 4.0, "authors": 2.0, "place": 2.0, "doi": 1.5, "numbers": 1.0, "year": 0.5}
#: Least confidence of a match; from CERTAIN on, what is tied together is one entity before the assignment.
LEAST, CERTAIN = 0.70, 0.85
#: Records and works of one paper that are joined in one piece, at most.
CELL = 1000
#: Years that two descriptions of one paper may be apart.
YEARS = 2
_MAY_NOTE = frozenset("勘更订撤EeCcRr")
_NOTE = re.compile(r"^\s*(?:勘误|更正|订正|撤稿|[Ee]rrat|ERRAT|[Cc]orrection|CORRECTION|[Cc]orrigend|CORRIGEND|[Rr]etract|RETRACT)|一文的(?:更正|勘误|订正)")
_SEQUEL = re.compile(r"[（(\[［【]\s*(上|中|下|续\d?|[一二三四五六]|[ⅠⅡⅢⅣⅤⅰⅱⅲⅳⅴ]|[ivx]{1,4}|\d)\s*[）)\]］】]|\bpart\s+([ivx\d]+)\b", re.I)
_MARKED = re.compile(r"[（(\[［【]\s*[上中下续一二三四五六ⅠⅡⅢⅣⅤⅰⅱⅲⅳⅴivxIVX\d]{1,4}\s*[）)\]］】]|[Pp][Aa][Rr][Tt] ")
#: What any mark of a sequel begins with.
_OPENS = frozenset("（([［【Pp")
_ADDED = re.compile(r"（网络首发）|\(网络首发\)|\[(?:中文|英文|chinese|english)\]|（(?:中文|英文)）|&amp;", re.I)
_HAN = re.compile(r"[㐀-鿿]")
_NUMBER = re.compile(r"\d{2,}")


@dataclass
class Features:
    """What is compared of one description of a paper."""

    zh: str
    en: str
    cut: bool
    note: bool
    sequel: str
    authors: tuple[tuple[str, ...], ...]
    et_al: bool
    numbers: tuple[str, ...]


_DROP = re.compile(r"[\W_]+")
_LONG_LATIN = re.compile(r"[A-Za-zＡ-Ｚａ-ｚ][A-Za-zＡ-Ｚａ-ｚ \-]{11}")
_PLAIN, _VARIANT = str.maketrans(VARIANTS), frozenset(VARIANTS)


def _folded(text: str) -> str:
    x = _DROP.sub("", unicodedata.normalize("NFKC", text).casefold())
    return x if _VARIANT.isdisjoint(x) else x.translate(_PLAIN)


def forms(title: str | None) -> tuple[str, str, bool, bool, str]:
    """Folded Chinese and English form, whether cut short, whether a correction note, and the mark of a sequel."""
    if not title:
        return "", "", False, False, ""
    t = title if title.isascii() else mojibake.repair(title)[0] or ""
    if "（" in t or "[" in t or "(" in t or "&" in t:
        t = _ADDED.sub("", t)
    note = (t.lstrip()[:1] in _MAY_NOTE or "一文的" in t) and bool(_NOTE.search(t))
    sequel = ""
    if not _OPENS.isdisjoint(t) and _MARKED.search(t):
        sequel = "+".join(sorted({unicodedata.normalize("NFKC", next(filter(None, m.groups()))).casefold() for m in _SEQUEL.finditer(t)}))
        t = _SEQUEL.sub("", t)
    cut_short = t.rstrip().endswith(("…", "...", "．．．"))
    if t.isascii():
        return "", _folded(t), cut_short, note, sequel
    if not _LONG_LATIN.search(t):
        return _folded(t), "", cut_short, note, sequel
    at = form_cut(t)
    parts = [t[at:], t[:at]] if at else re.split(r"\s*(?:\|\|?|｜|=|＝|;|；|/|／)\s*", t, maxsplit=1) if _two_forms(t) else [t]
    zh = en = ""
    for plain in map(_folded, parts):
        if len(_HAN.findall(plain)) * 3 >= len(plain) and _HAN.search(plain):
            zh = zh or plain
        else:
            en = en or plain
    return zh, en, cut_short, note, sequel


def _two_forms(t: str) -> bool:
    m = re.search(r"[|｜=＝;；/／]", t)
    return bool(m) and bool(_HAN.search(t, 0, m.start())) and len(re.findall("[A-Za-z]", t[m.end() :])) >= 12 and len(_HAN.findall(t[m.end() :])) <= 2


_ET_AL = re.compile(r"[;,]?\s*\bet\s+al\b\.?", re.I)
#: ASCII letters in lower case, separators of names as semicolons, all else as spaces.
_NAMES = {i: c.lower() if (c := chr(i)).isalpha() else ";" if c in ";|" else " " for i in range(128)}
_OTHER = re.compile(r"[^\x00-\x7f]")


def author_tokens(text: str | None) -> tuple[tuple[tuple[str, ...], ...], bool]:
    """Each author as the sorted name tokens in lower case (so that the order of names doesn't matter), and whether the list was cut."""
    if not text:
        return (), False
    plain = text
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain).casefold() if not unicodedata.combining(c))
    et_al = " al" in plain and bool(_ET_AL.search(plain))
    if et_al:
        plain = _ET_AL.sub("", plain)
    if not plain.isascii():
        plain = _OTHER.sub(" ", plain.replace("、", ";").replace("；", ";"))
    return tuple([t for a in plain.translate(_NAMES).split(";") if (t := _name(a))]), et_al


@functools.lru_cache(1 << 16)
def _name(text: str) -> tuple[str, ...]:
    """The sorted tokens of one name. Names recur, so they are kept."""
    return tuple(sorted(text.split()))


@functools.lru_cache(1 << 16)
def _initials(name: tuple[str, ...]) -> int:
    """The first letters of a name's tokens, as bits."""
    return sum({_LETTER[t[0]] for t in name})


def features(title: str | None, authors: str | None) -> Features:
    zh, en, cut, note, sequel = forms(title)
    sets, et_al = author_tokens(authors)
    return Features(zh, en, cut, note, sequel, sets, et_al, tuple(sorted(set(_NUMBER.findall(zh or en)))))


def text_similarity(a: str, b: str, cut: bool = False) -> float:
    """Dice coefficient of the sets of character pairs; of a title cut short, the other's part of that length is compared."""
    if a == b:
        return 1.0
    if cut and min(len(a), len(b)) >= 8:
        n = min(len(a), len(b))
        a, b = a[:n], b[:n]
    x, y = set(zip(a, a[1:], strict=False)), set(zip(b, b[1:], strict=False))
    return 2 * len(x & y) / max(1, len(x) + len(y))


def _same_name(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """1 for the same tokens, 0.8 where initials stand for names, 0 otherwise."""
    if a == b:
        return 1.0
    rest_a, rest_b = list(a), []
    for t in b:
        if t in rest_a:
            rest_a.remove(t)
        else:
            rest_b.append(t)
    if len(rest_a) == len(a) or not rest_a or not rest_b:
        return 0.0
    return 0.8 if all(x[0] == y[0] and min(len(x), len(y)) == 1 for x, y in zip(rest_a, rest_b, strict=False)) else 0.0


def author_similarity(a: Features, b: Features) -> float | None:
    """Share of authors that agree, in order; beyond a list that ends in "et al." nothing is expected."""
    x, y = a.authors, b.authors
    if not x or not y:
        return None
    n = min(len(x), len(y)) if a.et_al or b.et_al else max(len(x), len(y))
    in_order = sum(_same_name(p, q) for p, q in zip(x, y, strict=False))
    return in_order / n


def place_similarity(a: tuple, b: tuple) -> float | None:
    """Volume, issue and first page: the page weighs twice; fields that one side lacks don't count."""
    got = [(w, p == q) for w, p, q in zip((1, 1, 2), a, b, strict=True) if p and q]
    if not got or sum(w for w, _ in got) < 2:
        return None
    return sum(w for w, same in got if same) / sum(w for w, _ in got)


def confidence(fa: Features, ya: int | None, pa_: tuple, da: str | None, fb: Features, yb: int | None, pb: tuple, db: str | None) -> float:
    """Weighted mean of the similarities of the fields both have, or 0 where something rules a match out.

    Ruled out are: years further apart than YEARS, one of the two a correction note, other marks of a sequel, titles in
    the same language that differ, and agreement in too little: besides equal or nearly equal titles one more field must
    agree, and without comparable titles two must.
    """
    if ya is not None and yb is not None and abs(ya - yb) > YEARS or fa.note != fb.note or fa.sequel != fb.sequel:
        return 0.0
    cut = fa.cut or fb.cut
    titles = [text_similarity(x, y, cut) for x, y in ((fa.zh, fb.zh), (fa.en, fb.en)) if x and y]
    s: dict[str, float] = {}
    if titles:
        s["title"] = max(titles)
        if s["title"] < 0.6:
            return 0.0
    if (a := author_similarity(fa, fb)) is not None:
        s["authors"] = a
    if (p := place_similarity(pa_, pb)) is not None:
        s["place"] = p
    if da and db and da == db:
        s["doi"] = 1.0
    if fa.numbers and fb.numbers and not cut:
        s["numbers"] = float(fa.numbers == fb.numbers or bool(titles) and s["title"] == 1)
    if ya is not None and yb is not None:
        s["year"] = 1 - abs(ya - yb) / (YEARS + 1)
    full_list = s.get("authors", 0) == 1 and len(fa.authors) > 1
    agree = (s.get("authors", 0) >= 0.75) + (s.get("place", 0) >= 0.9) + ("doi" in s) + full_list
    if titles:
        if s["title"] < 0.8 and agree < 2 or s["title"] < 0.999 and agree < 1 or agree == 0 and (s.get("authors", 1) < 0.4 or s.get("place", 1) < 0.5 or ya is None or yb is None):
            return 0.0
        if s.get("authors", 1) < 0.3 and s.get("place", 1) < 0.5 and "doi" not in s:
            return 0.0
    else:
        if s.get("numbers", 1) == 0 or s.get("authors", 1) < 0.5 or s.get("place", 1) < 0.6 or agree < 2:
            return 0.0
        if "numbers" not in s and "doi" not in s and s.get("place", 0) < 0.9:
            return 0.0
    return sum(WEIGHTS[k] * v for k, v in s.items()) / sum(WEIGHTS[k] for k in s)


# ---------------------------------------------------------------- entries

def entries(records: DataFrame, works: DataFrame) -> DataFrame:
    """Both tables in one shape, cells as they stand; ids of the two sides may overlap."""
    a = records.select(F.col("rec_id").cast("long").alias("id"), F.lit(0).alias("side"), F.col("pub_year").cast("int").alias("year"), "doi", "volume", "issue", F.col("pages").alias("page"), "title", F.col("authors_pinyin_raw").alias("authors"))
    b = works.select(F.col("work_id").cast("long").alias("id"), F.lit(1).alias("side"), F.col("publication_year").cast("int").alias("year"), "doi", "volume", "issue", F.col("first_page").alias("page"), "title", F.col("authors_str").alias("authors"))
    return a.unionByName(b)


_DOI = re.compile(r"10\.\d{4,9}/\S*\d{3}\S*")
_DOI_LABEL = re.compile(r"^(?:(?:https?://)?(?:dx\.|www\.)?doi\.org/|doi[:=]*)+")
_PAGE = re.compile(r"\s*([a-zA-Z]?\d+)")


def clean_doi(text: str | None) -> str | None:
    """A DOI in lower case without label and padding; null for what is none, as fillers without a number are."""
    if not text:
        return None
    x = text if text.isascii() else unicodedata.normalize("NFKC", text)
    x = _DOI_LABEL.sub("", "".join(x.lower().split())).rstrip(".。")
    return x if _DOI.fullmatch(x) else None


@functools.lru_cache(1 << 14)
def clean_number(text: str | None) -> str | None:
    """A volume or issue without padding and leading zeros; null for blank cells and fillers."""
    if not text:
        return None
    if not text.isdecimal() or not text.isascii():
        text = unicodedata.normalize("NFKC", text).strip().lower()
        if text in C.FILLERS:
            return None
    return text.lstrip("0") or (text and "0") or None


def clean_page(text: str | None) -> str | None:
    """The first page of a range."""
    m = _PAGE.match(text if not text or text.isascii() else unicodedata.normalize("NFKC", text)) if text else None
    return clean_number(m.group(1)) if m else None


_TEXTS = ("doi", "volume", "issue", "page", "zh", "en", "sequel", "authors", "numbers", "who", "lead")
_FEATURES = "id long, side int, year int, cut boolean, note boolean, et_al boolean, " + ", ".join(f"{x} string" for x in _TEXTS) + ", compact binary"
_COMPARED = ("year", "cut", "note", "et_al", *_TEXTS[:-2])


#: Authors of which a compact description has the initials, and the bits that a title's character pairs are hashed to, in the window and in a description.
_LISTED, _BITS, _SKETCH = 4, 256, 64
#: Bits of the codes that stand for texts in a compact description.
_CODES = {"sequel": 8, "volume": 16, "issue": 8, "page": 16, "doi": 32, "numbers": 16}
_COMPACT = np.dtype([("year", "<i2"), ("flags", "u1"), ("authors", "<u2"), ("pairs_zh", "<u2"), ("pairs_en", "<u2"), *((x, f"<u{n // 8}") for x, n in _CODES.items()), ("initials", "<u4", (_LISTED,)), ("sketch", "<u8")])
_CUT, _NOTE_BIT, _ET_AL_BIT, _ZH, _EN, _YEAR = (1 << i for i in range(6))
_LETTER = {chr(97 + i): 1 << i for i in range(26)}


def _code(texts: list[str | None], bits: int) -> np.ndarray:
    """Numbers that are equal for equal texts, 0 for none."""
    plain = np.array([x or "" for x in texts], dtype=object)
    return np.where(plain == "", 0, pd.util.hash_array(plain, categorize=False) >> np.uint64(64 - bits) | np.uint64(1))


def _pairs(titles: list[str]) -> np.ndarray:
    """How many different character pairs each title has."""
    flat = np.frombuffer("".join(titles).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(titles), dtype=np.uint64), np.fromiter(map(len, titles), dtype=np.int64, count=len(titles)))
    inside = row[1:] == row[:-1]
    pairs = np.sort((row[1:] << np.uint64(42) | flat[:-1] << np.uint64(21) | flat[1:])[inside])
    first = np.ones(len(pairs), dtype=bool)
    first[1:] = pairs[1:] != pairs[:-1]
    return np.minimum(65535, np.bincount((pairs[first] >> np.uint64(42)).astype(np.int64), minlength=len(titles)))


def _compact(f: list[Features], year: list[int | None], **texts: list[str | None]) -> np.ndarray:
    """Descriptions of fixed size, from which bounds() tells what a pair can't be."""
    out = np.zeros(len(f), dtype=_COMPACT)
    out["year"] = [max(-32768, min(32767, y or 0)) for y in year]
    out["flags"] = [x.cut * _CUT | x.note * _NOTE_BIT | x.et_al * _ET_AL_BIT | bool(x.zh) * _ZH | bool(x.en) * _EN | (y is not None) * _YEAR for x, y in zip(f, year, strict=True)]
    out["authors"] = [min(65535, len(x.authors)) for x in f]
    out["pairs_zh"], out["pairs_en"] = _pairs([x.zh for x in f]), _pairs([x.en for x in f])
    for c, bits in _CODES.items():
        out[c] = _code(texts[c], bits)
    out["initials"] = [([*map(_initials, x.authors[:_LISTED])] + [0] * _LISTED)[:_LISTED] for x in f]
    out["sketch"] = _pair_bits([x.zh or x.en for x in f], _SKETCH)[:, 0]
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cleaned cells and features; authors and numbers as joined text, with the first author's initials and the first three authors, and all in compact form."""
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    mojibake.use(frozenset())
    for b in batches:
        doi, volume, issue, page, title, people = (b.column(i).to_pylist() for i in range(3, 9))
        f = list(map(features, title, people))
        sets = [list(map(" ".join, x.authors)) for x in f]
        doi, volume, issue, page = list(map(clean_doi, doi)), list(map(clean_number, volume)), list(map(clean_number, issue)), list(map(clean_page, page))
        numbers = [",".join(x.numbers) for x in f]
        compact = _compact(f, b.column(2).to_pylist(), doi=doi, volume=volume, issue=issue, page=page, numbers=numbers, sequel=[x.sequel for x in f]).tobytes()
        size = _COMPACT.itemsize
        texts = (
            doi, volume, issue, page, (x.zh for x in f), (x.en for x in f), (x.sequel for x in f), (";".join(s) for s in sets), numbers,
            ("".join(w[0] for w in s[0].split(" ")) if s else None for s in sets), (";".join(s[:3]) if s else None for s in sets),
        )
        flags = (pa.array([x.cut for x in f], pa.bool_()), pa.array([x.note for x in f], pa.bool_()), pa.array([x.et_al for x in f], pa.bool_()))
        #: ids of the two sides must differ
        ids = pa.array(b.column(0).to_numpy() * 2 + b.column(1).to_numpy(), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, b.column(1), b.column(2), *flags, *(pa.array(list(t), pa.string()) for t in texts), pa.array([compact[i : i + size] for i in range(0, len(compact), size)], pa.binary())], names=names)


def _sort_rows(e: DataFrame) -> DataFrame:
    """``(key, digest, id, compact)``: an entry once for each composite sort key that it has; the key begins with the pass.

    Keys are whole, however long: a title, then year and first author, so that only what is equal in all of them is ordered by the digest.
    """
    year = F.coalesce(F.col("year").cast("string"), F.lit(""))
    who, known = F.coalesce("who", F.lit("")), F.col("who").isNotNull()
    titled = lambda t: F.concat_ws(AFTER, t, year, who)
    keys = [
        F.when(F.length("zh") > 4, titled(F.col("zh"))),
        F.when(F.length("zh") > 4, titled(F.reverse("zh"))),
        F.when(F.length("en") > 8, titled(F.col("en"))),
        F.when(F.col("doi").isNotNull(), F.concat_ws("|", "doi", who)),
        F.when(F.col("page").isNotNull() & (F.col("volume").isNotNull() | F.col("issue").isNotNull()), F.concat_ws("|", year, "page", who, F.coalesce("volume", F.lit("")), F.coalesce("issue", F.lit("")))),
        F.when(known, F.concat_ws("|", "lead", year, "numbers")),
    ]
    rows = [F.concat(F.lit(str(i)), k) for i, k in enumerate(keys)]
    digest = F.xxhash64("side", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in _COMPARED])
    return e.select(F.array_compact(F.array(*rows)).alias("keys"), digest.alias("digest"), "id", "compact").select(F.explode("keys").alias("key"), "digest", "id", "compact")


_PAIR = "a long, b long, kind int, key string, digest long, id long, compact binary, part int"


def _windows(across: bool) -> Callable:
    """Candidates among WINDOW neighbours of a sorted partition, and its edge rows, which meet the next partition's later.

    Every pair of neighbours is compared: see bounds(). All by array operations over the whole batch, one distance after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = [x.split()[0] for x in _PAIR.split(", ")]
        held: pa.Table | None = None
        first: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            n_held = held.num_rows if held is not None else 0
            whole = pa.concat_tables([held, t]).combine_chunks() if held is not None else t.combine_chunks()
            whole, links = _collapsed(whole, n_held)
            yield from _batch(links, 2, names)
            if first is None or first.num_rows < WINDOW:
                fresh = whole.slice(n_held)
                first = pa.concat_tables([first, fresh]).slice(0, WINDOW) if first is not None else fresh.slice(0, WINDOW)
            yield from _near(whole, n_held, across, names)
            held = whole.slice(max(0, whole.num_rows - WINDOW))
        if held is not None and not across:
            edge = pa.concat_tables([first, held]).combine_chunks()
            n = edge.num_rows
            nothing = pa.array(np.full(n, -1), pa.int64())
            cols = [nothing, nothing, pa.array(np.full(n, 1), pa.int32()), *(edge.column(i).combine_chunks() for i in range(4)), pa.array(np.full(n, part), pa.int32())]
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names=names)

    return run


def _collapsed(t: pa.Table, old: int) -> tuple[pa.Table, np.ndarray]:
    """The rows without those that repeat the description before them, and the links from these to the first of each run."""
    if t.num_rows < 2:
        return t, np.empty((0, 2), dtype=np.int64)
    dig, ids = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("digest", "id"))
    again = np.concatenate([[False], dig[1:] == dig[:-1]])
    again[:old] = False
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(ids))))
    return t.filter(pa.array(~again)), np.stack([ids[first[again]], ids[again]], axis=1)


def _batch(pairs: np.ndarray, kind: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    if len(pairs):
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        m = len(pairs)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(m, kind), pa.int32()), *(pa.nulls(m, k) for k in kinds), pa.array(np.zeros(m), pa.int32())], names=names)


def _described(column: pa.ChunkedArray) -> np.ndarray:
    """The compact descriptions of a table, without copying them."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    at = np.frombuffer(flat.buffers()[1], dtype=np.int32)[flat.offset]
    return np.frombuffer(flat.buffers()[2], dtype=_COMPACT, count=len(flat), offset=at)


def _pair_bits(titles: list[str], bits: int = _BITS) -> np.ndarray:
    """The character pairs of each title, hashed to so many bits, as rows of 64-bit numbers."""
    flat = np.frombuffer("".join(titles).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.fromiter(map(len, titles), dtype=np.int64, count=len(titles))
    row = np.repeat(np.arange(len(titles)), sizes)
    inside = row[1:] == row[:-1]
    bit = (flat[:-1] * np.uint32(0x9E3779B1) ^ flat[1:] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) >> np.uint32(33 - bits.bit_length())
    out = np.zeros((len(titles), bits), dtype=bool)
    out[row[1:][inside], bit[inside]] = True
    return np.packbits(out, axis=1).view(np.uint64)


def _most_alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """What text_similarity() can be at most: the character pairs that only one title's bits show can't be shared."""
    only_a, only_b = np.bitwise_count(a & ~b), np.bitwise_count(b & ~a)
    if a.ndim > 1:
        only_a, only_b = only_a.sum(axis=1, dtype=np.int32), only_b.sum(axis=1, dtype=np.int32)
    return 2 * np.minimum(na - only_a.astype(np.int32), nb - only_b.astype(np.int32)) / np.maximum(1, na + nb)


def bounds(a: np.ndarray, b: np.ndarray, title: np.ndarray, of_title: np.ndarray) -> np.ndarray:
    """For pairs of compact descriptions, a confidence that confidence() can't exceed; 0 where that surely is 0.

    ``title`` bounds the titles' similarity, ``of_title`` tells where it stands for titles at all. Codes that are equal
    count as equal values, and an author as the same wherever one's initials are among the other's, so nothing that
    confidence() accepts gets less than it does there.
    """
    cut = (a["flags"] | b["flags"]) & _CUT > 0
    both = a["flags"] & b["flags"]
    dated = both & _YEAR > 0
    apart = np.abs(a["year"].astype(np.int32) - b["year"])
    ok = ~(dated & (apart > YEARS)) & ((a["flags"] ^ b["flags"]) & _NOTE_BIT == 0) & (a["sequel"] == b["sequel"])
    na, nb = a["authors"].astype(np.int32), b["authors"].astype(np.int32)
    fewer, named = np.minimum(na, nb), (na > 0) & (nb > 0)
    expected = np.where((a["flags"] | b["flags"]) & _ET_AL_BIT > 0, fewer, np.maximum(na, nb))
    shared = a["initials"] & b["initials"]
    may = ((shared == a["initials"]) | (shared == b["initials"])) & (np.arange(_LISTED) < fewer[:, None])
    authors = np.where(named, (may.sum(axis=1) + np.maximum(0, fewer - _LISTED)) / np.maximum(1, expected), 0.0)
    have = [(a[x] != 0) & (b[x] != 0) for x in ("volume", "issue", "page")]
    weight = have[0] * 1 + have[1] + have[2] * 2
    same = sum((h & (a[x] == b[x])) * w for h, x, w in zip(have, ("volume", "issue", "page"), (1, 1, 2), strict=True))
    placed = weight >= 2
    place = np.where(placed, same / np.maximum(1, weight), 0.0)
    doi = (a["doi"] != 0) & (a["doi"] == b["doi"])
    counted = (a["numbers"] != 0) & (b["numbers"] != 0) & ~cut
    numbers = (a["numbers"] == b["numbers"]) | of_title & (title >= 1)
    agree = (authors >= 0.75).astype(np.int8) + (place >= 0.9) + doi + ((authors >= 1) & (na > 1))
    far = named & (authors < 0.4) | placed & (place < 0.5) | ~dated
    other = named & (authors < 0.3) & placed & (place < 0.5) & ~doi
    with_title = (title >= 0.6) & ~((title < 0.8) & (agree < 2) | (title < 0.999) & (agree < 1) | (agree == 0) & far) & ~other
    without = ~(counted & ~numbers) & ~(named & (authors < 0.5)) & ~(placed & (place < 0.6)) & (agree >= 2) & (counted | doi | (place >= 0.9))
    ok &= np.where(of_title, with_title, without)
    parts = ((of_title, title, "title"), (named, authors, "authors"), (placed, place, "place"), (doi, 1.0, "doi"), (counted, numbers, "numbers"), (dated, 1 - apart / (YEARS + 1), "year"))
    total = sum(WEIGHTS[k] * there for there, _, k in parts)
    return np.where(ok, sum(WEIGHTS[k] * there * value for there, value, k in parts) / np.maximum(total, 1e-9), 0.0)


def _near(t: pa.Table, old: int, across: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The pairs of neighbours whose confidence may reach LEAST."""
    n = t.num_rows
    if n < 2:
        return
    ids = t.column("id").combine_chunks().to_numpy(zero_copy_only=False)
    keys = t.column("key").to_pylist()
    pas = np.array([ord(k[0]) - 48 for k in keys])
    d_of = _described(t.column("compact"))
    bits = _pair_bits([k[1:].partition(AFTER)[0] if k[0] < "3" else "" for k in keys])
    zh, en = d_of["pairs_zh"].astype(np.int32), d_of["pairs_en"].astype(np.int32)
    pairs, either = np.where(pas == 2, en, zh), np.where(d_of["flags"] & _ZH > 0, zh, en)
    part = t.column("part").combine_chunks().to_numpy(zero_copy_only=False) if across else None
    out: list[np.ndarray] = []
    for d in range(1, WINDOW + 1):
        if d >= n:
            break
        i, j = np.arange(0, n - d), np.arange(d, n)
        ok = (j >= old) & (pas[i] == pas[j]) & (ids[i] != ids[j])
        if part is not None:
            ok &= part[i] != part[j]
        i, j = i[ok], j[ok]
        p, both = pas[i], d_of["flags"][i] & d_of["flags"][j]
        # titles are in the keys of three passes; for the others the short sketch must do. A title cut short, or one with a second form, may yet be the same
        keyed = p <= 2
        form = both & (_ZH | _EN)
        other = (d_of["flags"][i] ^ d_of["flags"][j]) & (_ZH | _EN)
        title = np.where(keyed, _most_alike(bits[i], bits[j], pairs[i], pairs[j]), _most_alike(d_of["sketch"][i], d_of["sketch"][j], either[i], either[j]))
        title[((d_of["flags"][i] | d_of["flags"][j]) & _CUT > 0) | (form == _ZH | _EN) | ~keyed & (form == _EN) & (other > 0)] = 1.0
        titled = keyed | (form > 0)
        # unlike titles rule a match out whatever else agrees: see bounds()
        some = (title >= 0.6) | ~titled
        i, j = i[some], j[some]
        good = bounds(d_of[i], d_of[j], title[some], titled[some]) >= LEAST - 1e-6
        if good.any():
            out.append(np.stack([ids[i[good]], ids[j[good]]]))
    if out:
        yield from _batch(np.concatenate(out, axis=1).T, 0, names)


def candidates(e: DataFrame) -> DataFrame:
    """``(a, b, kind)``: ids that are neighbours under some sort key (kind 0) or have the same description (kind 2).

    All keys are sorted in one range partitioning by (key, digest, id), the key beginning with its pass, so that ties of a hot key are split over
    partitions too. Repeated descriptions are linked to the first and leave the window to others. Every partition also
    gives its first and last WINDOW descriptions, which are collapsed again and compared across partitions.
    """
    rows = _sort_rows(e)
    order = ["key", "digest", "id"]
    parts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hit = materialise(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_windows(False), _PAIR), "window")
    edge = hit.filter("kind = 1").select("key", "digest", "id", "compact", "part").distinct()
    across = edge.repartitionByRange(1, *order).sortWithinPartitions(*order).mapInArrow(_windows(True), _PAIR)
    return hit.filter("kind <> 1").select("a", "b", "kind").unionByName(across.filter("kind <> 1").select("a", "b", "kind")).groupBy("a", "b").agg(F.max("kind").alias("kind"))


# ---------------------------------------------------------------- scores and assignment


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        sides = []
        for x in "ab":
            c = {n: t.column(f"{x}_{n}").to_pylist() for n in _COMPARED}
            sets = [tuple(tuple(z.split(" ")) for z in s.split(";")) if s else () for s in c["authors"]]
            f = [Features(*r) for r in zip(c["zh"], c["en"], c["cut"], c["note"], c["sequel"], sets, c["et_al"], [tuple(s.split(",")) if s else () for s in c["numbers"]], strict=True)]
            sides.append((f, c["year"], list(zip(c["volume"], c["issue"], c["page"], strict=True)), c["doi"]))
        out = np.array(list(map(confidence, *sides[0], *sides[1])), dtype=float)
        yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(out)], names=["a", "b", "confidence"]).filter(pa.array(out >= LEAST))


def _assign(rows: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """One-to-one assignment of the greatest total confidence among the entities of a conflict, however many (shortest augmenting paths over the edges).

    ``u`` and ``v`` are bounds with u + v >= confidence for every edge, equal for those taken, and 0 for whoever is left
    over. From each left entity in turn the cheapest way is sought, nearest first, to a free right entity or to a left
    one that is rather left over.
    """
    best = {(a, b): w for a, b, w in sorted(rows, key=lambda r: r[2])}
    ways: dict[int, list[tuple[int, float]]] = {}
    for (a, b), w in sorted(best.items()):
        ways.setdefault(a, []).append((b, w))
    u, v = {}, dict.fromkeys((b for _, b in best), 0.0)
    taken: dict[int, int] = {}
    partner: dict[int, int] = {}
    for start, edges in ways.items():
        u[start] = max(0.0, max(w - v[b] for b, w in edges))
        far_left, far_right, come, heap = {start: 0.0}, {}, {}, []
        a, d, end, out, free = start, 0.0, u[start], start, None
        while True:
            if d + u[a] < end:
                end, out = d + u[a], a
            for b, w in ways[a]:
                new = d + max(0.0, u[a] + v[b] - w)
                if b not in far_right and new < end and (b not in come or new < come[b][0]):
                    come[b] = new, a
                    heapq.heappush(heap, (new, b in taken, b))
            while heap and heap[0][2] in far_right:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= end:
                break
            d, _, b = heapq.heappop(heap)
            far_right[b] = d
            if b not in taken:
                end, free = d, b
                break
            a = taken[b]
            far_left[a] = d
        for x, far in far_left.items():
            u[x] -= end - far
        for x, far in far_right.items():
            v[x] += end - far
        if free is None and out == start:
            continue
        b = partner.pop(out) if free is None else free
        while True:
            a = come[b][1]
            taken[b], before = a, partner.get(a)
            partner[a] = b
            if a == start:
                break
            b = before
    return [(a, b, best[a, b]) for a, b in partner.items()]


def one_to_one(edges: DataFrame, tag: str = "assign") -> DataFrame:
    """``(left, right, confidence)`` → the assignment with the greatest total confidence.

    Edges without rival stand. Conflicts are taken apart into connected components, each of which is solved optimally by
    one task, whatever its size.
    """
    edges = materialise(edges.groupBy("left", "right").agg(F.max("confidence").alias("confidence")), tag)
    ln = edges.groupBy("left").agg(F.count("*").alias("ln"))
    rn = edges.groupBy("right").agg(F.count("*").alias("rn"))
    counted = materialise(edges.join(ln, "left").join(rn, "right"), tag)
    alone = counted.filter("ln = 1 and rn = 1").select("left", "right", "confidence")
    rivals = materialise(counted.filter("ln > 1 or rn > 1").select("left", "right", "confidence"), tag)
    if not rows_of(rivals):
        return alone
    node = lambda c, s: F.col(c) * 2 + s
    labels = propagate(rivals.select(node("left", 0).alias("u"), node("right", 1).alias("v")), tag)
    tied = rivals.withColumn("u", node("left", 0)).join(labels, "u").drop("u")

    def solve(t: pa.Table) -> pa.Table:
        got = _assign(list(zip(*(t.column(c).to_pylist() for c in ("left", "right", "confidence")), strict=True)))
        return pa.table({"left": pa.array([g[0] for g in got], pa.int64()), "right": pa.array([g[1] for g in got], pa.int64()), "confidence": pa.array([g[2] for g in got], pa.float64())})

    return alone.unionByName(tied.groupBy("label").applyInArrow(solve, "left long, right long, confidence double"))


def match(records: DataFrame, works: DataFrame) -> DataFrame:
    """``(rec_id, work_id, confidence)``: every pair of a record and a work that are the same paper.

    Equal descriptions on one side are collapsed first, so copies neither fill windows nor are compared. Neighbours under
    any sort key are scored; descriptions tied with a confidence of CERTAIN or more are one entity, and what ties less
    surely is assigned one to one between the entities that hold records only and those that hold works only. Each
    entity's pairs of record and work then come out, copies included. Null fields don't count; a record and a work that
    share too little are never matched. Ids must be unique on either side.
    """
    e = materialise(entries(records, works).mapInArrow(_featured, _FEATURES), "entries")
    near = materialise(candidates(e), "near")
    side = lambda s: e.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in _COMPARED])
    # the candidates are the smaller side of both joins: they are hashed, and the entries needn't be sorted
    first = near.filter("kind = 0").select("a", "b").hint("shuffle_hash").join(side("a"), "a")
    scored = materialise(first.hint("shuffle_hash").join(side("b"), "b").mapInArrow(_scored, "a long, b long, confidence double"), "scored")
    sure = scored.filter(F.col("confidence") >= CERTAIN)
    links = sure.select("a", "b").unionByName(near.filter("kind = 2").select("a", "b"))
    labels = propagate(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "entities")
    #: the lowest bit of an id is its side
    of_side = lambda c: F.col(c).bitwiseAND(F.lit(1))
    lo, hi = F.min(of_side("u")), F.max(of_side("u"))
    has = materialise(labels.groupBy("label").agg(F.when(hi != lo, 2).otherwise(hi).alias("h"), F.count("*").alias("n")), "entities")
    known = materialise(lookup(labels, has, "label", rows_of(labels), spread=F.xxhash64("u")).withColumnRenamed("label", "entity"), "entities")
    loose = scored.filter(F.col("confidence") < CERTAIN)
    entity = lambda c: known.select(F.col("u").alias(c), F.col("entity").alias(f"e{c}"), F.col("h").alias(f"h{c}"))
    ends = loose.join(entity("a"), "a", "left").join(entity("b"), "b", "left").select("confidence", *[F.coalesce(f"e{c}", c).alias(f"e{c}") for c in "ab"], *[F.coalesce(f"h{c}", of_side(c)).alias(f"h{c}") for c in "ab"])
    cross = ends.filter("ea <> eb and ha + hb = 1 and ha <> hb").select(F.when(F.col("ha") == 0, F.col("ea")).otherwise(F.col("eb")).alias("left"), F.when(F.col("ha") == 0, F.col("eb")).otherwise(F.col("ea")).alias("right"), "confidence")
    assigned = materialise(one_to_one(cross), "assigned")
    # entities that hold both sides by themselves, and those that the assignment brings together
    tied = sure.filter(of_side("a") != of_side("b")).select(F.col("a").alias("u"), "confidence").join(known, "u").groupBy("entity").agg(F.max("confidence").alias("tie"))
    own = has.filter("h = 2").select(F.col("label").alias("entity")).join(tied, "entity", "left").select(F.col("entity").alias("left"), F.col("entity").alias("right"), F.coalesce("tie", F.lit(1.0)).alias("confidence"))
    single = lambda c: assigned.select(F.col(c).alias("id")).join(known.select(F.col("u").alias("id")), "id", "left_anti").select("id", F.col("id").alias("entity"))
    member = materialise(known.select(F.col("u").alias("id"), "entity").unionByName(single("left")).unionByName(single("right")), "member")
    return _expanded(member, own.unionByName(assigned.select("left", "right", "confidence")))


def _expanded(member: DataFrame, papers: DataFrame) -> DataFrame:
    """All pairs of a record and a work of each paper. Papers of many copies are joined in pieces of CELL by CELL rows at most."""
    rows = {"left": member.filter(F.col("id").bitwiseAND(F.lit(1)) == 0), "right": member.filter(F.col("id").bitwiseAND(F.lit(1)) == 1)}
    count = lambda c: rows[c].groupBy(F.col("entity").alias(c)).agg(F.count("*").alias(f"n_{c}"))
    sized = materialise(papers.join(count("left"), "left").join(count("right"), "right").withColumn("n", F.greatest("n_left", "n_right")), "papers")
    pieces = lambda c: F.ceil(F.col(f"n_{c}") / CELL)

    def side(c: str, other: str, into: str) -> DataFrame:
        paper = sized.select(F.col(c).alias("entity"), F.col("left").alias("paper"), "confidence", "n_left", "n_right", "n")
        paper._bibloom_top = sized._bibloom_top
        got = lookup(rows[c], paper, "entity", rows_of(member), spread=F.xxhash64("id")).filter("paper is not null")
        at, all_ = F.pmod(F.xxhash64("id"), pieces(c)), F.sequence(F.lit(0), pieces(other) - 1)
        return got.select(F.shiftright("id", 1).alias(into), "paper", "confidence", at.cast("long").alias(f"at_{c}"), F.explode(all_.cast("array<long>")).alias(f"at_{other}"))

    return side("left", "right", "rec_id").join(side("right", "left", "work_id").drop("confidence"), ["paper", "at_left", "at_right"]).select("rec_id", "work_id", "confidence")


def found(records: DataFrame, works: DataFrame) -> DataFrame:
    return match(records, works).select("rec_id", "work_id").distinct()
