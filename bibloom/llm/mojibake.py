"""Text decoded with the wrong encoding: round-trip repair under candidate encodings, layer by layer, while a garbling cost falls."""

from __future__ import annotations

import codecs
import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.runtime import forget, materialise, rows_of

#: Encodings a reader may wrongly have assumed. One-byte ones pass bytes they don't define as control characters.
ONE_BYTE = ("latin-1", "cp1252", "mac_roman", "cp1251", "koi8-r", "cp437")
TWO_BYTE = ("gb18030", "big5", "cp949", "cp932")
#: Encodings a text may have been written in.
INTENDED = ("utf-8", "gb18030")
#: A repair must lower the cost by MIN_GAIN, to at most MAX_LEFT of what it was.
MIN_GAIN, MAX_LEFT = 1.0, 0.6
_SPLIT = re.compile(r"([;；,，、|｜/\s*#＊]+)")
#: Signs of text that was lost: replacement, control and private characters.
_SIGNS = re.compile("[\ufffd\x80-\x84\x86-\x9f\ue000-\uf8ff]")


def _decoded_signs() -> tuple[str, ...]:
    """What two replacement characters become when their UTF-8 is read as one of the wrong encodings: their round trip back shows that text was lost before."""
    raw, out = ("\ufffd" * 2).encode(), []
    for wrong in (*ONE_BYTE, *TWO_BYTE):
        try:
            text = raw.decode(wrong)
        except UnicodeDecodeError:
            continue
        size = 3 if wrong in ONE_BYTE else 2
        out += [text[i : i + size] for i in range(len(text) - size + 1)] if wrong in TWO_BYTE else [text[:size]]
    return tuple(dict.fromkeys(out))


_DECODED_SIGNS = _decoded_signs()
#: Those of them that look like common ideographs.
_WIDE_SIGNS = re.compile("|".join(x for x in _DECODED_SIGNS if all("一" <= c <= "鿿" for c in x)))
_LOST = re.compile("|".join([_SIGNS.pattern, *map(re.escape, _DECODED_SIGNS)]))
#: What any run worth repairing among ideographs holds: six bytes of UTF-8 or more.
_HAN_PAIR = re.compile(rb"[\xe2-\xef][\x80-\xbf]{2}[\xe2-\xef][\x80-\xbf]{2}|[\xc2-\xdf][\x80-\xbf](?:[\xc2-\xdf][\x80-\xbf][\xe3-\xe9]|[\xe3-\xe9][\x80-\xbf]{2}[\xc2-\xdf])[\x80-\xbf]")
_HAN_BYTES = re.compile(rb"(?:[\xe2-\xef][\x80-\xbf]{2}|[\xc2-\xdf][\x80-\xbf])*[\xe3-\xe9][\x80-\xbf]{2}(?:[\xe2-\xef][\x80-\xbf]{2}|[\xc2-\xdf][\x80-\xbf]|[\x20-\x7e](?=[\xe2-\xef][\x80-\xbf]{2}))*")


#: Ideographs outside GB2312 that a corpus uses by themselves, as personal and place names do: see familiar(). Set by use().
_known: frozenset[str] = frozenset()
#: Share of the fields with an uncommon ideograph in which it is the only one, from which the corpus uses it, as garbled text
#: brings several together; and share of all fields with any in which it is so, as garbling makes many different ones.
ALONE, OFTEN = 1 / 3, 1e-3


def use(known: frozenset[str]) -> None:
    """The ideographs that cost little from now on, in this process."""
    global _known
    if known != _known:
        _known = known
        for f in (_cost, _uncommon, _any_uncommon, _piece):
            f.cache_clear()


@functools.cache
def _reverse(encoding: str) -> dict[int, int]:
    """Code point → byte of a one-byte encoding; a byte it doesn't define stands for itself."""
    out = {}
    for b in range(256):
        try:
            out[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    for b in range(0x80, 0xA0):
        out.setdefault(b, b)
    return out


@functools.cache
def _high(encoding: str) -> str:
    return "".join(re.escape(chr(c)) for c, b in _reverse(encoding).items() if b >= 0x80)


@functools.cache
def _cost(c: str) -> float:
    """What a character speaks for garbling: 0 for what Chinese bibliographic text is made of, up to 3 for what no text should hold."""
    o = ord(c)
    if o < 0x80:
        return 0.0 if o >= 0x20 or c in "\t\n\r" else 2.0
    if c == "�" or 0xE000 <= o <= 0xF8FF:
        return 3.0
    if 0x80 <= o < 0xA0:
        return 2.0
    name = unicodedata.category(c)
    if 0x4E00 <= o <= 0x9FFF:
        try:
            return 0.0 if c.encode("gb2312")[0] < 0xD8 else 0.25
        except UnicodeEncodeError:
            return 0.25 if c in _known else 1.0
    if 0x3000 <= o <= 0x303F or 0xFF01 <= o <= 0xFF5E or c in "—“”‘’…·•★☆※○●△□　​﻿ⅠⅡⅢⅣⅤⅥⅱαβγμ℃°±×≥≤÷":
        return 0.05
    if 0xC0 <= o <= 0x24F and name[0] == "L":
        return 0.6
    return 1.0 if name[0] == "L" or o >= 0x100 else 0.8


def garbling_cost(text: str) -> float:
    return sum(map(_cost, text))


def _encoded(text: str, encoding: str) -> bytes | None:
    if encoding in ONE_BYTE:
        table = _reverse(encoding)
        try:
            return bytes(table[ord(c)] for c in text)
        except KeyError:
            return None
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        return None


def _better(before: str, after: str, meant: str = "gb18030") -> bool:
    """Valid UTF-8 rarely comes about by chance, so half the gain will do for it."""
    a, b = garbling_cost(before), garbling_cost(after)
    return a - b >= (MIN_GAIN / 2 if meant == "utf-8" else MIN_GAIN) and b <= a * MAX_LEFT


def _round_trip(piece: str) -> str | None:
    """The best strict repair of one layer of ``piece`` as a whole, or null. What reads as UTF-8 goes first: bytes seldom are valid UTF-8 by chance."""
    raws = {wrong: raw for wrong in (*ONE_BYTE, *TWO_BYTE) if (raw := _encoded(piece, wrong)) is not None}
    for meant in INTENDED:
        best = None
        for wrong, raw in raws.items():
            if meant == wrong:
                continue
            try:
                text = raw.decode(meant)
            except UnicodeDecodeError:
                continue
            if text != piece and _plausible(piece, text, meant) and _better(piece, text, meant) and (best is None or garbling_cost(text) < garbling_cost(best)):
                best = text
        if best is not None:
            return best
    return None


def _plausible(before: str, after: str, meant: str) -> bool:
    """A strict decoding as gb18030 proves little, so its ideographs must all be common ones and no Latin word may have been eaten."""
    if "�" in after or any(unicodedata.category(c) in ("Cc", "Co", "Cn") for c in after if c not in "\t\n\r" and not 0x80 <= ord(c) < 0xA0):
        return False
    if meant == "utf-8":
        return True
    han = [c for c in after if "一" <= c <= "鿿"]
    high = [c for c in before if ord(c) >= 0x80]
    if not han:
        return all(0xC0 <= ord(c) <= 0x24F for c in after if ord(c) >= 0x80) and any(ord(c) >= 0x80 for c in after)
    if re.search("[A-Za-z][一-鿿]+[a-z]", after) and re.search("[A-Za-z][^\x00-\x7f]{1,4}[a-z]", before):
        return False
    words = re.findall(r"[^\W\d_]+", before)
    if words and (re.fullmatch("[가-힣]+", "".join(words)) or re.fullmatch("[ぁ-ヿ]+", "".join(words))):
        return False
    if words and re.fullmatch(r"[\w\s.'-]+", before) and all(re.fullmatch("[А-ЯЁ]?[а-яё]+|[А-ЯЁ]", w) for w in words):
        return False
    if all(ord(c) < 0x2E80 for c in before) and len(high) < 2 * len(han) - sum(map(str.isascii, before)):
        return False
    return sum(map(_cost, han)) <= 0.25 * len(han)


_ODD = re.compile("[^\x00-\x7f　-〿一-鿿＀-｠—“”‘’…·•★☆※○●△□​ⅠⅡⅢⅣⅤⅥⅱαβγμ℃]+")


def _runs(text: str) -> str | None:
    """One layer of repair of the garbled runs inside ``text``, the rest left as it is; null if no run can be repaired.

    Of all encodings, and of runs with and without the ASCII characters that are second bytes of gb18030, the repair
    with the least cost is taken.
    """
    best, least = None, garbling_cost(text)
    for wrong in ONE_BYTE:
        high = _high(wrong)
        for pattern in (f"[{high}]{{2,}}", f"(?:[{high}][@-~]?){{2,}}"):
            new = re.sub(pattern, lambda m, w=wrong: _run(m.group(), w), text)
            if new != text and (cost := garbling_cost(new)) < least:
                best, least = new, cost
    for new in (_wide_runs(text), _eastern_run(text)):
        if new is not None and (cost := garbling_cost(new)) < least:
            best, least = new, cost
    return best


def _eastern_run(text: str) -> str | None:
    """The stretch from the first to the last uncommon character, read as Big5 or another East Asian set by mistake."""
    odd = [i for i, c in enumerate(text) if _cost(c) >= 0.8]
    if len(odd) < 2:
        return None
    for a in (odd[0], max(0, odd[0] - 1)):
        for b in (odd[-1] + 1, odd[-1] + 2):
            run = text[a:b]
            for wrong in TWO_BYTE[1:]:
                raw = _encoded(run, wrong)
                if raw is None:
                    continue
                try:
                    new = raw.decode("gb18030")
                except UnicodeDecodeError:
                    continue
                if _plausible(run, new, "gb18030") and _better(run, new):
                    return text[:a] + new + text[b:]
    return None


def _run(run: str, wrong: str) -> str:
    raw = _encoded(run, wrong)
    if raw is None:
        return run
    for meant in INTENDED:
        try:
            new = raw.decode(meant)
        except UnicodeDecodeError:
            if meant != "utf-8" or len(raw) < 6:
                continue
            new = raw.decode(meant, "replace")  # a run cut or mixed with noise: most of it must still be text
            if new.count("�") * 4 > len(new):
                continue
            if _better(run, new.replace("�", "")):
                return new
            continue
        if _plausible(run, new, meant) and _better(run, new, meant):
            return new
    return run


def _wide_runs(text: str) -> str | None:
    """Runs whose gb18030 bytes are UTF-8 of ideographs, beginning at a character."""
    if text.isascii():
        return None
    raw = text.encode("gb18030", "replace")
    starts: dict[int, int] | None = None
    for m in _HAN_BYTES.finditer(raw):
        if m.end() - m.start() < 6:
            continue
        if starts is None:
            starts, at = {}, 0
            for i, c in enumerate(text):
                starts[at] = i
                at += len(c.encode("gb18030", "replace"))
            starts[at] = len(text)
        if m.start() not in starts:
            continue
        end = m.end()
        while end not in starts and end > m.start():
            end -= 1
        a, b = starts[m.start()], starts[end]
        new = raw[m.start() : end].decode("utf-8", "replace")
        if len(new) >= 2 and _better(text[a:b], new.replace("�", "")):
            return text[:a] + new + text[b:]
    return None


@functools.lru_cache(1 << 16)
def _piece(piece: str) -> str:
    while True:  # every layer lowers the cost, so this ends
        new = _round_trip(piece) or _runs(piece)
        if new is None or new == piece:
            return piece
        piece = new


def repair(text: str | None) -> tuple[str | None, bool, bool]:
    """``(repaired text, affected, wholly recovered)``.

    Whole texts are tried first, then the pieces between separators, then runs inside the pieces, each layer after
    layer while the cost falls. A text that holds replacement, private or control characters, or the traces they leave when
    decoded again, is affected even where nothing can be recovered. Null and empty texts are not affected.
    """
    if not text or text.isascii():
        return text, False, False
    if _clean(text):
        return text, False, False
    new = _piece(text)
    if new == text or _LOST.search(new) or garbling_cost(new) >= 1:
        parts = _SPLIT.split(new)
        new = "".join(p if i % 2 else _piece(p) for i, p in enumerate(parts))
    lost = bool(_LOST.search(new)) or bool(_LOST.search(text)) and new == text
    return new, new != text or lost, new != text and not lost


def _clean(text: str) -> bool:
    """Nothing odd in it, and no ideographs that read as UTF-8: the common case, decided by two searches. What the other marks of lost text are made of is odd."""
    return not (_ODD.search(text) or _WIDE_SIGNS.search(text) or _HAN_PAIR.search(text.encode("gb18030", "replace")) or _big5(text))


def _big5(text: str) -> bool:
    """Whether a piece has several characters outside GB2312, as text decoded as Big5 or another East Asian set has."""
    return bool(_any_uncommon().search(text)) and len(_uncommon().intersection(text)) >= 2


@functools.cache
def _any_uncommon() -> re.Pattern:
    return re.compile("[" + "".join(sorted(_uncommon())) + "]")


@functools.cache
def _uncommon() -> frozenset[str]:
    """Letters that neither GB2312 nor names have: uncommon ideographs, and letters of scripts that Chinese text seldom holds."""
    odd = (0x590, 0x600), (0x400, 0x530), (0x3040, 0x3100), (0x3100, 0x31A0), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFE30, 0xFE6C)
    return frozenset(chr(i) for a, b in odd for i in range(a, b) if _cost(chr(i)) >= 1.0)


def _uncommon_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ideographs outside GB2312 of every field that holds any and nothing else that is odd."""
    use(frozenset())
    han = frozenset(c for c in _uncommon() if "一" <= c <= "鿿")
    any_ = re.compile("[" + "".join(sorted(han)) + "]")
    for b in batches:
        got = [sorted(han.intersection(t)) for c in b.columns for t in c.to_pylist() if t and any_.search(t) and not _ODD.search(t)]
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.string()))], names=["chars"])


def familiar(df: DataFrame, fields: tuple[str, ...]) -> frozenset[str]:
    """The ideographs outside GB2312 that the corpus uses by themselves: in at least ALONE of the fields that hold one, and OFTEN of those that hold any, it is the only one.

    Counted over all rows; those found don't count as company of others, until no more is found. The result has as many
    characters as there are ideographs at most, whatever the corpus.
    """
    sets = materialise(df.select(*fields).mapInArrow(_uncommon_sets, "chars array<string>"), "uncommon")
    found: set[str] = set()
    while True:
        rest = sets.select(F.array_except("chars", F.array(*map(F.lit, sorted(found))).cast("array<string>")).alias("chars"))
        n = rest.select(F.explode("chars").alias("c"), (F.size("chars") == 1).alias("alone")).groupBy("c").agg(F.count("*").alias("n"), F.count_if("alone").alias("k"))
        new = {r["c"] for r in n.filter((F.col("k") >= F.col("n") * ALONE) & (F.col("k") >= rows_of(sets) * OFTEN) & (F.col("k") > 0)).select("c").collect()}
        if not new:
            forget(sets)
            return frozenset(found)
        found |= new


def repaired(df: DataFrame, row: str, fields: tuple[str, ...]) -> DataFrame:
    """One row for each affected field: ``(row, field_name, original, repaired, recovered)``.

    Uncommon ideographs that the corpus uses by themselves are counted first, over all rows; then each field is judged by
    itself, in Arrow batches where it is read, without a shuffle. Further columns of ``df`` are ignored.
    """
    kind = dict(df.dtypes)[row]
    known = familiar(df, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(known)
        for b in batches:
            ids = b.column(0)
            for k, name in enumerate(fields, 1):
                texts = b.column(k).to_pylist()
                hits = [(i, *r) for i, t in enumerate(texts) if t and not t.isascii() for r in [repair(t)] if r[1]]
                at = pa.array([h[0] for h in hits], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(at), pa.array([name] * len(hits), pa.string()), b.column(k).take(at), pa.array([h[1] for h in hits], pa.string()), pa.array([h[3] for h in hits], pa.bool_())], names=["id", "field_name", "original", "repaired", "recovered"])

    return df.select(F.col(row).alias("id"), *fields).mapInArrow(run, f"id {kind}, field_name string, original string, repaired string, recovered boolean").withColumnRenamed("id", row)


def restore(df: DataFrame, row: str, fields: tuple[str, ...]) -> DataFrame:
    """``df`` with the fields' recoverable text put back in place; every other value, and every row, stays as it is."""
    names = df.columns
    known = familiar(df, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(known)
        for b in batches:
            cols = [pa.array([repair(x)[0] for x in b.column(i).to_pylist()], pa.string()) if n in fields else b.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, df.schema)


def found(df: DataFrame, row: str = "rec_id", fields: tuple[str, ...] = ("title", "authors_raw")) -> DataFrame:
    """``(field_name, rec_id)`` of every field of which all or part was decoded with a wrong encoding."""
    return repaired(df, row, fields).select("field_name", F.col(row))


assert all(codecs.lookup(e) for e in (*ONE_BYTE, *TWO_BYTE, *INTENDED))
