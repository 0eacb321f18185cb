"""Oversized texts into pieces: content-defined landmarks, snapped to natural boundaries within size limits."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm import tokens
from bibloom.llm.leaks import gram_hashes

#: Natural boundaries, strongest first: paragraph, line, sentence, clause, word.
KINDS = ("paragraph", "line", "sentence", "clause", "word", "none")
_BREAKS = re.compile(r"(?P<p>[ \t　]*\r?\n(?:[ \t　]*\r?\n)+)|(?P<l>\r?\n)|(?P<s>[。！？!?…]+[”’」』）)\"']*|\.[\"')\]]*(?=\s)|[;；](?=\s|[㐀-鿿]))")
#: Weak boundaries, sought only where there is no natural one.
_WEAK = (re.compile(r"[,，、:：|]"), re.compile(r"[ \t　]+"))
_RANK = {"p": 0, "l": 1, "s": 2}
#: Characters in the rolling hash's window; one position in SPACING is a landmark.
WINDOW, SPACING = 16, 48
#: A piece holds at least this share of its limit, but for the last and where the text forbids.
LEAST = 0.35
#: Characters a landmark may be away from the boundary it snaps to.
REACH = 64


def _joins(c: str) -> bool:
    """Whether a character must not be parted from the one before it."""
    return "̀" <= c <= "ͯ" or "︀" <= c <= "️" or c in "‍゙゚" or "\U0001f3fb" <= c <= "\U0001f3ff"


def _kind(c: str) -> int:
    """Class of a character in the pre-tokenizer's pattern: letter, number, white space or other."""
    return 0 if c.isalpha() else 1 if c.isdigit() else 2 if c.isspace() else 3


def _parted(text: str, at: int) -> bool:
    """Whether the tokenizer surely begins a new token at ``at``, in the text as well as in a piece that ends or begins there.

    Only plain characters are trusted: ASCII and common ideographs with their punctuation, whose classes no version of
    Unicode disputes. White space before the cut, and an apostrophe, which may begin a contraction, are not.
    """
    if at <= 0 or at >= len(text):
        return True
    a, b = text[at - 1], text[at]
    plain = lambda c: c < "\x7f" or "、" <= c <= "】" or "一" <= c <= "龥" or c in "，。；：？！（）"
    return plain(a) and plain(b) and not a.isspace() and a != "'" and (b.isspace() or _kind(a) != _kind(b))


class Chunker:
    """Pieces of one text under a limit, by one tokenizer."""

    def __init__(self, folder: str = tokens.FOLDER, name: str = tokens.VOCABULARY):
        self.encoding = tokens.encoding(folder, name)
        self.lengths = np.array([len(self.encoding.decode_single_token_bytes(i)) for i in range(self.encoding.n_vocab)], dtype=np.int64)

    def size(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def span(self, text: str, upto: list[int], start: int, end: int) -> int:
        """Tokens of ``text[start:end]`` by itself: counted afresh only up to the first and from the last sure token boundary."""
        a = start
        while a < end and not _parted(text, a):
            a += 1
        b = end
        while b > a and not _parted(text, b):
            b -= 1
        if b <= a:
            return self.size(text[start:end])
        return (self.size(text[start:a]) if a > start else 0) + upto[b] - upto[a] + (self.size(text[b:end]) if b < end else 0)

    def pieces(self, text: str, most: int, overlap: int) -> list[tuple[int, int, int, int, str]] | None:
        """``(start, end, tokens, overlap characters, kind of the boundary at the end)`` of each piece; null if the text fits.

        The cut after a position is the least of the hashes of the landmarks between the least and the greatest size, so
        it depends on the text there alone. Without a landmark the strongest and last natural boundary is taken, without
        any the last character that fits. A piece that the tokenizer counts longer by itself is cut shorter.
        """
        if most < 1 or not 0 <= overlap < most:
            raise ValueError(f"a limit of {most} tokens with an overlap of {overlap}")
        ids = np.array(self.encoding.encode_ordinary(text), dtype=np.int64)
        if len(ids) <= most:
            return None
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        at_byte = np.concatenate([[0], np.cumsum(width)])
        ends = np.cumsum(self.lengths[ids])
        #: tokens that end at or before each character
        upto = np.searchsorted(ends, at_byte, side="right").tolist()
        marks = [(m.end(), _RANK[m.lastgroup]) for m in _BREAKS.finditer(text)]
        spots, ranks = [m[0] for m in marks], [m[1] for m in marks]
        snapped = self._landmarks(codes, spots)
        landmarks = sorted(snapped)
        out: list[tuple[int, int, int, int, str]] = []
        start = begin = 0
        while begin < len(text):
            room = most - (upto[begin] - upto[start])
            last = bisect_right(upto, upto[begin] + room, begin + 1) - 1
            if last >= len(text):
                end, kind = len(text), "end"
            else:
                end, kind = self._cut(text, upto, begin, last, room, landmarks, snapped, spots, ranks)
            n = self.span(text, upto, start, end)
            while n > most and end > begin + 1:
                last = max(begin + 1, bisect_right(upto, upto[end] - (n - most), begin + 1) - 1) if upto[end] - upto[begin] > 1 else begin + 1
                end, kind = self._cut(text, upto, begin, min(last, end - 1), room, landmarks, snapped, spots, ranks)
                n = self.span(text, upto, start, end)
            if n > most and begin > start:  # a single character and an overlap that leaves no room for it
                start = begin
                n = self.span(text, upto, start, end)
            out.append((start, end, n, begin - start, kind))
            begin = end
            start = begin if begin >= len(text) else self._back(text, upto, begin, overlap, out[-1][0])
        return out

    def _back(self, text: str, upto: list[int], begin: int, overlap: int, before: int) -> int:
        """The first character of the piece that begins at ``begin`` with ``overlap`` tokens of what stands before."""
        start = bisect_left(upto, upto[begin] - overlap, 0, begin) if overlap else begin
        while start < begin and _joins(text[start]):
            start += 1
        return max(start, before + 1) if start < begin else begin

    def _landmarks(self, codes: np.ndarray, spots: list[int]) -> dict[int, int]:
        """Natural boundaries that a landmark snaps to, with the least hash of theirs."""
        if not spots or len(codes) < WINDOW:
            return {}
        h = gram_hashes(codes, WINDOW)
        at = np.flatnonzero(h < np.uint64((1 << 64) // SPACING))
        edge = np.array(spots)
        right = np.minimum(np.searchsorted(edge, at), len(edge) - 1)
        left = np.maximum(right - 1, 0)
        near = np.where(np.abs(edge[right] - at) < np.abs(edge[left] - at), right, left)
        ok = np.abs(edge[near] - at) <= REACH
        out: dict[int, int] = {}
        for spot, v in zip(edge[near[ok]].tolist(), h[at[ok]].tolist(), strict=True):
            if v < out.get(spot, 1 << 64):
                out[spot] = v
        return out

    def _cut(self, text: str, upto: list[int], begin: int, last: int, room: int, landmarks: list[int], snapped: dict[int, int], spots: list[int], ranks: list[int]) -> tuple[int, str]:
        first = bisect_left(upto, upto[begin] + max(1, int(room * LEAST)), begin + 1, max(begin + 1, last))
        some = landmarks[bisect_left(landmarks, first) : bisect_right(landmarks, last)]
        if some:
            end = min(some, key=snapped.__getitem__)
            return end, KINDS[ranks[bisect_left(spots, end)]]
        a, b = bisect_left(spots, first), bisect_right(spots, last)
        if a < b:
            return spots[b - 1], KINDS[ranks[b - 1]]
        for kind, weak in zip(("clause", "word"), _WEAK, strict=True):
            found = [m.end() for m in weak.finditer(text, max(begin, first - 1), last) if first <= m.end() <= last]
            if found:
                return found[-1], kind
        end = max(last, begin + 1)
        while end > begin + 1 and end < len(text) and _joins(text[end]):
            end -= 1
        return end, "none"


def split(docs: DataFrame, limits: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", folder: str = tokens.FOLDER, name: str = tokens.VOCABULARY) -> DataFrame:
    """One row for each piece of every document that exceeds the limit of its source.

    ``(doc_id, source, piece_no, n_pieces, start_char, end_char, n_tokens, overlap_chars, overlap_tokens, boundary, piece)``. Pieces
    cover the text without a gap; ``n_tokens`` is what the tokenizer counts of the piece by itself and never exceeds the
    limit, except that a single character can't be cut. Null texts, documents within their limit and sources without a
    limit give no rows. ``limits`` has one row for each source, is a bounded list and is broadcast; texts are cut where
    they are read, whole, without a shuffle.
    """
    rules = F.broadcast(limits.select(F.col("source").alias("_source"), F.col("max_tokens").cast("int").alias("_most"), F.coalesce(F.col("overlap_tokens"), F.lit(0)).cast("int").alias("_overlap")).dropDuplicates(["_source"]))
    #: a text of n bytes has at most n tokens
    big = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).join(rules, F.col("source") == F.col("_source")).filter(F.octet_length("text") > F.col("_most")).drop("_source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker(folder, name)
        kinds = (pa.int64(), pa.string(), *[pa.int32()] * 7, pa.string(), pa.string())
        for b in batches:
            out = []
            for i, s, t, most, overlap in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                got = chunker.pieces(t, most, overlap) or []
                out += [(i, s, k, len(got), start, end, n, over, tokens.count(t[start : start + over], folder, name), kind, t[start:end]) for k, (start, end, n, over, kind) in enumerate(got)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=_SCHEMA_NAMES)

    return big.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(_SCHEMA_NAMES, ("long", "string", *["int"] * 7, "string", "string"), strict=True)))


def joined(pieces: DataFrame) -> DataFrame:
    """``(doc_id, text)``: the documents put together again from their pieces, overlaps left out. A document's pieces are no more than its text."""
    own = F.struct("piece_no", F.substr("piece", F.col("overlap_chars") + 1).alias("own"))
    return pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["own"]), "").alias("text"))


_SCHEMA_NAMES = ["doc_id", "source", "piece_no", "n_pieces", "start_char", "end_char", "n_tokens", "overlap_chars", "overlap_tokens", "boundary", "piece"]
