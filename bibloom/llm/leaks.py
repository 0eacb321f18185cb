"""Evaluation passages inside training text: rare n-gram seeds join them to documents, Smith-Waterman alignment decides, and a check tells verbatim runs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm import folding
from bibloom.runtime import forget, lookup, materialise, rows_of

#: Verbatim runs that make a leak: words of an English passage, characters of a Chinese one.
WORDS, CHARACTERS = 16, 30
#: Characters in a seed; both are powers of two, and a run of WORDS or CHARACTERS holds many.
SEED_EN, SEED_ZH = 16, 8
#: A gram is common wording if it stands in more documents than this many times the median of its item's grams; all others are seeds.
COMMON = 4
#: Bits of the filter that finds grams of the items in texts, for each gram, at least and at most in all, and probes of each.
BITS_A_GRAM, LEAST_BITS, MOST_BITS, PROBES = 64, 22, 27, 6
MATCH, MISMATCH, GAP = 2, -2, -2
#: Share of the best possible score from which a copy is one however edited; what scores less must hold a verbatim run.
LEAST_SHARE = 0.3
#: Pairs aligned at once, and places of their bands and items together, unless one pair alone has more.
ALIGNED, PLACES = 256, 1 << 20
#: Texts that are arrays, and rows of pairs that are Python objects, at one time.
ROWS = 1024
_M = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` codes (a power of two), by doubling: log2(k) passes over the array."""
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint64) + np.uint64(0x1234567)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        width, m = 1, _M
        while width < k:
            if len(h) <= width:
                return h[:0]
            h = h[:-width] * m + h[width:]
            m = m * m + np.uint64(2)
            width *= 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(31))


@dataclass
class Item:
    """A passage as folded codes, with the runs that count as leaked and the length of its grams."""

    item_id: int
    codes: np.ndarray
    k: int
    runs: list[tuple[int, int]]


def _words(text: str) -> list[int]:
    """Starts of the words among the folded codes, and their number at the end."""
    f, _, _ = folding.fold([text])
    kept = f != folding.SKIP
    before = np.concatenate([[0], np.cumsum(kept)])
    start = np.flatnonzero(kept & ~np.concatenate([[False], kept[:-1]]))
    return [int(before[i]) for i in start] + [int(before[-1])]


def make_item(item_id: int, passage: str | None, lang: str | None) -> Item | None:
    """Items whose passage is too short for any run, or null, can't leak and are left out. A run of 16 words is at least as long as a seed."""
    if not passage:
        return None
    f, _, _ = folding.fold([passage])
    codes = f[f != folding.SKIP]
    han = int(((codes >= 0x3400) & (codes < 0xA000)).sum())
    if lang == "zh" or lang != "en" and han * 2 > len(codes):
        runs = [(i, i + CHARACTERS) for i in range(len(codes) - CHARACTERS + 1)]
        k = SEED_ZH
    else:
        w = _words(passage)
        runs = [(w[i], w[i + WORDS]) for i in range(len(w) - WORDS)]
        k = SEED_EN
    return Item(item_id, codes, k, runs) if runs else None


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _as_text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _as_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_ITEMS = "item_id long, k int, codes string, least int, runs array<int>"
_GRAMS = "item_id long, k int, at int, gram long, last int"


def _read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's folded text, the length of its shortest run, and for every place of its text the end of the run that begins there, or 0."""
    for b in batches:
        got = [x for x in map(make_item, *(b.column(i).to_pylist() for i in range(3))) if x]
        runs = []
        for x in got:
            ends = np.zeros(len(x.codes), dtype=np.int32)
            for start, end in x.runs:
                ends[start] = end
            runs.append(ends.tolist())
        yield pa.RecordBatch.from_arrays([pa.array([x.item_id for x in got], pa.int64()), pa.array([x.k for x in got], pa.int32()), pa.array([_as_text(x.codes) for x in got], pa.string()), pa.array([min(e - s for s, e in x.runs) for x in got], pa.int32()), pa.array(runs, pa.list_(pa.int32()))], names=["item_id", "k", "codes", "least", "runs"])


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every gram of every item with its place, and the last place at which a gram of the run that begins there begins (-1: no run begins there)."""
    for b in batches:
        for item, k, codes, runs in zip(*(b.column(c).to_pylist() for c in ("item_id", "k", "codes", "runs")), strict=True):
            h = gram_hashes(_as_codes(codes), k)
            n = len(h)
            ends = np.array(runs[:n], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, item)), pa.array(np.full(n, k, dtype=np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(_signed(h)), pa.array(np.where(ends > 0, ends - k, -1).astype(np.int32))], names=["item_id", "k", "at", "gram", "last"])


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The filter's bits of each hash, one probe after the other; the mask of who is left is sent back."""
    step = (h >> np.uint64(64 - bits)) | np.uint64(1)
    mask = np.uint64((1 << bits) - 1)
    with np.errstate(over="ignore"):
        for i in range(PROBES):
            keep = yield (h + np.uint64(i) * step) & mask
            if keep is not None:
                h, step = h[keep], step[keep]


def _filter_of(bits: int):
    """The filter's bits that are set by a partition of grams, packed, for each gram length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            ks, h = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for k in np.unique(ks):
                t = tables.setdefault(int(k), np.zeros(1 << bits, dtype=bool))
                for at in _probes(h[ks == k], bits):
                    t[at] = True
        for k, t in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(t).tobytes()], pa.binary())], names=["k", "bits"])

    return run


def gram_filter(grams: DataFrame) -> tuple[int, dict[int, np.ndarray]]:
    """A Bloom filter of the items' grams for each gram length: of bounded size, whatever the test set, built in up to eight parts."""
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(BITS_A_GRAM * max(1, rows_of(grams)))))))
    out: dict[int, np.ndarray] = {}
    for r in grams.select("k", "gram").distinct().coalesce(8).mapInArrow(_filter_of(bits), "k int, bits binary").toLocalIterator():
        part = np.frombuffer(r["bits"], dtype=np.uint8)
        out[r["k"]] = part | out[r["k"]] if r["k"] in out else part
    return bits, out


_HOLDING = "doc_id long, lo long, stretch string, k array<int>, at array<int>, gram array<long>, of_doc array<long>"


def _scan(bits: int, packed: dict[int, np.ndarray], longest: int):
    """Finds grams of the items in texts and cuts out the stretches around them.

    A stretch is as wide as the longest item on either side of its hits; hits nearer than twice that share one. The
    first stretch of a document carries the distinct grams of all of it.
    """
    wide = longest + longest // 8 + 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.unpackbits(v).astype(bool) for k, v in packed.items()}
        names = [x.split()[0] for x in _HOLDING.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for b in (whole.slice(x, ROWS) for whole in batches for x in range(0, whole.num_rows, ROWS)):
            ids = b.column(0).to_pylist()
            f, at, _ = folding.fold([x or "" for x in b.column(1).to_pylist()])
            kept = f != folding.SKIP
            codes = f[kept]
            start = np.concatenate([[0], np.cumsum(kept)])[at]
            hits = []
            for k, table in tables.items():
                h = gram_hashes(codes, k)
                pos, left = np.arange(len(h)), h
                probe = _probes(h, bits)
                bit = next(probe)
                for i in range(PROBES):
                    keep = table[bit]
                    pos, left = pos[keep], left[keep]
                    bit = probe.send(keep) if i + 1 < PROBES else bit
                text = np.searchsorted(start, pos, side="right") - 1
                inside = pos + k <= start[text + 1]
                hits.append(np.stack([text[inside], pos[inside], _signed(left[inside]), np.full(int(inside.sum()), k)]))
            t, pos, gram, k = np.concatenate(hits, axis=1)
            order = np.lexsort((pos, t))
            t, pos, gram, k = t[order], pos[order], gram[order], k[order]
            cut = np.flatnonzero((np.diff(t) != 0) | (np.diff(pos) > 2 * wide)) + 1
            rows, before = [], -1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(t)], strict=True) if len(t) else ():
                doc = int(t[x])
                lo, hi = max(int(start[doc]), int(pos[x]) - wide), min(int(start[doc + 1]), int(pos[y - 1]) + wide)
                whole = np.unique(gram[t == doc]).tolist() if doc != before else None
                before = doc
                rows.append((ids[doc], lo - int(start[doc]), _as_text(codes[lo:hi]), k[x:y].astype(np.int32).tolist(), (pos[x:y] - lo).astype(np.int32).tolist(), gram[x:y].tolist(), whole))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return run


def _seeds_of_item(t: pa.Table) -> pa.Table:
    """The places of one item at which seeds begin: grams that are no common wording, and the rarest of every run, the first of equals."""
    order = np.argsort(t.column("at").to_numpy())
    at, df, gram, last = (t.column(c).to_numpy()[order] for c in ("at", "df", "gram", "last"))
    chosen = df <= COMMON * np.median(df[df > 0]) if (df > 0).any() else np.zeros(len(df), dtype=bool)
    for i in np.flatnonzero(last >= 0):
        part = df[i : last[i] + 1]
        if part.min() > 0:  # a run with a gram that stands nowhere stands nowhere
            chosen[i + int(part.argmin())] = True
    chosen &= df > 0
    n = int(chosen.sum())
    return pa.table({"item_id": pa.array(t.column("item_id").to_numpy()[:1].repeat(n)), "at": pa.array(at[chosen]), "gram": pa.array(gram[chosen])})


def align(a: list[np.ndarray], b: list[np.ndarray], low: list[int], high: list[int]) -> np.ndarray:
    """Smith-Waterman scores of the best local alignments of pairs of code arrays within a band, all pairs at once.

    Place i of ``a`` meets places i + low to i + high of ``b``. Arrays have a row for each place of the band and a column
    for each pair, so that every step is one pass over contiguous numbers; gaps along the band are settled by a running
    maximum, as their cost is linear. Padding matches nothing, so it adds nothing to a score.
    """
    n, width, k = max(map(len, a), default=0), max((h - l + 1 for l, h in zip(low, high, strict=True)), default=0), len(a)
    rows = np.full((n, k), 0xFFFFFFFE, dtype=np.uint32)
    band = np.full((n + width, k), 0xFFFFFFFF, dtype=np.uint32)
    for i, (x, y, lo) in enumerate(zip(a, b, low, strict=True)):
        rows[: len(x), i] = x
        part = y[max(0, lo) : max(0, lo + n + width)]
        band[max(0, -lo) : max(0, -lo) + len(part), i] = part[: n + width - max(0, -lo)]
    kind = np.int16 if MATCH * n - GAP * width < 32000 else np.int32
    inside = np.arange(width)[:, None] <= np.array([h - l for l, h in zip(low, high, strict=True)])[None, :]
    whole = bool(inside.all())
    h = np.zeros((width + 1, k), dtype=kind)
    ramp = (np.arange(width) * -GAP).astype(kind)[:, None]
    best = np.zeros((width, k), dtype=kind)
    new = np.empty((width, k), dtype=kind)
    for i in range(n):
        np.multiply(band[i : i + width] == rows[i], kind(MATCH - MISMATCH), out=new, dtype=kind, casting="unsafe")
        new += kind(MISMATCH)
        new += h[:-1]
        np.maximum(new, h[1:] + kind(GAP), out=new)
        np.maximum(new, 0, out=new)
        new += ramp
        np.maximum.accumulate(new, axis=0, out=new)
        new -= ramp
        if not whole:
            new *= inside
        np.maximum(best, new, out=best)
        h[:-1] = new
    return best.max(axis=0, initial=0)


def verbatim(codes: str, runs: list[int], segment: str) -> bool:
    """Whether one of the item's runs stands in the segment."""
    return any(codes[a:b] in segment for a, b in enumerate(runs) if b)


def _clusters(diagonals: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Bands of diagonals to align: from the seeds' own, an eighth of the item's length to either side; bands that meet are one."""
    margin = size // 8 + 16
    lo = last = diagonals[0]
    for d in diagonals[1:]:
        if d - last > 2 * margin:
            yield lo - margin, last + margin
            lo = d
        last = d
    yield lo - margin, last + margin


def _batches(todo: list[tuple[int, int, int]], codes: list[str]) -> Iterator[list[tuple[int, int, int]]]:
    """Pairs in the order of their bands, as many at once as ALIGNED and PLACES allow."""
    part: list[tuple[int, int, int]] = []
    size = 0
    for x in todo:
        size = max(size, x[2] - x[1] + 2 * len(codes[x[0]]))
        if part and (len(part) >= ALIGNED or size * (len(part) + 1) > PLACES):
            yield part
            part, size = [], x[2] - x[1] + 2 * len(codes[x[0]])
        part.append(x)
    if part:
        yield part


_SCHEMA = "doc_id long, item_id long, score double, verbatim boolean"


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of an item and a stretch whose alignment scores at least what a verbatim run of the required length does, and LEAST_SHARE unless there is such a run."""
    for b in (whole.slice(x, ROWS) for whole in batches for x in range(0, whole.num_rows, ROWS)):
        doc, item, diagonals, stretch, codes, least, runs = (b.column(c).to_pylist() for c in ("doc_id", "item_id", "diagonals", "stretch", "codes", "least", "runs"))
        todo = [(i, lo, hi) for i, (d, c) in enumerate(zip(diagonals, codes, strict=True)) for lo, hi in _clusters(sorted(d), len(c))]
        todo.sort(key=lambda x: (x[2] - x[1], len(codes[x[0]])))
        best: dict[int, int] = {}
        exact: set[int] = set()
        for part in _batches(todo, codes):
            scores = align([_as_codes(codes[i]) for i, _, _ in part], [_as_codes(stretch[i]) for i, _, _ in part], [lo for _, lo, _ in part], [hi for _, _, hi in part])
            for (i, lo, hi), score in zip(part, scores.tolist(), strict=True):
                if score >= MATCH * least[i]:
                    best[i] = max(best.get(i, 0), score)
                    if i not in exact and verbatim(codes[i], runs[i], stretch[i][max(0, lo) : len(codes[i]) + hi]):
                        exact.add(i)
        got = sorted(i for i in best if i in exact or best[i] >= LEAST_SHARE * MATCH * len(codes[i]))
        yield pa.RecordBatch.from_arrays([pa.array([doc[i] for i in got], pa.int64()), pa.array([item[i] for i in got], pa.int64()), pa.array([best[i] / (MATCH * len(codes[i])) for i in got], pa.float64()), pa.array([i in exact for i in got], pa.bool_())], names=["doc_id", "item_id", "score", "verbatim"])


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", lang: str = "lang") -> DataFrame:
    """``(doc_id, item_id, score, verbatim)`` of every document that an item's passage leaked into, verbatim or edited.

    A pair leaks if the Smith-Waterman score of the passage against the document is at least that of a verbatim run of 16
    words (English) or 30 characters (Chinese), case, width, white space and punctuation being disregarded, and either
    such a run stands there in one piece (``verbatim``) or the score is at least LEAST_SHARE of the passage's best
    possible. ``score`` is that share.

    1. One scan of the documents finds the grams of the passages by a filter of bounded size and cuts out the stretches
       around them; what follows reads these only. Long documents are searched whole.
    2. Grams are joined with the passages' own (which removes what the filter let through by chance) and counted over all
       documents. All but common wording are seeds, and the rarest of every run is one, so that no run lacks a seed.
    3. Seeds join passages to stretches; each pair is one row, spread over all tasks however many documents one item
       leaked into, and is aligned around its seeds.
    Null or empty texts and passages match nothing; an empty table on either side gives no rows. Document ids must be unique.
    """
    spark = docs.sparkSession
    own = materialise(items.select(F.col(item).cast("long"), F.col(passage), F.col(lang)).mapInArrow(_read_items, _ITEMS), "items")
    longest = own.agg(F.max(F.length("codes"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], _SCHEMA)
    grams = materialise(own.mapInArrow(_item_grams, _GRAMS), "grams")
    scan = _scan(*gram_filter(grams), longest)
    holding = materialise(docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, _HOLDING), "holding")
    df = holding.select(F.explode("of_doc").alias("gram")).join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    counted = grams.join(df, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    seeds = counted.groupBy("item_id").applyInArrow(_seeds_of_item, "item_id long, at int, gram long")
    by_gram = materialise(seeds.groupBy("gram").agg(F.collect_list(F.struct("item_id", "at")).alias("of")).join(df.withColumnRenamed("df", "n"), "gram"), "seeds")
    hits = materialise(holding.select("doc_id", "lo", F.explode(F.arrays_zip("at", "gram")).alias("h")).select("doc_id", "lo", F.col("h.at").alias("pos"), "h.gram"), "hits")
    met = lookup(hits, by_gram, "gram", rows_of(hits), spread=F.xxhash64("doc_id", "pos")).filter("of is not null").select("doc_id", "lo", "pos", F.explode("of").alias("of"))
    pairs = materialise(met.groupBy("doc_id", "lo", F.col("of.item_id").alias("item_id")).agg(F.collect_set(F.col("pos") - F.col("of.at")).alias("diagonals")), "pairs")
    sized = materialise(own.drop("k").join(pairs.groupBy("item_id").agg(F.count("*").alias("n")), "item_id"), "sized")
    full = lookup(pairs, sized, "item_id", rows_of(pairs), spread=F.xxhash64("doc_id", "lo")).join(holding.select("doc_id", "lo", "stretch"), ["doc_id", "lo"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialise(full.repartition(parts, "doc_id", "lo", "item_id").mapInArrow(_aligned, _SCHEMA), "leaks")
    forget(own, grams, holding, by_gram, hits, pairs, sized)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.bool_or("verbatim").alias("verbatim"))


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(docs, items).filter("verbatim").select("doc_id", "item_id").distinct()
