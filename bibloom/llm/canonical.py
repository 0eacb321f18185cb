"""Freely typed values to the entries of a reference list, by a prefix-filtered set-similarity join."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.llm.folding import VARIANTS
from bibloom.runtime import forget, lookup, materialise

#: Words put before or after a name without being part of it (fixed values, in half width and lower case).
BEFORE = ("来自", "来源", "源自", "源", "摘自", "转自", "中国", "the", "from")
AFTER = ("见备注", "编辑部", "编委会", "杂志社", "出版社", "数据库", "导出", "检索", "下载", "平台", "网站", "database", "export")
_ISSUE = re.compile(r"[\s,，;；]*(?:19|20)\d\d\s*(?:年(?:\s*第?\s*\d+\s*[期卷])?)?\s*(?:[,，]?\s*\d+\s*\(\s*\d+(?:-\d+)?\s*\))?[\s.。]*$")
_TWO_FORMS = re.compile(r"^(?P<zh>.*?[㐀-鿿].*?)\s*[=/|(\[:;]\s*(?P<en>[a-z][a-z .&,'-]*[a-z.])\s*[)\]]?\s*$")
#: Least Jaccard similarity of the sets of characters and character pairs of two names. One edit takes at most three of n
#: tokens and gives three new ones, so names one edit apart have (n - 3) / (n + 3) at least, n being the longer's tokens.
MIN_JACCARD = 0.3


def one_edit(n: Column) -> Column:
    """The similarity that names of ``n`` tokens keep with one edit, never under MIN_JACCARD."""
    return F.greatest(F.lit(MIN_JACCARD), (n - 3) / (n + 3) - 1e-9)


def _plain(text: str) -> str:
    return "".join(VARIANTS.get(c, c) for c in unicodedata.normalize("NFKC", text).casefold())


def _letters(text: str) -> str:
    return "".join(c for c in text.replace("&", "and") if c.isalnum())


def readings(value: str) -> list[str]:
    """The names a cell may be meant to hold: as it stands, without issue data and added words, and either form of a bilingual one."""
    text = _plain(value).strip()
    out = [text, _ISSUE.sub("", text)]
    if m := _TWO_FORMS.match(out[-1]):
        out += [m["zh"], m["en"]]
    for x in list(out):
        y = x.strip(" \t　.。·;；:：,，《》\"'“”‘’【】[]()*")
        for _ in range(3):
            z = y
            for w in BEFORE:
                if z.startswith(w) and len(z) > len(w) + 1 and (not w.isascii() or not z[len(w)].isalnum()):
                    z = z[len(w) :].lstrip(" :：=-")
            for w in AFTER:
                if z.endswith(w) and len(z) > len(w) + 1:
                    z = z[: -len(w)].rstrip(" (（")
            if z == y:
                break
            y = z
            out.append(y)
    return list(dict.fromkeys(s for s in map(_letters, out) if s))


def tokens(name: str) -> list[str]:
    """Characters and character pairs, with marks at both ends; a repeated one counts with its number."""
    padded = f"^{name}$"
    out: dict[str, int] = {}
    marked = []
    for t in (*name, *(padded[i : i + 2] for i in range(len(padded) - 1))):
        out[t] = out.get(t, 0) + 1
        marked.append(t if out[t] == 1 else f"{t}{out[t]}")
    return marked


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [(i, r) for i, v in enumerate(b.column(1).to_pylist()) if v for r in readings(v)]
        at = pa.array([i for i, _ in got], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([r for _, r in got], pa.string()), pa.array([tokens(r) for _, r in got], pa.list_(pa.string()))], names=["key", "name", "tokens"])


def similarity_join(left: DataFrame, right: DataFrame, threshold: float | Callable[[Column], Column] = one_edit) -> DataFrame:
    """Pairs ``(field, name, entry, jaccard)`` of two tables ``(field, name, tokens)`` whose token sets reach ``threshold``.

    The threshold is a number, or rises with the tokens of the larger set. Tokens are ordered by how rare they are in both
    tables together. Two sets that reach t share a token of their first |x| - ceil(t|x|) + 1; only these prefixes are
    joined, under the length filter and the positional filter (what is left after the shared token must still suffice),
    and the Jaccard similarity of what remains is computed exactly. Empty token sets match nothing. Only prefixes are
    shuffled.
    """
    t = threshold if callable(threshold) else lambda n: F.lit(threshold)
    both = left.select("tokens").unionByName(right.select("tokens"))
    counts = materialise(both.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.count("*").alias("df")), "tokens")
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = F.size("tokens")
    p = lambda n: (n - F.ceil(t(n) * n) + 1).cast("int")

    def prefixes(side: DataFrame, name: str) -> DataFrame:
        # a common character is a hot key: its rows are spread by its count
        each = lookup(side.select("field", "name", size.alias("size"), F.explode("tokens").alias("t")), counts, "t", total, spread=F.xxhash64("field", "name"))
        order = each.groupBy("field", "name", F.col("size").alias("n")).agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "t"))), F.lit(1), p(F.col("n"))).alias("first"))
        return order.select("field", F.col("name").alias(name), F.col("n").alias(f"n_{name}"), F.posexplode("first").alias(f"at_{name}", "x")).select("*", F.col("x.t").alias("t")).drop("x")

    lp, rp = prefixes(left, "name"), prefixes(right, "entry")
    n, m = F.col("n_name"), F.col("n_entry")
    both_t = t(F.greatest(n, m))
    need = F.ceil(both_t / (1 + both_t) * (n + m) - 1e-9)
    met = lp.join(rp, ["field", "t"]).filter((n >= F.ceil(both_t * m - 1e-9)) & (m >= F.ceil(both_t * n - 1e-9)) & (1 + F.least(n - F.col("at_name") - 1, m - F.col("at_entry") - 1) + F.least("at_name", "at_entry") >= need))
    pairs = met.select("field", "name", "entry").distinct()
    full = pairs.join(left.select("field", "name", F.col("tokens").alias("a")), ["field", "name"]).join(right.select("field", F.col("name").alias("entry"), F.col("tokens").alias("b")), ["field", "entry"])
    shared = F.size(F.array_intersect("a", "b"))
    larger = F.greatest(F.size("a"), F.size("b"))
    return full.withColumns({"jaccard": shared / (F.size("a") + F.size("b") - shared), "least": t(larger)}).filter(F.col("jaccard") >= F.col("least")).select("field", "name", "entry", "jaccard")


def map_values(values: DataFrame, ref: DataFrame) -> DataFrame:
    """``(field, value)`` distinct cells → ``(field, value, ref_id, jaccard, margin)``, ``ref_id`` 0 for those that mean no entry.

    ``ref`` has ``field_name, ref_id`` and the names of an entry. Of all readings of a cell and all names of entries, the
    pair of the highest Jaccard similarity that reaches the threshold decides, of equals the smallest ref_id. ``margin`` is
    how far the next entry's best pair lies behind, null where there is none. Null and blank cells must be left out before.
    """
    keyed = values.select(F.concat_ws("\x1f", "field", "value").alias("key"), "value", "field")
    read = keyed.select("key", "value").mapInArrow(_read, "key string, name string, tokens array<string>").withColumn("field", F.substring_index("key", "\x1f", 1))
    read = materialise(read, "readings")
    names = ref.select(F.col("field_name").alias("field"), "ref_id", F.explode(F.array_compact(F.array("canonical", "english_name", "abbreviation"))).alias("value"))
    entry_names = names.select(F.concat_ws("\x1f", "field", F.col("ref_id").cast("string")).alias("key"), "value").mapInArrow(_plain_names, "key string, name string, tokens array<string>")
    entries = materialise(entry_names.select(F.substring_index("key", "\x1f", 1).alias("field"), F.substring_index("key", "\x1f", -1).cast("long").alias("ref_id"), "name", "tokens"), "entries")
    left = read.groupBy("field", "name").agg(F.first("tokens").alias("tokens"))
    right = entries.groupBy("field", "name").agg(F.first("tokens").alias("tokens"))
    near = similarity_join(left, right)
    ids = entries.groupBy("field", F.col("name").alias("entry")).agg(F.min("ref_id").alias("ref_id"))
    each = near.join(ids, ["field", "entry"]).join(read.select("field", "name", "key"), ["field", "name"]).groupBy("key", "ref_id").agg(F.max("jaccard").alias("jaccard"))
    # an entry gives one row at most for a cell, so what is sorted is never longer than the reference list
    best = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("jaccard")).alias("far"), "ref_id"))).alias("b"))
    first, second = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    out = keyed.join(best, "key", "left").select("field", "value", F.coalesce(first["ref_id"], F.lit(0).cast("long")).alias("ref_id"), (-first["far"]).alias("jaccard"), (second["far"] - first["far"]).alias("margin"))
    return out


def _plain_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = [_letters(_plain(v)) for v in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array([tokens(x) for x in names], pa.list_(pa.string()))], names=["key", "name", "tokens"])


def cells(df: DataFrame, row: str, fields: tuple[str, ...]) -> DataFrame:
    """``(row, field, value)`` of all cells that are not null or blank."""
    stacked = df.select(row, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("c")).select(F.col(row).alias("id"), "c.field", "c.value")
    return stacked.filter(F.col("value").rlike(r"[^\s\p{Z}\p{Cf}]"))


def canonical_values(df: DataFrame, ref: DataFrame, row: str = "rec_id", fields: tuple[str, ...] = ("journal", "source_db")) -> DataFrame:
    """``(field_name, rec_id, ref_id)`` of every cell that is not blank and not, as it stands, a canonical value of its field.

    Distinct cells are counted with partial aggregation, mapped once, and meet their rows again in a join in which a
    cell that fills a large share of all rows is spread over all tasks. An empty ``ref`` maps every cell to 0.
    """
    canon = F.broadcast(ref.select(F.col("field_name").alias("field"), F.col("canonical").alias("value")).distinct()) if _small(ref) else ref.select(F.col("field_name").alias("field"), F.col("canonical").alias("value")).distinct()
    typed = cells(df, row, fields).join(canon, ["field", "value"], "left_anti")
    counted = materialise(typed.groupBy("field", "value").agg(F.count("*").alias("n")), "typed")
    mapped = map_values(counted.select("field", "value"), ref)
    key: Column = F.concat_ws("\x1f", "field", "value")
    small = materialise(mapped.join(counted, ["field", "value"]).select(key.alias("key"), "ref_id", "n"), "mapped")
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = lookup(typed.select("id", "field", key.alias("key")), small, "key", total, spread=F.xxhash64("id"))
    forget(counted)
    return rows.select(F.col("field").alias("field_name"), F.col("id").alias(row), F.col("ref_id"))


def _small(ref: DataFrame, most: int = 100_000) -> bool:
    """Whether a reference list is short enough to be sent to every task."""
    return ref.limit(most + 1).count() <= most
