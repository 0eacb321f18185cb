"""Delimited lines that fail to parse: minimum-cost error parse, typed tests, and the split into good and bad rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibloom.functions import columns as C

#: Columns of a line, by the table it is meant for.
LAYOUTS = {
    "chinese_records": ("title", "authors", "authors_pinyin", "journal", "pub_year", "source_db", "retrieved_on", "doi"),
    "journals": ("issn", "eissn", "journal", "impact_factor", "jcr_quartile", "source_edition", "retrieved_on"),
}
_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
_GOOD = re.compile(f"{_FIELD}(?:,{_FIELD})*")
_ONE = re.compile(r'("(?:[^"]|"")*"|[^",\r\n]*)(,|$)')
_TOKENS = re.compile(r'[^",\r\n]+|[",\r\n]')
START, PLAIN, QUOTED, AFTER = range(4)
#: A quote edit outweighs any number of delimiter edits, so that a line needs quote edits only if its quoting is wrong.
QUOTE_EDIT, DELIMITER_EDIT = 1 << 20, 1


def fields_of(line: str) -> list[str]:
    """Fields of a line whose quoting is right."""
    out, at = [], 0
    while True:
        m = _ONE.match(line, at)
        f = m.group(1)
        out.append(f[1:-1].replace('""', '"') if f[:1] == '"' else f)
        if not m.group(2):
            return out
        at = m.end()


def error_parse(line: str, columns: int) -> tuple[list[str], str | None, list[str]]:
    """Fields, fault and edits of the cheapest repair of ``line`` into ``columns`` fields.

    Dynamic programme over the line's tokens, the lexer's state and the number of delimiters passed. An edit deletes or
    inserts a quote or a delimiter; to delete a delimiter joins two fields, each of which keeps its own quotes. One
    inserted between a quote and text, or that takes out a line break, counts as a quote edit. So a line whose quoting is
    right is repaired by delimiter edits alone, and no other line is. fault is null at cost 0, ``quoting`` if any repair needs a quote edit, else ``column_count``. An empty line is one
    empty field.
    """
    tokens = _TOKENS.findall(line)
    best: dict[tuple[int, int], tuple[int, tuple]] = {(START, 0): (0, ())}
    last = columns - 1

    def spread(layer: dict, follows: str | None) -> None:
        """Insertions before the next token; each state can be improved by a later one, hence the loop."""
        queue = list(layer)
        while queue:
            s, k = key = queue.pop()
            cost, path = layer[key]
            steps = []
            if s != PLAIN:
                steps.append(({START: QUOTED, QUOTED: AFTER, AFTER: QUOTED}[s], k, QUOTE_EDIT, "insert quote"))
            if s != QUOTED and k < last:
                steps.append((START, k + 1, QUOTE_EDIT if s == AFTER and follows not in (None, ",") or s == PLAIN and follows == '"' else DELIMITER_EDIT, "insert delimiter"))
            for s2, k2, c, op in steps:
                if cost + c < layer.get((s2, k2), (1 << 60,))[0]:
                    layer[s2, k2] = (cost + c, (path, "i" + op[7]))
                    queue.append((s2, k2))

    for i, t in enumerate(tokens):
        spread(best, t)
        after: dict[tuple[int, int], tuple[int, tuple]] = {}
        follows = tokens[i + 1] if i + 1 < len(tokens) else None

        def put(s: int, k: int, cost: int, path: tuple) -> None:
            if k <= last and cost < after.get((s, k), (1 << 60,))[0]:  # noqa: B023
                after[s, k] = (cost, path)  # noqa: B023

        for (s, k), (cost, path) in best.items():
            if t == '"':
                if s != PLAIN:
                    put({START: QUOTED, QUOTED: AFTER, AFTER: QUOTED}[s], k, cost, (path, t))
                put(s, k, cost + QUOTE_EDIT, (path, "dq"))
            elif t == ",":
                put(QUOTED if s == QUOTED else START, k + (s != QUOTED), cost, (path, t))
                if s != QUOTED:
                    put(START, k, cost + DELIMITER_EDIT, (path, "dd"))
            elif t in "\r\n":
                if s == QUOTED:
                    put(s, k, cost, (path, t))
                else:
                    put(s, k, cost + QUOTE_EDIT, (path, "dn"))
            elif s == QUOTED:
                put(s, k, cost, (path, t))
            elif s != AFTER:  # after a closing quote only an inserted one, see spread(), can go on
                put(PLAIN, k, cost, (path, t))
        best = after
    spread(best, None)
    cost, path = min((best[s, last] for s in (START, PLAIN, AFTER) if (s, last) in best), key=lambda x: x[0])
    steps = []
    while path:
        path, step = path
        steps.append(step)
    fields, edits = _replay(steps[::-1])
    return fields, _name(cost), edits


def _name(cost: int) -> str | None:
    return "quoting" if cost >= QUOTE_EDIT else "column_count" if cost else None


def _replay(steps: list[str]) -> tuple[list[str], list[str]]:
    """Fields and edits in words, from the steps of the cheapest path."""
    words = {"iq": "insert quote", "id": "insert delimiter", "dq": "delete quote", "dd": "delete delimiter", "dn": "delete line break"}
    fields, edits, state, at = [""], [], START, 0
    for x in steps:
        op = words.get(x) if len(x) == 2 and x in words else None
        if op:
            edits.append(f"{op} at {at}")
        c = {"iq": '"', "id": ","}.get(x, x) if op else x
        if x in ("dq", "dd", "dn") and op:
            state = START if x == "dd" else state
            at += 1
            continue
        if c == '"' and state != PLAIN:
            if state == AFTER:
                fields[-1] += '"'
            state = {START: QUOTED, QUOTED: AFTER, AFTER: QUOTED}[state]
        elif c == "," and state != QUOTED:
            fields.append("")
            state = START
        else:
            if state == START:
                state = PLAIN
            fields[-1] += c
        at += 0 if op else len(x)
    return fields, edits


def parse_line(line: str, columns: int) -> tuple[list[str], str | None, list[str]]:
    """As error_parse(), with lines that cost nothing told by one regular expression."""
    if _GOOD.fullmatch(line) and len(found := fields_of(line)) == columns:
        return found, None, []
    return error_parse(line, columns)


def parse_lines(df: DataFrame, line: str = "raw_line", table: str = "target_table", layouts: dict[str, tuple[str, ...]] = LAYOUTS) -> DataFrame:
    """``df`` with ``fields`` (array, null for an unknown table), ``fault`` and ``edits`` added.

    Null lines count as empty ones; lines of a table without layout get the fault ``unknown_table``. Columns of ``df``
    named like the three are replaced. No shuffle: lines are parsed where they are read, in Arrow batches.
    """
    keep = [f for f in df.schema.fields if f.name not in ("fields", "fault", "edits")]
    extra = [("fields", pa.list_(pa.string())), ("fault", pa.string()), ("edits", pa.list_(pa.string()))]
    sizes = {k: len(v) for k, v in layouts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse_line(x or "", sizes[t]) if t in sizes else (None, "unknown_table", []) for x, t in zip(b.column("__line").to_pylist(), b.column("__table").to_pylist(), strict=True)]
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([f[i] for f in found], type=kind) for i, (_, kind) in enumerate(extra))], names=[*(f.name for f in keep), *(n for n, _ in extra)])

    schema = T.StructType([*keep, T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("fault", T.StringType()), T.StructField("edits", T.ArrayType(T.StringType()))])
    return df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(line).alias("__line"), F.col(table).alias("__table")).mapInArrow(run, schema)


def year_fault(c: Column) -> Column:
    """Whether the cell fails to state exactly one calendar year from 1949 to 2026; null and blank fail."""
    return C.one_year(c).isNull()


def issn_fault(c: Column) -> Column:
    """Whether the cell is neither blank nor exactly one ISSN with the right check digit."""
    return ~C.blank(c) & C.valid_issn(c).isNull()


def typed_reason(table: str = "target_table", layouts: dict[str, tuple[str, ...]] = LAYOUTS) -> Column:
    """The first reason that applies to a parsed line: its fault, then the typed test of its table."""
    at = lambda t, f: F.get("fields", F.lit(layouts[t].index(f)))
    return F.coalesce(
        F.col("fault"),
        F.when((F.col(table) == "chinese_records") & year_fault(at("chinese_records", "pub_year")), F.lit("pub_year")),
        F.when((F.col(table) == "journals") & issn_fault(at("journals", "issn")), F.lit("issn")),
    )


def split_rows(raw: DataFrame) -> DataFrame:
    """raw_rows with ``fields``, ``edits`` and ``reason``; the rows with a null reason are the ones to load."""
    return parse_lines(raw).withColumn("reason", typed_reason()).drop("fault")


def load_good(raw: DataFrame, table: str) -> DataFrame:
    """The valid lines meant for ``table``, one string column for each field, blank cells as null."""
    good = split_rows(raw.filter(F.col("target_table") == table)).filter("reason is null")
    return good.select("raw_id", *[F.nullif(F.trim(F.get("fields", F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(LAYOUTS[table])])


def bad_rows(records: DataFrame, journals: DataFrame, raw: DataFrame) -> DataFrame:
    """Every bad row of the three tables as ``(reason, row_key, table_name)``.

    Works on null cells, empty tables and tables with further columns; a row is bad once, by the first reason.
    """
    one = lambda df, key, bad, reason, name: df.filter(bad).select(F.lit(reason).alias("reason"), F.col(key).cast("long").alias("row_key"), F.lit(name).alias("table_name"))
    parsed = parse_lines(raw.select("raw_id", "target_table", "raw_line")).select("raw_id", typed_reason().alias("reason"))
    return (
        one(records, "rec_id", year_fault(F.col("pub_year_raw")), "pub_year", "chinese_records")
        .unionByName(one(journals, "row_id", issn_fault(F.col("issn")), "issn", "journals"))
        .unionByName(parsed.filter("reason is not null").select("reason", F.col("raw_id").cast("long").alias("row_key"), F.lit("raw_rows").alias("table_name")))
    )
