"""SQL text for identifiers, years, serial numbers and delimited lines, in the dialect of the checking engine."""

from __future__ import annotations

from collections.abc import Callable

from bibloom.functions import columns as C
from bibloom.operators.badrows import LAYOUTS

_SPACE = r"[\s\p{Z}\p{Cf}]+"


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _translate(x: str, table: dict) -> str:
    keep = {(k if isinstance(k, str) else chr(k)): (v if isinstance(v, str) else chr(v)) for k, v in table.items()}
    return f"translate({x}, {text(''.join(keep))}, {text(''.join(keep.values()))})"


def narrow(x: str) -> str:
    return _translate(x, C._WIDE)


def digits(x: str) -> str:
    return _translate(x, {**C._DIGITS, **C._HAN_DIGITS})


def replaced(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {text(pattern)}, {text(by)}, 'g')"


def blank(x: str) -> str:
    return f"coalesce(NOT regexp_matches({x}, '[^\\s\\p{{Z}}\\p{{Cf}}]'), true)"


def no_filler(x: str) -> str:
    return f"CASE WHEN NOT {blank(x)} AND lower({narrow(f'trim({x})')}) NOT IN ({', '.join(map(text, C.FILLERS))}) THEN {x} END"


def pmid(x: str) -> str:
    bare = replaced(f"lower({digits(narrow(no_filler(x)))})", _SPACE)
    bare = replaced(bare, r"^(?:https?://)?(?:www\.)?(?:pubmed\.ncbi\.nlm\.nih\.gov/|ncbi\.nlm\.nih\.gov/pubmed/)?(?:pmid)?[:#.=]*")
    return f"nullif({replaced(bare, '^0+|[./]+$')}, '')"


def doi(x: str) -> str:
    bare = replaced(replaced(f"lower({narrow(no_filler(x))})", _SPACE), r"^(?:(?:https?://)?(?:dx\.|www\.)?doi\.org/|doi[:=]*)+")
    bare = replaced(bare, "[.。]+$")
    return f"CASE WHEN regexp_matches({bare}, '[0-9]') THEN {bare} END"


def years(x: str) -> str:
    """The distinct years that a cell states."""
    runs = f"regexp_extract_all({digits(x)}, '[0-9]+')"
    date = "(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])"
    return f"list_distinct(list_concat(list_filter({runs}, lambda r: length(r) = 4), list_transform(list_filter({runs}, lambda r: regexp_full_match(r, '{date}')), lambda r: r[1:4])))"


def one_year(x: str) -> str:
    return f"(SELECT CASE WHEN len(y) = 1 AND y[1]::int BETWEEN 1949 AND 2026 THEN y[1]::int END FROM (SELECT {years(x)} AS y))"


def issn(x: str) -> str:
    """The serial number in a cell as eight characters, or null."""
    bare = replaced(f"upper({narrow(x)})", r"(?:[EPL][\s\-]?)?ISSN(?:\s*[\-(]?\s*(?:PRINT|ONLINE|ELECTRONIC|E|P|L)\s*\))?\s*[:.=#]?")
    bare = replaced(bare, r"[\s\p{Z}\p{Cf}\p{Pd}−_./:·]+")
    total = "list_sum(list_transform(range(1, 8), lambda i: s[i]::int * (9 - i)))"
    return f"(SELECT CASE WHEN regexp_full_match(s, '[0-9]{{7}}[0-9X]') THEN CASE WHEN ({total} + CASE WHEN s[8] = 'X' THEN 10 ELSE s[8]::int END) % 11 = 0 THEN s END END FROM (SELECT {bare} AS s))"


_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'


def well_quoted(line: str) -> str:
    return f"regexp_full_match({line}, {text(f'{_FIELD}(?:,{_FIELD})*')})"


def fields(line: str) -> str:
    """The fields of a well quoted line."""
    got = f"regexp_extract_all(',' || {line}, {text(f',({_FIELD})')}, 1)"
    return f"""list_transform({got}, lambda f: CASE WHEN f[1] = '"' THEN replace(f[2:-2], '""', '"') ELSE f END)"""


#: raw_rows with ``fields`` and ``reason``.
PARSED = f"""
cut AS (SELECT *, {well_quoted("coalesce(raw_line, '')")} AS ok FROM raw_rows),
split AS (SELECT *, CASE WHEN ok THEN {fields("coalesce(raw_line, '')")} END AS fields FROM cut),
parsed AS (SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN len(fields) <> CASE target_table {' '.join(f"WHEN '{t}' THEN {len(c)}" for t, c in LAYOUTS.items())} END THEN 'column_count'
    WHEN target_table = 'chinese_records' AND {one_year('fields[5]')} IS NULL THEN 'pub_year' WHEN target_table = 'journals' AND NOT {blank('fields[1]')} AND {issn('fields[1]')} IS NULL THEN 'issn' END AS reason FROM split)"""


def loaded(table: str, typed: dict[str, Callable[[str], str]]) -> str:
    cells = {c: f"nullif(trim(fields[{i + 1}], ' '), '')" for i, c in enumerate(LAYOUTS[table])}
    return f"WITH {PARSED} SELECT raw_id, {', '.join(f'{typed[c](x) if c in typed else x} AS {c}' for c, x in cells.items())} FROM parsed WHERE target_table = '{table}' AND reason IS NULL"


BAD_ROWS = f"""WITH {PARSED}
SELECT 'pub_year' AS reason, rec_id AS row_key, 'chinese_records' AS table_name FROM chinese_records WHERE {one_year('pub_year_raw')} IS NULL
UNION ALL SELECT 'issn', row_id, 'journals' FROM journals WHERE NOT {blank('issn')} AND {issn('issn')} IS NULL
UNION ALL SELECT reason, raw_id, 'raw_rows' FROM parsed WHERE reason IS NOT NULL"""

_PLAIN = ("title", "authors_str", "journal", "issn", "pub_date", "pub_year", "volume", "issue", "pages", "pmc_id", "abstract")
_plain = lambda x: f"coalesce({no_filler(x)}, '')"
_AUTHOR = " || chr(31) || ".join(_plain(f"a.{x}") if x not in ("equal_contrib", "is_corresponding") else f"coalesce(a.{x}::varchar, '')" for x in ("name", "last", "fore", "initials", "affiliation", "email", "orcid", "equal_contrib", "is_corresponding"))

#: The changes between snapshots of papers, with both row numbers.
CHANGES = f"""WITH RECURSIVE keyed AS (SELECT *, {pmid('pmid')} AS pk, {doi('doi')} AS dk FROM papers),
base AS (SELECT row_id, snapshot_no::bigint AS snap, coalesce(pk, '') || chr(31) || coalesce(dk, '') AS node, pk, dk,
    coalesce(pk, '') || chr(29) || coalesce(dk, '') || chr(29) || {" || chr(29) || ".join(_plain(c) for c in _PLAIN)}
    || chr(29) || coalesce(array_to_string(list_transform(authors, lambda a: {_AUTHOR}), chr(30)), '') || chr(29) || coalesce(array_to_string(list_transform(confirmed_by, lambda a: {_plain('a')}), chr(30)), '') AS content
    FROM keyed WHERE pk IS NOT NULL OR dk IS NOT NULL),
held AS (SELECT DISTINCT node, 'p' || pk AS k FROM base WHERE pk IS NOT NULL UNION SELECT DISTINCT node, 'd' || dk FROM base WHERE dk IS NOT NULL),
hub AS (SELECT k, min(node) AS h FROM held GROUP BY 1),
link AS (SELECT DISTINCT node AS a, h AS b FROM held JOIN hub USING (k) WHERE node <> h), ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT DISTINCT node AS root, node FROM held UNION SELECT root, b FROM reach JOIN ways ON a = node),
label AS (SELECT node, min(root) AS paper FROM reach GROUP BY 1),
contents AS (SELECT paper, snap, content, min(row_id) AS row_id FROM base JOIN label USING (node) GROUP BY ALL),
sets AS (SELECT paper, snap, string_agg(content, chr(28) ORDER BY content) AS all_of, min(row_id) AS row_id FROM contents GROUP BY ALL),
pairs AS (SELECT coalesce(b.snap, a.snap + 1) AS snapshot_no, a.row_id AS old_row_id, b.row_id AS new_row, a.all_of AS old_all, b.all_of AS new_all FROM sets a FULL JOIN sets b ON a.paper = b.paper AND b.snap = a.snap + 1),
changes AS (SELECT CASE WHEN old_row_id IS NULL THEN 'added' WHEN new_row IS NULL THEN 'removed' ELSE 'changed' END AS change_type, coalesce(new_row, old_row_id) AS row_id, snapshot_no, old_row_id, new_row
    FROM pairs WHERE snapshot_no > (SELECT min(snap) FROM base) AND snapshot_no <= (SELECT max(snap) FROM base) AND old_all IS DISTINCT FROM new_all)"""

VALUES = CHANGES + """ SELECT change_type, c.snapshot_no, c.row_id, old_row_id, n.pmid, o.pmid AS old_pmid, n.doi, o.doi AS old_doi, n.title, o.title AS old_title
FROM changes c LEFT JOIN papers n ON n.row_id = new_row LEFT JOIN papers o ON o.row_id = old_row_id"""


# names


def script(x: str) -> str:
    han, latin = f"regexp_matches({x}, '[一-鿿㐀-䶿]')", f"regexp_matches({x}, '[A-Za-zÀ-ɏ]')"
    return f"CASE WHEN {x} IS NULL OR NOT ({han} OR {latin}) THEN 'empty' WHEN {han} AND {latin} THEN 'mixed' WHEN {han} THEN 'han' ELSE 'latin' END"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(strip_accents({narrow(x)})), '[a-z]+')"


def forms(t: str) -> str:
    return f"list_transform(range(1, len({t}) + 1), lambda i: array_to_string(list_concat({t}[i:], CASE WHEN i > 1 THEN {t}[1:i-1] ELSE [] END), ''))"


def covered(s: str, l: str) -> str:
    many = f"len(list_filter({s}, lambda x: starts_with(x, w))) > len(list_filter({l}, lambda x: starts_with(x, w)))"
    same = f"len(list_filter({s}, lambda x: x = w)) > len(list_filter({l}, lambda x: x = w))"
    short = f"len({s}) < len({l}) OR len({s}) = len({l}) AND len(list_filter({s}, lambda x: length(x) = 1)) > 0"
    return f"(len({s}) > 0 AND ({short}) AND len(list_filter(list_distinct({s}), lambda w: CASE WHEN length(w) = 1 THEN {many} ELSE {same} END)) = 0)"


def name_level(a: str, b: str) -> str:
    """Agreement of two names, from columns ``{a}_name``, ``{a}_script``, ``{a}_tokens`` and ``{a}_forms`` and those of ``b``."""
    sa, sb, ta, tb = f"{a}_script", f"{b}_script", f"{a}_tokens", f"{b}_tokens"
    han = lambda x: f"regexp_replace({x}_name, '[^一-鿿㐀-䶿]', '', 'g')"
    return f"""CASE WHEN {sa} = 'empty' OR {sb} = 'empty' THEN NULL WHEN {sa} = 'han' AND {sb} = 'han' THEN CASE WHEN {han(a)} = {han(b)} THEN 'exact' END
    WHEN {sa} <> {sb} AND {sa} <> 'mixed' AND {sb} <> 'mixed' THEN 'undecidable_script' WHEN NOT ({sa} = 'latin' OR {sb} = 'latin') OR len({ta}) = 0 OR len({tb}) = 0 THEN NULL
    WHEN {ta} = {tb} THEN CASE WHEN len({ta}) = 1 THEN 'partial_name' ELSE 'exact' END WHEN list_has_any({a}_forms, {b}_forms) THEN 'name_form' WHEN {covered(ta, tb)} OR {covered(tb, ta)} THEN 'partial_name' END"""


def name_columns(x: str, of: str) -> str:
    """The columns that name_level() needs of the name ``of``."""
    return f"{of} AS {x}_name, {script(of)} AS {x}_script, coalesce({tokens(of)}, []) AS {x}_tokens, {forms(f'coalesce({tokens(of)}, [])')} AS {x}_forms"
