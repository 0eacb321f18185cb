"""Column expressions for identifiers, years and numbers. All run inside the JVM; none needs Python workers."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width ASCII forms and the ideographic space, by rule.
_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20}
#: Every decimal digit of Unicode, by rule, and the Chinese numerals that stand for one digit.
_DIGITS = {c: str(unicodedata.decimal(chr(c))) for c in range(0x80, min(sys.maxunicode, 0x1FFFF)) if unicodedata.decimal(chr(c), None) is not None}
_HAN_DIGITS = dict(zip("〇○零一二三四五六七八九", "000123456789", strict=True))

#: Words that stand for "nothing" in an identifier or text cell (fixed values, compared trimmed and in lower case).
FILLERS = ("n/a", "na", "nan", "none", "null", "nil", "unknown", "-", "--", "---", "—", "/", "?", "tbd", "无", "暂无", "未知", "不详", "待补", "待查", "空")


def translate(c: Column, table: dict) -> Column:
    """translate() with a table of one character to one or none."""
    keep = {k: v for k, v in table.items() if v}
    drop = [k for k, v in table.items() if not v]
    return F.translate(c, "".join(map(_ch, [*keep, *drop])), "".join(map(_ch, keep.values())))


def _ch(x: int | str) -> str:
    return chr(x) if isinstance(x, int) else x


def narrow(c: Column) -> Column:
    """Full-width forms in half width."""
    return translate(c, _WIDE)


def ascii_digits(c: Column) -> Column:
    """Digits of any script, and Chinese numerals, as 0 to 9."""
    return translate(c, {**{chr(k): v for k, v in _DIGITS.items()}, **_HAN_DIGITS})


def stated_years(c: Column) -> Column:
    """The distinct four-digit runs of ``c``, in digits of any script, and the years of eight-digit dates."""
    d = ascii_digits(c)
    runs = F.regexp_extract_all(d, F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), F.lit(1))
    dates = F.regexp_extract_all(d, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?![0-9])"), F.lit(1))
    return F.array_distinct(F.concat(runs, dates))


def one_year(c: Column, first: int = 1949, last: int = 2026) -> Column:
    """The calendar year that ``c`` states, or null where it states none, several, or one outside the range."""
    years = stated_years(c)
    year = F.get(years, F.lit(0)).cast("int")
    return F.when((F.size(years) == 1) & year.between(first, last), year)


def issn_compact(c: Column) -> Column:
    """The cell in capitals and half width, without an ISSN label, separators and white space."""
    up = F.upper(narrow(c))
    bare = F.regexp_replace(up, r"(?:[EPL][\s\-]?)?ISSN(?:\s*[\-(]?\s*(?:PRINT|ONLINE|ELECTRONIC|E|P|L)\s*\))?\s*[:.=#]?", "")
    return F.regexp_replace(bare, r"[\s\p{Z}\p{Cf}\p{Pd}−_./:·]+", "")


def issn_ok(compact: Column) -> Column:
    """Whether ``compact`` is eight characters of an ISSN whose last is the right check digit."""
    total = F.lit(0)
    for i in range(7):
        total = total + F.substring(compact, i + 1, 1).try_cast("int") * F.lit(8 - i)
    last = F.substring(compact, 8, 1)
    check = F.when(last == "X", F.lit(10)).otherwise(last.try_cast("int"))
    return F.coalesce(compact.rlike("^[0-9]{7}[0-9X]$") & (F.pmod(total + check, F.lit(11)) == 0), F.lit(False))


def valid_issn(c: Column) -> Column:
    """The ISSN in ``c`` as eight characters, or null."""
    x = issn_compact(c)
    return F.when(issn_ok(x), x)


def blank(c: Column) -> Column:
    """Null, empty or only white space of any kind."""
    return c.isNull() | ~c.rlike(r"[^\s\p{Z}\p{Cf}]")


def no_filler(c: Column) -> Column:
    """``c``, or null where it is blank or a filler word."""
    return F.when(~blank(c) & ~F.lower(narrow(F.trim(c))).isin(*FILLERS), c)


def pmid_key(c: Column) -> Column:
    """PMID without prefix, padding and leading zeros; null for fillers."""
    x = F.regexp_replace(F.lower(ascii_digits(narrow(no_filler(c)))), r"[\s\p{Z}\p{Cf}]+", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^(?:https?://)?(?:www\.)?(?:pubmed\.ncbi\.nlm\.nih\.gov/|ncbi\.nlm\.nih\.gov/pubmed/)?(?:pmid)?[:#.=]*", ""), r"^0+|[./]+$", "")
    return F.when(x != "", x)


def doi_key(c: Column) -> Column:
    """DOI in lower case without resolver or label, padding and final full stops; null for fillers."""
    x = F.regexp_replace(F.lower(narrow(no_filler(c))), r"[\s\p{Z}\p{Cf}]+", "")
    x = F.regexp_replace(x, r"^(?:(?:https?://)?(?:dx\.|www\.)?doi\.org/|doi[:=]*)+", "")
    x = F.regexp_replace(x, r"[.。]+$", "")
    return F.when((x != "") & x.rlike("[0-9]"), x)
