"""Schemas of the corpus model and the header names of side tables."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import types as T

S, L, B, I = T.StringType(), T.LongType(), T.BooleanType(), T.IntegerType()  # noqa: E741
_f = T.StructField

AUTHOR = T.StructType([*[_f(n, S) for n in ("name", "last", "fore", "initials", "affiliation")], _f("is_corresponding", B), _f("email", S), _f("orcid", S), _f("equal_contrib", B), _f("openalex_author_id", S), _f("name_zh", S)])
PAPER = T.StructType([
    *[_f(n, S) for n in ("pmid", "title", "authors_str")], _f("authors", T.ArrayType(AUTHOR)), *[_f(n, S) for n in ("journal", "issn", "issn_type", "issn_linking", "journal_abbrev", "pub_date", "pub_year", "volume", "issue", "pages", "doi", "pmc_id", "abstract", "role", "source")],
    _f("confirmed_by", T.ArrayType(S)), _f("openalex_work_id", S), _f("openalex_author_ids", T.ArrayType(S)),
])
QUERY = T.StructType([*[_f(n, S) for n in ("term", "mindate", "maxdate")], *[_f(n, L) for n in ("years_back", "retmax", "esearch_count", "pmids_returned", "max_records", "pages_fetched", "duplicates_dropped")], _f("truncated", B)])
IDENTITY = T.StructType([_f("author_name", S), _f("orcid", S), _f("affiliation_keywords", T.ArrayType(S)), _f("email_domains", T.ArrayType(S)), _f("openalex_author_id", S), _f("require_affiliation_effective", B)])
COUNTS = T.StructType([*[_f(n, L) for n in ("fetched", "verified", "rejected", "corpus_total", "name_only")], _f("by_evidence", T.MapType(S, L)), _f("by_source", T.MapType(S, L))])
CORPUS = T.StructType([_f("schema_version", I), _f("generated_at", S), _f("position_filtered", B), _f("query", QUERY), _f("identity", IDENTITY), _f("counts", COUNTS), _f("fallback_fired", B), _f("papers", T.ArrayType(PAPER))])

#: Columns of the side tables: whether each must be there, and other header names for it (fixed values, folded).
TABLES: dict[str, dict[str, tuple[bool, tuple[str, ...]]]] = {
    "journals": {
        "issn": (True, ("刊号", "国际刊号")), "journal": (True, ("期刊", "刊名", "期刊名称", "journalname")), "source_edition": (True, ("版本", "数据版本")), "retrieved_on": (True, ("检索日期", "获取日期")), "eissn": (False, ("电子刊号",)), "impact_factor": (False, ("影响因子", "if")),
        "if_year": (False, ("影响因子年份",)), "jcr_quartile": (False, ("分区", "jcr分区", "quartile")), "cas_major": (False, ("中科院大类分区", "大类")), "cas_minor": (False, ("中科院小类分区", "小类")), "is_warning": (False, ("预警", "是否预警")), "warning_level": (False, ("预警级别",)), "notes": (False, ("备注",)),
    },
    "theses": {
        "advisor": (True, ("导师", "指导教师")), "student": (True, ("学生", "作者", "研究生")), "degree": (True, ("学位",)), "graduation_year": (True, ("毕业年份", "年份")), "source_db": (True, ("来源库", "数据库")), "export_date": (True, ("导出日期",)),
        "advisor_latin": (False, ("导师拼音",)), "student_latin": (False, ("学生拼音",)), "enrolment_year": (False, ("入学年份",)), "title": (False, ("题名", "论文题目")), "institution": (False, ("单位", "学校")),
    },
    "evaluations": {
        "advisor": (True, ("导师",)), "source": (True, ("来源",)), "retrieved_on": (True, ("检索日期",)), "content": (False, ("内容", "评价")), "rating": (False, ("评分",)), "advisor_latin": (False, ("导师拼音",)), "student_role": (False, ("身份",)), "year": (False, ("年份",)), "url": (False, ("链接",)),
    },
    "chinese_records": {
        "title": (True, ("题名", "标题", "篇名")), "authors": (True, ("作者",)), "authors_pinyin": (True, ("作者拼音",)), "journal": (True, ("期刊", "刊名")), "pub_year": (True, ("年份", "年")), "source_db": (True, ("来源库", "数据库")), "retrieved_on": (True, ("检索日期",)),
        "issn": (False, ("刊号",)), "doi": (False, ()), "volume": (False, ("卷",)), "issue": (False, ("期",)), "pages": (False, ("页码",)), "abstract": (False, ("摘要",)), "index_status": (False, ("收录",)), "institution": (False, ("单位",)), "notes": (False, ("备注",)),
    },
}


def fold_header(text: str) -> str:
    """A header in lower case and half width without punctuation and white space."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text).lower())


def resolve_headers(headers: list[str], table: str) -> tuple[dict[str, str], list[str]]:
    """Which header is which column, and the headers that are none.

    Two headers for one column are refused, and so is a file without a column that must be there.
    """
    names = {fold_header(x): c for c, (_, others) in TABLES[table].items() for x in (c, *others)}
    found: dict[str, str] = {}
    rest = []
    for h in headers:
        c = names.get(fold_header(h.lstrip("﻿")))
        if c is None:
            rest.append(h)
        elif c in found.values():
            raise ValueError(f"two columns for {c}: {[k for k, v in found.items() if v == c] + [h]}")
        else:
            found[h] = c
    missing = [c for c, (must, _) in TABLES[table].items() if must and c not in found.values()]
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    return found, rest
