"""Queries that link records with side tables, compare harvests and reuse kept answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibloom.functions import columns as C
from bibloom.functions import scalar as S
from bibloom.operators import cache, cohesion, corpus, diff, linkage, people
from bibloom.plans import sqltext as X
from bibloom.plans.adapter import CTES, Model, sql

QUERIES = {}
SQL: dict[str, str] = {}


def query(text: str | None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf: f(Model(spark, sf))
        if text:
            SQL[f.__name__] = sql(text)
        return f

    return keep


# scalar rules over the whole tables

_NARROW = "translate({}, '０１２３４５６７８９－／．：；，（）ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ　', '0123456789-/.:;,()ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz ')"
_COMPACT = f"regexp_replace(regexp_replace(upper({_NARROW.format('issn')}), '(?:[EPL][\\s\\-]?)?ISSN(?:\\s*[\\-(]?\\s*(?:PRINT|ONLINE|ELECTRONIC|E|P|L)\\s*\\))?\\s*[:.=#]?', '', 'g'), '[\\s\\p{{Z}}\\p{{Cf}}\\p{{Pd}}−_./:·]+', '', 'g')"
_CHECK = " + ".join(f"{8 - i} * try_cast(substr(x, {i + 1}, 1) AS INTEGER)" for i in range(7))
_VALID = f"regexp_full_match(x, '[0-9]{{7}}[0-9X]') AND ({_CHECK} + CASE WHEN substr(x, 8, 1) = 'X' THEN 10 ELSE try_cast(substr(x, 8, 1) AS INTEGER) END) % 11 = 0"


@query(f"SELECT row_id, x AS compact, coalesce({_VALID}, false) AS valid FROM (SELECT row_id, {_COMPACT} AS x FROM journals)")
def issn_checksum(m):
    x = C.issn_compact(F.col("issn"))
    return m.table("journals").select("row_id", x.alias("compact"), F.coalesce(C.issn_ok(x), F.lit(False)).alias("valid"))


@query("""SELECT row_id, CASE WHEN lower(trim(doi)) IN ('', '-', 'n/a') THEN NULL ELSE regexp_replace(regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', ''), '\\.+$', '') END AS doi FROM papers""")
def doi_normalise(m):
    return m.table("papers").select("row_id", C.doi_key(F.col("doi")).alias("doi"))


_MONTH = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr(regexp_extract(pub_date, '[A-Za-z]+'), 1, 3)))"


@query(f"""SELECT row_id, coalesce(nullif(regexp_extract(pub_date, '[0-9]{{4}}'), ''), '1900') || '-' || lpad(CAST(coalesce(nullif({_MONTH}, 0), 1) AS VARCHAR), 2, '0') || '-' || lpad(CAST(least(greatest(coalesce(try_cast(list_last(regexp_extract_all(pub_date, '\\b([0-9]{{1,2}})\\b', 1)) AS INTEGER), 1), 1), 31) AS VARCHAR), 2, '0') AS date_iso FROM papers""")
def date_parts(m):
    return m.table("papers").select("row_id", S.parse_date(F.col("pub_date")).alias("date_iso"))


@query("SELECT row_id, 1 + (length(authors_str) - length(replace(authors_str, ';', ''))) AS n_listed, len(authors) AS n_entries, len(list_filter(authors, lambda a: coalesce(trim(a.last), '') = '' AND coalesce(trim(a.fore), '') = '' AND coalesce(trim(a.initials), '') = '' AND coalesce(trim(a.name), '') <> '')) AS n_consortia FROM papers")
def consortium_filter(m):
    e = F.filter("authors", lambda a: S.consortium(a["name"], a["last"], a["fore"], a["initials"]))
    return m.table("papers").select("row_id", (F.length("authors_str") - F.length(F.replace("authors_str", F.lit(";"), F.lit(""))) + 1).cast("long").alias("n_listed"), F.size("authors").cast("long").alias("n_entries"), F.size(e).cast("long").alias("n_consortia"))


@query("SELECT row_id, regexp_matches(title, '(?i)^\\s*(?:" + "|".join(S.CORRECTION_WORDS) + ")\\b') AS is_correction FROM papers")
def correction_titles(m):
    return m.table("papers").select("row_id", S.is_correction(F.col("title")).alias("is_correction"))


@query("SELECT row_id, CASE WHEN len(confirmed_by) > 0 THEN array_to_string(confirmed_by, '+') ELSE journal END AS label FROM papers")
def source_label(m):
    return m.table("papers").select("row_id", S.source_label(F.col("confirmed_by"), F.col("journal")).alias("label"))


@query("""SELECT work_id, CASE WHEN NOT (h OR l) THEN 'empty' WHEN h AND l THEN 'mixed' WHEN h THEN 'han' ELSE 'latin' END AS script FROM (SELECT work_id, coalesce(regexp_matches(title, '[一-鿿㐀-䶿]'), false) AS h, coalesce(regexp_matches(title, '[A-Za-zÀ-ɏ]'), false) AS l FROM works)""")
def script_class(m):
    return m.table("works").select("work_id", S.script_of(F.col("title")).alias("script"))


_LINK = r"""(?i)(https?://[^\s"<>]+)"""


@query("""SELECT rec_id, array_to_string(list_distinct(regexp_extract_all(doi, '(?i)(https?://[^\\s"<>]+)', 1)), ' ') AS links FROM chinese_records WHERE doi IS NOT NULL""")
def html_links(m):
    """Links found in a text cell by patterns in order, each once."""
    return m.table("chinese_records").filter("doi is not null").select("rec_id", F.array_join(S.html_links(F.col("doi"), (_LINK,)), " ").alias("links"))


# names over papers' bylines

CTES["byname"] = """SELECT row_id, CAST(snapshot_no AS BIGINT) AS corpus_id, a.name, a.last, a.fore, a.initials, a.orcid, a.affiliation, a.email, lower(trim(a.last)) || '|' || lower(substr(coalesce(nullif(trim(a.fore), ''), trim(a.initials), ''), 1, 1)) AS loose, lower(coalesce(nullif(trim(a.fore), ''), trim(a.initials), '')) AS given, nullif(trim(a.orcid), '') AS oid
  FROM (SELECT row_id, snapshot_no, unnest(authors) AS a FROM papers)"""
CTES["perloose"] = """SELECT corpus_id, loose, count(DISTINCT oid) AS n_owners, min(oid) AS one FROM byname GROUP BY 1, 2"""


def _names(m):
    p = m.table("papers").select("row_id", F.col("snapshot_no").cast("long").alias("corpus_id"), F.explode("authors").alias("a"))
    return p.select("row_id", "corpus_id", "a.*")


@query("""SELECT b.corpus_id, CASE WHEN oid IS NOT NULL THEN oid WHEN given = '' OR p.n_owners <> 1 THEN b.loose ELSE p.one END AS person_key, count(*) AS n FROM byname b JOIN perloose p ON p.corpus_id = b.corpus_id AND p.loose = b.loose GROUP BY 1, 2""")
def person_keys(m):
    return people.person_keys(_names(m)).groupBy("corpus_id", "person_key").agg(F.count("*").alias("n"))


@query("""SELECT corpus_id, person_key, arg_max(name, (c, length(name), name)) AS display_name, CAST(sum(c) AS BIGINT) AS n_entries FROM (SELECT b.corpus_id, CASE WHEN oid IS NOT NULL THEN oid WHEN given = '' OR p.n_owners <> 1 THEN b.loose ELSE p.one END AS person_key, name, count(*) AS c FROM byname b JOIN perloose p ON p.corpus_id = b.corpus_id AND p.loose = b.loose GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def display_name_mode(m):
    return people.display_names(people.person_keys(_names(m)))


@query("SELECT corpus_id, count(DISTINCT lower(last) || chr(1) || lower(coalesce(nullif(trim(fore), ''), trim(initials), ''))) AS n_strict, count(DISTINCT lower(last) || chr(1) || lower(substr(coalesce(nullif(trim(fore), ''), trim(initials), ''), 1, 1))) AS n_loose FROM byname GROUP BY 1")
def strict_loose_gap(m):
    return people.name_gap(_names(m))


@query("""SELECT corpus_id, CASE WHEN oid IS NOT NULL THEN 4 WHEN email ILIKE '%@example.org' OR email ILIKE '%.example.org' THEN 2 WHEN affiliation ILIKE '%hospital%' THEN 1 ELSE 0 END AS tier, count(*) AS n FROM byname GROUP BY 1, 2""")
def evidence_tier(m):
    e = _names(m)
    tier = S.evidence_tier(F.trim("orcid") != "", F.lit(False), S.email_matches(F.col("email"), ["example.org"]), S.affiliation_keyword(F.col("affiliation"), ["hospital"]).isNotNull())
    return e.groupBy("corpus_id", tier.alias("tier")).agg(F.count("*").alias("n"))


@query("""SELECT row_id, name FROM (SELECT *, regexp_replace(lower(strip_accents(last)), '[^a-z]+', '', 'g') AS s, regexp_replace(lower(strip_accents(coalesce(nullif(trim(fore), ''), initials, ''))), '[^a-z ]+', '', 'g') AS g FROM byname) WHERE s = 'wei' AND (trim(g) = '' OR trim(g)[1] = 'z')""")
def name_match(m):
    """Byline entries that can be the person typed as the first argument, by the rules for initials and given names."""
    return _names(m).filter(S.name_match("Wei Z", F.col("last"), F.col("fore"), F.col("initials"))).select("row_id", "name")


_AT = "list_position(list_transform(parts, lambda x: regexp_matches(lower(x), '{}')), true)"


@query(f"""SELECT label, count(*) AS n FROM (SELECT CASE WHEN i > 0 THEN CASE WHEN i > 1 THEN parts[i-1] || ', ' || parts[i] ELSE parts[1] END ELSE parts[1] END AS label FROM (SELECT parts, coalesce(nullif({_AT.format(S.INSTITUTION_WORDS)}, 0), {_AT.format(S.UNIT_WORDS)}) AS i FROM
  (SELECT list_filter(list_transform(string_split(string_split(regexp_replace(affiliation, '[\\w.+-]+@[\\w.-]+\\.\\w+', '', 'g'), ';')[1], ','), lambda x: regexp_replace(x, '^[ .]+|[ .]+$', '', 'g')), lambda x: x <> '') AS parts FROM byname WHERE trim(affiliation) <> ''))) GROUP BY 1""")
def affiliation_labels(m):
    return _names(m).filter(F.trim("affiliation") != "").select("row_id", S.affiliation_label(F.col("affiliation")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


# joins with side tables


_TITLE = "regexp_replace(lower(title), '[^a-z0-9一-鿿]', '', 'g')"


@query(f"""SELECT a.rec_id AS record_id, CASE WHEN b.base_id IS NOT NULL THEN 'cross' WHEN a.turn > 1 THEN 'internal' ELSE 'new' END AS outcome, b.base_id FROM (SELECT rec_id, key, CASE WHEN key IS NOT NULL THEN row_number() OVER (PARTITION BY key ORDER BY rec_id) END AS turn FROM (SELECT rec_id, CASE WHEN {_TITLE} <> '' AND pub_year IS NOT NULL THEN {_TITLE} || '|' || pub_year END AS key FROM chinese_records)) a
  LEFT JOIN (SELECT {_TITLE} || '|' || publication_year AS key, min(work_id) AS base_id FROM works WHERE {_TITLE} <> '' AND publication_year IS NOT NULL GROUP BY 1) b ON a.key = b.key""")
def title_year_merge(m):
    key = lambda y: F.when((F.regexp_replace(F.lower("title"), "[^a-z0-9一-鿿]", "") != "") & F.col(y).isNotNull(), F.concat_ws("|", F.regexp_replace(F.lower("title"), "[^a-z0-9一-鿿]", ""), F.col(y).cast("string")))
    base = m.table("works").select(F.col("work_id").alias("record_id"), key("publication_year").alias("key"))
    added = m.table("chinese_records").select(F.col("rec_id").alias("record_id"), key("pub_year").alias("key"))
    return linkage.title_year_merge(base, added).select("record_id", "outcome", "base_id")


_KEY = "regexp_replace(trim(regexp_replace(replace(lower(strip_accents({})), '&', ' and '), '[^a-z0-9一-鿿]+', ' ', 'g')), '^the ', '')"
_TOKENS = "list_filter(string_split({}, ' '), lambda t: t NOT IN ('the', 'of', 'and', 'for', 'in', 'on', 'a', 'an', 'de', 'der', 'die', 'das', ''))"
_SIGN = "array_to_string(list_transform({}, lambda t: t[1]), '')"
_FITS = "len(x) = len(y) AND len(x) > 0 AND len(list_filter(range(1, len(x) + 1), lambda i: NOT (starts_with(x[i], y[i]) OR starts_with(y[i], x[i])))) = 0 AND list_sum(list_transform(range(1, len(x) + 1), lambda i: least(length(x[i]), length(y[i])))) >= 6"


@query(f"""SELECT journal, CASE WHEN n1 = 1 THEN 'issn' WHEN n1 > 1 THEN 'ambiguous' WHEN n2 = 1 THEN 'name_exact' WHEN n2 > 1 THEN 'ambiguous' WHEN n3 = 1 THEN 'name_abbrev_official' WHEN n3 > 1 THEN 'ambiguous' WHEN n4 = 1 THEN 'name_abbrev' WHEN n4 > 1 THEN 'ambiguous' ELSE 'none' END AS route,
  CASE WHEN n1 IS NOT NULL THEN CASE WHEN n1 = 1 THEN e1 END WHEN n2 IS NOT NULL THEN CASE WHEN n2 = 1 THEN e2 END WHEN n3 IS NOT NULL THEN CASE WHEN n3 = 1 THEN e3 END WHEN n4 = 1 THEN e4 END AS entry, coalesce(n1, n2, n3, n4, 0) AS n_candidates FROM
  (SELECT journal, {X.issn('issn')} AS i, {_KEY.format('journal')} AS k FROM (SELECT journal, min(issn) AS issn FROM papers GROUP BY 1 UNION ALL SELECT DISTINCT host_journal, NULL FROM works)) n
  LEFT JOIN (SELECT {X.issn('issn')} AS i, min(ref_id) AS e1, count(DISTINCT ref_id) AS n1 FROM ref_values WHERE field_name = 'journal' AND {X.issn('issn')} IS NOT NULL GROUP BY 1) a ON a.i = n.i
  LEFT JOIN (SELECT k, min(ref_id) AS e2, count(DISTINCT ref_id) AS n2 FROM (SELECT ref_id, {_KEY.format('unnest([canonical, english_name])')} AS k FROM ref_values WHERE field_name = 'journal') WHERE k <> '' GROUP BY 1) b ON b.k = n.k
  LEFT JOIN (SELECT {_KEY.format('abbreviation')} AS k, min(ref_id) AS e3, count(DISTINCT ref_id) AS n3 FROM ref_values WHERE field_name = 'journal' AND {_KEY.format('abbreviation')} <> '' GROUP BY 1) c ON c.k = n.k
  LEFT JOIN (SELECT k, min(ref_id) AS e4, count(DISTINCT ref_id) AS n4 FROM (SELECT DISTINCT {_KEY.format('journal')} AS k FROM (SELECT journal FROM papers UNION SELECT host_journal FROM works)) u JOIN (SELECT ref_id, {_KEY.format('unnest([canonical, english_name])')} AS rk FROM ref_values WHERE field_name = 'journal') r ON (SELECT {_FITS} FROM (SELECT {_TOKENS.format('u.k')} AS x, {_TOKENS.format('r.rk')} AS y)) GROUP BY 1) d ON d.k = n.k""")
def journal_route_join(m):
    """Journals of the papers and works against the reference list by ISSN, by name, by the entry's own abbreviation, and by abbreviating each other."""
    names = m.table("papers").groupBy("journal").agg(F.min("issn").alias("issn"))
    ref = m.table("ref_values").filter("field_name = 'journal'").select(F.col("ref_id").alias("entry"), F.explode(F.array("canonical", "english_name")).alias("name"), F.col("abbreviation").alias("official_abbreviation"), "issn", F.lit(None).cast("string").alias("eissn"))
    return linkage.journal_routes(names.unionByName(m.table("works").select(F.col("host_journal").alias("journal"), F.lit(None).cast("string").alias("issn")).distinct()), ref)


@query("""SELECT journal, count(*) AS n_papers, arg_min(issn, row_id) AS issn, count(DISTINCT issn) AS n_issns FROM (SELECT journal, row_id, CASE WHEN """ + _VALID + """ THEN x END AS issn FROM (SELECT journal, row_id, """ + _COMPACT + """ AS x FROM papers) t) WHERE trim(journal) <> '' GROUP BY 1""")
def journal_worklist(m):
    return linkage.worklist(m.table("papers").withColumnRenamed("row_id", "record_id"))


@query("""SELECT journal_key, field, count(DISTINCT v) AS n_values FROM (SELECT journal_key, 'jcr_quartile' AS field, nullif(trim(jcr_quartile), '') AS v FROM journals UNION ALL SELECT journal_key, 'cas_major', nullif(trim(cas_major), '') FROM journals UNION ALL SELECT journal_key, 'is_warning', CAST(is_warning AS VARCHAR) FROM journals) WHERE v IS NOT NULL AND journal_key <> '' GROUP BY 1, 2 HAVING count(DISTINCT v) > 1""")
def edition_disagreement(m):
    return linkage.edition_disagreement(m.table("journals").filter("journal_key <> ''"), "journal_key", ("jcr_quartile", "cas_major", "is_warning"))


@query("""SELECT j.journal, CASE WHEN j.i IS NULL THEN 'no_issn' WHEN r.s IS NULL THEN 'unchecked' ELSE 'checked' END AS status, CASE WHEN j.i IS NOT NULL AND r.s IS NOT NULL THEN r.k END AS n_signals, r.s AS signals FROM
  (SELECT journal, min(CASE WHEN """ + _VALID + """ THEN x END) AS i FROM (SELECT journal, """ + _COMPACT + """ AS x FROM papers) t WHERE trim(journal) <> '' GROUP BY 1) j
  LEFT JOIN (SELECT i, string_agg(DISTINCT signal, '; ' ORDER BY signal) AS s, count(DISTINCT signal) AS k FROM (SELECT CASE WHEN """ + _VALID + """ THEN x END AS i, signal FROM (SELECT warning_level AS signal, """ + _COMPACT + """ AS x FROM journals) t) WHERE i IS NOT NULL AND signal IS NOT NULL GROUP BY 1) r ON r.i = j.i""")
def risk_join(m):
    return linkage.risk_join(m.table("papers"), m.table("journals").filter("warning_level is not null").select("issn", F.col("warning_level").alias("signal")))


@query(f"""WITH n AS (SELECT host_journal AS journal, count(*) AS n, {_TOKENS.format(_KEY.format('host_journal'))} AS tok FROM works WHERE trim(host_journal) <> '' GROUP BY 1), p AS (SELECT a.journal, b.journal AS anchor, b.n AS an FROM n a JOIN n b ON {_SIGN.format('a.tok')} = {_SIGN.format('b.tok')} AND (b.n > a.n OR b.n = a.n AND b.journal <= a.journal) AND (SELECT {_FITS} FROM (SELECT a.tok AS x, b.tok AS y)))
SELECT journal, arg_min(anchor, (-an, anchor)) AS anchor FROM p GROUP BY 1""")
def alias_groups(m):
    """Names of works' journals that abbreviate a commoner one."""
    return cohesion.alias_groups(m.table("works").filter("trim(host_journal) <> ''").groupBy(F.col("host_journal").alias("journal")).agg(F.count("*").alias("n")))


CTES["roster"] = "SELECT CAST(o_custkey % 25 AS BIGINT) AS corpus_id, c_mktsegment AS advisor, o_orderpriority AS degree, year(o_orderdate) AS graduation_year, o_custkey AS student_key FROM orders JOIN customer ON o_custkey = c_custkey"


def _roster(m):
    j = m.table("orders").join(m.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select((F.col("o_custkey") % 25).alias("corpus_id"), F.col("c_mktsegment").alias("advisor"), F.col("o_orderpriority").alias("degree"), F.year("o_orderdate").alias("graduation_year"), F.col("o_custkey").alias("student_key"))


@query("SELECT corpus_id, count(*) AS n_rows, count(DISTINCT advisor) AS n_advisors, count(*) FILTER (WHERE advisor = 'BUILDING' AND corpus_id % 2 = 0) AS n_matched, CASE WHEN bool_or(advisor = 'BUILDING' AND corpus_id % 2 = 0) THEN 'matched' WHEN count(DISTINCT advisor) = 1 THEN 'unverified_single' ELSE 'refused' END AS outcome FROM roster GROUP BY 1")
def roster_selection(m):
    return linkage.select_rows(_roster(m), (F.col("advisor") == "BUILDING") & (F.col("corpus_id") % 2 == 0))


@query("SELECT corpus_id, student_key, count(*) AS n_rows, count(DISTINCT degree) AS n_degrees, CAST(min(graduation_year) AS BIGINT) AS first_year, CAST(max(graduation_year) AS BIGINT) AS last_year, CASE WHEN count(*) > 1 AND count(DISTINCT degree) = count(*) THEN 'continuing_student' WHEN count(*) > 1 THEN 'same_name_same_degree' END AS flag FROM roster GROUP BY 1, 2")
def graduate_groups(m):
    return linkage.graduate_groups(_roster(m))


# two harvests: orders to 1999 and from 1997

CTES["harvest"] = "SELECT *, '10.1/' || record_id AS k FROM paper"


def _halves(m):
    keys = F.when(F.col("record_id") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("d:"), F.col("record_id").cast("string"))))
    p = m.papers.withColumn("keys", keys)
    return p.filter("year <= 1999"), p.filter("year >= 1997")


@query("""SELECT corpus_id, record_id, status FROM (SELECT corpus_id, record_id, CASE WHEN record_id % 10 = 0 THEN 'unkeyable_old' WHEN yr < 1997 THEN 'only_old' END AS status FROM paper WHERE yr <= 1999
  UNION ALL SELECT corpus_id, record_id, CASE WHEN record_id % 10 = 0 THEN 'unkeyable_new' WHEN yr > 1999 THEN 'only_new' END FROM paper WHERE yr >= 1997) WHERE status IS NOT NULL""")
def diff_papers(m):
    return diff.rows(*_halves(m))


CTES["old_people"] = "SELECT DISTINCT corpus_id, person FROM entry WHERE yr <= 1999"
CTES["new_people"] = "SELECT DISTINCT corpus_id, person FROM entry WHERE yr >= 1997"


@query("""SELECT corpus_id, person, 'only_old' AS status FROM (SELECT * FROM old_people EXCEPT SELECT * FROM new_people) UNION ALL SELECT corpus_id, person, 'only_new' FROM (SELECT * FROM new_people EXCEPT SELECT * FROM old_people)""")
def diff_people(m):
    side = lambda cond: m.entries.filter(cond).select("corpus_id", "person").distinct().withColumn("keys", F.array(F.col("person").cast("string")))
    return diff.rows(side("year <= 1999"), side("year >= 1997"), "person")


@query("""SELECT x.corpus_id, x.status, l.person, count(*) AS n_first FROM (SELECT corpus_id, record_id, CASE WHEN yr < 1997 THEN 'only_old' ELSE 'only_new' END AS status FROM paper WHERE record_id % 10 <> 0 AND (yr < 1997 OR yr > 1999)) x JOIN entry l ON l.record_id = x.record_id AND l.idx = 0 GROUP BY 1, 2, 3""")
def diff_first_slots(m):
    return diff.first_slot_holders(diff.rows(*_halves(m)), m.leads)


CTES["wins"] = "SELECT corpus_id, min(yr) FILTER (WHERE yr <= 1999) AS os, max(yr) FILTER (WHERE yr <= 1999) AS oe, min(yr) FILTER (WHERE yr >= 1997) AS ns, max(yr) FILTER (WHERE yr >= 1997) AS ne FROM paper GROUP BY 1"


@query("""SELECT corpus_id, true AS comparable, greatest(os, ns) AS shared_start, least(oe, ne) AS shared_end, array_to_string(list_filter(range(os, oe + 1), lambda y: y < ns OR y > ne), ',') AS only_old, array_to_string(list_filter(range(ns, ne + 1), lambda y: y < os OR y > oe), ',') AS only_new FROM wins""")
def diff_window(m):
    a, b = _halves(m)
    return diff.windows(corpus.window_years(a), corpus.window_years(b))


@query("""SELECT x.corpus_id, x.status, count(*) FILTER (WHERE p.yr BETWEEN greatest(os, ns) AND least(oe, ne)) AS inside, count(*) FILTER (WHERE NOT p.yr BETWEEN greatest(os, ns) AND least(oe, ne)) AS outside, 0 AS unknown FROM (SELECT corpus_id, record_id, CASE WHEN record_id % 10 = 0 THEN 'unkeyable_old' WHEN yr < 1997 THEN 'only_old' END AS status FROM paper WHERE yr <= 1999
  UNION ALL SELECT corpus_id, record_id, CASE WHEN record_id % 10 = 0 THEN 'unkeyable_new' WHEN yr > 1999 THEN 'only_new' END FROM paper WHERE yr >= 1997) x JOIN paper p ON p.record_id = x.record_id JOIN wins w ON w.corpus_id = x.corpus_id WHERE x.status IS NOT NULL GROUP BY 1, 2""")
def diff_tallies(m):
    a, b = _halves(m)
    shared = diff.windows(corpus.window_years(a), corpus.window_years(b))
    return diff.tallies(diff.rows(a, b), m.papers, shared)


# kept answers: the events of each user and type

_NOW, _AGE = "TIMESTAMP '2024-01-25 00:00:00'", 10


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(m):
    return cache.latest(m.table("events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query(f"""SELECT r.user_id, r.event_type, e.event_id IS NOT NULL AS hit, e.event_id, e.value FROM (SELECT DISTINCT user_id, event_type FROM events) r LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts >= {_NOW} - INTERVAL {_AGE} DAY) WHERE rn = 1) e ON e.user_id = r.user_id AND e.event_type = r.event_type""")
def ttl_cache_lookup(m):
    e = m.table("events")
    now = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return cache.lookup_fresh(e.select("user_id", "event_type").distinct(), e, ["user_id", "event_type"], "ts", "event_id", now, _AGE).select("user_id", "event_type", "hit", "event_id", "value")


@query(f"SELECT event_type AS status, count(*) AS n FROM events WHERE NOT (event_type = 'error' AND ts < {_NOW} - INTERVAL {_AGE} DAY) GROUP BY 1")
def cache_expiry(m):
    now = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return cache.stats(cache.expire(m.table("events"), "ts", "event_type", now, _AGE, "error"), "event_type")


@query("SELECT record_id, journal FROM (SELECT record_id, journal, row_number() OVER (PARTITION BY corpus_id, date_iso, journal ORDER BY record_id) AS rn FROM paper) WHERE rn = 1")
def dedup_first_wins(m):
    first = m.papers.groupBy("corpus_id", "date_iso", "journal").agg(F.min("record_id").alias("record_id"))
    return first.select("record_id", "journal")


@query("SELECT CAST(o_custkey AS BIGINT) AS key, min(o_orderkey) AS kept, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def dedup_lowest_id(m):
    return m.table("orders").groupBy(F.col("o_custkey").alias("key")).agg(F.min("o_orderkey").alias("kept"), F.count("*").alias("n")).filter("n > 1")
