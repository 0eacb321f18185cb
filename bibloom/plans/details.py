"""Queries of the finer points: statuses, gaps, ties, refusals, counterparts, windows, gates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibloom.functions import scalar as S
from bibloom.operators import cache, corpus, diff, impact, metrics, quality, reports, scoring
from bibloom.plans import sqltext as X
from bibloom.plans.adapter import CTES, Model, sql
from bibloom.plans.impact_and_scores import _parts
from bibloom.runtime import materialise
from bibloom.sources import files

QUERIES = {}
SQL: dict[str, str] = {}


def query(text: str | None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf: f(Model(spark, sf))
        if text:
            SQL[f.__name__] = sql(text)
        return f

    return keep


# records left out, on the papers of each snapshot

_BARE = "nullif(lower(trim({})), '')"


@query(f"""SELECT row_id AS record_id, CASE WHEN early IS NOT NULL THEN early WHEN dup_p THEN 'duplicate_pmid' WHEN d IS NOT NULL AND row_number() OVER (PARTITION BY snapshot_no, coalesce(d, row_id::varchar || '#'), early IS NULL AND NOT dup_p ORDER BY try_cast(p AS BIGINT) NULLS LAST, p NULLS FIRST, row_id) > 1 THEN 'duplicate_doi' WHEN n >= 50 THEN 'hyperauthorship' END AS reason FROM
  (SELECT *, p IS NOT NULL AND early IS NULL AND row_number() OVER (PARTITION BY snapshot_no, coalesce(p, row_id::varchar || '#'), early IS NULL ORDER BY row_id) > 1 AS dup_p FROM
  (SELECT row_id, snapshot_no, len(authors) AS n, {_BARE.format('pmid')} AS p, {_BARE.format('doi')} AS d, CASE WHEN NOT coalesce(regexp_matches(pub_date, '[0-9]{{4}}'), false) THEN 'unparseable_date' WHEN coalesce(regexp_matches(title, '(?i)^\\s*(?:{'|'.join(S.CORRECTION_WORDS)})\\b'), false) THEN 'correction_or_comment' WHEN len(authors) = 0 THEN 'empty_author_list' END AS early FROM papers))""")
def exclusion_papers(m):
    """Why each paper of a snapshot is left out: dates, corrections, bylines, repeated PMIDs and DOIs, and sizes as they stand."""
    p = m.table("papers").select(F.col("snapshot_no").alias("corpus_id"), F.col("row_id").alias("record_id"), "pmid", "doi", "title", "pub_date", F.lit(None).cast("int").alias("year"), F.size("authors").alias("n"))
    return corpus.exclusion_reasons(p, F.col("n")).select("record_id", "reason")


# citations in their reference distribution: half of the papers state no identifier or topic where their order has none

CTES["asked"] = """SELECT record_id, CASE WHEN status <> 'O' OR cites > 3 THEN topic END AS topic, CASE WHEN status <> 'O' OR cites > 5 THEN yr END AS yr, cites + CASE WHEN topic = 'BUILDING' THEN 100 ELSE 0 END AS cites, cites <> 1 AS has_identifier, cites = 2 AS lookup_failed FROM paper"""
CTES["refcell"] = "SELECT topic, yr, cites, count(*) AS n FROM paper WHERE cites IS NOT NULL AND (topic <> 'MACHINERY' OR yr > 1994) GROUP BY 1, 2, 3"
CTES["refsize"] = "SELECT topic, yr, sum(n) AS population, max(cites) AS top FROM refcell GROUP BY 1, 2"


def _placed(m):
    p = m.papers
    asked = p.select(
        "record_id", F.when((F.col("status") != "O") | (F.col("cites") > 3), F.col("topic")).alias("topic"), F.when((F.col("status") != "O") | (F.col("cites") > 5), F.col("year")).alias("year"), (F.col("cites") + F.when(F.col("topic") == "BUILDING", 100).otherwise(0)).alias("cites"), (F.col("cites") != 1).alias("has_identifier"), (F.col("cites") == 2).alias("lookup_failed"),
    )
    return impact.percentiles(asked, impact.reference_cells(p.filter("topic <> 'MACHINERY' or year > 1994")))


_STATUS = """CASE WHEN p.cites IS NULL THEN 'no_citation_count' WHEN NOT has_identifier THEN 'no_identifier' WHEN lookup_failed THEN 'topic_lookup_failed' WHEN p.topic IS NULL THEN 'no_topic' WHEN p.yr IS NULL THEN 'no_year' WHEN s.population IS NULL THEN 'distribution_unavailable' WHEN s.population < 100 THEN 'distribution_too_small' ELSE 'located' END"""


@query(f"""SELECT record_id, status, CASE WHEN status = 'located' THEN tied END AS tied, CASE WHEN status = 'located' THEN round(100.0 * below / population, 6) END AS percentile, CASE WHEN status = 'located' THEN round(tied / population, 6) END AS tied_share, CASE WHEN status = 'located' THEN round(100.0 / population, 6) END AS points_a_paper, CASE WHEN status = 'located' THEN cites > top END AS above_max FROM
  (SELECT record_id, p.cites, s.population, s.top, {_STATUS} AS status, coalesce(q.below, 0) AS below, coalesce(q.tied, 0) AS tied FROM asked p LEFT JOIN refsize s ON s.topic = p.topic AND s.yr = p.yr
  LEFT JOIN (SELECT a.topic, a.yr, a.cites, sum(n) FILTER (WHERE c.cites < a.cites) AS below, sum(n) FILTER (WHERE c.cites = a.cites) AS tied FROM (SELECT DISTINCT topic, yr, cites FROM asked) a JOIN refcell c ON c.topic = a.topic AND c.yr = a.yr GROUP BY 1, 2, 3) q ON q.topic = p.topic AND q.yr = p.yr AND q.cites = p.cites)""")
def citation_place(m):
    """All statuses of a paper's place in its distribution; counts that the distribution doesn't hold, and over its greatest."""
    return _placed(m).select("record_id", "status", "tied", *[F.round(c, 6).alias(c) for c in ("percentile", "tied_share", "points_a_paper")], "above_max")


@query("SELECT s AS status, coalesce(n, 0) AS n FROM (SELECT unnest([" + ", ".join(f"'{s}'" for s in impact.STATUSES) + f"]) AS s) LEFT JOIN (SELECT {_STATUS} AS status, count(*) AS n FROM asked p LEFT JOIN refsize s ON s.topic = p.topic AND s.yr = p.yr GROUP BY 1) ON status = s")
def citation_statuses(m):
    return impact.status_counts(_placed(m))


@query("SELECT corpus_id, status AS cite_source, count(*) AS n, count(*) OVER (PARTITION BY corpus_id) > 1 AS mixed_sources FROM paper WHERE cites IS NOT NULL GROUP BY 1, 2")
def citation_sources(m):
    return impact.source_histogram(m.papers.withColumn("cite_source", F.col("status")))


# trends


@query("""SELECT corpus_id, yr::double AS year, 'repeated_year' AS fault FROM (SELECT corpus_id, status, CASE WHEN status <> 'P' THEN yr END AS yr, count(*) AS c FROM paper GROUP BY 1, 2, 3) WHERE yr IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1
  UNION ALL SELECT DISTINCT corpus_id, NULL::double, 'no_year' FROM paper WHERE status = 'P'""")
def trend_faults(m):
    """Series with a year given once for each status, and none for one of them."""
    s = m.papers.groupBy("corpus_id", "status", F.when(F.col("status") != "P", F.col("year")).alias("year")).agg(F.count("*").alias("count"))
    return metrics.trend_faults(s)


@query("""SELECT corpus_id, min(yr) AS first, max(yr) AS last, array_to_string(list_filter(range(min(yr), max(yr) + 1), lambda y: NOT list_contains(list(DISTINCT yr), y)), ',') AS gaps, coalesce(string_agg(CASE WHEN yr <= lo OR yr >= hi - 1 THEN yr::varchar END, ',' ORDER BY yr), '') AS censored, avg(yr) AS centre FROM (SELECT DISTINCT p.corpus_id, yr, lo, hi FROM paper p JOIN (SELECT corpus_id, min(yr) AS lo, max(yr) AS hi FROM paper GROUP BY 1) w USING (corpus_id) WHERE p.cites > 18 OR yr = lo OR yr = hi) GROUP BY 1""")
def trend_context(m):
    """Years of much cited records: those missing in between, and those at the ends of the window."""
    y = F.col("year")
    s = m.papers.join(m.windows, "corpus_id").filter((F.col("cites") > 18) | (y == F.col("window_start")) | (y == F.col("window_end"))).select("corpus_id", y.cast("long").alias("year"), (y <= F.col("window_start")).alias("partial"), (y >= F.col("window_end") - 1).alias("indexing_lag")).distinct()
    return metrics.trend_context(s)


@query("SELECT e.corpus_id, count(t.record_id) FILTER (WHERE e.idx = t.pi_index) AS located, CASE WHEN bool_or(is_corresponding) THEN count(*) FILTER (WHERE e.idx = t.pi_index AND is_corresponding) END AS corresponding FROM entry e LEFT JOIN target t ON t.record_id = e.record_id GROUP BY 1")
def corresponding_share(m):
    return metrics.corresponding_share(m.entries, m.target)


# scores: components of less than full value only, so that corpora rest on different ones

CTES["fewer"] = "SELECT corpus_id, count(*) AS n_components, string_agg(component, ',' ORDER BY component) AS components, CASE WHEN count(*) >= 3 THEN round(100 * avg(value), 1) END AS score FROM parts WHERE value < 0.62 GROUP BY 1"


def _fewer(m):
    return materialise(scoring.scores(_parts(m).filter("value < 0.62")), "scores")


@query("""SELECT corpus_id, other_id, outcome, CASE WHEN outcome IN ('tie', 'ahead', 'behind') THEN abs(gap) END AS difference FROM (SELECT corpus_id, other_id, gap, CASE WHEN score IS NULL OR other_score IS NULL THEN 'unranked' WHEN components <> other_components THEN 'different_components' WHEN gap = 0 THEN 'tie' WHEN gap > 0 THEN 'ahead' ELSE 'behind' END AS outcome FROM
  (SELECT *, lead(corpus_id) OVER w AS other_id, lead(components) OVER w AS other_components, lead(score) OVER w AS other_score, round(score - lead(score) OVER w, 1) AS gap FROM fewer WINDOW w AS (ORDER BY corpus_id)) WHERE other_id IS NOT NULL)""")
def pairwise_statements(m):
    """What may be said of corpora that rest on different components."""
    return scoring.pairwise(_fewer(m))


@query("""SELECT corpus_id, rank() OVER (ORDER BY band DESC) AS rank, row_number() OVER (ORDER BY band DESC, corpus_id) AS place, array_to_string(list_filter(list_sort(list(corpus_id) OVER (PARTITION BY band)), lambda x: x <> corpus_id), ',') AS tied_with FROM (SELECT corpus_id, round(score / 5) * 5 AS band FROM scored WHERE score IS NOT NULL)""")
def rank_ties(m):
    """Ranks by scores rounded to fives, with the corpora that share each."""
    s = scoring.scores(_parts(m)).withColumn("score", F.round(F.col("score") / 5) * 5)
    return scoring.tied_with(scoring.rank_corpora(materialise(s, "scores")))


# two harvests

CTES["oldp"] = "SELECT corpus_id, person, count(*) FILTER (WHERE idx = 0) AS n_first FROM entry WHERE yr <= 1999 GROUP BY 1, 2"
CTES["newp"] = "SELECT corpus_id, person, count(*) FILTER (WHERE idx = 0) AS n_first FROM entry WHERE yr >= 1997 GROUP BY 1, 2"
CTES["alone"] = "SELECT x.corpus_id, x.status, l.person, count(*) AS n_first FROM (SELECT corpus_id, record_id, CASE WHEN yr < 1997 THEN 'only_old' ELSE 'only_new' END AS status FROM paper WHERE yr < 1997 OR yr > 1999) x JOIN entry l ON l.record_id = x.record_id AND l.idx = 0 GROUP BY 1, 2, 3"


def _halves(m):
    p = m.papers.withColumn("keys", F.array(F.concat(F.lit("d:"), F.col("record_id").cast("string"))))
    return p.filter("year <= 1999"), p.filter("year >= 1997")


def _side(m, cond):
    return m.entries.filter(cond).groupBy("corpus_id", "person").agg(F.count_if(F.col("idx") == 0).alias("n_first"))


@query("""SELECT a.corpus_id, a.status, a.person, a.n_first, CASE WHEN status = 'only_old' THEN o.n_first ELSE n.n_first END AS here, CASE WHEN status = 'only_old' THEN n.n_first ELSE o.n_first END AS there, CASE WHEN status = 'only_old' THEN n.n_first ELSE o.n_first END IS NULL AS unknown_there
  FROM alone a LEFT JOIN oldp o ON o.corpus_id = a.corpus_id AND o.person = a.person LEFT JOIN newp n ON n.corpus_id = a.corpus_id AND n.person = a.person""")
def diff_counterparts(m):
    """Who leads records of one harvest only, and what they hold in the other."""
    m = m.keep("papers", "entries")
    holders = diff.first_slot_holders(diff.rows(*_halves(m)), m.leads)
    return diff.slot_counterparts(holders, _side(m, "year <= 1999"), _side(m, "year >= 1997"))


def _identities(m):
    both = m.table("customer").groupBy(F.col("c_nationkey").cast("long").alias("corpus_id")).agg(F.min("c_mktsegment").alias("affiliation"), F.max("c_mktsegment").alias("other"), F.collect_set("c_mktsegment").alias("keywords"))
    old = both.select("corpus_id", "affiliation", "keywords", F.lit("").alias("orcid"))
    return old, both.select("corpus_id", F.when(F.col("corpus_id") < 10, F.col("other")).otherwise(F.col("affiliation")).alias("affiliation"), F.reverse(F.array_sort("keywords")).alias("keywords"), F.lit(None).cast("string").alias("orcid"))


@query("SELECT c_nationkey::bigint AS corpus_id, CASE WHEN c_nationkey < 10 AND min(c_mktsegment) <> max(c_mktsegment) THEN 'affiliation' ELSE '' END AS changed_fields, NOT (c_nationkey < 10 AND min(c_mktsegment) <> max(c_mktsegment)) AS same FROM customer GROUP BY c_nationkey")
def identity_changes(m):
    return diff.identity_changes(*_identities(m), ("affiliation", "keywords", "orcid"))


@query("""SELECT w.corpus_id, true AS caliber_changed, CASE WHEN w.corpus_id < 10 AND seg > 1 THEN 'affiliation' ELSE '' END AS changed_fields, coalesce(ro, 0) AS records_only_old, coalesce(rn, 0) AS records_only_new, 0 AS records_unkeyable_old, 0 AS records_unkeyable_new, coalesce(po, 0) AS people_only_old, coalesce(pn, 0) AS people_only_new, 0 AS people_unkeyable_old, 0 AS people_unkeyable_new
  FROM (SELECT corpus_id, count(*) FILTER (WHERE yr < 1997) AS ro, count(*) FILTER (WHERE yr > 1999) AS rn FROM paper GROUP BY 1) w JOIN (SELECT c_nationkey::bigint AS corpus_id, count(DISTINCT c_mktsegment) AS seg FROM customer GROUP BY 1) c ON c.corpus_id = w.corpus_id
  LEFT JOIN (SELECT corpus_id, count(*) AS po FROM (SELECT corpus_id, person FROM oldp EXCEPT SELECT corpus_id, person FROM newp) GROUP BY 1) a ON a.corpus_id = w.corpus_id LEFT JOIN (SELECT corpus_id, count(*) AS pn FROM (SELECT corpus_id, person FROM newp EXCEPT SELECT corpus_id, person FROM oldp) GROUP BY 1) b ON b.corpus_id = w.corpus_id""")
def diff_full(m):
    old, new = _halves(m)
    keyed = lambda cond: _side(m, cond).withColumn("keys", F.array(F.col("person").cast("string")))
    return diff.full(diff.windows(corpus.window_years(old), corpus.window_years(new)), diff.identity_changes(*_identities(m), ("affiliation", "keywords", "orcid")), diff.rows(old, new), diff.rows(keyed("year <= 1999"), keyed("year >= 1997"), "person"))


# windows, evidence, gates


@query("""SELECT n_nationkey::bigint AS corpus_id, coalesce(lo, w.s) AS window_start, greatest(coalesce(lo, w.s), coalesce(hi, w.e)) AS window_end FROM (SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 1993 END AS lo, CASE WHEN n_regionkey = 0 THEN 1990 WHEN n_regionkey = 1 THEN 1996 END AS hi FROM nation) LEFT JOIN (SELECT corpus_id, min(yr) AS s, max(yr) AS e FROM paper GROUP BY 1) w ON w.corpus_id = n_nationkey""")
def stated_windows(m):
    """Windows as the search states them, else as the records have them; an end before its start is moved."""
    e = m.table("nation").select(F.col("n_nationkey").cast("long").alias("corpus_id"), F.when(F.col("n_regionkey") == 0, "1993/01/01").alias("mindate"), F.when(F.col("n_regionkey") == 0, "1990").when(F.col("n_regionkey") == 1, "1996 Dec").otherwise("none").alias("maxdate"))
    return corpus.stated_window(m.papers, e)


@query("SELECT t.record_id, pi_index, pi_evidence, CASE WHEN topic = 'BUILDING' THEN greatest(pi_evidence, 3) ELSE pi_evidence END AS reported_evidence FROM target t JOIN paper p ON p.record_id = t.record_id")
def lifted_evidence(m):
    ids = m.papers.select("record_id", F.array(F.when(F.col("topic") == "BUILDING", "A1").otherwise("A2")).alias("author_ids"))
    return corpus.lifted_evidence(m.target, ids, "A1").select("record_id", "pi_index", "pi_evidence", "reported_evidence")


CTES["told"] = "SELECT n_nationkey::bigint AS corpus_id, n_regionkey * 10 AS fetched, 25::bigint AS verified FROM nation UNION ALL SELECT 100 + r_regionkey, 5, 5 FROM region"


def _told(m):
    a = m.table("nation").select(F.col("n_nationkey").cast("long").alias("corpus_id"), (F.col("n_regionkey") * 10).cast("long").alias("fetched"), F.lit(25).cast("long").alias("verified"))
    return a.unionByName(m.table("region").select((F.col("r_regionkey") + 100).cast("long").alias("corpus_id"), F.lit(5).cast("long").alias("fetched"), F.lit(5).cast("long").alias("verified")))


@query("""SELECT corpus_id, n AS n_records, bare, gate IS NOT NULL AS refused, gate FROM (SELECT t.corpus_id, coalesce(n, 0) AS n, coalesce(bare, 0) AS bare, CASE WHEN verified > fetched THEN 'inconsistent_counts' WHEN coalesce(n, 0) = 0 THEN 'empty_corpus' WHEN bare > 0 THEN 'no_structured_authors' END AS gate FROM told t
  LEFT JOIN (SELECT p.corpus_id, count(*) AS n, count(*) FILTER (WHERE s.n IS NULL) AS bare FROM paper p LEFT JOIN sized s ON s.record_id = p.record_id GROUP BY 1) x ON x.corpus_id = t.corpus_id)""")
def gate_all(m):
    """Every corpus that was searched for, also those without a record and those with counts that can't be."""
    return quality.gates(_told(m), m.papers.join(m.sizes, "record_id", "left"), F.col("n"))


@query("SELECT corpus_id, fetched, verified, CASE WHEN fetched >= verified THEN fetched - verified END AS rejected, fetched < verified AS inconsistent FROM told")
def harvest_counts(m):
    return quality.harvest_counts(_told(m))


# side tables and reports

_SAME = "coalesce(regexp_replace(lower(advisor), '[^a-z]+', '', 'g') = regexp_replace(lower(wanted), '[^a-z]+', '', 'g'), false)"


@query(f"""SELECT corpus_id, n_rows, n_advisors, n_matched, outcome, coalesce(CASE WHEN outcome = 'matched' THEN n_matched WHEN outcome = 'unverified_single' THEN n_rows END, 0) AS rows_used, coalesce(CASE WHEN outcome = 'matched' THEN dm WHEN outcome = 'unverified_single' THEN d END, 0) AS dated FROM (SELECT corpus_id, count(*) AS n_rows, count(DISTINCT advisor) AS n_advisors, count(*) FILTER (WHERE {_SAME}) AS n_matched, count(*) FILTER (WHERE {_SAME} AND yr IS NOT NULL) AS dm, count(yr) AS d,
  CASE WHEN bool_or({_SAME}) THEN 'matched' WHEN count(DISTINCT advisor) = 1 THEN 'unverified_single' ELSE 'refused' END AS outcome FROM (SELECT p.corpus_id, CASE WHEN p.corpus_id = 7 THEN 'one' ELSE topic END AS advisor, CASE WHEN status <> 'P' THEN yr END AS yr, CASE WHEN p.corpus_id < 5 THEN 'Building' ELSE 'Nobody' END AS wanted FROM paper p) GROUP BY 1)""")
def evaluation_outcomes(m):
    """Rows of a table of statements that are the target's: matched, of the only advisor there is, or refused."""
    rows = m.papers.select("corpus_id", F.when(F.col("corpus_id") == 7, "one").otherwise(F.col("topic")).alias("advisor"), F.when(F.col("status") != "P", F.col("year")).alias("year"))
    target = m.table("nation").select(F.col("n_nationkey").cast("long").alias("corpus_id"), F.when(F.col("n_nationkey") < 5, "Building").otherwise("Nobody").alias("target"))
    return reports.evaluation_rows(rows, target)


@query("""SELECT coalesce(pmid, '') AS pmid, left(coalesce(title, ''), 200) AS title, coalesce(pub_date, '') AS pub_date, coalesce(doi, '') AS doi, coalesce(pmc_id, '') AS pmc_id, 'ok (' || coalesce(issn, '') || ')' AS pdf_status, coalesce(regexp_extract(coalesce(issn, ''), '^([^()（）]+)$', 1), '') AS pdf_source, coalesce(volume, '') AS validation_reason FROM papers""")
def validation_report(m):
    p = m.table("papers").withColumns({"pmid": F.coalesce("pmid", F.lit("")), "pdf_status": F.concat(F.lit("ok ("), F.coalesce("issn", F.lit("")), F.lit(")")), "pdf_validation": F.col("volume")})
    return reports.validation_report(p)


@query("""SELECT CASE WHEN c THEN 'cached' WHEN source IS NOT NULL THEN 'downloaded' ELSE 'failed' END AS status, CASE WHEN NOT c THEN source END AS source, count(*) AS n FROM (SELECT l_orderkey, bool_or(l_discount < 0.02) AS c, arg_min(l_linestatus, (l_quantity, l_linestatus)) FILTER (WHERE l_returnflag = 'R') AS source FROM lineitem GROUP BY 1) GROUP BY 1, 2""")
def file_outcomes(m):
    """The lines of an order as attempts to fetch its file: the quickest valid one counts."""
    a = m.table("lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linestatus").alias("source"), F.col("l_quantity").alias("milliseconds"), (F.col("l_returnflag") == "R").alias("valid"), (F.col("l_discount") < 0.02).alias("cached"))
    return reports.file_counts(a)


@query("""SELECT row_number() OVER (ORDER BY row_id) AS no, coalesce(pmid, '') AS pmid, coalesce(title, '') AS title, coalesce(authors_str, '') AS authors_str, '' AS role, coalesce(nullif(array_to_string(confirmed_by, '+'), ''), '') AS source_label, coalesce(journal, '') AS journal, coalesce(pub_date, '') AS pub_date, coalesce(volume, '') AS volume, coalesce(issue, '') AS issue, coalesce(pages, '') AS pages, coalesce(doi, '') AS doi, coalesce(pmc_id, '') AS pmc_id, '' AS pdf_status, left(coalesce(abstract, ''), 500) AS abstract FROM papers""")
def export_rows(m):
    """The flat export of all papers, numbered by their ids."""
    return files.export_rows(m.table("papers"), "row_id")


@query("SELECT coalesce(journal, '') AS journal, coalesce(issn, '') AS issn, '' AS impact_factor, '' AS jcr_quartile, n::varchar AS n_papers FROM (SELECT journal, min(issn) AS issn, count(*) AS n FROM papers GROUP BY 1)")
def worklist_rows(m):
    j = m.table("papers").groupBy("journal").agg(F.min("issn").alias("issn"), F.count("*").alias("n_papers"))
    return files.worklist_rows(j, ("journal", "issn", "impact_factor", "jcr_quartile", "n_papers"))


_CLEAN = "regexp_replace(lower({}), '[\\s\\p{{P}}\\p{{S}}]+', '', 'g')"


@query(f"""SELECT rec_id, CASE WHEN {_CLEAN.format(X.narrow('source_db'))} IN ('cnki', 'cnkinet', '知网', '中国知网', '中国期刊网', '中国博士学位论文全文数据库', '中国优秀硕士学位论文全文数据库') THEN 'CNKI' WHEN {_CLEAN.format(X.narrow('source_db'))} IN ('万方', '万方数据', 'wanfang', 'wanfangdata') THEN '万方' ELSE '其他' END AS source,
  trim(regexp_replace(notes, '[\\s\\p{{Z}}]+', ' ', 'g')) AS line, string_split_regex(trim(split_part(authors_pinyin_raw, ';', 1)), '\\s+')[1] AS last, array_to_string(string_split_regex(trim(split_part(authors_pinyin_raw, ';', 1)), '\\s+')[2:], ' ') AS fore FROM chinese_records""")
def side_cells(m):
    """Databases, cells on one line, and the parts of the first romanised name, as a table of theses has them."""
    name = S.latin_split(F.get(F.split("authors_pinyin_raw", ";"), F.lit(0)))
    return m.table("chinese_records").select("rec_id", S.thesis_source(F.col("source_db")).alias("source"), S.one_line(F.col("notes")).alias("line"), name["last"].alias("last"), name["fore"].alias("fore"))


_NOW, _AGE = "TIMESTAMP '2024-01-25 00:00:00'", 10


@query(f"""SELECT r.user_id, r.event_type, e.event_id IS NOT NULL AS hit, e.event_id FROM (SELECT DISTINCT user_id, event_type FROM events) r LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE value > 10 AND ts >= {_NOW} - INTERVAL {_AGE} DAY) WHERE rn = 1) e ON e.user_id = r.user_id AND e.event_type = r.event_type""")
def reusable_counts(m):
    """Kept counts within their age; an answer without a count is asked again."""
    e = m.table("events").withColumn("citation_count", F.when(F.col("value") > 10, F.col("value")))
    now = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return cache.reusable_counts(e.select("user_id", "event_type").distinct(), e, ["user_id", "event_type"], "ts", "event_id", now, _AGE).select("user_id", "event_type", "hit", "event_id")


@query(f"""SELECT r.user_id, e.event_id IS NOT NULL AS hit, e.event_id FROM (SELECT DISTINCT user_id FROM events) r LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'error' AND ts >= {_NOW} - INTERVAL {_AGE} DAY) WHERE rn = 1) e ON e.user_id = r.user_id""")
def reusable_risk(m):
    """Kept answers that some source gave."""
    e = m.table("events").withColumn("sources", F.array_compact(F.array(F.when(F.col("event_type") != "error", F.col("event_type")))))
    now = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return cache.reusable_risk(e.select("user_id").distinct(), e, ["user_id"], "ts", "event_id", now, _AGE).select("user_id", "hit", "event_id")
