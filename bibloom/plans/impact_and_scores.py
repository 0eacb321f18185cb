"""Queries over citations, scores, ranks, clusters and the quality of a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibloom.operators import cohesion, impact, metrics, quality, reports, scoring
from bibloom.plans.adapter import CTES, Model, sql
from bibloom.runtime import materialise

QUERIES = {}
SQL: dict[str, str] = {}


def query(text: str | None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf: f(Model(spark, sf))
        if text:
            SQL[f.__name__] = sql(text)
        return f

    return keep


# citations: those of even orders come with a PMID, of odd ones with a DOI in another case; every seventh is given twice

CTES["citation"] = """SELECT record_id AS position, CASE WHEN record_id % 2 = 0 THEN CAST(record_id AS VARCHAR) END AS pmid, CASE WHEN record_id % 2 = 1 THEN '10.1/X' || record_id END AS doi, cites AS citation_count FROM paper
  UNION ALL SELECT record_id + 1000000000, CAST(record_id AS VARCHAR), NULL, cites + 1 FROM paper WHERE record_id % 7 = 0"""


def _citations(m):
    p = m.papers
    key = F.col("record_id").cast("string")
    a = p.select(F.col("record_id").alias("position"), F.when(F.col("record_id") % 2 == 0, key).alias("pmid"), F.when(F.col("record_id") % 2 == 1, F.concat(F.lit("10.1/X"), key)).alias("doi"), F.col("cites").alias("citation_count"), F.lit("a").alias("source"))
    b = p.filter("record_id % 7 = 0").select((F.col("record_id") + 1_000_000_000).alias("position"), key.alias("pmid"), F.lit(None).cast("string").alias("doi"), (F.col("cites") + 1).alias("citation_count"), F.lit("b").alias("source"))
    return a.unionByName(b)


@query("""SELECT p.corpus_id, p.record_id, coalesce(a.c, d.c) AS cites, CASE WHEN a.c IS NOT NULL THEN 'pmid' WHEN d.c IS NOT NULL THEN 'doi' ELSE 'none' END AS route FROM paper p
  LEFT JOIN (SELECT pmid, arg_min(citation_count, position) AS c FROM citation WHERE pmid IS NOT NULL AND citation_count IS NOT NULL GROUP BY 1) a ON a.pmid = CAST(p.record_id AS VARCHAR)
  LEFT JOIN (SELECT lower(doi) AS doi, arg_min(citation_count, position) AS c FROM citation WHERE doi IS NOT NULL AND citation_count IS NOT NULL GROUP BY 1) d ON d.doi = '10.1/x' || p.record_id""")
def citation_join(m):
    p = m.papers.select("corpus_id", "record_id", F.col("record_id").cast("string").alias("pmid"), F.concat(F.lit("10.1/x"), F.col("record_id").cast("string")).alias("doi"))
    return impact.join_citations(p, _citations(m)).select("corpus_id", "record_id", "cites", "route")


CTES["hrank"] = "SELECT corpus_id, cites, row_number() OVER (PARTITION BY corpus_id ORDER BY cites DESC, record_id) AS rn FROM paper WHERE cites IS NOT NULL"


@query("SELECT corpus_id, count(*) AS covered, count(*) FILTER (WHERE cites >= rn) AS h FROM hrank GROUP BY 1")
def h_index(m):
    return impact.h_index(m.papers).select("corpus_id", "covered", "h")


@query("SELECT corpus_id, count(*) FILTER (WHERE cites >= 10) AS i10 FROM paper WHERE cites IS NOT NULL GROUP BY 1")
def i10_index(m):
    return impact.h_index(m.papers).select("corpus_id", "i10")


_SUMMARY = """SELECT p.corpus_id, count(*) AS denominator, count(cites) AS covered, CASE WHEN count(*) >= 20 THEN CAST(round_even(100.0 * count(cites) / count(*), 0) AS BIGINT) END AS coverage_percent, CAST(coalesce(sum(cites), 0) AS BIGINT) AS total_citations,
  CASE WHEN count(cites) >= 5 THEN max(x.h) END AS h, CASE WHEN count(cites) >= 5 THEN count(*) FILTER (WHERE cites >= 10) END AS i10, CASE WHEN count(cites) >= 5 THEN quantile_cont(cites, 0.25) END AS q1, CASE WHEN count(cites) >= 5 THEN quantile_cont(cites, 0.5) END AS median, CASE WHEN count(cites) >= 5 THEN quantile_cont(cites, 0.75) END AS q3, count(cites) < count(*) AS lower_bound
  FROM paper p LEFT JOIN (SELECT corpus_id, count(*) FILTER (WHERE cites >= rn) AS h FROM hrank GROUP BY 1) x ON x.corpus_id = p.corpus_id GROUP BY 1"""


@query(_SUMMARY)
def citation_summary(m):
    return impact.summary(m.papers)


_CELL = "(SELECT topic, yr, cites, count(*) AS n FROM paper WHERE cites IS NOT NULL GROUP BY 1, 2, 3)"


@query(f"SELECT topic, yr AS year, cites, n FROM {_CELL}")
def reference_histogram(m):
    return impact.reference_cells(m.papers)


@query(f"""SELECT p.record_id, CASE WHEN p.cites IS NULL THEN 'no_citation_count' WHEN q.population IS NULL THEN 'distribution_unavailable' WHEN q.population < 100 THEN 'distribution_too_small' ELSE 'located' END AS status,
  CASE WHEN p.cites IS NOT NULL AND q.population >= 100 THEN CAST(q.population AS BIGINT) END AS population, CASE WHEN p.cites IS NOT NULL AND q.population >= 100 THEN round(100.0 * b.below / q.population, 6) END AS percentile,
  CASE WHEN p.cites IS NOT NULL AND q.population >= 100 THEN round(100.0 * b.upto / q.population, 6) END AS at_or_below, CASE WHEN p.cites IS NOT NULL AND q.population >= 100 THEN round(100.0 * b.below / (q.population + 50), 6) END AS low
  FROM paper p LEFT JOIN (SELECT topic, yr, count(cites) AS population FROM paper GROUP BY 1, 2) q ON q.topic = p.topic AND q.yr = p.yr
  LEFT JOIN (SELECT a.topic, a.yr, a.cites, coalesce(sum(c.n) FILTER (WHERE c.cites < a.cites), 0) AS below, sum(c.n) FILTER (WHERE c.cites <= a.cites) AS upto FROM {_CELL} a JOIN {_CELL} c ON a.topic = c.topic AND a.yr = c.yr GROUP BY 1, 2, 3) b ON b.topic = p.topic AND b.yr = p.yr AND b.cites = p.cites""")
def citation_percentile(m):
    cells = impact.reference_cells(m.papers)
    reported = cells.groupBy("topic", "year").agg((F.sum("n") + 50).alias("reported_total"))
    p = impact.percentiles(m.papers.select("record_id", "topic", "year", "cites"), cells, reported)
    return p.select("record_id", "status", "population", *[F.round(c, 6).alias(c) for c in ("percentile", "at_or_below", "low")])


@query("""SELECT record_id, coalesce(a, b) AS cites, CASE WHEN a IS NOT NULL THEN 'first' WHEN b IS NOT NULL THEN 'second' END AS source FROM (SELECT record_id, cites AS a, CASE WHEN record_id % 3 = 0 THEN record_id % 11 END AS b FROM paper)""")
def citation_source_chain(m):
    a = m.papers.select("record_id", F.col("cites").alias("citation_count"))
    b = m.papers.filter("record_id % 3 = 0").select("record_id", (F.col("record_id") % 11).alias("citation_count"))
    return impact.first_answer(m.papers, [("first", a), ("second", b)])


# scores

_PARTS = """SELECT s.corpus_id, 'lead_slot_share' AS component, 1.0 * a / d AS value FROM (SELECT p.corpus_id, count(*) AS d, count(*) FILTER (WHERE x.stratum = 'A') AS a FROM paper p LEFT JOIN (SELECT record_id, person FROM entry WHERE idx = 0) l ON l.record_id = p.record_id LEFT JOIN person x ON x.corpus_id = p.corpus_id AND x.person = l.person WHERE p.record_id NOT IN (SELECT record_id FROM target WHERE pi_index = 0) GROUP BY 1) s WHERE d >= 5
  UNION ALL SELECT corpus_id, 'people_with_lead_slot', 1.0 * h / (h + w) FROM (SELECT corpus_id, count(*) FILTER (WHERE n_first > 0) AS h, count(*) FILTER (WHERE n_first = 0 AND window_end - first_year >= 3) AS w FROM person WHERE stratum IN ('A', 'B') GROUP BY 1) WHERE h + w >= 5
  UNION ALL SELECT corpus_id, 'time_to_lead', greatest(0, least(1, 1 - quantile_cont(greatest(0, first_lead_year - first_year), 0.5) / 4.0)) FROM person WHERE stratum = 'A' GROUP BY 1 HAVING count(*) >= 5
  UNION ALL SELECT corpus_id, 'records_per_year', least(1, quantile_cont(k, 0.5) / 8.0) FROM (SELECT s.corpus_id, s.yr, coalesce(c.k, 0) AS k FROM spine s LEFT JOIN (SELECT corpus_id, yr, count(*) AS k FROM paper GROUP BY 1, 2) c ON c.corpus_id = s.corpus_id AND c.yr = s.yr WHERE s.yr > s.window_start AND s.yr < s.window_end - 1) GROUP BY 1 HAVING count(*) >= 3
  UNION ALL SELECT corpus_id, 'citation_h_index', least(1, h / 15.0) FROM summed WHERE covered >= 5 AND covered >= 0.5 * denominator
  UNION ALL SELECT corpus_id, 'citation_median', least(1, median / 20.0) FROM summed WHERE covered >= 5 AND covered >= 0.5 * denominator"""
CTES["summed"] = _SUMMARY
CTES["parts"] = _PARTS
CTES["scored"] = "SELECT corpus_id, count(*) AS n_components, string_agg(component, ',' ORDER BY component) AS components, CASE WHEN count(*) >= 3 THEN round(100 * avg(value), 1) END AS score FROM parts GROUP BY 1"


def _parts(m):
    m = m.keep()
    return scoring.components(metrics.first_author_slots(m.papers, m.leads, m.target, m.people), metrics.lead_partition(m.people), metrics.time_to_lead(m.people), metrics.records_per_year(m.papers), impact.summary(m.papers))


def _scores(m):
    """One row for each corpus, read by several steps."""
    return materialise(scoring.scores(_parts(m)), "scores")


@query("SELECT corpus_id, component, round(value, 6) AS value FROM parts")
def score_components(m):
    return _parts(m).withColumn("value", F.round("value", 6))


@query("SELECT corpus_id, n_components, components, score FROM scored")
def composite_score(m):
    return scoring.scores(_parts(m))


@query("SELECT corpus_id, CAST(least(5, floor(score / 20) + 1) AS BIGINT) AS stars FROM scored")
def star_bands(m):
    return scoring.scores(_parts(m)).select("corpus_id", scoring.bands(F.col("score"))[0].alias("stars"))


@query("SELECT corpus_id, substr('EDCBA', CAST(least(5, floor(score / 20) + 1) AS INTEGER), 1) AS letter FROM scored")
def letter_grades(m):
    return scoring.scores(_parts(m)).select("corpus_id", scoring.bands(F.col("score"))[1].alias("letter"))


CTES["placed"] = """SELECT corpus_id, score, CAST(NULL AS VARCHAR) AS reason, rank() OVER (ORDER BY score DESC) AS rank, count(*) OVER (PARTITION BY score) > 1 AS tied, (SELECT count(DISTINCT components) FROM scored) <= 1 AS comparable FROM scored"""


@query("SELECT * FROM placed")
def rank_corpora(m):
    return scoring.rank_corpora(_scores(m))


@query("SELECT * FROM (SELECT corpus_id, lead(corpus_id) OVER w AS next_id, CASE WHEN score = lead(score) OVER w THEN 'tie' ELSE 'ahead' END AS outcome, round(score - lead(score) OVER w, 1) AS difference FROM placed WINDOW w AS (ORDER BY score DESC, corpus_id)) WHERE next_id IS NOT NULL")
def adjacent_statements(m):
    return scoring.statements(scoring.rank_corpora(_scores(m)))


# clusters: the orders of one customer, tied by shared parts of the same brand

CTES["own"] = "SELECT p.group_id, p.record_id, x.p_brand AS who FROM paper p JOIN lineitem ON l_orderkey = p.record_id JOIN part x ON x.p_partkey = l_partkey"
_CLUSTER = """, big AS (SELECT group_id FROM paper GROUP BY 1 HAVING count(*) >= 5), link AS (SELECT DISTINCT a.group_id, a.record_id AS u, b.hub AS v FROM own a JOIN (SELECT group_id, who, min(record_id) AS hub FROM own GROUP BY 1, 2) b ON a.group_id = b.group_id AND a.who = b.who JOIN big ON big.group_id = a.group_id),
  edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link), walk AS (SELECT p.group_id, p.record_id AS u, p.record_id AS r FROM paper p JOIN big USING (group_id) UNION SELECT w.group_id, w.u, e.v FROM walk w JOIN edge e ON e.u = w.r),
  found AS (SELECT group_id, u AS record_id, min(r) AS cluster FROM walk GROUP BY 1, 2) """


def _recursive(body: str) -> str:
    base = sql("SELECT 1 FROM paper JOIN own")
    return base[: base.rindex("SELECT 1 FROM")].replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + _CLUSTER + body


def _members(m):
    line = m.table("lineitem").select("l_orderkey", "l_partkey").join(m.table("part").select("p_partkey", F.col("p_brand").alias("who")), F.col("l_partkey") == F.col("p_partkey"))
    return m.papers.select("group_id", "record_id").join(line, F.col("l_orderkey") == F.col("record_id")).select("group_id", "record_id", "who")


def _clusters(m):
    return cohesion.clusters(m.papers, _members(m), "group_id", "record_id", "who")


@query(None)
def coauthor_clusters(m):
    return _clusters(m)


@query(None)
def cluster_summary(m):
    return cohesion.cluster_summary(_clusters(m), m.papers, "group_id")


@query(None)
def cluster_person_edges(m):
    return cohesion.person_edges(_clusters(m), _members(m), corpus="group_id", person="who")


SQL["coauthor_clusters"] = _recursive("SELECT group_id, record_id, cluster FROM found")
SQL["cluster_summary"] = _recursive("""SELECT f.group_id, f.cluster, count(*) AS size, min(p.yr) AS first_year, max(p.yr) AS last_year, count(DISTINCT p.journal) AS n_journals, max(t.n) AS n_records FROM found f JOIN paper p ON p.record_id = f.record_id JOIN (SELECT group_id, count(*) AS n FROM found GROUP BY 1) t ON t.group_id = f.group_id GROUP BY 1, 2""")
SQL["cluster_person_edges"] = _recursive(""", seen AS (SELECT DISTINCT f.group_id, f.cluster, o.record_id, o.who FROM found f JOIN own o ON o.record_id = f.record_id), often AS (SELECT group_id, cluster, who FROM seen GROUP BY ALL HAVING count(*) >= 2), s AS (SELECT seen.* FROM seen JOIN often USING (group_id, cluster, who))
  SELECT a.group_id, a.cluster, a.who AS a, b.who AS b, count(*) AS n_records FROM s a JOIN s b ON a.record_id = b.record_id AND a.cluster = b.cluster AND a.who < b.who GROUP BY ALL HAVING count(*) >= 2""")


# quality


@query("""SELECT p.corpus_id, count(*) AS n_records, count(*) FILTER (WHERE s.n IS NULL) AS bare, count(*) FILTER (WHERE s.n IS NULL) > 0 AS refused, CASE WHEN count(*) FILTER (WHERE s.n IS NULL) > 0 THEN 'no_structured_authors' END AS gate FROM paper p LEFT JOIN sized s ON s.record_id = p.record_id GROUP BY 1""")
def gate_structured_authors(m):
    return quality.gates(m.papers.select("corpus_id").distinct(), m.papers.join(m.sizes, "record_id", "left"), F.col("n"))


CTES["reach"] = "SELECT p.corpus_id, count(*) AS total, count(t.pi_evidence) AS reached, count(*) FILTER (WHERE t.pi_evidence >= 4) AS strongly_reached FROM paper p LEFT JOIN target t ON t.record_id = p.record_id GROUP BY 1"


@query("SELECT * FROM reach")
def identity_reach(m):
    return quality.identity_reach(m.papers, m.target, 4)


@query("""SELECT corpus_id, w.warning, w.situation FROM (SELECT corpus_id, unnest(list_filter([CASE WHEN reached = 0 THEN {'warning': 'target_not_located', 'situation': 'none_of_the_records'} END, CASE WHEN strongly_reached < 20 AND coalesce(share, 0) < 0.5 THEN {'warning': 'weak_identity', 'situation': CASE WHEN share IS NULL THEN 'index_not_asked' WHEN share > 0 THEN 'index_on_a_minority' ELSE 'no_identifier' END} END,
  CASE WHEN total > 600 THEN {'warning': 'incomplete_harvest', 'situation': 'fewer_than_found'} END, CASE WHEN corpus_id % 5 = 0 THEN {'warning': 'identity_fallback', 'situation': 'all_kept'} END], lambda x: x IS NOT NULL)) AS w FROM (SELECT *, CASE WHEN corpus_id < 8 THEN NULL WHEN corpus_id < 12 THEN 0.0 WHEN corpus_id < 16 THEN 0.3 ELSE 0.8 END AS share FROM reach))""")
def warning_coverage(m):
    r = quality.identity_reach(m.papers, m.target, 4)
    r = r.withColumn("strongly_reached", F.when(F.col("strongly_reached") < 20, 0).otherwise(F.col("strongly_reached")))
    c = F.col("corpus_id")
    envelope = r.select("corpus_id", F.col("total").alias("esearch_count"), F.lit(600).alias("pmids_returned"), (c % 5 == 0).alias("fallback_fired"), F.when(c < 8, None).when(c < 12, 0.0).when(c < 16, 0.3).otherwise(0.8).alias("openalex_share"))
    return quality.warnings(r, envelope)


@query("""SELECT p.corpus_id, 'evidence' AS kind, CASE coalesce(t.pi_evidence, 0) WHEN 4 THEN 'orcid' WHEN 2 THEN 'email' WHEN 1 THEN 'affiliation' ELSE 'name_only' END AS name, count(*) AS n FROM paper p LEFT JOIN target t ON t.record_id = p.record_id GROUP BY ALL
  UNION ALL SELECT corpus_id, 'source', status, count(*) FROM paper GROUP BY ALL""")
def corpus_counts(m):
    j = m.papers.join(m.target, "record_id", "left")
    tier = F.when(F.col("pi_evidence") == 4, "orcid").when(F.col("pi_evidence") == 2, "email").when(F.col("pi_evidence") == 1, "affiliation").otherwise("name_only")
    return quality.corpus_counts(j, tier, F.col("status"))


@query("""SELECT corpus_id, value, n, place FROM (SELECT corpus_id, affiliation AS value, count(*) AS n, row_number() OVER (PARTITION BY corpus_id ORDER BY count(*) DESC, affiliation) AS place FROM entry WHERE idx = 0 OR idx = n - 1 GROUP BY 1, 2) WHERE place <= 5""")
def identity_hints(m):
    return quality.identity_hints(m.entries.filter("idx = 0 or idx = n - 1"), F.col("affiliation"))


# frames for reports


@query("""SELECT p.*, x.* EXCLUDE (corpus_id), y.* EXCLUDE (corpus_id), round(n_records / (last_year - first_year + 1), 1) AS records_a_year, round(top_two / appearances, 3) AS top_two_share FROM (SELECT corpus_id, count(*) AS n_records, min(yr) AS first_year, max(yr) AS last_year, count(DISTINCT journal) AS n_venues FROM paper GROUP BY 1) p LEFT JOIN (SELECT corpus_id, CAST(sum(n_appearances) FILTER (WHERE rn <= 2) AS BIGINT) AS top_two, CAST(sum(n_appearances) AS BIGINT) AS appearances, count(*) AS n_people, count(*) FILTER (WHERE n_appearances = 1) AS seen_once FROM (
  SELECT corpus_id, n_appearances, row_number() OVER (PARTITION BY corpus_id ORDER BY n_appearances DESC, person) AS rn FROM person) GROUP BY 1) x ON x.corpus_id = p.corpus_id LEFT JOIN (SELECT corpus_id, """ + ", ".join(f"count(*) FILTER (WHERE stratum = '{x}') AS people_{x.lower()}" for x in "ABCD") + """, count(*) FILTER (WHERE n_first > 0) AS with_lead FROM person GROUP BY 1) y ON y.corpus_id = p.corpus_id""")
def glance(m):
    m = m.keep()
    return reports.glance(m.people, m.papers)


@query("SELECT row_number() OVER (ORDER BY score DESC NULLS LAST, corpus_id) AS line, corpus_id, score, outcome, difference FROM (SELECT corpus_id, score, CASE WHEN lead(corpus_id) OVER w IS NULL THEN NULL WHEN score = lead(score) OVER w THEN 'tie' ELSE 'ahead' END AS outcome, round(score - lead(score) OVER w, 1) AS difference FROM placed WINDOW w AS (ORDER BY score DESC, corpus_id))")
def comparison_table(m):
    s = _scores(m)
    return reports.comparison(s, scoring.statements(scoring.rank_corpora(s)))


@query("""SELECT CAST(o_custkey % 25 AS BIGINT) AS corpus_id, 'priority' AS kind, o_orderpriority AS name, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT CAST(o_custkey % 25 AS BIGINT), 'year', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM orders GROUP BY ALL""")
def evaluation_counts(m):
    o = m.table("orders").select((F.col("o_custkey") % 25).alias("corpus_id"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"))
    return reports.evaluation_counts(o, ("priority", "year"))


_WORDS = "list_filter(list_distinct(string_split_regex(lower(title), '[^a-z0-9]+')), lambda t: length(t) >= 4 AND t NOT IN ('with', 'from', 'that', 'this', 'into', 'their', 'using'))"
_FLAT = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""SELECT doc_id, CASE WHEN length(t) < 200 THEN 'skipped' WHEN {_FLAT.format('title')} <> '' AND contains({_FLAT.format('t')}, {_FLAT.format('title')}) THEN 'title' WHEN len({_WORDS}) > 0 AND len(list_intersect({_WORDS}, string_split_regex(lower(t), '[^a-z0-9]+'))) / len({_WORDS}) >= 0.45 THEN 'tokens' ELSE 'mismatch' END AS verdict
  FROM (SELECT doc_id, title, coalesce(text, '') AS t FROM documents)""")
def text_validation(m):
    return m.table("documents").select("doc_id", reports.text_verdict(F.col("text"), F.col("title"), F.lit(None).cast("string")).alias("verdict"))


@query(None)
def figure_net(m):
    return reports.panels(_clusters(m), "group_id")


SQL["figure_net"] = _recursive("SELECT group_id, cluster, size, panel FROM (SELECT group_id, cluster, count(*) AS size, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, cluster) AS panel FROM found GROUP BY 1, 2) WHERE panel <= 12")


@query("""SELECT row_id, len(authors) > 0 AS structured, len(list_filter(authors, lambda a: coalesce(trim(a.affiliation), '') <> '')) AS n_affiliations FROM papers""")
def structured_bylines(m):
    return m.table("papers").select("row_id", (F.size("authors") > 0).alias("structured"), F.size(F.filter("authors", lambda a: F.coalesce(F.trim(a["affiliation"]), F.lit("")) != "")).cast("long").alias("n_affiliations"))
