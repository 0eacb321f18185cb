"""Queries over bylines, people and the metrics built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibloom.operators import corpus, metrics, people
from bibloom.plans.adapter import Model, sql

QUERIES = {}
SQL: dict[str, str] = {}
BIG = "CAST({} AS BIGINT) AS {}"


def query(text: str | None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf: f(Model(spark, sf))
        if text:
            SQL[f.__name__] = sql(text)
        return f

    return keep


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("SELECT corpus_id, record_id, idx, n, person, idx = 0 AS is_first, idx = n - 1 AS is_last FROM entry")
def byline_positions(m):
    return m.entries.select("corpus_id", "record_id", "idx", "n", "person", (F.col("idx") == 0).alias("is_first"), (F.col("idx") == F.col("n") - 1).alias("is_last"))


@query("SELECT record_id, pi_index, CAST(pi_evidence AS BIGINT) AS pi_evidence, pi_ambiguous FROM target")
def pi_resolution(m):
    return m.target


@query("""SELECT corpus_id, record_id, CASE WHEN n IS NULL THEN 'empty_author_list' WHEN rn > 1 THEN 'duplicate_pmid' WHEN n >= 10 THEN 'hyperauthorship' END AS reason FROM
  (SELECT p.corpus_id, p.record_id, s.n, row_number() OVER (PARTITION BY corpus_id, date_iso, topic, s.n IS NULL ORDER BY p.record_id) AS rn FROM paper p LEFT JOIN sized s ON p.record_id = s.record_id)""")
def exclusion_reasons(m):
    p = m.papers.join(m.sizes, "record_id", "left").withColumns({"pmid": F.concat_ws(" ", "date_iso", "topic"), "doi": F.lit(None).cast("string"), "title": F.col("journal")})
    return corpus.exclusion_reasons(p, F.coalesce("n", F.lit(0)), many=10).select("corpus_id", "record_id", "reason")


@query("""SELECT corpus_id, record_id, n AS n_authors FROM paper JOIN sized USING (record_id) WHERE n >= 10""")
def large_team_records(m):
    return m.papers.select("corpus_id", "record_id").join(m.sizes.filter("n >= 10"), "record_id").select("corpus_id", "record_id", F.col("n").alias("n_authors"))


@query("SELECT corpus_id, regexp_replace(lower(journal), '[^a-z0-9]', '', 'g') AS key, count(*) AS n, min(record_id) AS first FROM paper GROUP BY 1, 2 HAVING count(*) > 1")
def title_duplicates(m):
    return corpus.title_duplicates(m.papers.withColumn("title", F.col("journal")))


@query("SELECT corpus_id, window_start, window_end FROM win")
def window_years(m):
    return m.windows


@query("""SELECT corpus_id, person, n_appearances, n_first, n_last, first_year, last_year, first_lead_year, first_last_year, first_date, stratum, span_years, left_censored, right_censored FROM person""")
def people_rows(m):
    return m.people.select("corpus_id", "person", "n_appearances", "n_first", "n_last", "first_year", "last_year", "first_lead_year", "first_last_year", "first_date", "stratum", "span_years", "left_censored", "right_censored")


@query("""SELECT corpus_id, count(*) AS n_people, count(*) FILTER (WHERE stratum = 'A') AS n_a, count(*) FILTER (WHERE stratum = 'B') AS n_b, count(*) FILTER (WHERE stratum = 'C') AS n_c, count(*) FILTER (WHERE stratum = 'D') AS n_d FROM person GROUP BY 1""")
def roster_by_stratum(m):
    return people.roster(m.people)


_RANK = "SELECT corpus_id, person, CAST({v} AS BIGINT) AS value, rank() OVER (PARTITION BY corpus_id ORDER BY {v} DESC) AS rank, count(*) OVER (PARTITION BY corpus_id, {v}) > 1 AS tied FROM person"


@query(_RANK.format(v="n_first"))
def rank_people_first_slots(m):
    return people.rank(m.people, F.col("n_first"))


@query(_RANK.format(v="n_appearances"))
def rank_people_appearances(m):
    return people.rank(m.people, F.col("n_appearances"))


@query(_RANK.format(v="span_years"))
def rank_people_span(m):
    return people.rank(m.people, F.col("span_years"))


@query("SELECT corpus_id, person, n_first, n_last, first_lead_year, first_last_year FROM person WHERE stratum = 'D' AND n_first > 0")
def lead_to_senior_flips(m):
    return people.lead_to_senior(m.people)


@query("""SELECT corpus_id, person, CASE WHEN bool_or(is_home) THEN 'internal' ELSE 'external' END AS signal FROM appearance GROUP BY 1, 2""")
def affiliation_signal(m):
    return people.affiliation_signal(m.appearances, F.col("is_home"))


@query("""SELECT corpus_id, denominator, denominator < 5 AS suppressed, CASE WHEN denominator >= 5 THEN a END AS n_a, CASE WHEN denominator >= 5 THEN b END AS n_b, CASE WHEN denominator >= 5 THEN d END AS n_d, CASE WHEN denominator >= 5 THEN u END AS n_unclassified,
  CASE WHEN denominator >= 20 THEN CAST(round_even(100.0 * a / denominator, 0) AS BIGINT) END AS percent_a FROM (
  SELECT p.corpus_id, count(*) AS denominator, count(*) FILTER (WHERE stratum = 'A') AS a, count(*) FILTER (WHERE stratum = 'B') AS b, count(*) FILTER (WHERE stratum = 'D') AS d, count(*) FILTER (WHERE stratum IS NULL OR stratum = 'C') AS u
  FROM paper p LEFT JOIN (SELECT record_id, person FROM entry WHERE idx = 0) l ON p.record_id = l.record_id LEFT JOIN person x ON x.corpus_id = p.corpus_id AND x.person = l.person
  WHERE p.record_id NOT IN (SELECT record_id FROM target WHERE pi_index = 0) GROUP BY 1)""")
def first_author_slots(m):
    m = m.keep()
    return metrics.first_author_slots(m.papers, m.leads, m.target, m.people)


@query("""SELECT corpus_id, count(*) AS denominator, count(*) FILTER (WHERE n_first > 0) AS holds_lead, count(*) FILTER (WHERE n_first = 0 AND window_end - first_year >= 3) AS observed_without_lead, count(*) FILTER (WHERE n_first = 0 AND window_end - first_year < 3) AS too_recent FROM person WHERE stratum IN ('A', 'B') GROUP BY 1""")
def lead_slot_partition(m):
    return metrics.lead_partition(m.people)


@query("""SELECT corpus_id, count(*) AS denominator, count(*) FILTER (WHERE w = 0) AS count_at_zero, CASE WHEN count(*) >= 5 THEN quantile_cont(w, 0.5) END AS median, count(*) < 5 AS suppressed
  FROM (SELECT corpus_id, greatest(0, first_lead_year - first_year) AS w FROM person WHERE stratum = 'A') GROUP BY 1""")
def time_to_lead(m):
    return metrics.time_to_lead(m.people)


@query("SELECT corpus_id, CAST(greatest(0, first_lead_year - first_year) AS BIGINT) AS wait, count(*) AS n_people FROM person WHERE stratum = 'A' GROUP BY 1, 2")
def time_to_lead_histogram(m):
    return metrics.time_to_lead_histogram(m.people)


@query("""SELECT corpus_id, denominator, complete, left_only, right_only, both_ends, CASE WHEN complete >= 5 THEN q1 END AS q1, CASE WHEN complete >= 5 THEN median END AS median, CASE WHEN complete >= 5 THEN q3 END AS q3 FROM (
  SELECT corpus_id, count(*) AS denominator, count(*) FILTER (WHERE NOT left_censored AND NOT right_censored) AS complete, count(*) FILTER (WHERE left_censored AND NOT right_censored) AS left_only, count(*) FILTER (WHERE NOT left_censored AND right_censored) AS right_only, count(*) FILTER (WHERE left_censored AND right_censored) AS both_ends,
  quantile_cont(CASE WHEN NOT left_censored AND NOT right_censored THEN span_years END, 0.25) AS q1, quantile_cont(CASE WHEN NOT left_censored AND NOT right_censored THEN span_years END, 0.5) AS median, quantile_cont(CASE WHEN NOT left_censored AND NOT right_censored THEN span_years END, 0.75) AS q3 FROM person GROUP BY 1)""")
def activity_span(m):
    return metrics.activity_span(m.people)


@query("""SELECT s.corpus_id, s.yr AS year, coalesce(a.k, 0) AS active, coalesce(b.k, 0) AS arrivals, coalesce(d.k, 0) AS departures, s.yr >= s.window_end - 1 AS indexing_lag FROM spine s
  LEFT JOIN (SELECT corpus_id, yr, count(DISTINCT person) AS k FROM appearance GROUP BY 1, 2) a ON a.corpus_id = s.corpus_id AND a.yr = s.yr
  LEFT JOIN (SELECT corpus_id, first_year AS yr, count(*) AS k FROM person GROUP BY 1, 2) b ON b.corpus_id = s.corpus_id AND b.yr = s.yr
  LEFT JOIN (SELECT corpus_id, last_year AS yr, count(*) AS k FROM person GROUP BY 1, 2) d ON d.corpus_id = s.corpus_id AND d.yr = s.yr""")
def roster_turnover(m):
    m = m.keep()
    return metrics.turnover(m.appearances, m.people, m.papers)


_WHERE = "CASE WHEN t.pi_index IS NULL THEN 'unlocated' WHEN s.n = 1 THEN 'sole' WHEN t.pi_index = 0 THEN 'first' WHEN t.pi_index = s.n - 1 THEN 'last' ELSE 'middle' END"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE w = '{x}') AS {x}" if x not in ("first", "last") else f'count(*) FILTER (WHERE w = \'{x}\') AS "{x}"' for x in ("sole", "first", "last", "middle", "unlocated"))
_PLACED = f"(SELECT p.corpus_id, p.yr, {_WHERE} AS w, coalesce(t.pi_ambiguous, false) AS amb FROM paper p LEFT JOIN sized s ON s.record_id = p.record_id LEFT JOIN target t ON t.record_id = p.record_id)"


@query(f"SELECT corpus_id, count(*) AS denominator, {_COUNTS}, count(*) FILTER (WHERE amb) AS ambiguous FROM {_PLACED} GROUP BY 1")
def pi_byline_positions(m):
    return metrics.target_positions(m.papers, m.sizes, m.target)


@query(f"SELECT corpus_id, yr AS year, count(*) AS denominator, {_COUNTS}, count(*) FILTER (WHERE amb) AS ambiguous FROM {_PLACED} GROUP BY 1, 2")
def byline_by_year(m):
    return metrics.target_positions(m.papers, m.sizes, m.target, by_year=True)


@query("""SELECT corpus_id, count(*) AS denominator, count(*) FILTER (WHERE f AND NOT l) AS shared_first, count(*) FILTER (WHERE l AND NOT f) AS senior, count(*) FILTER (WHERE f AND l) AS both, count(*) FILTER (WHERE NOT f AND NOT l) AS other
  FROM (SELECT corpus_id, record_id, bool_or(idx = 0) AS f, bool_or(idx = n - 1) AS l FROM entry WHERE equal_contrib GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1""")
def equal_contrib(m):
    return metrics.equal_contribution(m.entries)


_PER_YEAR = """SELECT s.corpus_id, s.yr AS year, coalesce(c.k, 0) AS count, s.yr = s.window_start OR s.yr = s.window_end AS partial, s.yr >= s.window_end - 1 AS indexing_lag FROM spine s LEFT JOIN (SELECT corpus_id, yr, count(*) AS k FROM paper GROUP BY 1, 2) c ON c.corpus_id = s.corpus_id AND c.yr = s.yr"""


@query(_PER_YEAR)
def records_per_year(m):
    return metrics.records_per_year(m.papers)


@query("""SELECT corpus_id, count(*) AS denominator, min(n) AS min, max(n) AS max, count(*) FILTER (WHERE n >= 10) AS large_teams, CASE WHEN count(*) >= 5 THEN quantile_cont(n, 0.25) END AS q1, CASE WHEN count(*) >= 5 THEN quantile_cont(n, 0.5) END AS median, CASE WHEN count(*) >= 5 THEN quantile_cont(n, 0.75) END AS q3
  FROM paper p JOIN sized s ON s.record_id = p.record_id GROUP BY 1""")
def team_size(m):
    return metrics.team_size(m.papers, m.sizes, large=10)


@query("""SELECT l.corpus_id, count(*) AS denominator, CASE WHEN count(*) >= 10 THEN quantile_cont(l.n, 0.5) END AS median FROM entry l JOIN person x ON x.corpus_id = l.corpus_id AND x.person = l.person WHERE l.idx = 0 AND x.stratum IN ('A', 'B') GROUP BY 1""")
def team_size_subset(m):
    m = m.keep()
    return metrics.team_size_of_leads(m.leads, m.sizes, m.people)


@query("""SELECT b.corpus_id, b.journal, b.k AS count, r.singletons, r.missing FROM (SELECT corpus_id, journal, count(*) AS k FROM paper GROUP BY 1, 2) b
  JOIN (SELECT corpus_id, count(*) FILTER (WHERE k = 1 AND journal IS NOT NULL) AS singletons, CAST(coalesce(sum(k) FILTER (WHERE journal IS NULL), 0) AS BIGINT) AS missing FROM (SELECT corpus_id, journal, count(*) AS k FROM paper GROUP BY 1, 2) GROUP BY 1) r ON r.corpus_id = b.corpus_id WHERE b.k >= 2 AND b.journal IS NOT NULL""")
def venue_repetition(m):
    return metrics.venue_repetition(m.papers)


@query("SELECT corpus_id, affiliation, count(DISTINCT record_id) AS n_papers FROM entry GROUP BY 1, 2 HAVING count(DISTINCT record_id) >= 3")
def affiliation_strings(m):
    return metrics.affiliation_strings(m.entries)


@query("""SELECT s.corpus_id, s.yr AS year, coalesce(t.total, 0) AS total, coalesce(t.covered, 0) AS covered FROM spine s LEFT JOIN (SELECT p.corpus_id, p.yr, count(*) AS total, count(e.record_id) AS covered FROM paper p LEFT JOIN (SELECT DISTINCT record_id FROM entry) e ON e.record_id = p.record_id GROUP BY 1, 2) t ON t.corpus_id = s.corpus_id AND t.yr = s.yr""")
def affiliation_coverage(m):
    return metrics.affiliation_coverage(m.papers, m.entries)


@query("""SELECT corpus_id, yr AS year, record_id, journal AS title, row_number() OVER (PARTITION BY corpus_id, yr ORDER BY record_id) - 1 AS place FROM paper""")
def titles_by_year(m):
    return metrics.titles_by_year(m.papers.withColumn("title", F.col("journal")))


_T = "list_value(" + ", ".join(map(str, metrics.T_95)) + ")"


@query(f"""SELECT corpus_id, n, round(slope, 6) AS slope, round(my - slope * mx, 4) AS intercept, round(slope - half, 6) AS lower, round(slope + half, 6) AS upper, slope - half > 0 OR slope + half < 0 AS excludes_zero, sse = 0 AS exact_fit FROM (
  SELECT corpus_id, n, slope, mx, my, sse, coalesce({_T}[n - 2], 1.96) * sqrt(sse / (n - 2) / sxx) AS half FROM (
    SELECT y.corpus_id, f.n, f.slope, f.mx, f.my, f.sxx, sum(power(y.count - f.my - f.slope * (y.year - f.mx), 2)) AS sse FROM ({_PER_YEAR}) y
    JOIN (SELECT corpus_id, count(*) AS n, avg(year) AS mx, avg(count) AS my, regr_sxx(count, year) AS sxx, regr_slope(count, year) AS slope FROM ({_PER_YEAR}) GROUP BY 1 HAVING count(*) >= 4) f ON f.corpus_id = y.corpus_id GROUP BY ALL))""")
def trend_ols(m):
    t = metrics.trend(metrics.records_per_year(m.papers))
    return t.select("corpus_id", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "excludes_zero", "exact_fit")


# figure data: the frames that the figures are drawn from


@query("""SELECT a.corpus_id, a.person, a.yr AS year, count(*) AS n, bool_or(is_first) AS led FROM appearance a JOIN person x ON x.corpus_id = a.corpus_id AND x.person = a.person WHERE x.stratum IN ('A', 'B') GROUP BY 1, 2, 3""")
def figure_gantt(m):
    m = m.keep()
    own = m.people.filter(F.col("stratum").isin("A", "B")).select("corpus_id", "person")
    return m.appearances.join(own, ["corpus_id", "person"]).groupBy("corpus_id", "person", "year").agg(F.count("*").alias("n"), F.bool_or("is_first").alias("led"))


@query("""SELECT corpus_id, person, CASE WHEN n_first > 0 THEN 'lag' ELSE 'not_yet' END AS kind, CAST(CASE WHEN n_first > 0 THEN greatest(0, first_lead_year - first_year) ELSE window_end - first_year END AS BIGINT) AS years FROM person WHERE stratum IN ('A', 'B')""")
def figure_lag(m):
    p = m.people.filter(F.col("stratum").isin("A", "B"))
    led = F.col("n_first") > 0
    return p.select("corpus_id", "person", F.when(led, "lag").otherwise("not_yet").alias("kind"), F.when(led, F.greatest(F.lit(0), F.col("first_lead_year") - F.col("first_year"))).otherwise(F.col("window_end") - F.col("first_year")).cast("long").alias("years"))


@query("""SELECT corpus_id, record_id, yr AS year, row_number() OVER (PARTITION BY corpus_id, yr ORDER BY record_id) - 1 AS stack FROM paper""")
def figure_year(m):
    return corpus.numbered(m.papers.select("corpus_id", "record_id", "year"), ["corpus_id", "year"], "record_id", "stack")


@query("""SELECT p.corpus_id, CASE WHEN x.stratum IN ('A', 'B') THEN 'student' ELSE 'other' END AS lane, s.n AS n_authors, count(*) AS n_papers FROM paper p JOIN sized s ON s.record_id = p.record_id JOIN (SELECT record_id, person FROM entry WHERE idx = 0) l ON l.record_id = p.record_id LEFT JOIN person x ON x.corpus_id = p.corpus_id AND x.person = l.person GROUP BY 1, 2, 3""")
def figure_team(m):
    m = m.keep()
    j = m.leads.select("corpus_id", "record_id", "person", "n").join(m.people.select("corpus_id", "person", "stratum"), ["corpus_id", "person"], "left")
    return j.groupBy("corpus_id", F.when(F.col("stratum").isin("A", "B"), "student").otherwise("other").alias("lane"), F.col("n").alias("n_authors")).agg(F.count("*").alias("n_papers"))


@query("""SELECT corpus_id, CASE WHEN left_censored AND right_censored THEN 'both' WHEN left_censored THEN 'left' WHEN right_censored THEN 'right' ELSE 'complete' END AS bucket, CAST(span_years AS BIGINT) AS span, count(*) AS n FROM person GROUP BY 1, 2, 3""")
def figure_span(m):
    left, right = F.col("left_censored"), F.col("right_censored")
    return m.people.groupBy("corpus_id", F.when(left & right, "both").when(left, "left").when(right, "right").otherwise("complete").alias("bucket"), F.col("span_years").alias("span")).agg(F.count("*").alias("n"))
