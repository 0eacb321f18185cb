"""Paper and person metrics. Each takes whole frames, groups by corpus and tells its denominator; small samples give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.functions import scalar as S
from bibloom.operators.corpus import LARGE_TEAM, numbered, spine

#: Least cases for an aggregate, a median of a subset, and a percentage.
LEAST, LEAST_SUBSET, LEAST_PERCENT = 5, 10, 20


def at_least(n: Column, value: Column, least: int = LEAST) -> Column:
    return F.when(n >= least, value)


def quantiles(value: Column, where: Column | None = None) -> dict[str, Column]:
    """Exact interpolated quartiles as aggregates."""
    v = value if where is None else F.when(where, value)
    return {"q1": F.percentile(v, 0.25), "median": F.percentile(v, 0.5), "q3": F.percentile(v, 0.75)}


def first_author_slots(papers: DataFrame, leads: DataFrame, target: DataFrame, people: DataFrame, record: str = "record_id") -> DataFrame:
    """Who holds the first slot of the papers that the target does not lead, by stratum of the lead.

    ``leads`` has one row for each paper's first entry. Percentages need 20 papers, counts 5.
    """
    own = target.filter("pi_index = 0").select(record)
    eligible = papers.select("corpus_id", record).join(own, record, "left_anti").join(leads.select(record, "person"), record, "left")
    s = eligible.join(people.select("corpus_id", "person", "stratum"), ["corpus_id", "person"], "left")
    a = s.groupBy("corpus_id").agg(F.count("*").alias("denominator"), *[F.count_if(F.col("stratum") == x).alias(f"c_{x.lower()}") for x in "ABD"], F.count_if(F.col("stratum").isNull() | (F.col("stratum") == "C")).alias("c_unclassified"))
    n = F.col("denominator")
    return a.select("corpus_id", "denominator", (n < LEAST).alias("suppressed"), *[at_least(n, F.col(f"c_{x}")).alias(f"n_{x}") for x in ("a", "b", "d", "unclassified")], S.percent(F.col("c_a"), n).alias("percent_a"))


def lead_partition(people: DataFrame, lag: int = 3) -> DataFrame:
    """People of strata A and B: who holds a lead, who was watched long enough without one, and who came too late to tell."""
    p = people.filter(F.col("stratum").isin("A", "B"))
    watched = F.col("window_end") - F.col("first_year") >= lag
    holds = F.col("n_first") > 0
    return p.groupBy("corpus_id").agg(F.count("*").alias("denominator"), F.count_if(holds).alias("holds_lead"), F.count_if(~holds & watched).alias("observed_without_lead"), F.count_if(~holds & ~watched).alias("too_recent"))


def time_to_lead(people: DataFrame) -> DataFrame:
    """Years from the first record to the first lead of stratum A; the median from 5 people on."""
    p = people.filter("stratum = 'A'").withColumn("wait", F.greatest(F.lit(0), F.col("first_lead_year") - F.col("first_year")))
    a = p.groupBy("corpus_id").agg(F.count("*").alias("denominator"), F.count_if(F.col("wait") == 0).alias("count_at_zero"), F.percentile("wait", 0.5).alias("m"))
    return a.select("corpus_id", "denominator", "count_at_zero", at_least(F.col("denominator"), F.col("m")).alias("median"), (F.col("denominator") < LEAST).alias("suppressed"))


def time_to_lead_histogram(people: DataFrame) -> DataFrame:
    wait = F.greatest(F.lit(0), F.col("first_lead_year") - F.col("first_year")).cast("long")
    return people.filter("stratum = 'A'").groupBy("corpus_id", wait.alias("wait")).agg(F.count("*").alias("n_people"))


def activity_span(people: DataFrame) -> DataFrame:
    """People by which end of their span the window cuts off; quartiles of the span over the complete ones only."""
    left, right, span = F.col("left_censored"), F.col("right_censored"), F.col("span_years")
    complete = ~left & ~right
    a = people.groupBy("corpus_id").agg(
        F.count("*").alias("denominator"), F.count_if(complete).alias("complete"), F.count_if(left & ~right).alias("left_only"), F.count_if(~left & right).alias("right_only"), F.count_if(left & right).alias("both_ends"),
        *[v.alias(k) for k, v in quantiles(span, complete).items()],
    )
    return a.select("corpus_id", "denominator", "complete", "left_only", "right_only", "both_ends", *[at_least(F.col("complete"), F.col(q)).alias(q) for q in ("q1", "median", "q3")])


def turnover(appearances: DataFrame, people: DataFrame, papers: DataFrame, person: str = "person") -> DataFrame:
    """Per calendar year, gaps included, how many people were active, arrived and departed; the last two years are told apart."""
    active = appearances.select("corpus_id", "year", person).distinct().groupBy("corpus_id", "year").agg(F.count("*").alias("active"))
    came = people.groupBy("corpus_id", F.col("first_year").alias("year")).agg(F.count("*").alias("arrivals"))
    left = people.groupBy("corpus_id", F.col("last_year").alias("year")).agg(F.count("*").alias("departures"))
    s = spine(papers)
    for x in (active, came, left):
        s = s.join(x.withColumn("year", F.col("year").cast("long")), ["corpus_id", "year"], "left")
    return s.fillna(0, ["active", "arrivals", "departures"]).select("corpus_id", "year", "active", "arrivals", "departures", (F.col("year") >= F.col("window_end") - 1).alias("indexing_lag"))


def target_positions(papers: DataFrame, n_authors: DataFrame, target: DataFrame, by_year: bool = False, record: str = "record_id") -> DataFrame:
    """Where in the byline the target stands: sole, first, last, middle or not located."""
    p = papers.select("corpus_id", record, "year").join(n_authors, record, "left").join(target, record, "left")
    i, n = F.col("pi_index"), F.col("n")
    where = F.when(i.isNull(), "unlocated").when(n == 1, "sole").when(i == 0, "first").when(i == n - 1, "last").otherwise("middle")
    keys = ["corpus_id", F.col("year").cast("long").alias("year")] if by_year else ["corpus_id"]
    return p.groupBy(*keys).agg(F.count("*").alias("denominator"), *[F.count_if(where == w).alias(w) for w in ("sole", "first", "last", "middle", "unlocated")], F.count_if(F.coalesce(F.col("pi_ambiguous"), F.lit(False))).alias("ambiguous"))


def equal_contribution(entries: DataFrame, record: str = "record_id") -> DataFrame:
    """Papers with marks of equal contribution: on the first slots, on the last, on both, elsewhere."""
    e = entries.filter("equal_contrib")
    marks = e.groupBy("corpus_id", record).agg(F.count("*").alias("k"), F.bool_or(F.col("idx") == 0).alias("f"), F.bool_or(F.col("idx") == F.col("n") - 1).alias("l")).filter("k > 1")
    kind = F.when(F.col("f") & F.col("l"), "both").when(F.col("f"), "shared_first").when(F.col("l"), "senior").otherwise("other")
    return marks.groupBy("corpus_id").agg(F.count("*").alias("denominator"), *[F.count_if(kind == x).alias(x) for x in ("shared_first", "senior", "both", "other")])


def records_per_year(papers: DataFrame) -> DataFrame:
    """Records of each calendar year; the window's ends are partial, the last two years still being indexed."""
    counts = papers.groupBy("corpus_id", F.col("year").cast("long").alias("year")).agg(F.count("*").alias("count"))
    s = spine(papers).join(counts, ["corpus_id", "year"], "left")
    y = F.col("year")
    return s.select("corpus_id", "year", F.coalesce("count", F.lit(0).cast("long")).alias("count"), ((y == F.col("window_start")) | (y == F.col("window_end"))).alias("partial"), (y >= F.col("window_end") - 1).alias("indexing_lag"))


def team_size(papers: DataFrame, sizes: DataFrame, large: int = LARGE_TEAM, record: str = "record_id") -> DataFrame:
    """Authors on a paper: range, quartiles from 5 papers on, and large teams."""
    p = papers.select("corpus_id", record).join(sizes, record)
    a = p.groupBy("corpus_id").agg(F.count("*").alias("denominator"), F.min("n").alias("min"), F.max("n").alias("max"), F.count_if(F.col("n") >= large).alias("large_teams"), *[v.alias(k) for k, v in quantiles(F.col("n")).items()])
    return a.select("corpus_id", "denominator", "min", "max", "large_teams", *[at_least(F.col("denominator"), F.col(q)).alias(q) for q in ("q1", "median", "q3")])


def team_size_of_leads(leads: DataFrame, sizes: DataFrame, people: DataFrame, record: str = "record_id") -> DataFrame:
    """Median authors on papers led by people of strata A and B, from 10 papers on."""
    p = leads.select("corpus_id", record, "person").join(people.filter(F.col("stratum").isin("A", "B")).select("corpus_id", "person"), ["corpus_id", "person"]).join(sizes, record)
    a = p.groupBy("corpus_id").agg(F.count("*").alias("denominator"), F.percentile("n", 0.5).alias("m"))
    return a.select("corpus_id", "denominator", at_least(F.col("denominator"), F.col("m"), LEAST_SUBSET).alias("median"))


def venue_repetition(papers: DataFrame) -> DataFrame:
    """Venues used at least twice, and in each row the corpus's venues used once and records without one."""
    name = F.nullif(F.trim("journal"), F.lit(""))
    by = papers.groupBy("corpus_id", name.alias("journal")).agg(F.count("*").alias("count"))
    rest = by.groupBy("corpus_id").agg(F.count_if((F.col("count") == 1) & F.col("journal").isNotNull()).alias("singletons"), F.coalesce(F.sum(F.when(F.col("journal").isNull(), F.col("count"))), F.lit(0)).cast("long").alias("missing"))
    return by.filter("count >= 2 and journal is not null").join(F.broadcast(rest), "corpus_id")


def affiliation_strings(entries: DataFrame, least: int = 3, record: str = "record_id") -> DataFrame:
    """Affiliations found on at least ``least`` papers."""
    a = entries.filter(F.trim("affiliation") != "").select("corpus_id", "affiliation", record).distinct()
    return a.groupBy("corpus_id", "affiliation").agg(F.count("*").alias("n_papers")).filter(F.col("n_papers") >= least)


def affiliation_coverage(papers: DataFrame, entries: DataFrame, record: str = "record_id") -> DataFrame:
    """Per year how many papers have any affiliation."""
    has = entries.filter(F.trim("affiliation") != "").select(record).distinct().withColumn("has", F.lit(True))
    p = papers.select("corpus_id", F.col("year").cast("long").alias("year"), record).join(has, record, "left")
    s = p.groupBy("corpus_id", "year").agg(F.count("*").alias("total"), F.count_if(F.coalesce("has", F.lit(False))).alias("covered"))
    return spine(papers).select("corpus_id", "year").join(s, ["corpus_id", "year"], "left").fillna(0, ["total", "covered"])


def titles_by_year(papers: DataFrame, record: str = "record_id") -> DataFrame:
    """Titles of each year, one a row, with their place in the order of the ids."""
    rows = papers.select("corpus_id", F.col("year").cast("long").alias("year"), record, "title")
    return numbered(rows, ["corpus_id", "year"], record, "place")


#: Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom; 1.96 beyond (fixed values).
T_95 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)


def trend(series: DataFrame, x: str = "year", y: str = "count", keys: tuple[str, ...] = ("corpus_id",)) -> DataFrame:
    """Least-squares line through the points of each series with its 95 % interval, from 4 points on.

    The error is summed from centred deviations in a second pass, so that an exact series has exactly no error.
    """
    s = series.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    m = s.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    j = s.join(m, list(keys)).withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})
    f = j.groupBy(*keys, "n", "mx", "my").agg(F.sum(F.col("dx") * F.col("dx")).alias("sxx"), F.sum(F.col("dx") * F.col("dy")).alias("sxy")).filter("n >= 4 and sxx > 0").withColumn("slope", F.col("sxy") / F.col("sxx"))
    e = j.select(*keys, "dx", "dy").join(f, list(keys)).groupBy(*keys, "n", "mx", "my", "sxx", "slope").agg(F.sum(F.pow(F.col("dy") - F.col("slope") * F.col("dx"), F.lit(2))).alias("sse"))
    t = F.coalesce(F.get(F.array(*[F.lit(v) for v in T_95]), (F.col("n") - 3).cast("int")), F.lit(1.96))
    half = t * F.sqrt(F.col("sse") / (F.col("n") - 2) / F.col("sxx"))
    lower, upper = F.col("slope") - half, F.col("slope") + half
    return e.select(*keys, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "sse", lower.alias("lower"), upper.alias("upper"), ((lower > 0) | (upper < 0)).alias("excludes_zero"), (F.col("sse") == 0).alias("exact_fit"))


def trend_faults(series: DataFrame, x: str = "year", y: str = "count", keys: tuple[str, ...] = ("corpus_id",)) -> DataFrame:
    """What forbids a line through a series: ``(keys, year, fault)``, a year given twice, one that is no whole year, a count that isn't finite.

    Which of two counts of one year is meant only the caller can say, so none is chosen.
    """
    v = F.col(y).cast("double")
    bad = F.when(F.col(x).isNull() | (F.col(x).cast("double") != F.floor(F.col(x).cast("double"))), "no_year").when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "not_finite")
    single = series.withColumn("fault", bad).filter("fault is not null").select(*keys, F.col(x).cast("double").alias("year"), "fault")
    twice = series.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("year")).agg(F.count("*").alias("k")).filter("k > 1").select(*keys, "year", F.lit("repeated_year").alias("fault"))
    return single.distinct().unionByName(twice)


def trend_context(series: DataFrame, keys: tuple[str, ...] = ("corpus_id",)) -> DataFrame:
    """What a line through a series rests on: its first and last year, years missing in between, years that are known to be undercounted, and its centre."""
    weak = F.coalesce(F.col("partial"), F.lit(False)) | F.coalesce(F.col("indexing_lag"), F.lit(False))
    a = series.groupBy(*keys).agg(F.min("year").alias("first"), F.max("year").alias("last"), F.collect_set("year").alias("years"), F.array_sort(F.collect_set(F.when(weak, F.col("year")))).alias("weak"), F.avg("year").alias("centre"))
    gaps = F.array_sort(F.array_except(F.sequence("first", "last"), F.col("years")))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return a.select(*keys, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), text(gaps).alias("gaps"), text(F.col("weak")).alias("censored"), "centre")


def corresponding_share(entries: DataFrame, target: DataFrame, record: str = "record_id") -> DataFrame:
    """Per corpus records in which the target is located, and those in which it is corresponding: null where no entry of the corpus has such a mark."""
    marked = entries.groupBy("corpus_id").agg(F.bool_or(F.coalesce("is_corresponding", F.lit(False))).alias("measured"))
    t = entries.drop("pi_index").join(target.select(record, "pi_index"), record).filter("idx = pi_index").groupBy("corpus_id").agg(F.count("*").alias("located"), F.count_if(F.coalesce("is_corresponding", F.lit(False))).alias("k"))
    j = marked.join(t, "corpus_id", "left")
    return j.select("corpus_id", F.coalesce("located", F.lit(0)).alias("located"), F.when(F.col("measured"), F.coalesce("k", F.lit(0))).alias("corresponding"))
