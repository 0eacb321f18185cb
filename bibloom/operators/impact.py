"""Citations: joins in order of preference, indices, summaries and percentiles in a reference distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions import scalar as S
from bibloom.operators.metrics import LEAST, LEAST_PERCENT, at_least

#: Least papers of a cell of the reference distribution.
LEAST_CELL = 100


def join_citations(papers: DataFrame, citations: DataFrame) -> DataFrame:
    """``papers`` (record_id, pmid, doi) with ``cites``, ``cite_source`` and ``route`` (pmid, doi or none).

    A citation row must have a readable count and a key. Of rows with one key the first (by position) counts. The PMID
    goes before the DOI, and a citation row is used once: by the first paper that finds it.
    """
    c = citations.select(F.col("position"), F.nullif(F.trim("pmid"), F.lit("")).alias("cp"), F.nullif(F.lower(F.trim("doi")), F.lit("")).alias("cd"), S.count_or_null(F.col("citation_count")).alias("cc"), F.col("source").alias("cite_source"))
    c = c.filter("cc is not null and (cp is not null or cd is not null)")
    first = lambda k: c.filter(f"{k} is not null").groupBy(k).agg(F.min_by(F.struct("position", "cc", "cite_source"), "position").alias(f"by_{k}"))
    p = papers.withColumns({"_p": F.nullif(F.trim("pmid"), F.lit("")), "_d": F.nullif(F.lower(F.trim("doi")), F.lit(""))})
    j = p.join(first("cp"), F.col("_p") == F.col("cp"), "left").join(first("cd"), F.col("_d") == F.col("cd"), "left")
    j = j.withColumn("hit", F.coalesce("by_cp", "by_cd"))
    w = Window.partitionBy(F.coalesce(F.col("hit.position"), -F.xxhash64("record_id"))).orderBy("record_id")  # papers without a hit are spread
    used = j.withColumn("turn", F.when(F.col("hit").isNotNull(), F.row_number().over(w)))
    ok = F.col("turn") == 1
    return used.select(*[F.col(x) for x in papers.columns], F.when(ok, F.col("hit.cc")).alias("cites"), F.when(ok, F.col("hit.cite_source")).alias("cite_source"), F.when(~F.coalesce(ok, F.lit(False)), "none").when(F.col("by_cp").isNotNull(), "pmid").otherwise("doi").alias("route"))


def h_index(papers: DataFrame, key: str = "corpus_id") -> DataFrame:
    """The most papers that have at least as many citations each.

    From counts per citation number, not from a rank over the papers: of the papers with at least c citations, the lesser
    of their number and c is reached for some c, and the greatest of these is the index.
    """
    by = papers.filter("cites is not null").groupBy(key, "cites").agg(F.count("*").alias("k"))
    w = Window.partitionBy(key).orderBy(F.desc("cites")).rowsBetween(Window.unboundedPreceding, 0)
    return by.withColumn("above", F.sum("k").over(w)).groupBy(key).agg(F.sum("k").alias("covered"), F.max(F.least("above", "cites")).alias("h"), F.coalesce(F.sum(F.when(F.col("cites") >= 10, F.col("k"))), F.lit(0)).cast("long").alias("i10"))


def summary(papers: DataFrame) -> DataFrame:
    """Coverage, total, quartiles and indices of each corpus; aggregates from 5 covered papers on, the total always."""
    a = papers.groupBy("corpus_id").agg(F.count("*").alias("denominator"), F.count("cites").alias("covered"), F.sum("cites").alias("total_citations"), *[F.percentile("cites", q).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    j = a.join(h_index(papers).drop("covered"), "corpus_id", "left")
    c = F.col("covered")
    return j.select("corpus_id", "denominator", "covered", S.percent(c, F.col("denominator"), LEAST_PERCENT).alias("coverage_percent"), F.coalesce("total_citations", F.lit(0)).cast("long").alias("total_citations"), *[at_least(c, F.col(x), LEAST).alias(x) for x in ("h", "i10", "q1", "median", "q3")], (c < F.col("denominator")).alias("lower_bound"))


def reference_cells(works: DataFrame, cell: tuple[str, ...] = ("topic", "year")) -> DataFrame:
    """The distribution of citations in each cell: ``(cell, cites, n)``."""
    return works.filter("cites is not null").groupBy(*cell, "cites").agg(F.count("*").alias("n"))


#: Why a paper has no place in its reference distribution, in the order in which the first that applies counts, after the located ones.
STATUSES = ("located", "no_citation_count", "no_identifier", "topic_lookup_failed", "no_topic", "no_year", "distribution_unavailable", "distribution_too_small")


def percentiles(papers: DataFrame, cells: DataFrame, reported: DataFrame | None = None, cell: tuple[str, ...] = ("topic", "year"), least: int = LEAST_CELL) -> DataFrame:
    """Each paper's place in its cell: ``(record_id, status, population, percentile, at_or_below, low, high, tied, tied_share, points_a_paper, above_max)``.

    The percentile is the share of strictly fewer citations; ``low`` and ``high`` bound it by what ``reported`` (cell,
    reported_total) says the distribution lacks. A count that the distribution doesn't hold has its place too. Sums run
    over a cell's distinct counts, never over its papers. A cell of fewer than ``least`` papers gives none, and the status
    tells why there is none; papers may have ``has_identifier`` and ``lookup_failed``.
    """
    by = Window.partitionBy(*cell)
    up = by.orderBy("cites").rowsBetween(Window.unboundedPreceding, -1)
    asked = papers.filter("cites is not null").select(*cell, "cites").distinct().withColumn("n", F.lit(0).cast("long"))
    counts = cells.select(*cell, "cites", "n").unionByName(asked).groupBy(*cell, "cites").agg(F.sum("n").alias("n"))
    c = counts.withColumns({"below": F.coalesce(F.sum("n").over(up), F.lit(0)), "population": F.sum("n").over(by), "top": F.max(F.when(F.col("n") > 0, F.col("cites"))).over(by)})
    p = papers.join(c, [*cell, "cites"], "left")
    p = p.join(reported, list(cell), "left") if reported is not None else p.withColumn("reported_total", F.lit(None).cast("long"))
    missing = F.greatest(F.lit(0), F.coalesce(F.col("reported_total") - F.col("population"), F.lit(0)))
    flag = lambda x, otherwise: F.coalesce(F.col(x), F.lit(otherwise)) if x in papers.columns else F.lit(otherwise)
    status = F.when(F.col("cites").isNull(), STATUSES[1]).when(~flag("has_identifier", True), STATUSES[2]).when(flag("lookup_failed", False), STATUSES[3]).when(F.col(cell[0]).isNull(), STATUSES[4]).when(F.col(cell[1]).isNull(), STATUSES[5])
    status = status.when(F.coalesce(F.col("population"), F.lit(0)) == 0, STATUSES[6]).when(F.col("population") < least, STATUSES[7]).otherwise(STATUSES[0])
    ok = status == STATUSES[0]
    pct = lambda x, n: F.when(ok, F.lit(100.0) * x / n)
    n, tied = F.col("population"), F.col("n")
    return p.select(
        "record_id", status.alias("status"), F.when(ok, n).alias("population"), pct(F.col("below"), n).alias("percentile"), pct(F.col("below") + tied, n).alias("at_or_below"), pct(F.col("below"), n + missing).alias("low"), pct(F.col("below") + missing, n + missing).alias("high"),
        F.when(ok, tied).alias("tied"), F.when(ok, tied / n).alias("tied_share"), pct(F.lit(1), n).alias("points_a_paper"), F.when(ok, F.col("cites") > F.col("top")).alias("above_max"),
    )


def status_counts(placed: DataFrame) -> DataFrame:
    """How many papers have each status, those that none has with 0."""
    every = placed.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(placed.groupBy("status").agg(F.count("*").alias("n")), "status", "left").fillna(0, ["n"])


def source_histogram(papers: DataFrame) -> DataFrame:
    """Per corpus the sources that its counts came from, and whether they are mixed."""
    h = papers.filter("cites is not null").groupBy("corpus_id", "cite_source").agg(F.count("*").alias("n"))
    return h.withColumn("mixed_sources", F.count("*").over(Window.partitionBy("corpus_id")) > 1)


def first_answer(papers: DataFrame, sources: list[tuple[str, DataFrame]], key: str = "record_id") -> DataFrame:
    """The first source that has a count: ``(key, cites, source)``; zero is an answer, null is none."""
    j = papers.select(key)
    for i, (_, s) in enumerate(sources):
        j = j.join(s.select(key, S.count_or_null(F.col("citation_count")).alias(f"c{i}")), key, "left")
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, (name, _) in enumerate(sources):
        found = found.when(F.col(f"c{i}").isNotNull(), name)
    return j.select(key, F.coalesce(*[F.col(f"c{i}") for i in range(len(sources))]).alias("cites"), found.alias("source"))
