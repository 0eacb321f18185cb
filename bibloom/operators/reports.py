"""Small frames for reports: validation of fetched texts, counts of evaluations, the target in Chinese bylines, glances and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions import scalar as S

#: Least share of a title's words that a text must hold, and characters under which a text can't be judged.
LEAST_OVERLAP, LEAST_TEXT = 0.45, 200
#: Least bytes of a fetched file, and how it must begin.
LEAST_BYTES, MAGIC = 1000, "%PDF-"


def is_pdf(content: Column) -> Column:
    """Whether a binary cell is long enough and begins as a PDF file does."""
    return F.coalesce((F.octet_length(content) >= LEAST_BYTES) & (F.substring(content, 1, len(MAGIC)).cast("string") == MAGIC), F.lit(False))


def text_verdict(text: Column, title: Column, doi: Column) -> Column:
    """Why a fetched text is taken for a paper's: skipped (too short), doi, title, tokens, or mismatch."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    t = F.coalesce(text, F.lit(""))
    wanted = S.title_tokens(title)
    share = F.size(F.array_intersect(wanted, F.split(F.lower(t), "[^a-z0-9]+"))) / F.size(wanted)
    return (
        F.when(F.length(t) < LEAST_TEXT, "skipped").when(F.coalesce(F.contains(F.lower(t), F.lower(doi)), F.lit(False)), "doi").when((flat(title) != "") & F.contains(flat(t), flat(title)), "title")
        .when((F.size(wanted) > 0) & (share >= LEAST_OVERLAP), "tokens").otherwise("mismatch")
    )


def evaluation_counts(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of each corpus by each of ``columns``, in long form; blanks are a value of their own."""
    cells = F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("name")) for c in columns])
    return rows.select("corpus_id", F.explode(cells).alias("c")).groupBy("corpus_id", "c.kind", "c.name").agg(F.count("*").alias("n"))


def evaluation_rows(rows: DataFrame, target: DataFrame) -> DataFrame:
    """Which rows of a table of statements are about the target: per corpus matched, unverified_single or refused, and how many rows that leaves, dated and undated."""
    from bibloom.operators.linkage import same_advisor, select_rows

    j = rows.join(F.broadcast(target), "corpus_id")
    chosen = select_rows(j, same_advisor(F.col("advisor"), F.col("target")))
    kept = j.join(chosen.select("corpus_id", "outcome"), "corpus_id").filter((F.col("outcome") == "unverified_single") | (F.col("outcome") == "matched") & same_advisor(F.col("advisor"), F.col("target")))
    n = kept.groupBy("corpus_id").agg(F.count("*").alias("rows_used"), F.count("year").alias("dated"))
    return chosen.join(n, "corpus_id", "left").fillna(0, ["rows_used", "dated"])


def locate(records: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Where the target, known by ``names`` (one for each script), stands in each record's list ``authors``.

    ``(record_id, outcome, index)``: exact for one author that agrees, ambiguous for several, then partial_name,
    undecidable_script (only names in another script), no_author_matched.
    """
    e = records.select("record_id", F.posexplode_outer("authors").alias("index", "author"))
    level = F.lit(None).cast("string")
    rank = {"exact": 4, "name_form": 4, "partial_name": 3, "undecidable_script": 1}
    best = F.lit(0)
    for n in names:
        level = S.name_level(F.col("author"), F.lit(n))
        best = F.greatest(best, F.coalesce(F.create_map(*[F.lit(x) for k, v in rank.items() for x in (k, v)])[level], F.when(level.isNull() & F.col("author").isNotNull() & (S.script_of(F.col("author")) == S.script_of(F.lit(n))), 2).otherwise(0)))
    e = e.withColumn("b", best)
    a = e.groupBy("record_id").agg(F.count_if(F.col("b") == 4).alias("n_good"), F.min(F.when(F.col("b") == 4, F.col("index"))).alias("first"), F.max("b").alias("top"))
    outcome = F.when(F.col("n_good") == 1, "exact").when(F.col("n_good") > 1, "ambiguous").when(F.col("top") == 3, "partial_name").when(F.col("top") == 1, "undecidable_script").otherwise("no_author_matched")
    return a.select("record_id", outcome.alias("outcome"), F.when(F.col("n_good") == 1, F.col("first")).cast("long").alias("index"))


def glance(people: DataFrame, papers: DataFrame) -> DataFrame:
    """A few numbers for each corpus: records, years, records a year, venues, people by stratum, people seen once, and what the two most frequent hold."""
    counted = people.groupBy("corpus_id", "n_appearances").agg(F.count("*").alias("k"))
    up = Window.partitionBy("corpus_id").orderBy(F.desc("n_appearances"))
    c = counted.withColumn("before", F.coalesce(F.sum("k").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = c.groupBy("corpus_id").agg(F.sum(F.col("n_appearances") * F.greatest(F.lit(0), F.least(F.col("k"), F.lit(2) - F.col("before")))).alias("top_two"), F.sum(F.col("n_appearances") * F.col("k")).alias("appearances"), F.sum("k").alias("n_people"), F.coalesce(F.sum(F.when(F.col("n_appearances") == 1, F.col("k"))), F.lit(0)).cast("long").alias("seen_once"))
    by = people.groupBy("corpus_id").agg(*[F.count_if(F.col("stratum") == x).alias(f"people_{x.lower()}") for x in "ABCD"], F.count_if(F.col("n_first") > 0).alias("with_lead"))
    own = papers.groupBy("corpus_id").agg(F.count("*").alias("n_records"), F.min("year").cast("long").alias("first_year"), F.max("year").cast("long").alias("last_year"), F.countDistinct(F.nullif(F.trim("journal"), F.lit(""))).alias("n_venues"))
    j = own.join(top, "corpus_id", "left").join(by, "corpus_id", "left")
    return j.withColumns({"records_a_year": F.round(F.col("n_records") / (F.col("last_year") - F.col("first_year") + 1), 1), "top_two_share": F.round(F.col("top_two") / F.col("appearances"), 3)})


def validation_report(papers: DataFrame) -> DataFrame:
    """What became of each paper's file, one line for each: its source is what stands in brackets at the end of the status."""
    source = F.nullif(F.regexp_extract("pdf_status", r"[(（]([^()（）]+)[)）]\s*$", 1), F.lit(""))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return papers.select("pmid", F.left(blank("title"), F.lit(200)).alias("title"), blank("pub_date").alias("pub_date"), blank("doi").alias("doi"), blank("pmc_id").alias("pmc_id"), blank("pdf_status").alias("pdf_status"), F.coalesce(source, F.lit("")).alias("pdf_source"), blank("pdf_validation").alias("validation_reason"))


def file_counts(attempts: DataFrame, key: str = "record_id") -> DataFrame:
    """Outcome of fetching each paper's file from several sources, and how many papers had each: the source that answered first with a valid file, else failed; what was kept before is cached.

    ``attempts`` has the key, ``source, milliseconds, valid, cached``.
    """
    best = attempts.groupBy(key).agg(F.bool_or("cached").alias("c"), F.min_by(F.when(F.col("valid"), F.col("source")), F.when(F.col("valid"), F.struct("milliseconds", "source"))).alias("source"))
    status = F.when(F.col("c"), "cached").when(F.col("source").isNotNull(), "downloaded").otherwise("failed")
    return best.groupBy(status.alias("status"), F.when(~F.col("c"), F.col("source")).alias("source")).agg(F.count("*").alias("n"))


def comparison(scored: DataFrame, statements: DataFrame) -> DataFrame:
    """Corpora by score, those without one last, each with what is said of it and the next."""
    w = Window.partitionBy().orderBy(F.col("score").desc_nulls_last(), "corpus_id")  # one row for each corpus
    return scored.withColumn("line", F.row_number().over(w).cast("long")).join(statements.select("corpus_id", "outcome", "difference"), "corpus_id", "left").select("line", "corpus_id", "score", "outcome", "difference")


def panels(clusters: DataFrame, corpus: str = "corpus_id", most: int = 12) -> DataFrame:
    """The largest clusters of each corpus for a figure of at most ``most`` panels."""
    size = clusters.groupBy(corpus, "cluster").agg(F.count("*").alias("size"))
    w = Window.partitionBy(corpus).orderBy(F.desc("size"), "cluster")
    return size.withColumn("panel", F.row_number().over(w).cast("long")).filter(F.col("panel") <= most)
