"""From records and bylines to prepared papers, exclusions and appearances. Every step works on all corpora at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions import scalar as S

#: A byline from this length on is left out of people metrics, and one from LARGE_TEAM on is reported.
MANY_AUTHORS, LARGE_TEAM = 50, 20
#: Why a record is left out, in the order in which the first that applies counts.
REASONS = ("unparseable_date", "correction_or_comment", "empty_author_list", "duplicate_pmid", "duplicate_doi", "hyperauthorship")


def byline(entries: DataFrame, record: str = "record_id", order: tuple[str, ...] = ("position",)) -> DataFrame:
    """Entries with ``idx`` (from 0) and ``n`` (the byline's length); ties of ``order`` should be broken by it."""
    w = Window.partitionBy(record)
    return entries.withColumns({"idx": (F.row_number().over(w.orderBy(*order)) - 1).cast("long"), "n": F.count("*").over(w)})


def explode_byline(papers: DataFrame, authors: str = "authors", record: str = "record_id") -> DataFrame:
    """One row for each entry of an array of author structs, consortia marked; papers without authors give none."""
    rest = [F.col(c) for c in papers.columns if c != authors]
    e = papers.select(*rest, F.size(authors).cast("long").alias("n_entries"), F.posexplode(authors).alias("pos", "a")).select("*", "a.*").drop("a")
    e = e.withColumn("is_consortium", S.consortium(F.col("name"), F.col("last"), F.col("fore"), F.col("initials")))
    w = Window.partitionBy(record)
    persons = e.filter(~F.col("is_consortium"))
    numbered = persons.withColumns({"idx": (F.row_number().over(w.orderBy("pos")) - 1).cast("long"), "n": F.count("*").over(w)})
    return numbered


def resolve_target(entries: DataFrame, evidence: Column, record: str = "record_id") -> DataFrame:
    """Per record the entry with the strongest evidence of being the target person.

    ``(record, pi_index, pi_evidence, pi_ambiguous)``: among equals the first entry is taken and the tie is told, never
    hidden. ``evidence`` is a rank of S.EVIDENCE; records in which no entry has any (0 or null) are absent. One aggregate,
    so the entries are read once.
    """
    e = entries.withColumn("ev", evidence.cast("long")).filter("ev > 0")
    ranks = sorted(r for r in S.EVIDENCE.values() if r > 0)
    best = e.groupBy(record).agg(F.max(F.struct("ev", (-F.col("idx")).alias("back"))).alias("b"), F.array(*[F.count_if(F.col("ev") == r) for r in ranks]).alias("k"))
    tied = F.get("k", (F.array_position(F.array(*map(F.lit, ranks)), F.col("b.ev").cast("int")) - 1).cast("int")) > 1
    return best.select(record, (-F.col("b.back")).alias("pi_index"), F.col("b.ev").alias("pi_evidence"), tied.alias("pi_ambiguous"))


def mark_target(entries: DataFrame, evidence: Column, record: str = "record_id") -> DataFrame:
    """Entries with ``pi_index``, the entry that resolve_target() chooses, null where none has evidence: a window over each record, without a join."""
    best = F.max(F.when(evidence > 0, F.struct(evidence.cast("long").alias("ev"), (-F.col("idx")).alias("back")))).over(Window.partitionBy(record))
    return entries.withColumn("pi_index", -best["back"])


def exclusion_reasons(papers: DataFrame, n_authors: Column, record: str = "record_id", many: int = MANY_AUTHORS) -> DataFrame:
    """``papers`` with ``reason``, null for those kept. A date without a year is unparseable, whatever year stands in for it.

    Of records with one PMID the first (by record) is kept, of those with one DOI the one with the least PMID; records
    already left out don't count. Records without the identifier never count as its duplicates, and are spread over all
    partitions, many as they may be.
    """
    key = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    apart = lambda c: F.coalesce(F.col(c), F.concat(F.lit("\x1f"), F.col(record).cast("string")))
    undated = ~S.date_parseable(F.col("pub_date")) if "pub_date" in papers.columns else F.col("year").isNull()
    early = F.when(undated, REASONS[0]).when(S.is_correction(F.col("title")), REASONS[1]).when(n_authors == 0, REASONS[2])
    p = papers.withColumns({"_p": key(F.col("pmid")), "_d": key(F.col("doi")), "_e": early})
    by_pmid = Window.partitionBy("corpus_id", apart("_p"), F.col("_e").isNull()).orderBy(record)
    p = p.withColumn("_dup_p", F.col("_p").isNotNull() & F.col("_e").isNull() & (F.row_number().over(by_pmid) > 1))
    live = ~F.col("_dup_p") & F.col("_e").isNull()
    by_doi = Window.partitionBy("corpus_id", apart("_d"), live).orderBy(F.col("_p").try_cast("long").asc_nulls_last(), "_p", record)
    p = p.withColumn("_dup_d", F.col("_d").isNotNull() & live & (F.row_number().over(by_doi) > 1))
    reason = F.when(F.col("_e").isNotNull(), F.col("_e")).when(F.col("_dup_p"), REASONS[3]).when(F.col("_dup_d"), REASONS[4]).when(n_authors >= many, REASONS[5])
    return p.withColumn("reason", reason).drop("_p", "_d", "_e", "_dup_p", "_dup_d")


def numbered(df: DataFrame, keys: list[str], order: str, into: str, width: int = 1 << 16) -> DataFrame:
    """``df`` with its rows' places, from 0, in the order of a whole number that is unique within each key.

    Rows are numbered within ranges of ``width`` numbers and the rows of the ranges before are added, so a key that holds
    most of all rows is no single task.
    """
    part = F.floor(F.col(order) / width)
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1
    ranged = df.withColumn("_range", part)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_before", before).drop("_n")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "_range")]
    j = ranged.withColumn("_within", within).alias("a").join(counts.alias("b"), same)
    return j.select(*[F.col(f"a.{c}").alias(c) for c in df.columns], (F.col("_before") + F.col("_within")).cast("long").alias(into))


def title_duplicates(papers: DataFrame, record: str = "record_id") -> DataFrame:
    """Groups of records of a corpus whose titles have the same ASCII letters and digits: ``(corpus_id, key, n, first)``."""
    key = F.regexp_replace(F.lower("title"), "[^a-z0-9]", "")
    return papers.withColumn("key", key).filter("key <> ''").groupBy("corpus_id", "key").agg(F.count("*").alias("n"), F.min(record).alias("first")).filter("n > 1")


def window_years(papers: DataFrame) -> DataFrame:
    """``(corpus_id, window_start, window_end)``: the first and last year of each corpus."""
    return papers.groupBy("corpus_id").agg(F.min("year").cast("long").alias("window_start"), F.max("year").cast("long").alias("window_end"))


def stated_window(papers: DataFrame, envelope: DataFrame) -> DataFrame:
    """window_years(), but for the years of the search (``mindate, maxdate``, free text) where the envelope states them; an end before its start is moved to it."""
    year = lambda c: F.nullif(F.regexp_extract(c, r"([0-9]{4})", 1), F.lit("")).cast("long")
    j = envelope.select("corpus_id", year("mindate").alias("lo"), year("maxdate").alias("hi")).join(window_years(papers), "corpus_id", "left")
    start = F.coalesce("lo", "window_start")
    return j.select("corpus_id", start.alias("window_start"), F.greatest(start, F.coalesce("hi", "window_end")).alias("window_end"))


def lifted_evidence(target: DataFrame, record_ids: DataFrame, wanted: str, record: str = "record_id") -> DataFrame:
    """The target's evidence as reported: an open-index id anywhere on the record lifts it to that rank. The entry chosen stays."""
    j = target.join(record_ids.select(record, F.array_contains("author_ids", wanted).alias("_has")), record, "left")
    lifted = F.when(F.coalesce("_has", F.lit(False)), F.greatest("pi_evidence", F.lit(S.EVIDENCE["openalex"]))).otherwise(F.col("pi_evidence"))
    return j.withColumn("reported_evidence", lifted.cast("long")).drop("_has")


def spine(papers: DataFrame) -> DataFrame:
    """``(corpus_id, year)`` for every year of each corpus's window, years without records included."""
    return window_years(papers).select("corpus_id", "window_start", "window_end", F.explode(F.sequence("window_start", "window_end")).alias("year"))


def appearances(entries: DataFrame, target: DataFrame | None = None, record: str = "record_id") -> DataFrame:
    """Entries other than the target's slot, with ``is_first`` and ``is_last`` of the persons of the byline. Without ``target`` the entries come from mark_target()."""
    e = entries if target is None else entries.drop("pi_index").join(target.select(record, "pi_index"), record, "left")
    e = e.filter("pi_index is null or idx <> pi_index")
    return e.withColumns({"is_first": F.col("idx") == 0, "is_last": F.col("idx") == F.col("n") - 1}).drop("pi_index")
