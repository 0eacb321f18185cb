"""Gates that refuse a corpus, warnings that mark one, and the counts they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least share of records whose target has an identifier of the open index.
LEAST_OPENALEX = 0.5


def gates(envelope: DataFrame, papers: DataFrame, n_authors: Column) -> DataFrame:
    """``(corpus_id, n_records, bare, refused, gate)`` of every corpus of the envelope: nothing kept, counts that can't be, or records without structured authors.

    ``envelope`` has a row for each corpus, whether it has records or not, and may state ``fetched`` and ``verified``.
    """
    a = papers.groupBy("corpus_id").agg(F.count("*").alias("n_records"), F.count_if(F.coalesce(n_authors, F.lit(0)) == 0).alias("bare"))
    told = all(c in envelope.columns for c in ("fetched", "verified"))
    j = envelope.join(a, "corpus_id", "left").fillna(0, ["n_records", "bare"])
    gate = F.when(F.col("verified") > F.col("fetched"), "inconsistent_counts") if told else F.when(F.lit(False), "")
    gate = gate.when(F.col("n_records") == 0, "empty_corpus").when(F.col("bare") > 0, "no_structured_authors")
    return j.select("corpus_id", "n_records", "bare", gate.isNotNull().alias("refused"), gate.alias("gate"))


def harvest_counts(envelope: DataFrame) -> DataFrame:
    """Fetched, verified and rejected of each harvest; where more were verified than fetched nothing is rejected and the counts are marked."""
    left = F.col("fetched") - F.col("verified")
    return envelope.select("corpus_id", "fetched", "verified", F.when(left >= 0, left).alias("rejected"), F.coalesce(left < 0, F.lit(False)).alias("inconsistent"))


def identity_reach(papers: DataFrame, target: DataFrame, strong: int = 2, record: str = "record_id") -> DataFrame:
    """Records whose target is located, and with strong evidence, of all."""
    j = papers.select("corpus_id", record).join(target.select(record, "pi_evidence"), record, "left")
    return j.groupBy("corpus_id").agg(F.count("*").alias("total"), F.count("pi_evidence").alias("reached"), F.count_if(F.col("pi_evidence") >= strong).alias("strongly_reached"))


def warnings(reach: DataFrame, envelope: DataFrame | None = None) -> DataFrame:
    """One row for each warning of a corpus, with what it was seen by: target_not_located, weak_identity, incomplete_harvest, identity_fallback.

    Weak identity has three situations: no identifier of any kind on any record, an identifier of the open index on a
    minority of them, and one that was never asked for. Its share must be at least LEAST_OPENALEX to stand for the rest.
    """
    r = reach if envelope is None else reach.join(envelope, "corpus_id", "left")
    has = lambda c: F.col(c) if c in r.columns else F.lit(None)
    share = has("openalex_share").cast("double")
    weak = (F.col("strongly_reached") == 0) & (F.coalesce(share, F.lit(0.0)) < LEAST_OPENALEX)
    one = lambda when, kind, seen: F.when(when, F.struct(F.lit(kind).alias("warning"), seen.alias("situation")))
    kinds = F.array_compact(F.array(
        one((F.col("total") > 0) & (F.col("reached") == 0), "target_not_located", F.lit("none_of_the_records")),
        one(weak, "weak_identity", F.when(share.isNull(), "index_not_asked").when(share > 0, "index_on_a_minority").otherwise("no_identifier")),
        one(has("esearch_count").cast("long") > has("pmids_returned").cast("long"), "incomplete_harvest", F.lit("fewer_than_found")),
        one(F.coalesce(has("fallback_fired").cast("boolean"), F.lit(False)), "identity_fallback", F.lit("all_kept")),
    ))
    return r.select("corpus_id", F.explode(kinds).alias("w")).select("corpus_id", "w.warning", "w.situation")


def corpus_counts(papers: DataFrame, tier: Column, source: Column) -> DataFrame:
    """Records by evidence and by source, in long form: ``(corpus_id, kind, name, n)``."""
    cells = F.array(F.struct(F.lit("evidence").alias("kind"), tier.alias("name")), F.struct(F.lit("source").alias("kind"), source.alias("name")))
    return papers.select("corpus_id", F.explode(cells).alias("c")).groupBy("corpus_id", "c.kind", "c.name").agg(F.count("*").alias("n"))


def identity_hints(entries: DataFrame, value: Column, top: int = 5) -> DataFrame:
    """The commonest values (addresses, affiliations) of a corpus's matched slots, ties by name: a report of the top few."""
    c = entries.filter(value.isNotNull()).groupBy("corpus_id", value.alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("corpus_id").orderBy(F.desc("n"), "value")
    return c.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= top)
