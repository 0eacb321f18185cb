"""Queries of the training-data operators over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions import columns as C
from bibloom.llm import canonical, chunks, copies, groups, leaks, matching, mixture, mojibake


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.found(_table(spark, sf, "chinese_records"))


def p1_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The affected fields with the text recovered from them."""
    return mojibake.repaired(_table(spark, sf, "chinese_records"), "rec_id", ("title", "authors_raw"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return matching.found(_table(spark, sf, "chinese_records"), _table(spark, sf, "works"))


def p2_matched(spark: SparkSession, sf: str) -> DataFrame:
    """The matches with their confidence."""
    return matching.match(_table(spark, sf, "chinese_records"), _table(spark, sf, "works"))


def _journal_keys() -> list[Column]:
    """Serial numbers of either cell share one name space, names have another."""
    serial = lambda c: F.concat(F.lit("s:"), C.valid_issn(F.col(c)))
    return [serial("issn"), serial("eissn"), F.when(F.col("journal_key") != "", F.concat(F.lit("n:"), F.col("journal_key")))]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return groups.row_groups(_table(spark, sf, "journals"), "row_id", _journal_keys())


def p3_row_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of journals that has a serial number or a name, with its group, rows alone included."""
    journals, keys = _table(spark, sf, "journals"), _journal_keys()
    found = p3_found(spark, sf)
    return journals.filter(F.coalesce(*keys).isNotNull()).select("row_id").join(found, "row_id", "left").select("row_id", F.coalesce("group_id", "row_id").alias("group_id"))


def p3_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of 16 links an order: one component in which v is tied to 2v/3 and which is dozens of links deep, and stars of ten."""
    v = _table(spark, sf, "orders").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.col("o_orderkey") * 8 + j)).alias("v"))
    deep = v.select((F.col("v") * 2).alias("u"), (F.floor(F.col("v") * 2 / 3) * 2).alias("v"))
    stars = v.select((F.col("v") * 2 + 1).alias("u"), ((F.col("v") - F.col("v") % 10) * 2 + 1).alias("v"))
    return groups.group_links(deep.unionByName(stars))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies.found(_table(spark, sf, "chinese_records"))


def p4_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """One record for each paper with the number of its copies."""
    return copies.collapsed(_table(spark, sf, "chinese_records")).select("rec_id", "title", "pub_year", "n_copies")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.canonical_values(_table(spark, sf, "chinese_records"), _table(spark, sf, "ref_values"))


def p5_values(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct values with the entries they mean, the similarity that decided and its margin."""
    typed = canonical.cells(_table(spark, sf, "chinese_records"), "rec_id", ("journal", "source_db")).select("field", "value").distinct()
    return canonical.map_values(typed, _table(spark, sf, "ref_values"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.found(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p8_scored(spark: SparkSession, sf: str) -> DataFrame:
    """All documents and items that share a seed, with the alignment's score: edited copies too."""
    return leaks.leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mixture.mixture(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares reached by the mixture beside the targets."""
    return mixture.shares(p9_mixture(spark, sf), _table(spark, sf, "mix_targets"))


def p9_marginals(spark: SparkSession, sf: str) -> DataFrame:
    """The languages and topics of the mixture beside what they were raked to."""
    return mixture.marginals(*mixture.fitted(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets")))


def p9_all_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The shares of a mixture that is to have as many tokens as all documents of its sources, so that scarce sources end at their number of repeats."""
    docs, targets = _table(spark, sf, "documents"), _table(spark, sf, "mix_targets")
    total = mixture.counted(docs, targets).agg(F.sum("n_tokens")).first()[0] or 0
    return mixture.shares(mixture.mixture(docs, targets, total_tokens=float(total)), targets)


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every document over the limit of its source."""
    return chunks.split(_table(spark, sf, "documents"), _table(spark, sf, "size_limits"))


def p10_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of all texts, those that were cut put together again from their pieces."""
    docs = _table(spark, sf, "documents").filter("text is not null").select("doc_id", "text")
    again = chunks.joined(p10_pieces(spark, sf)).withColumnRenamed("text", "rebuilt")
    return docs.join(again, "doc_id", "left").select("doc_id", F.md5(F.coalesce("rebuilt", "text")).alias("digest"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p2_found, p3_found, p4_found, p5_found, p8_found, p9_mixture, p10_pieces)
    return {f.__name__: f for f in (*found, p3_row_groups, p3_deep, p5_values, p10_rebuilt, p1_repaired, p2_matched, p4_collapsed, p8_scored, p9_shares, p9_marginals, p9_all_tokens)}
