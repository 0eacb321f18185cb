"""Queries of the two general data-quality operators: rows that fail to parse, and differences between snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions import columns as C
from bibloom.operators import badrows, snapshots
from bibloom.plans import sqltext
from bibloom.runtime import materialise


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.diff_snapshots(_table(spark, sf, "papers")).drop("old_row_id")


def p6_values(spark: SparkSession, sf: str) -> DataFrame:
    """The changes with the papers' identifiers and titles, new and old; only the differing papers' values are fetched."""
    papers = _table(spark, sf, "papers")
    changes = materialise(snapshots.diff_snapshots(papers), "changes")
    return snapshots.changed_values(papers, changes, ("pmid", "doi", "title")).select("change_type", "snapshot_no", "row_id", "old_row_id", "pmid", "old_pmid", "doi", "old_doi", "title", "old_title")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return badrows.bad_rows(_table(spark, sf, "chinese_records"), _table(spark, sf, "journals"), _table(spark, sf, "raw_rows"))


def p7_loaded_journals(spark: SparkSession, sf: str) -> DataFrame:
    """The good lines meant for journals, typed."""
    good = badrows.load_good(_table(spark, sf, "raw_rows"), "journals")
    return good.withColumn("impact_factor", F.col("impact_factor").try_cast("double"))


def p7_loaded_records(spark: SparkSession, sf: str) -> DataFrame:
    """The good lines meant for chinese_records, typed."""
    good = badrows.load_good(_table(spark, sf, "raw_rows"), "chinese_records")
    return good.withColumn("pub_year", C.one_year(F.col("pub_year")))


def p7_good_records(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of chinese_records that load, with the year they state."""
    return _table(spark, sf, "chinese_records").filter(~badrows.year_fault(F.col("pub_year_raw"))).select("rec_id", C.one_year(F.col("pub_year_raw")).alias("pub_year"))


def p7_good_journals(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of journals that load, with the serial number they state, null for a blank cell."""
    return _table(spark, sf, "journals").filter(~badrows.issn_fault(F.col("issn"))).select("row_id", C.valid_issn(F.col("issn")).alias("issn"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p6_found, p6_values, p7_found, p7_loaded_journals, p7_loaded_records, p7_good_records, p7_good_journals)}


SQL = {
    "p6_found": sqltext.CHANGES + " SELECT change_type, row_id, snapshot_no FROM changes",
    "p6_values": sqltext.VALUES,
    "p7_found": sqltext.BAD_ROWS,
    "p7_loaded_journals": sqltext.loaded("journals", {"impact_factor": "TRY_CAST({} AS double)".format}),
    "p7_loaded_records": sqltext.loaded("chinese_records", {"pub_year": sqltext.one_year}),
    "p7_good_records": f"SELECT rec_id, y AS pub_year FROM (SELECT rec_id, {sqltext.one_year('pub_year_raw')} AS y FROM chinese_records) WHERE y IS NOT NULL",
    "p7_good_journals": f"SELECT row_id, s AS issn FROM (SELECT row_id, issn AS cell, {sqltext.issn('issn')} AS s FROM journals) WHERE s IS NOT NULL OR {sqltext.blank('cell')}",
}
