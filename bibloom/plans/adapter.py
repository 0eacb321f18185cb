"""The corpus model over the driver's tables, as frames and as the SQL that the same queries start from.

A corpus is a nation's customers, a record an order, its byline the order's lines, a person a part; the target of a corpus
is any line of a supplier of the same nation, and how the line was returned is the evidence for it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.operators import corpus, people
from bibloom.runtime import materialise

LONG = "long"


def _rank():
    return F.when(F.col("l_returnflag") == "R", 4).when(F.col("l_returnflag") == "A", 2).otherwise(1)


@dataclass
class Model:
    """Frames of one data directory; each is built when first asked for."""

    spark: SparkSession
    sf: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    @cached_property
    def papers(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        j = o.join(c, o["o_custkey"] == c["c_custkey"])
        status = F.col("o_orderstatus")
        return j.select(
            F.col("c_nationkey").cast(LONG).alias("corpus_id"), F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("group_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_iso"), F.year("o_orderdate").cast(LONG).alias("year"),
            F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("journal"), F.col("c_mktsegment").alias("topic"), F.when(status != "P", F.floor(F.col("o_totalprice") / 20000).cast(LONG)).alias("cites"), status.alias("status"),
        )

    @cached_property
    def entries(self) -> DataFrame:
        line = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus")
        s = self.table("supplier").select("s_suppkey", "s_nationkey").join(self.table("nation").select("n_nationkey", F.col("n_name").alias("affiliation")), F.col("s_nationkey") == F.col("n_nationkey"))
        p = self.papers.select("corpus_id", "record_id", "year", "date_iso")
        # the lines meet their order before they are numbered, so that they are partitioned by it once for all that follows
        j = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_orderkey") == F.col("record_id"))
        numbered = corpus.byline(j, "record_id", ("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")).withColumn("is_home", F.col("s_nationkey") == F.col("corpus_id"))
        return corpus.mark_target(numbered, F.when(F.col("is_home"), _rank())).select(
            "corpus_id", "record_id", "year", "date_iso", "idx", "n", F.col("l_partkey").alias("person"), "affiliation", "is_home", (F.col("l_returnflag") == "A").alias("equal_contrib"), (F.col("l_linestatus") == "F").alias("is_corresponding"), "l_returnflag", "pi_index",
        )

    @cached_property
    def sizes(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.count("*").alias("n"))

    @cached_property
    def target(self) -> DataFrame:
        return corpus.resolve_target(self.entries.filter("is_home").drop("pi_index"), _rank())

    @cached_property
    def appearances(self) -> DataFrame:
        return corpus.appearances(self.entries)

    @cached_property
    def windows(self) -> DataFrame:
        return corpus.window_years(self.papers)

    @cached_property
    def people(self) -> DataFrame:
        return people.people(self.appearances, self.windows)

    @cached_property
    def leads(self) -> DataFrame:
        return self.entries.filter("idx = 0")


    def keep(self, *names: str) -> Model:
        """The same model with papers, entries and people (or those named) as written tables, for queries that read them several times: each source table is read once."""
        out = Model(self.spark, self.sf)
        for name in names or ("papers", "entries", "people"):
            out.__dict__[name] = materialise(getattr(out, name), name)
        return out


#: Common table expressions, each after those that it uses.
CTES = {
    "paper": """SELECT CAST(c_nationkey AS BIGINT) AS corpus_id, o_orderkey AS record_id, o_custkey AS group_id, strftime(o_orderdate, '%Y-%m-%d') AS date_iso, CAST(year(o_orderdate) AS BIGINT) AS yr,
        c_mktsegment || ' ' || o_orderpriority AS journal, c_mktsegment AS topic, CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 20000) AS BIGINT) END AS cites, o_orderstatus AS status
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "entry": """SELECT p.corpus_id, p.record_id, p.yr, p.date_iso, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) - 1 AS idx, count(*) OVER (PARTITION BY l_orderkey) AS n,
        l_partkey AS person, n_name AS affiliation, s_nationkey = p.corpus_id AS is_home, l_returnflag = 'A' AS equal_contrib, l_linestatus = 'F' AS is_corresponding, l_returnflag
        FROM paper p JOIN lineitem ON l_orderkey = p.record_id JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "sized": "SELECT l_orderkey AS record_id, count(*) AS n FROM lineitem GROUP BY 1",
    "ranked": "SELECT record_id, idx, CASE l_returnflag WHEN 'R' THEN 4 WHEN 'A' THEN 2 ELSE 1 END AS ev FROM entry WHERE is_home",
    "target": """SELECT r.record_id, min(idx) AS pi_index, b.best AS pi_evidence, count(*) > 1 AS pi_ambiguous FROM ranked r JOIN (SELECT record_id, max(ev) AS best FROM ranked GROUP BY 1) b ON r.record_id = b.record_id AND r.ev = b.best GROUP BY r.record_id, b.best""",
    "appearance": "SELECT e.*, idx = 0 AS is_first, idx = n - 1 AS is_last FROM entry e LEFT JOIN target t ON e.record_id = t.record_id WHERE t.pi_index IS NULL OR e.idx <> t.pi_index",
    "win": "SELECT corpus_id, min(yr) AS window_start, max(yr) AS window_end FROM paper GROUP BY 1",
    "person": """SELECT a.*, w.window_start, w.window_end, CASE WHEN n_last > 0 THEN 'D' WHEN n_first > 0 THEN 'A' WHEN n_appearances >= 2 THEN 'B' ELSE 'C' END AS stratum,
        last_year - first_year + 1 AS span_years, first_year <= window_start AS left_censored, last_year >= window_end - 1 AS right_censored
        FROM (SELECT corpus_id, person, count(*) AS n_appearances, count(*) FILTER (WHERE is_first) AS n_first, count(*) FILTER (WHERE is_last) AS n_last, min(yr) AS first_year, max(yr) AS last_year,
              min(yr) FILTER (WHERE is_first) AS first_lead_year, min(yr) FILTER (WHERE is_last) AS first_last_year, min(date_iso) AS first_date FROM appearance GROUP BY 1, 2) a JOIN win w ON a.corpus_id = w.corpus_id""",
    "spine": "SELECT corpus_id, window_start, window_end, unnest(range(window_start, window_end + 1)) AS yr FROM win",
}


def sql(body: str) -> str:
    """``body`` after the expressions it needs."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in reversed(CTES):
            if name not in used and _names(text, name):
                used.append(name)
                need(CTES[name])

    need(body)
    ordered = [n for n in CTES if n in used]
    return ("WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in ordered) + "\n" if ordered else "") + body


def _names(text: str, name: str) -> bool:
    import re

    return bool(re.search(rf"(?:FROM|JOIN)\s+{name}\b", text))
