"""Clusters of records that share people, and groups of journal names that abbreviate each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.functions import scalar as S
from bibloom.operators.components import propagate, shared_key_edges
from bibloom.operators.metrics import LEAST
from bibloom.runtime import lookup, materialise, rows_of


def clusters(papers: DataFrame, members: DataFrame, corpus: str = "corpus_id", record: str = "record_id", person: str = "person") -> DataFrame:
    """``(corpus, record, cluster)``: records of a corpus that share a person, directly or through others.

    The least record of a cluster names it. A person ties its records in a star, not in pairs. Corpora of fewer than 5
    records are left out.
    """
    big = papers.groupBy(corpus).agg(F.count("*").alias("k")).filter(F.col("k") >= LEAST).select(corpus)
    p = papers.select(corpus, record).join(big, corpus)
    m = materialise(members.select(corpus, record, person).join(big, corpus).distinct(), "members")
    key = F.concat_ws("\x1f", F.col(corpus).cast("string"), F.col(person).cast("string"))
    edges = shared_key_edges(m.select(record, key.alias("key")), record, [F.col("key")], "cohesion")
    labels = propagate(edges, "cohesion")
    least = materialise(labels.groupBy("label").agg(F.min("u").alias("cluster"), F.count("*").alias("n")), "cohesion")
    named = lookup(labels, least, "label", rows_of(labels), spread=F.xxhash64("u")).select(F.col("u").alias(record), "cluster")
    return p.join(named, record, "left").select(corpus, record, F.coalesce("cluster", F.col(record)).alias("cluster"))


def cluster_summary(found: DataFrame, papers: DataFrame, corpus: str = "corpus_id", record: str = "record_id") -> DataFrame:
    """Size, years and number of journals of each cluster, and its share of the corpus's records."""
    j = found.join(papers.select(record, "year", "journal"), record)
    a = j.groupBy(corpus, "cluster").agg(F.count("*").alias("size"), F.min("year").cast("long").alias("first_year"), F.max("year").cast("long").alias("last_year"), F.countDistinct("journal").alias("n_journals"))
    n = found.groupBy(corpus).agg(F.count("*").alias("n_records"))
    return a.join(n, corpus)


def person_edges(found: DataFrame, members: DataFrame, least: int = 2, corpus: str = "corpus_id", record: str = "record_id", person: str = "person") -> DataFrame:
    """Pairs of people who are on at least ``least`` records of a cluster together; pairs are made within a record only."""
    m = members.select(corpus, record, person).distinct().join(found, [corpus, record])
    recurring = m.groupBy(corpus, "cluster", person).agg(F.count("*").alias("k")).filter(F.col("k") >= least).drop("k")
    m = m.join(recurring, [corpus, "cluster", person]).groupBy(corpus, "cluster", record).agg(F.array_sort(F.collect_set(person)).alias("ps"))
    pair = F.flatten(F.transform("ps", lambda a: F.transform(F.filter("ps", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return m.select(corpus, "cluster", F.explode(pair).alias("x")).groupBy(corpus, "cluster", "x.a", "x.b").agg(F.count("*").alias("n_records")).filter(F.col("n_records") >= least)


def alias_groups(names: DataFrame) -> DataFrame:
    """``(journal, anchor)``: names that abbreviate a commoner one.

    ``names`` has ``journal, n``. A name's anchor is the commonest name (ties: the first in order) that has as many
    tokens, each the beginning of its partner or the other way round. Names meet by the number of tokens and the first
    letter of each, so no name is compared with all.
    """
    key = S.journal_key(F.col("journal"))
    tok = S.journal_tokens(key)
    t = names.withColumn("tok", tok).withColumn("sig", F.array_join(F.transform("tok", lambda x: F.substring(x, 1, 1)), "")).filter(F.size("tok") > 0)
    o = t.select(F.col("journal").alias("anchor"), F.col("n").alias("an"), F.col("tok").alias("atok"), "sig")
    hit = t.join(o, "sig").filter(S.abbreviates(F.col("tok"), F.col("atok")) & ((F.col("an") > F.col("n")) | ((F.col("an") == F.col("n")) & (F.col("anchor") <= F.col("journal")))))
    return hit.groupBy("journal").agg(F.min_by("anchor", F.struct(-F.col("an"), "anchor")).alias("anchor"))
