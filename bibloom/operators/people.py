"""People behind bylines: keys, strata, rosters and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions import scalar as S
from bibloom.runtime import lookup, materialise, rows_of


def person_keys(entries: DataFrame) -> DataFrame:
    """``entries`` (corpus_id, last, fore, initials, orcid) with ``person_key``, ``n_owners``, ``flag``.

    Entries with an ORCID are that person. Others go by surname and first initial; if exactly one ORCID is seen under
    that loose key they belong to it. More than one is a confirmed collision, for those ORCIDs too; without any, several
    forenames, none the beginning of another, are a suspected one and compatible ones a benign drift; without a given name
    nothing is merged. Owners and forenames are gathered per loose key with partial aggregation, so a common name costs
    no window over all its entries.
    """
    given = F.coalesce(F.nullif(F.trim("fore"), F.lit("")), F.trim("initials"), F.lit(""))
    loose = F.concat_ws("|", F.lower(F.trim("last")), F.lower(F.substring(given, 1, 1)))
    e = entries.withColumns({"loose": loose, "_given": F.lower(given), "orcid": F.nullif(F.trim("orcid"), F.lit(""))})
    per = e.groupBy("corpus_id", "loose").agg(F.collect_set("orcid").alias("owners"), F.collect_set(F.when(F.col("orcid").isNull() & (F.col("_given") != ""), F.col("_given"))).alias("givens"))
    clash = F.exists("givens", lambda a: F.exists("givens", lambda b: ~F.startswith(a, b) & ~F.startswith(b, a)))
    n = F.size("owners")
    flag = F.when(n > 1, "collision_confirmed").when(n == 1, None).when(clash, "collision_suspected").when(F.size("givens") > 1, "drift_benign")
    per = per.select("corpus_id", "loose", n.cast("long").alias("n_owners"), F.when(n == 1, F.get("owners", F.lit(0))).alias("owner"), flag.alias("group_flag"))
    j = e.join(per, ["corpus_id", "loose"])
    shared = j.filter("orcid is not null and n_owners > 1").select("corpus_id", "orcid", F.lit("collision_confirmed").alias("orcid_flag")).distinct()
    no_given = F.col("_given") == ""
    own = F.col("orcid").isNotNull()
    key = F.when(own, F.col("orcid")).when(no_given, F.col("loose")).otherwise(F.coalesce("owner", "loose"))
    told = F.when(own, F.col("orcid_flag")).when(no_given, "incomplete_name").otherwise(F.col("group_flag"))
    return j.join(shared, ["corpus_id", "orcid"], "left").withColumns({"person_key": key, "flag": told}).drop("_given", "owner", "group_flag", "orcid_flag")


def display_names(entries: DataFrame) -> DataFrame:
    """The commonest name of each person; of equals the longest, then the last in order."""
    counted = entries.groupBy("corpus_id", "person_key", "name").agg(F.count("*").alias("c"))
    return counted.groupBy("corpus_id", "person_key").agg(F.max_by("name", F.struct("c", F.length("name"), "name")).alias("display_name"), F.sum("c").alias("n_entries"))


def people(appearances: DataFrame, windows: DataFrame, person: str = "person") -> DataFrame:
    """One row for each person of a corpus: counts, years, stratum and whether the window cuts off either end."""
    lead, senior = F.col("is_first"), F.col("is_last")
    p = appearances.groupBy("corpus_id", person).agg(
        F.count("*").alias("n_appearances"), F.count_if(lead).alias("n_first"), F.count_if(senior).alias("n_last"), F.min("year").cast("long").alias("first_year"), F.max("year").cast("long").alias("last_year"),
        F.min(F.when(lead, F.col("year"))).cast("long").alias("first_lead_year"), F.min(F.when(senior, F.col("year"))).cast("long").alias("first_last_year"), F.min("date_iso").alias("first_date"),
    )
    p = p.join(F.broadcast(windows), "corpus_id")
    return p.withColumns({"stratum": S.stratum(F.col("n_first"), F.col("n_last"), F.col("n_appearances")), "span_years": F.col("last_year") - F.col("first_year") + 1, "left_censored": F.col("first_year") <= F.col("window_start"), "right_censored": F.col("last_year") >= F.col("window_end") - 1})


def roster(people: DataFrame) -> DataFrame:
    """Persons per stratum of each corpus."""
    return people.groupBy("corpus_id").agg(F.count("*").alias("n_people"), *[F.count_if(F.col("stratum") == s).alias(f"n_{s.lower()}") for s in "ABCD"])


def name_gap(entries: DataFrame) -> DataFrame:
    """Distinct persons by full name and by surname with initial: the two bounds of how many there are."""
    given = F.coalesce(F.nullif(F.trim("fore"), F.lit("")), F.trim("initials"), F.lit(""))
    return entries.groupBy("corpus_id").agg(F.countDistinct(F.lower("last"), F.lower(given)).alias("n_strict"), F.countDistinct(F.lower("last"), F.lower(F.substring(given, 1, 1))).alias("n_loose"))


def rank(people: DataFrame, value: Column, person: str = "person") -> DataFrame:
    """Competition rank (1, 2, 2, 4) of each corpus's people by ``value``, ties told.

    A rank is one more than the people with a greater value, summed over the distinct values of a corpus and never over
    its people; a value that many share is spread over all tasks.
    """
    key = F.concat_ws("\x1f", F.col("corpus_id").cast("string"), F.col("value").cast("string"))
    v = materialise(people.select("corpus_id", person, value.cast("long").alias("value")).withColumn("key", key), "rank")
    counts = v.groupBy("corpus_id", "value", "key").agg(F.count("*").alias("n"))
    above = Window.partitionBy("corpus_id").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    table = materialise(counts.select("key", "n", (F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).alias("rank"), (F.col("n") > 1).alias("tied")), "rank")
    return lookup(v, table, "key", rows_of(v), spread=F.xxhash64(person)).select("corpus_id", person, "value", "rank", "tied")


def lead_to_senior(people: DataFrame, person: str = "person") -> DataFrame:
    """People seen both in first and in last slots."""
    return people.filter("stratum = 'D' and n_first > 0").select("corpus_id", person, "n_first", "n_last", "first_lead_year", "first_last_year")


def affiliation_signal(appearances: DataFrame, internal: Column, person: str = "person") -> DataFrame:
    """internal if any entry's affiliation is the target's, external if all known ones are others, unknown without any."""
    known = F.col("affiliation").isNotNull() & (F.trim("affiliation") != "")
    agg = appearances.groupBy("corpus_id", person).agg(F.bool_or(known & internal).alias("i"), F.bool_or(known).alias("k"))
    return agg.select("corpus_id", person, F.when(F.col("i"), "internal").when(F.col("k"), "external").otherwise("unknown").alias("signal"))
