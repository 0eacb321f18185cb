"""Which records of a search are the target person's: roles in the byline, evidence of identity, and the records kept."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.functions import scalar as S

#: Roles of a byline entry, in the order in which they are told, and evidence of identity, strongest first.
ROLES, EVIDENCE = ("first", "last", "corresponding"), ("orcid", "email", "affiliation")
#: A record that was kept although nobody in it could be verified, and one of a search that kept all it found.
NAME_ONLY, FALLBACK = "name_only", "fallback"


@dataclass
class Identity:
    """What is known of the target person; without keywords the affiliation that was searched for stands for them."""

    name: str
    orcid: str = ""
    email_domains: list[str] = field(default_factory=list)
    affiliation_keywords: list[str] = field(default_factory=list)
    affiliation: str = ""
    require_affiliation: bool = True


def role_filter(entries: DataFrame, who: Identity, record: str = "record_id") -> DataFrame:
    """``(record, kept, roles, evidence, idx)`` of every record in which an entry can be the person in a leading role.

    ``entries`` has the record, ``idx`` (from 0), ``n`` and the cells ``last, fore, initials, orcid, email, affiliation,
    is_corresponding``. An entry counts if its name fits and it is first, last or corresponding. The first entry in the
    byline with any evidence decides, and of its evidence the strongest. Where none has any, the record is kept as
    ``name_only`` only if no affiliation is required, else it is refused. Records without such an entry are absent.
    """
    corresponding = F.coalesce(F.col("is_corresponding"), F.lit(False))
    held = F.array_compact(F.array(F.when(F.col("idx") == 0, ROLES[0]), F.when(F.col("idx") == F.col("n") - 1, ROLES[1]), F.when(corresponding, ROLES[2])))
    orcid = (F.lit(who.orcid) != "") & (F.lower(F.trim("orcid")) == who.orcid.lower())
    keywords = who.affiliation_keywords or ([who.affiliation] if who.affiliation else [])
    placed = S.affiliation_keyword(F.col("affiliation"), keywords).isNotNull() if keywords else F.lit(False)
    evidence = F.when(F.coalesce(orcid, F.lit(False)), EVIDENCE[0]).when(S.email_matches(F.col("email"), who.email_domains), EVIDENCE[1]).when(placed, EVIDENCE[2])
    e = entries.filter(S.name_match(who.name, F.col("last"), F.col("fore"), F.col("initials"))).select(record, "idx", held.alias("roles"), evidence.alias("evidence")).filter(F.size("roles") > 0)
    first = F.min_by(F.struct("idx", "roles", "evidence"), F.struct(F.col("evidence").isNull().alias("bare"), "idx"))
    one = e.groupBy(record).agg(first.alias("e"))
    kept = F.col("e.evidence").isNotNull() | F.lit(not who.require_affiliation)
    return one.select(record, kept.alias("kept"), F.array_join("e.roles", " / ").alias("roles"), F.when(kept, F.coalesce("e.evidence", F.lit(NAME_ONLY))).alias("evidence"), F.col("e.idx").cast("long").alias("idx"))


def search_counts(filtered: DataFrame, total: DataFrame, corpus: str = "corpus_id") -> DataFrame:
    """Per corpus records fetched, verified, kept by name only, refused and without the person. ``total`` has a row for each record fetched."""
    j = total.join(filtered, "record_id", "left")
    verified = F.coalesce(F.col("evidence").isin(*EVIDENCE), F.lit(False))
    return j.groupBy(corpus).agg(F.count("*").alias("fetched"), F.count_if(verified).alias("verified"), F.count_if(F.coalesce(F.col("evidence") == NAME_ONLY, F.lit(False))).alias("name_only"), F.count_if(~F.coalesce(F.col("kept"), F.lit(True))).alias("refused"), F.count_if(F.col("kept").isNull()).alias("absent"))


def tier_of(mark: Column) -> Column:
    """The evidence that a stored mark names, or null where it names none, as that of a record kept by the fallback."""
    return F.coalesce(*[F.when(F.contains(mark, F.lit(x)), x) for x in EVIDENCE])


def is_name_only(mark: Column) -> Column:
    """Whether a stored mark says that a record was kept by name alone; a record without a mark says nothing."""
    return F.coalesce(F.contains(mark, F.lit(NAME_ONLY)) | (F.trim(mark) == FALLBACK), F.lit(False))


def record_author_ids(byline_ids: Column, stored: Column) -> Column:
    """All open-index ids of a record, those of its byline and those kept with it, each once and in order."""
    valid = lambda ids: F.array_compact(F.transform(F.coalesce(ids, F.array().cast("array<string>")), S.openalex_id))
    return F.array_sort(F.array_union(valid(byline_ids), valid(stored)))


def author_candidates(people: DataFrame, searched: Column, top: int = 3) -> DataFrame:
    """Persons of an index whose name was searched for: ``(searched, person, works, institutions, topics, n_candidates, resolution, adopted)``.

    ``people`` has a row for each work: ``person, institution, topic, year`` and what ``searched`` reads. Institutions come
    in the order first seen, topics are the ``top`` commonest. A person is adopted only if no other has the name: the
    resolution is unique then, else ambiguous.
    """
    rows = people.withColumn("searched", searched).filter("searched is not null")
    key = ["searched", "person"]
    seen = rows.filter(F.trim("institution") != "").groupBy(*key, "institution").agg(F.min("year").alias("since"))
    places = seen.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("since", "institution"))), lambda x: x["institution"]).alias("institutions"))
    often = rows.filter(F.trim("topic") != "").groupBy(*key, "topic").agg(F.count("*").alias("k"))
    topics = often.groupBy(*key).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "topic"))), lambda x: x["topic"]), 1, top).alias("topics"))
    found = rows.groupBy(*key).agg(F.count("*").alias("works"))
    n = found.groupBy("searched").agg(F.count("*").alias("n_candidates"))
    j = found.join(places, key, "left").join(topics, key, "left").join(n, "searched")
    unique = F.col("n_candidates") == 1
    return j.select(*key, "works", "institutions", "topics", "n_candidates", F.when(unique, "unique").otherwise("ambiguous").alias("resolution"), unique.alias("adopted"))


def resolutions(searches: DataFrame, candidates: DataFrame, failed: Column | None = None) -> DataFrame:
    """``(searched, resolution, person)`` of every search: error, none, unique with the person, or ambiguous."""
    one = candidates.groupBy("searched").agg(F.max("resolution").alias("r"), F.min(F.when(F.col("adopted"), F.col("person"))).alias("person"))
    error = failed if failed is not None else F.lit(False)
    return searches.join(one, "searched", "left").select("searched", F.when(error, "error").otherwise(F.coalesce("r", F.lit("none"))).alias("resolution"), F.when(~error, F.col("person")).alias("person"))


def institution_lookup(names: DataFrame, index: DataFrame, most: int = 3) -> DataFrame:
    """``(name, best, hits)``: of the institutions whose name holds the one sought, the one with most works, and up to ``most`` of them by works.

    Both tables are keyed by ``word``, the rarest word of the name, so that no name meets the whole index.
    """
    j = names.join(index, "word").filter(F.contains(F.lower("institution"), F.lower("name")))
    a = j.groupBy("name").agg(F.slice(F.transform(F.array_sort(F.collect_set(F.struct((-F.col("works")).alias("w"), "institution"))), lambda x: x["institution"]), 1, most).alias("hits"))
    return names.select("name").distinct().join(a, "name", "left").select("name", F.get("hits", F.lit(0)).alias("best"), F.array_join("hits", "; ").alias("hits"))
