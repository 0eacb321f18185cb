"""Two harvests of one corpus compared: windows, records, people and who held first slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per corpus the shared interval of two year windows and the years only one of them has; comparable only if all four ends are known."""
    j = old.select("corpus_id", F.col("window_start").alias("os"), F.col("window_end").alias("oe")).join(new.select("corpus_id", F.col("window_start").alias("ns"), F.col("window_end").alias("ne")), "corpus_id")
    years = lambda a, b: F.sequence(F.col(a), F.col(b))
    lo, hi = F.greatest("os", "ns"), F.least("oe", "ne")
    known = F.col("os").isNotNull() & F.col("oe").isNotNull() & F.col("ns").isNotNull() & F.col("ne").isNotNull()
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return j.select("corpus_id", known.alias("comparable"), F.when(lo <= hi, lo).cast("long").alias("shared_start"), F.when(lo <= hi, hi).cast("long").alias("shared_end"), text(F.array_except(years("os", "oe"), years("ns", "ne"))).alias("only_old"), text(F.array_except(years("ns", "ne"), years("os", "oe"))).alias("only_new"))


def rows(old: DataFrame, new: DataFrame, row: str = "record_id") -> DataFrame:
    """Rows of either side that no row of the other shares a key with: ``(corpus_id, row, status)``.

    Both have ``corpus_id, row, keys``. A row without keys can't be compared and is unkeyable on its side.
    """
    ex = lambda d: d.select("corpus_id", row, F.explode("keys").alias("key"))

    def one(a: DataFrame, b: DataFrame, status: str, bare: str) -> DataFrame:
        hit = ex(a).join(ex(b).select("corpus_id", "key").distinct(), ["corpus_id", "key"], "left_semi").select("corpus_id", row).distinct()
        alone = a.filter(F.size("keys") > 0).join(hit, ["corpus_id", row], "left_anti").select("corpus_id", row, F.lit(status).alias("status"))
        return alone.unionByName(a.filter(F.size("keys") == 0).select("corpus_id", row, F.lit(bare).alias("status")))

    return one(old, new, "only_old", "unkeyable_old").unionByName(one(new, old, "only_new", "unkeyable_new"))


def tallies(changes: DataFrame, papers: DataFrame, shared: DataFrame, row: str = "record_id") -> DataFrame:
    """Changes by whether their year lies in the shared window, outside it, or is unknown."""
    j = changes.join(papers.select(row, "year"), row, "left").join(shared.select("corpus_id", "shared_start", "shared_end"), "corpus_id", "left")
    inside = F.col("year").between(F.col("shared_start"), F.col("shared_end"))
    side = F.when(inside.isNull(), "unknown").when(inside, "inside").otherwise("outside")
    return j.groupBy("corpus_id", "status").agg(*[F.count_if(side == s).alias(s) for s in ("inside", "outside", "unknown")])


def first_slot_holders(changes: DataFrame, leads: DataFrame, row: str = "record_id") -> DataFrame:
    """Who leads the records that one side alone has: ``(corpus_id, status, person, n_first)``."""
    return changes.filter(F.col("status").isin("only_old", "only_new")).join(leads.select(row, "person"), row).groupBy("corpus_id", "status", "person").agg(F.count("*").alias("n_first"))


def slot_counterparts(holders: DataFrame, old_people: DataFrame, new_people: DataFrame) -> DataFrame:
    """Holders of first slots on records of one side, with their slots on both sides: ``(corpus_id, status, person, n_first, here, there, unknown_there)``.

    ``old_people`` and ``new_people`` have ``corpus_id, person, n_first``. No slots there and not being named there at all
    are told apart: the count is null for the latter.
    """
    side = lambda df, c: df.select("corpus_id", "person", F.col("n_first").alias(c))
    j = holders.join(side(old_people, "in_old"), ["corpus_id", "person"], "left").join(side(new_people, "in_new"), ["corpus_id", "person"], "left")
    old = F.col("status") == "only_old"
    here, there = F.when(old, F.col("in_old")).otherwise(F.col("in_new")), F.when(old, F.col("in_new")).otherwise(F.col("in_old"))
    return j.select("corpus_id", "status", "person", "n_first", here.alias("here"), there.alias("there"), there.isNull().alias("unknown_there"))


def identity_changes(old: DataFrame, new: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Which pieces of identity evidence two harvests of a corpus state differently; lists are compared as sets, null and empty are the same."""
    plain = lambda df, c: F.coalesce(F.array_join(F.array_sort(F.array_distinct(df[c])), "\x1f") if dict(df.dtypes)[c].startswith("array") else df[c].cast("string"), F.lit(""))
    tell = lambda df, prefix: df.select("corpus_id", *[plain(df, c).alias(f"{prefix}{c}") for c in fields])
    j = tell(old, "o_").join(tell(new, "n_"), "corpus_id")
    changed = F.array_compact(F.array(*[F.when(F.col(f"o_{c}") != F.col(f"n_{c}"), c) for c in fields]))
    return j.select("corpus_id", F.array_join(changed, ",").alias("changed_fields"), (F.size(changed) == 0).alias("same"))


def full(shared: DataFrame, identities: DataFrame, papers: DataFrame, people: DataFrame) -> DataFrame:
    """One row for each corpus: whether the two harvests were made by the same measure, and how many records and people each alone has.

    ``shared`` comes from windows(), ``identities`` from identity_changes(), ``papers`` and ``people`` from rows(). Another
    window or another identity is another measure: counts below it then compare unlike corpora.
    """
    n = lambda df, prefix: df.groupBy("corpus_id").agg(*[F.count_if(F.col("status") == s).alias(f"{prefix}_{s}") for s in ("only_old", "only_new", "unkeyable_old", "unkeyable_new")])
    j = shared.join(identities, "corpus_id", "left").join(n(papers, "records"), "corpus_id", "left").join(n(people, "people"), "corpus_id", "left")
    moved = ~F.col("comparable") | (F.col("only_old") != "") | (F.col("only_new") != "") | ~F.coalesce("same", F.lit(True))
    counts = [c for c in j.columns if c.startswith(("records_", "people_"))]
    return j.select("corpus_id", moved.alias("caliber_changed"), F.coalesce("changed_fields", F.lit("")).alias("changed_fields"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
