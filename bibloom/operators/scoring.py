"""Composite scores from normalised components, ranks, bands and statements on neighbours."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions.scalar import clamp

#: Values at which a component is full: years to a lead, records a year, h-index, median citations (fixed values).
FULL = {"time_to_lead": 4.0, "records_per_year": 8.0, "citation_h_index": 15.0, "citation_median": 20.0}
COMPONENTS = ("lead_slot_share", "people_with_lead_slot", "time_to_lead", "records_per_year", "citation_h_index", "citation_median")
#: Least components of a score, share of papers with a count, people, and fully observed years.
LEAST_COMPONENTS, LEAST_COVERAGE, LEAST_PEOPLE, LEAST_YEARS = 3, 0.5, 5, 3


def weights(given: dict[str, float] | None = None) -> dict[str, float]:
    """Checked weights; components not given weigh 1. Unknown names and values below 0 or not finite are refused."""
    for k, v in (given or {}).items():
        if k not in COMPONENTS:
            raise ValueError(f"unknown component {k}")
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v < 0:
            raise ValueError(f"weight of {k} is {v}")
    return {k: float((given or {}).get(k, 1.0)) for k in COMPONENTS}


def components(slots: DataFrame, partition: DataFrame, waits: DataFrame, years: DataFrame, impact: DataFrame) -> DataFrame:
    """Long table ``(corpus_id, component, value)``; a component that can't be had has no row, never a 0."""
    one = lambda df, name, value, ok: df.filter(ok).select("corpus_id", F.lit(name).alias("component"), clamp(value).alias("value"))
    c = F.col
    full = years.filter("not partial and not indexing_lag").groupBy("corpus_id").agg(F.count("*").alias("n"), F.percentile("count", 0.5).alias("m"))
    covered = (c("covered") >= LEAST_PEOPLE) & (c("covered") >= LEAST_COVERAGE * c("denominator"))
    parts = [
        one(slots, COMPONENTS[0], c("n_a") / c("denominator"), ~c("suppressed")),
        one(partition, COMPONENTS[1], c("holds_lead") / (c("holds_lead") + c("observed_without_lead")), c("holds_lead") + c("observed_without_lead") >= LEAST_PEOPLE),
        one(waits, COMPONENTS[2], 1 - c("median") / FULL["time_to_lead"], c("median").isNotNull()),
        one(full, COMPONENTS[3], c("m") / FULL["records_per_year"], c("n") >= LEAST_YEARS),
        one(impact, COMPONENTS[4], c("h") / FULL["citation_h_index"], covered & c("h").isNotNull()),
        one(impact, COMPONENTS[5], c("median") / FULL["citation_median"], covered & c("median").isNotNull()),
    ]
    return reduce(DataFrame.unionByName, parts)


def scores(parts: DataFrame, given: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of what is available, times 100, to one decimal; null under three components that weigh."""
    w = weights(given)
    table = F.create_map(*[F.lit(x) for k, v in w.items() for x in (k, v)])
    p = parts.withColumn("w", table[F.col("component")])
    a = p.groupBy("corpus_id").agg(F.count_if(F.col("w") > 0).alias("n_components"), F.sum(F.col("w") * F.col("value")).alias("s"), F.sum("w").alias("t"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("w") > 0, F.col("component")))), ",").alias("components"))
    return a.select("corpus_id", "n_components", "components", F.when((F.col("n_components") >= LEAST_COMPONENTS) & (F.col("t") > 0), F.round(100 * F.col("s") / F.col("t"), 1)).alias("score"))


def bands(score: Column) -> tuple[Column, Column]:
    """Stars 1 to 5 and letters E to A over five equal bands, the top one closed; null outside 0 to 100."""
    stars = F.when(score.between(0, 100), F.least(F.lit(5), F.floor(score / 20) + 1)).cast("long")
    return stars, F.get(F.array(*[F.lit(x) for x in "EDCBA"]), (stars - 1).cast("int"))


def rank_corpora(scored: DataFrame) -> DataFrame:
    """Competition rank by printed score of the corpora that can be ranked; others stay, with the reason.

    ``scored`` has ``corpus_id, score, components`` and may have ``refused`` and ``warned``. Needs two scores; ranks are
    comparable if all ranked corpora rest on the same components.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in scored.columns else F.lit(False)
    reason = F.when(flag("refused"), "refused").when(flag("warned"), "warnings").when(F.col("score").isNull(), "no_score")
    s = scored.withColumn("reason", reason)
    able = F.col("reason").isNull()
    everyone = Window.partitionBy()  # one row for each corpus
    s = s.withColumns({"n_ranked": F.count_if(able).over(everyone), "kinds": F.size(F.collect_set(F.when(able, F.col("components"))).over(everyone)).cast("long")})
    order = Window.partitionBy(able).orderBy(F.desc("score"))
    tie = Window.partitionBy(able, "score")
    ok = able & (F.col("n_ranked") >= 2)
    return s.select("corpus_id", "score", "reason", F.when(ok, F.rank().over(order).cast("long")).alias("rank"), F.when(ok, F.count("*").over(tie) > 1).alias("tied"), (F.col("kinds") <= 1).alias("comparable"))


def tied_with(ranked: DataFrame) -> DataFrame:
    """Ranked corpora with the others of the same printed score, and their place in a table (score down, then id)."""
    group = Window.partitionBy("score")  # one row for each corpus
    r = ranked.filter("rank is not null").withColumn("same", F.array_sort(F.collect_list("corpus_id").over(group)))
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "corpus_id")).cast("long")
    return r.select("corpus_id", "rank", place.alias("place"), F.array_join(F.array_remove("same", F.col("corpus_id")).cast("array<string>"), ",").alias("tied_with"))


def statements(ranked: DataFrame) -> DataFrame:
    """Each ranked corpus against the next one down: tie, or by how much it is ahead."""
    w = Window.partitionBy().orderBy(F.desc("score"), "corpus_id")  # one row for each corpus
    r = ranked.filter("rank is not null").withColumns({"next_id": F.lead("corpus_id").over(w), "next_score": F.lead("score").over(w)})
    return r.filter("next_id is not null").select("corpus_id", "next_id", F.when(F.col("score") == F.col("next_score"), "tie").otherwise("ahead").alias("outcome"), F.round(F.col("score") - F.col("next_score"), 1).alias("difference"))


def pairwise(scored: DataFrame) -> DataFrame:
    """What may be said of each corpus and the one with the next id: nothing if either has no score, or they rest on other components or weights; else tie, ahead or behind, and by how much.

    ``scored`` has ``corpus_id, score, components`` and may have ``weights``, a text that is equal for equal weights.
    """
    w = Window.partitionBy().orderBy("corpus_id")  # one row for each corpus
    cols = ["score", "components", *(["weights"] if "weights" in scored.columns else [])]
    r = scored.withColumns({"other_id": F.lead("corpus_id").over(w), **{f"other_{c}": F.lead(c).over(w) for c in cols}}).filter("other_id is not null")
    unlike = lambda c: ~F.col(c).eqNullSafe(F.col(f"other_{c}")) if c in cols else F.lit(False)
    gap = F.round(F.col("score") - F.col("other_score"), 1)
    outcome = F.when(F.col("score").isNull() | F.col("other_score").isNull(), "unranked").when(unlike("components"), "different_components").when(unlike("weights"), "different_weights").when(gap == 0, "tie").when(gap > 0, "ahead").otherwise("behind")
    return r.select("corpus_id", "other_id", outcome.alias("outcome"), F.when(outcome.isin("tie", "ahead", "behind"), F.abs(gap)).alias("difference"))
