"""Sources mixed to target shares of tokens: proportional fitting of cell weights, then sampling by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.llm import tokens
from bibloom.runtime import forget, lookup, materialise, rows_of

#: Rounds of fitting at most, the error of a marginal (share of all tokens) at which it ends, and the one that a given marginal may keep.
ROUNDS, CLOSE, TOLERANCE = 200, 1e-7, 1e-4
#: Steps into which a source's documents are put by their random number; a target is met to about one step of a source.
STEPS = 4096
#: Languages that documents may be marked with, at most: a factor for each, and for each source, is kept by the driver.
MOST_LANGS = 1000
#: Stands for null in keys.
NONE = "\x00"


@dataclass
class Fit:
    """``weights`` (source, lang, topic, n, weight), the tokens aimed at per source, the targets and errors of the raked marginals, and the rounds taken."""

    weights: DataFrame | None
    aim: dict[str, float]
    langs: dict[str | None, float] | None
    topics: DataFrame | None
    errors: dict[str, float]
    rounds: int


def aims(supply: dict[str, float], target: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens that each source should contribute.

    Without ``total``, the most for which every source that exists reaches its share of those that exist. With it, shares
    are met as nearly as the caps allow: a source that can't is used to its cap and the others share the rest in
    proportion.
    """
    cap = {s: supply.get(s, 0.0) * max(0, repeats.get(s, 1)) for s in target}
    live = [s for s in target if target[s] > 0 and cap[s] > 0]
    out = dict.fromkeys(target, 0.0)
    if not live:
        return out
    if total is None:
        scale = min(cap[s] / target[s] for s in live)
        return out | {s: scale * target[s] for s in live}
    left, free = min(total, sum(cap[s] for s in live)), list(live)
    while free:
        share = sum(target[s] for s in free)
        full = [s for s in free if cap[s] <= left * target[s] / share]
        if not full:
            return out | {s: left * target[s] / share for s in free}
        for s in full:
            out[s] = cap[s]
        left -= sum(cap[s] for s in full)
        free = [s for s in free if s not in full]
    return out


def _topic_fit(batches: Iterator[pa.RecordBatch], a: np.ndarray, b: np.ndarray, ceiling: np.ndarray) -> Iterator[tuple]:
    """Per batch of topics: cell sources, languages, topics, sizes, document counts, the weight of each cell before its source's factor, and what each topic lacks.

    A topic's factor is the one with which its cells, none over its source's ceiling, come to the topic's tokens; cells
    that reach the ceiling stay there and the others share the rest, until no further one does.
    """
    for batch in batches:
        cells = batch.column(batch.schema.get_field_index("cells"))
        n = len(cells)
        flat = cells.flatten()
        ti = np.repeat(np.arange(n), np.diff(cells.offsets.to_numpy()))
        s, l, size, docs = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        want = batch.column(batch.schema.get_field_index("want")).to_numpy(zero_copy_only=False).astype(float)
        base, most = a[s] * b[l], ceiling[s]
        factor, missing = np.ones(n), np.zeros(n)
        raked = ~np.isnan(want)
        capped = np.zeros(len(s), dtype=bool)
        while raked.any():
            fixed = np.bincount(ti, np.where(capped, most * size, 0.0), n)
            free = np.bincount(ti, np.where(capped, 0.0, base * size), n)
            factor = np.where(raked, np.where(free > 0, np.maximum(want - fixed, 0) / np.maximum(free, 1e-300), 0.0), 1.0)
            over = ~capped & raked[ti] & (base * factor[ti] > most * (1 + 1e-12))
            if not over.any():
                missing = np.where(raked & (free <= 0), np.maximum(want - fixed, 0), 0.0)
                break
            capped |= over
        g = np.where(capped, np.inf, b[l] * factor[ti])
        yield batch, s, l, ti, size, docs, g, missing


def _weights(g: np.ndarray, a: np.ndarray, most: np.ndarray) -> np.ndarray:
    return np.where(a > 0, np.minimum(most, np.where(np.isinf(g), most, a * np.where(np.isinf(g), 1.0, g))), 0.0)


def _sums(a: np.ndarray, b: np.ndarray, a2: np.ndarray, ceiling: np.ndarray):
    """Tokens per source and language that stand at the ceiling, those that don't, and what the topics lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s, l, _, size, _, g, missing in _topic_fit(batches, a, b, ceiling):
            w = _weights(g, a2[s], ceiling[s])
            at = w >= ceiling[s]
            k = s.astype(np.int64) * len(b) + l
            n = len(a) * len(b)
            fixed, free = np.bincount(k, np.where(at, w * size, 0.0), n), np.bincount(k, np.where(at, 0.0, w * size), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(fixed), pa.array(free), pa.array(np.where(np.arange(n) == 0, missing.sum(), 0.0))], names=["k", "fixed", "free", "missing"])

    return run


def _weighted(a: np.ndarray, b: np.ndarray, a2: np.ndarray, ceiling: np.ndarray, sources: list[str], langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s, l, ti, _, docs, g, _ in _topic_fit(batches, a, b, ceiling):
            topic = batch.column(batch.schema.get_field_index("topic")).take(pa.array(ti))
            yield pa.RecordBatch.from_arrays([pa.array([sources[i] for i in s], pa.string()), pa.array([langs[i] for i in l], pa.string()), topic, pa.array(docs), pa.array(_weights(g, a2[s], ceiling[s]))], names=["source", "lang", "topic", "n", "weight"])

    return run


def rake(cells: DataFrame, aim: dict[str, float], repeats: dict[str, int], langs: dict[str | None, float] | None = None, topics: dict[str | None, float] | None = None) -> Fit:
    """Weights per cell ``(source, lang, topic, size[, n])`` so that weighted tokens meet the sources' aims, and shares of languages and topics.

    Iterative proportional fitting with a ceiling: a weight is the product of a factor of its source, one of its language
    and one of its topic, but never over the source's number of repeats. Cells are a table with one row for each topic,
    however many there are; each round is one pass over it that finds the topics' factors where they stand and sums by
    source and language, from which the driver corrects these few factors. Sources are met last and exactly.

    Shares that are given bind: ValueError if they can't be met within TOLERANCE. Where neither is given, languages and
    topics are raked to what they are in all cells, as nearly as sources and ceilings allow; where one is given, the other
    is left free. Null is a language and a topic of its own.
    """
    live = sorted(s for s, x in aim.items() if x > 0)
    keyed = cells.filter(F.col("source").isin(live)).select("source", F.coalesce("lang", F.lit(NONE)).alias("lang"), F.coalesce("topic", F.lit(NONE)).alias("topic"), "size", (F.col("n") if "n" in cells.columns else F.lit(1)).cast("long").alias("n"))
    sums = keyed.groupBy("source", "lang").agg(F.sum("size").alias("t")).limit(len(live) * MOST_LANGS + 1).collect()
    names = sorted({r["lang"] for r in sums})
    if len(names) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not sums:
        return Fit(None, aim, None, None, {}, 0)
    supply, by_lang = dict.fromkeys(live, 0.0), dict.fromkeys(names, 0.0)
    for r in sums:
        supply[r["source"]] += r["t"]
        by_lang[r["lang"]] += r["t"]
    total, everything = sum(aim[s] for s in live), sum(supply.values())
    natural = langs is None and topics is None
    plain = lambda d: None if d is None else {NONE if k is None else k: float(v) / sum(d.values()) for k, v in d.items()}
    lang_share = {k: v / everything for k, v in by_lang.items()} if natural else plain(langs)
    topic_share = plain(topics)
    spark = cells.sparkSession
    index = lambda c, values: F.array_position(F.array(*map(F.lit, values)), F.col(c)).cast("int") - 1
    each = F.struct(index("source", live).alias("s"), index("lang", names).alias("l"), F.col("size").cast("double").alias("size"), "n")
    by_topic = keyed.groupBy("topic").agg(F.collect_list(each).alias("cells"), F.sum("size").alias("t"))
    lost = 0.0
    if natural:
        wanted = by_topic.withColumn("want", F.col("t") / everything * total)
    elif topic_share:
        given = spark.createDataFrame(list(topic_share.items()), "topic string, share double")
        wanted = by_topic.join(F.broadcast(given), "topic", "left").withColumn("want", F.coalesce("share", F.lit(0.0)) * total)
    else:
        wanted = by_topic.withColumn("want", F.lit(None).cast("double"))
    table = materialise(wanted.select("topic", "want", "cells"), "topics")
    if topic_share:
        lost = 1 - sum(topic_share[r["topic"]] for r in table.filter(F.col("topic").isin(list(topic_share))).select("topic").collect())
    ceiling = np.array([float(max(0, repeats.get(s, 1))) for s in live])
    want_s = np.array([aim[s] for s in live])
    want_l = None if lang_share is None else np.array([lang_share.get(x, 0.0) for x in names]) * total
    absent = 0.0 if lang_share is None else sum(v for k, v in lang_share.items() if k not in by_lang)
    a, b = want_s / np.array([supply[s] for s in live]), np.ones(len(names))

    def measured(a2: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        rows = table.mapInArrow(_sums(a, b, a2, ceiling), "k long, fixed double, free double, missing double").groupBy("k").agg(*[F.sum(c).alias(c) for c in ("fixed", "free", "missing")]).collect()
        fixed, free = np.zeros(len(a) * len(b)), np.zeros(len(a) * len(b))
        for r in rows:
            fixed[r["k"]], free[r["k"]] = r["fixed"], r["free"]
        return fixed.reshape(len(a), len(b)), free.reshape(len(a), len(b)), sum(r["missing"] for r in rows)

    ratio = lambda want, fixed, free: np.where(free > 0, np.clip((want - fixed) / np.maximum(free, 1e-300), 1e-3, 1e3), 1.0)
    errors, best, since = {}, np.inf, 0
    for rounds in range(1, ROUNDS + 1):
        fixed, free, missing = measured(a)
        have = fixed + free
        errors = {"source": float(np.abs(have.sum(axis=1) - want_s).max() / total)}
        if want_l is not None:
            errors["lang"] = float(np.abs(have.sum(axis=0) - want_l).max() / total) + absent
        if natural or topic_share:
            errors["topic"] = missing / total + lost
        worst = max(errors.values())
        since, best = (0, worst) if worst < 0.9 * best else (since + 1, best)
        if worst < CLOSE or since >= 10:
            break
        if want_l is not None:
            f = ratio(want_l, fixed.sum(axis=0), free.sum(axis=0))
            b, free = b * f, free * f[None, :]
        a = a * ratio(want_s, fixed.sum(axis=1), free.sum(axis=1))
    a2 = a
    for _ in range(ROUNDS):  # sources alone, the rest as it stands
        fixed, free, missing = measured(a2)
        have = fixed + free
        errors["source"] = float(np.abs(have.sum(axis=1) - want_s).max() / total)
        if errors["source"] < CLOSE:
            break
        a2 = a2 * ratio(want_s, fixed.sum(axis=1), free.sum(axis=1))
    if want_l is not None:
        errors["lang"] = float(np.abs(have.sum(axis=0) - want_l).max() / total) + absent
    if not natural and max(errors.values()) > TOLERANCE:
        raise ValueError(f"the given shares can't be met: {errors}")
    weights = materialise(table.mapInArrow(_weighted(a, b, a2, ceiling, live, names), "source string, lang string, topic string, n long, weight double").withColumns({c: F.nullif(c, F.lit(NONE)) for c in ("lang", "topic")}), "weights")
    shares = {None if k == NONE else k: v for k, v in lang_share.items()} if lang_share is not None else None
    targets = table.select(F.nullif("topic", F.lit(NONE)).alias("topic"), (F.col("want") / total).alias("share")) if natural or topic_share else None
    return Fit(weights, aim, shares, targets, errors, rounds)


def counted(docs: DataFrame, targets: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str = "corpus_label", folder: str = tokens.FOLDER, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``(doc_id, source, lang, topic, n_tokens)`` of the documents of the target sources that have any token."""
    wanted = F.broadcast(targets.select(F.col("source").alias("_s")).distinct())
    own = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(lang).cast("string").alias("lang"), F.col(topic).cast("string").alias("topic"), F.col(text).alias("text")).join(wanted, F.col("source") == F.col("_s")).drop("_s")
    return materialise(tokens.with_counts(own, "text", "n_tokens", ("doc_id", "source", "lang", "topic"), folder, vocabulary).filter("n_tokens > 0"), "counted")


def _cell() -> Column:
    return F.concat_ws("\x1f", "source", F.coalesce("lang", F.lit(NONE)), F.coalesce("topic", F.lit(NONE)))


_MIXTURE = "doc_id long, source string, lang string, topic string, n_tokens long, weight double, copies int"


def fitted(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, lang_shares: dict[str | None, float] | None = None, topic_shares: dict[str | None, float] | None = None, seed: int = 0, folder: str = tokens.FOLDER, vocabulary: str = tokens.VOCABULARY) -> tuple[DataFrame, Fit]:
    """mixture() and the fit behind it."""
    spark = docs.sparkSession
    rules = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] if r["max_repeats"] is not None else 1)) for r in targets.select("source", "target_share", "max_repeats").toLocalIterator() if r["source"] is not None}
    target, repeats = {s: v[0] for s, v in rules.items()}, {s: v[1] for s, v in rules.items()}
    count = counted(docs, targets, folder=folder, vocabulary=vocabulary)
    cells = materialise(count.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n")), "cells")
    supply = {r["source"]: float(r["t"]) for r in cells.groupBy("source").agg(F.sum("size").alias("t")).collect()}
    fit = rake(cells, aims(supply, target, repeats, total_tokens), repeats, lang_shares, topic_shares)
    if fit.weights is None:
        return spark.createDataFrame([], _MIXTURE), fit
    weights = fit.weights.select(_cell().alias("cell"), "weight", "n")
    weights._bibloom_top = fit.weights._bibloom_top
    whole = F.floor(F.col("weight") + 1e-9)
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    found = lookup(count.withColumn("cell", _cell()), weights, "cell", rows_of(count), spread=F.xxhash64("doc_id")).drop("cell").filter("weight is not null")
    rest = F.greatest(F.lit(0.0), F.col("weight") - F.col("whole"))
    placed = materialise(found.withColumn("whole", whole).withColumn("rest", rest).withColumn("v", F.when(F.col("rest") > 0, u / F.col("rest"))).drop("rest"), "placed")
    # calibration: documents in the order of v = u / rest, the nearer to 0 the surer; the source takes them up to what it lacks
    step = F.floor(F.least("v", F.lit(2.0)) * (STEPS // 2)).cast("int")
    sums = placed.groupBy("source", step.alias("step")).agg(F.sum("n_tokens").alias("t"), F.sum(F.col("whole") * F.col("n_tokens")).alias("base")).collect()
    limit: list[tuple[str, float]] = []
    for s, aim in fit.aim.items():
        mine = sorted((r["step"], r["t"]) for r in sums if r["source"] == s and r["step"] is not None)
        lack = aim - sum(r["base"] or 0 for r in sums if r["source"] == s)
        have, best, at = 0.0, abs(lack), 0
        for k, t in mine:
            have += t
            if abs(lack - have) < best:
                best, at = abs(lack - have), k + 1
        limit.append((s, at / (STEPS // 2)))
    limits = spark.createDataFrame(limit or [("", 0.0)], "source string, upto double")
    caps = spark.createDataFrame([(s, n) for s, n in repeats.items()] or [("", 0)], "source string, cap int")
    out = placed.join(F.broadcast(limits), "source").join(F.broadcast(caps), "source")
    copies = F.least(F.col("whole") + F.when(F.col("v") < F.col("upto"), 1).otherwise(0), "cap")
    forget(count, cells)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", copies.cast("int").alias("copies")).filter("copies > 0"), fit


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, lang_shares: dict[str | None, float] | None = None, topic_shares: dict[str | None, float] | None = None, seed: int = 0, folder: str = tokens.FOLDER, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``(doc_id, source, lang, topic, n_tokens, weight, copies)``: the documents of the mixture, each to be used ``copies`` times.

    ``targets`` has ``source, target_share, max_repeats``. A document's weight is its cell's (source x language x topic,
    all as they stand); it comes floor(weight) times, and once more if its random number, a hash of its id, is under the
    rest of the weight times the source's calibration, which is set so that the source's tokens come out as aimed at. No
    document comes more than ``max_repeats`` times. Sources without documents get nothing and their share goes to the
    others in proportion. Null and empty texts are left out; an empty table gives no rows. See rake() for shares given.
    """
    return fitted(docs, targets, total_tokens, lang_shares, topic_shares, seed, folder, vocabulary)[0]


def marginals(mixed: DataFrame, fit: Fit) -> DataFrame:
    """``(marginal, name, target_share, share, tokens)`` of a mixture's languages and topics; the target is null where the marginal was left free."""
    total = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] or 0
    spark = mixed.sparkSession
    langs = spark.createDataFrame(list((fit.langs or {}).items()), "name string, target_share double")
    topics = fit.topics.select(F.col("topic").alias("name"), F.col("share").alias("target_share")) if fit.topics is not None else langs.limit(0)
    out = []
    for marginal, target in (("lang", langs), ("topic", topics)):
        used = mixed.groupBy(F.col(marginal).alias("name")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
        both = target.withColumn("tokens", F.lit(None).cast("long")).unionByName(used.withColumn("target_share", F.lit(None).cast("double")))
        out.append(both.groupBy("name").agg(F.max("target_share").alias("target_share"), F.coalesce(F.max("tokens"), F.lit(0)).alias("tokens")).withColumn("marginal", F.lit(marginal)))
    return out[0].unionByName(out[1]).select("marginal", "name", "target_share", (F.col("tokens") / F.lit(max(1, total))).alias("share"), "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, share, tokens, documents, most_copies)`` of a mixture, absent sources with 0."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    filled = targets.select("source", "target_share").join(used, "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy())  # over one row for each source
    return filled.select("source", "target_share", F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)).alias("share"), "tokens", "documents", "most_copies")
