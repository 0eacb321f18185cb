"""Answers of journal services as JSON text, read into signals; kept answers of citations, risk and reference distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.sources.files import latest_file

#: Signals by service, in the order of a report (fixed values).
SIGNALS = (
    "doaj_indexed", "doaj_not_indexed", "doaj_discontinued", "doaj_apc", "doaj_review_process", "crossref_unknown", "crossref_metadata_missing", "crossref_deposited_dois",
    "openalex_unknown", "openalex_in_doaj", "openalex_indexed_in_scopus", "openalex_apc_usd", "openalex_works_count", "openalex_impact",
)


def body(text: Column, status: Column | None = None) -> Column:
    """A JSON object as a variant: null for an answer that isn't 200, isn't JSON or isn't an object."""
    v = F.try_parse_json(F.when(status == 200, text) if status is not None else text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def number(v: Column, path: str) -> Column:
    """A number of a variant; null for text, booleans and what is missing."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(?:BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, path, "double"))


def flag(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def text(v: Column, path: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))


def _signal(kind: str, condition: Column, value: Column) -> Column:
    return F.when(condition, F.struct(F.lit(kind).alias("signal"), value.cast("string").alias("value")))


def _listed(*signals: Column) -> Column:
    return F.array_compact(F.array(*signals))


def doaj_signals(answer: Column) -> Column:
    """Whether a journal is listed, and what it declares. An answer that can't be read gives nothing, which is not "not listed"."""
    total = number(answer, "$.total")
    item = lambda p: f"$.results[0].bibjson.{p}"
    listed = F.coalesce(total > 0, F.lit(False))
    review = F.coalesce(F.array_join(F.try_variant_get(answer, item("editorial.review_process"), "array<string>"), ", "), text(answer, item("editorial.review_process")))
    return _listed(
        _signal(SIGNALS[1], total <= 0, total.cast("long")), _signal(SIGNALS[0], listed, total.cast("long")), _signal(SIGNALS[2], listed & text(answer, item("discontinued_date")).isNotNull(), text(answer, item("discontinued_date"))),
        _signal(SIGNALS[3], listed & flag(answer, item("apc.has_apc")).isNotNull(), flag(answer, item("apc.has_apc"))), _signal(SIGNALS[4], listed & (review != ""), review),
    )


def crossref_signals(answer: Column, tracked: tuple[str, ...] = ("abstracts-current", "orcids-current", "references-current", "funders-current", "licenses-current", "affiliations-current")) -> Column:
    """Deposited metadata: how many of the tracked fields that are reported stand at zero, and how many records there are."""
    known = F.schema_of_variant(F.try_variant_get(answer, "$.message", "variant")).startswith("OBJECT")
    cover = F.array_compact(F.array(*[number(answer, f"$.message.coverage['{t}']") for t in tracked]))
    zero = F.size(F.filter(cover, lambda x: x == 0))
    dois = number(answer, "$.message.counts['total-dois']")
    known = F.coalesce(known, F.lit(False))
    return _listed(
        _signal(SIGNALS[5], answer.isNotNull() & ~known, F.lit("")), _signal(SIGNALS[6], known & (F.size(cover) > 0), F.concat(zero, F.lit("/"), F.size(cover))), _signal(SIGNALS[7], known & dois.isNotNull(), dois.cast("long"))
    )


def openalex_signals(answer: Column) -> Column:
    """What an open index says of a source, its own copies of others' answers included."""
    known = F.coalesce(text(answer, "$.id").isNotNull(), F.lit(False))
    apc, works = number(answer, "$.apc_usd"), number(answer, "$.works_count")
    cited, h = number(answer, "$.summary_stats['2yr_mean_citedness']"), number(answer, "$.summary_stats.h_index")
    return _listed(
        _signal(SIGNALS[8], answer.isNotNull() & ~known, F.lit("")), _signal(SIGNALS[9], known & flag(answer, "$.is_in_doaj").isNotNull(), flag(answer, "$.is_in_doaj")), _signal(SIGNALS[10], known, F.coalesce(flag(answer, "$.is_indexed_in_scopus").cast("string"), F.lit("unknown"))),
        _signal(SIGNALS[11], known & apc.isNotNull(), apc.cast("long")), _signal(SIGNALS[12], known & works.isNotNull(), works.cast("long")),
        _signal(SIGNALS[13], known & (cited.isNotNull() | h.isNotNull()), F.concat_ws("/", F.coalesce(F.round(cited, 2).cast("string"), F.lit("-")), F.coalesce(h.cast("long").cast("string"), F.lit("-")))),
    )


def source_signals(answers: DataFrame) -> DataFrame:
    """``answers`` (issn, service, status, body) → ``(issn, service, signal, value)``, each in the order of a report."""
    v = body(F.col("body"), F.col("status"))
    kinds = {"doaj": doaj_signals, "crossref": crossref_signals, "openalex": openalex_signals}
    found = F.coalesce(*[F.when(F.col("service") == k, f(F.col("v"))) for k, f in kinds.items()])
    return answers.withColumn("v", v).select("issn", "service", F.explode(found).alias("s")).select("issn", "service", "s.signal", "s.value")


def readable_shape(doc: Column, blocks: dict[str, str]) -> Column:
    """Which blocks of a JSON text can't be read, ``blocks`` giving each one's kind (OBJECT, ARRAY, STRING, BIGINT, ...): missing ones are no fault, null text is ``document``."""
    v = F.try_parse_json(doc)
    bad = [F.when((kind := F.schema_of_variant(F.try_variant_get(v, f"$.{b}", "variant"))).isNotNull() & (kind != "VOID") & ~kind.startswith(want), b) for b, want in blocks.items()]
    return F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.array(F.lit("document"))).otherwise(F.array_compact(F.array(*bad)))


def stamp(c: Column) -> Column:
    """A time of retrieval, or null where none can be read: such an answer is fetched again."""
    return F.coalesce(F.try_to_timestamp(F.trim(c)), F.try_to_timestamp(F.trim(c), F.lit("yyyyMMdd_HHmmss")))


def save_answers(rows: DataFrame, path: str, searched: int) -> None:
    """Answers as JSON lines, each with how many items were asked for, so that a reader can tell what is missing."""
    rows.withColumn("n_searched", F.lit(searched)).write.mode("overwrite").json(path)


def load_answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Kept answers; what a file doesn't state stays null, and a file that doesn't exist is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def latest_answers(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """The answers of the newest file that matches."""
    found = latest_file(spark, pattern)
    return load_answers(spark, found, schema) if found else spark.createDataFrame([], schema)


def denominator_mismatch(rows: DataFrame) -> DataFrame:
    """Where the number of rows kept isn't the number asked for: told, never mended."""
    a = rows.groupBy("n_searched").agg(F.count("*").alias("n_kept"))
    return a.filter("n_kept <> n_searched")
