"""Readers and writers of corpora and side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibloom.functions import columns as C
from bibloom.functions import scalar as S
from bibloom.sources.schema import AUTHOR, CORPUS, PAPER, resolve_headers

SPREADSHEETS = (".xlsx", ".xlsm", ".xls", ".csv")
#: Columns of the flat export and how much of an abstract it keeps.
EXPORT, ABSTRACT = ("no", "pmid", "title", "authors_str", "role", "source_label", "journal", "pub_date", "volume", "issue", "pages", "doi", "pmc_id", "pdf_status", "abstract"), 500


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The newest file that matches, by its time of change and then its name."""
    f = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    r = f.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return r["p"] if r else None


def read_corpora(spark: SparkSession, path: str) -> DataFrame:
    """Corpus files, one row each, with ``path``. A spreadsheet is refused before anything is read."""
    if path.lower().endswith(SPREADSHEETS):
        raise ValueError(f"{path} is a spreadsheet; bylines can't be had from it")
    return spark.read.schema(CORPUS).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Papers of corpus files, of plain ``{"papers": [...]}`` files and of bare lists, one row each, with ``corpus_id`` (the file)."""
    own = T.StructType([*CORPUS.fields[:-1], CORPUS["papers"], *[f for f in PAPER.fields if f.name not in CORPUS.fieldNames()]])
    raw = spark.read.schema(own).option("multiLine", True).json(path).withColumn("corpus_id", F.col("_metadata.file_path"))
    nested = raw.filter("papers is not null").select("corpus_id", F.explode("papers").alias("p")).select("corpus_id", "p.*")
    bare = raw.filter("papers is null and (pmid is not null or title is not null or doi is not null)").select("corpus_id", *PAPER.fieldNames())
    return nested.unionByName(bare)


def write_papers(papers: DataFrame, path: str, search: DataFrame | None = None) -> None:
    """Papers as JSON lines. ``search``, one row with what was searched for and found, stands in a file of its own beside them, so that a reader can tell a whole corpus from one cut short."""
    papers.write.mode("overwrite").json(path)
    if search is not None:
        search.withColumn("schema_version", F.lit(1)).coalesce(1).write.mode("overwrite").json(path.rstrip("/") + ".search")


def export_rows(papers: DataFrame, order: str = "pmid") -> DataFrame:
    """The flat export: 15 columns, numbered in an order, the abstract cut to 500 characters; cells that a table lacks are blank.

    Numbers come from ranges of the order and the rows before each, so no task sees all rows.
    """
    have = papers.columns
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    label = S.source_label(F.col("confirmed_by") if "confirmed_by" in have else F.array().cast("array<string>"), cell("source"))
    placed = papers.orderBy(order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    before = placed.groupBy("_part").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each partition
    numbered = placed.join(F.broadcast(before.select("_part", "before")), "_part").withColumn("no", F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return numbered.select("no", *[label.alias(c) if c == "source_label" else F.left(cell(c), F.lit(ABSTRACT)).alias(c) if c == "abstract" else cell(c).alias(c) for c in EXPORT[1:]])


def worklist_rows(journals: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A template to fill in by hand: what is known of each journal, and empty cells for the rest."""
    return journals.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in journals.columns else F.lit("").alias(c) for c in columns])


def load_counters(rows: DataFrame) -> DataFrame:
    """How many rows of side_rows() were loaded, rejected (by reason) and repeated."""
    kind = F.when(F.col("reject").isNotNull(), F.col("reject")).when(F.col("duplicate"), "duplicate").otherwise("loaded")
    return rows.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def fill_constant(df: DataFrame, column: str) -> DataFrame:
    """Blank cells of a column filled with its only value, if it has one only: a roster that names its advisor once."""
    one = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(one["lo"]))) if one["lo"] == one["hi"] else df


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", encoding).option("escape", '"').csv(path)


def sniff_encoding(spark: SparkSession, path: str, otherwise: str = "GB18030") -> str:
    """UTF-8 where every line is valid in it, else the other encoding that such tables come in."""
    return otherwise if spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count() else "UTF-8"


def read_side_table(spark: SparkSession, path: str, table: str, encoding: str | None = None) -> tuple[DataFrame, list[str]]:
    """A side table with the model's column names, cells trimmed and blanks null, and the headers that it doesn't know."""
    enc = encoding or sniff_encoding(spark, path)
    if enc.upper() != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # the reader takes other encodings only with it, when it runs too
    raw = spark.read.option("header", True).option("encoding", enc).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    found, rest = resolve_headers(raw.columns, table)
    clean = lambda h: F.nullif(F.trim(F.col(f"`{h}`")), F.lit(""))
    return raw.select(*[clean(h).alias(c) for h, c in found.items()]), rest


def parse_flag(c: Column) -> Column:
    """True, false, or null for a blank: not marked is not the same as marked as no."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("1", "true", "yes", "y", "是", "预警"), True).when(low.isin("0", "false", "no", "n", "否"), False)


def parse_day(c: Column) -> Column:
    """A date cell in one of six spellings."""
    x = F.trim(C.narrow(c))
    return F.coalesce(*[F.try_to_date(x, f) for f in ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "yyyy年M月d日")], F.try_to_date(F.concat(x, F.lit("-1")), "yyyy-M-d"))


def side_rows(df: DataFrame, table: str) -> DataFrame:
    """Rows of a side table with ``reject`` (null if loaded) and ``duplicate`` of an earlier row with the same key."""
    has = lambda *c: F.lit(False) if not [x for x in c if x in df.columns] else F.coalesce(*[F.col(x) for x in c if x in df.columns]).isNotNull()
    rules = {
        "journals": (F.when(~has("issn", "eissn") & ~has("journal"), "no_key"), ("issn", "eissn", "journal", "source_edition")),
        "theses": (F.when(~has("student", "student_latin"), "no_student").when(C.one_year(F.col("graduation_year")).isNull() if "graduation_year" in df.columns else F.lit(True), "no_year"), ("advisor", "student", "degree", "graduation_year")),
        "evaluations": (F.when(~has("source"), "no_source").when(~has("content", "rating"), "empty"), ("advisor", "source", "content", "rating", "year")),
        "chinese_records": (F.when(~has("title"), "no_title").when(C.one_year(F.col("pub_year")).isNull() if "pub_year" in df.columns else F.lit(True), "no_year").when(~has("authors"), "no_author"), ("title_key", "pub_year")),
    }
    reject, key = rules[table]
    if table == "chinese_records" and "title" in df.columns:
        df = df.withColumn("title_key", S.journal_key(F.col("title")))
    w = Window.partitionBy(F.xxhash64(*[F.coalesce(F.lower(F.col(k)), F.lit("")) for k in key if k in df.columns]), *[F.col(k) for k in key if k in df.columns]).orderBy(F.monotonically_increasing_id())
    return df.withColumn("reject", reject).withColumn("duplicate", F.row_number().over(w) > 1).drop("title_key")


def split_authors(c: Column) -> Column:
    """A free author list as ``(name_zh, is_corresponding)``: seven separators, trailing marks mean corresponding author."""
    parts = F.filter(F.transform(F.split(c, "[;；,，、|｜]"), F.trim), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.trim(F.regexp_replace(x, r"[*＊#†\s]+$", "")).alias("name_zh"), x.rlike(r"[*＊†]\s*$").alias("is_corresponding")))


# ------------------------------------------------------------------ article XML

ARTICLE = """
MedlineCitation struct<PMID: string, Article: struct<
  Journal: struct<ISSN: struct<_VALUE: string, _IssnType: string>, JournalIssue: struct<Volume: string, Issue: string, PubDate: struct<Year: string, Month: string, Day: string, MedlineDate: string>>, Title: string, ISOAbbreviation: string>,
  ArticleTitle: string, Pagination: struct<MedlinePgn: string>, ELocationID: array<struct<_VALUE: string, _EIdType: string>>, Abstract: struct<AbstractText: array<struct<_VALUE: string, _Label: string>>>,
  AuthorList: struct<Author: array<struct<_EqualContrib: string, LastName: string, ForeName: string, Initials: string, CollectiveName: string, Identifier: array<struct<_VALUE: string, _Source: string>>, AffiliationInfo: array<struct<Affiliation: string>>>>>>,
  MedlineJournalInfo: struct<ISSNLinking: string>>,
PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>, History: struct<PubMedPubDate: array<struct<_PubStatus: string, Year: string, Month: string, Day: string>>>>
"""


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of XML files in the model's shape."""
    return map_articles(spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE.replace("\n", " ")).load(path))


def map_articles(raw: DataFrame) -> DataFrame:
    a, j = F.col("MedlineCitation.Article"), F.col("MedlineCitation.Article.Journal")
    ids = F.coalesce(F.col("PubmedData.ArticleIdList.ArticleId"), F.array().cast("array<struct<_VALUE:string,_IdType:string>>"))
    by_type = lambda t: F.get(F.filter(ids, lambda x: F.lower(x["_IdType"]) == t), F.lit(0))["_VALUE"]
    eloc = F.get(F.filter(a["ELocationID"], lambda x: F.lower(x["_EIdType"]) == "doi"), F.lit(0))["_VALUE"]
    d = j["JournalIssue"]["PubDate"]
    sent = F.get(F.col("PubmedData.History.PubMedPubDate"), F.lit(0))
    year = F.coalesce(d["Year"], F.nullif(F.regexp_extract(d["MedlineDate"], r"([0-9]{4})", 1), F.lit("")), sent["Year"])
    date = F.when(d["Year"].isNotNull(), F.concat_ws(" ", d["Year"], d["Month"], d["Day"])).when(d["MedlineDate"].isNotNull(), year).otherwise(F.concat_ws(" ", sent["Year"], sent["Month"], sent["Day"]))
    text = lambda x: F.concat(F.coalesce(F.concat(x["_Label"], F.lit(": ")), F.lit("")), F.trim(x["_VALUE"]))
    abstract = F.array_join(F.filter(F.transform(a["Abstract"]["AbstractText"], text), lambda x: x != ""), " ")

    def author(x: Column) -> Column:
        aff = F.array_join(F.transform(x["AffiliationInfo"], lambda i: i["Affiliation"]), " ")
        email = F.nullif(F.regexp_extract(aff, r"([\w.+-]+@[\w-]+\.[\w.-]*\w)", 1), F.lit(""))
        orcid = F.regexp_extract(F.get(F.filter(x["Identifier"], lambda i: F.upper(i["_Source"]) == "ORCID"), F.lit(0))["_VALUE"], r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])", 1)
        name = F.coalesce(F.nullif(F.concat_ws(" ", x["LastName"], x["ForeName"]), F.lit("")), x["CollectiveName"])
        e = lambda c: F.coalesce(c, F.lit(""))
        return F.struct(
            e(name).alias("name"), e(x["LastName"]).alias("last"), e(x["ForeName"]).alias("fore"), e(x["Initials"]).alias("initials"), e(aff).alias("affiliation"), (email.isNotNull() | F.lower(e(aff)).contains("corresponding")).alias("is_corresponding"), e(email).alias("email"), e(orcid).alias("orcid"),
            (e(x["_EqualContrib"]) == "Y").alias("equal_contrib"), F.lit(None).cast("string").alias("openalex_author_id"), F.lit(None).cast("string").alias("name_zh"),
        )

    authors = F.coalesce(F.transform(a["AuthorList"]["Author"], author), F.array().cast(T.ArrayType(AUTHOR)))
    return raw.select(
        F.col("MedlineCitation.PMID").alias("pmid"), a["ArticleTitle"].alias("title"), authors.alias("authors"), F.array_join(F.transform(authors, lambda x: x["name"]), "; ").alias("authors_str"), j["Title"].alias("journal"), j["ISSN"]["_VALUE"].alias("issn"), j["ISSN"]["_IssnType"].alias("issn_type"),
        F.col("MedlineCitation.MedlineJournalInfo.ISSNLinking").alias("issn_linking"), j["ISOAbbreviation"].alias("journal_abbrev"), date.alias("pub_date"), year.alias("pub_year"), j["JournalIssue"]["Volume"].alias("volume"), j["JournalIssue"]["Issue"].alias("issue"), a["Pagination"]["MedlinePgn"].alias("pages"),
        F.coalesce(by_type("doi"), eloc).alias("doi"), by_type("pmc").alias("pmc_id"), F.coalesce(abstract, F.lit("")).alias("abstract"),
    )


# ------------------------------------------------------------------ works of an open index

WORK = """id string, doi string, title string, publication_year int, publication_date string, cited_by_count bigint, ids struct<pmid: string, pmcid: string>, biblio struct<volume: string, issue: string, first_page: string, last_page: string>,
primary_location struct<source: struct<display_name: string, issn_l: string>>, primary_topic struct<id: string, display_name: string, score: double>, abstract_inverted_index map<string, array<int>>,
authorships array<struct<author_position: string, is_corresponding: boolean, raw_affiliation_strings: array<string>, author: struct<id: string, display_name: string, orcid: string>, institutions: array<struct<display_name: string>>>>"""


def inverted_abstract(index: Column) -> Column:
    """Text from a map of words to their positions, in the order of these."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(spots), lambda x: x["w"]), " "), F.lit(""))


def map_works(raw: DataFrame) -> DataFrame:
    """Works in the model's shape; those without title, DOI and PMID are left out, and of a work given twice one stays."""
    pmid = F.nullif(F.regexp_extract(F.col("ids.pmid"), r"(\d+)/?$", 1), F.lit(""))

    def author(x: Column) -> Column:
        name = F.trim(x["author"]["display_name"])
        parts = F.split(name, r"\s+")
        comma = F.contains(name, F.lit(","))
        last = F.when(comma, F.trim(F.substring_index(name, ",", 1))).otherwise(F.element_at(parts, -1))
        fore = F.when(comma, F.trim(F.substring_index(name, ",", -1))).otherwise(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " "))
        aff = F.when(F.size(x["raw_affiliation_strings"]) > 0, F.array_join(x["raw_affiliation_strings"], " ")).otherwise(F.array_join(F.transform(x["institutions"], lambda i: i["display_name"]), "; "))
        return F.struct(
            name.alias("name"), last.alias("last"), fore.alias("fore"), F.array_join(F.transform(F.split(fore, r"[\s-]+"), lambda w: F.substring(w, 1, 1)), "").alias("initials"), F.coalesce(aff, F.lit("")).alias("affiliation"), F.coalesce(x["is_corresponding"], F.lit(False)).alias("is_corresponding"), F.lit("").alias("email"),
            F.coalesce(F.regexp_extract(x["author"]["orcid"], r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])", 1), F.lit("")).alias("orcid"), F.lit(False).alias("equal_contrib"), S.openalex_id(x["author"]["id"]).alias("openalex_author_id"), F.lit(None).cast("string").alias("name_zh"),
        )

    b = F.col("biblio")
    out = raw.select(
        F.regexp_extract("id", r"(W\d+)$", 1).alias("openalex_work_id"), C.doi_key(F.col("doi")).alias("doi"), pmid.alias("pmid"), "title", F.col("publication_year").cast("string").alias("pub_year"), F.col("publication_date").alias("pub_date"), b["volume"].alias("volume"), b["issue"].alias("issue"),
        F.concat_ws("-", b["first_page"], b["last_page"]).alias("pages"), F.col("primary_location.source.display_name").alias("journal"), F.col("primary_location.source.issn_l").alias("issn"), "cited_by_count", inverted_abstract(F.col("abstract_inverted_index")).alias("abstract"),
        F.transform("authorships", author).alias("authors"), F.col("primary_topic.id").alias("topic_id"),
    )
    return out.filter("title is not null or doi is not null or pmid is not null").dropDuplicates(["openalex_work_id"])


# ------------------------------------------------------------------ signals on journals


def journal_signals(raw: DataFrame) -> DataFrame:
    """Risk signals of each journal from flags of several sources, all kept: ``(issn, signals, n_signals, sources, fetched_at)``.

    ``raw`` has ``issn, source, signal, value, fetched_at``; a journal's stamp is the oldest of its sources'.
    """
    on = raw.filter(F.coalesce(F.col("value").cast("boolean"), F.lit(False)))
    all_ = raw.groupBy("issn").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.min("fetched_at").alias("fetched_at"))
    s = on.groupBy("issn").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    return all_.join(s, "issn", "left").select("issn", F.coalesce("signals", F.array().cast("array<string>")).alias("signals"), F.coalesce(F.size("signals"), F.lit(0)).alias("n_signals"), "sources", "fetched_at")
