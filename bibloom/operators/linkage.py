"""Record linkage between corpora and side tables, always with the route or outcome of each match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions import columns as C
from bibloom.functions import scalar as S
from bibloom.operators.components import propagate, shared_key_edges
from bibloom.runtime import lookup, materialise, rows_of


def identity_keys(doi: Column, pmid: Column, title: Column, year: Column) -> Column:
    """Keys of a record in order of preference: DOI, PMID, title with year."""
    t = F.regexp_replace(F.lower(title), "[^a-z0-9一-鿿]", "")
    title_year = F.when((t != "") & year.isNotNull(), F.concat(F.lit("t:"), t, F.lit("|"), year.cast("string")))
    return F.array_compact(F.array(F.concat(F.lit("d:"), C.doi_key(doi)), F.concat(F.lit("p:"), C.pmid_key(pmid)), title_year))


#: What a key of identity_keys() is, by its first letter.
KINDS = {"d": "doi", "p": "pmid", "t": "title_year"}


def merge_harvests(first: DataFrame, second: DataFrame) -> DataFrame:
    """Where each record of a second harvest goes: ``(corpus_id, record_id, entity, in_first, outcome, kind)``.

    Both have ``corpus_id, record_id, keys``, the keys in order of preference and the ids unique within their harvest.
    Records of the first harvest are never folded into each other. One of the second is

    * ``cross`` if it has a key that a record of the first states itself: by the first such key, its least record;
    * ``internal`` if it shares keys with others of the second only, directly or through others: it goes to the least
      record of the first that any of them goes to, else to their least record;
    * ``new`` if it is the least of those, or alone.

    ``kind`` is that of the key that decided: doi, pmid or title_year. The result doesn't depend on the order of rows. Keys
    that a large share of all rows have are spread over all tasks.
    """
    scoped = lambda df: df.select("corpus_id", "record_id", F.transform("keys", lambda k: F.concat(F.col("corpus_id").cast("string"), F.lit("\x1f"), k)).alias("keys"))
    b = materialise(scoped(second), "merge")
    own = scoped(first).select(F.explode("keys").alias("key"), "record_id").groupBy("key").agg(F.min("record_id").alias("base"))
    held = materialise(b.select("record_id", F.posexplode("keys").alias("at", "key")), "merge")
    counted = materialise(held.groupBy("key").agg(F.count("*").alias("n"), F.count("*").alias("copies")).join(own, "key", "left"), "merge")
    letter = F.substring(F.substring_index("key", "\x1f", -1), 1, 1)
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[letter]
    best = lambda condition, *c: F.min(F.when(condition, F.struct("at", kind.alias("kind"), *c)))
    each = lookup(held, counted, "key", rows_of(held)).groupBy("record_id").agg(best(F.col("base").isNotNull(), "base").alias("direct"), best(F.col("copies") > 1).alias("shared"))
    labels = propagate(shared_key_edges(b, "record_id", [F.get("keys", F.lit(i)) for i in range(len(KINDS))], "merge"), "merge")
    j = b.drop("keys").join(each, "record_id", "left").join(labels.withColumnRenamed("u", "record_id"), "record_id", "left").withColumn("group", F.coalesce("label", "record_id"))
    groups = materialise(j.groupBy("group").agg(F.min("direct.base").alias("base"), F.min("record_id").alias("least"), F.count("*").alias("n")), "merge")
    j = lookup(j, groups, "group", rows_of(b), spread=F.xxhash64("record_id"))
    direct = F.col("direct").isNotNull()
    alone = F.col("base").isNull() & (F.col("record_id") == F.col("least"))
    outcome = F.when(direct, "cross").when(alone, "new").otherwise("internal")
    return j.select("corpus_id", "record_id", F.coalesce("direct.base", "base", "least").alias("entity"), F.col("base").isNotNull().alias("in_first"), outcome.alias("outcome"), F.when(direct, F.col("direct.kind")).when(~alone, F.col("shared.kind")).alias("kind"))


def fold_harvests(first: DataFrame, second: DataFrame, merged: DataFrame) -> DataFrame:
    """The merged corpus: ``(corpus_id, entity, in_first, doi, work_id, author_ids, confirmed_by)``, one row for each paper.

    Both harvests have ``corpus_id, record_id, doi, work_id, author_ids, source``. The record that keeps its place keeps
    its cells; a missing DOI or work id comes from the first copy that has one, the ids of authors and the sources are
    those of all copies.
    """
    cols = ("doi", "work_id", "author_ids", "source")
    a = first.select("corpus_id", F.col("record_id").alias("entity"), F.lit(True).alias("in_first"), F.struct(F.lit(0).alias("side"), "record_id").alias("place"), *cols)
    b = second.join(merged.select("corpus_id", "record_id", "entity", "in_first"), ["corpus_id", "record_id"]).select("corpus_id", "entity", "in_first", F.struct(F.lit(1).alias("side"), "record_id").alias("place"), *cols)
    rows = a.unionByName(b)
    key = ["corpus_id", "entity", "in_first"]
    stated = lambda c: F.min_by(F.nullif(F.trim(c), F.lit("")), F.when(F.trim(c) != "", F.col("place"))).alias(c)
    one = rows.groupBy(*key).agg(stated("doi"), stated("work_id"), F.array_sort(F.collect_set("source")).alias("confirmed_by"))
    ids = rows.select(*key, F.explode("author_ids").alias("id")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("author_ids"))
    return one.join(ids, key, "left").select(*key, "doi", "work_id", F.coalesce("author_ids", F.array().cast("array<string>")).alias("author_ids"), "confirmed_by")


def merge_counts(first: DataFrame, merged: DataFrame) -> DataFrame:
    """Per corpus how many records each harvest has, and the merged one; how many papers both have; and what decided, across harvests and within the second."""
    a = first.groupBy("corpus_id").agg(F.count("*").alias("first_total"))
    hit = lambda o, k: F.count_if((F.col("outcome") == o) & (F.col("kind") == k)).alias(f"{o}_{k}")
    b = merged.groupBy("corpus_id").agg(F.count("*").alias("second_total"), F.count_if(F.col("outcome") == "new").alias("second_only"), *[hit(o, k) for o in ("cross", "internal") for k in KINDS.values()])
    both = merged.filter("in_first").select("corpus_id", "entity").distinct().groupBy("corpus_id").agg(F.count("*").alias("both_sources"))
    j = a.join(b, "corpus_id", "full").join(both, "corpus_id", "left").fillna(0)
    return j.withColumns({"merged_total": F.col("first_total") + F.col("second_only"), "first_only": F.col("first_total") - F.col("both_sources")})


def title_year_merge(base: DataFrame, added: DataFrame) -> DataFrame:
    """Added records against a base by one key (title with year): cross for a key of the base, internal for one that an earlier added record has, new else.

    Both have ``record_id, key``; rows without a key are new.
    """
    known = base.filter("key is not null").groupBy("key").agg(F.min("record_id").alias("base_id"))
    w = Window.partitionBy(F.coalesce("key", F.concat(F.lit("\x1f"), F.col("record_id").cast("string")))).orderBy("record_id")  # rows without a key are spread
    a = added.withColumn("turn", F.when(F.col("key").isNotNull(), F.row_number().over(w))).join(known, "key", "left")
    return a.select("record_id", "key", F.when(F.col("base_id").isNotNull(), "cross").when(F.col("turn") > 1, "internal").otherwise("new").alias("outcome"), "base_id")


def journal_routes(names: DataFrame, table: DataFrame) -> DataFrame:
    """How each journal name finds its entry: ``(journal, route, entry, n_candidates)``.

    ``names`` has ``journal, issn``, ``table`` ``entry, name, official_abbreviation, issn, eissn``. Routes in order: issn,
    name_exact, name_abbrev_official (the name is an entry's own abbreviation), name_abbrev (either abbreviates the other,
    with exactly one candidate); several candidates on a route are ambiguous, none is none.
    """
    by_issn = table.select("entry", F.explode(F.array_compact(F.array(C.valid_issn(F.col("issn")), C.valid_issn(F.col("eissn"))))).alias("i")).groupBy("i").agg(F.min("entry").alias("e1"), F.countDistinct("entry").alias("n1"))
    keyed = lambda c: table.select("entry", S.journal_key(F.col(c)).alias("k")).filter("k <> ''").distinct()
    t = keyed("name")
    by_name = t.groupBy("k").agg(F.min("entry").alias("e2"), F.count("*").alias("n2"))
    by_official = keyed("official_abbreviation").groupBy("k").agg(F.min("entry").alias("e3"), F.count("*").alias("n3"))
    n = names.withColumns({"i": C.valid_issn(F.col("issn")), "k": S.journal_key(F.col("journal"))}).withColumn("tok", S.journal_tokens(F.col("k")))
    sig = lambda c: F.array_join(F.transform(c, lambda x: F.substring(x, 1, 1)), "")
    n = n.withColumn("sig", sig(F.col("tok"))).join(by_issn, "i", "left").join(by_name, "k", "left").join(by_official, "k", "left")
    tt = t.select("entry", S.journal_tokens(F.col("k")).alias("ttok")).withColumn("sig", sig(F.col("ttok")))
    rest = n.filter("e1 is null and e2 is null and e3 is null and sig <> ''").select("k", "sig", "tok").distinct()
    loose = rest.join(tt, "sig").filter(S.abbreviates(F.col("tok"), F.col("ttok"))).groupBy("k").agg(F.countDistinct("entry").alias("n4"), F.min("entry").alias("e4"))
    j = n.join(loose, "k", "left")
    route, entry, many = F.lit("none"), F.lit(None).cast("long"), F.lit(0).cast("long")
    for at, name in ((4, "name_abbrev"), (3, "name_abbrev_official"), (2, "name_exact"), (1, "issn")):
        e, k = F.col(f"e{at}"), F.col(f"n{at}")
        route = F.when(k == 1, name).when(k > 1, "ambiguous").otherwise(route)
        entry = F.when(k == 1, e).when(k > 1, None).otherwise(entry)
        many = F.when(k > 0, k).otherwise(many)
    return j.select("journal", route.alias("route"), entry.alias("entry"), many.alias("n_candidates"))


def worklist(papers: DataFrame) -> DataFrame:
    """Journals of a corpus to look up: papers, the first ISSN seen, and how many different ones."""
    i = C.valid_issn(F.col("issn"))
    return papers.filter(F.trim("journal") != "").groupBy("journal").agg(F.count("*").alias("n_papers"), F.min_by(F.when(i.isNotNull(), i), F.when(i.isNotNull(), F.col("record_id"))).alias("issn"), F.countDistinct(i).alias("n_issns"))


def edition_disagreement(table: DataFrame, group: str, fields: tuple[str, ...]) -> DataFrame:
    """Per group and field with more than one value: how many there are."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias("v")) for f in fields])
    e = table.select(group, F.explode(cells).alias("c")).select(group, "c.field", "c.v").filter("v is not null")
    return e.groupBy(group, "field").agg(F.countDistinct("v").alias("n_values")).filter("n_values > 1")


def risk_join(papers: DataFrame, records: DataFrame) -> DataFrame:
    """Journals of papers against risk records by ISSN only: ``(journal, status, n_signals, signals)``; unchecked and without ISSN are told apart."""
    i = C.valid_issn(F.col("issn"))
    j = papers.filter(F.trim("journal") != "").groupBy("journal").agg(F.min(i).alias("i"))
    r = records.groupBy(C.valid_issn(F.col("issn")).alias("i")).agg(F.array_sort(F.collect_set("signal")).alias("s")).filter("i is not null")
    x = j.join(r, "i", "left")
    status = F.when(F.col("i").isNull(), "no_issn").when(F.col("s").isNull(), "unchecked").otherwise("checked")
    return x.select("journal", status.alias("status"), F.when(status == "checked", F.size("s").cast("long")).alias("n_signals"), F.array_join("s", "; ").alias("signals"))


def select_rows(rows: DataFrame, matches: Column) -> DataFrame:
    """Per corpus whose rows of a side table are its own: matched if any row's person is the target, unverified_single if the table has one person only, else refused."""
    a = rows.groupBy("corpus_id").agg(F.bool_or(F.coalesce(matches, F.lit(False))).alias("m"), F.countDistinct("advisor").alias("n_advisors"), F.count("*").alias("n_rows"), F.count_if(F.coalesce(matches, F.lit(False))).alias("n_matched"))
    return a.select("corpus_id", "n_rows", "n_advisors", "n_matched", F.when(F.col("m"), "matched").when(F.col("n_advisors") == 1, "unverified_single").otherwise("refused").alias("outcome"))


def graduate_groups(rows: DataFrame) -> DataFrame:
    """Graduates of a roster: rows of one student together, with whether the degrees go on or repeat."""
    a = rows.groupBy("corpus_id", "student_key").agg(F.count("*").alias("n_rows"), F.countDistinct("degree").alias("n_degrees"), F.min("graduation_year").cast("long").alias("first_year"), F.max("graduation_year").cast("long").alias("last_year"))
    return a.withColumn("flag", F.when((F.col("n_rows") > 1) & (F.col("n_degrees") == F.col("n_rows")), "continuing_student").when(F.col("n_rows") > 1, "same_name_same_degree"))


def with_parts(df: DataFrame, name: str, prefix: str) -> DataFrame:
    """``df`` with the parts of the names in a column, for with_level()."""
    t = f"{prefix}_tokens"
    # a column each: Spark would work out the fields of a struct again wherever they are read
    return df.withColumn(t, S.latin_tokens(F.col(name))).withColumns({f"{prefix}_{k}": v for k, v in S.name_parts(F.col(name), F.col(t)).items()})


def with_level(df: DataFrame, a: str, b: str, *columns: str) -> DataFrame:
    """``columns`` of ``df`` and how the names with the parts ``a`` and ``b`` of with_parts() agree, as ``level``."""
    parts = lambda p: {k: F.col(f"{p}_{k}") for k in ("script", "han", "tokens", "forms", "firsts", "letters")}
    x, y = parts(a), parts(b)
    # rules on arrays are outside generated code: only pairs that need them carry their arrays there
    carried = [F.when(S.tokens_decide(x, y), p[k]).alias(f"{c}_{k}") for c, p in ((a, x), (b, y)) for k in ("tokens", "forms")]
    told = df.select(*columns, S.level_by_script(x, y).alias("_level"), *carried)
    return told.select(*columns, F.when(x["tokens"].isNotNull(), S.level_by_tokens(x, y)).otherwise(F.col("_level")).alias("level"))


#: Rows of either side that joined_in_pieces() joins in one piece, about.
PIECE = 500


def joined_in_pieces(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of rows with equal keys, where either side may have very many of one; rows have ids ``left`` and ``right``.

    A key with more rows than PIECE on a side is joined in pieces of PIECE by PIECE, each a join key of its own, so that
    no task makes all pairs of it.
    """
    left, right = materialise(left.filter(F.col(keys[0]).isNotNull()), "left"), materialise(right.filter(F.col(keys[0]).isNotNull()), "right")
    count = lambda df, c: df.groupBy(*keys).agg(F.ceil(F.count("*") / PIECE).cast("int").alias(c))
    # at most 1 / PIECE of all rows' keys
    many = materialise(count(left, "p_left").join(count(right, "p_right"), keys).filter("p_left > 1 or p_right > 1"), "pieces")

    def cut(df: DataFrame, c: str, other: str) -> DataFrame:
        one = F.lit(1)
        at, of = F.pmod(F.xxhash64(c), F.coalesce(f"p_{c}", one)).cast("int"), F.sequence(F.lit(0), F.coalesce(f"p_{other}", one) - 1)
        return df.join(many, keys, "left").select(*df.columns, at.alias(f"at_{c}"), F.explode(of).alias(f"at_{other}"))

    # by a given number: partitions would else be put together by their bytes, which say nothing of the pairs they make
    by, tasks = [*keys, "at_left", "at_right"], 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = cut(left, "left", "right").repartition(tasks, *by).join(cut(right, "right", "left").repartition(tasks, *by).hint("shuffle_hash"), by)
    return pieces.drop("at_left", "at_right")


def name_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(corpus_id, left, right, level)``: pairs of names of one corpus that agree at all.

    Both have ``corpus_id, name``, distinct. Names that are equal or forms of each other meet by their form (each rotation
    of the tokens, joined, or the ideographs), which few share. One that may state part of the other meets it by one full
    word with the first letter of another token: by a word alone all names of a common surname would meet.
    """
    t, w, i, none = F.col("t"), F.col("w"), F.col("i"), F.array().cast("array<string>")
    rotated = F.array_join(F.concat(F.slice(t, i + 1, F.size(t)), F.slice(t, F.lit(1), i)), "")

    def meeting(df: DataFrame, c: str, less: str, more: str) -> DataFrame:
        named = df.select("corpus_id", F.col("name").alias(c), S.latin_tokens(F.col("name")).alias("t"), F.nullif(S.han_key(F.col("name")), F.lit("")).alias("h"))
        each = named.withColumn("at", S.longest_word(t)).select("*", F.posexplode_outer("t").alias("i", "w"))
        # a row for each token: outside of lambdas, and of explode(), its keys are made by generated code
        keys = F.concat(
            F.when(w.isNotNull(), F.array(F.concat(F.lit("l:"), rotated))).otherwise(none), F.when(F.coalesce(i, F.lit(0)) == 0, F.array(F.concat(F.lit("h:"), "h"))).otherwise(none),
            F.when(i == F.col("at"), F.array(F.concat(F.lit(less), S.short_key(t, w, i)))).otherwise(none), F.when((F.length(w) > 1) & (F.size(t) > 1), S.long_keys(t, w, i, more)).otherwise(none),
        )
        # a number is sorted faster than text; names that meet since their keys have one number are told apart by the level
        return each.select("corpus_id", c, keys.alias("keys")).select("corpus_id", c, F.explode_outer("keys").alias("k")).filter("k is not null").select("corpus_id", c, F.xxhash64("corpus_id", "k").alias("k"))

    x, y = meeting(left, "left", "<", ">"), meeting(right, "right", ">", "<")
    pairs = x.join(y, ["k", "corpus_id"]).select("corpus_id", "left", "right").distinct()
    parts = lambda c, t, script: {"script": F.col(script), "han": S.han_key(F.col(c)), "tokens": F.col(t), "forms": S.rotations(F.col(t))}
    told = pairs.withColumns({f"{p}_tokens": S.latin_tokens(F.col(c)) for p, c in (("a", "left"), ("b", "right"))} | {f"{p}_script": S.script_of(F.col(c)) for p, c in (("a", "left"), ("b", "right"))})
    # written before it is filtered: a filter on the level would be pushed into the join, and worked out for each of its rows
    return materialise(told.select("corpus_id", "left", "right", S.level_by_parts(parts("left", "a_tokens", "a_script"), parts("right", "b_tokens", "b_script")).alias("level")), "names").filter("level is not null and level <> 'undecidable_script'")


def reconcile(graduates: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graduates against the people of a corpus, both ``(corpus_id, name)`` and distinct.

    The first result has ``(corpus_id, graduate, outcome, person)``: one person that agrees is matched, several are
    ambiguous; else partial_name if a name may state part of it, undecidable_script if the corpus has names in the other
    script only to compare with, else without_record. A person that two graduates claim is contested, and so are these.
    The second has ``(corpus_id, person, standing)`` of every person: claimed, in_review (named by a graduate that isn't
    matched) or people_only.
    """
    graduates, people = materialise(graduates, "graduates"), materialise(people, "people")
    found = name_candidates(graduates, people)
    good = F.col("level").isin("exact", "name_form")
    a = found.groupBy("corpus_id", "left").agg(F.count_if(good).alias("n_good"), F.min(F.when(good, F.col("right"))).alias("person"), F.bool_or(F.col("level") == "partial_name").alias("weak"))
    script = S.script_of(F.col("name"))
    has = people.groupBy("corpus_id").agg(F.bool_or(script == "han").alias("has_han"), F.bool_or(script == "latin").alias("has_latin"))
    own = S.script_of(F.col("graduate"))
    other = (own == "han") & F.col("has_latin") | (own == "latin") & F.col("has_han")
    g = graduates.select("corpus_id", F.col("name").alias("graduate")).join(a.withColumnRenamed("left", "graduate"), ["corpus_id", "graduate"], "left").join(F.broadcast(has), "corpus_id", "left")
    outcome = F.when(F.col("n_good") == 1, "matched").when(F.col("n_good") > 1, "ambiguous").when(F.col("weak"), "partial_name").when(other, "undecidable_script").otherwise("without_record")
    g = g.withColumn("outcome", outcome).withColumn("person", F.when(F.col("outcome") == "matched", F.col("person")))
    claims = g.filter("person is not null").groupBy("corpus_id", "person").agg(F.count("*").alias("claims"))
    out = materialise(g.join(claims, ["corpus_id", "person"], "left").select("corpus_id", "graduate", F.when(F.col("claims") > 1, "contested").otherwise(F.col("outcome")).alias("outcome"), "person"), "outcomes")
    claimed = out.filter("outcome = 'matched'").select("corpus_id", "person", F.lit(True).alias("claimed"))
    review = found.withColumnRenamed("left", "graduate").join(out.filter(F.col("outcome").isin("ambiguous", "partial_name", "contested")).select("corpus_id", "graduate"), ["corpus_id", "graduate"]).select("corpus_id", F.col("right").alias("person"), F.lit(False).alias("claimed"))
    named = claimed.unionByName(review).groupBy("corpus_id", "person").agg(F.bool_or("claimed").alias("claimed"))
    standing = F.when(F.col("claimed"), "claimed").when(~F.col("claimed"), "in_review").otherwise("people_only")
    p = people.select("corpus_id", F.col("name").alias("person")).join(named, ["corpus_id", "person"], "left")
    return out, p.select("corpus_id", "person", standing.alias("standing"))


def reconcile_shares(outcomes: DataFrame, standings: DataFrame) -> DataFrame:
    """Per corpus graduates by outcome, the bounds of those without a record, and their share: null under 5 graduates or with half of them open."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    a = outcomes.groupBy("corpus_id").agg(F.count("*").alias("graduates"), n("matched").alias("with_record"), n("without_record").alias("without_record"), n("ambiguous", "partial_name", "contested").alias("review"), n("undecidable_script").alias("undecidable"))
    p = standings.groupBy("corpus_id").agg(F.count_if(F.col("standing") == "people_only").alias("people_only"))
    open_ = (F.col("review") + F.col("undecidable")) / F.col("graduates")
    share = F.when((F.col("graduates") >= 5) & (open_ <= 0.5), F.col("without_record") / F.col("graduates"))
    return a.join(p, "corpus_id", "left").withColumns({"without_at_most": F.col("without_record") + F.col("review"), "share_without": share})


def same_advisor(a: Column, b: Column) -> Column:
    """Whether two cells name one advisor: their letters are equal, or their Latin tokens in any order."""
    ta, tb = S.latin_tokens(a), S.latin_tokens(b)
    key = lambda c: S.letters_only(C.narrow(c))
    return F.coalesce(((key(a) != "") & (key(a) == key(b))) | ((F.size(ta) > 0) & (F.array_sort(ta) == F.array_sort(tb)) & (S.script_of(a) == "latin") & (S.script_of(b) == "latin")), F.lit(False))


def best_issn(*cells: Column) -> Column:
    """The first valid serial number of several cells."""
    return F.coalesce(*[C.valid_issn(c) for c in cells])
