"""Queries over harvested records: two harvests merged, roles and identity, names of people, side tables and services' answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibloom.functions import columns as C
from bibloom.functions import scalar as S
from bibloom.operators import linkage, reports, roles
from bibloom.plans import sqltext as X
from bibloom.plans.adapter import Model
from bibloom.sources import signals

QUERIES = {}
SQL: dict[str, str] = {}


def query(text: str | None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf: f(Model(spark, sf))
        if text:
            SQL[f.__name__] = text
        return f

    return keep


# two harvests: each snapshot of the papers and the next one, all four of them

_TITLE = "regexp_replace(lower(title), '[^a-z0-9一-鿿]', '', 'g')"
_MERGE = f"""WITH RECURSIVE p AS (SELECT row_id, snapshot_no::bigint AS snap, {X.doi('doi')} AS d, {X.pmid('pmid')} AS m, CASE WHEN {_TITLE} <> '' AND pub_year IS NOT NULL THEN {_TITLE} || '|' || pub_year END AS t FROM papers),
keyed AS (SELECT row_id, snap, 0 AS place, 'doi' AS kind, 'd:' || d AS key FROM p WHERE d IS NOT NULL UNION ALL SELECT row_id, snap, 1, 'pmid', 'p:' || m FROM p WHERE m IS NOT NULL UNION ALL SELECT row_id, snap, 2, 'title_year', 't:' || t FROM p WHERE t IS NOT NULL),
own AS (SELECT snap AS corpus_id, key, min(row_id) AS base FROM keyed GROUP BY 1, 2), held AS (SELECT snap - 1 AS corpus_id, row_id, place, kind, key FROM keyed WHERE snap > (SELECT min(snap) FROM p)),
several AS (SELECT corpus_id, key, min(row_id) AS hub FROM held GROUP BY 1, 2 HAVING count(*) > 1),
direct AS (SELECT row_id, arg_min(base, place) AS base, arg_min(kind, place) AS kind FROM held JOIN own USING (corpus_id, key) GROUP BY 1), shared AS (SELECT row_id, arg_min(kind, place) AS kind FROM held JOIN several USING (corpus_id, key) GROUP BY 1),
link AS (SELECT DISTINCT row_id AS u, hub AS v FROM held JOIN several USING (corpus_id, key) WHERE row_id <> hub), ways AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT row_id AS root, row_id AS node FROM p UNION SELECT root, v FROM reach JOIN ways ON u = node), grouped AS (SELECT node AS row_id, min(root) AS grp FROM reach GROUP BY 1),
tied AS (SELECT g.grp, min(d.base) AS base, min(g.row_id) AS least FROM grouped g JOIN p ON p.row_id = g.row_id AND snap > (SELECT min(snap) FROM p) LEFT JOIN direct d ON d.row_id = g.row_id GROUP BY 1),
merged AS (SELECT p.snap - 1 AS corpus_id, p.row_id AS record_id, coalesce(d.base, t.base, t.least) AS entity, t.base IS NOT NULL AS in_first, CASE WHEN d.row_id IS NOT NULL THEN 'cross' WHEN t.base IS NULL AND p.row_id = t.least THEN 'new' ELSE 'internal' END AS outcome,
  CASE WHEN d.row_id IS NOT NULL THEN d.kind WHEN NOT (t.base IS NULL AND p.row_id = t.least) THEN s.kind END AS kind
  FROM p JOIN grouped g ON g.row_id = p.row_id JOIN tied t ON t.grp = g.grp LEFT JOIN direct d ON d.row_id = p.row_id LEFT JOIN shared s ON s.row_id = p.row_id WHERE p.snap > (SELECT min(snap) FROM p))
"""


def _harvests(m):
    p = m.table("papers")
    ids = F.transform("authors", lambda a: a["orcid"])
    rows = p.select(F.col("snapshot_no").cast("long").alias("snap"), F.col("row_id").alias("record_id"), linkage.identity_keys(F.col("doi"), F.col("pmid"), F.col("title"), F.col("pub_year")).alias("keys"), C.doi_key(F.col("doi")).alias("doi"), F.col("pmc_id").alias("work_id"), F.array_compact(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.nullif(F.trim(x), F.lit("")))).alias("author_ids"))
    least = p.agg(F.min("snapshot_no")).first()[0]
    first = rows.withColumn("corpus_id", F.col("snap")).withColumn("source", F.lit("first")).drop("snap")
    second = rows.filter(F.col("snap") > F.lit(least)).withColumn("corpus_id", F.col("snap") - 1).withColumn("source", F.lit("second")).drop("snap")
    return first, second


@query(_MERGE + "SELECT * FROM merged")
def corpus_merge(m):
    """Where each paper of a snapshot goes in the snapshot before it: by DOI, PMID, or title and year, directly or through its copies."""
    return linkage.merge_harvests(*_harvests(m))


@query(_MERGE + """, a AS (SELECT snap AS corpus_id, count(*) AS first_total FROM p GROUP BY 1), b AS (SELECT corpus_id, count(*) AS second_total, count(*) FILTER (WHERE outcome = 'new') AS second_only, """ + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}' AND kind = '{k}') AS {o}_{k}" for o in ("cross", "internal") for k in ("doi", "pmid", "title_year")) + """, count(DISTINCT entity) FILTER (WHERE in_first) AS both_sources FROM merged GROUP BY 1)
SELECT a.corpus_id, first_total, coalesce(second_total, 0) AS second_total, coalesce(second_only, 0) AS second_only, """ + ", ".join(f"coalesce({o}_{k}, 0) AS {o}_{k}" for o in ("cross", "internal") for k in ("doi", "pmid", "title_year")) + """, coalesce(both_sources, 0) AS both_sources, first_total + coalesce(second_only, 0) AS merged_total, first_total - coalesce(both_sources, 0) AS first_only FROM a LEFT JOIN b USING (corpus_id)""")
def merge_counts(m):
    first, second = _harvests(m)
    return linkage.merge_counts(first, linkage.merge_harvests(first, second))


@query(_MERGE + f""", everything AS (SELECT snap AS corpus_id, row_id AS entity, true AS in_first, 0 AS side, row_id AS record_id FROM p UNION ALL SELECT corpus_id, entity, in_first, 1, record_id FROM merged),
cells AS (SELECT e.*, {X.doi('q.doi')} AS doi, nullif(trim(q.pmc_id), '') AS work_id, authors FROM everything e JOIN papers q ON q.row_id = e.record_id),
ids AS (SELECT corpus_id, entity, in_first, string_agg(id, ';' ORDER BY id) AS author_ids FROM (SELECT DISTINCT corpus_id, entity, in_first, nullif(trim(a.orcid), '') AS id FROM (SELECT corpus_id, entity, in_first, unnest(authors) AS a FROM cells)) WHERE id IS NOT NULL GROUP BY 1, 2, 3)
SELECT c.corpus_id, c.entity, c.in_first, arg_min(doi, side * 1000000000000 + record_id) AS doi, arg_min(work_id, side * 1000000000000 + record_id) AS work_id, coalesce(any_value(i.author_ids), '') AS author_ids, string_agg(DISTINCT CASE WHEN side = 0 THEN 'first' ELSE 'second' END, ';' ORDER BY CASE WHEN side = 0 THEN 'first' ELSE 'second' END) AS confirmed_by
FROM cells c LEFT JOIN ids i ON i.corpus_id = c.corpus_id AND i.entity = c.entity AND i.in_first = c.in_first GROUP BY 1, 2, 3""")
def corpus_fold(m):
    """The merged corpora with what the copies of a paper give to the record that stays."""
    first, second = _harvests(m)
    joined = lambda c: F.array_join(c, ";").alias(c)
    return linkage.fold_harvests(first, second, linkage.merge_harvests(first, second)).select("corpus_id", "entity", "in_first", "doi", "work_id", joined("author_ids"), joined("confirmed_by"))


# roles and identity: one person among the bylines of all snapshots

_WANTED = roles.Identity("Wei Y", orcid="0000-0000-9585-0823", email_domains=["yandong.example"], affiliation_keywords=["hospital", "university"])


def _entries(m):
    rows = m.table("papers").filter("size(authors) > 0").select(F.col("row_id").alias("record_id"), F.col("snapshot_no").cast("long").alias("corpus_id"), F.size("authors").cast("long").alias("n"), F.posexplode("authors").alias("idx", "a"))
    return rows.select("record_id", "corpus_id", "idx", "n", "a.*")


_BYLINE = """byline AS (SELECT row_id AS record_id, snapshot_no::bigint AS corpus_id, len(authors) AS n, unnest(range(0, len(authors))) AS idx, unnest(authors) AS a FROM papers WHERE len(authors) > 0),
cells AS (SELECT record_id, corpus_id, n, idx, a.*, regexp_replace(lower(strip_accents(coalesce(a.last, ''))), '[^a-zßæøđłœþð]+', '', 'g') AS surname, regexp_replace(lower(strip_accents(coalesce(a.initials, ''))), '[^a-z]+', '', 'g') AS code,
  list_filter(flatten(list_transform(string_split_regex(trim(coalesce(nullif(trim(a.fore), ''), a.initials, '')), '\\s+'), lambda w: CASE WHEN len(list_filter(string_split_regex(w, '[-.‐]'), lambda x: length(regexp_replace(lower(strip_accents(x)), '[^a-z]+', '', 'g')) > 1)) = 0 THEN list_transform(string_split_regex(w, '[-.‐]'), lambda x: regexp_replace(lower(strip_accents(x)), '[^a-z]+', '', 'g')) ELSE [regexp_replace(lower(strip_accents(w)), '[^a-z]+', '', 'g')] END)), lambda x: x <> '') AS words FROM byline)"""


@query(f"WITH {_BYLINE}" + """, hit AS (SELECT *, coalesce(is_corresponding, false) AS corr FROM cells WHERE (surname = 'wei' AND (len(words) = 0 OR words[1][1] = 'y')) OR (surname = 'y' AND (len(words) = 0 OR code = 'wei' OR (CASE WHEN len(list_filter(words, lambda x: length(x) > 1)) = 0 OR code <> '' AND array_to_string(words, '') = code THEN words[1][1] = 'w' ELSE array_to_string(words, '') = 'wei' OR words[1] = 'wei' END)))),
told AS (SELECT *, array_to_string(list_filter([CASE WHEN idx = 0 THEN 'first' END, CASE WHEN idx = n - 1 THEN 'last' END, CASE WHEN corr THEN 'corresponding' END], lambda x: x IS NOT NULL), ' / ') AS roles,
  CASE WHEN lower(trim(orcid)) = '0000-0000-9585-0823' THEN 'orcid' WHEN lower(trim(email)) LIKE '%@yandong.example' OR lower(trim(email)) LIKE '%.yandong.example' OR lower(trim(email)) = 'yandong.example' THEN 'email' WHEN contains(lower(affiliation), 'hospital') OR contains(lower(affiliation), 'university') THEN 'affiliation' END AS ev FROM hit WHERE idx = 0 OR idx = n - 1 OR corr)
SELECT record_id, bool_or(ev IS NOT NULL) AS kept, arg_min(roles, (ev IS NULL)::int * 100000 + idx) AS roles, arg_min(ev, idx) AS evidence, arg_min(idx, (ev IS NULL)::int * 100000 + idx)::bigint AS idx FROM told GROUP BY 1""")
def role_filter(m):
    """The records that are one person's, by name, role and identity."""
    return roles.role_filter(_entries(m), _WANTED)


_LOOSE = roles.Identity("Wei", affiliation="Hospital", require_affiliation=False)


@query("""WITH hit AS (SELECT row_id AS record_id, len(authors) AS n, unnest(range(0, len(authors))) AS idx, unnest(authors) AS a FROM papers WHERE len(authors) > 0), told AS (SELECT record_id, CASE WHEN contains(lower(a.affiliation), 'hospital') THEN 'affiliation' END AS ev FROM hit WHERE regexp_replace(lower(strip_accents(coalesce(a.last, ''))), '[^a-z]+', '', 'g') = 'wei' AND (idx = 0 OR idx = n - 1 OR coalesce(a.is_corresponding, false))),
one AS (SELECT record_id, coalesce(max(ev), 'name_only') AS ev FROM told GROUP BY 1)
SELECT p.snapshot_no::bigint AS corpus_id, count(*) AS fetched, count(*) FILTER (WHERE ev = 'affiliation') AS verified, count(*) FILTER (WHERE ev = 'name_only') AS name_only, 0 AS refused, count(*) FILTER (WHERE ev IS NULL) AS absent FROM papers p LEFT JOIN one ON record_id = row_id GROUP BY 1""")
def role_counts(m):
    """Records fetched, verified and kept by name alone for a surname, where no affiliation is required."""
    total = m.table("papers").select(F.col("row_id").alias("record_id"), F.col("snapshot_no").cast("long").alias("corpus_id"))
    return roles.search_counts(roles.role_filter(_entries(m), _LOOSE), total)


_PERSON = "lower(trim(a.last)) || '|' || lower(trim(a.fore)) || '|' || coalesce(nullif(trim(a.orcid), ''), '')"


@query(f"""WITH e AS (SELECT try_cast(pub_year AS INT) AS year, coalesce(trim(journal), '') AS topic, unnest(authors) AS a FROM papers), r AS (SELECT lower(trim(a.last)) AS searched, {_PERSON} AS person, coalesce(trim(a.affiliation), '') AS institution, topic, year FROM e WHERE trim(a.last) <> ''),
found AS (SELECT searched, person, count(*) AS works FROM r GROUP BY 1, 2), top AS (SELECT searched, person, string_agg(topic, '; ' ORDER BY k DESC, topic) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY searched, person ORDER BY k DESC, topic) AS rn FROM (SELECT searched, person, topic, count(*) AS k FROM r WHERE topic <> '' GROUP BY 1, 2, 3)) WHERE rn <= 3 GROUP BY 1, 2),
seen AS (SELECT searched, person, string_agg(institution, '; ' ORDER BY since NULLS FIRST, institution) AS institutions FROM (SELECT searched, person, institution, min(year) AS since FROM r WHERE institution <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT f.searched, f.person, works, coalesce(institutions, '') AS institutions, coalesce(topics, '') AS topics, count(*) OVER (PARTITION BY f.searched) AS n_candidates, CASE WHEN count(*) OVER (PARTITION BY f.searched) = 1 THEN 'unique' ELSE 'ambiguous' END AS resolution FROM found f LEFT JOIN top USING (searched, person) LEFT JOIN seen USING (searched, person)""")
def author_search(m):
    """Every surname searched for in the bylines: the persons who have it, with institutions as first seen and the commonest journals."""
    e = m.table("papers").select(F.col("pub_year").try_cast("int").alias("year"), F.coalesce(F.trim("journal"), F.lit("")).alias("topic"), F.explode("authors").alias("a"))
    person = F.concat_ws("|", F.lower(F.trim("a.last")), F.lower(F.trim("a.fore")), F.coalesce(F.nullif(F.trim("a.orcid"), F.lit("")), F.lit("")))
    rows = e.filter(F.trim("a.last") != "").filter(F.col("a.fore").isNotNull()).select("year", "topic", F.lower(F.trim("a.last")).alias("surname"), person.alias("person"), F.coalesce(F.trim("a.affiliation"), F.lit("")).alias("institution"))
    joined = lambda c: F.coalesce(F.array_join(c, "; "), F.lit("")).alias(c)
    return roles.author_candidates(rows, F.col("surname")).select("searched", "person", "works", joined("institutions"), joined("topics"), "n_candidates", "resolution")


# names of people


@query(f"""WITH w AS (SELECT work_id, d, unnest(range(0, len(l))) AS idx, unnest(l) AS name FROM (SELECT work_id, {X.doi('doi')} AS d, string_split(authors_str, ';') AS l FROM works)), r AS (SELECT rec_id, d, unnest(range(0, len(l))) AS idx, unnest(l) AS name FROM (SELECT rec_id, {X.doi('doi')} AS d, string_split(authors_pinyin_raw, ';') AS l FROM chinese_records)),
both_ AS (SELECT work_id, rec_id, w.idx, {X.name_columns('a', 'w.name')}, {X.name_columns('b', 'r.name')} FROM w JOIN r ON w.d = r.d AND w.idx = r.idx) SELECT work_id, rec_id, idx, {X.name_level('a', 'b')} AS level FROM both_""")
def name_compare(m):
    """Byline names of the works against those in the same place of the records with the same DOI: how they agree."""
    side = lambda t, i, c: m.table(t).select(i, C.doi_key(F.col("doi")).alias("d"), F.posexplode(F.split(c, ";")).alias("idx", c))
    left = linkage.with_parts(side("works", "work_id", "authors_str"), "authors_str", "a").drop("authors_str")
    right = linkage.with_parts(side("chinese_records", "rec_id", "authors_pinyin_raw"), "authors_pinyin_raw", "b").drop("authors_pinyin_raw")
    j = linkage.joined_in_pieces(left.withColumnRenamed("work_id", "left"), right.withColumnRenamed("rec_id", "right"), ["d", "idx"])
    return linkage.with_level(j, "a", "b", "left", "right", "idx").select(F.col("left").alias("work_id"), F.col("right").alias("rec_id"), F.col("idx").cast("long").alias("idx"), "level")


_NAMES = f"""WITH g0 AS (SELECT DISTINCT publication_year::bigint AS corpus_id, trim(unnest(string_split(authors_str, ';'))) AS name FROM works), p0 AS (SELECT DISTINCT pub_year::bigint AS corpus_id, trim(unnest(string_split(authors_pinyin_raw, ';'))) AS name FROM chinese_records),
g AS (SELECT corpus_id, {X.name_columns('a', 'name')} FROM g0 WHERE corpus_id IS NOT NULL AND name <> ''), q AS (SELECT corpus_id, {X.name_columns('b', 'name')} FROM p0 WHERE corpus_id IS NOT NULL AND name <> ''),
gk AS (SELECT *, unnest(list_distinct(list_concat(list_transform(a_forms, lambda x: 'l:' || x), ['h:' || regexp_replace(a_name, '[^一-鿿㐀-䶿]', '', 'g')], list_filter(a_tokens, lambda x: length(x) > 1)))) AS k FROM g), qk AS (SELECT *, unnest(list_distinct(list_concat(list_transform(b_forms, lambda x: 'l:' || x), ['h:' || regexp_replace(b_name, '[^一-鿿㐀-䶿]', '', 'g')], list_filter(b_tokens, lambda x: length(x) > 1)))) AS k FROM q),
cand AS (SELECT DISTINCT gk.corpus_id, a_name, a_script, a_tokens, a_forms, b_name, b_script, b_tokens, b_forms FROM gk JOIN qk ON gk.corpus_id = qk.corpus_id AND gk.k = qk.k WHERE gk.k <> 'h:'),
found AS (SELECT corpus_id, a_name AS graduate, b_name AS person, {X.name_level('a', 'b')} AS level FROM cand), per AS (SELECT corpus_id, graduate, count(*) FILTER (WHERE level IN ('exact', 'name_form')) AS good, min(person) FILTER (WHERE level IN ('exact', 'name_form')) AS person, count(*) FILTER (WHERE level = 'partial_name') AS weak FROM found GROUP BY 1, 2),
has AS (SELECT corpus_id, bool_or(b_script = 'han') AS han, bool_or(b_script = 'latin') AS latin FROM q GROUP BY 1),
first_ AS (SELECT g.corpus_id, a_name AS graduate, CASE WHEN good = 1 THEN 'matched' WHEN good > 1 THEN 'ambiguous' WHEN weak > 0 THEN 'partial_name' WHEN a_script = 'han' AND latin OR a_script = 'latin' AND han THEN 'undecidable_script' ELSE 'without_record' END AS outcome, CASE WHEN good = 1 THEN person END AS person FROM g LEFT JOIN per ON per.corpus_id = g.corpus_id AND per.graduate = a_name LEFT JOIN has ON has.corpus_id = g.corpus_id),
outcome AS (SELECT corpus_id, graduate, CASE WHEN person IS NOT NULL AND count(*) OVER (PARTITION BY corpus_id, person) > 1 THEN 'contested' ELSE outcome END AS outcome, person FROM first_),
claimed AS (SELECT DISTINCT corpus_id, person FROM outcome WHERE outcome = 'matched'), review AS (SELECT DISTINCT f.corpus_id, f.person FROM found f JOIN outcome o ON o.corpus_id = f.corpus_id AND o.graduate = f.graduate WHERE f.level IN ('exact', 'name_form', 'partial_name') AND o.outcome IN ('ambiguous', 'partial_name', 'contested')),
standing AS (SELECT q.corpus_id, b_name AS person, CASE WHEN c.person IS NOT NULL THEN 'claimed' WHEN r.person IS NOT NULL THEN 'in_review' ELSE 'people_only' END AS standing FROM q LEFT JOIN claimed c ON c.corpus_id = q.corpus_id AND c.person = b_name LEFT JOIN review r ON r.corpus_id = q.corpus_id AND r.person = b_name) """


def _reconciled(m):
    names = lambda t, y, c: m.table(t).select(F.col(y).cast("long").alias("corpus_id"), F.explode(F.split(c, ";")).alias("name")).select("corpus_id", F.trim("name").alias("name")).filter("corpus_id is not null and name <> ''").distinct()
    return linkage.reconcile(names("works", "publication_year", "authors_str"), names("chinese_records", "pub_year", "authors_pinyin_raw"))


@query(_NAMES + "SELECT * FROM outcome")
def thesis_reconcile(m):
    """Authors of the works of a year as graduates against authors of that year's records as people."""
    return _reconciled(m)[0]


@query(_NAMES + "SELECT * FROM standing")
def thesis_people(m):
    """The people of the same reconciliation: claimed by a graduate, in review, or in the records only."""
    return _reconciled(m)[1]


@query(_NAMES + """, n AS (SELECT corpus_id, count(*) AS graduates, count(*) FILTER (WHERE outcome = 'matched') AS with_record, count(*) FILTER (WHERE outcome = 'without_record') AS without_record, count(*) FILTER (WHERE outcome IN ('ambiguous', 'partial_name', 'contested')) AS review, count(*) FILTER (WHERE outcome = 'undecidable_script') AS undecidable FROM outcome GROUP BY 1)
SELECT n.*, people_only, without_record + review AS without_at_most, CASE WHEN graduates >= 5 AND (review + undecidable) / graduates <= 0.5 THEN without_record / graduates END AS share_without FROM n LEFT JOIN (SELECT corpus_id, count(*) FILTER (WHERE standing = 'people_only') AS people_only FROM standing GROUP BY 1) USING (corpus_id)""")
def thesis_shares(m):
    return linkage.reconcile_shares(*_reconciled(m))


@query(f"""WITH target AS (SELECT {X.name_columns('h', "'韦珩'")}, {X.name_columns('l', "'Wei Heng'")}), lists AS (SELECT rec_id, list_filter(list_transform(string_split_regex(authors_raw, '[;；,，、|｜]'), lambda x: regexp_replace(x, '[*＊#†\\s]+', '', 'g')), lambda x: x <> '') AS l FROM chinese_records),
e AS (SELECT rec_id, unnest(range(0, len(l))) AS idx, unnest(l) AS name FROM lists), c AS (SELECT rec_id, idx, {X.name_columns('a', 'name')}, target.* FROM e CROSS JOIN target), v AS (SELECT rec_id, idx, a_script, {X.name_level('a', 'h')} AS one, {X.name_level('a', 'l')} AS two FROM c),
b AS (SELECT rec_id, idx, greatest(CASE WHEN one IN ('exact', 'name_form') OR two IN ('exact', 'name_form') THEN 4 ELSE 0 END, CASE WHEN one = 'partial_name' OR two = 'partial_name' THEN 3 ELSE 0 END, CASE WHEN one IS NULL AND a_script = 'han' OR two IS NULL AND a_script = 'latin' THEN 2 ELSE 0 END, CASE WHEN one = 'undecidable_script' OR two = 'undecidable_script' THEN 1 ELSE 0 END) AS b FROM v),
n AS (SELECT rec_id, count(*) FILTER (WHERE b = 4) AS good, min(idx) FILTER (WHERE b = 4) AS first_, max(b) AS top FROM b GROUP BY 1)
SELECT r.rec_id AS record_id, CASE WHEN good = 1 THEN 'exact' WHEN good > 1 THEN 'ambiguous' WHEN top = 3 THEN 'partial_name' WHEN top = 1 THEN 'undecidable_script' ELSE 'no_author_matched' END AS outcome, CASE WHEN good = 1 THEN first_ END AS index FROM chinese_records r LEFT JOIN n ON n.rec_id = r.rec_id""")
def target_in_bylines(m):
    """Where one person, known by a Chinese and a romanised name, stands in the records' author lists."""
    r = m.table("chinese_records").select(F.col("rec_id").alias("record_id"), F.filter(F.transform(F.split("authors_raw", "[;；,，、|｜]"), lambda x: F.regexp_replace(x, r"[*＊#†\s]+", "")), lambda x: x != "").alias("authors"))
    return reports.locate(r, ("韦珩", "Wei Heng"))


_SORTED = "list_sort({})"


@query(f"""WITH a AS (SELECT c_custkey AS id, c_name AS x, o.c_next AS y FROM customer JOIN (SELECT c_custkey - 1 AS k, c_name AS c_next FROM customer) o ON o.k = c_custkey) SELECT id, coalesce(regexp_replace(lower(x), '[^a-z]+', '', 'g') = regexp_replace(lower(y), '[^a-z]+', '', 'g') AND regexp_replace(lower(x), '[^a-z]+', '', 'g') <> '' OR {_SORTED.format(X.tokens('x'))} = {_SORTED.format(X.tokens('y'))}, false) AS same FROM a""")
def advisor_equality(m):
    """Each customer's name and the next one's: equal letters or the same words."""
    c = m.table("customer").select("c_custkey", "c_name")
    j = c.join(c.select((F.col("c_custkey") - 1).alias("k"), F.col("c_name").alias("y")), F.col("c_custkey") == F.col("k"))
    return j.select(F.col("c_custkey").alias("id"), linkage.same_advisor(F.col("c_name"), F.col("y")).alias("same"))


@query(f"SELECT row_id, coalesce({X.issn('issn')}, {X.issn('eissn')}) AS issn FROM journals")
def best_issn(m):
    return m.table("journals").select("row_id", linkage.best_issn(F.col("issn"), F.col("eissn")).alias("issn"))


# answers of services: each journal row told as three services would


@query("""SELECT row_id, CASE WHEN is_warning THEN 'doaj_not_indexed' ELSE 'doaj_indexed' END AS signal, CASE WHEN is_warning THEN '0' ELSE '1' END AS value FROM journals WHERE is_warning IS NOT NULL
UNION ALL SELECT row_id, 'openalex_works_count', (row_id + 1)::varchar FROM journals UNION ALL SELECT row_id, 'openalex_indexed_in_scopus', 'unknown' FROM journals UNION ALL SELECT row_id, 'openalex_in_doaj', is_warning::varchar FROM journals WHERE is_warning IS NOT NULL""")
def source_signals(m):
    """Signals read from JSON answers made of the journal rows."""
    j = m.table("journals").select("row_id", "is_warning")
    doaj = F.to_json(F.struct(F.when(F.col("is_warning"), 0).when(~F.col("is_warning"), 1).alias("total")))
    index = F.to_json(F.struct(F.concat(F.lit("S"), F.col("row_id")).alias("id"), (F.col("row_id") + 1).alias("works_count"), F.col("is_warning").alias("is_in_doaj")))
    rows = j.select(F.col("row_id").alias("issn"), F.explode(F.array(F.struct(F.lit("doaj").alias("service"), doaj.alias("body")), F.struct(F.lit("openalex").alias("service"), index.alias("body")))).alias("s")).select("issn", "s.*", F.lit(200).alias("status"))
    return signals.source_signals(rows).select(F.col("issn").alias("row_id"), "signal", "value")
