"""Edge cases of the operators on hand-made frames."""

import random
import time
from statistics import quantiles

import pytest
from pyspark.sql import functions as F

from bibloom.functions import scalar as S
from bibloom.operators import cache, cohesion, corpus, diff, impact, linkage, metrics, people, quality, roles, scoring


def test_exclusions_first_reason_wins(spark):
    rows = [
        (1, 1, "5", "10.1/a", "ok", 2020, 3), (1, 2, "5", None, "same pmid", 2020, 3), (1, 3, "4", "10.1/A ", "same doi, least pmid", 2020, 3), (1, 4, None, None, "no keys", 2020, 3), (1, 5, "", "", "no keys either", 2020, 3), (1, 6, "7", None, "no year", None, 3),
        (1, 0, "5", None, "no year either", None, 3), (1, 7, "8", None, "Erratum: x", 2020, 3), (1, 8, "9", None, "bare", 2020, 0), (1, 9, "10", None, "many", 2020, 50), (1, 10, "11", None, "nearly", 2020, 49), (2, 11, "5", "10.1/a", "other corpus", 2020, 3),
    ]
    df = spark.createDataFrame(rows, "corpus_id long, record_id long, pmid string, doi string, title string, year int, n int")
    got = {r["record_id"]: r["reason"] for r in corpus.exclusion_reasons(df, F.col("n")).collect()}
    assert got == {0: "unparseable_date", 1: "duplicate_doi", 2: "duplicate_pmid", 3: None, 4: None, 5: None, 6: "unparseable_date", 7: "correction_or_comment", 8: "empty_author_list", 9: "hyperauthorship", 10: None, 11: None}


def test_byline_with_consortia(spark):
    a = lambda name, last="": {"name": name, "last": last, "fore": "", "initials": ""}
    df = spark.createDataFrame([(1, [a("Team"), a("A", "A"), a("B", "B")]), (2, []), (3, None), (4, [a("Team")])], "record_id long, authors array<struct<name:string,last:string,fore:string,initials:string>>")
    got = [(r["record_id"], r["name"], r["idx"], r["n"]) for r in corpus.explode_byline(df).orderBy("record_id", "idx").collect()]
    assert got == [(1, "A", 0, 2), (1, "B", 1, 2)]


def test_target_tie_is_told(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 4), (1, 2, 4), (2, 0, 0), (3, 5, 2)], "record_id long, idx long, e int")
    got = {tuple(r) for r in corpus.resolve_target(df, F.col("e")).collect()}
    assert got == {(1, 1, 4, True), (3, 5, 2, False)}


def test_person_keys(spark):
    rows = [("Li", "Wei", "", "O1"), ("Li", "W", "", None), ("Li", "Wen", "", None), ("Wu", "An", "", "O2"), ("Wu", "A", "", "O3"), ("Wu", "An", "", None), ("Xu", "", "", None), ("Yu", "Bo", "", None), ("Yu", "Bao", "", None), ("Zu", "Bo", "", None), ("Zu", "B", "", None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "corpus_id long, last string, fore string, initials string, orcid string").withColumn("name", F.concat_ws(" ", "last", "fore"))
    got = sorted((r["last"], r["fore"], r["person_key"], str(r["flag"])) for r in people.person_keys(df).collect())
    assert got == sorted([
        ("Li", "Wei", "O1", "None"), ("Li", "W", "O1", "None"), ("Li", "Wen", "O1", "None"), ("Wu", "An", "O2", "collision_confirmed"), ("Wu", "A", "O3", "collision_confirmed"), ("Wu", "An", "wu|a", "collision_confirmed"),
        ("Xu", "", "xu|", "incomplete_name"), ("Yu", "Bo", "yu|b", "collision_suspected"), ("Yu", "Bao", "yu|b", "collision_suspected"), ("Zu", "Bo", "zu|b", "drift_benign"), ("Zu", "B", "zu|b", "drift_benign"),
    ])


def test_competition_rank(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (1, "c", 3), (1, "d", 1)], "corpus_id long, person string, v int")
    assert {(r["person"], r["rank"], r["tied"]) for r in people.rank(df, F.col("v")).collect()} == {("a", 1, False), ("b", 2, True), ("c", 2, True), ("d", 4, False)}


def test_quantiles_and_suppression(spark):
    values = [1, 2, 3, 10]
    row = spark.createDataFrame([(x,) for x in values], "x int").agg(*[c.alias(k) for k, c in metrics.quantiles(F.col("x")).items()]).first()
    assert [row["q1"], row["median"], row["q3"]] == quantiles(values, n=4, method="inclusive") == [1.75, 2.5, 4.75]
    people_ = spark.createDataFrame([(c, f"p{i}", 1, 0, 2000 + i, 2000, 2010, "A") for c, n in ((1, 4), (2, 5)) for i in range(n)], "corpus_id long, person string, n_first int, n_last int, first_lead_year int, first_year int, window_end int, stratum string")
    got = {r["corpus_id"]: r for r in metrics.time_to_lead(people_).collect()}
    assert got[1]["median"] is None and got[1]["suppressed"] and got[2]["median"] == 2.0 and not got[2]["suppressed"]


def test_spine_has_gaps(spark):
    df = spark.createDataFrame([(1, 1, 2000), (1, 2, 2003)], "corpus_id long, record_id long, year int")
    got = [(r["year"], r["count"], r["partial"], r["indexing_lag"]) for r in metrics.records_per_year(df).orderBy("year").collect()]
    assert got == [(2000, 1, True, False), (2001, 0, False, False), (2002, 0, False, True), (2003, 1, True, True)]


def test_trend(spark):
    series = [(1, y, 2.0 * (y - 2000) + 1) for y in range(2000, 2006)] + [(2, y, 5.0) for y in range(2000, 2004)] + [(3, 2000, 1.0), (3, 2001, 2.0), (3, 2002, 3.0)] + [(4, 2000 + i, v) for i, v in enumerate([1.0, 3.0, 2.0, 5.0, 4.0])]
    got = {r["corpus_id"]: r for r in metrics.trend(spark.createDataFrame(series, "corpus_id long, year int, count double")).collect()}
    assert 3 not in got and got[1]["exact_fit"] and got[1]["slope"] == 2.0 and got[2]["slope"] == 0.0 and not got[2]["excludes_zero"]
    x = list(range(5))
    y = [1.0, 3.0, 2.0, 5.0, 4.0]
    sse = sum((b - (1.4 + 0.8 * a)) ** 2 for a, b in zip(x, y, strict=True))
    half = 3.182 * (sse / 3 / 10) ** 0.5
    assert got[4]["slope"] == pytest.approx(0.8) and got[4]["upper"] == pytest.approx(0.8 + half)


def test_citations(spark):
    papers = spark.createDataFrame([(1, "p1", "10.1/A"), (2, "p1", None), (3, None, "10.1/a"), (4, None, None), (5, "p5", None)], "record_id long, pmid string, doi string")
    cites = spark.createDataFrame([(0, "p1", None, "7", "s"), (1, "p1", None, "9", "s"), (2, None, "10.1/A", "0", "s"), (3, "p5", None, "-1", "s"), (4, None, None, "3", "s")], "position long, pmid string, doi string, citation_count string, source string")
    got = {r["record_id"]: (r["cites"], r["route"]) for r in impact.join_citations(papers, cites).collect()}
    assert got == {1: (7, "pmid"), 2: (None, "none"), 3: (0, "doi"), 4: (None, "none"), 5: (None, "none")}


def test_h_index_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(c, rnd.choice([None, *range(12)])) for c in range(6) for _ in range(rnd.randrange(0, 15))] + [(99, None)]
    got = {r["corpus_id"]: r["h"] for r in impact.h_index(spark.createDataFrame(rows, "corpus_id long, cites long")).collect()}
    for c in {r[0] for r in rows}:
        v = sorted((x for k, x in rows if k == c and x is not None), reverse=True)
        if v:
            assert got[c] == max([0, *(i for i in range(1, len(v) + 1) if v[i - 1] >= i)])
    assert 99 not in got


def test_scores(spark):
    with pytest.raises(ValueError):
        scoring.weights({"nope": 1})
    with pytest.raises(ValueError):
        scoring.weights({"time_to_lead": float("nan")})
    parts = spark.createDataFrame([(1, "time_to_lead", 0.5), (1, "records_per_year", 0.25), (1, "citation_median", 1.0), (2, "time_to_lead", 1.0), (2, "records_per_year", 1.0)], "corpus_id long, component string, value double")
    got = {r["corpus_id"]: r["score"] for r in scoring.scores(parts, {"citation_median": 2}).collect()}
    assert got == {1: 68.8, 2: None}
    ranked = spark.createDataFrame([(1, 50.0, "a", False), (2, 50.0, "a", False), (3, 20.0, "b", False), (4, None, "a", False), (5, 90.0, "a", True)], "corpus_id long, score double, components string, warned boolean")
    got = {r["corpus_id"]: (r["rank"], r["reason"], r["comparable"]) for r in scoring.rank_corpora(ranked).collect()}
    assert got == {1: (1, None, False), 2: (1, None, False), 3: (3, None, False), 4: (None, "no_score", False), 5: (None, "warnings", False)}
    assert [tuple(r) for r in scoring.statements(scoring.rank_corpora(ranked)).orderBy("corpus_id").collect()] == [(1, 2, "tie", 0.0), (2, 3, "ahead", 30.0)]
    stars, letter = scoring.bands(F.col("s"))
    assert [tuple(r) for r in spark.createDataFrame([(0.0,), (19.9,), (20.0,), (100.0,), (101.0,), (None,)], "s double").select(stars, letter).collect()] == [(1, "E"), (1, "E"), (2, "D"), (5, "A"), (None, None), (None, None)]


def test_clusters(spark):
    papers = spark.createDataFrame([(1, i) for i in range(6)] + [(2, 10), (2, 11)], "corpus_id long, record_id long")
    members = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 1, "b"), (1, 2, "b"), (1, 3, "c"), (1, 3, "c"), (2, 10, "x"), (2, 11, "x")], "corpus_id long, record_id long, person string")
    got = {r["record_id"]: r["cluster"] for r in cohesion.clusters(papers, members).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}


def test_alias_groups(spark):
    df = spark.createDataFrame([("Journal of Applied Physics", 9), ("J Appl Phys", 2), ("J Appl Chem", 1), ("期刊", 3)], "journal string, n long")
    assert {r["journal"]: r["anchor"] for r in cohesion.alias_groups(df).collect() if r["journal"] != r["anchor"]} == {"J Appl Phys": "Journal of Applied Physics"}


def test_journal_routes(spark):
    names = spark.createDataFrame([("X", "0317-8471"), ("The Alpha Beta Gamma", None), ("Alph Bet Gam", None), ("Delt Eps Zet", None), ("None such", "bad"), ("A.B.G.", None), (None, None)], "journal string, issn string")
    table = spark.createDataFrame([(1, "Alpha Beta Gamma", "A B G", "0317-8471", None), (2, "Delta Epsilon Zeta", None, None, None), (3, "Deltas Epsilons Zetas", None, None, "2049-3630")], "entry long, name string, official_abbreviation string, issn string, eissn string")
    got = {r["journal"]: (r["route"], r["entry"]) for r in linkage.journal_routes(names, table).collect()}
    assert got == {"X": ("issn", 1), "The Alpha Beta Gamma": ("name_exact", 1), "Alph Bet Gam": ("name_abbrev", 1), "Delt Eps Zet": ("ambiguous", None), "None such": ("none", None), "A.B.G.": ("name_abbrev_official", 1), None: ("none", None)}


def test_reconcile(spark):
    g = spark.createDataFrame([(1, x) for x in ("Wei Zhou", "Zhou Wei", "Li W", "吴安", "No One", "Ma Bo", "Qi Yun")] + [(2, "Wei Zhou")], "corpus_id long, name string")
    p = spark.createDataFrame([(1, x) for x in ("wei zhou", "Li Wen", "Wu An", "Ma Bo", "Bo Ma", "QiYun", "Xu")], "corpus_id long, name string")
    out, standing = linkage.reconcile(g, p)
    assert {(r["corpus_id"], r["graduate"]): r["outcome"] for r in out.collect()} == {(1, "Wei Zhou"): "contested", (1, "Zhou Wei"): "contested", (1, "Li W"): "partial_name", (1, "吴安"): "undecidable_script", (1, "No One"): "without_record", (1, "Ma Bo"): "ambiguous", (1, "Qi Yun"): "matched", (2, "Wei Zhou"): "without_record"}
    assert {r["person"]: r["standing"] for r in standing.collect()} == {"wei zhou": "in_review", "Li Wen": "in_review", "Wu An": "people_only", "Ma Bo": "in_review", "Bo Ma": "in_review", "QiYun": "claimed", "Xu": "people_only"}
    share = {r["corpus_id"]: (r["graduates"], r["without_record"], r["without_at_most"], r["share_without"]) for r in linkage.reconcile_shares(out, standing).collect()}
    assert share == {1: (7, 1, 5, None), 2: (1, 1, 1, None)}
    empty = linkage.reconcile(g.limit(0), p.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_name_candidates_against_all_pairs(spark):
    rng = random.Random(5)
    words = ("wei", "we", "zhou", "w", "z", "ei", "an", "a", "Wei", "Ān", "吴", "weizhou")
    names = sorted({rng.choice((" ", "-", " ")).join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(260)})
    df = spark.createDataFrame([(1, x) for x in names], "corpus_id long, name string")
    got = {(r["left"], r["right"]): r["level"] for r in linkage.name_candidates(df, df).collect()}
    told = linkage.with_parts(linkage.with_parts(df.withColumnRenamed("name", "x"), "x", "a").crossJoin(df.select(F.col("name").alias("y"))), "y", "b")
    common = F.exists("a_tokens", lambda t: (F.length(t) > 1) & F.array_contains("b_tokens", t)) | F.arrays_overlap("a_forms", "b_forms") | (F.col("a_han") != "") & (F.col("a_han") == F.col("b_han"))
    plain = told.filter(common).withColumn("plain", S.name_level(F.col("x"), F.col("y")))
    all_ = linkage.with_level(plain, "a", "b", "x", "y", "plain").withColumnRenamed("level", "by_parts").collect()
    assert all(r["plain"] == r["by_parts"] for r in all_)
    assert got == {(r["x"], r["y"]): r["plain"] for r in all_ if r["plain"] not in (None, "undecidable_script")}
    assert {"exact", "name_form", "partial_name"} == set(got.values())


def test_pieces_of_a_common_key(spark):
    rows = lambda n, c: spark.range(n).select(F.col("id").alias(c), F.when(F.col("id") % 20 < 18, "common").when(F.col("id") % 20 == 18, F.col("id").cast("string")).alias("d"), (F.col("id") % 2).alias("idx"))
    left, right = rows(1700, "left"), rows(2900, "right")
    j = linkage.joined_in_pieces(left, right, ["d", "idx"]).withColumn("piece", F.spark_partition_id())
    assert j.select("left", "right").distinct().count() == j.count() == left.join(right, ["d", "idx"]).count()
    assert len({r["piece"] for r in j.filter("d = 'common'").select("piece").distinct().collect()}) > 2


def test_common_surname_is_not_all_pairs(spark):
    given = lambda i: "".join("bdfghjklm"[int(c)] + "a" for c in f"{i:04d}")
    g = spark.range(6000).select(F.lit(1).cast("long").alias("corpus_id"), F.concat(F.lit("Wei "), F.conv(F.col("id") * 7, 10, 25)).alias("name")).withColumn("name", F.translate("name", "0123456789", "qrstuvwxyz"))
    p = spark.createDataFrame([(1, "Wei " + given(i)) for i in range(6000) if "9" not in str(i)] + [(1, "Wei Q")], "corpus_id long, name string")
    began = time.time()
    out, standing = linkage.reconcile(g.distinct(), p)
    assert out.count() == g.distinct().count() and standing.count() == p.count()
    share = linkage.reconcile_shares(out, standing).collect()[0]
    assert share["graduates"] == g.distinct().count() and share["people_only"] <= p.count()
    assert time.time() - began < 60


def test_keys_of_names_are_made_once_and_meet_by_number(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(linkage, "materialise", lambda df, tag: plans.setdefault(tag, df))
    df = spark.createDataFrame([(1, "Wei Zhou"), (1, "Zhou W"), (2, "Zhou Wei"), (2, "Wei"), (2, "Wei Zhou Min"), (3, "Wei Zhou")], "corpus_id long, name string")
    got = {(r["corpus_id"], r["left"], r["right"]): r["level"] for r in linkage.name_candidates(df.filter("corpus_id < 3"), df).collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == 1 and k[1] != k[2]} == {("Wei Zhou", "Zhou W"): "partial_name", ("Zhou W", "Wei Zhou"): "partial_name"}
    assert len(got) == 13 and {k[0] for k in got} == {1, 2}
    steps = plans["names"]._jdf.queryExecution().optimizedPlan().toString().split("\n")
    made = [x for x in steps if "Generate" in x or "Filter" in x]
    assert made and not any("lambdafunction" in x for x in made)  # else all keys of a name are worked out twice, and without generated code
    assert all("xxhash64" in x for x in steps if "AS k#" in x)


def test_standing_meets_people_once(spark):
    of = lambda *names: spark.createDataFrame([(1, x) for x in names], "corpus_id long, name string")
    # Li Wen is claimed and named by a graduate in review as well
    _, standing = linkage.reconcile(of("Li Wen", "Li W", "Ma Bo"), of("Li Wen", "Ma Bo", "Bo Ma", "Xu"))
    assert {r["person"]: r["standing"] for r in standing.collect()} == {"Li Wen": "claimed", "Ma Bo": "in_review", "Bo Ma": "in_review", "Xu": "people_only"}
    assert standing._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_merge_and_diff(spark):
    keyed = "corpus_id long, record_id long, keys array<string>"
    a = spark.createDataFrame([(1, 1, ["d:x"]), (1, 2, ["p:1"]), (1, 3, [])], keyed)
    b = spark.createDataFrame([(1, 11, ["d:x", "p:1"]), (1, 12, ["d:z"]), (1, 13, []), (1, 14, ["p:9", "t:a|1"]), (1, 15, ["d:y", "t:a|1"]), (1, 16, ["d:y"]), (1, 17, ["d:q", "p:1"]), (1, 18, ["d:q"]), (2, 19, ["d:x"])], keyed)
    got = {r["record_id"]: (r["entity"], r["in_first"], r["outcome"], r["kind"]) for r in linkage.merge_harvests(a, b).collect()}
    # 11 goes by its DOI although its PMID is another record's; 14 to 16 are one paper of the second harvest; 18 reaches record 2 only by a DOI that 17 brings
    assert got == {11: (1, True, "cross", "doi"), 12: (12, False, "new", None), 13: (13, False, "new", None), 14: (14, False, "new", None), 15: (14, False, "internal", "doi"), 16: (14, False, "internal", "doi"), 17: (2, True, "cross", "pmid"), 18: (1, True, "internal", "doi"), 19: (19, False, "new", None)}
    counts = {r["corpus_id"]: r for r in linkage.merge_counts(a, linkage.merge_harvests(a, b)).collect()}
    assert (counts[1]["first_total"], counts[1]["second_total"], counts[1]["both_sources"], counts[1]["merged_total"], counts[1]["first_only"], counts[1]["cross_doi"], counts[1]["cross_pmid"], counts[1]["internal_doi"]) == (3, 8, 2, 6, 1, 1, 1, 3)
    assert linkage.merge_harvests(a, b.limit(0)).count() == 0 and linkage.merge_harvests(a.limit(0), b).filter("outcome = 'cross'").count() == 0
    full = "corpus_id long, record_id long, doi string, work_id string, author_ids array<string>, source string"
    fa = spark.createDataFrame([(1, 1, None, "", ["A1"], "a"), (1, 2, "10.1/b", None, None, "a"), (1, 3, None, None, None, "a")], full)
    fb = spark.createDataFrame([(1, 11, "10.1/x", "W1", ["A2", "A1"], "b"), (1, 12, "10.1/z", "W2", [], "b")], full)
    merged = linkage.merge_harvests(a, b.filter("record_id < 13 and corpus_id = 1"))
    folded = {(r["entity"], r["in_first"]): (r["doi"], r["work_id"], r["author_ids"], r["confirmed_by"]) for r in linkage.fold_harvests(fa, fb, merged).collect()}
    assert folded == {(1, True): ("10.1/x", "W1", ["A1", "A2"], ["a", "b"]), (2, True): ("10.1/b", None, [], ["a"]), (3, True): (None, None, [], ["a"]), (12, False): ("10.1/z", "W2", [], ["b"])}
    assert {(r["record_id"], r["status"]) for r in diff.rows(a, b.filter("record_id < 14")).collect()} == {(3, "unkeyable_old"), (12, "only_new"), (13, "unkeyable_new")}


def test_roles(spark):
    cells = "record_id long, idx int, n long, last string, fore string, initials string, orcid string, email string, affiliation string, is_corresponding boolean"
    rows = [
        (1, 0, 3, "Wei", "Zhou", "Z", "", "", "Hospital A", None), (1, 1, 3, "Wei", "Zhou", "Z", "0-1", "", "", True), (1, 2, 3, "Li", "A", "A", "", "", "", None),  # an earlier entry's affiliation goes before a later ORCID
        (2, 0, 3, "Li", "A", "A", "", "", "", None), (2, 1, 3, "Wei", "Zhou", "Z", "0-1", "", "", None), (2, 2, 3, "Xu", "A", "A", "", "", "", None),  # in the middle
        (3, 0, 1, "Wei", "Zhou", "Z", None, None, None, False), (4, 0, 2, "Wei", "Z", "Z", "", "a@mail.x.org", "", True), (4, 1, 2, "Li", "A", "A", "", "", "", None),
    ]
    df = spark.createDataFrame(rows, cells)
    who = roles.Identity("Wei Zhou", "0-1", ["x.org"], ["hospital"])
    got = {r["record_id"]: (r["kept"], r["roles"], r["evidence"], r["idx"]) for r in roles.role_filter(df, who).collect()}
    assert got == {1: (True, "first", "affiliation", 0), 3: (False, "first / last", None, 0), 4: (True, "first / corresponding", "email", 0)}
    who.require_affiliation = False
    loose = roles.role_filter(df, who)
    assert {r["record_id"]: r["evidence"] for r in loose.collect()} == {1: "affiliation", 3: "name_only", 4: "email"}
    total = spark.createDataFrame([(i, 7) for i in range(1, 5)], "record_id long, corpus_id long")
    assert [tuple(r) for r in roles.search_counts(loose, total).collect()] == [(7, 4, 2, 1, 0, 1)]
    marks = spark.createDataFrame([("first / last [affiliation]",), ("name_only",), ("fallback",), ("",), (None,)], "m string")
    assert [tuple(r) for r in marks.coalesce(1).select(roles.tier_of(F.col("m")), roles.is_name_only(F.col("m"))).collect()] == [("affiliation", False), (None, True), (None, True), (None, False), (None, False)]
    ids = spark.createDataFrame([(["https://x/A2", None, "x"], ["A1", "A2"]), (None, None)], "a array<string>, b array<string>")
    assert [r[0] for r in ids.coalesce(1).select(roles.record_author_ids(F.col("a"), F.col("b"))).collect()] == [["A1", "A2"], []]


def test_target_by_window_and_by_aggregate(spark):
    rnd = random.Random(14)
    rows = [(r, i, rnd.choice([None, 0, 1, 2, 2, 4])) for r in range(80) for i in range(rnd.randrange(1, 6))]
    e = spark.createDataFrame(rows, "record_id long, idx long, ev int")
    want = {}
    for r, i, v in rows:
        if v and v > want.get(r, (0, 0))[0]:
            want[r] = v, i
    got = {r["record_id"]: r for r in corpus.resolve_target(e, F.col("ev")).collect()}
    assert {r: (x["pi_evidence"], x["pi_index"]) for r, x in got.items()} == want
    assert all(x["pi_ambiguous"] == (sum(a == r and v == want[r][0] for a, _, v in rows) > 1) for r, x in got.items())
    assert {r["record_id"]: r["pi_index"] for r in corpus.mark_target(e, F.col("ev")).collect()} == {r: want[r][1] if r in want else None for r, _, _ in rows}


def test_places_in_order(spark):
    rnd = random.Random(13)
    ids = rnd.sample(range(5000), 600)
    rows = [(rnd.choice(["a", "a", "b", None]), i) for i in ids]
    got = {(r["k"], r["i"]): r["at"] for r in corpus.numbered(spark.createDataFrame(rows, "k string, i long"), ["k"], "i", "at", width=50).collect()}
    for k in ("a", "b", None):
        assert [got[k, i] for i in sorted(i for x, i in rows if x == k)] == list(range(sum(x == k for x, _ in rows)))


def test_ranks(spark):
    rows = [(1, p, v) for p, v in enumerate([5, 5, 5, 2, 9, None])] + [(2, 0, 1)]
    got = {(r["corpus_id"], r["person"]): (r["rank"], r["tied"]) for r in people.rank(spark.createDataFrame(rows, "corpus_id long, person long, x long"), F.col("x")).collect()}
    assert got == {(1, 4): (1, False), (1, 0): (2, True), (1, 1): (2, True), (1, 2): (2, True), (1, 3): (5, False), (1, 5): (6, False), (2, 0): (1, False)}


def test_author_search(spark):
    rows = [("w", "w1", "I2", "t", 2001), ("w", "w1", "I1", "t", 2000), ("w", "w1", "", "u", 2002), ("v", "v1", None, None, None), ("v", "v2", "I", "t", 1)]
    df = spark.createDataFrame(rows, "name string, person string, institution string, topic string, year int")
    c = roles.author_candidates(df, F.col("name"))
    assert {r["person"]: (r["institutions"], r["topics"], r["resolution"]) for r in c.collect()} == {"w1": (["I1", "I2"], ["t", "u"], "unique"), "v1": (None, None, "ambiguous"), "v2": (["I"], ["t"], "ambiguous")}
    s = spark.createDataFrame([("w", False), ("v", False), ("x", False), ("y", True)], "searched string, failed boolean")
    assert {r["searched"]: (r["resolution"], r["person"]) for r in roles.resolutions(s, c, F.col("failed")).collect()} == {"w": ("unique", "w1"), "v": ("ambiguous", None), "x": ("none", None), "y": ("error", None)}


def test_gates(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (2, 3)], "corpus_id long, n int")
    assert {r["corpus_id"]: r["gate"] for r in quality.gates(spark.createDataFrame([(1, 3, 3), (2, 2, 1), (3, 1, 0), (4, 1, 2)], "corpus_id long, fetched long, verified long"), df, F.col("n")).collect()} == {1: "no_structured_authors", 2: None, 3: "empty_corpus", 4: "inconsistent_counts"}
    reach = spark.createDataFrame([(1, 5, 0, 0), (2, 5, 5, 5)], "corpus_id long, total long, reached long, strongly_reached long")
    assert {tuple(r) for r in quality.warnings(reach).collect()} == {(1, "target_not_located", "none_of_the_records"), (1, "weak_identity", "index_not_asked")}


def test_cache_at_the_cutoff(spark):
    rows = spark.createDataFrame([("a", "2024-01-10 00:00:00", 1, 1.0), ("a", "2024-01-09 23:59:59", 2, 2.0), ("b", None, 3, 3.0)], "k string, ts string, id long, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    got = {r["k"]: (r["hit"], r["id"]) for r in cache.lookup_fresh(req, rows, ["k"], "ts", "id", now, 10).collect()}
    assert got == {"a": (True, 1), "b": (False, None), "c": (False, None)}
    assert not any(r["hit"] for r in cache.lookup_fresh(req, rows, ["k"], "ts", "id", now, 0).collect())
    assert cache.upsert(rows, rows.withColumn("id", F.col("id") + 10), ["k"], "ts", "id").filter("k = 'a'").first()["id"] == 11
