import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibloom.llm import canonical, copies, groups, matching, mixture


def _components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[find(u)] = find(v)
    out = defaultdict(set)
    for x in list(parent):
        out[find(x)].add(x)
    return {(x, min(c)) for c in out.values() for x in c}


@pytest.mark.parametrize("depth", [0.3, 8])
def test_groups_against_union_find(spark, monkeypatch, depth):
    monkeypatch.setattr(groups, "DEPTH", depth)
    rnd = random.Random(1)
    star = [(0, i) for i in range(1, 200)] + [(i, 400 + i) for i in range(1, 60)]
    chain = [(1000 + i, 1001 + i) for i in range(60)]
    small = [(2000 + 3 * i, 2001 + 3 * i) for i in range(50)] + [(2001 + 3 * i, 2002 + 3 * i) for i in range(25)]
    for edges in (star + chain + small, chain, [(5, 5), (6, 7), (7, 6), (6, 7)], [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)]):
        df = spark.createDataFrame(edges, "u long, v long").withColumn("label", F.lit("x"))
        assert {(r["u"], r["label"]) for r in groups.group_links(df).collect()} == _components(edges)
    assert groups.group_links(spark.createDataFrame([], "u long, v long")).count() == 0


def test_row_groups(spark):
    rows = [(1, "a", None), (2, "a", "x"), (3, None, "x"), (4, "b", None), (5, None, None), (6, "c", "c"), (7, "d", None), (8, "d", None)]
    df = spark.createDataFrame(rows, "row_id long, k string, v string")
    got = {tuple(r) for r in groups.row_groups(df, "row_id", [F.concat(F.lit("k"), "k"), F.concat(F.lit("v"), "v")]).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (7, 7), (7, 8)}
    assert groups.row_groups(df.limit(0), "row_id", [F.col("k")]).count() == 0


TITLES = ["Ａ研究（一）", "a 研 究 一", "研究：A一", "Effect of music on sleep in Yuba / 音乐对睡眠的影响", "音乐对睡眠的影响｜EFFECT OF MUSIC ON SLEEP IN YUBA", "音乐对睡眠的影响", "", " ", "。。", None, "é", "é", "Ⅱ型", "II型", "ß", "SS", "𠀀", "𠀀。"]


def _form(t):
    cut = copies.form_cut(t)
    return "".join(c for c in unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t[cut:] + t[:cut]).casefold()) if c.isalnum())


def test_copies_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(TITLES), rnd.choice([2000, 2001, None])) for i in range(300)] + [(500, "长" * 50_000, 2000), (501, " ".join("长" * 50_000), 2000)]
    df = spark.createDataFrame(rows, "rec_id long, title string, pub_year int").withColumn("group_id", F.lit("clash"))
    by = defaultdict(list)
    for i, t, y in rows:
        if t and y and _form(t):
            by[y, _form(t)].append(i)
    want = {(min(v), i) for v in by.values() if len(v) > 1 for i in v}
    assert {tuple(r) for r in copies.found(df).collect()} == want
    kept = copies.collapsed(df)
    assert kept.count() == len(rows) - len(want) + len({g for g, _ in want}) and kept.agg(F.sum("n_copies")).first()[0] == len(rows)
    assert copies.found(df.limit(0)).count() == 0


def test_forms():
    assert copies.same_form("A-b, c", "ａ ｂ　Ｃ") and not copies.same_form("ab", "abc") and not copies.same_form("abc", "ab")
    assert copies.form_cut("IL-6 与焦虑的关系；A 组") == 0


def test_regroup_of_colliding_rows(spark):
    df = spark.createDataFrame([(1, "ab", 2000), (2, "A b", 2000), (3, "cd", 2000)], "rec_id long, title string, pub_year int")
    odd = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert {tuple(r) for r in copies._regroup(df, odd, "rec_id", "title", "pub_year").collect()} == {(1, 1), (1, 2)}


REF = [(1, "journal", "新编杏涧材料论坛", "Xingjian New Forum of Materials", "Xingjian New Forum Mater"), (2, "journal", "新编杏涧材料论坛（英文版）", "Xingjian New Forum of Materials English Edition", None), (9, "source_db", "其他", "Other", "OTH"), (3, "source_db", "文汇库", "Wenhui Archive", "WHA")]


def test_canonical_values(spark):
    cases = {
        "新编杏涧材料论坛": None, " 新编杏涧材料论坛": 1, "《新编杏涧村料论坛》": 1, "新编杏涧材料论壇, 2015, 31(1)": 1, "新编杏涧材料论坛 2010年第7期": 1, "新编杏涧材料论坛（英文版）": None, "新编杏涧材料论坛(英文版);": 2,
        "新编杏涧材料论坛（电子版）": 0, "XINGJIAN NEW FORUM MATER": 1, "The Xingjian New Forum of Materials": 1, "新编杏涧材料论坛 = Xingjian New Forum of Materials": 1, "当代石陇营养研究与实践": 0, "某省年鉴": 0, "--": 0, "杏": 0,
        "x" * 5000: 0,
    }
    dbs = {"文汇库": None, "其它": 9, "其他（见备注）": 9, "来自文汇库": 3, "中国文汇库": 3, "文汇库导出": 3, "W.H.A": 3, "ＷＨＡ": 3, "文汇文库": 3, "导师提供": 0, "其中": 0}
    rows = [(i, j, None) for i, j in enumerate(cases)] + [(100 + i, None, d) for i, d in enumerate(dbs)] + [(200, "", "  "), (201, None, None)]
    df = spark.createDataFrame(rows, "rec_id long, journal string, source_db string").withColumn("value", F.lit(1)).withColumn("ref_id", F.lit(1))
    ref = spark.createDataFrame(REF, "ref_id long, field_name string, canonical string, english_name string, abbreviation string")
    got = {(r["field_name"], r["rec_id"]): r["ref_id"] for r in canonical.canonical_values(df, ref).collect()}
    want = {("journal", i): w for i, w in enumerate(cases.values()) if w is not None} | {("source_db", 100 + i): w for i, w in enumerate(dbs.values()) if w is not None}
    assert got == want
    none = canonical.canonical_values(df, ref.limit(0))
    assert none.count() == len(cases) + len(dbs) and none.filter("ref_id <> 0").count() == 0
    assert canonical.canonical_values(df.limit(0), ref).count() == 0


def test_similarity_join_against_all_pairs(spark):
    rnd = random.Random(6)
    name = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randrange(3, 9)))
    left, right = {name() for _ in range(60)}, {name() for _ in range(60)}
    table = lambda s: spark.createDataFrame([("f", x, canonical.tokens(x)) for x in s], "field string, name string, tokens array<string>")
    for t in (0.3, 0.6):
        got = {(r["name"], r["entry"]) for r in canonical.similarity_join(table(left), table(right), t).collect()}
        j = lambda a, b: len(a & b) / len(a | b)
        assert got == {(a, b) for a in left for b in right if j(set(canonical.tokens(a)), set(canonical.tokens(b))) >= t}


def test_assignment_is_optimal():
    import itertools

    rnd = random.Random(8)
    for _ in range(60):
        n, m = rnd.randrange(1, 5), rnd.randrange(1, 5)
        w = {(i, 10 + j): rnd.random() for i in range(n) for j in range(m) if rnd.random() < 0.7}
        best = 0.0
        for k in range(min(n, m) + 1):
            for a in itertools.permutations(range(n), k):
                for b in itertools.combinations(range(m), k):
                    pairs = [(i, 10 + j) for i, j in zip(a, b, strict=True)]
                    if all(p in w for p in pairs):
                        best = max(best, sum(w[p] for p in pairs))
        got = matching._assign([(a, b, x) for (a, b), x in w.items()]) if w else []
        assert len({g[0] for g in got}) == len(got) == len({g[1] for g in got}) and abs(sum(g[2] for g in got) - best) < 1e-9


def test_one_to_one(spark):
    rnd = random.Random(9)
    rows = [(i, i, 0.8) for i in range(20)] + [(100, 200 + i, 0.7 + i / 1000) for i in range(90)] + [(300, 300, 0.8), (300, 301, 0.9), (301, 301, 0.85)]
    rnd.shuffle(rows)
    got = {(r["left"], r["right"]) for r in matching.one_to_one(spark.createDataFrame(rows, "left long, right long, confidence double")).collect()}
    assert got == {(i, i) for i in range(20)} | {(100, 289), (300, 300), (301, 301)} or got == {(i, i) for i in range(20)} | {(100, 289), (300, 301)}
    assert {(300, 300), (301, 301)} <= got


R = "rec_id long, title string, authors_pinyin_raw string, pub_year int, doi string, volume string, issue string, pages string, id string"
W = "work_id long, title string, authors_str string, publication_year int, doi string, volume string, issue string, first_page string, side string"


def test_matching(spark):
    t1, t2 = "基于624例样本的鹤浦早产儿视力进展研究", "沐墩地区321例护理人员针刺干预对听力阈值的影响"
    records = [
        (1, t1, "Shen Ruoyan; Qian Lin", 2017, "10.99006/k2017.001026291", "36", "9", "338-342", "x"), (2, " " + t1, "Shen Ruoyan; Qian Lin", 2017, None, "36", "9", "338-342", "x"),
        (3, t2, "You Gui", 2003, "10.99999/none", "25", "2", "374-383", "x"), (4, None, None, None, None, None, None, None, "x"), (5, "", "", 2003, "", "", "", "", "x"), (6, t2 + "（下）", "You Gui", 2003, None, "25", "3", "400-410", "x"),
    ]
    works = [
        (11, t1[:14] + "…", "R Shen; L Qian", 2017, "doi:10.99006/K2017.001026291", None, None, None, "x"), (12, "Visual progression in 624 preterm infants of Hepu", "Ruoyan Shen; Lin Qian", 2017, None, "36", "9", "338", "x"),
        (13, "更正：" + t1, "Shen Ruoyan; Qian Lin", 2018, "10.99006/k2017.001026291.e1", "36", "10", "20", "x"), (14, t2, "You Gui", 2003, None, "25", "2", "374", "x"), (15, t2, "You Gui", 2006, None, "28", "2", "11", "x"),
        (16, None, None, None, None, None, None, None, "x"), (17, t2 + "（下）", "You Gui", 2003, None, "25", "3", "400", "x"),
    ]
    r, w = spark.createDataFrame(records, R), spark.createDataFrame(works, W)
    got = {(x["rec_id"], x["work_id"]) for x in matching.found(r, w).collect()}
    assert got == {(1, 11), (1, 12), (2, 11), (2, 12), (3, 14), (6, 17)}
    assert all(0.7 <= x["confidence"] <= 1 for x in matching.match(r, w).collect())
    assert matching.found(r.limit(0), w).count() == 0 and matching.found(r, w.limit(0)).count() == 0


def test_aims():
    aim = mixture.aims({"a": 1000.0, "b": 100.0, "c": 500.0}, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.1}, {"a": 1, "b": 2, "c": 1, "d": 5})
    assert abs(aim["b"] - 200) < 1e-6 and abs(aim["a"] - 200 * 5 / 3) < 1e-6 and aim["d"] == 0
    capped = mixture.aims({"a": 1000.0, "b": 100.0}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, total=800)
    assert capped == {"a": 600.0, "b": 200.0}
    assert mixture.aims({}, {"a": 1.0}, {"a": 1}) == {"a": 0.0}


CELLS = [(s, g, t, 10.0 * (i + 1)) for i, (s, g, t) in enumerate((s, g, t) for s in "ab" for g in ("zh", "en") for t in ("one", "two", None))]


def _plain_raking(cells, want, rounds=2000):
    """Proportional fitting cell by cell, without ceilings."""
    w = {c[:3]: 1.0 for c in cells}
    for _ in range(rounds):
        for axis in (2, 1, 0):
            have = defaultdict(float)
            for *c, size in cells:
                have[c[axis]] += w[tuple(c)] * size
            w = {c: x * want[axis].get(c[axis], 0.0) / have[c[axis]] for c, x in w.items()}
    return w


def test_raking_against_plain_fitting(spark):
    df = spark.createDataFrame(CELLS, "source string, lang string, topic string, size double")
    want = [{"a": 60.0, "b": 120.0}, {"zh": 90.0, "en": 90.0}, {"one": 45.0, "two": 90.0, None: 45.0}]
    fit = mixture.rake(df, want[0], {"a": 9, "b": 9}, {"zh": 1, "en": 1}, {"one": 0.25, "two": 0.5, None: 0.25})
    got = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in fit.weights.collect()}
    plain = _plain_raking(CELLS, want)
    assert max(fit.errors.values()) < 1e-6 and all(abs(got[c] - plain[c]) < 1e-4 for c in plain)
    capped = mixture.rake(df, want[0], {"a": 2, "b": 1}, {"zh": 0.5, "en": 0.5})
    weights = capped.weights.collect()
    assert max(r["weight"] for r in weights if r["source"] == "b") <= 1 + 1e-6 and max(r["weight"] for r in weights if r["source"] == "a") <= 2 + 1e-6
    size = {c[:3]: c[3] for c in CELLS}
    for s, aim in want[0].items():
        assert abs(sum(r["weight"] * size[r["source"], r["lang"], r["topic"]] for r in weights if r["source"] == s) - aim) < 1e-4
    with pytest.raises(ValueError):
        mixture.rake(df, want[0], {"a": 9, "b": 9}, {"zh": 0.5, "fr": 0.5})
    with pytest.raises(ValueError):
        mixture.rake(df, want[0], {"a": 1, "b": 1}, None, {"one": 1.0})


def test_mixture(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "zh" if i % 2 else None, f"label {i % 90}", "word " * (1 + i % 7) if i % 11 else None, i) for i in range(3000)] + [(9000, None, "en", "x", "word", 1), (9001, "x", "en", "x", "word", 1)], "doc_id long, source string, lang string, corpus_label string, text string, copies int")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.5, 3), ("c", 0.1, 5)], "source string, target_share double, max_repeats int")
    mixed, fit = mixture.fitted(docs, targets)
    got = {r["source"]: r for r in mixture.shares(mixed, targets).collect()}
    assert abs(got["a"]["share"] - 4 / 9) < 0.01 and abs(got["b"]["share"] - 5 / 9) < 0.01 and got["c"]["share"] == 0
    assert got["a"]["most_copies"] == 1 and got["b"]["most_copies"] <= 3 and mixed.filter("source = 'x'").count() == 0
    by = mixture.marginals(mixed, fit).collect()
    assert {r["name"] for r in by if r["marginal"] == "topic"} == {f"label {i}" for i in range(90)} and {r["name"] for r in by if r["marginal"] == "lang"} == {"zh", None}
    assert all(abs(r["share"] - r["target_share"]) < 0.05 for r in by)
    # shares by label are met for the labels as they are spelled
    few, fit = mixture.fitted(docs, targets, total_tokens=150, topic_shares={"label 5": 4, "label 6": 5})
    assert few.select("topic").distinct().count() == 2 and max(fit.errors.values()) < 1e-6 and fit.langs is None
    assert mixture.mixture(docs.limit(0), targets).count() == 0


def _featured(spark, records, works):
    return matching.materialise(matching.entries(spark.createDataFrame(records, R), spark.createDataFrame(works, W)).mapInArrow(matching._featured, matching._FEATURES))


def _pairs(e):
    """Candidates of a record and a work, as rec_id and work_id."""
    ids = ((min(x["a"], x["b"], key=lambda i: i % 2), max(x["a"], x["b"], key=lambda i: i % 2)) for x in matching.candidates(e).collect())
    return {(a // 2, b // 2) for a, b in ids if a % 2 == 0 and b % 2 == 1}


def test_titles_of_one_series_are_sorted_as_a_whole(spark):
    rnd = random.Random(11)
    tails = ["".join(rnd.choice("杏涧材料石陇营养研究与实践鹤浦视力进展护理听阈") for _ in range(12)) for _ in range(300)]
    head = "沐墩地区农业生态环境综合治理与可持续发展战略系列调查报告第二辑分册专题文集"
    late = "heavymetalsinthesoilsofthelowerreachesoftherivermudunafterthirtyyearsofirrigation"
    records = [(i, head + t, "Shen Ruoyan", 1980 + i % 30, None, None, None, None, "x") for i, t in enumerate(tails)] + [(1000 + i, late + t.encode().hex(), "Shen Ruoyan", 1980 + i % 30, None, None, None, None, "x") for i, t in enumerate(tails)]
    works = [(i, head + t[:-1] + "末", "Shen Ruoyan", None, None, None, None, None, "x") for i, t in enumerate(tails)] + [(1000 + i, late + t.encode().hex()[:-3], "Shen Ruoyan", None, None, None, None, None, "x") for i, t in enumerate(tails)]
    assert {(r[0], r[0]) for r in records} <= _pairs(_featured(spark, records, works))


def test_equal_titles_are_sorted_by_year_and_author(spark):
    people = ["Shen Ruoyan", "Qian Lin", "You Gui", "Bao Wen", "Xu Dan"]
    rows = [(i, "音乐对睡眠的影响", people[i % 5], 1960 + i // 5, None, None, None, None, "x") for i in range(300)]
    works = [(i, t, who + "; Li Na", year, *rest) for i, t, who, year, *rest in rows]
    assert {(i, i) for i in range(300)} <= _pairs(_featured(spark, rows, works))


def test_bounds_of_confidence_hold():
    """No pair of descriptions gets a confidence above the bound that decides whether the window keeps it."""
    rnd = random.Random(12)
    titles = ["基于624例样本的鹤浦早产儿视力进展研究", "基于624例样本的鹤浦早产儿视力进展分析", "基于625例样本的鹤浦早产儿视力进展研究（下）", "Visual progression in 624 preterm infants", "Visual progression in 624 preterm infant…", "更正：基于624例样本的鹤浦早产儿视力进展研究", "基于624例样本的鹤浦早产儿视力进展研究 / Visual progression in 624 preterm infants", None]
    people = ["Shen Ruoyan; Qian Lin", "R Shen; L Qian", "Shen Ruoyan et al.", "Qian Lin; Shen Ruoyan; Bao Wen; Xu Dan; You Gui", "You Gui", None]
    rows = []
    for _ in range(250):
        cells = [rnd.choice([None, "36", "37"]), rnd.choice([None, "9", "2"]), rnd.choice([None, "338", "12"])]
        rows.append((rnd.choice(titles), rnd.choice(people), rnd.choice([None, 2016, 2017, 2021]), cells, rnd.choice([None, "10.1/a123", "10.1/b123"])))
    f = [matching.features(t, p) for t, p, *_ in rows]
    cell = lambda i: [r[3][i] for r in rows]
    compact = matching._compact(f, [r[2] for r in rows], volume=cell(0), issue=cell(1), page=cell(2), doi=[r[4] for r in rows], numbers=[",".join(x.numbers) for x in f], sequel=[x.sequel for x in f])
    i, j = np.triu_indices(len(rows), 1)
    both = compact["flags"][i] & compact["flags"][j] & (matching._ZH | matching._EN)
    bound = matching.bounds(compact[i], compact[j], np.ones(len(i)), both > 0)
    true = np.array([matching.confidence(f[a], rows[a][2], tuple(rows[a][3]), rows[a][4], f[b], rows[b][2], tuple(rows[b][3]), rows[b][4]) for a, b in zip(i, j, strict=True)])
    assert (true <= bound + 1e-9).all() and (true > 0).sum() > 100
    n = compact["pairs_zh"].astype(np.int32)
    for bits in (matching._pair_bits([x.zh for x in f]), matching._pair_bits([x.zh for x in f], 64)):
        most = matching._most_alike(bits[i], bits[j], n[i], n[j])
        assert all(matching.text_similarity(f[a].zh, f[b].zh) <= m + 1e-9 for a, b, m in zip(i.tolist(), j.tolist(), most.tolist(), strict=True) if f[a].zh and f[b].zh)


def test_papers_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(matching, "CELL", 7)
    member = spark.createDataFrame([(2 * i, 5) for i in range(40)] + [(2 * i + 1, 5) for i in range(23)] + [(200, 200), (201, 201), (301, 301)], "id long, entity long")
    papers = spark.createDataFrame([(5, 5, 0.9), (200, 201, 0.8)], "left long, right long, confidence double")
    got = matching._expanded(matching.materialise(member), papers).collect()
    assert len(got) == 40 * 23 + 1 and {(r["rec_id"], r["work_id"]) for r in got} == {(i, j) for i in range(40) for j in range(23)} | {(100, 100)}


def test_large_conflict_gets_the_greatest_total(spark):
    # a-x 0.84, a-y 0.83, b-x 0.83: both pairs of 0.83 are worth more; all in one component, tied by y and the next x
    rows = [r for k in range(100) for r in ((2 * k, 2 * k, 0.84), (2 * k, 2 * k + 1, 0.83), (2 * k + 1, 2 * k, 0.83), (2 * k + 1, 2 * k + 2, 0.70))]
    got = {(r["left"], r["right"]): r["confidence"] for r in matching.one_to_one(spark.createDataFrame(rows, "left long, right long, confidence double")).collect()}
    assert set(got) == {p for k in range(100) for p in ((2 * k, 2 * k + 1), (2 * k + 1, 2 * k))}


def test_assignment_against_a_dense_solver():
    rnd = random.Random(10)
    for n, m, ties in ((40, 40, 3), (60, 35, 16), (35, 60, 1), (50, 50, 1000)):
        w = {(i, j): 0.7 + 0.15 * rnd.randrange(ties + 1) / ties for i in range(n) for j in rnd.sample(range(m), 6)}
        got = matching._assign([(i, j, x) for (i, j), x in w.items()])
        assert len({g[0] for g in got}) == len(got) == len({g[1] for g in got}) and all(w[g[:2]] == g[2] for g in got)
        assert abs(sum(g[2] for g in got) - _dense(n, m, w)) < 1e-9


def _dense(n, m, w):
    """Greatest total by Bellman-Ford over the residual graph, one augmentation after the other."""
    taken, total = {}, 0.0
    while True:
        gain = {("l", i): 0.0 for i in range(n) if i not in taken.values()}
        come = dict.fromkeys(gain)
        changed = True
        while changed:
            changed = False
            for (i, j), x in w.items():
                steps = [(("r", j), ("l", i), -x)] if taken.get(j) == i else [(("l", i), ("r", j), x)]
                for a, b, g in steps:
                    if a in gain and gain[a] + g > gain.get(b, -9e9) + 1e-12:
                        gain[b], come[b], changed = gain[a] + g, a, True
        ends = [(g, k) for k, g in gain.items() if k[0] == "r" and k[1] not in taken]
        if not ends or max(ends)[0] <= 1e-12:
            return total
        g, k = max(ends)
        total += g
        while k is not None:
            before = come[k]
            if k[0] == "r":
                taken[k[1]] = before[1]
            k = before


def test_a_run_over_many_partitions_takes_one_place(spark):
    early, hot, late = "沐墩地区农业生态由", "沐墩地区农业生态甲", "沐墩地区农业生态电"
    same = "10.99006/k2017.001026291"
    rows = [(0, early, "Shen Ruoyan; Qian Lin", 2000, same, None, None, None, "x")] + [(i, hot, "You Gui", 1950, None, None, None, None, "x") for i in range(1, 4000)]
    works = [(0, late, "Shen Ruoyan; Bao Wen", None, same, "3", "4", "5", "x")]
    assert early < hot < late
    e = _featured(spark, rows, works)
    shown = matching._sort_rows(e).filter("key like '0%'").repartitionByRange(16, "key", "digest", "id").sortWithinPartitions("key", "digest", "id")
    hit = matching.materialise(shown.mapInArrow(matching._windows(False), matching._PAIR))
    edge = hit.filter("kind = 1")
    assert edge.groupBy("part", "digest").count().filter("count > 2").count() == 0
    across = edge.select("key", "digest", "id", "compact", "part").distinct().repartitionByRange(1, "key", "digest", "id").sortWithinPartitions("key", "digest", "id")
    got = {(x["a"], x["b"], x["kind"]) for x in across.mapInArrow(matching._windows(True), matching._PAIR).collect() + hit.filter("kind <> 1").collect()}
    assert (0, 1, 0) in got
    assert len({x for a, b, kind in got if kind == 2 for x in (a, b)}) == 3999
