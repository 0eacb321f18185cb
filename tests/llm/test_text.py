import random

import numpy as np
from pyspark.sql import functions as F

from bibloom.llm import chunks, leaks, mojibake, tokens

ZH = "铁路职工课堂翻转教学对焦虑水平的影响"


def test_round_trips_are_restored():
    for wrong, meant in [("latin-1", "utf-8"), ("cp1251", "gb18030"), ("latin-1", "gb18030"), ("big5", "gb18030")]:
        raw = ZH.encode(meant)
        garbled = "".join(bytes([b]).decode(wrong, "replace") if wrong != "big5" else "" for b in raw) if wrong != "big5" else raw.decode("big5", "replace")
        if wrong == "cp1251":
            table = {v: k for k, v in mojibake._reverse("cp1251").items()}
            garbled = "".join(chr(table[b]) for b in raw)
        text, affected, whole = mojibake.repair(garbled)
        assert affected
        if "�" not in garbled:
            assert text == ZH and whole, (wrong, meant, text)
    mac = ZH.encode().decode("mac_roman")
    assert mojibake.repair(mac) == (ZH, True, True)
    twice = ZH.encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.repair(twice)[0] == ZH
    deep = ZH
    for _ in range(8):
        deep = deep.encode().decode("latin-1")
    assert mojibake.repair(deep) == (ZH, True, True)
    assert mojibake.repair("前文" + ZH.encode().decode("latin-1") + "后文")[0] == "前文" + ZH + "后文"


def test_lost_text_is_affected():
    for t in ("锟斤拷锟斤拷", "abc�", "文字", "闊﹂箍鏃�*"):
        assert mojibake.repair(t)[1]


def test_right_text_is_left():
    for t in (None, "", " ", "plain", ZH, "张锟", "Ñuria Abelçant", "Łuka Grzewnik", "Håkon Ülbrist", "Jürg Pellandü", "β-胡萝卜素 Ⅱ型", "“引号”——…", "Иван Петров", "한국어", "ひらがな", "㐂䶮", "½ × 3 °C", "x" * 100_000, "中" * 100_000):
        assert mojibake.repair(t) == (t, False, False), t


def test_ideographs_that_a_corpus_uses(spark):
    """Rare ideographs of names are told from garbling by standing alone among common ones."""
    names = ["张旻", "李堃；王一", "喆明", "璟", "王旻；李四", "陈堃"] * 5 + ["张旻堃；喆璟"] * 4 + [ZH.encode("gb18030").decode("big5", "replace"), "中文编码".encode().decode("gb18030", "replace")]
    df = spark.createDataFrame([(i, None, x) for i, x in enumerate(names)], "rec_id long, title string, authors_raw string")
    assert mojibake.familiar(df, ("title", "authors_raw")) == frozenset("旻堃喆璟")
    assert {r["rec_id"] for r in mojibake.found(df).collect()} == {len(names) - 2, len(names) - 1}
    assert mojibake.familiar(df.limit(0), ("title",)) == frozenset()


def test_repair_of_tables(spark):
    df = spark.createDataFrame([(1, ZH.encode().decode("latin-1"), None, "a"), (2, ZH, "", "b"), (2, None, "�", "c")], "rec_id long, title string, authors_raw string, field_name string")
    got = mojibake.found(df)
    assert {tuple(r) for r in got.collect()} == {("title", 1), ("authors_raw", 2)}
    assert [r["title"] for r in mojibake.restore(df, "rec_id", ("title",)).orderBy("rec_id", F.desc("title")).collect()] == [ZH, ZH, None]
    assert mojibake.found(df.limit(0)).count() == 0


def _documents(rnd, n, items):
    words = ["cards", "ledger", "valley", "minutes", "panel", "slips", "archive", "draft", "clerk", "vote"]
    out = []
    for i in range(n):
        body = " ".join(rnd.choice(words) + str(rnd.randrange(40)) for _ in range(rnd.randrange(5, 120)))
        zh = "".join(rnd.choice("的一是在不了有和人这中大为上个国我以要他") for _ in range(60))
        if rnd.random() < 0.6:
            p = rnd.choice(items)[1] or ""
            a = rnd.randrange(max(1, len(p)))
            cut = p[a : a + rnd.randrange(20, 200)]
            body += rnd.choice([" ", "\n", "。"]) + rnd.choice([cut, cut.upper(), cut.replace(" ", "-\n"), "　".join(cut)])
        out.append((i, rnd.choice([body + zh, zh + body])))
    return out + [(n, None), (n + 1, ""), (n + 2, "�" * 5)]


def _brute(docs, items):
    import unicodedata

    def norm(t):
        return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())

    flat = lambda t: "".join(c for c in norm(t) if c.isalnum())
    out = set()
    for i, p, lang in items:
        if not p:
            continue
        if lang == "zh":
            f = flat(p)
            runs = {f[k : k + 30] for k in range(len(f) - 29)}
        else:
            w = "".join(c if c.isalnum() else " " for c in norm(p)).split()
            runs = {"".join(w[k : k + 16]) for k in range(len(w) - 15)}
        out |= {(d, i) for d, t in docs if t and any(r in flat(t) for r in runs)}
    return out


def test_leaks_against_brute_force(spark):
    rnd = random.Random(3)
    zh = lambda n: "".join(rnd.choice("书记员以桁垚谷命名这一差异并写了封信向洄颀索取原始签条岫沅评议会要求个实验室在截止日前交存全部手稿") for _ in range(n))
    en = lambda n: " ".join(rnd.choice(["the", "clerk", "named", "a", "slip", "Basta", "valley", "of", "cards", "7"]) for _ in range(n))
    items = [(1, zh(80), "zh"), (2, zh(31), "zh"), (3, en(60), "en"), (4, en(16), "en"), (5, en(15), "en"), (6, None, "en"), (7, "", None), (8, zh(29), "zh"), (9, zh(50) + "，" + zh(20), "zh")]
    docs = _documents(rnd, 150, items)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    t = spark.createDataFrame(items, "item_id long, passage string, lang string")
    got = {tuple(r) for r in leaks.found(d, t).collect()}
    assert got == _brute(docs, items) and got
    assert leaks.found(d.limit(0), t).count() == 0 and leaks.found(d, t.limit(0)).count() == 0


def test_alignment_against_brute_force():
    rnd = np.random.default_rng(1)
    many = [(rnd.integers(0, 3, rnd.integers(1, 12)).astype(np.uint32), rnd.integers(0, 3, rnd.integers(1, 12)).astype(np.uint32)) for _ in range(30)]
    for (a, b), score in zip(many, leaks.align([x for x, _ in many], [y for _, y in many], [-len(x) for x, _ in many], [len(y) for _, y in many]), strict=True):
        h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                s = leaks.MATCH if a[i - 1] == b[j - 1] else leaks.MISMATCH
                h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + leaks.GAP, h[i, j - 1] + leaks.GAP)
        assert score == h.max()


def test_edited_copies(spark):
    """Copies with 5 to 30 % of their characters or words changed, left out or added, among texts of the same vocabulary."""
    rnd = random.Random(7)
    han = "书记员以桁垚谷命名这一差异并写了封信向洄颀索取原始签条岫沅评议会要求个实验室在截止日前交存全部手稿天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳"
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    unit = {"zh": lambda: rnd.choice(han), "en": lambda: rnd.choice(words)}
    join = {"zh": "".join, "en": " ".join}
    passages = {i: ("zh" if i % 2 else "en", [unit["zh" if i % 2 else "en"]() for _ in range(rnd.randrange(100, 220) if i % 2 else rnd.randrange(60, 140))]) for i in range(1, 21)}

    def edited(lang, p, share):
        out = []
        for x in p:
            r = rnd.random()
            if r >= share:
                out.append(x)
            elif r < share / 3:
                out.append(unit[lang]())
            elif r < 2 * share / 3:
                out += [x, unit[lang]()]
        return out

    docs, want = [], {}
    for i, (lang, p) in passages.items():
        for share in (0.05, 0.1, 0.2, 0.3):
            text = join[lang]([unit[lang]() for _ in range(rnd.randrange(300))] + edited(lang, p, share) + [unit[lang]() for _ in range(rnd.randrange(300))])
            docs.append((len(docs), text))
            want[docs[-1][0], i] = share
        docs.append((len(docs), join[lang]([unit[lang]() for _ in range(300)] + p[: 25 if lang == "zh" else 12] + [unit[lang]() for _ in range(300)])))  # a quotation
        docs.append((len(docs), join[lang]([unit[lang]() for _ in range(700)])))
    items = spark.createDataFrame([(i, join[lang](p), lang) for i, (lang, p) in passages.items()], "item_id long, passage string, lang string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    for share in (0.05, 0.1, 0.2, 0.3):
        of = {k for k, s in want.items() if s == share}
        print(share, len(of & got) / len(of))
        assert len(of & got) >= 0.9 * len(of)
    assert len(got & set(want)) >= 0.95 * len(got)


def _check(text, most, overlap):
    c = chunks.Chunker()
    got = c.pieces(text, most, overlap)
    if got is None:
        assert tokens.count(text) <= most
        return []
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for before, (start, end, n, over, _) in zip([None, *got], got, strict=False):
        assert start < end and n == tokens.count(text[start:end])
        assert n <= most or end - start == 1
        if before:
            assert start + over == before[1] and start > before[0]
    return got


def test_pieces():
    rnd = random.Random(2)
    texts = ["x" * 3000, "中" * 3000, "a b " * 900, "😀👍🏽" * 300, "\n\n".join("One sentence here. Another follows! " * 5 for _ in range(40)), "，".join("这是一个句子" for _ in range(300)) + "。"]
    texts += ["".join(rnd.choice(["词", "ab", " ", "。", "\n", "，", "é", "7", ".", "́"]) for _ in range(2500)) for _ in range(4)]
    for t in texts:
        for most, overlap in ((64, 0), (64, 16), (10, 3), (5, 4)):
            assert _check(t, most, overlap)
    assert chunks.Chunker().pieces("short", 10, 2) is None


def test_overlaps_have_the_size_asked_for(spark):
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) + rnd.choice(["", "", ".", ","]) for _ in range(900)), "".join(rnd.choice("天地玄黄宇宙洪荒日月盈昃，。") for _ in range(2500))]
    docs = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    pieces = chunks.split(docs, spark.createDataFrame([("a", 100, 16)], "source string, max_tokens int, overlap_tokens int"))
    got = pieces.filter("piece_no > 0").select("overlap_tokens", "overlap_chars").collect()
    assert len(got) > 20 and all(r["overlap_chars"] > 0 and 14 <= r["overlap_tokens"] <= 17 for r in got), sorted(r["overlap_tokens"] for r in got)
    assert {r["doc_id"]: r["text"] for r in chunks.joined(pieces).collect()} == dict(enumerate(texts))


def test_edits_alter_only_neighbours():
    rnd = random.Random(4)
    text = "".join("".join(rnd.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张") for _ in range(rnd.randrange(8, 40))) + "。" for _ in range(400))
    cuts = lambda t: {t[a[0] : a[1]] for a in chunks.Chunker().pieces(t, 256, 0)}
    before, after = cuts(text), cuts(text[:3000] + "插入的几个字" + text[3000:])
    assert len(before - after) <= max(4, len(before) // 5)


def test_split_table(spark):
    docs = spark.createDataFrame([(1, "a", "word " * 400, 5), (2, "a", None, 5), (3, "b", "word " * 400, 5), (4, None, "word " * 400, 5), (5, "a", "", 5), (6, "a", "few words", 5)], "doc_id long, source string, text string, n_pieces int")
    limits = spark.createDataFrame([("a", 100, 10), ("a", 100, 10), ("c", 5, None)], "source string, max_tokens int, overlap_tokens int")
    got = chunks.split(docs, limits).collect()
    assert {r["doc_id"] for r in got} == {1} and all(r["n_tokens"] <= 100 for r in got)
    assert chunks.split(docs.limit(0), limits).count() == 0
