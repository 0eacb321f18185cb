import json

import pytest
from pyspark.sql import functions as F

from bibloom.sources import files, rest, schema

XML = """<Set><PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article><Journal><ISSN IssnType="Print">0317-8471</ISSN><JournalIssue><Volume>3</Volume><Issue>2</Issue><PubDate><Year>2020</Year><Month>Jun</Month></PubDate></JournalIssue><Title>J One</Title><ISOAbbreviation>J1</ISOAbbreviation></Journal>
<ArticleTitle>First</ArticleTitle><ELocationID EIdType="doi">10.1/e</ELocationID><Abstract><AbstractText Label="AIM">a</AbstractText><AbstractText>b</AbstractText></Abstract><AuthorList><Author EqualContrib="Y"><LastName>Ab</LastName><ForeName>Cd</ForeName><Initials>C</Initials><Identifier Source="ORCID">https://orcid.org/0000-0001-0002-000X</Identifier><AffiliationInfo><Affiliation>Univ X. a.b@x.org.</Affiliation></AffiliationInfo></Author><Author><CollectiveName>Team</CollectiveName></Author></AuthorList></Article><MedlineJournalInfo><ISSNLinking>0317-8471</ISSNLinking></MedlineJournalInfo></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/a</ArticleId><ArticleId IdType="pmc">PMC9</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>1998 Nov-Dec</MedlineDate></PubDate></JournalIssue><Title>J Two</Title></Journal><ArticleTitle>Second</ArticleTitle></Article></MedlineCitation></PubmedArticle></Set>"""


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    a, b = files.read_articles(spark, str(tmp_path / "a.xml")).orderBy("pmid").collect()
    assert (a["doi"], a["pmc_id"], a["pub_date"], a["pub_year"], a["issn"], a["issn_type"], a["abstract"], a["authors_str"]) == ("10.1/a", "PMC9", "2020 Jun", "2020", "0317-8471", "Print", "AIM: a b", "Ab Cd; Team")
    x, y = a["authors"]
    assert x["email"] == "a.b@x.org" and x["is_corresponding"] and x["equal_contrib"] and x["orcid"] == "0000-0001-0002-000X" and y["name"] == "Team" and y["last"] == "" and not y["is_corresponding"]
    assert b["pub_year"] == "1998" and b["authors"] == [] and b["abstract"] == "" and b["doi"] is None


def test_works(spark):
    work = {"id": "https://x/W5", "doi": "https://doi.org/10.1/AB", "title": "T", "publication_year": 2020, "cited_by_count": 3, "ids": {"pmid": "https://p/77"}, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": [{"author_position": "first", "raw_affiliation_strings": [], "author": {"id": "https://x/A12", "display_name": "Ab Cd", "orcid": None}, "institutions": [{"display_name": "U"}]}, {"author": {"display_name": "Last, Fo Re"}, "raw_affiliation_strings": ["R"]}]}
    rows = [(json.dumps(work),), (json.dumps(work),), (json.dumps({"id": "https://x/W6"}),)]
    got = files.map_works(spark.createDataFrame(rows, "j string").select(F.from_json("j", files.WORK.replace("\n", " ")).alias("w")).select("w.*")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["openalex_work_id"], r["doi"], r["pmid"], r["abstract"]) == ("W5", "10.1/ab", "77", "a b a")
    assert [(a["last"], a["fore"], a["initials"], a["affiliation"], a["openalex_author_id"]) for a in r["authors"]] == [("Cd", "Ab", "A", "U", "A12"), ("Last", "Fo Re", "FR", "R", None)]


def test_corpora(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"schema_version": 1, "counts": {"fetched": 2}, "papers": [{"pmid": "1", "authors": [{"name": "A"}], "confirmed_by": ["x", "y"], "abstract": "z" * 900}, {"pmid": "2"}]}))
    (tmp_path / "l.json").write_text(json.dumps([{"pmid": "3", "source": "s"}]))
    p = files.read_papers(spark, str(tmp_path))
    assert sorted(r["pmid"] for r in p.collect()) == ["1", "2", "3"]
    out = {r["pmid"]: r for r in files.export_rows(p).collect()}
    assert len(out["1"]["abstract"]) == 500 and out["1"]["source_label"] == "x+y" and out["3"]["source_label"] == "s"
    assert files.read_corpora(spark, str(tmp_path / "e.json")).first()["counts"]["fetched"] == 2
    assert files.latest_file(spark, str(tmp_path / "*.json")).endswith(".json")
    with pytest.raises(ValueError):
        files.read_corpora(spark, "x.XLSX")
    assert {r["no"] for r in files.export_rows(p).collect()} == {1, 2, 3} and files.export_rows(p).columns == [*files.EXPORT]
    files.write_papers(p, str(tmp_path / "out"), spark.createDataFrame([("q", 9)], "term string, esearch_count long"))
    assert spark.read.json(str(tmp_path / "out.search")).first()["esearch_count"] == 9
    assert spark.read.json(str(tmp_path / "out")).count() == 3


@pytest.mark.parametrize("encoding", ["utf-8-sig", "gb18030"])
def test_side_tables(spark, tmp_path, encoding):
    f = tmp_path / "t.csv"
    f.write_bytes("导师,学生,学位,毕业年份,来源库,导出日期,别的\n甲,乙,博士,2019,库,2025/1/2,x\n甲,乙,博士,2019,库,2025年1月2日,\n甲,,硕士,2019,库,,\n甲,丙,硕士,没,库,,\n".encode(encoding))
    df, rest = files.read_side_table(spark, str(f), "theses")
    assert rest == ["别的"] and set(df.columns) == {"advisor", "student", "degree", "graduation_year", "source_db", "export_date"}
    rows = files.side_rows(df, "theses").withColumn("d", files.parse_day(F.col("export_date")).cast("string")).collect()
    assert sorted(str(r["reject"]) for r in rows) == ["None", "None", "no_student", "no_year"] and sum(r["duplicate"] for r in rows) == 1 and {r["d"] for r in rows} == {"2025-01-02", None}


def test_headers():
    with pytest.raises(ValueError, match="lacks"):
        schema.resolve_headers(["advisor"], "theses")
    with pytest.raises(ValueError, match="two columns"):
        schema.resolve_headers(["advisor", "导师", "source", "retrieved on"], "evaluations")
    assert schema.resolve_headers(["Ad_visor", "来源", "Retrieved-On", "?"], "evaluations")[1] == ["?"]


def test_cells(spark):
    flags = spark.createDataFrame([("是",), ("NO",), ("",), (None,), ("1",)], "v string").select(files.parse_flag(F.col("v")).alias("f")).collect()
    assert [r["f"] for r in flags] == [True, False, None, None, True]
    a = spark.createDataFrame([("甲*；乙,丙＊|丁、",)], "v string").select(files.split_authors(F.col("v")).alias("a")).first()["a"]
    assert [(x["name_zh"], x["is_corresponding"]) for x in a] == [("甲", True), ("乙", False), ("丙", True), ("丁", False)]
    raw = spark.createDataFrame([("1", "a", "s1", True, "2"), ("1", "b", "s2", True, "1"), ("2", "a", "s1", False, "3")], "issn string, source string, signal string, value boolean, fetched_at string")
    got = {r["issn"]: r for r in files.journal_signals(raw).collect()}
    assert got["1"]["signals"] == ["s1", "s2"] and got["1"]["fetched_at"] == "1" and got["2"]["n_signals"] == 0


def test_rest(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"results": [{"id": i}, {"id": i}, {"id": 10 + i}]}))
    (tmp_path / "x.json").write_text("broken")
    spark.dataSource.register(rest.Replay)
    assert spark.read.format("replayed_pages").option("key", "id").load(str(tmp_path)).count() == 4
    assert rest.budget(20_000, 50_000) == (10_000, True) and rest.page_starts(250, 230) == [(0, 100), (100, 100), (200, 30)]
    naps = []
    answers = iter([(429, {"retry-after": "99"}, b""), (503, {}, b""), (200, {}, b"ok")])
    assert rest.with_retries(lambda: next(answers), sleep=naps.append) == b"ok" and naps == [30.0, 2.0]
    assert rest.with_retries(lambda: (404, {}, b""), sleep=naps.append) is None
    now = [0.0]
    t = rest.Throttle(0.34, lambda: now[0], naps.append)
    t.wait()
    t.wait()
    assert naps[-1] == pytest.approx(0.34)
    assert rest.search_term("Ab Cd", "0000", ("U",)) == '0000[auid] OR (("Ab Cd"[Author] OR "Ab C*"[Author]) AND ("U"[Affiliation]))' and rest.search_term("Ab") == "(Ab[Author])" and rest.search_term("") == ""


def test_scans():
    from bibloom.sources import rest

    found = {"wide": [str(i) for i in range(250)], "narrow": ["1", "2", "2", "3"]}
    fetch = lambda term, start, size: (len(found[k := "narrow" if "Affiliation" in term else "wide"]), found[k][start : start + size])
    ids, told = rest.scan_ids(fetch, "Ab Cd", wanted=1000)
    assert ids == found["wide"] and told["esearch_count"] == 250 and not told["narrowed"] and told["remedy"] is None
    ids, told = rest.scan_ids(fetch, "Ab Cd", affiliations=("U",), wanted=100)
    assert ids == ["1", "2", "3"] and told["narrowed"] and told["pmids_returned"] == 3
    assert rest.scan_ids(fetch, "Ab Cd", wanted=100)[1]["remedy"] == "raise_budget" and rest.remedy(20_000, 10_000) == "narrow_search"
    assert list(rest.scan_records(lambda ids: None if "2" in ids else ",".join(ids), ["1", "2", "3"], 1)) == ["1", "3"]
    pages = {"*": {"results": [{"id": "a"}, {"id": "b"}], "meta": {"next_cursor": "x"}}, "x": {"results": [{"id": "b"}, {"id": "c"}], "meta": {"next_cursor": None}}}
    assert rest.scan_cursor(pages.get) == ([{"id": "a"}, {"id": "b"}, {"id": "c"}], {"truncated": False, "request_failed": False})
    assert rest.scan_cursor(pages.get, 2)[1]["truncated"] and rest.scan_cursor({"*": pages["*"]}.get)[1]["request_failed"]
    assert rest.first_count([("a", lambda k: None), ("b", lambda k: 0)], "x") == (0, "b") and rest.first_count([], "x") == (None, None)
    asked = []
    topics = rest.topics_of({"1": "d", "2": "d", "3": "", "4": "e", "5": "f"}, lambda by: asked.append(by) or {"d": {"topic": "T"}, "e": {}}.get(by))
    assert {k: v["status"] for k, v in topics.items()} == {"1": "topic_found", "2": "topic_found", "3": "no_identifier", "4": "no_topic", "5": "topic_lookup_failed"} and asked == ["d", "e", "f"]


def test_answers(spark, tmp_path):
    from bibloom.sources import signals

    rows = [
        ("1", "doaj", 200, '{"total": 1, "results": [{"bibjson": {"apc": {"has_apc": true}, "editorial": {"review_process": ["Peer review", "Open"]}}}]}'), ("2", "doaj", 200, '{"total": 0}'), ("3", "doaj", 500, '{"total": 0}'), ("4", "doaj", 200, "no json"),
        ("1", "crossref", 200, '{"message": {"coverage": {"abstracts-current": 0.0, "orcids-current": 0.5}, "counts": {"total-dois": 12}}}'), ("2", "crossref", 200, "{}"), ("1", "openalex", 200, '{"id": "S1", "is_in_doaj": false, "works_count": 7, "summary_stats": {"2yr_mean_citedness": 1.234, "h_index": 5}}'), ("2", "openalex", 200, "{}"), ("3", "openalex", 200, "[1]"),
    ]
    got = {tuple(r) for r in signals.source_signals(spark.createDataFrame(rows, "issn string, service string, status int, body string")).collect()}
    assert got == {
        ("1", "doaj", "doaj_indexed", "1"), ("1", "doaj", "doaj_apc", "true"), ("1", "doaj", "doaj_review_process", "Peer review, Open"), ("2", "doaj", "doaj_not_indexed", "0"), ("1", "crossref", "crossref_metadata_missing", "1/2"), ("1", "crossref", "crossref_deposited_dois", "12"),
        ("2", "crossref", "crossref_unknown", ""), ("1", "openalex", "openalex_in_doaj", "false"), ("1", "openalex", "openalex_indexed_in_scopus", "unknown"), ("1", "openalex", "openalex_works_count", "7"), ("1", "openalex", "openalex_impact", "1.23/5"), ("2", "openalex", "openalex_unknown", ""),
    }
    docs = spark.createDataFrame([('{"a": {}, "b": 1}',), ('{"a": [], "c": "x"}',), ("x",), (None,)], "d string").coalesce(1)
    from pyspark.sql import functions as F

    assert [r[0] for r in docs.select(signals.readable_shape(F.col("d"), {"a": "OBJECT", "b": "BIGINT", "c": "STRING"})).collect()] == [[], ["a"], ["document"], ["document"]]
    stamps = spark.createDataFrame([("2024-01-02T03:04:05",), ("20240102_030405",), ("soon",), (None,)], "t string").coalesce(1).select(signals.stamp(F.col("t"))).collect()
    assert [r[0] is not None for r in stamps] == [True, True, False, False]
    path = str(tmp_path / "answers")
    signals.save_answers(spark.createDataFrame([("1", 3), ("2", None)], "doi string, citation_count long"), path, 5)
    kept = signals.load_answers(spark, path, "doi string, citation_count long, n_searched long, source string")
    assert {tuple(r) for r in kept.collect()} == {("1", 3, 5, None), ("2", None, 5, None)} and signals.denominator_mismatch(kept).first()["n_kept"] == 2
    assert signals.load_answers(spark, path + "x", "doi string").count() == 0


def test_small_tables(spark):
    rows = spark.createDataFrame([("a", "x"), (None, "y"), (None, None)], "advisor string, student string")
    assert [r["advisor"] for r in files.fill_constant(rows, "advisor").collect()] == ["a"] * 3
    two = rows.unionByName(spark.createDataFrame([("b", "z")], rows.schema))
    assert sorted(r["advisor"] or "" for r in files.fill_constant(two, "advisor").collect()) == ["", "", "a", "b"]
    assert files.fill_constant(rows.limit(0), "advisor").count() == 0
    loaded = spark.createDataFrame([(None, False), (None, True), ("no_title", False), ("no_title", True)], "reject string, duplicate boolean")
    assert {(r["outcome"], r["n"]) for r in files.load_counters(loaded).collect()} == {("loaded", 1), ("duplicate", 1), ("no_title", 2)}
    assert [tuple(r) for r in files.worklist_rows(rows, ("advisor", "note")).collect()] == [("a", ""), ("", ""), ("", "")]
