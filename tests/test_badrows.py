from hypothesis import given, settings
from hypothesis import strategies as st

from bibloom.operators import badrows as B


def test_strict_lines():
    assert B.parse_line('a,"b,c","d""e"', 3) == (["a", "b,c", 'd"e'], None, [])
    assert B.parse_line('"x\ny",', 2) == (["x\ny", ""], None, [])
    assert B.parse_line("", 1) == ([""], None, [])


def test_faults():
    for line, fault in [('a,"b', "quoting"), ('a"b,c', "quoting"), ('"a"b,c', "quoting"), ("a\nb,c", "quoting"), ("a", "column_count"), ("a,b,c", "column_count"), ('"a","b","c"', "column_count"), ("a;b", "column_count"), ("", "column_count"), ('a,"b"c,d', "quoting")]:
        fields, found, edits = B.parse_line(line, 2)
        assert found == fault and edits and len(fields) == 2, line


def _strict(line, columns):
    return bool(B._GOOD.fullmatch(line)) and len(B.fields_of(line)) == columns


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab,"\n', max_size=12), st.integers(1, 4))
def test_fault_is_that_of_the_strict_grammar(line, columns):
    fields, fault, edits = B.parse_line(line, columns)
    assert len(fields) == columns
    assert (fault == "quoting") == (not B._GOOD.fullmatch(line))
    assert (fault is None) == _strict(line, columns) == (not edits)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet='a,"', min_size=1, max_size=5), st.integers(1, 3))
def test_one_edit_is_found(line, columns):
    """Wherever one insertion or deletion repairs a line, the dynamic programme needs no second edit of that kind."""
    near = {line[:i] + c + line[i:] for i in range(len(line) + 1) for c in ',"'} | {line[:i] + line[i + 1 :] for i in range(len(line)) if line[i] in ',"'}
    if not _strict(line, columns) and any(_strict(x, columns) for x in near):
        edits = B.error_parse(line, columns)[2]
        assert len(edits) <= 2, (line, edits)


def test_long_line():
    text = "x" * 200_000
    assert B.parse_line(f'{text},"{text}"', 2)[1] is None
    assert B.parse_line(f'{text},"{text}', 2)[1] == "quoting"


def test_bad_rows(spark):
    records = spark.createDataFrame([(1, "2020", "x"), (2, None, "x"), (3, "20?0", "x")], "rec_id long, pub_year_raw string, reason string")
    journals = spark.createDataFrame([(1, "0317-8471"), (2, None), (3, ""), (4, "bad")], "row_id long, issn string")
    lines = [("journals", "0317-8471,,n,,,,2020"), ("journals", "bad,,n,,,,2020"), ("chinese_records", "t,a,p,j,2020,s,r,d"), ("chinese_records", "t,a,p,j,x,s,r,d"), ("chinese_records", "t"), ("journals", 'a"'), ("else", "x"), ("journals", None)]
    raw = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(lines)], "raw_id long, target_table string, raw_line string")
    got = {(r["table_name"], r["row_key"], r["reason"]) for r in B.bad_rows(records, journals, raw).collect()}
    assert got == {
        ("chinese_records", 2, "pub_year"), ("chinese_records", 3, "pub_year"), ("journals", 4, "issn"),
        ("raw_rows", 1, "issn"), ("raw_rows", 3, "pub_year"), ("raw_rows", 4, "column_count"), ("raw_rows", 5, "quoting"), ("raw_rows", 6, "unknown_table"), ("raw_rows", 7, "column_count"),
    }
    assert B.load_good(raw, "chinese_records").count() == 1
    empty = lambda d: d.limit(0)
    assert B.bad_rows(empty(records), empty(journals), empty(raw)).count() == 0
    clash = raw.withColumn("fields", raw.raw_id).withColumn("fault", raw.raw_line)
    assert B.parse_lines(clash).columns.count("fields") == 1


def test_edits_say_what_to_mend():
    assert B.parse_line("a,b,c", 2)[2] in (["delete delimiter at 1"], ["delete delimiter at 3"])
    assert B.parse_line('"a","b"', 1) == (["ab"], "column_count", ["delete delimiter at 3"])
    assert B.parse_line("a", 2) == (["a", ""], "column_count", ["insert delimiter at 1"])
    assert B.parse_line('"a', 1)[1:] in (("quoting", ["insert quote at 2"]), ("quoting", ["delete quote at 0"]))
