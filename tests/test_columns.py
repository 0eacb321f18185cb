from pyspark.sql import functions as F

from bibloom.functions import columns as C


def _each(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_one_year(spark):
    good = {"2020": 2020, "2025年": 2025, "2018-10": 2018, "1997年第2期": 1997, "2011.0": 2011, " 2013　": 2013, "2023/8/12": 2023, "２０２５": 2025, "二〇二五年": 2025, "二零一九年": 2019, "20240131": 2024, "٢٠٢١": 2021, "2020-2020": 2020}
    bad = [None, "", "  ", "20094", "l024", "200", "2O24", "1899-12-31", "19x7", "20年23", "一九", "第52卷", "2018-2019", "2018、2019合刊", "2027", "1948", "#VALUE!", "20?3"]
    assert _each(spark, [*good], C.one_year) == [*good.values()]
    assert _each(spark, bad, C.one_year) == [None] * len(bad)


def test_issn(spark):
    good = ["0317-8471", "ISSN 0317-8471", "issn：0317—8471 ", "０３１７－８４７１", " 0317 8471", "03178471", "eISSN: 2049-3630", "ISSN (Online) 2049-3630", "0000-006X", "0000006x"]
    bad = [None, "", "317-8471", "0317-84711", "0317-8472", "0317-847O", "0317-8471; 2049-3630", "CN 11-1111/R", "-", "待查", "3.17E+06", "X317-8471"]
    assert all(_each(spark, good, C.valid_issn))
    assert not any(_each(spark, bad, C.valid_issn))


def test_identifier_keys(spark):
    assert set(_each(spark, ["90000001", "PMID90000001", "PMID: 090000001", " 90000001 ", "９００００００１"], C.pmid_key)) == {"90000001"}
    assert _each(spark, [None, "", " ", "N/A", "-", "none", "0"], C.pmid_key) == [None] * 7
    assert set(_each(spark, ["10.1/Ab", "doi:10.1/ab", "DOI: 10.1/AB", "https://doi.org/10.1/ab", "http://dx.doi.org/10.1/ab.", " 10.1/ab. "], C.doi_key)) == {"10.1/ab"}
    assert _each(spark, [None, "", "N/A", "无", "-"], C.doi_key) == [None] * 5
