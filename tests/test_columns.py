"""Column functions, case by case."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from feedloom.functions import ids, text
from feedloom.functions.rand import uniform
from feedloom.functions.vectors import concat_vectors, has_any, is_valid_vector, linear_probability


def each(spark, values, fn, kind="string"):
    """`fn` of every value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_strip_knows_all_white_space(spark):
    values = ["\t a b\n", " x　", " ", None, " line ", "\x0bv\x85"]
    assert each(spark, values, text.strip) == [v.strip() if v is not None else None for v in values]


def test_split_list(spark):
    got = each(spark, ["cs.AI; cs.LG ", "", None, "a;;b"], text.split_list)
    assert got == [["cs.AI", "cs.LG"], [""], [""], ["a", "", "b"]]
    assert each(spark, [" a ;; b;"], text.clean_list) == [["a", "b"]]


def test_join_and_first(spark):
    values = [["a", None, "b"], [], None]
    assert each(spark, values, text.join_list, "array<string>") == ["a;b", "", ""]
    assert each(spark, values, text.first_item, "array<string>") == ["a", None, ""]


def test_first_sentences(spark):
    got = each(spark, ["One. Two\nhalf . . Three", "no stop", "", None], lambda c: text.first_sentences(c, 2))
    assert got == [["One.", "Two half."], ["no stop."], [], []]


def test_embedding_text(spark):
    df = spark.createDataFrame([("T", "A"), (None, " A "), ("T", None), (None, None)], "t string, a string")
    got = [r[0] for r in df.select(text.embedding_text(F.col("t"), F.col("a"))).collect()]
    assert got == ["T\n\nA", "A", "T", ""]


def test_iso_year(spark):
    values = ["2024-02-30", "2024", "20240101T00", "24-01-01", " 2024", "", None, "2024Z"]
    assert each(spark, values, ids.iso_year) == [2024, 2024, 2024, None, None, None, None, 2024]


@pytest.mark.parametrize(
    "value, year",
    [
        ("2302.11801", "2023"), ("0704.1234v3", "2007"), (" 2302.11801 ", "2023"), ("2301.123", None),
        ("hep-th/9101001", "1991"), ("HEP-TH/9001001", "2090"), ("math/0212345v2", "2002"),
        ("cs.AI/0212345", None), ("2302.11801x", None), ("", None), (None, None),
    ],
)
def test_year_from_id(spark, value, year):
    assert each(spark, [value], ids.year_from_id) == [year]


def test_year_from_path(spark):
    values = [
        "file:/data/metadata/metadata-2024.csv", "/x/2023/part_1.csv", "/x/a_2021-b/2020.parquet",
        "/x/y/z.csv", "/x/y/20245.csv", "2019.csv",
    ]
    assert each(spark, values, ids.year_from_path) == ["2024", "2023", "2021", None, None, "2019"]


def test_extract_id(spark):
    values = ["Reading group: arXiv:2406.07731", "Rules of this forum", "arXiv:1.2 arXiv:3.4", None]
    assert each(spark, values, ids.extract_id) == ["2406.07731", None, "1.2", None]


def test_month_bucket_keeps_the_written_month(spark):
    values = [
        "2024-01-31T23:30:00-05:00", "2024-02-03T08:00:00Z", " 2024-03", "20240415", "2024-13-01", "soon",
        "", None, "2024-05-99",
    ]
    want = ["2024-01", "2024-02", "2024-03", "2024-04", "unknown", "unknown", "unknown", "unknown", "2024-05"]
    assert each(spark, values, ids.month_bucket) == want
    df = spark.createDataFrame([("", "2024-06-01", "2020-01-01")], "a string, b string, c string")
    assert df.select(ids.month_bucket(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "2024-06"


def test_iso_instant(spark):
    values = ["2024-02-03T08:00:00Z", "2024-02-03", "2024-02-03 08:05", "2024-02-03T08:00:01.5-05:00", "2024-02 or so",
              "2024-13-01", "soon", None]
    assert each(spark, values, ids.iso_instant) == [
        "2024-02-03T08:00:00+00:00", "2024-02-03T00:00:00", "2024-02-03T08:05:00", "2024-02-03T08:00:01.5-05:00",
        "2024-02-01T00:00:00+00:00", "", "", "",
    ]


def test_month_labels(spark):
    values = ["2024-02", "init", "x", "2024-02-extra", "2024-13"]
    assert [tuple(r) for r in each(spark, values, ids.month_order)] == [
        (2024, 2), (-1, -1), (9999, 12), (2024, 2), (2024, 13)
    ]
    starts = each(spark, values, lambda c: ids.month_start(c, F.lit("now")))
    assert starts == ["2024-02-01T00:00:00+00:00", "now", "now", "2024-02-01T00:00:00+00:00", "now"]
    assert each(spark, values, ids.label_year) == ["2024", "unknown", "unknown", "2024", "2024"]


def test_category_setspec(spark):
    values = ["cs.AI", "stat.ML", "cs", "physics.acc-ph", "a.b.c"]
    assert each(spark, values, ids.category_setspec) == [
        "cs:cs:AI", "stat:stat:ML", "cs", "physics:acc-ph", "a:a:b.c"
    ]


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_valid_vectors(spark, kind):
    values = [[1.0, 2.0], [], None, [float("nan"), 0.0], [1.0, None], [float("inf")], [1.0, float("-inf")]]
    assert each(spark, values, is_valid_vector, kind) == [True, True, False, False, False, False, False]


def test_has_any(spark):
    assert each(spark, [["a", "b"], ["c"], []], lambda c: has_any(c, ["b", "x"]), "array<string>") == [
        True, False, False
    ]


def test_stacking_and_probability(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0])], "a array<float>, b array<float>")
    stacked = df.select(concat_vectors(["b", "a"]).alias("v"))
    assert stacked.first()[0] == [3.0, 1.0, 2.0]
    p = stacked.select(linear_probability([1.0, -1.0, 0.5], -4.0)("v")).first()[0]
    assert p == pytest.approx(1 / (1 + 2.718281828459045), abs=1e-12)


def test_uniform_depends_on_seed_and_key_only(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    a = dict(rows(df.select("k", uniform(1, F.col("k")).alias("u"))))
    b = dict(rows(df.repartition(7).select("k", uniform(1, F.col("k")).alias("u"))))
    c = dict(rows(df.select("k", uniform(2, F.col("k")).alias("u"))))
    assert a == b and a != c
    assert 0 < min(a.values()) and max(a.values()) < 1
    assert abs(sum(a.values()) / len(a) - 0.5) < 0.01
