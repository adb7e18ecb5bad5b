"""Small values, large scores, settings and sources that used to give wrong rows."""

from pyspark.sql import functions as F

from kindred.functions.numbers import quantize
from kindred.operators.pairs import cosine_neighbours
from kindred.sources.digests import table_digest
from kindred.sources.tables import discover, read_table


def test_tiny_cosines_stay(spark):
    big = 1e10
    rows = [(1, 1, big), (1, 2, 1.0), (2, 2, big), (2, 1, 1.0)]
    edges = cosine_neighbours(spark.createDataFrame(rows, "user_id long, item_id long, value double")).collect()
    assert {(r.item, r.other) for r in edges} == {(1, 2), (2, 1)}
    assert all(abs(r.weight / 2e-10 - 1) < 1e-5 for r in edges)


def test_quantize_keeps_the_grid(spark):
    values = [0.1234567891, -2e-10, 3e-17, 0.0, 5.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(quantize(F.col("v"))).collect()]
    assert got == [0.123456789, -2e-10, 0.0, 0.0, 5.0]


def test_digest_sees_where_nulls_are(spark):
    one = spark.createDataFrame([(5, None)], "a int, b int")
    two = spark.createDataFrame([(None, 5)], "a int, b int")
    assert table_digest(one) != table_digest(two)


def test_quoted_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('user_id,text\n1,"two\nlines"\n2,"say ""hi"", ok"\n')
    rows = {r.user_id: r.text for r in read_table(spark, str(path), multi_line=True).collect()}
    assert rows == {1: "two\nlines", 2: 'say "hi", ok'}


def test_a_folder_may_end_like_a_suffix(spark, tmp_path):
    folder = tmp_path / "ml-csv"
    folder.mkdir()
    (folder / "ratings.csv").write_text("a\n1\n")
    assert discover(spark, str(folder), ["ratings.csv"]).endswith("ml-csv/ratings.csv")
