import random

from pyspark.sql import functions as F

from quarrylight.operators.numbering import numbered


def test_numbers_are_dense_and_follow_the_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), rng.randrange(50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, k int").repartition(7)
    got = {r["k"]: r["number"] for r in numbered(df, F.col("a").asc_nulls_first(), F.desc("b"), "k").collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1], r[2]))
    assert [got[r[2]] for r in want] == list(range(1, 3001))
    got = {r["k"]: r["at"] for r in numbered(df, F.col("a").asc_nulls_first(), F.desc("b"), "k", name="at", within="a").collect()}
    for group in (None, 1, 2, 3):
        assert [got[r[2]] for r in want if r[0] == group] == list(range(1, sum(r[0] == group for r in rows) + 1))


def test_an_empty_table_has_no_numbers_and_ties_share_out_the_numbers(spark):
    assert numbered(spark.createDataFrame([], "a int"), "a").count() == 0
    assert sorted(r["number"] for r in numbered(spark.createDataFrame([(5,)] * 40, "a int"), "a").collect()) == list(range(1, 41))
