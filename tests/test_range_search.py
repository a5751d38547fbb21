"""the range of a row is found by compiled comparisons."""

from pyspark.sql import functions as F

from tidepool.operators.ranges import with_range


def test_ranges_follow_the_order_and_are_compiled(spark):
    rows = [(i % 7 if i % 5 else None, float(i % 11) if i % 3 else None, i) for i in range(3000)]
    parts = with_range(spark.createDataFrame(rows, "a long, b double, c long"), "a", "b", "c", ranges=9)
    assert "lambda" not in parts._jdf.queryExecution().optimizedPlan().toString()
    got = parts.orderBy("a", "b", "c").collect()
    assert [r._range for r in got] == sorted(r._range for r in got) and len({r._range for r in got}) > 5
    assert {r._range for r in got if r.a is None} == {0}
    edges = parts.groupBy("_range").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in edges) == 3000
