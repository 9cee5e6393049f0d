"""Offsets of progress reports (T11), mergeable medians (M02), applied casts."""
import numpy as np
from pyspark.sql import functions as F

from fraudlens.operators import pipeline as P
from fraudlens.streaming import progress as PR


def test_offsets_of_numbered_partitions_and_of_logs():
    end, latest = '{"txn": {"0": 90, "1": 5}}', '{"txn": {"0": 1500, "1": 5}}'
    assert PR.offset_rows("any", end, latest, 7) == [("txn", 0, 90, 1500, 7), ("txn", 1, 5, 5, 0)]
    assert PR.offset_rows("files", '{"logOffset": 3}', None, 4) == [("files", 0, 3, None, 4)]
    assert PR.offset_rows("rate", "12", "15", 1) == [("rate", 0, 12, 15, 1)]
    assert PR.offset_rows("odd", None, "no json", 0) == [("odd", 0, None, None, 0)]


def test_lag_of_the_log(spark):
    rows = [("q", b, 0, "txn", p, c, e, n) for b, p, c, e, n in
            [(0, 0, 10, 2000, 10), (1, 0, 900, 2000, 890), (0, 1, 5, 5, 5), (0, 2, 3, None, 1)]]
    out = {r["partition"]: r for r in PR.live_lag(spark.createDataFrame(rows, PR.SCHEMA)).collect()}
    assert {p: (r["lag"], r["alert"], r["consumed"]) for p, r in out.items()} == {
        0: (1100, True, 900), 1: (0, False, 5), 2: (None, False, 1)}


def test_merged_sketches_equal_a_refit_in_rank(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 6000), rng.exponential(50, 6000)])
    df = spark.createDataFrame([(i % 30, float(v), None if i % 3 else float(i)) for i, v in enumerate(x)],
                               "day int, a double, b double")
    days = P.median_sketches(df, ["a", "b"], F.col("day"), 400)
    assert days.count() == 40                    # b has values on ten days
    got = P.sketch_medians(days, 400)
    exact = P.fit_medians(df.select("a", "b"))
    b = np.arange(0, 12000, 3)
    assert abs((x <= got["a"]).mean() - 0.5) < 0.02 and abs((b <= got["b"]).mean() - 0.5) < 0.02
    assert abs((x <= exact["a"]).mean() - 0.5) < 1e-3
    older = P.median_sketches(df.where("day < 20"), ["a"], F.col("day"), 400)
    newer = P.median_sketches(df.where("day >= 20"), ["a"], F.col("day"), 400)
    both = P.sketch_medians(older.unionByName(newer), 400)["a"]
    assert abs((x <= both).mean() - 0.5) < 0.02
    assert P.sketch_medians(P.median_sketches(df.limit(0), ["a"], F.col("day"))) == {}


def test_narrowing_is_applied(spark):
    df = spark.createDataFrame([(1, 300, 1 << 40, 0.5, "x"), (2, None, 1, 1e300, "y")],
                               "t long, s long, b long, d double, w string")
    out = P.narrow(df)
    assert [f.dataType.simpleString() for f in out.schema.fields] == \
        ["tinyint", "smallint", "bigint", "double", "string"]
    assert [tuple(r) for r in out.orderBy("t").collect()] == [(1, 300, 1 << 40, 0.5, "x"),
                                                             (2, None, 1, 1e300, "y")]
    assert P.narrow(df.select("w")).columns == ["w"]
