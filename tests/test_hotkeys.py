import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from skein.operators.hotkeys import hot_keys, key_profile, ordinal, split_join

QS = {"q0": 0.0, "q25": 0.25, "median": 0.5, "q99": 0.99, "q1": 1.0}


def brute(rows):
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    out = {}
    for k, vs in by.items():
        have = sorted((v for v in vs if v is not None), key=lambda x: (math.isnan(x), x))
        out[k] = (len(vs), len(have), *[have[max(1, math.ceil(q * len(have))) - 1] if have else None for q in QS.values()])
    return out


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def check(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["n_rows"], r["n_values"], *[r[q] for q in QS]) for r in key_profile(df, ["k"], F.col("v"), QS).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert all(same(x, y) for x, y in zip(got[k], want[k], strict=True)), (k, got[k], want[k])


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(3000)] + [(f"k{rng.randrange(40)}", rng.choice([1.0, 2.0, 2.0, 1e300, -1e-300, 5e-324])) for _ in range(1500)]
    check(spark, rows)


def test_close_values_need_every_digit(spark):
    x = 1.0
    rows = []
    for _ in range(300):
        rows.append(("a", x))
        x = math.nextafter(x, 2)
    check(spark, rows)


def test_nulls_ties_nan_infinity(spark):
    check(spark, [("a", None), ("a", 1.0), ("a", 1.0), (None, 2.0), (None, None), ("b", None), ("c", math.nan), ("c", math.inf), ("c", -math.inf), ("c", 0.0), ("c", -0.0)])


def test_ordinal_keeps_order(spark):
    vals = [-math.inf, -1e308, -2.5, -2.0, -1.0, -2.0**-1022, -5e-324, 0.0, 5e-324, 2.0**-1022, 0.1, 0.5, 1.0, math.nextafter(1, 2), 2.0, 3.0, 1e16, 1.7976931348623157e308, math.inf, math.nan]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double").orderBy("i").select(ordinal(F.col("v"))).collect()]
    assert got == sorted(got) and len(set(got)) == len(got)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert key_profile(empty, ["k"], F.col("v"), QS).count() == 0
    assert hot_keys(empty, ["k"], 0.02).count() == 0
    df = spark.createDataFrame([("a", 1.0, 7, 8)], "k string, v double, n_rows int, c int")
    assert key_profile(df, ["k"], F.col("v"), QS).first()["n_rows"] == 1


def test_hot_keys_count_nulls_in_the_total(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)] + [(None,)] * 97, "k string")
    assert [r["hot_key"] for r in hot_keys(df, ["k"], 0.02).collect()] == ["a"]
    for n in (50, 150, 350, 1150):  # exactly a fiftieth, whatever the rounding
        exact = spark.createDataFrame([("a",)] * (n // 50) + [(None,)] * (n - n // 50), "k string")
        assert [r["hot_key"] for r in hot_keys(exact, ["k"], 0.02).collect()] == ["a"]


def test_split_join_is_a_left_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(i, i) for i in range(2, 60)] + [(None, 1)], "k bigint, x int")
    right = spark.createDataFrame([(i, i * 10) for i in range(0, 40)], "k bigint, y int")
    got = sorted(map(str, split_join(left, right, "k", 0.1).select("k", "x", "y").collect()))
    assert got == sorted(map(str, left.join(right, "k", "left").select("k", "x", "y").collect()))
    assert split_join(left.where("false"), right, "k").count() == 0
