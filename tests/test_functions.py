from __future__ import annotations

import math
import random
from decimal import Decimal as D

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import session
from ledgerline.functions import quantiles, ranking, semantics, text


def _money(spark, values):
    return spark.createDataFrame([(D(v) if v is not None else None,) for v in values], "Sales decimal(12,2)")


@pytest.mark.parametrize("seed", range(4))
def test_exact_quantiles_match_numpy(spark, seed):
    rng = random.Random(seed)
    size = rng.choice([1, 2, 7, 500])
    scale = rng.choice([1, 1000, 10**9])
    values = [f"{rng.uniform(-scale, scale):.2f}" for _ in range(size)]
    if seed % 2:
        values += [values[0]] * size  # one value holds half of the rows
    got = quantiles.exact_quantiles(_money(spark, [*values, None]), ["Sales"], (0.0, 0.25, 0.5, 0.75, 1.0))
    for p, q in got["Sales"].items():
        assert q == pytest.approx(np.quantile([float(v) for v in values], p), rel=1e-12, abs=1e-9)


def test_exact_quantiles_edges(spark):
    assert quantiles.exact_quantiles(_money(spark, ["1", "2", "3", "10"]), ["Sales"])["Sales"][0.25] == 1.75
    empty = quantiles.exact_quantiles(_money(spark, []), ["Sales"])["Sales"]
    assert all(math.isnan(v) for v in empty.values())
    extremes = quantiles.exact_quantiles(_money(spark, ["-9999999999.99", "9999999999.99"]), ["Sales"], (0.0, 1.0))
    assert extremes["Sales"] == {0.0: -9999999999.99, 1.0: 9999999999.99}
    with pytest.raises(TypeError):
        quantiles.exact_quantiles(spark.range(3), ["id"])


def test_t_quantiles(spark):
    assert quantiles.t_quantile_90(28) == pytest.approx(1.3125, abs=5e-5)
    assert quantiles.t_quantile_90(1) == pytest.approx(3.077683537, abs=1e-8)
    got = spark.createDataFrame([(float(n),) for n in (0, 5, 100, 101, 400)], "n double").select(
        quantiles.t_quantile_90_col(F.col("n"))
    )
    got = [r[0] for r in got.collect()]
    assert got[0] is None
    for value, n in zip(got[1:], (5, 100, 101, 400)):
        assert value == pytest.approx(quantiles.t_quantile_90(n), abs=1e-8)


def test_row_numbers_are_dense_and_in_order(spark):
    rng = random.Random(1)
    values = [(rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(values, "a int, b int").repartition(7)
    base = spark.createDataFrame([(100,)], "top long")
    got = ranking.number_rows(df, [F.desc("a"), F.asc("b")], "n", after=base).collect()
    by_number = sorted(got, key=lambda r: r["n"])
    assert [r["n"] for r in by_number] == list(range(101, 3101))
    assert [(r["a"], r["b"]) for r in by_number] == sorted(values, key=lambda v: (-v[0], v[1]))
    none = spark.createDataFrame([], "top long").agg(F.max("top"))
    assert rows(ranking.number_rows(df.limit(1), [F.asc("b")], "n", after=none), "n") == [(1,)]
    assert ranking.number_rows(df.limit(0), [F.asc("b")], "n").count() == 0


def test_row_numbers_use_several_partitions(spark):
    placed = ranking.number_rows(spark.range(100_000), [F.asc("id")], "n")
    assert placed.agg(F.max("n"), F.count_distinct("n")).first() == (100_000, 100_000)
    assert placed.filter("n != id + 1").isEmpty()


def test_null_rules(spark):
    df = spark.createDataFrame([(None, None), (None, "a"), (None, "b")], "x double, y string")
    got = df.agg(semantics.nz_sum("x").alias("s"), semantics.n_distinct("y").alias("n")).first()
    assert (got["s"], got["n"]) == (0.0, 3)
    pairs = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -1.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in pairs.select(semantics.ratio("a", "b")).collect()] == [0.5, 0.0, 0.0, 0.0]
    growth = spark.createDataFrame([(3.0, 2.0), (3.0, 0.0), (3.0, None)], "a double, b double")
    assert [r[0] for r in growth.select(semantics.growth_pct("a", "b")).collect()] == [50.0, 0.0, 0.0]
    missing = spark.createDataFrame([("",), ("NA",), ("null",), ("NaN",), (None,), ("x",)], "t string")
    assert [r[0] for r in missing.select(semantics.is_missing("t")).collect()] == [True] * 5 + [False]


def test_number_texts(spark):
    df = spark.createDataFrame([(D("28742.50"),), (D("1234567.60"),), (D("-3.20"),)], "a decimal(12,2)")
    assert [r[0] for r in df.select(text.money(F.col("a"))).collect()] == ["₹28,742", "₹1,234,568", "₹-3"]
    assert spark.range(1).select(text.percent(F.lit(0.33321), 2)).first()[0] == "33.32%"


def test_keep_first_null_places_last(spark):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("p", T.LongType())])
    df = spark.createDataFrame([("a", None), ("a", 5), ("b", None)], schema)
    assert rows(ranking.keep_first(df, ["k"], ["p"])) == [("a", 5), ("b", None)]


def test_numbers_in_parts(spark, monkeypatch):
    """Parts that follow each other give the numbers of one sort, NULL last in every key."""
    rng = random.Random(5)
    pairs = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), i) for i in range(400)]
    df = session.durable(spark.createDataFrame(pairs, "a int, b string, c long"), "pairs")
    monkeypatch.setattr(session, "PART_BYTES", 1)
    keys = ["a", "b", "c"]
    got = ranking.number_rows(df, semantics.asc(*keys), "n", keys=keys, keep=["c"])
    assert got.columns == ["c", "n"]
    last = sorted(pairs, key=lambda p: [(v is None, v or 0) if i != 1 else (v is None, v or "") for i, v in enumerate(p)])
    assert sorted((r["n"], r["c"]) for r in got.collect()) == [(i, p[2]) for i, p in enumerate(last, 1)]
    base = spark.createDataFrame([(7,)], "m long")
    assert ranking.number_rows(df.limit(0), semantics.asc(*keys), "n", keys=keys).count() == 0
    assert ranking.number_rows(df.filter("c = 9"), semantics.asc(*keys), "n", base, keys).first()["n"] == 8
