from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal as D

import numpy as np
import pytest
from conftest import rows
from fixtures import record, sales
from pyspark.sql import functions as F

from ledgerline.operators import demand, segmentation


def customer(i, orders, amount, last):
    return [
        record(
            Order_ID=f"c{i}-{k}",
            Customer_ID=f"C{i}",
            Customer_Name=f"N{i}",
            Sales=D(amount),
            Order_Date=last - dt.timedelta(days=k),
        )
        for k in range(orders)
    ]


def test_three_clear_segments(spark):
    today = dt.date(2024, 6, 30)
    data = []
    for i in range(10):
        data += customer(i, 9, 1000 + i, today)
        data += customer(100 + i, 5, 300 + i, today - dt.timedelta(days=100))
        data += customer(200 + i, 1, 10 + i, today - dt.timedelta(days=300))
    out = segmentation.segment_customers(sales(spark, *data))
    got = {r["Customer_ID"]: r["Segment"] for r in out.data.collect()}
    assert len(got) == 30 and out.k == 3 and out.withinss < 1
    assert all(got[f"C{i}"] == "Champions" for i in range(10))
    assert all(got[f"C{100 + i}"] == "Loyal Customers" for i in range(10))
    assert all(got[f"C{200 + i}"] == "At Risk" for i in range(10))
    profile = out.centroids.collect()
    assert [r["Segment"] for r in profile] == ["Champions", "Loyal Customers", "At Risk"]
    assert [r["Size"] for r in profile] == [10, 10, 10]
    spend = [r["Mean_Monetary"] for r in profile]
    assert spend == sorted(spend, reverse=True)


def test_fewer_customers_than_clusters(spark):
    today = dt.date(2024, 6, 30)
    one = segmentation.segment_customers(sales(spark, *customer(1, 2, 10, today)))
    assert one.k == 1 and rows(one.data, "Segment") == [("Valued Partners",)]
    assert {"Cluster", "Size", "Segment", "Mean_Recency"} <= set(one.centroids.columns)
    two = segmentation.segment_customers(
        sales(spark, *customer(1, 2, 10, today), *customer(2, 5, 99, today))
    )
    assert two.k == 2 and {r[0] for r in rows(two.data, "Segment")} == {"Champions", "At Risk"}
    same = segmentation.segment_customers(
        sales(spark, *customer(1, 2, 10, today), *customer(2, 2, 10, today), *customer(3, 2, 10, today))
    )
    assert same.k == 1 and same.data.count() == 3
    assert segmentation.segment_customers(sales(spark, record()).limit(0)) is None


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(2)
    data = []
    for i in range(600):
        category = rng.choice(["Clothing", "Electronics", "Furniture"])
        mean = {"Clothing": 8, "Electronics": 3, "Furniture": 1}[category]
        data.append(
            record(
                Order_ID=f"o{i}",
                Category=category,
                Quantity=max(1, round(rng.gauss(mean, 1))),
                Price=D(rng.choice([10, 20, 30])),
                Region=rng.choice(["East", "West"]),
                Order_Date=dt.date(2024, rng.randint(1, 3), 5),
            )
        )
    return data, sales(spark, *data).cache()


def _poisson_by_newton(data):
    """Dense iteratively reweighted fit: |z| per coefficient, fitted means."""
    columns, names = [np.ones(len(data))], []
    for level in ("Electronics", "Furniture"):
        columns.append(np.array([float(r["Category"] == level) for r in data]))
        names.append(f"Category_{level}")
    columns.append(np.array([float(r["Price"]) for r in data]))
    names.append("Price")
    columns.append(np.array([float(r["Region"] == "West") for r in data]))
    names.append("Region_West")
    for month in (2, 3):
        columns.append(np.array([float(r["Order_Date"].month == month) for r in data]))
        names.append(f"Month_{month}")
    x, y = np.column_stack(columns), np.array([float(r["Quantity"]) for r in data])
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(y.mean())
    for _ in range(50):
        mean = np.exp(x @ beta)
        beta += np.linalg.solve(x.T @ (x * mean[:, None]), x.T @ (y - mean))
    mean = np.exp(x @ beta)
    z = beta / np.sqrt(np.diag(np.linalg.inv(x.T @ (x * mean[:, None]))))
    return dict(zip(names, np.abs(z[1:]))), y, mean


def test_poisson_importance_and_errors(lines):
    data, df = lines
    model = demand.train_demand(df, "poisson")
    expected, y, mean = _poisson_by_newton(data)
    got = dict(rows(model.importance))
    assert set(got) == set(expected)
    for name, z in expected.items():
        assert got[name] == pytest.approx(z, rel=1e-4, abs=1e-4)
    errors = model.metrics.first()
    assert errors["RMSE"] == pytest.approx(np.sqrt(np.mean((y - mean) ** 2)), rel=1e-6)
    assert errors["MAE"] == pytest.approx(np.mean(np.abs(y - mean)), rel=1e-6)
    assert errors["Mean_Quantity"] == pytest.approx(y.mean())


def test_forest_finds_the_driver(lines):
    _, df = lines
    model = demand.train_demand(df)
    ranked = model.importance.collect()
    assert [r["Variable"] for r in ranked][0] == "Category" and len(ranked) == 4
    assert model.metrics.first()["RMSE"] < 2
    assert demand.train_demand(df.limit(0)) is None


@pytest.mark.parametrize("method", ["forest", "poisson"])
def test_scoring_scenarios(spark, lines, method):
    _, df = lines
    model = demand.train_demand(df, method)
    wanted = spark.createDataFrame(
        [("Clothing", 20.0, "East", 1), ("Furniture", 20.0, "East", 1), ("Garden", 20.0, "East", 1), ("Clothing", 20.0, "East", 12)],
        "Category string, Price double, Region string, Month int",
    )
    got = {(r["Category"], r["Month"]): r for r in demand.score_demand(model, df, wanted).collect()}
    assert len(got) == 4
    high, low = got["Clothing", "1"], got["Furniture", "1"]
    assert high["Predicted_Quantity"] > low["Predicted_Quantity"]
    assert high["Result"] == (
        f"Predicted Quantity Demand: {high['Predicted_Quantity']:.1f} units per transaction (using {model.label})"
    )
    for unknown in (("Garden", "1"), ("Clothing", "12")):
        assert got[unknown]["Predicted_Quantity"] is None
        assert got[unknown]["Result"] == "Prediction failed. Verify predictor configuration."


def test_unbounded_levels_of_one_factor(spark):
    """6,000 categories: more columns than a dense normal equation takes; totals of every level are met."""
    n = 12_000
    df = spark.range(n).select(
        F.concat(F.lit("c"), F.col("id") % 6000).alias("Category"),
        (F.col("id") % 7 + 1).cast("double").alias("Price"),
        F.element_at(F.array(F.lit("East"), F.lit("West")), (F.col("id") % 2 + 1).cast("int")).alias("Region"),
        (F.col("id") % 3 + 1).cast("int").alias("Month"),
        (F.pmod(F.xxhash64("id"), F.lit(9)) + 1).alias("Quantity"),
    )
    model = demand.train_demand(df, "poisson")
    assert model.label == demand.POISSON_LABEL
    assert model.importance.count() == 5999 + 1 + 1 + 2
    off = demand.fitted_totals(df, model).filter(F.abs(F.col("Observed") - F.col("Fitted")) > 1e-3)
    assert off.count() == 0


def test_models_give_way_to_each_other(spark, lines, monkeypatch):
    _, df = lines

    def broken(rows):
        raise ValueError("no forest here")

    monkeypatch.setattr(demand, "train_forest", broken)
    assert demand.train_demand(df).label == demand.POISSON_LABEL
    monkeypatch.setattr(demand, "NARROW_LEVELS", 1)
    model = demand.train_demand(df)
    assert model.label == demand.MEAN_LABEL and model.importance.count() == 0
    errors = model.metrics.first()
    quantities = [float(r["Quantity"]) for r in lines[0]]
    assert errors["RMSE"] == pytest.approx(np.std(quantities)) and errors["Mean_Quantity"] == pytest.approx(np.mean(quantities))
    wanted = spark.createDataFrame([("Clothing", 20.0, "East", 1)], "Category string, Price double, Region string, Month int")
    assert demand.score_demand(model, df, wanted).first()["Predicted_Quantity"] == pytest.approx(np.mean(quantities))


def test_trees_draw_single_lines(spark):
    """One combination holds a third of the lines: a tree that drew combinations would miss it with chance 1/e."""
    hot = [record(Order_ID=f"h{i}", Category="Hot", Quantity=90, Price=D(10), Region="East") for i in range(200)]
    cold = [
        record(Order_ID=f"c{i}", Category="Cold", Quantity=1 + i % 5, Price=D(10 + i), Region="West") for i in range(400)
    ]
    rows_ = demand.model_rows(sales(spark, *hot, *cold))
    assert rows_.filter("weight = 200").count() == 1
    model = demand.train_forest(rows_, trees=20)
    features = model.fitted.indexed.transform(rows_.filter("Category = 'Hot'")).first()["features"]
    assert all(tree.predict(features) > 20 for tree in model.fitted.grown.trees)
    sampled = {tree._call_java("rootNode").impurityStats().count() for tree in model.fitted.grown.trees}
    assert len(sampled) > 1  # the number of lines drawn differs from tree to tree


def test_time_follows_combinations(spark, monkeypatch):
    """Four billion lines in eight combinations: a forest that reads single lines does not end."""
    combos = [
        (float(q), c, p, "East", "1", 5e8) for q, c, p in
        [(1, "A", 10.0), (3, "A", 10.0), (5, "A", 20.0), (7, "A", 20.0), (11, "B", 10.0), (13, "B", 10.0), (20, "B", 20.0), (30, "B", 20.0)]
    ]
    rows_ = spark.createDataFrame(combos, "Quantity double, Category string, Price double, Region string, Month string, weight double")
    fitted = []
    fit = demand.RandomForestRegressor.fit
    monkeypatch.setattr(demand.RandomForestRegressor, "fit", lambda self, df: (fitted.append(df.count()), fit(self, df))[1])
    model = demand.train_forest(rows_, trees=40)
    assert fitted == [1]
    grown = model.fitted.grown
    assert grown.getNumTrees == 40
    drawn = [tree._call_java("rootNode").impurityStats().count() for tree in grown.trees]
    assert len(set(drawn)) == 40 and all(abs(n - 4e9) < 1e6 for n in drawn)
    whole = [t for t in grown.trees if t.depth == 2 and t.numNodes == 7]  # both features were drawn where they part
    asked = model.fitted.indexed.transform(rows_.select("Category", "Price", "Region", "Month").distinct()).collect()
    means = {("A", 10.0): 2, ("A", 20.0): 6, ("B", 10.0): 12, ("B", 20.0): 25}
    assert whole and all(t.predict(r["features"]) == pytest.approx(means[r["Category"], r["Price"]], abs=0.01) for t in whole for r in asked)
    # in rounds of three trees, and then by Spark from the lines
    monkeypatch.setattr(demand, "DRAWN", 12)
    assert len(demand.train_forest(rows_, trees=7).fitted.grown.trees) == 7
    monkeypatch.setattr(demand, "DRAWN", 1)
    few = rows_.withColumn("weight", F.lit(9.0))
    assert len(demand.train_forest(few, trees=3).fitted.grown.trees) == 3 and fitted[-1] == 72


def test_price_thresholds(spark, monkeypatch):
    few = spark.createDataFrame([(1.0, 5.0), (2.0, 1.0), (4.0, 1.0)], "Price double, weight double")
    assert demand.price_thresholds(few, 31) == [1.5, 3.0] and demand.price_thresholds(few, 1) == [1.5]
    assert demand.price_thresholds(few.limit(1), 31) == []
    many = spark.range(1000).select(F.col("id").cast("double").alias("Price"), F.lit(3.0).alias("weight"))
    exact = demand.price_thresholds(many, 9)
    assert exact == [99.5 + 100 * i for i in range(9)]
    monkeypatch.setattr(demand, "PRICES", 10)
    assert all(abs(a - b) < 12 for a, b in zip(demand.price_thresholds(many, 9), exact, strict=True))


def test_no_start_is_cheaper(spark):
    """Weighted points on a line: the best split of all is found."""
    source = random.Random(4)
    places = [(round(source.random(), 3), source.randint(1, 9)) for _ in range(40)]
    points = spark.createDataFrame(
        [(x, 0.0, 0.0, float(n)) for x, n in places], "R_Norm double, F_Norm double, M_Norm double, n double"
    )
    centers, cost = segmentation.fit_centers(points, 3, 25)

    def spread(part):
        total = sum(n for _, n in part)
        mean = sum(x * n for x, n in part) / total
        return sum(n * (x - mean) ** 2 for x, n in part)

    ordered = sorted(places)
    best = min(
        spread(ordered[:i]) + spread(ordered[i:j]) + spread(ordered[j:]) for i in range(1, 39) for j in range(i + 1, 40)
    )
    assert cost == pytest.approx(best, rel=1e-9) and centers.shape == (3, 3)
