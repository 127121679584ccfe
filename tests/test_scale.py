"""Hot keys and plan shapes."""

from __future__ import annotations

import contextlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerline.functions.ranking import first_by
from ledgerline.operators import cleaning, customers, products, sales, star
from ledgerline.session import durable, stage_root


@contextlib.contextmanager
def settings(spark, **values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot(spark):
    """60,000 lines; one customer, product and order hold a third of them."""
    third = F.col("id") % 3 == 0
    money = "decimal(12,2)"
    return durable(
        spark.range(60_000).select(
            F.col("id").alias("place"),
            F.when(third, "HOT").otherwise(F.concat(F.lit("O"), F.col("id") % 9000)).alias("Order_ID"),
            F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("Order_Date"),
            F.when(third, "HOT").otherwise(F.concat(F.lit("C"), F.col("id") % 500)).alias("Customer_ID"),
            F.when(F.col("id") % 50 == 0, None).otherwise(F.concat(F.lit("N"), F.col("id") % 7)).alias("Customer_Name"),
            F.when(third, "HOT").otherwise(F.concat(F.lit("P"), F.col("id") % 40)).alias("Product"),
            F.lit("Clothing").alias("Category"),
            F.lit(1).alias("Quantity"),
            F.lit(2).cast(money).alias("Price"),
            (F.col("id") % 1000).cast(money).alias("Sales"),
            F.lit(1).cast(money).alias("Profit"),
            F.when(F.col("id") % 40 == 0, "").otherwise(F.concat(F.lit("T"), F.col("id") % 11)).alias("City"),
            F.when(third, "HOT").otherwise(F.concat(F.lit("S"), F.col("id") % 20)).alias("State"),
            F.lit("East").alias("Region"),
        ),
        "hot",
    )


def test_hot_customer_metrics(hot):
    got = {r["Customer_ID"]: r for r in hot.transform(customers.customer_metrics).groupBy("Customer_ID").agg(F.sum("Total_Units").alias("u")).collect()}
    assert got["HOT"]["u"] == 20_000
    assert sales.kpis(hot).first()["TotalOrders"] == hot.select("Order_ID").distinct().count()
    assert products.product_metrics(hot).filter("Product = 'HOT'").first()["Quantity"] == 20_000


def test_distinct_counts_spread_a_hot_group_over_orders(hot):
    plan = products.product_metrics(hot)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
    first_exchange = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line][-1]
    assert "Order_ID" in first_exchange  # not by product alone


def test_hot_order_keeps_its_first_line(hot):
    kept = cleaning.remove_duplicates(hot, ["place"])
    assert kept.filter("Order_ID = 'HOT'").first()["place"] == 0
    assert kept.count() == hot.select("Order_ID").distinct().count()


def test_hot_imputation_is_whole(hot):
    out = cleaning.impute(hot, cleaning.learn_lookups(hot, ["place"]))
    assert out.count() == 60_000
    assert out.filter("Customer_Name IS NULL OR City = ''").isEmpty()
    first = hot.filter("Customer_Name IS NOT NULL").groupBy("Customer_ID").agg(
        first_by(F.col("Customer_Name"), ["place"]).alias("n")
    )
    filled = out.filter("no_name").join(first, "Customer_ID")
    assert filled.filter("Customer_Name != n").isEmpty()
    # the others are customers without any name
    nameless = out.filter("no_name AND Customer_Name = 'Valued Partner'").count()
    assert filled.count() + nameless == 1200 and filled.count() > 0


def test_complete_rows_pass_imputation_without_a_shuffle(hot):
    out = cleaning.impute_names(hot, cleaning.learn_names(hot, ["place"]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    whole = plan.split("\n:- ")[1].split("\n+- ")[0]
    assert "Join" not in whole


def test_skewed_lookup_join_is_split(spark, hot):
    """Without broadcasts a hot product's join partition is cut into pieces."""
    lines = hot.select(F.col("Product").alias("product_id"), "Sales", "place")
    dimension = lines.groupBy("product_id").agg(F.count(F.lit(1)).alias("stock"))
    dimension = durable(dimension, "dimension")
    with settings(
        spark,
        **{
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
            "spark.sql.shuffle.partitions": "12",
        },
    ):
        joined = lines.repartition(6).join(dimension, "product_id", "left")
        assert len(joined.collect()) == 60_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_no_broadcast_without_known_size(spark, hot):
    """With broadcasts off by size, views fall back to shuffled joins and give the same rows."""
    flat = hot.limit(3000)
    built = {
        name: durable(df, name) for name, df in star.build_star(durable(flat, "some"), ["place"]).items()
    }
    usual = rows(star.product_summary(built))
    with settings(
        spark,
        **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"},
    ):
        summary = star.product_summary(built)
        assert "BroadcastHashJoin" not in summary._jdf.queryExecution().executedPlan().toString()
        assert rows(summary) == usual


class Session:
    """Only the settings of a session."""

    def __init__(self, **values):
        self.conf = {k.replace("_", "."): v for k, v in values.items()}


def test_stage_tables_use_the_shared_folder(spark):
    shared = Session(spark_checkpoint_dir="hdfs://warehouse/stage/", spark_master="yarn")
    assert stage_root(shared) == "hdfs://warehouse/stage"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage_root(Session(spark_master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage_root(Session(spark_master="yarn", spark_sql_warehouse_dir="file:/srv/warehouse"))
    named = Session(spark_master="yarn", spark_sql_warehouse_dir="s3a://tables/warehouse")
    assert stage_root(named) == "s3a://tables/warehouse/_stages"
    alone = Session(spark_master="local[4]", spark_sql_warehouse_dir="file:/srv/warehouse")
    assert stage_root(alone) == "file:/srv/warehouse/_stages"
    table = durable(spark.range(5), "five")
    assert stage_root(spark) in table.inputFiles()[0] and table.count() == 5


def test_filters_reach_the_scan(spark, hot):
    plan = sales.dashboard_filter(hot, "East", "Clothing")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Region,East)" in plan and "EqualTo(Category,Clothing)" in plan
    pruned = products.category_contribution(hot)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Category:string,Sales:decimal(12,2)>" in pruned
