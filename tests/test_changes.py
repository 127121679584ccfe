from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F
from star_fixture import CHANGED, base_rows, call, calls_frame, make_star, run_calls

from ledgerline.operators import changes, star
from ledgerline import session
from ledgerline.session import durable, stage_folder


@pytest.fixture(scope="module")
def at():
    return F.lit(CHANGED).cast("timestamp")


def same_tables(got, expected, names=("categories", "regions", "customers", "products", "orders", "order_items")):
    for name in names:
        assert rows(got[name]) == sorted(expected[name], key=repr), name


@pytest.mark.parametrize("seed", range(3))
def test_order_batch_equals_single_calls(spark, at, seed):
    rng = random.Random(seed)
    calls = []
    for seq in range(120):
        hot = rng.random() < 0.4  # one customer and product in much of the batch
        calls.append(
            call(
                seq,
                order_code=f"N{rng.randint(1, 40)}" if rng.random() < 0.9 else "O10",
                order_date=dt.date(2024, 6, rng.randint(1, 28)),
                customer_code="C1" if hot else f"C{rng.randint(1, 12)}",
                customer_name=f"name {seq}",
                city=rng.choice([None, "Ulm", "Jena"]),
                product_name="Shirt" if hot else rng.choice(["TV", "Lamp", "Desk", "Chair"]),
                category_name=rng.choice(["Clothing", "Home", "Electronics", "Office"]),
                quantity=rng.randint(-1, 6),
                price_per_unit=D(rng.randint(-1, 50)),
                sales=D(rng.randint(0, 90)),
                profit=D(rng.randint(-9, 9)) if rng.random() < 0.95 else None,
                region_name=rng.choice(["East", "South", "North"]),
            )
        )
    shuffled = calls[:]
    rng.shuffle(shuffled)
    out = changes.apply_orders(make_star(spark), calls_frame(spark, shuffled), ["seq"], at)
    expected = run_calls(base_rows(), calls)
    same_tables(out.tables, expected)
    kept = len(expected["order_items"]) - len(base_rows()["order_items"])
    assert out.rejects.count() == len(calls) - kept
    # stock falls exactly by the inserted units
    inserted = out.added["order_items"].agg(F.sum("quantity")).first()[0] or 0
    new_products = out.tables["products"].count() - 2
    assert out.tables["products"].agg(F.sum("stock")).first()[0] == 102 + 100 * new_products - inserted


def test_a_batch_sent_again_counts_once(spark, at):
    calls = [call(i, order_code=f"N{i % 4}", customer_code=f"C{i % 3}", product_name=("Shirt", "Desk")[i % 2]) for i in range(12)]
    bad, late = call(20, quantity=0), call(30, order_code="N9", city=None)
    empty = changes.empty_ledger(spark)
    once = changes.apply_orders_once(make_star(spark), calls_frame(spark, [*calls, bad]), ["seq"], at, empty)
    assert once.tables["order_ledger"].count() == 12
    stored = {name: durable(table, name) for name, table in once.tables.items()}
    again = changes.apply_orders_once(
        stored, calls_frame(spark, [*calls[::-1], bad, late]), ["seq"], at, stored["order_ledger"]
    )
    same_tables(again.tables, run_calls(base_rows(), [*calls, late]))
    assert rows(again.rejects, "seq", "reason") == [(20, "quantity > 0")]
    assert again.added["order_items"].count() == 1 and again.tables["order_ledger"].count() == 13


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def stage_names(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []


def some_calls(n):
    return [
        call(
            seq, order_code=f"N{seq % 17}" if seq % 9 else "O10", customer_code=f"C{seq % 5}", customer_name=f"name {seq}",
            product_name=("Shirt", "TV", "Lamp", "Desk")[seq % 4], category_name=("Clothing", "Home")[seq % 2],
            quantity=seq % 7, region_name=("East", "South")[seq % 2],
        )
        for seq in range(n)
    ]


def test_large_batch_is_applied_in_parts(spark, at, monkeypatch):
    """The same tables in eight parts; neither shuffle files nor numbered calls stay beside them."""
    calls = some_calls(150)
    batch = durable(calls_frame(spark, calls[::-1]), "batch")
    monkeypatch.setattr(session, "PART_BYTES", 1)
    assert session.parts_of(batch) == 8
    spark._jvm.System.gc()
    files, numbered = shuffle_files(spark), sum(n.startswith("call-") for n in stage_names(spark))
    out = changes.apply_orders(make_star(spark), batch, ["seq"], at, store=True)
    assert shuffle_files(spark) <= files
    assert sum(n.startswith("call-") for n in stage_names(spark)) == numbered
    same_tables(out.tables, run_calls(base_rows(), calls))


def test_large_batch_sent_again_in_parts(spark, at, monkeypatch):
    calls, late = some_calls(60), call(90, order_code="N99", city=None)
    monkeypatch.setattr(session, "PART_BYTES", 1)
    before = set(stage_names(spark))
    batch = durable(calls_frame(spark, [*calls, calls[1]]), "batch")  # one call comes twice in the first batch
    once = changes.apply_orders_once(make_star(spark), batch, ["seq"], at, changes.empty_ledger(spark))
    assert not any(n.startswith("fresh-calls") for n in {*stage_names(spark)} - before)  # a stored batch is not written again
    kept = sum(c[8] > 0 for c in calls)
    assert once.tables["order_ledger"].count() == kept and once.added["order_items"].count() == kept + 1
    keys = {r["call_key"] for r in once.tables["order_ledger"].collect()}
    expected = {r[0] for r in batch.filter("quantity > 0").select(changes.call_key(["seq"])).collect()}
    assert keys == expected
    again = changes.apply_orders_once(once.tables, batch, ["seq"], at, once.tables["order_ledger"])
    same_tables(again.tables, {n: [tuple(r) for r in once.tables[n].collect()] for n in base_rows()})
    assert again.added["order_items"].isEmpty() and again.tables["order_ledger"].count() == kept
    more = durable(calls_frame(spark, [*calls[:20], late, calls[0]]), "batch")
    third = changes.apply_orders_once(again.tables, more, ["seq"], at, again.tables["order_ledger"])
    assert rows(third.added["orders"], "order_code") == [("N99",)] and third.added["order_items"].count() == 1


def test_rejected_calls_name_the_rule(spark, at):
    bad = [
        call(1, quantity=0),
        call(2, price_per_unit=D(-1)),
        call(3, sales=D(-1)),
        call(4, customer_code=None),
    ]
    out = changes.apply_orders(make_star(spark), calls_frame(spark, bad), ["seq"], at)
    assert [r[0] for r in sorted(rows(out.rejects, "reason", "seq"), key=lambda r: r[1])] == [
        "quantity > 0", "price_per_unit >= 0", "sales >= 0", "customer_code is missing",
    ]
    same_tables(out.tables, base_rows())


def test_full_scenario(spark, at):
    """New customer, category and product; an order; its update; its delete."""
    tables = make_star(spark)
    person = spark.createDataFrame(
        [("TEST-CUST", "Test Integration User", "Boston", "Massachusetts", 1)],
        "customer_code string, customer_name string, city string, state string, seq long",
    )
    tables = changes.add_customers(tables, person, ["seq"], at).tables
    category = spark.createDataFrame([("Custom Category", 1)], "category_name string, seq long")
    tables = changes.add_categories(tables, category, ["seq"]).tables
    product = spark.createDataFrame(
        [("Custom Test Product", "Custom Category", D("450.00"), 250, 1)],
        "product_name string, category_name string, price decimal(12,2), stock int, seq long",
    )
    tables = changes.add_products(tables, product, ["seq"], at).tables
    assert rows(tables["categories"])[-1] == (5, "Custom Category")
    order = call(
        1,
        order_code="TEST-ORDER",
        order_date=dt.date(2026, 6, 26),
        customer_code="TEST-CUST",
        customer_name="Test Integration User",
        city="Boston",
        state="Massachusetts",
        product_name="Custom Test Product",
        category_name="Custom Category",
        quantity=10,
        price_per_unit=D("450.00"),
        sales=D("4500.00"),
        profit=D("1350.00"),
    )
    tables = changes.apply_orders(tables, calls_frame(spark, [order]), ["seq"], at).tables

    def stock():
        return tables["products"].filter("product_name = 'Custom Test Product'").first()["stock"]

    assert stock() == 240
    update = spark.createDataFrame(
        [("TEST-ORDER", "Custom Test Product", 15, D("450.00"), D("6750.00"), D("2025.00"), 1)],
        "order_code string, product_name string, quantity int, price_per_unit decimal(12,2), "
        "sales decimal(12,2), profit decimal(12,2), seq long",
    )
    tables = changes.update_items(tables, update, ["seq"]).tables
    line = star.sales_summary(tables).filter("Order_ID = 'TEST-ORDER'").first()
    assert (line["Quantity"], line["Sales"], line["Region"]) == (15, D("6750.00"), "East")
    assert stock() == 240
    gone = changes.delete_orders(
        tables, spark.createDataFrame([("TEST-ORDER",), ("NO-SUCH",)], "order_code string"), at
    )
    tables = gone.tables
    assert stock() == 240
    assert star.sales_summary(tables).filter("Order_ID = 'TEST-ORDER'").isEmpty()
    log = gone.added["deleted_orders_log"].collect()
    assert [(r["log_id"], r["order_code"], r["deleted_at"]) for r in log] == [(1, "TEST-ORDER", CHANGED)]
    assert rows(gone.rejects) == [("NO-SUCH", "order does not exist")]
    assert star.check_constraints(tables).isEmpty()


def test_known_and_repeated_master_rows_are_rejected(spark, at):
    people = spark.createDataFrame(
        [("C1", "Other", "x", "y", 1), ("C9", "first", "x", "y", 2), ("C9", "second", "x", "y", 3)],
        "customer_code string, customer_name string, city string, state string, seq long",
    )
    out = changes.add_customers(make_star(spark), people, ["seq"], at)
    assert rows(out.added["customers"], "customer_id", "customer_name") == [(8, "first")]
    assert rows(out.rejects) == [("C1", 1, "already exists"), ("C9", 1, "repeated in the batch")]
    assert rows(out.tables["customers"].filter("customer_code = 'C1'"), "customer_name") == [("Ann",)]
    stuff = spark.createDataFrame(
        [("Shirt", "Ghost", D("1.00"), 1), ("Lamp", "Home", D("5.00"), 2)],
        "product_name string, category_name string, price decimal(12,2), seq long",
    )
    made = changes.add_products(make_star(spark), stuff, ["seq"], at)
    assert rows(made.added["products"], "product_id", "product_name", "category_id", "stock") == [(6, "Lamp", 5, 100)]
    assert rows(made.added["categories"]) == [(5, "Home")]  # nothing for the rejected product


def test_item_updates(spark):
    updates = spark.createDataFrame(
        [
            ("O10", "Shirt", 9, D("1.00"), D("9.00"), D("1.00"), 1),
            ("O10", "Shirt", 8, D("2.00"), D("16.00"), D("2.00"), 2),
            ("O99", "Shirt", 1, D("1.00"), D("1.00"), D("1.00"), 3),
            ("O10", "Ghost", 1, D("1.00"), D("1.00"), D("1.00"), 4),
            ("O11", "TV", 1, D("1.00"), D("1.00"), D("1.00"), 5),
            ("O11", "Shirt", 0, D("1.00"), D("1.00"), D("1.00"), 6),
        ],
        "order_code string, product_name string, quantity int, price_per_unit decimal(12,2), "
        "sales decimal(12,2), profit decimal(12,2), seq long",
    )
    out = changes.update_items(make_star(spark), updates, ["seq"])
    items = {r["order_item_id"]: r for r in out.tables["order_items"].collect()}
    assert items[20]["quantity"] == items[21]["quantity"] == 8  # all items of the pair, last update
    assert items[22]["quantity"] == 1
    assert rows(out.rejects) == [
        ("O10", "Ghost", "product does not exist"),
        ("O11", "Shirt", "quantity > 0"),
        ("O99", "Shirt", "order does not exist"),
    ]


def test_delete_log_continues(spark, at):
    first = changes.delete_orders(make_star(spark), spark.createDataFrame([("O10",)], "order_code string"), at)
    second = changes.delete_orders(
        first.tables,
        spark.createDataFrame([("O11",), ("O11",)], "order_code string"),
        at,
        log=first.added["deleted_orders_log"],
    )
    assert rows(second.tables["deleted_orders_log"], "log_id", "order_code") == [(1, "O10"), (2, "O11")]
    assert rows(second.tables["orders"], "order_code") == [("EMPTY",)]
    assert second.tables["order_items"].isEmpty()


def test_rows_with_gaps_are_turned_away(spark, at):
    tables = make_star(spark)
    customers = spark.createDataFrame(
        [(1, None, "x", None, None), (2, "NEW", None, None, None), (3, "NEW", "Ada", None, None)],
        "seq long, customer_code string, customer_name string, city string, state string",
    )
    got = changes.add_customers(tables, customers, ["seq"], at)
    assert rows(got.rejects) == sorted(
        [(None, 1, "customer_code is missing"), ("NEW", 1, "customer_name is missing")], key=repr
    )
    assert rows(got.added["customers"], "customer_code", "customer_name") == [("NEW", "Ada")]
    products = spark.createDataFrame(
        [(1, "P1", None, D("1.00")), (2, "P2", "Toys", None)],
        "seq long, product_name string, category_name string, price decimal(12,2)",
    )
    got = changes.add_products(tables, products, ["seq"], at)
    assert rows(got.rejects, "reason") == [("category_name is missing",), ("price is missing",)]
    assert got.added["products"].isEmpty() and got.added["categories"].isEmpty()
    updates = spark.createDataFrame(
        [(1, "O10", "Shirt", None, D("1.00"), D("1.00"), D("1.00"))],
        "seq long, order_code string, product_name string, quantity int, price_per_unit decimal(12,2), "
        "sales decimal(12,2), profit decimal(12,2)",
    )
    got = changes.update_items(tables, updates, ["seq"])
    assert rows(got.rejects) == [("O10", "Shirt", "quantity is missing")]
    assert rows(got.tables["order_items"]) == rows(tables["order_items"])


def test_item_updates_run_on_the_whole_star(spark):
    """All lines of all orders come back, updates after the cutover apply, and both rejects occur."""
    from __spark_entry__ import queries

    folder = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    items = queries()["apply_item_updates_star"](spark, folder)
    assert items.count() == lines.count()
    returned = lines.filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct()
    whole = items.filter("sales = floor(sales)").select("order_id", "product_id").distinct()
    assert returned.exceptAll(whole.toDF(*returned.columns)).count() == 0
    rejects = queries()["item_update_rejects_star"](spark, folder)
    reasons = {r[0] for r in rejects.select("reason").distinct().collect()}
    assert reasons == {"order does not exist", "product does not exist"}
    assert rejects.filter("order_code NOT LIKE 'X%' AND product_name NOT LIKE '% (old)'").count() == 0
