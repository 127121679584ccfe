from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import rows
from fixtures import placed, record, sales
from pyspark.sql import functions as F

from ledgerline.operators import cleaning
from ledgerline.plans.pipeline import process_dataset, process_raw_data
from ledgerline.sources import readers
from ledgerline.sources.schemas import DERIVED_COLUMNS, REQUIRED_COLUMNS

ORDER = ["place"]


def test_margins_need_more_than_five_complete_rows(spark):
    five = [record(Order_ID=f"e{i}", Category="Electronics", Profit=D("1.00")) for i in range(5)]
    six = [record(Order_ID=f"f{i}", Category="Furniture", Profit=D(i)) for i in range(6)]
    free = [record(Order_ID="z", Category="Furniture", Sales=D(0), Profit=D(99))]
    got = dict(rows(cleaning.learn_margins(placed(spark, *five, *six, *free))))
    assert got["Electronics"] == 0.235
    assert abs(got["Furniture"] - 0.25) < 1e-12  # mean of 0, .1, ... .5
    assert got["Clothing"] == 0.40 and got["Office Supplies"] == 0.50


def test_imputation_rules_and_audit(spark):
    data = [
        record(Order_ID="a", Profit=None, Sales=D("123456.78"), Category="Clothing"),
        record(Order_ID="b", Profit=None, Sales=D("12.00"), Category="Garden"),
        record(Order_ID="c", Customer_Name="NA", Customer_ID="C9"),
        record(Order_ID="d", Customer_Name="Zoe", Customer_ID="C9"),
        record(Order_ID="e", Customer_Name="Yan", Customer_ID="C9"),
        record(Order_ID="f", Customer_Name=None, Customer_ID="C0"),
        record(Order_ID="g", City="", State="Tie"),
        record(Order_ID="h", City="Bern", State="Tie"),
        record(Order_ID="i", City="Aarau", State="Tie"),
        record(Order_ID="j", City="null", State="Nowhere"),
        record(Order_ID="k", City="NaN", State=None),
    ]
    df = placed(spark, *data)
    imputed = cleaning.impute(df, cleaning.learn_lookups(df, ORDER))
    got = {r["Order_ID"]: r for r in imputed.collect()}
    assert len(got) == len(data)
    assert got["a"]["Profit"] == D("49382.71")  # 40 %
    assert got["b"]["Profit"] == D("3.00")  # unknown category: 25 %
    assert got["c"]["Customer_Name"] == "Zoe"  # first on record
    assert got["f"]["Customer_Name"] == "Valued Partner"
    assert got["g"]["City"] == "Aarau"  # tie: first in the alphabet
    assert got["j"]["City"] == got["k"]["City"] == "Corporate Headquarters"

    at = F.lit("2026-01-02 03:04:05").cast("timestamp")
    log = sorted(cleaning.audit_log(imputed, ORDER, at).collect(), key=lambda r: r["Audit_ID"])
    assert [r["Audit_ID"] for r in log] == [f"AUD-{1000 + i}" for i in range(1, 8)]
    assert [r["Order_ID"] for r in log] == ["a", "b", "c", "f", "g", "j", "k"]
    assert {r["Time"] for r in log} == {"03:04:05"} and {r["Status"] for r in log} == {"Resolved"}
    assert log[0]["Issue"] == "Missing Profit (NA value detected)"
    assert log[0]["Action"] == "Imputed profit (₹49,382.71) using 40% average margin for Clothing"
    assert log[1]["Action"] == "Imputed profit (₹3) using 25% average margin for Garden"
    assert log[2]["Action"] == "Mapped ID 'C9' to database record 'Zoe'"
    assert log[4]["Action"] == "Resolved geographic scope to 'Aarau' from State context 'Tie'"
    assert log[6]["Action"].endswith("from State context 'NA'")


def test_seven_significant_digits(spark):
    from ledgerline.functions.text import seven_digits

    amounts = ["12.50", "100.00", "12345.67", "123456.78", "1234567.89", "-1142.61", "0.00", "99999.99"]
    df = spark.createDataFrame([(D(a),) for a in amounts], "a decimal(14,2)")
    got = [r[0] for r in df.select(seven_digits(F.col("a"))).collect()]
    assert got == ["12.5", "100", "12,345.67", "123,456.8", "1,234,568", "-1,142.61", "0", "99,999.99"]


def test_first_row_per_order_survives(spark):
    data = [
        record(Order_ID="x", Product="first"),
        record(Order_ID="x", Product="second"),
        record(Order_ID=None, Product="n1"),
        record(Order_ID=None, Product="n2"),
    ]
    df = placed(spark, *data)
    once = cleaning.remove_duplicates(df, ORDER)
    assert rows(once, "Product") == [("first",), ("n1",)]
    assert rows(cleaning.remove_duplicates(once, ORDER)) == rows(once)
    both = cleaning.remove_duplicates(df, ORDER, ("Order_ID", "Product"))
    assert both.count() == 4


def test_dedupe_limits_each_group_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS Order_ID", "id AS place")
    plan = cleaning.remove_duplicates(df, ORDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_invalid_and_null_rows_leave(spark):
    data = [
        record(Order_ID="ok"),
        record(Order_ID="q", Quantity=-1),
        record(Order_ID="p", Price=D(0)),
        record(Order_ID="s", Sales=D(0)),
        record(Order_ID="n", Quantity=None),
    ]
    assert rows(cleaning.valid_rows(placed(spark, *data)), "Order_ID") == [("ok",)]


def test_typing(spark):
    raw = spark.createDataFrame(
        [
            ("2024-01-05", "3", "1.50"),
            ("2024-1-5", "3.7", "NA"),
            ("20240105", "x", "1e2"),
            ("2024/01/05", None, "NaN"),
            ("tomorrow", "", ""),
        ],
        "Order_Date string, Quantity string, Price string",
    )
    got = cleaning.convert_types(raw).collect()
    day = dt.date(2024, 1, 5)
    assert [r["Order_Date"] for r in got] == [day, day, day, day, None]
    assert [r["Quantity"] for r in got] == [3, 3, None, None, None]
    assert [r["Price"] for r in got] == [D("1.50"), None, D("100.00"), None, None]


def test_outlier_flags_match_numpy(spark):
    import numpy as np

    values = [10, 11, 12, 13, 14, 15, 16, 500, -300, 12, 12, 13]
    data = [record(Order_ID=f"o{i}", Sales=D(v), Profit=D(v) / 2) for i, v in enumerate(values)]
    got = {r["Order_ID"]: r["Is_Outlier"] for r in cleaning.detect_outliers(sales(spark, *data)).collect()}
    q1, q3 = np.quantile(values, [0.25, 0.75])
    spread = q3 - q1
    for i, v in enumerate(values):
        assert got[f"o{i}"] == (v < q1 - 1.5 * spread or v > q3 + 1.5 * spread)


def test_normalize(spark):
    data = [record(Order_ID=f"o{i}", Sales=D(v)) for i, v in enumerate((5, 10, 15))]
    out = cleaning.normalize(sales(spark, *data), ("Sales", "Profit", "Missing"))
    assert rows(out, "Sales_Norm") == [(0.0,), (0.5,), (1.0,)]
    assert rows(out.distinct(), "Profit_Norm")[0] == (0.0,)
    assert "Missing_Norm" not in out.columns


def _csv(tmp_path, lines):
    path = tmp_path / "raw.csv"
    path.write_text("\n".join([",".join(REQUIRED_COLUMNS), *lines]) + "\n")
    return str(path)


def test_csv_to_clean_table(spark, tmp_path):
    lines = [
        "EC-1,2024-01-01,C1,Ann,Pen,Office Supplies,2,5,10,NA,Bonn,NRW,West",
        "EC-2,2024-02-01,C1,,Pen,Office Supplies,1,5,5,2.5,,NRW,West",
        "EC-3,2024-03-01,C2,Bob,Desk,Furniture,-1,100,100,10,Bonn,NRW,West",
        "EC-4,2024-04-01,C2,Bob,Desk,Furniture,1,0,0,0,Bonn,NRW,West",
        "EC-1,2024-01-01,C1,Ann,Pen,Office Supplies,2,5,10,NA,Bonn,NRW,West",
        "EC-5,2024-05-01,C3,Cy,Lamp,Furniture,1,40,40,-2,Kiel,SH,North",
    ]
    out = process_dataset(spark, _csv(tmp_path, lines))
    assert out.data.columns == [*REQUIRED_COLUMNS, *DERIVED_COLUMNS]
    got = {r["Order_ID"]: r for r in out.data.collect()}
    assert sorted(got) == ["EC-1", "EC-2", "EC-5"]
    assert got["EC-1"]["Profit"] == D("5.00") and got["EC-2"]["Customer_Name"] == "Ann"
    assert got["EC-2"]["City"] == "Bonn" and got["EC-5"]["Profit_Margin"] == -0.05
    # every imputed value is logged, that of the later duplicate too
    assert rows(out.audit_log, "Order_ID") == [("EC-1",), ("EC-1",), ("EC-2",), ("EC-2",)]
    stats = out.stats.first()
    assert (stats["Raw_Rows"], stats["Duplicates_Removed"], stats["Invalid_Removed"]) == (6, 1, 2)


def test_sources(spark, tmp_path):
    assert readers.read_sales_csv(spark, str(tmp_path / "none.csv")) is None
    assert process_dataset(spark, str(tmp_path / "none.csv")) is None
    short = sales(spark, record()).drop("City", "Price")
    assert readers.missing_columns(short) == ["Price", "City"]
    assert not readers.has_required_columns(short) and not readers.has_required_columns(None)
    assert process_raw_data(short, ["Order_ID"]) is None
    report = {r["column_name"]: r["present"] for r in readers.column_type_report(short).collect()}
    assert report["City"] is False and report["Sales"] is True

    full = sales(spark, record())

    def broken():
        raise RuntimeError("no database")

    assert readers.load_sales(spark, broken, lambda: full).count() == 1
    assert readers.load_sales(spark, lambda: full.limit(0), lambda: full).count() == 1
    nothing = readers.load_sales(spark, None, lambda: None)
    assert nothing.count() == 0 and nothing.columns == list(REQUIRED_COLUMNS)
    tokens = spark.createDataFrame([("NA",), ("null",), ("",), ("ok",)], "a string")
    assert [r[0] for r in readers.null_tokens(tokens).collect()] == [None, None, None, "ok"]


def test_file_order_follows_the_file(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text("n\n" + "\n".join(str(i) for i in range(20000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = readers.with_file_order(readers.read_sales_csv(spark, str(path)))
        assert df.rdd.getNumPartitions() > 1
        got = [int(r["n"]) for r in df.orderBy(*readers.FILE_ORDER).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(20000))


def test_large_amounts_stay_and_unreadable_values_are_told(spark):
    raw = spark.createDataFrame(
        [("1", "12345678901.25", "3000000000"), ("2", "abc", "2.7"), ("3", None, "NA")],
        "Order_ID string, Sales string, Quantity string",
    )
    typed = {r.Order_ID: r for r in cleaning.convert_types(raw).collect()}
    assert str(typed["1"].Sales) == "12345678901.25" and typed["1"].Quantity == 3_000_000_000
    assert typed["2"].Sales is None and typed["2"].Quantity == 2
    assert [(r.Order_ID, r.Unread) for r in cleaning.unreadable(raw).collect()] == [("2", "Sales")]


def test_files_with_other_headers_fail_instead_of_mixing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Order_ID,Quantity,Price\n1,2,7\n")
    (tmp_path / "b.csv").write_text("Order_ID,Price,Quantity\n2,7,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_sales_csv(spark, str(tmp_path)).collect()


def test_files_with_other_headers_are_read_by_name(spark, tmp_path):
    texts = {
        "a.csv": 'x,y\n1,"a,b"\n2,c\n',
        "b b.csv": "y,x\nd,3\ne\nf,5,6\n",
        "c.csv": "x,z\n7,q\n",
        "d.csv": "x,X\n8,9\n",
        "e.csv": "",
        "f.csv": "y,x\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found = readers.read_sales_files(spark, str(tmp_path))
    assert rows(found.data, "x", "y", "z") == sorted(
        [("1", "a,b", None), ("2", "c", None), ("3", "d", None), ("7", None, "q")], key=repr
    )
    lost = {(r["file_path"].rpartition("/")[2], r["line"]) for r in found.rejects.collect()}
    assert lost == {("b%20b.csv", "e"), ("b%20b.csv", "f,5,6"), ("d.csv", "x,X")}
    assert found.rejects.select("line").count() == 3 and found.data.select("y").count() == 4
    assert readers.read_sales_files(spark, str(tmp_path / "none")) is None
