from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from conftest import rows
from pyspark.sql import functions as F
from star_fixture import CALL_SCHEMA, base_rows, call, calls_frame, make_star, run_calls

from ledgerline.streaming.order_feed import order_feed, read_star, start_star


def test_feed_equals_single_calls(spark, tmp_path):
    path, source = str(tmp_path / "star"), str(tmp_path / "calls")
    start_star(make_star(spark), path)
    first = [call(1, order_code="N1", quantity=3), call(2, order_code="N2", customer_code="C5", region_name="North")]
    second = [
        call(3, order_code="N1", product_name="Lamp", category_name="Home", price_per_unit=D("9.00")),
        call(4, order_code="N3", customer_code="C5", customer_name="Eve", order_date=dt.date(2024, 7, 1)),
        call(5, quantity=0),
    ]
    for calls in (first, second):
        calls_frame(spark, calls).coalesce(1).write.mode("append").parquet(source)
        query = order_feed(spark, source, CALL_SCHEMA, ["seq"], path, str(tmp_path / "progress"))
        query.awaitTermination(300)
        assert query.exception() is None
    got = read_star(spark, path, 2)
    expected = run_calls(run_calls(base_rows(), first), second)
    for name in ("regions", "categories"):
        assert rows(got[name]) == sorted(expected[name], key=repr)
    # times are the batch's own
    for name in ("customers", "products", "orders", "order_items"):
        columns = [c for c in got[name].columns if not c.endswith("_at")]
        keep = [i for i, c in enumerate(got[name].columns) if not c.endswith("_at")]
        wanted = [tuple(r[i] for i in keep) for r in expected[name]]
        assert rows(got[name], *columns) == sorted(wanted, key=repr), name
    assert read_star(spark, path, 1)["orders"].count() == 5
    assert spark.read.parquet(f"{path}/rejects").select(F.col("reason")).distinct().collect()[0][0] == "quantity > 0"
