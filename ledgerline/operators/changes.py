"""Batches of changes to the star: new master data, orders, item updates, order deletes.

Every job takes tables and a batch and returns new tables and what it turned away. A batch
carries columns that put its rows in sequence (``seq``): where a single call would come
first or last, the first or last row in sequence decides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.ranking import first_by, last_by, number_rows
from ledgerline.functions.semantics import asc
from ledgerline.session import discard, durable, durable_parts, is_stage, part_of, parts_of
from ledgerline.sources.schemas import DEFAULT_STOCK

Star = Mapping[str, DataFrame]

# The parameters of one order call.
ORDER_COLUMNS = (
    "order_code",
    "order_date",
    "customer_code",
    "customer_name",
    "city",
    "state",
    "product_name",
    "category_name",
    "quantity",
    "price_per_unit",
    "sales",
    "profit",
    "region_name",
)
_OPTIONAL = {"city", "state"}

EXISTS = "already exists"
REPEATED = "repeated in the batch"
NO_ORDER = "order does not exist"
NO_PRODUCT = "product does not exist"


@dataclass(frozen=True)
class Changed:
    tables: dict[str, DataFrame]  # the star after the batch
    rejects: DataFrame  # what was turned away, with a reason
    added: dict[str, DataFrame] = field(default_factory=dict)  # new rows only


def _last_id(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column))


def _after(star: Star, **changes: DataFrame) -> dict[str, DataFrame]:
    return {**star, **changes}


# --- master data --------------------------------------------------------------------------


def _gap(columns: Sequence[str]) -> Column:
    """The first of the columns that is NULL, as a reason; NULL when none is."""
    return F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in columns])


def _split_new(
    batch: DataFrame,
    key: str,
    values: Sequence[str],
    existing: DataFrame,
    seq: Sequence[str],
    label: str,
    required: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """New keys with their first sound row's values, and per key how many rows were turned away.

    Rows without a key or a ``required`` value are turned away before anything is numbered.

    Rows are combined per key before the shuffle, so a key that fills the batch is one row.
    """
    place = F.struct(*seq)
    judged = batch.withColumn("gap", _gap((key, *required)))
    gaps = judged.filter("gap IS NOT NULL").groupBy(F.col(key).alias("key"), F.col("gap").alias("reason")).agg(
        F.count(F.lit(1)).alias("rejected_rows")
    )
    per_key = durable(
        judged.filter("gap IS NULL").groupBy(key).agg(
            first_by(F.struct(F.lit(1).alias("one"), *values), seq).alias("first"),
            F.min(place).alias("first_place"),
            F.count(F.lit(1)).alias("rows"),
        ),
        label,
    )
    known = existing.select(key)
    new = per_key.join(known, key, "left_anti")
    old = per_key.join(known, key, "left_semi")
    rejects = old.select(
        F.col(key).alias("key"), F.col("rows").alias("rejected_rows"), F.lit(EXISTS).alias("reason")
    ).unionByName(
        new.filter("rows > 1").select(
            F.col(key).alias("key"),
            (F.col("rows") - 1).alias("rejected_rows"),
            F.lit(REPEATED).alias("reason"),
        )
    ).unionByName(gaps)
    return new.select(key, "first_place", *[F.col(f"first.{v}").alias(v) for v in values]), rejects


def add_customers(star: Star, batch: DataFrame, seq: Sequence[str], at: Column) -> Changed:
    """Insert customers (customer_code, customer_name, city, state); known codes are rejected."""
    new, rejects = _split_new(
        batch,
        "customer_code",
        ("customer_name", "city", "state"),
        star["customers"],
        seq,
        "new-customers",
        required=("customer_name",),
    )
    rows = number_rows(
        new, asc("first_place"), "customer_id", after=_last_id(star["customers"], "customer_id")
    ).select(
        "customer_id",
        "customer_code",
        "customer_name",
        "city",
        "state",
        at.alias("created_at"),
        at.alias("updated_at"),
    )
    return Changed(
        _after(star, customers=star["customers"].unionByName(rows)), rejects, {"customers": rows}
    )


def _new_names(
    names: DataFrame, table: DataFrame, name_column: str, id_column: str
) -> DataFrame:
    """Rows for names (name, first_place) the table lacks, ids in order of appearance."""
    new = names.filter(F.col(name_column).isNotNull()).join(
        table.select(name_column), name_column, "left_anti"
    )
    return number_rows(new, asc("first_place"), id_column, after=_last_id(table, id_column)).select(
        id_column, name_column
    )


def add_categories(star: Star, batch: DataFrame, seq: Sequence[str]) -> Changed:
    """Insert categories (category_name); known names are rejected."""
    new, rejects = _split_new(batch, "category_name", (), star["categories"], seq, "new-categories")
    rows = number_rows(
        new, asc("first_place"), "category_id", after=_last_id(star["categories"], "category_id")
    ).select("category_id", "category_name")
    return Changed(
        _after(star, categories=star["categories"].unionByName(rows)), rejects, {"categories": rows}
    )


def add_products(star: Star, batch: DataFrame, seq: Sequence[str], at: Column) -> Changed:
    """Insert products (product_name, category_name, price, optional stock).

    A missing category is created first, also for a product that is then accepted; known
    product names are rejected and create nothing.
    """
    if "stock" not in batch.columns:
        batch = batch.withColumn("stock", F.lit(DEFAULT_STOCK))
    new, rejects = _split_new(
        batch,
        "product_name",
        ("category_name", "price", "stock"),
        star["products"],
        seq,
        "new-products",
        required=("category_name", "price"),
    )
    wanted = new.groupBy("category_name").agg(F.min("first_place").alias("first_place"))
    new_categories = _new_names(wanted, star["categories"], "category_name", "category_id")
    categories = star["categories"].unionByName(new_categories)
    rows = (
        number_rows(
            new, asc("first_place"), "product_id", after=_last_id(star["products"], "product_id")
        )
        .join(categories, "category_name", "left")
        .select(
            "product_id",
            "product_name",
            "category_id",
            "price",
            F.coalesce("stock", F.lit(DEFAULT_STOCK)).cast("long").alias("stock"),
            at.alias("created_at"),
            at.alias("updated_at"),
        )
    )
    return Changed(
        _after(star, categories=categories, products=star["products"].unionByName(rows)),
        rejects,
        {"categories": new_categories, "products": rows},
    )


# --- orders -------------------------------------------------------------------------------


def _item_problem() -> Column:
    """First rule an item breaks, NULL when it is sound."""
    return (
        F.when(~(F.col("quantity") > 0), F.lit("quantity > 0"))
        .when(~(F.col("price_per_unit") >= 0), F.lit("price_per_unit >= 0"))
        .when(~(F.col("sales") >= 0), F.lit("sales >= 0"))
    )


def _order_problem() -> Column:
    return F.coalesce(_gap([c for c in ORDER_COLUMNS if c not in _OPTIONAL]), _item_problem())


def _sync_customers(star: Star, batch: DataFrame, seq: Sequence[str], at: Column) -> DataFrame:
    """Known customers take the last row's name and place, new ones are added."""
    latest = durable_parts(
        [
            batch.groupBy("customer_code").agg(
                last_by(F.struct("customer_name", "city", "state"), seq).alias("last"),
                F.min(F.struct(*seq)).alias("first_place"),
            )
        ],
        "batch-customers",
    )
    known = star["customers"]
    touched = F.col("last").isNotNull()

    def synced(name: str) -> Column:
        return F.when(touched, F.col(f"last.{name}")).otherwise(F.col(name)).alias(name)

    kept = known.join(latest, "customer_code", "left").select(
        "customer_id",
        "customer_code",
        synced("customer_name"),
        synced("city"),
        synced("state"),
        "created_at",
        F.when(touched, at).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    new = number_rows(
        latest.join(known.select("customer_code"), "customer_code", "left_anti"),
        asc("first_place"),
        "customer_id",
        after=_last_id(known, "customer_id"),
    ).select(
        "customer_id",
        "customer_code",
        F.col("last.customer_name").alias("customer_name"),
        F.col("last.city").alias("city"),
        F.col("last.state").alias("state"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )
    return kept.unionByName(new)


def _sync_products(
    star: Star, categories: DataFrame, batch: DataFrame, seq: Sequence[str], at: Column
) -> DataFrame:
    """Known products take the last price and keep their category; new ones start from their
    first row. Stock falls by the quantity of every inserted item and may go negative."""
    latest = durable_parts(
        [
            batch.groupBy("product_name").agg(
                last_by(F.col("price_per_unit"), seq).alias("last_price"),
                first_by(F.col("category_name"), seq).alias("category_name"),
                F.sum("quantity").alias("units"),
                F.min(F.struct(*seq)).alias("first_place"),
            )
        ],
        "batch-products",
    )
    known = star["products"]
    touched = F.col("units").isNotNull()
    changes = latest.select("product_name", "last_price", "units")
    kept = known.join(changes, "product_name", "left").select(
        "product_id",
        "product_name",
        "category_id",
        F.when(touched, F.col("last_price")).otherwise(F.col("price")).alias("price"),
        (F.col("stock") - F.coalesce("units", F.lit(0))).alias("stock"),
        "created_at",
        F.when(touched, at).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    new = (
        number_rows(
            latest.join(known.select("product_name"), "product_name", "left_anti"),
            asc("first_place"),
            "product_id",
            after=_last_id(known, "product_id"),
        )
        .join(categories, "category_name")
        .select(
            "product_id",
            "product_name",
            "category_id",
            F.col("last_price").alias("price"),
            (F.lit(DEFAULT_STOCK) - F.col("units")).alias("stock"),
            at.alias("created_at"),
            at.alias("updated_at"),
        )
    )
    return kept.unionByName(new)


def _first_places(batch: DataFrame, column: str, seq: Sequence[str]) -> DataFrame:
    return batch.groupBy(column).agg(F.min(F.struct(*seq)).alias("first_place"))


def apply_orders(star: Star, batch: DataFrame, seq: Sequence[str], at: Column, store: bool = False) -> Changed:
    """Order calls in one batch.

    Region and category: get or create. Customer: get or create, known ones take the call's
    name, city and state. Product: get or create, known ones take the call's price. Order
    header: created by the first call of an absent code and never changed. Item: always
    appended, so a batch must be applied once. Calls that break an item rule or lack a
    required value are turned away whole.

    The sound calls are sorted and numbered once; that number decides first and last
    everywhere below and gives the item ids. A large batch is numbered in parts. With ``store``
    the new orders and items are written here, items in parts, and the numbered calls dropped;
    without it they are joined when they are read.
    """
    judged = batch.withColumn("reason", _order_problem())
    rejects = judged.filter("reason IS NOT NULL")
    sound = judged.filter("reason IS NULL").select(*dict.fromkeys([*ORDER_COLUMNS, *seq]))
    calls = number_rows(sound, asc(*seq), "call", keys=seq, keep=ORDER_COLUMNS).select(*ORDER_COLUMNS, "call")
    seq = ["call"]

    regions = star["regions"].unionByName(
        _new_names(_first_places(calls, "region_name", seq), star["regions"], "region_name", "region_id")
    )
    categories = star["categories"].unionByName(
        _new_names(
            _first_places(calls, "category_name", seq), star["categories"], "category_name", "category_id"
        )
    )
    customers = _sync_customers(star, calls, seq, at)
    products = _sync_products(star, categories, calls, seq, at)

    headers = calls.groupBy("order_code").agg(
        first_by(F.struct("customer_code", "order_date", "region_name"), seq).alias("first"),
        F.min(F.struct(*seq)).alias("first_place"),
    )
    new_orders = (
        number_rows(
            headers.join(star["orders"].select("order_code"), "order_code", "left_anti"),
            asc("first_place"),
            "order_id",
            after=_last_id(star["orders"], "order_id"),
        )
        .select("order_id", "order_code", "first.*")
        .join(customers.select("customer_id", "customer_code"), "customer_code")
        .join(regions, "region_name")
        .select(
            "order_id",
            "order_code",
            "customer_id",
            "order_date",
            "region_id",
            at.alias("created_at"),
            at.alias("updated_at"),
        )
    )
    if store:
        new_orders = durable_parts([new_orders], "new-orders")
    orders = star["orders"].unionByName(new_orders)

    last_item = F.coalesce(_last_id(star["order_items"], "order_item_id").scalar(), F.lit(0))
    codes = orders.select("order_id", "order_code")

    def items(calls: DataFrame, codes: DataFrame) -> DataFrame:
        return (
            calls.withColumn("order_item_id", last_item + F.col("call"))
            .join(products.select("product_id", "product_name"), "product_name")
            .join(codes, "order_code")  # last, so that stored items of an order lie together
            .select(
                "order_item_id",
                "order_id",
                "product_id",
                "quantity",
                "price_per_unit",
                "sales",
                "profit",
            )
        )

    new_items = items(calls, codes)
    if store:
        parts = parts_of(batch)
        some = [part_of("order_code", i, parts) for i in range(parts)]
        new_items = durable_parts((items(calls.filter(mine), codes.filter(mine)) for mine in some), "new-items")
        discard(calls)
    tables = _after(
        star,
        regions=regions,
        categories=categories,
        customers=customers,
        products=products,
        orders=orders,
        order_items=star["order_items"].unionByName(new_items),
    )
    return Changed(tables, rejects, {"orders": new_orders, "order_items": new_items})


def call_key(seq: Sequence[str]) -> Column:
    """What tells one order call from another: all its parameters and its place in the feed."""
    return F.sha2(F.to_json(F.struct(*dict.fromkeys([*ORDER_COLUMNS, *seq]))), 256)


def apply_orders_once(star: Star, batch: DataFrame, seq: Sequence[str], at: Column, ledger: DataFrame) -> Changed:
    """``apply_orders`` for a batch that may be sent again, whole or in part.

    ``ledger`` (call_key string, applied_at timestamp) names the calls that were applied before; they are
    taken out before items append and stock falls. Calls that are turned away never enter it, so they are
    turned away again. ``tables`` and ``added`` hold the ledger as ``order_ledger``; it is written together
    with the star, or a batch whose write was lost would count as applied. Equal calls within one batch are
    separate calls, as in ``apply_orders``.
    """
    fresh = _fresh_calls(batch, seq, ledger)
    changed = apply_orders(star, fresh, seq, at, store=True)
    keys = fresh.filter(_order_problem().isNull()).select(F.unhex(call_key(seq)).alias("key")).distinct()
    entered = durable_parts(
        [keys.select(F.lower(F.hex("key")).alias("call_key"), at.alias("applied_at"))], "entered-calls"
    )
    return Changed(
        {**changed.tables, "order_ledger": ledger.unionByName(entered)},
        changed.rejects,
        {**changed.added, "order_ledger": entered},
    )


def _fresh_calls(batch: DataFrame, seq: Sequence[str], ledger: DataFrame) -> DataFrame:
    """The calls that the ledger does not name, written once: the same calls must be applied and entered.

    Keys are compared by themselves, as bytes, and in parts; whole calls move only if some but not all are fresh.
    """
    if ledger.isEmpty():
        return batch if is_stage(batch) else durable_parts([batch], "fresh-calls")
    sent = durable_parts([batch.select(F.unhex(call_key(seq)).alias("key"))], "sent-keys")
    parts = parts_of(sent)
    known = ledger.select(F.unhex("call_key").alias("key"))
    new = durable_parts(
        (
            sent.filter(part_of("key", i, parts)).join(known.filter(part_of("key", i, parts)), "key", "left_anti")
            for i in range(parts)
        ),
        "new-keys",
    )
    discard(sent)
    if new.isEmpty():
        fresh = batch.sparkSession.createDataFrame([], batch.schema)
    else:
        keyed = batch.withColumn("key", F.unhex(call_key(seq)))
        fresh = durable_parts([keyed.join(new, "key", "left_semi").drop("key")], "fresh-calls")
    discard(new)
    return fresh


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "call_key string, applied_at timestamp")


def update_items(star: Star, updates: DataFrame, seq: Sequence[str]) -> Changed:
    """Set quantity, price, sales and profit on all items of an (order, product).

    Columns: order_code, product_name, quantity, price_per_unit, sales, profit. The last
    update of a pair counts. Unknown orders or products and broken item rules are turned
    away; stock stays as it is.
    """
    values = ("quantity", "price_per_unit", "sales", "profit")
    needed = ("order_code", "product_name", *values)
    judged = updates.withColumn("problem", F.coalesce(_gap(needed), _item_problem()))
    last = judged.filter("problem IS NULL").groupBy("order_code", "product_name").agg(
        last_by(F.struct(*values), seq).alias("new")
    )
    resolved = (
        last.join(star["orders"].select("order_code", "order_id"), "order_code", "left")
        .join(star["products"].select("product_name", "product_id"), "product_name", "left")
    )
    missing = F.when(F.col("order_id").isNull(), F.lit(NO_ORDER)).when(
        F.col("product_id").isNull(), F.lit(NO_PRODUCT)
    )
    resolved = durable(resolved.withColumn("reason", missing), "item-updates")
    rejects = (
        resolved.filter("reason IS NOT NULL")
        .select("order_code", "product_name", "reason")
        .unionByName(
            judged.filter("problem IS NOT NULL").select(
                "order_code", "product_name", F.col("problem").alias("reason")
            )
        )
    )
    good = resolved.filter("reason IS NULL").select("order_id", "product_id", "new")
    old = star["order_items"]
    changed = F.col("new").isNotNull()
    items = old.join(good, ["order_id", "product_id"], "left").select(
        *[
            F.when(changed, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in old.columns
        ]
    )
    return Changed(_after(star, order_items=items), rejects)


def delete_orders(
    star: Star, codes: DataFrame, at: Column, log: DataFrame | None = None
) -> Changed:
    """Delete orders by code with their items and log each deleted order.

    Unknown codes change nothing; stock is not given back. The log rows are in ``added``.
    """
    wanted = codes.select("order_code").distinct()
    victims = durable(star["orders"].join(wanted, "order_code", "left_semi"), "deleted-orders")
    gone = victims.select("order_id")
    entries = number_rows(
        victims.select("order_id", "order_code", "customer_id", "order_date"),
        asc("order_id"),
        "log_id",
        after=_last_id(log, "log_id") if log is not None else None,
    ).select("log_id", "order_id", "order_code", "customer_id", "order_date", at.alias("deleted_at"))
    tables = _after(
        star,
        orders=star["orders"].join(gone, "order_id", "left_anti").select(*star["orders"].columns),
        order_items=star["order_items"]
        .join(gone, "order_id", "left_anti")
        .select(*star["order_items"].columns),
        deleted_orders_log=entries if log is None else log.unionByName(entries),
    )
    unknown = wanted.join(star["orders"].select("order_code"), "order_code", "left_anti").select(
        F.col("order_code"), F.lit(NO_ORDER).alias("reason")
    )
    return Changed(tables, unknown, {"deleted_orders_log": entries})
