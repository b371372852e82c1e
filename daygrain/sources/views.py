"""Views V1..V7: the driver tables re-read as sensor series, a spine and labels.

Each view is a lazy plan over the parquet scans; nothing is materialised.
Schemas are listed in FIXTURES.md section 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from daygrain.functions.exprs import dlit, finite
from daygrain.sources.tables import read_table

ITEM_FIELDS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
NESTED_KEYS = ["l_quantity", "l_extendedprice", "l_discount"]
V7_TARGETS = ["quality", "toxic"]
TRAIN_SHARE = 0.8


def sensor_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one scalar reading per row (events)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    return ev.select(
        F.col("user_id").alias("subject_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("row_id"),
        finite("value").alias("value"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        F.col("event_type").alias("category"),
    )


ORDER_KEYS = ["l_linenumber", "l_partkey", "l_suppkey"]
ORDER_ITEM_FIELDS = ITEM_FIELDS + ["l_returnflag", "p_brand"]


def sensor_orders(spark: SparkSession, sf_dir: str, fields: list[str] = ORDER_ITEM_FIELDS) -> DataFrame:
    """List sensors as one view: per order, the items sorted by (linenumber, partkey, suppkey).

    Items hold the sort keys and ``fields``; only these are read and shuffled, and ``part``
    is joined only for ``p_brand``. With all fields, V2-V5 are projections of one such view.
    Per-order lists are bounded by an order's line count, so ``collect_list`` per order is
    safe at any scale.
    """
    cols = ORDER_KEYS + [c for c in fields if c not in ORDER_KEYS]
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", *[c for c in cols if c != "p_brand"]])
    if "p_brand" in cols:
        part = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand"])
        li = li.join(part, li.l_partkey == part.p_partkey, "left")
    items = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("items"))
    return _attach_orders(spark, sf_dir, items)


def nested_items(items, fields: list[str] = ITEM_FIELDS) -> F.Column:
    return F.transform(items, lambda x: F.struct(*[x[c].alias(c) for c in fields]))


def usage_items(items) -> F.Column:
    return F.transform(items, lambda x: F.struct(x["p_brand"].alias("app_name"), x["l_quantity"].alias("total_time")))


def label_items(items) -> F.Column:
    return F.transform(items, lambda x: F.struct(x["l_returnflag"].alias("label"), x["l_discount"].alias("prob")))


def price_readings(items) -> F.Column:
    return F.transform(items, lambda x: x["l_extendedprice"])


def sensor_nested(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None,
                  fields: list[str] = ITEM_FIELDS) -> DataFrame:
    """V2: list-of-struct readings, items sorted by (linenumber, partkey, suppkey)."""
    o = orders if orders is not None else sensor_orders(spark, sf_dir, fields)
    return o.select("subject_id", "bucket", "row_id", nested_items("items", fields).alias("items"))


def sensor_array(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """V3: list-of-double readings (extended prices in item order)."""
    o = orders if orders is not None else sensor_orders(spark, sf_dir, ["l_extendedprice"])
    return o.select("subject_id", "bucket", "row_id", price_readings("items").alias("readings"))


def sensor_usage(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """V4: app usage lists, app = part brand, time = quantity."""
    o = orders if orders is not None else sensor_orders(spark, sf_dir, ["l_quantity", "p_brand"])
    return o.select("subject_id", "bucket", "row_id", usage_items("items").alias("items"))


def sensor_labels(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """V5: label/probability lists, label = return flag, prob = discount."""
    o = orders if orders is not None else sensor_orders(spark, sf_dir, ["l_returnflag", "l_discount"])
    return o.select("subject_id", "bucket", "row_id", label_items("items").alias("items"))


def _attach_orders(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    o = orders.join(cust, orders.o_custkey == cust.c_custkey, "inner")
    o = o.join(items, o.o_orderkey == items.l_orderkey, "left")
    item_type = items.schema["items"].dataType
    return o.select(
        F.col("c_nationkey").alias("subject_id"),
        F.trunc(F.to_date("o_orderdate"), "month").alias("bucket"),
        F.col("o_orderkey").alias("row_id"),
        F.coalesce(F.col("items"), F.array().cast(item_type)).alias("items"),
    )


def spine(spark: SparkSession, sf_dir: str, train_share: float = TRAIN_SHARE) -> DataFrame:
    """V6: distinct (subject, day) of V1 with a split tag; the last 20 % of the day range predicts.

    The cut-off comes from a one-row global aggregate (min/max day), joined as a
    broadcast of exactly one row.
    """
    days = (sensor_scalar(spark, sf_dir)
            .select("subject_id", F.to_date("timestamp").alias("lifelog_date"))
            .distinct())
    return spine_from_days(days, train_share)


def spine_from_days(days: DataFrame, train_share: float = TRAIN_SHARE) -> DataFrame:
    """V6 from any distinct (subject_id, lifelog_date) table, e.g. the keys of a daily aggregate."""
    rng = days.agg(F.min("lifelog_date").alias("d0"), F.max("lifelog_date").alias("d1"))
    n_days = F.datediff("d1", "d0") + 1
    cut = F.floor(n_days * dlit(train_share)).cast("int")
    return (days.crossJoin(F.broadcast(rng))
                .select("subject_id",
                        F.date_add("lifelog_date", 1).alias("sleep_date"),
                        "lifelog_date",
                        F.when(F.datediff("lifelog_date", "d0") < cut, F.lit("train"))
                         .otherwise(F.lit("predict")).alias("split")))


def pseudo_predictions():
    """Fixed arithmetic of document columns standing in for three models' outputs."""
    p_a = dlit(0.05) + dlit(0.9) * F.pmod(F.col("doc_id") * 7919, F.lit(1000)).cast("double") / dlit(999.0)
    p_b = dlit(1.0) / (dlit(1.0) + F.exp(-(F.ln(F.col("n_chars").cast("double") + dlit(1.0)) - dlit(7.3))))
    base = F.when(F.col("target") == "quality", dlit(0.8)).otherwise(dlit(0.1))
    p_c = base + dlit(0.05) * F.pmod(F.col("doc_id"), F.lit(3)).cast("double")
    return p_a.alias("p_a"), p_b.alias("p_b"), p_c.alias("p_c")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: long labels (key, subject, ord, target, y) plus pseudo-predictions.

    Labelled documents are ``train`` rows; documents without labels are
    ``predict`` rows with y null.
    """
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "source", "n_chars"])
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    train = (docs.join(lab, "doc_id", "inner")
                 .unpivot(["doc_id", "source", "n_chars"], V7_TARGETS, "target", "y")
                 .withColumn("split", F.lit("train")))
    pred = (docs.join(lab, "doc_id", "left_anti")
                .withColumn("target", F.explode(F.array(*[F.lit(t) for t in V7_TARGETS])))
                .withColumn("y", F.lit(None).cast("int"))
                .withColumn("split", F.lit("predict")))
    both = train.unionByName(pred)
    return both.select(
        F.col("doc_id").alias("key"),
        F.col("source").alias("subject_id"),
        F.col("doc_id").alias("ord"),
        "target",
        F.col("y").cast("int").alias("y"),
        *pseudo_predictions(),
        "split",
    )


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7 melted to the OOF layout (key, subject_id, ord, target, y, split, model, pred)."""
    v7 = labelled(spark, sf_dir)
    return v7.unpivot(["key", "subject_id", "ord", "target", "y", "split"],
                      ["p_a", "p_b", "p_c"], "model", "pred") \
             .withColumn("model", F.substring("model", 3, 1))


def document_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric readings of every document: lengths of the whole text, by key (doc_id) with its language and source."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    return docs.select(
        F.col("doc_id").alias("key"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.ln(F.col("n_chars").cast("double") + dlit(1.0)).alias("log_chars"),
        F.size(F.split(F.trim(F.col("text")), r"\s+")).cast("double").alias("n_words"),
        F.size(F.split(F.col("text"), "\n")).cast("double").alias("n_lines"),
        "lang", "source")
