"""Domain tables (bills, logs, flows, corpora) as DataFrames over the base tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2002-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bill for each order; its parties are the suppliers of its lines, in line order.

    The suppliers are joined without their address columns and gathered per order, so one shuffle
    by order key serves the parties and the due date.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    name = F.when(F.col("s_suppkey") % 50 == 0, "").otherwise(F.col("s_name"))
    lines = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    entry = F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", name.alias("name"))
    chains = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("chain"), F.max("l_shipdate").alias("due"))
    b = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(chains, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    parties = F.transform("chain", lambda x: x["name"])
    b = b.withColumn("parties", F.coalesce(parties, F.array().cast("array<string>")))
    first, last = F.try_element_at("parties", F.lit(1)), F.try_element_at("parties", F.lit(-1))
    number = F.col("o_orderkey").cast("string")
    kind = F.when(F.col("o_orderstatus") == "F", "银行承兑汇票").when(F.col("o_orderstatus") == "O", "商业承兑汇票").otherwise("银行本票")
    return b.select(
        F.col("o_orderkey").alias("bill_id"),
        F.col("c_nationkey").alias("tenant_id"),
        F.when(F.col("o_orderkey") % 97 == 0, F.concat(F.lit("DUP-"), number)).otherwise(number).alias("ticket_number"),
        kind.alias("ticket_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("issue_date"),
        F.date_format("due", "yyyy-MM-dd").alias("due_date"),
        F.round(F.col("o_totalprice") * 100, 2).alias("amount_numeric"),
        F.lit("壹百万元整").alias("amount_text"),
        F.lit("人民币").alias("currency"),
        F.col("c_name").alias("drawer"),
        F.lit("6222000000000000000").alias("drawer_account"),
        F.lit("银行").alias("drawer_bank"),
        last.alias("acceptor"),
        first.alias("payee"),
        last.alias("drawee_bank"),
        F.slice("parties", F.lit(2), F.size("parties")).alias("endorsers"),
        F.coalesce(F.datediff("due", "o_orderdate"), F.lit(0)).alias("maturity_days"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("trade_purpose"),
        F.lit("到期无条件支付").alias("acceptance_clause"),
        F.lit(None).cast("string").alias("special_remarks"),
        (F.lit(60) + F.col("o_orderkey") % 40).cast("double").alias("confidence_pct"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    ).withColumn("confidence_score", F.col("confidence_pct") / 100)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bill uploaded three times, the k-th time with its first k endorsers."""
    b = bills(spark, sf_dir)
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")
    each = b.select("*", k)
    return each.withColumn("endorsers", F.slice("endorsers", 1, F.col("k"))).withColumn("upload_time", F.col("created_at") + F.make_dt_interval(F.col("k")))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract for every second order: an amount near the bill's and one party."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == 0)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    party = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("Trader#"), F.col("o_orderkey"))).otherwise(F.col("c_name"))
    share = F.lit(1) + (F.col("o_orderkey") % 13 - 6) / 100.0
    return o.select(F.col("o_orderkey").alias("bill_id"), (F.col("o_totalprice") * 100 * share).alias("contract_amount"), party.alias("party"), F.lit("1-URGENT 货款").alias("contract_purpose"))


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 17 == 0)
    return s.select(F.col("s_name").alias("entity_name"), (F.col("s_acctbal") > 0).alias("is_active"), (F.col("s_suppkey") % 34 == 0).alias("is_global"), F.col("s_nationkey").alias("list_tenant"))


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("name"), (100 + 10 * F.col("n_nationkey")).alias("doc_quota"), (1 + F.col("n_nationkey") % 5).alias("qps_limit"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the status that their label gives; a document's tenant is its source."""
    d = table(spark, sf_dir, "documents")
    q = table(spark, sf_dir, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "failed").otherwise("processing")
    return d.join(q, "doc_id", "left").select(
        "doc_id", F.col("source").alias("tenant_id"), "text", "n_chars", F.md5("text").alias("md5_hash"), status.alias("status"), F.floor(F.col("doc_id") / 10).alias("batch_id"), (F.col("n_chars") % 7).alias("chunk_count")
    )


def query_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    route = F.when(F.col("event_type").isin("purchase", "signup"), "specialized").when(F.col("event_type") == "error", "off_topic").when(F.col("event_type") == "view", "fuzzy")
    hit = F.when(k.isNull() | (k % 10 == 0), F.lit(None).cast("boolean")).otherwise(k >= 40)
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 8).alias("tenant_id"), F.col("event_type").alias("query"), route.alias("route_type"), hit.alias("top_k_hit"),
        (F.col("value") * 20).alias("total_ms"), (F.col("value") * 8).alias("retrieval_ms"), F.col("ts").alias("created_at"),
    )


def flow_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as the steps of a message flow."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    m = table(spark, sf_dir, "lineitem").withColumn("step_index", F.row_number().over(order))
    anomaly = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)
    return m.select(
        F.col("l_orderkey").alias("flow_task_id"), "step_index", F.floor("l_extendedprice").cast("long").alias("processing_ms"), anomaly.alias("is_anomaly"),
        F.when(~anomaly, "success").when(F.col("l_linestatus") == "F", "timeout").otherwise("error").alias("status"),
    )


def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"))
