"""Version history of bills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(uploads: DataFrame) -> DataFrame:
    """Uploads with version (1, 2, ... per tenant and ticket) and the endorsers new in each."""
    order = Window.partitionBy("tenant_id", "ticket_number").orderBy("upload_time", "bill_id")
    before = F.lag("endorsers").over(order)
    v = uploads.withColumn("version", F.row_number().over(order)).withColumn("before", F.coalesce(before, F.array().cast("array<string>")))
    fresh = F.filter("endorsers", lambda e: ~F.coalesce(F.array_contains("before", F.coalesce(e, F.lit(""))), F.lit(False)))
    return v.withColumn("new_endorsers", fresh).drop("before")


def records(uploads: DataFrame) -> DataFrame:
    """One record per tenant and ticket: the first upload's fields and the newest version."""
    v = versions(uploads)
    first = lambda c: F.min_by(c, "version").alias(c)
    return v.groupBy("tenant_id", "ticket_number").agg(F.max("version").alias("latest_version"), first("drawer"), first("amount_numeric"), F.max_by("endorsers", "version").alias("endorsers"))


def latest_versions(uploads: DataFrame) -> DataFrame:
    newest = Window.partitionBy("tenant_id", "ticket_number").orderBy(F.desc("version"))
    return versions(uploads).withColumn("r", F.row_number().over(newest)).where("r = 1").drop("r")


def merged_flags(old: Column, new: Column) -> Column:
    """Old flags, then new ones of other codes."""
    return F.concat(old, F.filter(new, lambda n: ~F.exists(old, lambda o: o["code"] == n["code"])))


def states(flagged: DataFrame) -> DataFrame:
    """What is known of each bill (tenant_id, ticket_number) after some uploads with flags: how many
    they were, the first one's fields, the last one's endorsers, and where each flag came up first."""
    at = F.struct("upload_time", "bill_id")
    places = F.transform("flags", lambda f, i: F.struct(F.struct("upload_time", "bill_id", i.alias("place")).alias("at"), f["code"].alias("code")))
    one = flagged.select(
        "tenant_id", "ticket_number", F.lit(1).cast("long").alias("uploads"), F.struct(at.alias("at"), "drawer", "amount_numeric").alias("first"), F.struct(at.alias("at"), "endorsers").alias("last"), places.alias("flags")
    )
    return merged_states(one)


def merged_states(parts: DataFrame) -> DataFrame:
    """States of the same bills taken together; in whichever parts and order, the result is the same."""
    both = parts.groupBy("tenant_id", "ticket_number").agg(F.sum("uploads").alias("uploads"), F.min_by("first", "first.at").alias("first"), F.max_by("last", "last.at").alias("last"), F.flatten(F.collect_list("flags")).alias("flags"))
    # Of each code the earliest place; a bill has few codes.
    earliest = F.filter("flags", lambda f: ~F.exists("flags", lambda o: (o["code"] == f["code"]) & (o["at"] < f["at"])))
    return both.withColumn("flags", F.array_sort(F.array_distinct(earliest)))


def whole_records(states: DataFrame) -> DataFrame:
    """(tenant_id, ticket_number, latest_version, drawer, amount_numeric, endorsers, codes): the record
    of each bill with the flags of all its uploads, in the order in which they came up."""
    return states.select(
        "tenant_id", "ticket_number", F.col("uploads").cast("int").alias("latest_version"), "first.drawer", "first.amount_numeric", "last.endorsers", F.transform("flags", lambda f: f["code"]).alias("codes")
    )
