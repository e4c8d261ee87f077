"""Bills from pages: merging, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions import exprs as E

# The fields of a bill's face.
FACE = ("ticket_number", "ticket_type", "issue_date", "due_date", "amount_numeric", "amount_text", "currency", "drawer", "drawer_account", "drawer_bank", "acceptor", "payee", "drawee_bank")


def merge_pages(pages: DataFrame, key: str, order: Column, fields: tuple[str, ...] = FACE) -> DataFrame:
    """One bill of the pages on which one was found: each field from the first page that has it,
    endorsers of all pages in order, once each and none blank. No such page, no row."""
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    lists = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce("endorsers", F.array().cast("array<string>")).alias("e")))), lambda x: x["e"])
    g = pages.where(F.coalesce("is_bill_found", F.lit(False))).groupBy(key).agg(*first, F.flatten(lists).alias("endorsers"))
    return g.withColumn("endorsers", F.array_distinct(F.filter("endorsers", lambda e: F.coalesce(e != "", F.lit(False)))))


def extraction_confidence(bills: DataFrame) -> DataFrame:
    """(bill_id, confidence, is_low, field_confidences): the share of the face's fields that are filled."""
    there = {f: F.coalesce(E.present_number(f) if f == "amount_numeric" else E.present(f), F.lit(False)).cast("double") for f in FACE}
    share = F.round(sum(there.values(), F.lit(0.0)) / len(FACE), 3)
    each = F.map_from_arrays(F.array(*map(F.lit, FACE)), F.array(*there.values()))
    return bills.select("bill_id", share.alias("confidence"), (share < 0.70).alias("is_low"), each.alias("field_confidences"))


def doc_confidence(docs: DataFrame, elements: DataFrame) -> DataFrame:
    """The value a document came with, else the mean of its elements', else 1."""
    mean = elements.groupBy("doc_id").agg(F.avg("confidence").alias("mean"))
    return docs.join(mean, "doc_id", "left").select("doc_id", F.round(F.coalesce("stated_confidence", "mean", F.lit(1.0)), 6).alias("confidence"))
