"""Files, chunk tables and what is kept between runs of an ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.functions import exprs as E

# The file types that are taken in.
SUFFIXES = ("pdf", "doc", "docx", "xlsx", "xls", "png", "jpg", "jpeg", "tiff")


def scan_files(spark: SparkSession, path: str, recursive: bool = True, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Files of the known types, upper or lower case, by path; their content is read only if asked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.where(F.lower(F.substring_index("path", ".", -1)).isin(*suffixes)).orderBy("path")


def with_md5(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("md5_hash", F.md5(content))


def rows_to_markdown(rows: DataFrame, *by: str) -> DataFrame:
    """One Markdown table from rows (by, row_idx, cells): the first is the header, null cells are empty."""
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.lit("---")), " | "), F.lit(" |"))
    each = F.struct("row_idx", line.alias("line"), rule.alias("rule"))
    g = rows.groupBy(*by).agg(F.array_sort(F.collect_list(each)).alias("r"))
    lines = F.transform("r", lambda x: x["line"])
    return g.select(*by, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(F.col("r")[0]["rule"]), F.slice(lines, F.lit(2), F.size(lines))), "\n").alias("markdown"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks with the tenant as a folder, which a tenant's reads then prune to."""
    chunks.write.mode("append").partitionBy("tenant_id").parquet(path)


def chunk_key(document: str = "doc_id", index: str = "chunk_index") -> Column:
    return F.concat_ws("_", document, index)


def chunk_uuid(document: str = "doc_id", index: str = "chunk_index") -> Column:
    """A chunk's key: the UUID of its number in the namespace of its document. A document whose id is
    no UUID has the UUID of its id in the namespace of object identifiers."""
    own = F.col(document).cast("string")
    is_uuid = own.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    return E.uuid5(F.when(is_uuid, own).otherwise(E.uuid5(F.lit(E.OID_NAMESPACE), own)), F.col(index))


def missing(new: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` whose key is not stored, each key once: appending them again changes nothing."""
    return new.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def resume_parse(docs: DataFrame, parsed: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows of an earlier parse that serve again, documents that are still to be parsed)."""
    return parsed.join(docs.select(key).distinct(), key, "left_semi"), docs.join(parsed.select(key).distinct(), key, "left_anti")


def without_documents(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks without those of the named documents (tenant_id, doc_id); postings are built from what is left."""
    return chunks.join(gone.select("tenant_id", "doc_id"), ["tenant_id", "doc_id"], "left_anti")


def unfinished(parsed: DataFrame, chunks: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is kept of an earlier parse: rows of documents whose chunks (key, chunk_index) are not all
    stored. A document that has succeeded, or that has no chunks, needs its parse no more."""
    left = chunks.select(key, "chunk_index").join(stored.select(key, "chunk_index"), [key, "chunk_index"], "left_anti")
    return parsed.join(left.select(key).distinct(), key, "left_semi")
