"""Sinks: export files, partitioned audit tables, an append log and the idempotent upsert of text chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.functions import columns as C

# The columns of an export, in order.
EXPORT = ("title", "authors", "year", "journal", "doi", "abstract", "url", "source", "similarity", "relevance")
REVIEW = ("researcher_notes", "exclusion_reason", "methodology", "population", "intervention", "key_findings", "limitations", "conclusions", "translation")


def export_view(df: DataFrame, review: bool = True) -> DataFrame:
    """The fixed columns of an export, with those of the review or without, missing ones empty, arrays joined by commas; all strings."""
    kinds = dict(df.dtypes)

    def cell(c: str):
        if c not in kinds:
            return F.lit("").alias(c)
        if kinds[c].startswith("array"):
            return F.array_join(F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")), ", ").alias(c)
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    return df.select(*(cell(c) for c in (EXPORT + REVIEW if review else EXPORT)))


def write_export(df: DataFrame, path: str) -> None:
    export_view(df).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_audit(df: DataFrame, path: str, by: str = "stage") -> None:
    """Rows by stage or reason as one partitioned table instead of one file a stage."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def upsert_chunks(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table after an upsert of (article, chunk_no, full, text): an article that is stored is replaced only by a full text
    over an abstract; otherwise the stored one stays. Merge on read: two joins on the article and a union."""
    have = stored.groupBy("article").agg(F.max("full").alias("have_full"))
    new = fresh.groupBy("article").agg(F.max("full").alias("new_full"))
    take = new.join(have, "article", "left").where(F.col("have_full").isNull() | (F.col("new_full") & ~F.col("have_full"))).select("article")
    return stored.join(take, "article", "left_anti").unionByName(fresh.join(take, "article", "left_semi"))


def chunk_key(title, year, author):
    return F.md5(F.concat_ws("_", C.text(title), F.coalesce(year.cast("string"), F.lit("")), C.text(author)))


def append_queue(queue: DataFrame, fresh: DataFrame) -> DataFrame:
    """The manual queue after new articles: one row an identifier, those that wait keep their place; with a file name."""
    key = C.normal_doi(F.col("doi"))
    new = fresh.withColumn("key", key).where("key is not null").groupBy("key").agg(F.min_by(F.struct("title", "doi"), "ord").alias("x")).select("key", "x.*")
    name = F.concat(F.regexp_replace("key", "[^a-z0-9]+", "_"), F.lit(".pdf"))
    added = new.join(queue.select("key"), "key", "left_anti").select("key", "title", "doi", name.alias("file_name"))
    return queue.unionByName(added)
