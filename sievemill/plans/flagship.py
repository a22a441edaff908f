"""One screening run end to end: canonical records, metadata filter, exact deduplication, concept filter, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.operators import atoms as A
from sievemill.operators import screening as S
from sievemill.operators.scoring import Pico, lexical_relevance


def screen(articles: DataFrame, metadata: S.MetadataFilter, contract: A.Contract, pico: Pico, top: int = 20) -> DataFrame:
    """The ``top`` articles by coverage, relevance and citations, with the atoms they hold.

    Filters reach the scan, the deduplication is the one shuffle (on its key), and the ranking keeps ``top`` rows a task.
    """
    kept = S.filter_metadata(articles, metadata).select("ord", "title", "abstract", "doi", "year", "citations")
    unique = S.exact_dedup(kept).where("dup_reason is null")
    passed = A.concept_filter(unique, contract).where("passed")
    scored = A.atom_coverage(passed, contract).withColumn("relevance", F.round(lexical_relevance(F.col("title"), F.col("abstract"), F.col("citations"), pico), 6))
    best = scored.orderBy(F.col("coverage").desc(), F.col("relevance").desc(), F.coalesce("citations", F.lit(0)).desc(), "ord").limit(top)
    return best.select("ord", "title", "year", F.array_join("matched", ",").alias("matched"), "coverage", "relevance")
