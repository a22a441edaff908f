"""Records of landed provider responses as articles: one projection a provider, no shuffle but for the first record of a key.

Inputs are tables of single records with nested fields, as ``spark.read.json`` or the XML reader gives them; a field that a
landing lacks counts as null. Fetching the responses is not part of this library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.sources.ingest import paired_authors, rebuilt_abstract

NO_ABSTRACT = "No abstract available."


def field(df: DataFrame, path: str, kind: str = "string") -> Column:
    """A nested field by its dotted path, or null of the given type where the schema does not have it."""
    from pyspark.sql.types import StructType

    at = df.schema
    for name in path.split("."):
        if not isinstance(at, StructType) or name not in at.names:
            return F.lit(None).cast(kind)
        at = at[name].dataType
    return F.col(path)


def _worth(title: Column, abstract: Column, doi: Column) -> Column:
    """Not a software page, and not thin: some abstract, an identifier or a long title."""
    noise = (title == "") | C.contains_any(F.lower(title), C.NOISE_TITLES)
    return ~noise & ((F.length(abstract) >= 150) | (F.length(F.trim(doi)) > 5) | (F.length(title) >= 25))


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _first_of_key(df: DataFrame, order: str | None) -> DataFrame:
    """The first record of each key by a column of order; any where there is none."""
    if order is None:
        return df.dropDuplicates(["key"])
    others = [c for c in df.columns if c not in ("key", "_ord")]
    return df.groupBy("key").agg(F.min_by(F.struct(*others), "_ord").alias("x")).select("key", "x.*")


def europe_pmc_articles(df: DataFrame, order: str | None = None) -> DataFrame:
    """Articles of Europe PMC results; ``key`` is the pmcid, else the pmid, else the first 60 letters of the title."""
    get = lambda p, kind="string": field(df, p, kind)
    title, abstract, doi = _empty(get("title")), _empty(get("abstractText")), _empty(get("doi"))
    pmcid, pmid = _empty(get("pmcid")), _empty(get("pmid"))
    rows = df.where(_worth(title, abstract, doi)).select(
        F.when(pmcid != "", pmcid).when(pmid != "", pmid).otherwise(F.substring(title, 1, 60)).alias("key"), title.alias("title"),
        F.when(abstract == "", NO_ABSTRACT).otherwise(abstract).alias("abstract"), F.coalesce(get("pubYear").try_cast("int"), F.lit(0)).alias("year"),
        paired_authors(get("authorString")).alias("authors"), doi.alias("doi"),
        F.coalesce(F.nullif(get("journalTitle"), F.lit("")), F.nullif(get("journalInfo.journal.title"), F.lit(""))).alias("journal"),
        F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).when(pmid != "", F.concat(F.lit("https://europepmc.org/article/MED/"), pmid)).otherwise("").alias("url"),
        F.when(pmcid != "", F.concat(F.lit("https://europepmc.org/articles/"), pmcid, F.lit("?pdf=render"))).otherwise("").alias("pdf_url"),
        F.coalesce(get("citationCount").try_cast("int"), F.lit(0)).alias("citations"), get("language").alias("language"), F.lit("Europe PMC").alias("source"),
        *((F.col(order).alias("_ord"),) if order else ()),
    )
    return _first_of_key(rows, order)


def openalex_articles(df: DataFrame, order: str | None = None) -> DataFrame:
    """Articles of OpenAlex works; ``key`` is the work's id, the abstract is rebuilt from its inverted index."""
    get = lambda p, kind="string": field(df, p, kind)
    title, raw = _empty(get("display_name")), _empty(get("doi"))
    doi = F.replace(raw, F.lit("https://doi.org/"), F.lit(""))
    abstract = _empty(rebuilt_abstract(get("abstract_inverted_index", "map<string,array<int>>")))
    who = F.transform(F.slice(get("authorships", "array<struct<author:struct<display_name:string>>>"), 1, 10), lambda a: _empty(a["author"]["display_name"]))
    journal = get("primary_location.source.display_name")
    rows = df.where(_worth(title, abstract, doi)).select(
        get("id").alias("key"), title.alias("title"), F.when(abstract == "", NO_ABSTRACT).otherwise(abstract).alias("abstract"), F.coalesce(get("publication_year").cast("int"), F.lit(0)).alias("year"),
        F.filter(F.coalesce(who, F.array().cast("array<string>")), lambda a: a != "").alias("authors"), doi.alias("doi"), journal.alias("journal"),
        F.when(raw != "", raw).otherwise(get("id")).alias("url"), _empty(get("open_access.oa_url")).alias("pdf_url"), F.coalesce(get("cited_by_count").cast("int"), F.lit(0)).alias("citations"),
        get("language").alias("language"), F.lit("OpenAlex").alias("source"), *((F.col(order).alias("_ord"),) if order else ()),
    )
    return _first_of_key(rows, order)


def pubmed_articles(df: DataFrame, least: int = 100) -> DataFrame:
    """Articles of PubMed citations (pmid, title, abstract_parts, authors with last and fore names, year, journal, languages, ids).

    The parts of an abstract are joined; records with less than ``least`` characters of it are dropped. ``ids`` are (kind, value);
    the first of kind doi counts.
    """
    get = lambda p, kind="string": field(df, p, kind)
    abstract = F.array_join(F.coalesce(get("abstract_parts", "array<string>"), F.array().cast("array<string>")), " ")
    full = F.filter(get("authors", "array<struct<last:string,fore:string>>"), lambda a: a["last"].isNotNull() & a["fore"].isNotNull())
    ids = F.filter(get("ids", "array<struct<kind:string,value:string>>"), lambda x: x["kind"] == "doi")
    doi = _empty(F.try_element_at(ids, F.lit(1))["value"])
    pmid = _empty(get("pmid").cast("string"))
    return df.where(F.length(abstract) >= least).select(
        pmid.alias("key"), _empty(get("title")).alias("title"), abstract.alias("abstract"), F.coalesce(get("year").try_cast("int"), F.lit(0)).alias("year"),
        F.coalesce(F.transform(full, lambda a: F.concat(a["last"], F.lit(", "), a["fore"])), F.array().cast("array<string>")).alias("authors"), doi.alias("doi"), F.nullif(get("journal"), F.lit("")).alias("journal"),
        F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid)).alias("url"), F.lit("").alias("pdf_url"), F.lit(0).alias("citations"),
        F.coalesce(F.try_element_at(get("languages", "array<string>"), F.lit(1)), F.lit("eng")).alias("language"), F.lit("PubMed").alias("source"),
    )
