"""Sources: delimited files with free headers, landed provider payloads, citation edges and fan-in of sources."""

from __future__ import annotations

import csv
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemill.functions import columns as C

# Headers that name the fields of an article, the first that is there counts; and label words.
HEADER_ALIASES = {
    "title": ("title", "titulo", "article_title", "item_title"),
    "abstract": ("abstract", "abstract_note", "abstractnote", "resumen", "description"),
    "doi": ("doi", "digital_object_identifier"),
    "year": ("year", "publication_year", "pub_year", "date", "publication_date"),
    "authors": ("author", "authors", "creators", "autor", "autores"),
    "journal": ("publication_title", "journal", "journal_title", "venue", "source_title"),
    "url": ("url", "urls", "link", "document_url"),
    "pdf_path": ("file_attachments", "file", "pdf_path", "pdf", "attachments"),
    "item_type": ("item_type", "type", "publication_type", "document_type"),
    "language": ("language", "idioma"),
    "label": ("manual_decision", "inclusion_manual", "inclusion", "incluido", "label", "gold", "gold_label", "relevant"),
}
POSITIVE_LABELS = ("1", "true", "yes", "y", "si", "sí", "include", "included", "incluir", "relevant", "positivo", "incluido")
NEGATIVE_LABELS = ("0", "false", "no", "n", "exclude", "excluded", "excluir", "irrelevant", "negativo", "excluido")
MOST_BYTES = 12 * 1024 * 1024


def normal_header(name: str) -> str:
    flat = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    return re.sub(r"[^a-z0-9]+", "_", flat).strip("_")


def column_mapping(headers: list[str], label_column: str | None = None) -> dict[str, str]:
    """Target field -> header; a label column may be named, or be any header that speaks of inclusion, manual work or gold."""
    known = {normal_header(h): h for h in reversed(headers)}
    out = {t: known[a] for t, names in HEADER_ALIASES.items() for a in reversed(names) if a in known}
    if label_column and label_column in headers:
        out["label"] = label_column
    elif "label" not in out:
        out |= {"label": h for h in reversed(headers) if re.search("inclus|manual|gold", normal_header(h))}
    return out


@dataclass(frozen=True)
class FileFormat:
    separator: str
    encoding: str


def sniff(path: str) -> FileFormat:
    """Separator and encoding from the head of a file on a local path; size-limited uploads alone are read this way."""
    with open(path, "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError("the file is larger than an upload may be; read it as a dataset instead")
    for enc in ("utf-8-sig", "utf-8", "latin-1"):
        try:
            head = raw.decode(enc)[:4096]
            break
        except UnicodeDecodeError:
            continue
    try:
        return FileFormat(csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter, enc)
    except csv.Error:
        return FileFormat(",", enc)


def label_value(c: Column) -> Column:
    """1, 0 or null by the label vocabularies."""
    flat = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(flat.isin(*POSITIVE_LABELS), 1).when(flat.isin(*NEGATIVE_LABELS), 0)


def read_delimited(spark: SparkSession, path: str, fmt: FileFormat | None = None, label_column: str | None = None) -> DataFrame:
    """Articles of a file with free headers: rows without title are dropped; ``row_id`` numbers the rows of the source."""
    fmt = fmt or sniff(path.removeprefix("file://"))
    raw = spark.read.csv(path, header=True, sep=fmt.separator, encoding={"latin-1": "ISO-8859-1"}.get(fmt.encoding, "UTF-8"), multiLine=True, escape='"', quote='"')
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    m = column_mapping(raw.columns, label_column)
    if "title" not in m:
        raise ValueError("no column holds titles")
    pick = lambda t: F.col(f"`{m[t]}`") if t in m else F.lit(None).cast("string")
    numbered = raw.withColumn("_n", F.monotonically_increasing_id())
    part, local = F.shiftright("_n", 33), F.col("_n").bitwiseAND((1 << 33) - 1)
    numbered = numbered.withColumns({"_part": part, "_local": local})
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_off"))  # one row a partition
    rows = numbered.join(F.broadcast(offsets), "_part").withColumn("row", F.col("_off") + F.col("_local") + 1)
    return rows.where(C.text(pick("title")) != "").select(
        F.concat(F.lit("csv-"), F.col("row").cast("string")).alias("row_id"), C.text(pick("title")).alias("title"), C.text(pick("abstract")).alias("abstract"),
        pick("doi").alias("doi"), F.regexp_extract(C.text(pick("year")), r"\b((?:19|20)\d{2})\b", 1).try_cast("int").alias("year"),
        split_authors(pick("authors")).alias("authors"), pick("journal").alias("journal"), pick("url").alias("url"), pick("pdf_path").alias("pdf_path"),
        (C.text(pick("pdf_path")) != "").alias("open_access"), C.language_code(pick("language")).alias("language"),
        pick("item_type").alias("item_type"), label_value(pick("label")).alias("_gold_label"),
    )


def without_private(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_gold")])


def profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled): non-empty values by field, one aggregate."""
    one = df.agg(*(F.count_if(C.text(F.col(f).cast("string")) != "").alias(f) for f in fields))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields))).alias("x")).select("x.*")


def label_histogram(df: DataFrame, label: str) -> DataFrame:
    """(value, parsed, n): raw label values with what they are read as; null for those that are not understood."""
    return df.groupBy(F.lower(C.text(F.col(label).cast("string"))).alias("value")).agg(F.count(F.lit(1)).alias("n")).select("value", label_value(F.col("value")).alias("parsed"), "n")


def ingest_warnings(df: DataFrame, mapping: dict[str, str]) -> list[str]:
    """What a user should know of ingested articles before a run: missing columns, missing abstracts, no rows; three counts."""
    n, bare = df.agg(F.count(F.lit(1)), F.count_if(C.text("abstract") == "")).first()
    if not n:
        return ["No se detectaron articulos con titulo."]
    out = [] if "abstract" in mapping else ["No se detecto columna de abstract; el cribado dependera de metadatos/PDF."]
    out += [] if "doi" in mapping else ["No se detecto DOI; la deduplicacion sera menos precisa."]
    return out + ([f"{bare} articulos no tienen abstract."] if bare else [])


def split_authors(c: Column) -> Column:
    """Names parted by semicolons, else by and."""
    flat = C.text(c)
    parts = F.when(flat.contains(";"), F.split(flat, ";")).otherwise(F.split(flat, r"\s+and\s+"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def paired_authors(c: Column, most: int = 20) -> Column:
    """Comma-parted "Surname, AB" strings: a part of three characters or fewer belongs to the name before it."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(C.text(c), r"\.$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    none = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(", ", F.element_at(acc, -1), p)))
        fits = (F.size(acc) > 0) & (F.length(p) <= 3) & ~F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")).contains(",")
        return F.when(fits, F.when(F.size(acc) > 0, joined).otherwise(acc)).otherwise(F.concat(acc, F.array(p)))

    return F.slice(F.aggregate(parts, none, step), 1, most)


def rebuilt_abstract(c: Column) -> Column:
    """Text of an inverted index word -> positions, in the order of the positions; no explode, no shuffle."""
    cells = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(cells), lambda x: x["word"]), " ")


def inverted_index(c: Column) -> Column:
    """word -> positions (from 0) of a text's blank-parted words."""
    words = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    entries = F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())))
    return F.map_from_entries(entries)


def merge_payload(df: DataFrame) -> DataFrame:
    """Provider records merged by ``paper_id``: noise titles out, thin records without identifier out, the first row's text, the
    modes joined, the queries collected, the most citations. (paper_id, ord, mode, query, title, abstract, doi, citations)"""
    title, abstract = C.text("title"), C.text("abstract")
    noise = (title == "") | C.contains_any(F.lower(title), C.NOISE_TITLES)
    thin = (F.length(abstract) < 100) & ~C.valid_doi(F.col("doi")) & (F.length(title) < 25)
    rows = df.where(~noise & ~thin & F.col("paper_id").isNotNull())
    first = F.min_by(F.struct("title", "abstract", "doi"), "ord").alias("f")
    return rows.groupBy("paper_id").agg(
        first, F.min("ord").alias("ord"), F.array_join(F.array_sort(F.collect_set("mode")), "+").alias("modes"),
        F.array_sort(F.collect_set("query")).alias("queries"), F.max(F.coalesce("citations", F.lit(0))).alias("citations"),
    ).select("paper_id", "ord", "f.*", "modes", "queries", "citations")


def expand_graph(seeds: DataFrame, edges: DataFrame, per_seed: int, total: int) -> DataFrame:
    """(node, seed, direction): neighbours of the seeds in both directions, at most ``per_seed`` each way and ``total`` together,
    no seeds among them. Edges (src, dst) are joined from either end; the limits are those of the report."""
    out = edges.join(seeds.select(F.col("seed").alias("src")), "src").select(F.col("src").alias("seed"), F.col("dst").alias("node"), F.lit("references").alias("direction"))
    back = edges.join(seeds.select(F.col("seed").alias("dst")), "dst").select(F.col("dst").alias("seed"), F.col("src").alias("node"), F.lit("citations").alias("direction"))
    both = out.unionAll(back).distinct()
    r = F.row_number().over(Window.partitionBy("seed", "direction").orderBy("node"))
    fresh = both.withColumn("r", r).where(F.col("r") <= per_seed).join(seeds.select(F.col("seed").alias("node")), "node", "left_anti")
    return fresh.groupBy("node").agg(F.min(F.struct("seed", "direction")).alias("s")).select("node", "s.seed", "s.direction").orderBy("node").limit(total)


def fan_in(sources: list) -> DataFrame:
    """Union of sources by name; a field that a source lacks is null.

    A source is a DataFrame, or a function that opens one; one that cannot be opened is left out, unless none can.
    """
    frames, failed = [], []
    for s in sources:
        try:
            frames.append(s() if callable(s) else s)
        except Exception as e:  # whatever a reader may raise
            failed.append(e)
    if not frames:
        raise ValueError("no source could be read") from (failed[0] if failed else None)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_landed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed provider responses with a given schema (no inference pass); broken lines are kept aside in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
