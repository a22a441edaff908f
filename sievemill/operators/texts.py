"""Text operators: paragraph chunks, sections, ordered joining, context samples and citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paragraph_chunks(c: Column, most: int = 1200, step: int = 1000, limit: int | None = None) -> Column:
    """Paragraphs gathered while they stay under ``most`` characters; a longer one is sliced every ``step``, after what was
    gathered. ``limit`` is the store's limit on chunks an article, off by default."""
    paras = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\n+"), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step_(acc: Column, p: Column) -> Column:
        flushed = F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        slices = F.transform(F.sequence(F.lit(0), F.greatest(F.length(p) - 1, F.lit(0)), F.lit(step)), lambda i: F.substr(p, i + F.lit(1), F.lit(most)))
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        return (
            F.when(F.length(p) > most, F.struct(F.concat(flushed, slices).alias("done"), F.lit("").alias("open")))
            .when(F.length(joined) < most, F.struct(acc["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(flushed.alias("done"), p.alias("open")))
        )

    folded = F.aggregate(paras, start, step_)
    out = F.when(folded["open"] != "", F.concat(folded["done"], F.array(folded["open"]))).otherwise(folded["done"])
    return F.slice(out, 1, limit) if limit else out


# Headings, as alternatives; they start on a line of their own, perhaps numbered.
HEADINGS = {
    "references": "References|Bibliography|Literature Cited|Referencias|Bibliografía",
    "introduction": "Introduction|Introducción",
    "methods": r"Methods|Methodology|Proposed Method|Proposed Methodology|Experimental Design|System Model|Materials\s+and\s+Methods|Método|Metodología",
    "conclusions": r"Conclusion|Conclusions|Concluding Remarks|Discussion\s+and\s+Conclusion|Conclusions\s+and\s+Future\s+Work|Conclusiones",
}
NUMBERED = r"\n\s*(?:[IVX\d]+\.\s*)?"


def sections(df: DataFrame, text_col: str, least: int = 3000, most: int = 30000) -> DataFrame:
    """The rows with ``body``, ``introduction``, ``methods``, ``conclusions`` and ``selected``, the labelled parts together.

    ``body`` is the text up to its last heading of references in the second half. A part runs from its heading to the next
    one's, or 8,000 characters for an introduction and 12,000 for methods; without headings the first 6,000 and, of
    bodies over 12,000, the last 4,000 characters stand in. Texts under ``least`` are selected as they are; null is empty.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    heading = lambda k, after: rf"(?is)(?U){NUMBERED}(?:{HEADINGS[k]}){after}"
    # the greedy start leads to the last heading
    starts = [F.length(F.regexp_extract(t, rf"(?is)(?U)^(.*){NUMBERED}(?:{HEADINGS['references']})\s*{end}", 1)) for end in (r"\z", r"\n")]
    cut = F.least(*(F.when(p > F.length(t) * 0.5, p).otherwise(F.length(t)) for p in starts))
    out = df.withColumn("body", F.regexp_replace(F.substr(t, F.lit(1), cut), r"(?U)^\s+|\s+$", ""))
    body = F.col("body")
    at = {k: F.regexp_instr(body, F.lit(heading(k, r"\b"))) for k in ("introduction", "methods", "conclusions")}
    out = out.withColumns({f"_{k}": p for k, p in at.items()})
    i, m, c = F.col("_introduction"), F.col("_methods"), F.col("_conclusions")
    trimmed = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    intro = F.when(i > 0, trimmed(F.substr(body, i, F.when(m > i, m - i).otherwise(8000)))).otherwise(F.substring("body", 1, 6000))
    methods = F.when(m > 0, trimmed(F.substr(body, m, F.when(c > m, c - m).otherwise(12000)))).otherwise("")
    ends = F.when(c > 0, trimmed(F.substr(body, c, F.length(body)))).when(F.length(body) > 12000, F.right(body, F.lit(4000))).otherwise("")
    out = out.withColumns({"introduction": intro, "methods": methods, "conclusions": ends})
    mark = lambda there, name: F.when(there, F.lit(f"=== {name} ===\n")).otherwise(F.lit(f"=== {name} (FALLBACK) ===\n"))
    parts = F.concat_ws(
        "\n\n", F.concat(mark(i > 0, "INTRODUCTION"), "introduction"), F.when(m > 0, F.concat(F.lit("=== METHODOLOGY ===\n"), "methods")),
        F.when((c > 0) | (F.length(body) > 12000), F.concat(mark(c > 0, "CONCLUSIONS"), "conclusions")),
    )
    chosen = F.when(F.length(t) < least, trimmed(t)).otherwise(trimmed(F.substring(parts, 1, most)))
    return out.withColumn("selected", chosen).drop("_introduction", "_methods", "_conclusions")


def ordered_text(df: DataFrame, key: str, pos: str, text: str, least: int = 200) -> DataFrame:
    """(key, text, pieces): pieces joined from position 0 to the first gap; only results longer than ``least``.

    A group is one article's pieces, bounded by the length of an article.
    """
    cells = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    grouped = df.where(F.col(pos) >= 0).groupBy(key, pos).agg(F.min(text).alias(text)).groupBy(key).agg(cells.alias("c"))
    run = F.filter(F.col("c"), lambda x, i: x["p"] == i)
    return grouped.select(key, F.array_join(F.transform(run, lambda x: x["t"]), "\n\n").alias("text"), F.size(run).alias("pieces")).where(F.length("text") > least)


# Labels of the segments of a context, in order.
SEGMENTS = ("INTRODUCCIÓN_Y_OBJETIVOS", "METODOLOGÍA_Y_DISEÑO", "RESULTADOS_Y_TABLAS_1", "RESULTADOS_Y_TABLAS_2", "DISCUSIÓN_Y_CONCLUSIONES")


def context_sample(c: Column, abstract: Column | None = None, segment: int = 8000, most: int = 24000, least: int = 2000) -> Column:
    """Labelled segments from the start, the quarters and the end of a text, ``most`` characters together at most.

    Texts under ``least`` characters, and null, give way to the abstract's first 6,000 characters (empty without one).
    """
    n = F.length(c)
    spots = [F.lit(1), F.floor(n / 4).cast("int") + 1, F.floor(n / 2).cast("int") + 1, F.floor(3 * n / 4).cast("int") + 1, F.greatest(n - segment + 1, F.lit(1))]
    joined = F.concat(*(F.concat(F.lit(f"\n\n--- SECCIÓN: {name} ---\n"), F.substr(c, at, F.lit(segment))) for name, at in zip(SEGMENTS, spots, strict=True)))
    short = F.substring(F.coalesce(abstract, F.lit("")), 1, 6000) if abstract is not None else F.lit("")
    return F.when(n >= least, F.substring(joined, 1, most)).otherwise(short)


def unknown_citations(c: Column, allowed: Column) -> Column:
    """Surnames of "Name (YYYY)" mentions that are not among the allowed ones."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([A-ZÀ-Þ][\p{L}-]+)(?: et al\.)? \((?:19|20)\d{2}\)"), F.lit(1))
    return F.array_except(F.array_distinct(found), allowed)


# Phrases of short answers that are none.
EVASIVE = (
    "no reportado en", "no encontrado en", "no disponible", "no se reporta en", "no hay información", "sin información", "no menciona", "no especifica", "la columna no",
    "[sin informacion]", "no detallada",
)


def placeholder_answer(c: Column) -> Column:
    """Whether an answer is none: null, under 15 characters, or under 180 with an evasive phrase."""
    flat = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    evasive = F.lit(False)
    for p in EVASIVE:
        evasive = evasive | flat.contains(p)
    return (F.length(flat) < 15) | ((F.length(flat) < 180) & evasive)
