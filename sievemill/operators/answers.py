"""Free-form answers and questions brought to tables: term mappings, category lists, traced outputs, terms of questions, synonyms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.operators.atoms import Atom, Contract, variants

# Words of a question that are no terms, what stands in for none, and the notice on untraced answers.
QUESTION_STOPWORDS = frozenset("a an the and or but if of at by for with in on to from de la el en y que".split())
NO_TERMS = ("systematic review",)
# What shows that an item of a list gives reasons instead of naming something.
REASONS = (r"\)\s+(?:es|son|resulta|representa)\b", r"\b(?:es|son)\s+relevante\b", r"\b(?:para|porque|debido a que)\b.*\b(?:es|son)\b")
UNTRACED = "⚠️ [Aviso: Trazabilidad no etiquetada]\n"


def mapped_terms(df: DataFrame, observed: DataFrame, response: str = "response", most: int = 8) -> DataFrame:
    """(id, term, pos) of {"atoms": [{"id", "terms"}]} answers: terms copied from the observed ones alone, ``most`` an atom.

    Whatever stands around the object, blanks and case do not matter; the first answer row for an atom and term counts.
    """
    kind = "array<struct<id:string,terms:array<string>>>"
    atoms = F.from_json(F.get_json_object(C.json_object(F.col(response)), "$.atoms"), kind)
    rows = df.select(F.explode(atoms).alias("a")).select(F.trim("a.id").alias("id"), F.posexplode(F.array_distinct(F.transform("a.terms", lambda t: F.lower(F.trim(t))))).alias("pos", "term"))
    known = observed.select(F.lower(F.trim("term")).alias("term")).where("term != ''").distinct()
    first = rows.where((F.col("id") != "") & (F.col("pos") < most)).groupBy("id", "term").agg(F.min("pos").alias("pos"))
    return first.join(known, "term", "left_semi").select("id", "term", "pos")


def traced(c: Column) -> Column:
    """An answer without its tagged analysis; a notice stands before longer ones that name neither evidence nor context.

    An analysis that is not closed ends at the first bullet, else the last two paragraphs are the answer, else all of it.
    """
    opened, closed = c.contains("<analisis>"), c.contains("</analisis>")
    rest = F.substring_index(c, "<analisis>", -1)
    bullet = F.instr(rest, "•")
    tail = F.when(bullet > 0, F.substr(rest, bullet)).when(rest.contains("\n\n"), F.substring_index(rest, "\n\n", -2)).otherwise(rest)
    body = F.when(opened & closed, F.trim(F.split_part(c, F.lit("</analisis>"), F.lit(2)))).when(opened, F.trim(tail)).otherwise(c)
    bare = ~body.contains("[EVIDENCIA") & ~body.contains("[CONTEXTO") & (F.length(body) > 40)
    return F.when(bare, F.concat(F.lit(UNTRACED), body)).otherwise(body)


def question_terms(question: str | None, most: int = 3) -> list[str]:
    """The first words of four letters or more that are no function words; a stand-in where there is none."""
    words = (w.lower() for w in re.findall(r"[^\W\d_]+", question or ""))
    return list(w for w in words if len(w) > 3 and w not in QUESTION_STOPWORDS)[:most] or list(NO_TERMS)


def domain_words(terms: list[str]) -> set[str]:
    """Words of three letters or more of some terms, in lower case."""
    return {w for t in terms for w in t.lower().split() if len(w) > 2}


def category_list(answer: str | None, base: list[str], most: int = 5, least: int = 3) -> list[str]:
    """Categories of a listed answer: three words or more, cut to eighteen, each once; with fewer than ``least`` the base fills up.

    Reasons and half-open brackets are dropped; an answer that says there are none gives an empty list, none at all the base.
    """
    if not answer:
        return base[:most]
    if "no se identificaron aportes" in answer.lower():
        return []
    out: dict[str, str] = {}
    key = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    for item in re.split(r"[\n;,]+", re.sub("```(?:json)?", "", answer)):
        item = " ".join(re.sub(r"^\s*(?:[-*]|\d+[).:-])\s*", "", item).strip(" \t\r\"'").split())
        reason = any(re.search(p, item, re.I) for p in REASONS)
        words = re.sub(r"\s*\([^)]*$", "", item).strip(" ()").split()
        if not reason and len(words) >= 3 and len(out) < most:
            text = " ".join(words[:18])
            out.setdefault(key(text), text)
    if len(out) < least:
        for b in base:
            if key(b) and len(out) < most:
                out.setdefault(key(b), b)
    return list(out.values())[:most]


def synonym_rows(contract: Contract) -> list[tuple[str, str, bool, str, str]]:
    """(atom, category, required, term, variant) of a contract: the dimension table that matching by join needs."""
    return [(a.name, a.category, a.required, t, v) for a in contract.atoms for t in dict.fromkeys((a.name, *a.terms)) for v in variants(t)]


def criteria_rows(inclusion: str, exclusion: str) -> list[tuple[str, str, str]]:
    """(kind, level, criterion): one row a line; without a judge all of them count as told by the abstract."""
    lines = lambda t: [x.strip(" -*\t") for x in (t or "").splitlines() if x.strip(" -*\t")]
    return [(kind, "abstract", x) for kind, t in (("inclusion", inclusion), ("exclusion", exclusion)) for x in lines(t)]


__all__ = ["Atom", "category_list", "criteria_rows", "domain_words", "mapped_terms", "question_terms", "synonym_rows", "traced"]
