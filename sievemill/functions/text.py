"""Column predicates and tokenisers shared by the operators; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that stand for "nothing here" in bibliographic exports.
PLACEHOLDERS = (
    "-", "--", "—", "–", "...", "…", "?", "[]", "{}", "null", "none", "nan", "nil", "n/a", "na", "n.a.", "n.d.", "s/d",
    "unknown", "undefined", "not available", "no abstract", "no abstract available", "abstract not available",
    "abstract unavailable", "[no abstract]", "[no abstract available]", "[abstract not available]", "no title",
    "[no title]", "untitled", "title not available", "sin resumen", "resumen no disponible", "sin título", "sin titulo",
    "no disponible", "sem resumo", "resumo não disponível", "sem título", "não disponível", "sans résumé",
    "résumé non disponible", "pas de résumé", "sans titre", "non disponible", "kein abstract",
    "keine zusammenfassung", "zusammenfassung nicht verfügbar", "nicht verfügbar", "ohne titel",
    "nessun abstract", "abstract non disponibile", "senza titolo", "non disponibile", "tbd", "tba", "pending", "xx",
)

WORD = r"[\p{L}\p{N}]+"
BLANK = r"[\s   ​﻿]+"


def squeezed(c: Column) -> Column:
    """Trimmed lower-case text with every run of blanks as one space and no final stops."""
    flat = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), BLANK, " ")))
    return F.when(F.length(flat) > 3, F.regexp_replace(flat, r"[.\s]+$", "")).otherwise(flat)


def usable(c: Column) -> Column:
    """Not null, not blank and no placeholder; never null."""
    flat = squeezed(c)
    known = sorted({p.rstrip(".") if len(p) > 3 else p for p in PLACEHOLDERS})
    # long texts need no more than a look for their first character
    return F.when(F.length(c) > 100, c.rlike(r"[^\s \u2000-\u200b\u3000\ufeff]")).otherwise((flat != "") & ~flat.isin(*known))


def words(c: Column) -> Column:
    """Maximal runs of letters and digits, lower-case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))
