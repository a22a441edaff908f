"""Problem 3: cutting oversized items into overlapping pieces at natural boundaries.

One bounded-quantifier regular expression does the cutting: its alternatives are ordered by the strength of
the boundary (paragraph, sentence, line or clause, blank) and end with plain characters, so that every match
consumes as much as fits under the limit. Everything is a projection inside the JVM, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 200


def cutting_pattern(most: int) -> str:
    """Alternatives by boundary strength; the stronger ones must fill half of the limit at least."""
    half = max(1, most // 2)
    ends = (
        r"(?<=\n[ \t\r]{0,8}\n)",  # paragraph
        r"(?<=[.!?…][\"'’”»)\]]{0,2}\s)",  # sentence
        r"(?<=[;:,\n]\s{0,2})(?<=\s)",  # line or clause
    )
    strong = "|".join(rf".{{{half},{most}}}{end}" for end in ends)
    return rf"(?s)(?:.{{1,{most}}}\z|{strong}|.{{1,{most}}}(?<=\s)|.{{1,{most}}}(?!\p{{M}})|.{{1,{most}}})"


def _pieces(text: Column, limit: int, overlap: int) -> Column:
    fresh = limit - overlap  # what a later piece may add to its overlap
    first = F.regexp_extract(text, r"\A" + cutting_pattern(limit), 0)
    rest = F.regexp_extract_all(F.substr(text, F.length(first) + F.lit(1)), F.lit(cutting_pattern(fresh)), F.lit(0))
    return F.concat(F.array(first), rest)


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: id, piece_no (from 0), start (from 0, of the fresh part), overlap_chars, piece, cut_kind.

    Lengths are code points. Fresh parts, joined in order, give the text again; each piece after the first starts
    with ``overlap_chars`` characters of the one before: ``overlap`` of them, less the part of a word at their start.
    ``cut_kind`` is ``none`` for texts within the limit, ``hard`` for texts with a longer run without
    blanks, else ``soft``. A null text gives no row, an empty one a single empty piece; equal rows give equal
    pieces each; other columns of ``df`` are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    over = F.length("_text") > limit
    cut = src.select("_id", "_text", F.when(over, _pieces(F.col("_text"), limit, overlap)).otherwise(F.array("_text")).alias("_parts"))
    # a piece that ends without a blank was cut by the character fallback; only then can there be a run beyond the limit
    forced = F.exists(F.slice("_parts", F.lit(1), F.size("_parts") - 1), lambda p: p.rlike(r"(?U)\S\z"))
    unbroken = F.col("_text").rlike(rf"(?U)\S{{{limit + 1}}}")
    kind = F.when(F.size("_parts") == 1, F.lit("none")).when(forced & unbroken, F.lit("hard")).otherwise(F.lit("soft"))
    cut = cut.withColumn("cut_kind", kind)
    starts = F.aggregate(
        "_parts",
        F.array(F.lit(0)),
        lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))),
    )
    rows = cut.withColumn("_starts", starts).select(
        "_id", "_text", "cut_kind", "_starts", F.posexplode("_parts").alias("piece_no", "_part")
    )
    start = F.element_at("_starts", F.col("piece_no") + 1)
    back = F.least(F.lit(overlap), start)
    tail = F.substr(F.col("_text"), start - back + F.lit(1), back)
    # the overlap starts at a word, unless that would cost a third of it
    whole = F.regexp_replace(tail, rf"\A\S{{1,{max(1, overlap // 3)}}}\s+(?=\S)", "")
    at_word = F.substr(F.col("_text"), start - back, F.lit(1)).rlike(r"\s")
    lap = F.when(F.col("piece_no") == 0, F.lit("")).when((back >= start) | at_word, tail).otherwise(whole)
    return rows.select(
        F.col("_id").alias(id_col),
        "piece_no",
        start.alias("start"),
        F.length(lap).alias("overlap_chars"),
        F.concat(lap, F.col("_part")).alias("piece"),
        "cut_kind",
    )


def checked_pieces(pieces: DataFrame, id_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, rebuilt, pieces, within_limit, overlapping): the fresh parts of each text joined again, and whether its pieces keep to the rules.

    Rows are the distinct pieces of a text; what is gathered of one is as long as the text itself.
    """
    fresh = F.substr(F.col("piece"), F.col("overlap_chars") + F.lit(1))
    laps = (F.col("overlap_chars") <= overlap) & ((F.col("piece_no") == 0) | (F.col("overlap_chars") >= overlap - overlap // 3 - 1) | (F.col("overlap_chars") >= F.col("start")))
    rows = pieces.select(id_col, F.struct("piece_no", fresh.alias("t")).alias("x"), (F.length("piece") <= limit).alias("short"), laps.alias("laps")).distinct()
    got = rows.groupBy(id_col).agg(F.array_sort(F.collect_list("x")).alias("xs"), F.min("short").alias("within_limit"), F.min("laps").alias("overlapping"))
    return got.select(id_col, F.array_join(F.transform("xs", lambda x: x["t"]), "").alias("rebuilt"), F.size("xs").alias("pieces"), "within_limit", "overlapping")
