"""Evaluation of rankings and decisions, stage attribution, corpus statistics and audit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions import columns as C


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b == 0, 0.0).otherwise(a / b), 4)


def confusion(df: DataFrame, by: list[str] | None = None, truth: str = "truth", said: str = "said") -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1, accuracy (round 4), zero where a denominator is."""
    t, s = F.col(truth), F.col(said)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    g = df.groupBy(*by) if by else df
    counts = g.agg(n(t & s).alias("tp"), n(~t & s).alias("fp"), n(~t & ~s).alias("tn"), n(t & ~s).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "accuracy": _ratio(tp + tn, tp + fp + tn + fn)})
    p, r = F.when(tp + fp == 0, 0.0).otherwise(tp / (tp + fp)), F.when(tp + fn == 0, 0.0).otherwise(tp / (tp + fn))
    return out.withColumn("f1", F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 4))


def lost_at(df: DataFrame, stages: list[str]) -> DataFrame:
    """The rows with ``lost_at``: the first stage flag that is not true, or null where all are."""
    out = F.lit(None).cast("string")
    for s in reversed(stages):
        out = F.when(~F.coalesce(F.col(s), F.lit(False)), F.lit(s)).otherwise(out)
    return df.withColumn("lost_at", out)


def ranked_list_metrics(ranked: DataFrame, include: list[str], exclude: list[str], cutoffs: tuple[int, ...] = (10, 20, 50, 100), beta: float = 2.0) -> DataFrame:
    """One row a cutoff: recall and precision of the probe terms, F-beta, noise, and the share found in titles.

    ``ranked`` has (rank, title, abstract). Of each term only its first rank counts, one aggregate over the corpus.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("abstract"), F.lit(""))))
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    firsts = [F.min(F.when(text.contains(t.lower()), F.col("rank"))).alias(f"i{k}") for k, t in enumerate(include)]
    heads = [F.min(F.when(title.contains(t.lower()), F.col("rank"))).alias(f"t{k}") for k, t in enumerate(include)]
    noise = [F.sum((F.lit(False) if not exclude else C.contains_any(text, [x.lower() for x in exclude])).cast("int") * (F.col("rank") <= c).cast("int")).alias(f"x{c}") for c in cutoffs]
    one = ranked.agg(F.max("rank").alias("n"), *firsts, *heads, *noise)
    rows = []
    for c in cutoffs:
        found = sum((F.coalesce((F.col(f"i{k}") <= c).cast("int"), F.lit(0)) for k in range(len(include))), F.lit(0))
        in_title = sum((F.coalesce((F.col(f"t{k}") <= c).cast("int"), F.lit(0)) for k in range(len(include))), F.lit(0))
        size = F.least(F.lit(c), F.col("n"))
        p, r = found / size, found / max(1, len(include))
        b2 = beta * beta
        fb = F.when(p + r == 0, 0.0).otherwise((1 + b2) * p * r / (b2 * p + r))
        rows.append(F.struct(
            F.lit(c).alias("cutoff"), found.alias("found"), F.round(r, 4).alias("recall"), F.round(p, 4).alias("precision"), F.round(fb, 4).alias("f_beta"),
            F.round(F.col(f"x{c}") / size, 4).alias("noise"), in_title.alias("title_hits"),
        ))
    return one.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def work_saved(ranked: DataFrame, include: list[str], share: float = 0.95) -> DataFrame:
    """One row: the smallest rank at which ``share`` of the terms are found, and the work saved; nulls if never."""
    text = F.lower(F.concat_ws(" ", F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("abstract"), F.lit(""))))
    firsts = [F.min(F.when(text.contains(t.lower()), F.col("rank"))) for t in include]
    one = ranked.agg(F.max("rank").alias("n"), F.array_sort(F.array_compact(F.array(*firsts))).alias("r"))
    need = max(1, -(-int(share * 1000) * len(include) // 1000))
    at = F.when(F.size("r") >= need, F.element_at("r", F.least(F.lit(need), F.greatest(F.size("r"), F.lit(1)))))
    return one.select(at.cast("long").alias("rank"), F.round(F.greatest(F.lit(0.0), share - at / F.col("n")), 6).alias("wss"))


def head_and_tail(df: DataFrame, label: Column, top: int, rest: str = "otros") -> DataFrame:
    """(label, n, pct): the ``top`` labels and the sum of the others; percent of all rows, one decimal.

    Labels are counted first; the ranking runs over the counts, with the limit ahead of the sort.
    """
    counts = df.select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.col("n").desc(), "label").limit(top)
    total = counts.agg(F.sum("n").alias("total"))
    marked = counts.join(F.broadcast(best.select("label", F.lit(True).alias("_top"))), "label", "left")
    named = F.when(F.col("_top"), F.col("label")).otherwise(F.lit(rest))
    return marked.groupBy(named.alias("label")).agg(F.sum("n").alias("n")).join(F.broadcast(total)).select("label", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("pct"))


def dimension_counts(df: DataFrame, dimensions: dict[str, Column], top: int = 10) -> DataFrame:
    """(dim, label, n, pct): the most frequent labels of several dimensions in one pass; an array gives several labels."""
    def labelled(d: str, c: Column) -> Column:
        return F.transform(c, lambda x: F.struct(F.lit(d).alias("dim"), x.alias("label")))

    cells = [labelled(d, c) for d, c in dimensions.items()]
    counts = df.select(F.explode(F.concat(*cells)).alias("x")).select("x.*").groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    r = F.row_number().over(Window.partitionBy("dim").orderBy(F.col("n").desc(), "label"))
    return counts.withColumn("r", r).where(F.col("r") <= top).join(F.broadcast(total)).select("dim", "label", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("pct"))


def flow_counts(stages: DataFrame) -> DataFrame:
    """One row from rows with stage flags: raw, duplicates, concept_discarded, candidates, metadata_discarded, final."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    u, c, m = F.col("is_unique"), F.col("concept_ok"), F.col("metadata_ok")
    return stages.agg(
        F.count(F.lit(1)).alias("raw"), n(~u).alias("duplicates"), n(u & ~c).alias("concept_discarded"), n(u & c).alias("candidates"),
        n(u & c & ~m).alias("metadata_discarded"), n(u & c & m).alias("final"),
    )


def score_audit(df: DataFrame, score: str, by: list[str] = ()) -> DataFrame:
    """One row, or one a group: count, mean, population deviation, quartiles and warnings on the spread of a score."""
    a = df.groupBy(*by).agg(
        F.count(score).alias("n"), F.round(F.avg(score), 9).alias("mean"), F.round(F.stddev_pop(score), 9).alias("std"),
        *(F.round(F.percentile(score, F.lit(p / 100)), 9).alias(f"p{p}") for p in (25, 50, 75)),
    )
    return a.withColumn("warnings", F.concat_ws(",", F.when(F.col("std") < 0.05, "low_variance"), F.when(F.col("mean") > 0.85, "too_lenient"), F.when(F.col("mean") < 0.15, "too_strict")))


def share_sentence(df: DataFrame, label: str, pct: str, verb: str, connector: str = "mientras que") -> DataFrame:
    """One row ``sentence``: the shares of a small table of categories in order of share, as the report words them."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct((-F.col(pct)).alias("o"), F.col(label).alias("l"), F.format_number(pct, 1).alias("p")))), lambda x: x)
    one = df.agg(cells.alias("c"))
    n = F.size("c")
    said = F.transform(
        "c", lambda x, i: F.when(i == 0, F.concat(F.lit("el "), x["p"], F.lit(f"% {verb} "), x["l"])).otherwise(F.concat(F.when((i == n - 1), "y el ").otherwise("el "), x["p"], F.lit("% en "), x["l"]))
    )
    two = F.concat(F.element_at("s", 1), F.lit(f", {connector} "), F.element_at("s", -1))
    return one.withColumn("s", said).select(F.when(n == 0, "").when(n == 2, two).otherwise(F.array_join("s", ", ")).alias("sentence"))


def head_and_rest(df: DataFrame, label: str, pct: str, most: int = 2) -> DataFrame:
    """(label, pct): the ``most`` largest shares and what they leave of 100, if that is more than 0.5."""
    top = df.orderBy(F.col(pct).desc(), label).limit(most).select(F.col(label).alias("label"), F.col(pct).alias("pct"))
    rest = top.agg(F.round(100 - F.coalesce(F.sum("pct"), F.lit(0.0)), 1).alias("pct")).where("pct > 0.5").select(F.lit("otras revistas").alias("label"), "pct")
    return top.unionByName(rest)


# States of acquisition and their labels.
ACQUISITION = (
    ("pdf_direct", "PDF descargado (directo)"), ("pdf_unpaywall", "PDF via Unpaywall"), ("pdf_s2", "PDF via Semantic Scholar"), ("abstract_proxy", "Abstract proxy (degradado)"),
    ("manual_pending", "Pendiente upload manual"), ("manual_done", "Upload manual completado"), ("failed", "Sin fuente disponible"),
)


def acquisition_report(df: DataFrame) -> DataFrame:
    """(status, label, n, pct) of the known states in a column ``status``; the share is of all rows, null counts as unknown."""
    label = F.create_map(*(F.lit(x) for pair in ACQUISITION for x in pair))[F.col("status")]
    total = df.agg(F.count(F.lit(1)).alias("t"))
    counts = df.groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total))
    return counts.select("status", label.alias("label"), "n", F.round(100 * F.col("n") / F.col("t"), 1).alias("pct")).where("label is not null")
