"""Scores, thresholds and classes of articles, and everything around the answers of an external judge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.operators.quantiles import quantiles


def robust_scale(df: DataFrame, score: str, out: str = "scaled", lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Scores clipped to two percentiles and scaled to [0, 1]; 0.5 where both are equal."""
    a, b = quantiles(df, score, (lo, hi))
    if a is None or a == b:
        return df.withColumn(out, F.lit(0.5))
    return df.withColumn(out, (F.least(F.greatest(F.col(score), F.lit(a)), F.lit(b)) - a) / (b - a))


def phrases(queries: list[str], lo: int, hi: int) -> list[str]:
    """Distinct runs of lo..hi words of the queries, in order."""
    out: dict[str, None] = {}
    for q in queries:
        w = q.lower().split()
        for n in range(lo, min(hi, len(w)) + 1):
            for i in range(len(w) - n + 1):
                out[" ".join(w[i : i + n])] = None
    return list(out)


def _hits(text: Column, terms) -> Column:
    return sum((text.contains(t.lower()).cast("int") for t in terms), F.lit(0))


def domain_relevance(title: Column, abstract: Column, queries: list[str], keywords: list[str]) -> Column:
    """Steps by the number of query phrases (2 to 4 words) in the text, else by keywords."""
    low = F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lit(". "), F.lower(F.coalesce(abstract, F.lit(""))))
    n, m = _hits(low, phrases(queries, 2, 4)), _hits(low, keywords)
    return F.when(n >= 3, 1.0).when(n == 2, 0.75).when(n == 1, 0.5).when(m == 0, 0.0).when(m == 1, 0.4).when(m == 2, 0.7).otherwise(1.0)


def keyword_boost(title: Column, abstract: Column, terms: list[str], queries: list[str] = (), poles: tuple = ()) -> Column:
    """Coverage of the terms and of the first three, less without a shared run of three words or without both poles."""
    if not terms:
        return F.lit(0.0)
    low = F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lit(". "), F.lower(F.coalesce(abstract, F.lit(""))))
    n = _hits(low, terms)
    score = 0.4 * n / len(terms) + 0.6 * _hits(low, terms[:3]) / len(terms[:3])
    if queries:
        score = F.when((n >= 2) & (_hits(low, phrases(list(queries), 3, 3)) == 0), score * 0.5).otherwise(score)
    if len(poles) >= 2:
        score = F.when((_hits(low, poles[0]) > 0) & (_hits(low, poles[1]) > 0), score).otherwise(score * 0.85)
    return score


@dataclass(frozen=True)
class Pico:
    p: tuple[str, ...] = ()
    i: tuple[str, ...] = ()
    c: tuple[str, ...] = ()
    o: tuple[str, ...] = ()

    def boosts(self) -> list[str]:
        """Phrases that count extra: terms of several words, and pairs of the first population and intervention terms."""
        first = [[t.lower().strip() for t in ts if len(t.strip()) > 4][:3] for ts in (self.p, self.i)]
        out = [t for ts in first for t in ts if " " in t]
        for a in first[0][:2]:
            for b in first[1][:2]:
                out += [f"{a} {b}", f"{b} {a}"]
        return list(dict.fromkeys(out))[:12]


def lexical_relevance(title: Column, abstract: Column, citations: Column, pico: Pico) -> Column:
    """Weighted term hits, a bonus for population and intervention together, phrase boosts and damped citations."""
    t, a = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(abstract, F.lit("")))
    both = F.concat(t, F.lit(" "), a)
    long_ = lambda ts: [x.lower().strip() for x in ts if len(x.strip()) > 3]
    p, i, o = _hits(both, long_(pico.p)), _hits(both, long_(pico.i)), _hits(both, long_(pico.o))
    score = 3.0 * p + 2.0 * i + 1.0 * o + F.when((p > 0) & (i > 0), 25.0).otherwise(0.0)
    for b in pico.boosts():
        score = score + F.when(t.contains(b), 8.0).when(a.contains(b), 3.0).otherwise(0.0)
    return score + F.least(F.lit(10.0), F.log1p(F.greatest(F.coalesce(citations, F.lit(0)), F.lit(0)).cast("double")) * 1.5)


def hybrid_score(fuzzy: Column, relevance: Column, exclusion_hits: Column) -> Column:
    return F.least(F.greatest(0.6 * fuzzy + 0.4 * relevance - 0.15 * exclusion_hits, F.lit(0.0)), F.lit(1.0))


def adaptive_threshold(df: DataFrame, score: str, target: int = 50, floor: float = 0.40) -> DataFrame:
    """One row: the score of rank ``target`` (the last if there are fewer), the floor at least."""
    top = df.select(score).where(F.col(score).isNotNull()).orderBy(F.col(score).desc()).limit(target)
    return top.agg(F.greatest(F.coalesce(F.min(score), F.lit(floor)), F.lit(floor)).alias("threshold"))


def dual_thresholds(df: DataFrame, score: str, min_floor: float = 0.05, conservative: bool = False) -> DataFrame:
    """One row (floor, auto_include) from the 5th and 50th percentiles."""
    p = df.sparkSession.createDataFrame([tuple(quantiles(df, score, (0.05, 0.5)))], "p5 double, p50 double")
    if conservative:
        return p.select(F.greatest(F.lit(0.05), F.col("p5") * 0.5).alias("floor"), (F.col("p50") * 0.95).alias("auto_include"))
    return p.select(
        F.greatest(F.lit(min_floor), F.least(F.lit(0.30), F.col("p5"))).alias("floor"), F.greatest(F.lit(0.45), F.least(F.lit(0.60), F.col("p50"))).alias("auto_include")
    )


def three_zones(df: DataFrame, thresholds: DataFrame, score: str = "similarity", domain: str = "domain_relevance") -> DataFrame:
    """The rows with ``status`` (auto_include, grey_zone, auto_exclude) and ``rescued`` for those the domain lifts into the grey."""
    s, saved = F.col(score), F.coalesce(F.col(domain), F.lit(0.0)) >= 0.40
    status = F.when(s >= F.col("auto_include"), "auto_include").when((s >= F.col("floor")) | saved, "grey_zone").otherwise("auto_exclude")
    return df.join(F.broadcast(thresholds)).withColumns({"status": status, "rescued": (s < F.col("floor")) & saved}).drop("floor", "auto_include")


# The criteria of a judge's answer.
CRITERIA = ("population", "intervention", "outcome", "context", "comparator", "study_design")


def parse_verdict(df: DataFrame, response: str = "response", atom_score: Column | None = None) -> DataFrame:
    """A judge's free-form answer as columns: criteria, criteria_score, score, decision, passed, near_miss.

    Fences and prose around the object do not matter; a missing criterion and an answer without an object are NO; only YES
    is yes.
    """
    body = C.json_object(F.col(response))
    get = {c: F.upper(F.trim(F.coalesce(F.get_json_object(body, f"$.{c}"), F.get_json_object(body, f"$.{c}_yes_no"), F.lit("NO")))) for c in CRITERIA}
    yes = {c: v == "YES" for c, v in get.items()}
    share = sum((v.cast("int") for v in yes.values()), F.lit(0)) / len(CRITERIA)
    atom = F.lit(1.0) if atom_score is None else atom_score
    all_yes = F.lit(True)
    for v in yes.values():
        all_yes = all_yes & v
    ok = all_yes & (atom >= 1.0)
    score = F.least(share, atom)
    said = F.upper(F.trim(F.coalesce(F.get_json_object(body, "$.decision"), F.when(ok, "INCLUDE").otherwise("EXCLUDE"))))
    said = F.when((atom < 1.0) & (said == "INCLUDE"), F.when(score >= 0.5, "BACKGROUND_ONLY").otherwise("EXCLUDE")).otherwise(said)
    passed = ok & (said == "INCLUDE")
    decision = F.when(said.isin("INCLUDE", "EXCLUDE", "BACKGROUND_ONLY"), said).when(passed, "INCLUDE").otherwise("EXCLUDE")
    return df.withColumns({"criteria_score": F.round(share, 4), "score": F.round(score, 4), "decision": decision, "passed": passed, "near_miss": ~passed & (score >= 0.5)})


def majority(df: DataFrame, id_col: str) -> DataFrame:
    """(id, passed, score, runs) over judge runs (id, vote, score): two votes pass; a single run speaks for itself; without
    any usable run the row passes with 5.0."""
    n, yes = F.count("vote"), F.sum(F.col("vote").cast("int"))
    passed = F.when(n == 0, True).when(n == 1, yes == 1).otherwise(yes >= 2)
    return df.groupBy(id_col).agg(passed.alias("passed"), F.round(F.coalesce(F.avg("score"), F.lit(5.0)), 9).alias("score"), n.alias("runs"))


def combine_criteria(df: DataFrame) -> DataFrame:
    """Category scores to one: reviews get little for inclusion; hard exclusion below 2."""
    s = F.when(F.col("is_review"), F.least("s", F.lit(3.0))).otherwise(F.col("s"))
    total = 0.25 * F.col("embedding_score") + 0.45 * F.col("i") / 10 + 0.30 * s / 10
    return df.withColumns({"combined": F.round(total, 6), "hard_exclude": F.col("i") < 2})


def compose_rerank(df: DataFrame, top_n: int, order: str = "prior") -> DataFrame:
    """The rows with ``final`` and ``position``: the judged head by half its own and half the composed score, then the tail
    as it was."""
    composed = 0.35 * F.col("thematic") + 0.25 * F.col("slr") + 0.20 * F.col("methodological") + 0.20 * F.col("contribution")
    judged = (F.col("rank") <= top_n) & F.col("judge").isNotNull()
    return df.withColumns({"is_tail": F.col("rank") > top_n, "final": F.round(F.when(judged, 0.5 * F.col("judge") + 0.5 * composed).otherwise(F.col(order)), 9)})


def grey_outcome(relevant: Column, similarity: Column) -> Column:
    return F.when(relevant, F.greatest(similarity, F.lit(0.55))).otherwise(F.least(similarity, F.lit(0.25)))


