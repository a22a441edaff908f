"""Lexical and vector retrieval: tokens, corpus stop-words, BM25, TF-IDF mining, rank fusion and vector top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.operators.quantiles import quantiles
from sievemill.runtime import stored


# English function words.
ENGLISH = tuple(
    "a about above after again against all also although always am among an and any are around as at be because been before being below between both but by can cannot could did do does "
    "down during each either else even ever every few for from further get had has have having he her here hers him his how however i if in into is it its itself many may me might more "
    "most much must my neither never no nor not now of off often on once one only or other our ours out over own per perhaps rather same she should since so some still such than that the "
    "their them then there these they this those though through thus to together too toward under until up upon us very was we well were what when where whether which while who whose why "
    "will with within without would yet you your".split()
)


def tokens(c: Column, least: int = 2, most: int = 40) -> Column:
    """Folded lower-case tokens; a hyphenated word gives its parts and the joined form; lengths within the bounds."""
    raw = F.split(C.fold_accents(F.lower(F.coalesce(c, F.lit("")))), r"[^\w\-]+")
    words = F.filter(F.transform(raw, lambda w: F.regexp_replace(w, r"^-+|-+$", "")), lambda w: w != "")

    def parts(w: Column) -> Column:
        pieces = F.filter(F.split(w, "-"), lambda p: p != "")
        return F.when(w.contains("-"), F.concat(pieces, F.array(F.array_join(pieces, "")))).otherwise(F.array(w))

    return F.filter(F.flatten(F.transform(words, parts)), lambda t: F.length(t).between(least, most))


def token_bag(c: Column, least: int = 2, most: int = 40) -> Column:
    """The tokens of ``tokens`` without their order: plain words need no work of their own, hyphenated ones are few."""
    words = F.regexp_extract_all(C.fold_accents(F.lower(F.coalesce(c, F.lit("")))), F.lit(r"\w+(?:-+\w+)*"), F.lit(0))

    def parts(w: Column) -> Column:
        pieces = F.filter(F.split(w, "-"), lambda p: p != "")
        return F.concat(pieces, F.array(F.array_join(pieces, "")))

    plain = F.filter(words, lambda w: ~w.contains("-") & F.length(w).between(least, most))
    joined = F.flatten(F.transform(F.filter(words, lambda w: w.contains("-")), parts))
    return F.concat(plain, F.filter(joined, lambda t: F.length(t).between(least, most)))


def term_counts(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(doc, term, tf): one row a document and term; the explode is counted before anything is shuffled."""
    return df.select(F.col(id_col).alias("doc"), F.explode(token_bag(text)).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stopwords(freq: DataFrame, percentile: float = 97.0) -> DataFrame:
    """Terms whose document frequency reaches the percentile of all frequencies (linear interpolation)."""
    (cut,) = quantiles(freq, "df", (percentile / 100,))
    return freq.where(F.col("df") >= (F.lit(cut) if cut is not None else F.lit(None))).select("term", "df")


def bm25(counts: DataFrame, freq: DataFrame, stop: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, doc, score) of documents that share a term with a query; others have 0.

    Okapi weights over documents without corpus stop-words; negative weights become ``epsilon`` times the mean weight;
    a query's repeated terms count repeatedly. Queries (query_id, terms) are a bounded set that is broadcast.
    """
    stop = stored(stop.select("term"), "stop")
    kept = counts.join(stop, "term", "left_anti")
    lengths = stored(kept.groupBy("doc").agg(F.sum("tf").alias("dl")), "lengths")
    # four numbers about the corpus come to the driver
    n = counts.select("doc").distinct().count()
    total = lengths.agg(F.sum("dl")).first()[0] or 0
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weights = freq.join(stop, "term", "left_anti").withColumn("raw", raw)
    floor = epsilon * (weights.agg(F.avg("raw")).first()[0] or 0.0)
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighted = weights.join(F.broadcast(asked), "term").select("query_id", "term", (F.col("qtf") * F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw"))).alias("w"))
    hits = counts.join(F.broadcast(weighted), "term").join(lengths, "doc")
    saturation = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(total / max(1, n))))
    return hits.groupBy("query_id", "doc").agg(F.sum(F.col("w") * saturation).alias("score"))


def combine_queries(scores: DataFrame, n_queries: int, top: float = 0.7) -> DataFrame:
    """(doc, score): 0.7 of the best query and 0.3 of the mean over all queries, those without a hit included."""
    best = F.greatest(F.max("score"), F.lit(0.0)) if n_queries > 1 else F.max("score")
    return scores.groupBy("doc").agg((top * best + (1 - top) * F.sum("score") / n_queries).alias("score"))


def fuse_ranks(df: DataFrame, first: str, second: str, k: int = 60, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """The rows with ``fused``: reciprocal ranks of two score columns, weighted, scaled to [0, 1]; 0.5 if all are equal.

    Ties go by ord. Ranks come from a range-partitioned sort, not from one task.
    """
    r1 = ranked(df.select("ord", F.col(first).alias("s")), "s").withColumnRenamed("rank", "r1").drop("s")
    r2 = ranked(df.select("ord", F.col(second).alias("s")), "s").withColumnRenamed("rank", "r2").drop("s")
    both = df.join(r1, "ord").join(r2, "ord").withColumn("_raw", weights[0] / (k + F.col("r1")) + weights[1] / (k + F.col("r2")))
    span = both.agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise((F.col("_raw") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return both.join(F.broadcast(span)).withColumn("fused", scaled).drop("_raw", "_lo", "_hi")


def ranked(df: DataFrame, score: str) -> DataFrame:
    """(ord, score, rank): row number by score descending, then ord, without a single-task window.

    Rows are range-partitioned by score and numbered within partitions; the offsets are sums over one row a partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = stored(df.select("ord", F.col(score).alias(score)).repartitionByRange(parts, F.col(score).desc(), F.col("ord")).withColumn("_p", F.spark_partition_id()), "ranked")
    sizes = sorted_.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(F.col(score).desc(), "ord"))
    return sorted_.withColumn("_r", local).join(F.broadcast(offsets), "_p").select("ord", score, (F.col("_r") + F.col("_off")).alias("rank"))


def ngram_terms(words: Column, lo: int, hi: int) -> Column:
    """All runs of lo..hi words of an array, as phrases."""

    def runs(n: int) -> Column:
        spots = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        # single elements, as a slice would copy the whole array each time
        return F.transform(spots, lambda i: F.concat_ws(" ", *(F.get(words, i + (k - 1)) for k in range(n))))

    out = [runs(n) for n in range(lo, hi + 1)]
    return F.concat(*out)


def mine_terms(df: DataFrame, id_col: str, text: Column, lo: int = 1, hi: int = 3, features: int = 150, min_df: int = 2, top: int = 120, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(term, score): the terms with the highest mean of L2-normalised smooth TF-IDF among the ``features`` most frequent.

    Counts run over all documents; only the ``features`` terms take part in the second pass.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = df.select(F.col(id_col).alias("doc"), text.alias("_t"))
    if src.rdd.getNumPartitions() < parts:  # a small file is one task; its texts are spread before they grow into n-grams
        src = src.repartition(parts, "doc")
    text = F.col("_t")
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*stopwords) if stopwords else F.lit(True))
    # the words are a column of their own, as each n-gram looks into them; exploded as outer, since the filter that a plain explode
    # implies (not empty) would be pushed below that column and evaluate the words once an n-gram
    grams = src.select("doc", words.alias("_w")).select("doc", ngram_terms(F.col("_w"), lo, hi).alias("g"))
    # the first pass counts terms alone, with partial sums; the second keeps the chosen ones before it counts by document
    n = df.count()
    exploded = grams.select("doc", F.explode_outer("g").alias("term")).where("term is not null")
    if min_df <= 2:  # two documents have a term if the least and the greatest differ
        every = exploded.groupBy("term").agg(F.count(F.lit(1)).alias("cf"), (F.min("doc") != F.max("doc")).alias("_two")).where(F.col("_two") | F.lit(min_df < 2)).drop("_two")
    else:
        own = exploded.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
        every = own.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("_df")).where(F.col("_df") >= min_df).drop("_df")
    first = stored(every.orderBy(F.col("cf").desc(), "term").limit(features), "features")
    counts = grams.select("doc", F.explode_outer("g").alias("term")).join(F.broadcast(first), "term").groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = counts.join(F.broadcast(stats), "term").select("doc", "term", (F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("w"))
    norms = weighted.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    mean = weighted.join(norms, "doc").groupBy("term").agg((F.sum(F.col("w") / F.col("norm")) / n).alias("score"))
    return mean.orderBy(F.round("score", 9).desc(), "term").limit(top)


def top_by_cosine(df: DataFrame, query: list[float], k: int) -> DataFrame:
    """(vec_id, sim) of the k nearest vectors: a projection and a bounded top-k, no full sort."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return df.select("vec_id", C.cosine(F.col("embedding"), q).alias("sim")).orderBy(F.col("sim").desc(), "vec_id").limit(k)


def cosine_gate(df: DataFrame, query: list[float], text: Column, threshold: float, bypass: int = 150) -> DataFrame:
    """The rows with ``similarity`` (round 4) and ``passed``: short texts pass with 1.0, others at the threshold or above."""
    q = F.array(*(F.lit(float(x)) for x in query))
    sim = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < bypass, 1.0).otherwise(C.cosine(F.col("embedding"), q))
    return df.withColumn("_s", sim).withColumns({"similarity": F.round("_s", 4), "passed": F.coalesce(F.col("_s") >= threshold, F.lit(False))}).drop("_s")


def assign_category(df: DataFrame, centres: DataFrame, least: float = 0.19) -> DataFrame:
    """(vec_id, category, sim): the nearest of a few category vectors, a tie to the smaller; null below ``least``.

    The categories are a bounded set: their vectors become one array literal, so there is no join.
    """
    held = [(int(r["category"]), [float(x) for x in r["centre"]]) for r in centres.orderBy("category").limit(1001).collect()]
    if len(held) > 1000:
        raise ValueError("more than 1,000 categories")
    sims = [F.struct(C.cosine(F.col("embedding"), F.array(*(F.lit(x) for x in v))).alias("sim"), F.lit(-c).alias("neg")) for c, v in held]
    best = F.array_max(F.array(*sims))
    return df.select("vec_id", F.when(best["sim"] >= least, -best["neg"]).alias("category"), best["sim"].alias("sim"))


def chunk_context(df: DataFrame, query: list[float], keywords: list[str], k: int = 10, page: int = 0) -> DataFrame:
    """The page of the k best chunks by cosine plus 0.05 a keyword in them, back in the order of their position."""
    q = F.array(*(F.lit(float(x)) for x in query))
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    score = F.coalesce(C.cosine(F.col("embedding"), q), F.lit(0.0)) + 0.05 * sum((low.contains(w).cast("int") for w in keywords), F.lit(0))
    best = df.withColumn("score", score).orderBy(F.col("score").desc(), "pos").limit(k * (page + 1))
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "pos"))  # over k rows a page
    return best.withColumn("_r", rank).where(F.col("_r") > k * page).drop("_r").orderBy("pos")
