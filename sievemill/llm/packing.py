"""Problem 8: filling containers of fixed capacity with documents, by vector bin packing.

A document has three sizes: its tokens, one segment, and the tokens that bear loss. A container has a limit on each. Items
are spread over blocks of a bounded number of rows by a hash of their id, so that no key can make a block hot, and each
block is packed by the dot-product heuristic: a container is filled with the item, among those that fit, whose
sizes have the largest weighted dot product with what is left of the container (Panigrahy et al. 2011); the weight of a
dimension is its mean demand. Documents beyond the capacity are divided into runs of tokens; all others stay whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.runtime import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the tokenizer's vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class PackPlan:
    capacity: int = 2048  # tokens
    segments: int = 48
    loss_tokens: int = 2016  # a part that bears more by itself has a container of its own, as only the capacity divides
    block: int = 6000  # items packed together
    tokenizer: str = TOKENIZER


def shipped_tokenizer(docs: DataFrame, plan: PackPlan) -> str:
    """The vocabulary file given to the executors, wherever it lies: once a session; its name there."""
    sc = docs.sparkSession.sparkContext
    done = shipped_tokenizer.__dict__.setdefault("done", set())
    if (sc.applicationId, plan.tokenizer) not in done:
        sc.addFile(plan.tokenizer)
        done.add((sc.applicationId, plan.tokenizer))
    return plan.tokenizer.rsplit("/", 1)[-1]


@lru_cache
def tokenizer(name: str):
    import tiktoken
    from pyspark import SparkFiles

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def loss_start(text: str) -> int:
    """Where loss begins: after the first line, which is the prompt, if there is more than one; else at the start."""
    head, _, rest = text.partition("\n")
    return len(head) + 1 if rest.strip() else 0


def count_tokens(docs: DataFrame, plan: PackPlan) -> DataFrame:
    """(doc_id, tokens, prompt_tokens) of every document; a null text has no tokens."""
    name = shipped_tokenizer(docs, plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(name)
        for batch in batches:
            tokens, prompt = [], []
            for t in batch.column("text").to_pylist():
                t = t or ""
                cut = loss_start(t)
                head = len(enc.encode_ordinary(t[:cut])) if cut else 0
                prompt.append(head)
                tokens.append(head + len(enc.encode_ordinary(t[cut:])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(prompt, pa.int64())], names=["doc_id", "tokens", "prompt_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens long, prompt_tokens long")


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item (rows of sizes, each within the limits), by the dot-product heuristic."""
    n = len(sizes)
    share = sizes / limits
    # equal items are one kind with a count: ties and copies cost nothing more
    kinds, kind_of = np.unique(sizes, axis=0, return_inverse=True)
    kind_of = kind_of.ravel()
    left = np.bincount(kind_of, minlength=len(kinds))
    weight = share.mean(0)
    part = kinds / limits
    out = np.empty(n, dtype=np.int64)
    queue = np.argsort(kind_of, kind="stable")
    next_at = np.concatenate(([0], np.cumsum(left)[:-1]))
    live = np.arange(len(kinds))
    bin_, remaining = 0, n
    while remaining:
        room = limits.astype(np.float64).copy()
        took = False
        open_ = live
        while True:
            open_ = open_[(left[open_] > 0) & (kinds[open_] <= room).all(1)]
            if not len(open_):
                break
            gain = (part[open_] * (weight * room / limits)).sum(1)
            k = int(open_[gain.argmax()])
            # an item that fills the container exactly in its first size is the better end
            exact = open_[kinds[open_, 0] == room[0]]
            if len(exact):
                k = int(exact[0])
            out[queue[next_at[k]]] = bin_
            next_at[k] += 1
            left[k] -= 1
            room -= kinds[k]
            remaining -= 1
            took = True
        live = live[left[live] > 0]
        if took:
            bin_ += 1
        elif remaining:
            raise ValueError("an item exceeds the limits")
    return out


def _divide(counted: DataFrame, plan: PackPlan) -> DataFrame:
    """Items (doc_id, part_no, start_token, tokens, loss_tokens): whole documents, and the runs of those beyond the capacity."""
    most = plan.capacity
    over = F.col("tokens") > plan.capacity
    parts = F.when(over, F.ceil(F.col("tokens") / F.lit(most))).otherwise(F.lit(1)).cast("int")
    rows = counted.withColumn("parts", parts).withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    start = F.when(F.col("parts") > 1, F.col("part_no") * most).otherwise(F.lit(0)).cast("long")
    size = F.when(F.col("parts") > 1, F.least(F.lit(most), F.col("tokens") - start)).otherwise(F.col("tokens"))
    borne = F.greatest(F.lit(0), F.least(size, start + size - F.col("prompt_tokens")))
    return rows.select("doc_id", "part_no", "parts", start.alias("start_token"), size.cast("long").alias("tokens"), borne.cast("long").alias("loss_tokens"))


def fill_containers(docs: DataFrame, plan: PackPlan = PackPlan()) -> DataFrame:
    """(container_id, doc_id, part_no, parts, start_token, tokens, loss_tokens): every document in its container.

    Only documents beyond the capacity have several parts. Null and empty texts take no tokens but a segment; rows that repeat
    a doc_id are packed each. A container_id is unique over all blocks, and the same input gives the same containers.
    """
    items = stored(_divide(count_tokens(docs, plan), plan), "items")
    blocks = max(1, -(-items.count() // plan.block))
    limits = np.array([plan.capacity, plan.segments, plan.loss_tokens], dtype=np.int64)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part_no"], kind="stable")
        sizes = np.stack([pdf["tokens"], np.where(pdf["loss_tokens"] > plan.loss_tokens, plan.segments, 1), np.minimum(pdf["loss_tokens"], plan.loss_tokens)], 1).astype(np.int64)
        pdf["container_id"] = pack(sizes, limits) * blocks + pdf["block"].to_numpy()
        return pdf[["container_id", "doc_id", "part_no", "parts", "start_token", "tokens", "loss_tokens"]]

    # blocks are few and small in bytes but dear in time: as many tasks as blocks, which adaptive coalescing would fold into one
    spread = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(blocks))).repartition(blocks, "block")
    return spread.groupBy("block").applyInPandas(run, "container_id long, doc_id long, part_no int, parts int, start_token long, tokens long, loss_tokens long")


def fill_report(packed: DataFrame, plan: PackPlan = PackPlan()) -> DataFrame:
    """One row: containers, documents, divided documents, tokens, and the share of the capacity that is used."""
    per = packed.groupBy("container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("s"), F.sum("loss_tokens").alias("l"))
    a = per.agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("most_tokens"), F.max("s").alias("most_segments"), F.max("l").alias("most_loss_tokens"))
    d = packed.agg(F.count(F.when(F.col("part_no") == 0, 1)).alias("documents"), F.count(F.when((F.col("part_no") == 0) & (F.col("parts") > 1), 1)).alias("divided"))
    return a.join(F.broadcast(d)).withColumn("used", F.round(F.col("tokens") / (F.col("containers") * plan.capacity), 6))
