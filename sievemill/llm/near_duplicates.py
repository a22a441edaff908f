"""Problem 6: groups of near-duplicate records through a Gray-order hierarchical index of fingerprints.

1. A text becomes the set of its words. Equal sets are one text from here on.
2. A text gets a 128-bit fingerprint: one bit of each of 128 minima of hashed words, so that two texts of
   similarity J differ in about (1 - J) / 2 of the bits.
3. The upper nodes of the index are masked patterns: ``bands`` masks of ``rows`` minima each over all words, so
   that two texts share one by their similarity alone, however common their words are. A fingerprint is filed under each
   of its upper nodes, and only fingerprints that share one are compared.
4. In an upper node the fingerprints stand in Gray order, where neighbours differ in few bits. Close neighbours form a
   leaf; leaves form nodes of a fixed width with the bits that all of them share as the node's masked pattern. A whole
   node is pruned once the differences on the shared bits exceed the radius; what is left is compared member by member.
5. Upper nodes of more than ``hot`` fingerprints take two rounds: a few links a member first, then every pair of members
   that the first round's links, once checked, do not put into one group.
6. Links that survive are checked on the words themselves; records with equal key are linked as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.functions.text import usable, words
from sievemill.operators.components import components
from sievemill.runtime import stored

BITS = 128


@dataclass(frozen=True)
class IndexPlan:
    threshold: float = 0.7
    least_chars: int = 500
    bands: int = 64  # a pair of similarity 0.7 shares none of 64 nodes of 6 minima with a probability of 0.0003
    rows: int = 6
    radius: int = 32  # bits of 128; a pair of similarity 0.7 has 19.2 on average, with a deviation of 4
    leaf: int = 4  # bits to the first of a leaf
    sure: int = 12  # a member this close to one of a hot node's pivots is not held against its further pivots
    width: int = 16  # leaves a node
    hot: int = 512  # an upper node of more fingerprints takes two rounds
    pivots: int = 8  # members of a hot node that all others are held against in the first round
    chunk: int = 200_000  # fingerprints of one upper node held at once in the first round


def _mixers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def gray_rank(high: np.ndarray) -> np.ndarray:
    """Rank of a 64-bit word in the reflected Gray code: the prefix parities of its bits."""
    out = high.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def sign(flat: np.ndarray, starts: np.ndarray, plan: IndexPlan) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n x 2) and upper nodes (n x bands) of texts given as one array of word hashes, none empty."""
    mul, add = _mixers(BITS, 1)
    bits = np.zeros((len(starts), 2), dtype=np.uint64)
    for k in range(BITS):
        low = np.minimum.reduceat((flat * mul[k] + add[k]) >> np.uint64(20), starts)
        # a bit of the minimum that does not depend on its size
        bit = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
        bits[:, k // 64] |= bit << np.uint64(k % 64)
    mul, add = _mixers(plan.bands * plan.rows, 2)
    nodes = np.zeros((len(starts), plan.bands), dtype=np.uint64)
    for b in range(plan.bands):
        key = np.full(len(starts), b + 1, dtype=np.uint64)
        for r in range(b * plan.rows, (b + 1) * plan.rows):
            key = (key ^ np.minimum.reduceat((flat * mul[r] + add[r]) >> np.uint64(8), starts)) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        nodes[:, b] = key
    return bits, nodes


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1)


def _gray_order(ids: np.ndarray, bits: np.ndarray, group: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, gray_rank(bits[:, 1]), gray_rank(bits[:, 0]), group))


def _members(x: np.ndarray, y: np.ndarray, heads: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of members of the leaves x and y, about ``most`` at a time."""
    n = size[x] * size[y]
    big = n > most
    for p, q in zip(x[big], y[big], strict=True):
        step = max(1, most // int(size[q]))
        for at in range(0, int(size[p]), step):
            u = np.arange(heads[p] + at, heads[p] + min(at + step, int(size[p])))
            yield np.repeat(u, size[q]), np.tile(np.arange(heads[q], heads[q] + size[q]), len(u))
    x, y, n = x[~big], y[~big], n[~big]
    part = np.cumsum(n) // most
    for k in np.unique(part):
        u, v, m = x[part == k], y[part == k], n[part == k]
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        wide = np.repeat(size[v], m)
        yield np.repeat(heads[u], m) + at // wide, np.repeat(heads[v], m) + at % wide


def search_node(ids: np.ndarray, bits: np.ndarray, plan: IndexPlan, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the radius in one upper node of fingerprints in any order; those of one group are left out."""
    apart = group is not None
    group = group if apart else np.zeros(len(ids), dtype=np.int64)
    order = _gray_order(ids, bits, group)
    ids, bits, group = ids[order], bits[order], group[order]
    n = len(ids)
    if n < 2 or (apart and group[0] == group[-1]):
        return
    # leaves: runs of Gray-order neighbours of one group close to the first of the run
    heads, first = [], 0
    while first < n:
        heads.append(first)
        for reach in (64, 4096):
            ends = (_popcount(bits[first : first + reach] ^ bits[first]) > plan.leaf) | (group[first : first + reach] != group[first])
            if ends.any():
                break
        first += int(np.argmax(ends)) if ends.any() else len(ends)
    heads = np.array(heads)
    size = np.diff(np.append(heads, n))
    tops, owner, reach = bits[heads], group[heads], plan.radius + 2 * plan.leaf
    # nodes: the bits that all leaves of a node share, and their values
    cuts = np.arange(0, len(heads), plan.width)
    ones = np.bitwise_and.reduceat(tops, cuts, axis=0)
    zeros = ~np.bitwise_or.reduceat(tops, cuts, axis=0)
    shared = ones | zeros
    low, high = owner[cuts], owner[np.append(cuts[1:], len(heads)) - 1]
    for i, at in enumerate(cuts):
        near = _popcount((ones[i] ^ ones[i:]) & shared[i] & shared[i:]) <= reach
        if apart and low[i] == high[i]:
            near &= (low[i:] != low[i]) | (high[i:] != low[i])
        others = i + np.flatnonzero(near)
        for k in range(0, len(others), 4096):
            y = (cuts[others[k : k + 4096]][:, None] + np.arange(plan.width)).ravel()
            y = y[y < len(heads)]
            x = np.arange(at, min(at + plan.width, len(heads)))
            keep = (_popcount(tops[x][:, None] ^ tops[y][None]) <= reach) & (x[:, None] <= y)
            if apart:
                keep &= owner[x][:, None] != owner[y]
            p, q = np.nonzero(keep)
            for u, v in _members(x[p], y[q], heads, size):
                near_ = (u < v) & (_popcount(bits[u] ^ bits[v]) <= plan.radius)
                if near_.any():
                    yield ids[u[near_]], ids[v[near_]]


def _small_nodes(begin: np.ndarray, size: np.ndarray, ids: np.ndarray, bits: np.ndarray, plan: IndexPlan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the radius in many small nodes, those of one size at a time."""
    for n in np.unique(size):
        u, v = np.triu_indices(n, 1)
        of = begin[size == n]
        step = max(1, (1 << 20) // len(u))
        for k in range(0, len(of), step):
            a, b = (of[k : k + step, None] + u).ravel(), (of[k : k + step, None] + v).ravel()
            near = _popcount(bits[a] ^ bits[b]) <= plan.radius
            yield ids[a[near]], ids[b[near]]


def _near_batches(found: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Pairs, the smaller id first, each once in a batch."""
    got, n = [], 0
    for a, b in found:
        got.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        n += len(a)
        if n > most:
            yield np.unique(np.concatenate(got), axis=0)
            got, n = [], 0
    if n:
        yield np.unique(np.concatenate(got), axis=0)


FIRST = "a long, b long, node long, hi long, lo long"


def _links(plan: IndexPlan):
    """First round: all pairs of nodes that are not hot, as (a, b). A hot node gives the pairs of Gray-order neighbours and
    those with its pivots, and its members, as (a, node, hi, lo), for the second round."""

    def pairs_batch(pair: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(pair), pa.int64())
        return pa.record_batch({"a": pair[:, 0], "b": pair[:, 1], "node": none, "hi": none, "lo": none})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: dict[int, list] = {}  # of the node that is read in chunks

        def first_links(ids: np.ndarray, bits: np.ndarray, held: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            order = _gray_order(ids, bits, np.zeros(len(ids), dtype=np.int64))
            near = _popcount(bits[order[1:]] ^ bits[order[:-1]]) <= plan.radius
            yield ids[order[:-1]][near], ids[order[1:]][near]
            left = np.arange(len(ids))
            for k in range(plan.pivots):
                if not len(left):
                    break
                if k == len(held):
                    held.append((ids[left[0]], bits[left[0]].copy()))
                away = _popcount(bits[left] ^ held[k][1])
                near = (away <= plan.radius) & (ids[left] != held[k][0])
                yield np.full(near.sum(), held[k][0]), ids[left[near]]
                left = left[away > plan.sure]

        def hot(node: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            held = pivots.setdefault(int(node[0]), [])
            yield pa.record_batch({"a": ids, "b": pa.nulls(len(ids), pa.int64()), "node": node, "hi": bits[:, 0].view(np.int64), "lo": bits[:, 1].view(np.int64)})
            for pair in _near_batches(first_links(ids, bits, held)):
                yield pairs_batch(pair)

        def whole_nodes(node: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.diff(node)) + 1
            begin = np.concatenate(([0], edge)).astype(np.int64)
            size = np.diff(np.append(begin, len(node)))
            large = (size > plan.hot) | np.isin(node[begin], list(pivots))
            for at, n in zip(begin[large], size[large], strict=True):
                yield from hot(node[at : at + n], ids[at : at + n], np.ascontiguousarray(bits[at : at + n]))
            pivots.clear()
            small = ~large & (size > 1) & (size <= 32)

            def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                yield from _small_nodes(begin[small], size[small], ids, bits, plan)
                for at, n in zip(begin[~large & (size > 32)], size[~large & (size > 32)], strict=True):
                    yield from search_node(ids[at : at + n], bits[at : at + n], plan)

            for pair in _near_batches(found()):
                yield pairs_batch(pair)

        held: tuple | None = None
        for batch in batches:
            node, ids, hi, lo = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("node", "id", "hi", "lo"))
            bits = np.stack([hi, lo], 1).view(np.uint64)
            if held is not None:
                node, ids, bits = np.concatenate((held[0], node)), np.concatenate((held[1], ids)), np.concatenate((held[2], bits))
            if not len(node):
                continue
            whole = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            if whole:
                yield from whole_nodes(node[:whole], ids[:whole], bits[:whole])
            held = node[whole:], ids[whole:], bits[whole:]
            if len(held[0]) > plan.chunk:
                yield from hot(*held)
                held = held[0][:0], held[1][:0], held[2][:0]
        if held is not None and len(held[0]):
            yield from whole_nodes(*held)

    return run


def _links_between(plan: IndexPlan):
    """Second round: all pairs of different groups in the hot nodes (node, id, hi, lo, group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def of_node() -> Iterator[pa.RecordBatch]:
            ids, bits, group = (np.concatenate(x) for x in zip(*(h[1:] for h in held)))
            for pair in _near_batches(search_node(ids, bits, plan, group)):
                yield pa.record_batch({"a": pair[:, 0], "b": pair[:, 1]})

        for batch in batches:
            node, ids, hi, lo, group = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("node", "id", "hi", "lo", "group"))
            bits = np.stack([hi, lo], 1).view(np.uint64)
            edge = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1, [len(node)])).astype(np.int64)
            for at, stop in zip(edge[:-1], edge[1:], strict=True):
                if at == stop:
                    continue
                if held and held[0][0] != node[at]:
                    yield from of_node()
                    held = []
                held.append((node[at], ids[at:stop], bits[at:stop], group[at:stop]))
        if held:
            yield from of_node()

    return run


def _signer(plan: IndexPlan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            offsets = lists.offsets.to_numpy()
            starts = (offsets[:-1] - offsets[0]).astype(np.int64)
            if not len(starts):
                continue
            mixed = flat * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            bits, nodes = sign(mixed, starts, plan)
            k = plan.bands
            yield pa.record_batch({
                "node": nodes.view(np.int64).ravel(),
                "id": np.repeat(batch.column("id").to_numpy(zero_copy_only=False), k),
                "hi": np.repeat(bits[:, 0].view(np.int64), k),
                "lo": np.repeat(bits[:, 1].view(np.int64), k),
            })

    return run


def _texts(df: DataFrame, plan: IndexPlan, columns: dict[str, str]) -> DataFrame:
    c = {k: F.col(v) for k, v in columns.items()}
    fit = usable(c["abstract"]) & (F.length(c["abstract"]) >= plan.least_chars)
    both = F.concat_ws(" ", c["title"], c["abstract"])
    hashed = F.array_sort(F.array_distinct(F.transform(words(both), lambda w: F.hash(w))))
    return df.select(
        c["id"].cast("long").alias("id"),
        F.nullif(F.trim(c["key"]), F.lit("")).alias("key"),
        F.when(fit, hashed).alias("words"),
    ).withColumn("set_key", F.when(F.size("words") > 0, F.xxhash64("words")))


COLUMNS = {"id": "record_id", "title": "title", "abstract": "abstract", "key": "doi_normalized"}


def similarity_links(texts: DataFrame, plan: IndexPlan = IndexPlan()) -> DataFrame:
    """(a, b, jaccard): links between different texts (id, words) whose similarity reaches the threshold.

    In a hot node, pairs that are in one group by the links of the first round are not looked at any more.
    """
    left, right = texts.select(F.col("id").alias("a"), F.col("words").alias("wa")), texts.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    similarity = shared / (F.size("wa") + F.size("wb") - shared)

    def checked(near: DataFrame) -> DataFrame:
        return near.distinct().join(left, "a").join(right, "b").select("a", "b", similarity.alias("jaccard")).where(F.col("jaccard") >= plan.threshold)

    filed = texts.select("id", "words").mapInArrow(_signer(plan), "node long, id long, hi long, lo long")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = stored(filed.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_links(plan), FIRST), "near")
    links = checked(first.where("b is not null").select("a", "b"))
    hot = first.where("b is null").select("node", F.col("a").alias("id"), "hi", "lo")
    if not hot.take(1):
        return links
    links = stored(links, "first-links")
    group = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("id"), F.col("component").alias("group"))
    grouped = hot.join(group, "id", "left").select("node", "id", "hi", "lo", F.coalesce("group", "id").alias("group"))
    between = grouped.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_links_between(plan), "a long, b long")
    return links.unionAll(checked(between))


def duplicate_groups(df: DataFrame, plan: IndexPlan = IndexPlan(), columns: dict[str, str] | None = None) -> DataFrame:
    """One row per record: record_id, group_id (the least record_id of its group), n_links.

    Records belong together if their keys are equal and not blank, or if both have a usable abstract
    of ``least_chars`` or more and the words of title and abstract, each once, agree in ``threshold`` or more (shared
    words by words in either); groups are closed. ``n_links`` counts the links between different texts that the index
    found for the record's text (copies share it; in a hot node those that its group needs) and is 0 for records without. Nulls: a record without
    key and without fit abstract is its own group; a null title counts as no words. Rows that repeat a record_id are one record.
    """
    texts = stored(_texts(df, plan, columns or COLUMNS), "texts")
    sets = texts.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("id"))
    distinct = stored(texts.where("set_key is not null").join(sets, ["set_key", "id"], "left_semi").dropDuplicates(["id"]).select("id", "words"), "sets")
    links = stored(similarity_links(distinct, plan), "links")
    by_key = texts.where("key is not null").groupBy("key").agg(F.min("id").alias("v"))
    edges = (
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionAll(texts.join(sets.select("set_key", F.col("id").alias("v")), "set_key").select(F.col("id").alias("u"), "v"))
        .unionAll(texts.where("key is not null").join(by_key, "key").select(F.col("id").alias("u"), "v"))
    )
    found = components(edges)
    degree = links.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    members = texts.select("id", "set_key").distinct()
    withset = members.join(sets.select("set_key", F.col("id").alias("set_id")), "set_key", "left").join(degree, "set_id", "left")
    return (
        withset.join(found, F.col("id") == F.col("node"), "left")
        .select(F.col("id").alias("record_id"), F.coalesce("component", "id").alias("group_id"), F.coalesce("n", F.lit(0)).alias("n_links"))
    )


def group_pairs(groups: DataFrame) -> DataFrame:
    """All pairs (record_a < record_b) of records in one group: the expansion that a report of pairs asks for."""
    left = groups.select("group_id", F.col("record_id").alias("record_a"))
    right = groups.select("group_id", F.col("record_id").alias("record_b"))
    return left.join(right, "group_id").where("record_a < record_b").select("record_a", "record_b")
