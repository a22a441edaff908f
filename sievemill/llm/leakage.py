"""Problem 9: evaluation items leaking into documents, whole, in part or with other numbers and names.

Words are brought to templates: numbers, names and units become typed placeholders. Windows of consecutive templates of
the items are joined by hash with those of the documents; where windows meet, the slots decide. If every
placeholder holds the same word on both sides the passage is the item's own; if one mapping takes the item's slots to
the document's throughout, the item was re-parameterised; else the match is dropped.

A window of fewer than ``plain`` plain words, such as a row of figures, stands for its words and not for its template. A
match by parameters must be one that chance does not give: its windows belong to no other item (equal items count as
one), and a slot occurs twice in it, so that the mapping is put to the test. What stands for a name depends on the
word alone wherever a word belongs to an item, so that equal words always have equal templates.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.runtime import stored

WORD = re.compile(r"[^\W_]+")
# Units that vary with the numbers of a question.
UNITS = frozenset("percent por ciento km kg mg g mm cm m ml l h min days weeks months years hours minutes dias semanas meses años horas minutos jours semaines mois ans tage wochen monate jahre giorni settimane mesi anni".split())
NUM, NAME, UNIT = "\x01", "\x02", "\x03"
SLOTS = frozenset((NUM, NAME, UNIT))


@dataclass(frozen=True)
class LeakPlan:
    window: int = 12  # words
    plain: int = 5  # plain words from which a window stands for its template
    broadcast_words: int = 2_000_000  # items of more words together are joined with the documents' windows by a shuffle
    filter_bits: int = 1 << 26  # of the Bloom filter that the documents' windows pass before that shuffle


def capital_uses(texts: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    """By lower-case word: uses in small letters, and with a capital where no sentence begins."""
    small: dict[str, int] = defaultdict(int)
    capital: dict[str, int] = defaultdict(int)
    for t in texts:
        for m in WORD.finditer(t):
            w = m.group()
            if w[:1].isalpha():
                low, before = w.lower(), t[: m.start()].rstrip()
                small[low] += not w[0].isupper()
                capital[low] += w[0].isupper() and bool(before) and before[-1] not in ".!?¿¡:;"
    return small, capital


class Vocabulary:
    """The items' words: which of them are names. Built from the items alone, which are a held-out set of fixed size."""

    def __init__(self, texts: list[str]) -> None:
        small, capital = capital_uses(texts)
        self._settle(small, capital)

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]]) -> Vocabulary:
        """From counts by word: (word, uses in small letters, uses with a capital inside sentences)."""
        out = cls([])
        out._settle({w: s for w, s, _ in rows}, {w: c for w, _, c in rows})
        return out

    def _settle(self, small: dict[str, int], capital: dict[str, int]) -> None:
        self.plain = frozenset(w for w, n in small.items() if n >= capital[w] and (n or not capital[w]))
        self.names = frozenset(capital).difference(self.plain)

    def template(self, words: list[str]) -> list[str]:
        """Typed placeholders or the lower-case words themselves; ``words`` in their own case."""
        out = []
        for w in words:
            low = w.lower()
            if any(c.isdigit() for c in w):
                out.append(NUM)
            elif low in self.names:
                out.append(NAME)
            elif low in UNITS:
                out.append(UNIT)
            elif low in self.plain:
                out.append(low)
            else:
                # no item has this word: a name if it is written like one
                out.append(NAME if w[:1].isupper() else low)
        return out


def code(word: str) -> int:
    """A hash of a word or placeholder, the same everywhere."""
    data = word.encode()
    return (zlib.crc32(data) << 32 ^ zlib.adler32(data) * 2654435761) & 0xFFFFFFFFFFFFFFF or 1


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every window of n codes."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k]
    return out


class Windows:
    """Hashes of the windows of texts: of their templates, or of their words where these are hardly more than slots."""

    def __init__(self, vocabulary: Vocabulary, plan: LeakPlan) -> None:
        self.vocabulary, self.plan = vocabulary, plan
        words = vocabulary.plain | vocabulary.names | {NUM, NAME, UNIT} | UNITS
        # words that no item has share one number, which no window of an item contains
        self.codes = {w: code(w) for w in words}

    def hashes(self, words: list[str]) -> np.ndarray:
        n, known = self.plan.window, self.codes
        if len(words) < n:
            return np.zeros(0, np.uint64)
        templates = self.vocabulary.template(words)
        by_template = window_hashes(np.fromiter((known.get(t, 0) for t in templates), np.uint64, len(words)), n)
        slots = np.cumsum([0, *(t in SLOTS for t in templates)])
        thin = n - (slots[n:] - slots[:-n]) < self.plan.plain
        if thin.any():
            # figures need not be known words: they are hashed as they are
            own = np.fromiter((code(w.lower()) if t in SLOTS else known.get(t, 0) for w, t in zip(words, templates, strict=True)), np.uint64, len(words))
            by_template = np.where(thin, window_hashes(own, n) ^ np.uint64(1 << 61), by_template)
        return by_template


class ItemIndex:
    """Template windows of the items, by hash."""

    def __init__(self, items: list[tuple[int, str]], plan: LeakPlan) -> None:
        self.plan = plan
        self.maker = Windows(Vocabulary([t for _, t in items]), plan)
        self.lower, self.windows = {}, defaultdict(list)
        for i, t in items:
            words = WORD.findall(t)
            self.lower[i] = [w.lower() for w in words]
            for at, h in enumerate(self.maker.hashes(words).tolist()):
                self.windows[h].append((i, at))
        self.hashes = np.array(sorted(self.windows), dtype=np.uint64)
        # windows that differing items have in common prove no item by parameters
        self.shared = {h for h, places in self.windows.items() if len({tuple(self.lower[i]) for i, _ in places}) > 1}


def _runs(places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Windows that follow one another on both sides, as (place in the text, place in the item, windows)."""
    out: list[tuple[int, int, int]] = []
    for p, q in sorted(places, key=lambda x: (x[0] - x[1], x[0])):
        if out and out[-1][0] - out[-1][1] == p - q and out[-1][0] + out[-1][2] == p:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + 1)
        else:
            out.append((p, q, 1))
    return out


def tested(own: list[str], there: list[str]) -> bool:
    """Whether one mapping takes each word of the item to one counterpart throughout, and a changed one is met twice."""
    to: dict[str, str] = {}
    back: dict[str, str] = {}
    again = False
    for a, b in zip(own, there, strict=True):
        again |= a != b and a in to
        if to.setdefault(a, b) != b:
            return False
        if not b[:1].isdigit() and back.setdefault(b, a) != a:
            return False
    return again


def judge(places: list[tuple[int, int, bool]], own: list[str], low, n: int) -> tuple[str, int] | None:
    """How an item's windows stand in a text, and how many: places are (in the text, in the item, shared with other items)."""
    exact = sum(list(low(p, p + n)) == own[q : q + n] for p, q, _ in places)
    if exact:
        return "verbatim", exact
    consistent = 0
    for p, q, count in _runs([(p, q) for p, q, shared in places if not shared]):
        span = count + n - 1
        if tested(own[q : q + span], list(low(p, p + span))):
            consistent += count
    return ("parameters", consistent) if consistent else None


def match(text: str, index: ItemIndex) -> dict[int, tuple[str, int]]:
    """Per item: how its windows stand in the text (``verbatim`` or ``parameters``) and how many windows do."""
    words = WORD.findall(text)
    n = index.plan.window
    if len(words) < n or not len(index.hashes):
        return {}
    hashes = index.maker.hashes(words)
    at = np.searchsorted(index.hashes, hashes)
    hits = np.flatnonzero(index.hashes[np.minimum(at, len(index.hashes) - 1)] == hashes)
    if not len(hits):
        return {}
    low = [w.lower() for w in words]
    by_item: dict[int, list[tuple[int, int, bool]]] = defaultdict(list)
    for p in hits.tolist():
        h = int(hashes[p])
        for item, q in index.windows[h]:
            by_item[item].append((p, q, h in index.shared))
    found = ((item, judge(places, index.lower[item], lambda a, b: low[a:b], n)) for item, places in by_item.items())
    return {item: how for item, how in found if how}


def _search(index: ItemIndex):
    kind = "id long, item_id long, how string, windows int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [(doc, item, how, n) for item, (how, n) in match(text, index).items()]
            if rows:
                ids, items, hows, ns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(hows, pa.string()), pa.array(ns, pa.int32())], names=["id", "item_id", "how", "windows"])

    return run, kind


def _bloom_places(h: np.ndarray, bits: int) -> np.ndarray:
    """Three places of each hash in a filter of ``bits`` bits."""
    mixed = [(h * np.uint64(k)) >> np.uint64(17) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
    return np.stack(mixed) % np.uint64(bits)


def _by_shuffle(src: DataFrame, held: DataFrame, plan: LeakPlan) -> DataFrame:
    """The same search for item sets of any size: one pass over the documents, whose windows meet the items' by a hash join.

    Only windows that pass a Bloom filter of the items' windows are shuffled, each with its words. The vocabulary (distinct
    words) and the filter (``filter_bits``) are all that goes to the executors.
    """
    spark = held.sparkSession
    counts = held.select(F.regexp_replace("text", r"\s+", " ").alias("text")).mapInArrow(_capitals, "w string, small long, capital long").groupBy("w").agg(F.sum("small").alias("small"), F.sum("capital").alias("capital"))
    vocabulary = Vocabulary.of([(r["w"], r["small"], r["capital"]) for r in counts.collect()])
    maker, n = Windows(vocabulary, plan), plan.window

    def windows(ids: str, keep: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for i, text in zip(batch.column(ids).to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = WORD.findall(text)
                    hashes = maker.hashes(words)
                    if keep is None:
                        some = range(len(hashes))
                    else:
                        at = _bloom_places(hashes, plan.filter_bits)
                        some = np.flatnonzero((keep[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(0)).tolist()
                    low = [w.lower() for w in words]
                    out += [(int(np.int64(hashes[p].view(np.int64))), i, p, " ".join(low[p : p + n])) for p in some]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["h", ids, "p", "w"])

        return run

    own = stored(held.select("item_id", "text").mapInArrow(windows("item_id", None), "h long, item_id long, p int, w string"), "windows")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(plan.filter_bits // 8, np.uint8)
        for batch in batches:
            at = _bloom_places(batch.column("h").to_numpy().view(np.uint64), plan.filter_bits).ravel()
            np.bitwise_or.at(field, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        filled = np.flatnonzero(field)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(field[filled].astype(np.int32))], names=["at", "b"])

    field = np.zeros(plan.filter_bits // 8, np.uint8)
    for r in own.select("h").mapInArrow(bits, "at long, b int").groupBy("at").agg(F.bit_or("b").alias("b")).toLocalIterator():
        field[r["at"]] = r["b"]
    # a window that differing items hold is shared; equal items are told by their text
    texts = held.select("item_id", F.xxhash64(F.lower("text")).alias("t"))
    shared = own.select("h", "item_id").join(texts.hint("merge"), "item_id").groupBy("h").agg((F.min("t") != F.max("t")).alias("shared"))
    items = own.join(shared.hint("merge"), "h").select("h", "item_id", F.col("p").alias("q"), F.col("w").alias("own"), "shared")
    met = src.mapInArrow(windows("id", field), "h long, id long, p int, w string").join(items.hint("shuffle_hash"), "h").distinct()

    def resolve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mine, there = {}, {}
        for p, q, w, o in zip(pdf["p"], pdf["q"], pdf["w"], pdf["own"], strict=True):
            there.update(zip(range(p, p + n), w.split(" "), strict=True))
            mine.update(zip(range(q, q + n), o.split(" "), strict=True))
        words = [mine.get(k, "") for k in range(max(mine) + 1)]
        how = judge(list(zip(pdf["p"].tolist(), pdf["q"].tolist(), pdf["shared"].tolist(), strict=True)), words, lambda a, b: [there[k] for k in range(a, b)], n)
        return pd.DataFrame([(*key, *how)] if how else [], columns=["id", "item_id", "how", "windows"])

    return met.groupBy("id", "item_id").applyInPandas(resolve, "id long, item_id long, how string, windows int")


def _capitals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        small, capital = capital_uses(batch.column("text").to_pylist())
        ws = sorted(small)
        yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array([small[w] for w in ws], pa.int64()), pa.array([capital[w] for w in ws], pa.int64())], names=["w", "small", "capital"])


def find_leaks(docs: DataFrame, items: DataFrame, plan: LeakPlan = LeakPlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, how, windows): documents with ``window`` or more consecutive words of an item.

    ``how`` is ``verbatim`` if words agree one by one, ``parameters`` if numbers, names and units differ by one consistent
    mapping. Every document is searched as a whole, once. Null texts, and texts or items of fewer words than the window, give
    nothing; equal items give their rows each. The items' index goes to the executors if the items have at most
    ``broadcast_words`` words together (the size is checked); larger sets are joined through a shuffle.
    """
    held = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("n"))
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    src = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if total <= plan.broadcast_words:
        run, schema = _search(ItemIndex(sorted((r["item_id"], r["text"]) for r in held.collect()), plan))
        out = src.mapInArrow(run, schema)
    else:
        out = _by_shuffle(src, held, plan)
    return out.select(F.col("id").alias(id_col), "item_id", "how", "windows")


__all__ = ["ItemIndex", "LeakPlan", "find_leaks", "match"]
