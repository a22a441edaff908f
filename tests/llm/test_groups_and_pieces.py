"""Splitting, representatives and near-duplicates on small fixtures and against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from sievemill.operators.components import components
from sievemill.llm.near_duplicates import IndexPlan, duplicate_groups, gray_rank, group_pairs, search_node
from sievemill.llm.representatives import best_representatives, judged_facts, retained_values
from sievemill.llm.splitting import split_oversized

RECORD = "record_id long, title string, abstract string, doi_normalized string, pdf_url string, citations int, source string, retrieval_date string, extra string"


def pieces_of(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "raw_id long, chunk string, piece string")
    out = {}
    for r in split_oversized(df, "raw_id", "chunk", **kw).orderBy("raw_id", "piece_no").collect():
        out.setdefault(r.raw_id, []).append(r)
    return out


def test_split_round_trip_limits_and_overlap(spark):
    rng = random.Random(4)
    words = ["alpha", "be", "gamma-delta", "é", "naïve.", "end!", "x,", "𝒳𝒴", "\n\n", "\r\n", "  "]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 5, 300, 700, 1500)] + ["y" * 5000, "a b " + "z" * 1300, "", None, " " * 1500]
    got = pieces_of(spark, texts)
    for i, t in enumerate(texts):
        if t is None:
            assert i not in got
            continue
        rows = got[i]
        assert "".join(r.piece[r.overlap_chars :] for r in rows) == t
        assert max(len(r.piece) for r in rows) <= 1200
        for a, b in itertools.pairwise(rows):
            assert a.piece.endswith(b.piece[: b.overlap_chars])
            assert b.overlap_chars <= 200
        kind = "none" if len(t) <= 1200 else "hard" if re.search(r"\S{1201}", t) else "soft"
        assert {r.cut_kind for r in rows} == {kind}


def test_split_prefers_strong_boundaries(spark):
    text = ("word " * 150).strip() + ".\n\n" + "tail " * 200
    first = pieces_of(spark, [text])[0][0]
    assert first.piece.endswith(".\n\n")
    sentence = ("word " * 150).strip() + ". " + "tail " * 200
    assert pieces_of(spark, [sentence])[0][0].piece.endswith(". ")


def test_split_small_limits_and_bad_parameters(spark):
    rows = pieces_of(spark, ["one two three four five six"], limit=10, overlap=4)[0]
    assert "".join(r.piece[r.overlap_chars :] for r in rows) == "one two three four five six"
    assert all(len(r.piece) <= 10 for r in rows)
    with pytest.raises(ValueError):
        pieces_of(spark, ["a"], limit=5, overlap=5)


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([("Medarium", 3), ("Scholaris", 1), ("ArcPreprint", 2)], "source_name string, trust_rank int")


def test_representatives_follow_the_order_of_each_field(spark, registry):
    rows = [
        (1, "t", "short abstract", "d1", "u1", 5, " medarium ", "2022-01-01T00:00:00Z", ""),
        (2, "t", "a longer abstract", "d1", "N/A", -1, "SCHOLARIS", "2023-01-01T00:00:00+00:00", ""),
        (3, "t", "N/A", "d1", "u3", 7, None, "2022-06-01T00:00:00Z", ""),
        (4, "t", "alone", "d2", "u", 1, "Medarium", "2022-01-01T00:00:00Z", ""),
        (5, "t", "no key", "", "u", 1, "Medarium", "2022-01-01T00:00:00Z", ""),
        (6, "t", "no key", None, "u", 1, "Medarium", "2022-01-01T00:00:00Z", ""),
        (7, "t", "same", "d3", None, None, None, None, ""),
        (8, "t", "same", "d3", "-", None, "unheard of", "not a date", ""),
    ]
    got = {(r.group_id, r.field_name): r.record_id for r in best_representatives(spark.createDataFrame(rows, RECORD), registry).collect()}
    assert got == {(1, "abstract"): 2, (1, "pdf_url"): 3, (1, "citations"): 3, (1, "source"): 2, (7, "abstract"): 7, (7, "source"): 8}


def test_representatives_of_nothing(spark, registry):
    assert best_representatives(spark.createDataFrame([], RECORD), registry).count() == 0


def test_quality_model_trusts_the_agreeing_sources(spark, registry):
    rng = random.Random(2)
    rows, n = [], 0
    for g in range(150):
        true = f"http://good.example/{g}"
        for s in ("Medarium", "Scholaris", "ArcPreprint"):
            n += 1
            wrong = s == "ArcPreprint" and rng.random() < 0.8
            rows.append((n, "t", "a", f"d{g}", f"http://bad.example/{g}/{n}" if wrong else true, 1, s, "2022-01-01T00:00:00Z", ""))
    facts = judged_facts(spark.createDataFrame(rows, RECORD), registry).where("field_name = 'pdf_url'").collect()
    urls = {r[0]: r[4] for r in rows}
    good = [f.posterior for f in facts if "good" in urls[f.record_id]]
    bad = [f.posterior for f in facts if "bad" in urls[f.record_id]]
    assert min(good) > max(bad)
    kept = retained_values(spark.createDataFrame(rows, RECORD), registry).where("field_name = 'pdf_url' and judged_true").count()
    assert kept >= len(good)


def test_components_match_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {n: find(n) for n in parent}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_node_search_finds_every_pair_within_the_radius():
    rng = np.random.default_rng(3)
    plan = IndexPlan(radius=10, leaf=2, sure=4, width=4)
    centres = rng.integers(0, 2**63, (12, 2), dtype=np.uint64)
    bits = np.repeat(centres, 6, axis=0)
    for row in bits:
        for _ in range(rng.integers(0, 6)):
            row[rng.integers(0, 2)] ^= np.uint64(1) << np.uint64(rng.integers(0, 63))
    ids = np.arange(len(bits)) + 50
    parent = {int(i): int(i) for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in search_node(ids, bits, plan):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            parent[max(find(x), find(y))] = min(find(x), find(y))
    for i, j in itertools.combinations(range(len(ids)), 2):
        if np.bitwise_count(bits[i] ^ bits[j]).sum() <= plan.radius:
            assert find(int(ids[i])) == find(int(ids[j]))


def brute_pairs(rows):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def words(r):
        return set(re.findall(r"[^\W_]+", f"{r[1] or ''} {r[2]}".lower()))

    for a, b in itertools.combinations(rows, 2):
        key = (a[3] or "").strip() and (a[3] or "").strip() == (b[3] or "").strip()
        fit = all(r[2] and len(r[2]) >= 500 for r in (a, b))
        if key or (fit and len(words(a) & words(b)) / len(words(a) | words(b)) >= 0.7):
            x, y = find(a[0]), find(b[0])
            parent[max(x, y)] = min(x, y)
    return {(a[0], b[0]) for a, b in itertools.combinations(sorted(rows), 2) if find(a[0]) == find(b[0])}


def test_groups_match_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "tu") for b in range(100)]
    rows, n = [], 0
    for w in range(60):
        base = rng.sample(vocabulary, 110)
        for _ in range(rng.randint(1, 4)):
            n += 1
            text = list(base)
            for _ in range(rng.randint(0, 12)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rng.shuffle(text)
            cut = text if rng.random() < 0.9 else text[:40]
            rows.append((n, "title " + str(w) if rng.random() < 0.8 else None, " ".join(cut), f"d{w}" if rng.random() < 0.3 else rng.choice([None, "", " "]), "u", 1, "s", "x", ""))
    rows += [(n + 1, None, None, None, None, None, None, None, ""), (n + 2, "only a title", "N/A", "d1", None, None, None, None, ""), (n + 3, rows[0][1], rows[0][2], None, None, None, None, None, "")]
    df = spark.createDataFrame(rows, RECORD)
    groups = duplicate_groups(df)
    got = {tuple(r) for r in group_pairs(groups).collect()}
    assert got == brute_pairs(rows)
    assert groups.count() == len(rows)


def test_groups_of_copies_and_of_nothing(spark):
    text = " ".join(f"word{i}" for i in range(120))
    rows = [(i, "t", text, None, None, None, None, None, "") for i in range(40)]
    got = duplicate_groups(spark.createDataFrame(rows, RECORD)).collect()
    assert {r.group_id for r in got} == {0}
    assert duplicate_groups(spark.createDataFrame([], RECORD)).count() == 0


def test_a_hot_group_of_edited_variants_is_one_group(spark):
    rng = random.Random(5)
    vocabulary = [f"term{i}" for i in range(3000)]
    base = rng.sample(vocabulary, 100)
    rows = [(i, None, " ".join([*base, f"own{i}a", f"own{i}b", f"own{i}c"]), None, "u", 1, "s", "x", "") for i in range(200)]
    rows += [(i, None, " ".join(rng.sample(vocabulary, 100)), None, "u", 1, "s", "x", "") for i in range(200, 600)]
    got = {r.record_id: r.group_id for r in duplicate_groups(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {i: 0 if i < 200 else i for i in range(600)}


def test_node_search_gives_every_pair_itself_and_leaves_groups_out():
    rng = np.random.default_rng(8)
    plan = IndexPlan(radius=10, leaf=2, sure=4, width=4)
    bits = np.repeat(rng.integers(0, 2**63, (6, 2), dtype=np.uint64), 12, axis=0)
    for row in bits:
        for _ in range(rng.integers(0, 7)):
            row[rng.integers(0, 2)] ^= np.uint64(1) << np.uint64(rng.integers(0, 63))
    ids = rng.permutation(len(bits)) + 50
    near = {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(zip(ids.tolist(), bits), 2) if np.bitwise_count(x ^ y).sum() <= plan.radius}
    for group in (None, ids % 3):
        got = {(min(p), max(p)) for a, b in search_node(ids, bits, plan, group) for p in zip(a.tolist(), b.tolist(), strict=True)}
        assert got == {p for p in near if group is None or p[0] % 3 != p[1] % 3}


def test_hot_nodes_read_in_chunks_lose_no_group(spark):
    rng = random.Random(6)
    vocabulary = [f"term{i}" for i in range(900)]
    base, rows = rng.sample(vocabulary, 100), []
    for i in range(120):
        text = list(base)
        for k in rng.sample(range(100), rng.choice([2, 8, 14, 20])):
            text[k] = rng.choice(vocabulary)
        rows.append((i, None, " ".join(text), None, "u", 1, "s", "x", ""))
    groups = duplicate_groups(spark.createDataFrame(rows, RECORD), IndexPlan(hot=5, chunk=10, pivots=2))
    assert {tuple(r) for r in group_pairs(groups).collect()} == brute_pairs(rows)
