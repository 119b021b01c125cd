"""Lexical search against brute force, over many shards and blocks, and on the cases that its docstring defines."""

import collections
import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evalloom.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranking(docs, items, k):
    counted = [(d, collections.Counter(t)) for d, text in docs if (t := terms(text))]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for d, c in counted:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranking(spark, docs, items, k=10, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    index = L.build_index(d, shard_terms=how.pop("shard_terms", L.SHARD_TERMS))
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in L.search(index, q, k, **how).collect()), key=str)


def invented(seed, n, words):
    rng = random.Random(seed)
    some = [f"w{int(rng.paretovariate(0.7))}" for _ in range(words)]
    return [(rng.randrange(-50, 10**6), " ".join(rng.choice(some) for _ in range(rng.randint(0, 40)))) for _ in range(n)]


def test_many_shards_and_blocks(spark):
    docs, items = invented(1, 400, 300), [(k, t) for k, (_, t) in enumerate(invented(2, 30, 300))]
    want = plain_ranking(docs, items, 5)
    assert ranking(spark, docs, items, 5) == want
    assert ranking(spark, docs, items, 5, shard_terms=200, block_chars=150) == want


def test_ties_nulls_and_odd_texts(spark):
    docs = [(3, "alpha beta"), (1, "Alpha, BETA!"), (2, "beta alpha"), (None, "alpha\x00beta"), (4, None), (5, ""), (6, "\t .\n"), (1, "alpha beta"), (9, "ÄÖ é中 alphaé"), (-7, "alpha " * 30_000)]
    items = [(1, "alpha"), (1, "beta alpha"), (None, "äö ÄÖ 中"), (2, None), (3, ""), (4, "nowhere"), (5, "é中")]
    assert ranking(spark, docs, items, 4) == plain_ranking(docs, items, 4)
    assert ranking(spark, docs, items, 4, shard_terms=1) == plain_ranking(docs, items, 4)
    assert any(r[0] is None for r in ranking(spark, docs, items, 4))


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, rank int, score long, shard long, item_id long")
    one = spark.createDataFrame([(1, "a b", 1, 1, 1, 1)], none.schema)
    assert L.rank_documents(none, one).collect() == []
    assert L.rank_documents(one, none).collect() == []
    assert L.rank_documents(one, one).columns == ["item_id", "rank", "doc_id", "score"]


@given(st.lists(st.integers(0, 2**62)))
@settings(deadline=None)
def test_packing(values):
    data, starts = L.packed(np.array(values, np.int64))
    assert L.unpacked(data.tobytes()).tolist() == values and len(starts) == len(values) + 1


@given(st.lists(st.integers(-(2**62), 2**62 - 1)))
@settings(deadline=None)
def test_zigzag(values):
    x = np.array(values, np.int64)
    assert L.unzigzag(L.zigzag(x).view(np.int64)).tolist() == values
    assert L.unzigzag(L.unpacked(L.packed(L.zigzag(x))[0].tobytes())).tolist() == values


@given(st.lists(st.dictionaries(st.integers(0, 40), st.integers(0, 9), min_size=1), min_size=1, max_size=8), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_heap_merge(lists, k):
    made = []
    for one in lists:
        p = L.Postings.__new__(L.Postings)
        p.docs, p.adds = sorted(one), [one[d] for d in sorted(one)]
        p.most = max(p.adds)
        made.append(p)
    scores = collections.Counter()
    for one in lists:
        scores.update(one)
    want = sorted(((s, -d) for d, s in scores.items() if s), reverse=True)[:k]
    assert sorted(L.best(made, k), reverse=True) == want
