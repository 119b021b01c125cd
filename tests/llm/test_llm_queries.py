"""The operators against brute force and SQL, on small tables and on the cases that their docstrings define."""

import collections
import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalloom.llm import chat_format, decontaminate, embedding_neardup, line_dedup, mixing, registry, sharding, simhash, substring_dedup, token_counts, toxicity
from evalloom.llm.shared import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, fp long, component_id long, _leak string"
EDGE = [
    (1, None, None, None, 1, 1, "x"),
    (2, "", "en", "s", None, None, None),
    (3, " \t\n ", "en", "s", 1, 1, "x"),
    (4, "One two  three\nfour", "en", None, 1, 1, "x"),
    (4, "One two  three\nfour", "en", None, 1, 1, "x"),
    (None, "no id here\nOne two  three", "en", "s", 1, 1, "x"),
    (5, "long " * 30_000 + "tail", "en", "t", 1, 1, "x"),
    (6, "a b c d e f g h i j " * 12, "en", "t", 1, 1, "x"),
    (7, "z a b c d e f g h i j " + "a b c d e f g h i j " * 11, "en", "t", 1, 1, "x"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def texts(duck):
    return duck.execute("select doc_id, text from documents").fetchall()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cur = duck.execute(registry.ORACLES[name])
    order = sorted(df.columns)
    at = [[d[0] for d in cur.description].index(c) for c in order]
    show = lambda x: str(int(x)) if isinstance(x, (bool, int)) else str(x)
    assert sorted(tuple(show(r[c]) for c in order) for r in df.collect()) == sorted(tuple(show(r[k]) for k in at) for r in cur.fetchall())


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7), (50, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {k: 0 for k in [*range(31), 50]} | {100: 100, 101: 100}
    assert components(edges.where("a < 0")).count() == 0


# 1


def test_quantisation_bound_holds():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=(200, 70)), rng.normal(size=(20, 70)) * [1e-3] * 70 + np.eye(20, 70)])
    codes, scale, norm, lost = embedding_neardup.quantise(v)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = embedding_neardup.code_products(codes, codes) * scale[:, None] * scale
    assert (np.abs(u @ u.T - near) <= norm[:, None] * lost + lost[:, None] * norm + lost[:, None] * lost + 1e-12).all()


def test_embedding_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [], 1), (11, [2.0, 0.0], 1), (11, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("h", F.lit("x"))
    got = sorted(((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in embedding_neardup.near_duplicates(df, block=2).collect()), key=str)
    linked = {(1, 3, 1, True), (2, 3, 1, False), (11, 3, 1, False)}
    assert {g for g in got if g[1]} == linked and len(got) == len(rows)
    assert embedding_neardup.near_duplicates(df.limit(0)).count() == 0


def test_hot_label_is_dealt_to_tiles(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=8) * 0.15 + np.eye(8)[k % 4]).tolist(), 0) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    v = np.array([r[1] for r in rows])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = ((u @ u.T) >= 0.93).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_neardup.near_duplicates(df, block=16).collect()}
    assert got == dict(enumerate(links.tolist()))


# 2


def test_line_cases(spark, edge, empty):
    got = {(r["doc_id"], r["line_no"]): (r["first_id"], r["removed"]) for r in line_dedup.judge_lines(edge).collect()}
    assert got[None, 1] == (4, True) and got[4, 0] == (4, False) and got[3, 0] == (None, False) and (1, 0) not in got
    assert got[6, 0] == (6, False) and got[7, 0][1] is True  # 10 of 11 words
    assert line_dedup.judge_lines(empty).count() == 0
    assert {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(edge).collect()}[None] == "no id here"


def judged_by_brute_force(rows, num, den):
    """(id, line_no, first_id, first_line_no, n_links, removed) of every line."""
    first = {}
    for i, x in rows:
        for k, line in enumerate(y.strip(" \t") for y in x.split("\n")):
            if line:
                first[line] = min(first.get(line, (10**30, 0)), (i, k))
    sets = {line: set(line.split()) for line in first}
    n, late = collections.Counter(), set()
    for a, b in itertools.combinations(first, 2):
        if len(sets[a] & sets[b]) * (num + den) >= (len(sets[a]) + len(sets[b])) * num:
            n[a] += 1
            n[b] += 1
            late.add(max(a, b, key=first.get))
    lines = [(i, k, y.strip(" \t")) for i, x in rows for k, y in enumerate(x.split("\n"))]
    return sorted([(i, k, *first[y], n[y], y in late or first[y] < (i, k)) if y else (i, k, None, None, 0, False) for i, k, y in lines], key=str)


@pytest.mark.parametrize(("num", "den", "block"), [(4, 5, 3), (4, 5, 512), (1, 2, 4), (1, 2, 512)])
def test_similar_lines_match_brute_force(spark, monkeypatch, num, den, block):
    """Random sets of few words, negative ids, other blanks, tiles of a few lines some of which have an empty block."""
    monkeypatch.setattr(line_dedup.similar_lines, "__defaults__", (block,))
    rng, words = np.random.default_rng(8), [f"w{k}" for k in range(14)]
    line = lambda: ("  " if rng.random() < 0.2 else " ").join(rng.choice(words, rng.integers(0, 12)))
    rows = [(k - 20, "\n".join(line() for _ in range(8))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.judge_lines(df, similarity=(num, den)).collect()), key=str)
    assert got == judged_by_brute_force(rows, num, den)


# 3


def removed(rows, width):
    words = {k: (x or "").encode().split() for k, x in rows}
    seen = collections.Counter(tuple(w[i : i + width]) for w in words.values() for i in range(len(w) - width + 1))
    out = {}
    for k, w in words.items():
        stay = [True] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                stay[i : i + width] = [False] * width
        out[k] = (len(w), stay.count(False), hashlib.sha256(b" ".join(x for x, s in zip(w, stay, strict=True) if s)).hexdigest())
    return out


def test_substrings_match_brute_force(spark, duck):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in registry.op3_substring_dedup(spark, SF).collect()}
    assert got == removed(texts(duck), 35)


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_substring_runs_give_the_same(spark, batches):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice(list("abcd"), size=40))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.remove_repeats(df, width=7, gram=3, batches=batches)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in found.collect()} == {k: v[:2] for k, v in removed(rows, 7).items()}


def test_batches_are_judged_against_history(spark, tmp_path):
    """Batches one by one, with the index opened anew for the last, mark what all at once would; some text is longer than a pack."""
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(rng.choice(list("abcd"), size=40))) for k in range(50)] + [(50, " ".join(rng.choice(list("abcdefgh"), size=4000)))]
    docs = substring_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    path, marks = str(tmp_path / "index"), []
    index = substring_dedup.FingerprintIndex(spark, 7, 3, path)
    for b in range(4):
        if b == 3:
            index = substring_dedup.FingerprintIndex(spark, 7, 3, path, docs.where("key % 4 < 3"))
            assert [level for level, _ in index.runs] == [1, 0]
        marks.append(index.add(docs.where(f"key % 4 = {b}")))
    covered = collections.defaultdict(set)
    for r in (r for m in marks for r in m.collect()):
        covered[r["key"]] |= set(range(r["span"] // 64, r["span"] // 64 + r["span"] % 64 + 6))
    assert {k: len(covered[k]) for k, _ in rows} == {k: v[1] for k, v in removed(rows, 7).items()}
    assert [level for level, _ in index.runs] == [2]
    with pytest.raises(ValueError, match="width"):
        substring_dedup.FingerprintIndex(spark, 8, 3, path)


def test_packs_hold_one_long_text_or_some_short_ones(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PACK", 10)
    assert [(p.start, p.stop) for p in substring_dedup.packs([b"x" * 4, None, b"x" * 7, b"x" * 30, b"", b"x"])] == [(0, 2), (2, 3), (3, 4), (4, 6)]


def test_substring_cases(spark, edge, empty):
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(edge).collect())
    assert got[1, 0, 0] == got[2, 0, 0] == got[3, 0, 0] == 1 and got[4, 4, 0] == 2 and got[6, 120, 120] == 1 and got[5, 30_001, 30_000] == 1
    assert substring_dedup.remove_repeats(empty).count() == 0


# 4


def slow_fingerprint(text, n):
    w = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(duck):
    for _, text in texts(duck)[:40]:
        assert simhash.fingerprint(text.encode(), 3) == slow_fingerprint(text, 3)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.integers(0, 25))
def test_bit_sliced_pairs(values, radius):
    near = values + [v ^ (1 << (k % 64)) ^ (1 << (k * 7 % 64)) for k, v in enumerate(values)]
    v = np.array(near, np.uint64)
    got = {(int(a), int(b)) for i, j in simhash.close_pairs(v, radius, rows=37) for a, b in zip(i, j, strict=True)}
    assert got == {(a, b) for a in range(len(near)) for b in range(a + 1, len(near)) if bin(near[a] ^ near[b]).count("1") <= radius}


def test_simhash_groups_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 25)]
    fps = [b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 3), replace=False)) for b in base for _ in range(8)]
    root = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    rows = [(k, f - 2**64 if f >> 63 else f) for k, f in enumerate(fps)]
    groups = simhash.groups_of(spark.createDataFrame(rows, "id long, fp long"), block=4)
    got = {r["fp"]: r["component_id"] for r in groups.collect()}
    assert [got[f] for _, f in rows] == root


def test_simhash_cases(edge, empty):
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(edge).collect()}
    assert got[1] == got[2] == got[3] == (0, 1) and got[4][1] == 4
    kept = simhash.drop_near_duplicates(edge)
    assert kept.columns == edge.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) in ([-1, 1, 4, 5, 6], [-1, 1, 4, 5, 6, 7])
    assert simhash.drop_near_duplicates(empty).count() == simhash.near_duplicates(empty).count() == 0


def test_similar_texts_go_and_others_stay(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(5000)]
    rows, far = [], []
    for k in range(40):
        text = rng.choice(words, 300).tolist()
        rows.append((2 * k, " ".join(text)))
        text[100], text[200] = "changed", "twice"
        rows.append((2 * k + 1, " ".join(text)))
        far.append((1000 + k, " ".join(rng.choice(words, 300))))
    df = spark.createDataFrame(rows + far, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == {2 * k for k in range(40)} | {1000 + k for k in range(40)}


def five_shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups_by_brute_force(rows):
    """Smallest id over links of pairs with Jaccard 0.8 or more, in whole numbers."""
    sets, root = {k: five_shingles(x) for k, x in rows}, {k: k for k, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                x, y = root[a], root[b]
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return root


def test_near_duplicates_are_verified_on_whole_sets(spark):
    rng = np.random.default_rng(5)
    words, rows = [f"w{k}" for k in range(20_000)], []
    for n, shared in [(100, m) for m in range(76, 91)] * 4 + [(10, m) for m in (6, 7, 8, 9)] * 8 + [(5, 4), (5, 3)] * 4:
        text = rng.choice(words, n + 4, replace=False).tolist()
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(text[: shared + 4]))]
    text = rng.choice(words, 204, replace=False).tolist()
    rows += [(len(rows) + k, " ".join(text[12 * k : 12 * k + 104])) for k in range(8)]  # a chain of pairs under the threshold
    rows += [(len(rows) + k, " ".join(text[9 * k : 9 * k + 104])) for k in range(8)]  # and one of pairs above it
    root = groups_by_brute_force(rows)
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {k for k in root if root[k] == k}
    few = [(k, x) for k, x in rows if k < 40]
    found = simhash.similar_documents(spark.createDataFrame(few + [(1000, rows[0][1])], "doc_id long, text string"), block=1)
    group = {r["id"]: r["group"] for r in found.collect()}
    assert group[1000] == group[0] and all((group[a] == group[b]) == (root[a] == root[b]) for a, _ in few for b, _ in few)


def test_repeated_lines_do_not_part_texts_with_one_set_of_shingles(spark):
    rng = np.random.default_rng(6)
    words, rows, far = [f"w{k}" for k in range(20_000)], [], []
    for k in range(40):
        text = rng.choice(words, 200, replace=False).tolist()
        many = text[:19] * 20 + text[19:]
        assert len(five_shingles(" ".join(text)) ^ five_shingles(" ".join(many))) == 4
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(many))]
        a, b = (simhash.sketch(x.encode(), 5)[0] for _, x in rows[-2:])
        far.append(bin(a ^ b).count("1"))
    assert max(far) <= simhash.WIDE
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {2 * k for k in range(40)}


def test_rows_with_null_or_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(7)
    text = [" ".join(rng.choice([f"w{k}" for k in range(5000)], 50)) for _ in range(12)]
    rows = [(None, t, str(k)) for k, t in enumerate(text[:6])] + [(None, text[0], "0"), (1, text[1], "near"), (2, text[6], "a"), (2, text[7], "b"), (2, text[7], "b"), (3, text[8], "c"), (3, text[7] + " more", "d"), (4, None, "e"), (None, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text_hash string")
    kept = simhash.drop_near_duplicates(df)
    want = [(None, text[k], str(k)) for k in (0, 2, 3, 4, 5)] + [(1, text[1], "near"), (2, text[6], "a"), (2, text[7], "b"), (3, text[8], "c"), (4, None, "e")]
    assert kept.columns == df.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))


# 5


def test_tiling_is_greedy_and_disjoint():
    assert decontaminate.tile([(0, 4, 3), (6, 0, 4)], 2, 12, 8) == [(6, 0, 4), (0, 4, 3)]


def tiled_by_brute_force(doc, item, k):
    """Words of `item` under greedy tiles: the longest free match, the first in the document and then in the item, again and again."""
    in_doc, in_item, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not in_doc[i + n] and not in_item[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < k:
            return total
        in_doc[i : i + n] = in_item[j : j + n] = [True] * n
        total += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.lists(st.sampled_from("abc"), max_size=16), max_size=3), st.integers(1, 9))
def test_coverage_matches_brute_force(doc, items, chunk):
    decontaminate.CHUNK, before = chunk, decontaminate.CHUNK
    try:
        found = dict((i, c) for c, i in decontaminate.Benchmark([(k, " ".join(x)) for k, x in enumerate(items)], 3).covered(" ".join(doc), decontaminate.WordIds(), 0.01))
    finally:
        decontaminate.CHUNK = before
    want = {k: tiled_by_brute_force(doc, x, 3) / len(x) for k, x in enumerate(items) if x}
    assert found == pytest.approx({k: v for k, v in want.items() if v})


def test_one_word_many_times_is_cheap():
    benchmark = decontaminate.Benchmark([(1, "same " * 200)], 5)
    assert benchmark.covered("same " * 20_000, decontaminate.WordIds(), 0.5) == [(1.0, 0)]


def test_leaks_match_brute_force(spark, duck):
    """Every document and item of the smallest table whose words overlap at all, by a plain tiling."""
    flat = lambda x: re.findall(r"\w+", (x or "").lower())
    items = [(k, flat(x)) for k, x in duck.execute("select item_id, text from benchmark order by item_id").fetchall()]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    wanted = {}
    for doc, text in texts(duck):
        w = flat(text)
        own = grams(w)
        hits = [(tiled_by_brute_force(w, x, 5) / len(x), -k) for k, x in items if len(own & grams(x)) * 9 >= len(x) / 2 and len(x) >= 5]
        hits = [h for h in hits if h[0] >= 0.5]
        wanted[doc] = (len(hits), -max(hits)[1], round(max(hits)[0], 9)) if hits else (0, None, 0.0)
    got = {r["doc_id"]: (r["n_items"], r["item_id"], round(r["coverage"], 9)) for r in registry.op5_decontaminate(spark, SF).collect()}
    assert got == wanted


def test_reordered_passages_are_found(spark, edge, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    rows = [(1, "x y " + " ".join(w[10:]) + " between them " + " ".join(w[:10])), (2, " ".join(w[:9])), (3, item.upper() + "!"), (4, None), (5, " ".join(reversed(w))), (6, " ".join(w[:10]) + " q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (None, "")], "item_id long, text string")
    for chars in (16_000_000, 30):
        got = {r["doc_id"]: (r["contaminated"], r["item_id"], round(r["coverage"], 2)) for r in decontaminate.find_leaks(df, bench, block_chars=chars).collect()}
        assert got == {1: (True, 7, 1.0), 2: (False, None, 0.0), 3: (True, 7, 1.0), 4: (False, None, 0.0), 5: (False, None, 0.0), 6: (True, 7, 0.5)}
    assert decontaminate.drop_contaminated(edge, bench).columns == edge.columns
    assert decontaminate.drop_contaminated(edge, bench.limit(0)).count() == len(EDGE) and decontaminate.find_leaks(empty, bench).count() == 0


def test_leaks_match_plain_search(spark, duck):
    flat = lambda x: " " + " ".join(re.findall(r"\w+", x.lower())) + " "
    items = [flat(t) for (t,) in duck.execute("select text from benchmark").fetchall()]
    whole = {k for k, x in texts(duck) if any(i in flat(x) for i in items)}
    got = {r["doc_id"] for r in registry.op5_decontaminate(spark, SF).where("contaminated").collect()}
    assert whole and whole <= got


def test_an_item_without_an_id_comes_last_in_any_blocks(spark):
    passage = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, f"so {passage} it goes")], "doc_id long, text string")
    for order in ([(None, passage), (7, passage)], [(7, passage), (None, passage)]):
        items = spark.createDataFrame(order, "item_id long, text string")
        for chars in (10, 20, 30, 10_000):
            row = decontaminate.find_leaks(docs, items, block_chars=chars).first()
            assert (row["n_items"], row["item_id"], row["coverage"]) == (2, 7, 1.0)


# 6


def test_mixing_cases(spark, edge, empty):
    found = mixing.mix(edge, repetitions=2.0)
    assert {(r["doc_id"], r["text"]) for r in found.collect()} == {(r[0], r[1]) for r in EDGE}
    assert mixing.mix(empty, repetitions=2.0).count() == 0
    clash = edge.withColumns({"_mix_block": F.lit(5), "_mix_own": F.lit("x"), "_mix_epoch": F.lit("e")})
    assert mixing.mix(clash, repetitions=2.0, details=False).columns == clash.columns
    assert {r["_mix_own"] for r in mixing.mix(clash, repetitions=2.0).where("_mix_block <> 5 and _mix_epoch >= 1").collect()} == {"x"}
    sources = spark.createDataFrame([("a", 900), ("b", 90), (None, 10)], "source string, tokens long")
    power = mixing.exponent(sources, entropy=1.0)
    w = [r["weight"] for r in mixing.budgets(sources, power).collect()]
    assert -sum(x * np.log(x) for x in w) == pytest.approx(1.0, abs=1e-6)
    with pytest.raises(ValueError):
        mixing.exponent(sources)


# 7

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<TURN>>", "<<TEXT>>", "<</TURN>>", "\\", "<", "[", "/", ">", "é", "ok", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "<s>\\"]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=5))
def test_chat_round_trip(turns):
    form = chat_format.Formatter(chat_format.Template())
    assert list(form.read("".join(t for r, x in turns for t, _ in form.segments(r, x)))) == turns


def test_chat_query(spark, duck):
    conv = collections.defaultdict(list)
    for c, r, x in duck.execute("select conv_id, role, text from conversations order by conv_id, turn").fetchall():
        conv[c].append((r, x or ""))
    conv[-1] = [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    loss = {c: "".join(x for r, x in v if r == "assistant") for c, v in conv.items()}
    form = chat_format.Formatter(chat_format.Template())
    chars = {c: sum(len(t) for r, x in v for t, _ in form.segments(r, x)) for c, v in conv.items()}
    want = {c: (len(v), digest("".join(f"{r}\n{x}\n" for r, x in v)), len(loss[c]), digest(loss[c]), chars[c]) for c, v in conv.items()}
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in registry.op7_chat_format(spark, SF).collect()} == want


def test_stored_turns_are_brought_together(spark, tmp_path):
    rows = [(c, k, "assistant" if k % 2 else "user", f"{c} says {k}") for c in range(5) for k in range(30)]
    made = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    made.repartition(7, "place").write.parquet(str(tmp_path / "turns"))
    back = lambda df, **how: sorted(map(tuple, chat_format.read_back(df, **how).collect()))
    assert back(spark.read.parquet(str(tmp_path / "turns"))) == back(made, in_order=True) and len(back(made)) == 5


def test_chat_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, "user", "again"), (None, 0, None, "x"), (2, None, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("state", F.lit(1))
    got = {r["conv_id"]: (r["n_turns"], r["valid"]) for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert got == {1: (2, False), None: (1, False), 2: (2, True), 3: (1, False)}
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


# 8


def test_sharding_law(spark, duck):
    rows, text = registry.op8_sharding(spark, SF).collect(), dict(texts(duck))
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in rows)
    loads, places = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert len(rows) == len(text) and max(loads.values()) - min(loads.values()) <= max(r["size"] for r in rows)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def duck_ids(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))


def test_shard_map_versions(spark, edge, empty, tmp_path):
    recs = sharding.records(spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text")), slots=256)
    path = str(tmp_path / "map")
    sharding.save_map(sharding.first_map(sharding.slot_sizes(recs), 4), path, 1, 4)
    sharding.save_map(sharding.edited(sharding.load_map(spark, path), 4), path, 2, 5)
    old, new = ({r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, path, v).collect()} for v in (1, None))
    assert set(new.values()) == set(range(5)) and all(new[s] in (old[s], 4) for s in old)
    loads = [r["b"] for r in sharding.load_map(spark, path).groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert max(loads) < 1.2 * min(loads)
    path = str(tmp_path / "own")
    grown = [{r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, n, map_path=path).collect()} for df, n in ((duck_ids(spark, 400), 4), (duck_ids(spark, 600), 4), (duck_ids(spark, 600), 5))]
    assert all(grown[1][k] == grown[0][k] for k in grown[0]) and all(grown[2][k] in (grown[1][k], 4) for k in grown[1]) and 4 in grown[2].values()
    assert versions(spark, path) == [1, 2, 3]  # records in new slots, then a shard
    sharding.save_map(sharding.load_map(spark, path), path, 3, 5)
    assert sharding.load_map(spark, path).count() == sharding.load_map(spark, path).select("virtual_slot").distinct().count()
    with pytest.raises(ValueError, match="shards"):
        sharding.shard_documents(duck_ids(spark, 10), 3, map_path=path)
    assert sharding.shard_documents(edge).count() == len(EDGE) and sharding.shard_documents(empty).count() == 0


def versions(spark, path):
    return sorted(r["version"] for r in spark.read.parquet(path).select("version").distinct().collect())


def test_a_map_of_few_records(spark, tmp_path):
    """Shards without a slot are shards: nothing moves without an added one, no version is made for nothing, fewer are refused."""
    path = str(tmp_path / "few")
    shard_of = lambda n, shards=16, **how: {r["doc_id"]: r["shard"] for r in sharding.shard_documents(duck_ids(spark, n), shards, slots=256, map_path=path, **how).collect()}
    few, again, many = shard_of(8), shard_of(8), shard_of(600)
    assert few == again and all(many[k] == few[k] for k in few) and versions(spark, path) == [1, 2]
    assert set(many.values()) == set(range(16))
    with pytest.raises(ValueError, match="16 shards"):
        shard_of(8, 10)
    grown = shard_of(600, 17)
    assert all(grown[k] in (many[k], 16) for k in many) and 16 in grown.values() and versions(spark, path) == [1, 2, 3]


def test_drifting_loads_are_rebalanced_when_asked(spark, empty, tmp_path):
    path = str(tmp_path / "drift")
    even = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x" * 20).alias("text"))
    before = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(even, 4, map_path=path).collect()}
    heavy = even.withColumn("text", F.when(F.col("doc_id").isin([k for k, s in before.items() if s == 0]), F.repeat(F.lit("x"), 200)).otherwise(F.col("text")))
    recs = sharding.records(even).drop("size").join(sharding.records(heavy).select("id", "size"), "id")  # slots of the plain texts
    loads = lambda m: sorted(r["b"] for r in m.groupBy("shard").agg(F.sum("bytes").alias("b")).collect())
    kept = sharding.current_map(sharding.slot_sizes(recs), 4, path)
    assert loads(kept)[-1] > 3 * loads(kept)[0] and versions(spark, path) == [1]
    moved = sharding.current_map(sharding.slot_sizes(recs), 4, path, drift=0.05)
    assert loads(moved)[-1] < 1.1 * loads(moved)[0] and versions(spark, path) == [1, 2]
    assert loads(sharding.current_map(sharding.slot_sizes(recs), 4, path, drift=0.05)) == loads(moved) and versions(spark, path) == [1, 2]
    nothing = str(tmp_path / "empty")
    assert sharding.shard_documents(empty, 4, map_path=nothing).count() == 0 and sharding.shard_documents(even, 4, map_path=nothing).count() == 2000


# 9


def test_token_counts(spark, duck, edge, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    odd = ["", " ", "  a", "a  b \n c", "x<|endoftext|> y<|endoftext|>", "don't we'll\r\n\t1234 é ñ 漢字 🙂🙂 ", "   x　", "a\x1cb \x85 c", "tail \n", "\n\n\nhead", "१२३ ǅ İ ß ﬁ", "a" * 3000]
    counts = token_counts.PieceCounts(path, token_counts.single_tokens(path))
    for text in odd + [x for _, x in texts(duck)]:
        assert counts.of(text) == len(library.encode(text, add_special_tokens=False).ids), text[:80]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(edge, path).collect()}
    assert got[1] == got[2] == (0, 0, False) and got[5][2] is True and token_counts.count_tokens(empty, path).count() == 0


# 10


def test_toxicity(spark, edge, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = registry.op10_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    pos, neg = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    auc = np.mean([[(p > n) + (p == n) / 2 for n in neg] for p in pos])
    assert auc > 0.9 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    own = spark.createDataFrame([(3, None), (4, 1), (4, 0), (6, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score_documents(edge, own).count() == len(EDGE)
    assert {r["score"] for r in toxicity.score_documents(edge, own.limit(0)).collect()} == {0.0}
    assert toxicity.drop_toxic(edge, own).columns == edge.columns and toxicity.score_documents(empty, own).count() == 0


def plain_ftrl(texts, labels, alpha=1.0, beta=1.0, l1=toxicity.L1, l2=1.0):
    """FTRL-proximal feature by feature, in dictionaries."""
    z, n, bias, bias_n = collections.Counter(), collections.Counter(), 0.0, 0.0
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else (np.sign(z[k]) * l1 - z[k]) / ((beta + n[k] ** 0.5) / alpha + l2)
    for _ in range(toxicity.PASSES):
        loss = 0.0
        for text, y in zip(texts, labels, strict=True):
            own = {int(k): weight(int(k)) for k in set(toxicity.coordinates(text))}
            p = 1 / (1 + np.exp(-max(-35.0, min(35.0, sum(own.values()) + bias))))
            loss -= np.log(p if y else 1 - p)
            g = p - y
            for k, w in own.items():
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / alpha * w
                n[k] += g * g
            bias_n += g * g
            bias -= alpha * g / (beta + bias_n**0.5)
        if loss <= toxicity.LOSS * len(texts):
            break
    return {k: weight(k) for k in z if weight(k)}, bias


def test_fit_matches_plain_ftrl(duck):
    rows = duck.execute("select text, toxic from documents join labels using (doc_id) where toxic is not null order by doc_id").fetchall()
    x, y = [r[0][:2000] for r in rows], [r[1] for r in rows]
    place, weight, bias = toxicity.fit(x, y, l1=3.0)
    want, want_bias = plain_ftrl(x, y, l1=3.0)
    assert len(want) > 5 and bias == pytest.approx(want_bias) and dict(zip(place.tolist(), weight.tolist(), strict=True)) == pytest.approx(want)


def test_rows_that_repeat_a_labelled_id_count_once(spark):
    docs = spark.createDataFrame([(k, f"text {k} of {j}") for k in range(30) for j in range(20)], "doc_id long, text string")
    labels = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    seen = []
    fit, toxicity.fit = toxicity.fit, None
    try:
        toxicity.fit = lambda x, y: (np.arange(len(x)), np.ones(len(x)), 0.0)
        place, _, _ = toxicity.train(docs, labels, sample=10)
        seen = place.tolist()
    finally:
        toxicity.fit = fit
    assert len(seen) == 10


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == docs.columns and kept.count() > 0
    got = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(r["doc_id"] for r in kept.collect())


def test_history_is_met_where_it_lies(spark):
    """The batch's anchors are shuffled to the buckets of a run; the run itself isn't, and merged runs give what they gave."""
    docs = spark.range(40).select(F.col("id").alias("key"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(59)), lambda j: F.concat(F.lit("w"), ((F.col("id") * 7 + j) % 50).cast("string")))).cast("binary").alias("text"))
    index = substring_dedup.FingerprintIndex(spark, 7, 3, buckets=8)
    index.add(docs.where("key % 2 = 0"))
    anchors = substring_dedup.cut(substring_dedup.segments(docs.where("key % 2 = 1"), 7, 3).select("a").distinct(), "anchors")
    plan = index.at(anchors)._jdf.queryExecution().executedPlan().toString()
    history, batch = plan.split("SortMergeJoin")[1].split("FileScan parquet spark_catalog")
    assert "Bucketed: true" in batch and "Exchange" not in history and batch.count("Exchange") == 1
    before = {tuple(r) for r in index.at(anchors).select("a", "d1", "d2", "n").collect()}
    index.add(docs.where("key < 0"))
    index.compact()
    assert len(index.runs) == 1 and {tuple(r) for r in index.at(anchors).select("a", "d1", "d2", "n").collect()} == before and before
