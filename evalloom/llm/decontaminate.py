"""Benchmark decontamination by greedy string tiling.

Seeds are runs of MIN_MATCH words that a document shares with a benchmark item, found by a rolling Karp-Rabin hash. Of the
seeds on one diagonal only the first and last of each maximal match are kept, so words that repeat many times cost places,
not pairs of places. The longest match of unmarked words is marked on both sides, again and again, until none of MIN_MATCH
words is left; equally long ones go in order of their place in the document, then in the item. An item's coverage is the share of its words under tiles, so passages
that were cut up and reordered count in full. A document is contaminated if an item's coverage reaches the threshold.

The benchmark is dealt to blocks of at most about BLOCK_CHARS characters, and one block at a time is broadcast; a
benchmark beyond that takes more passes over the documents and loses nothing.

Defined cases: words are runs of letters, digits and underscores, lower-cased. A null or empty text shares nothing.
Items of fewer words than MIN_MATCH (null ones too) are never found. Ties in coverage go to the smallest item id, an item
without an id comes last; items that repeat count each. Words are told apart by 64-bit digests (XXH64), runs by hashes of these. An empty benchmark finds nothing; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.shared import cut, free_name, small_batches

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_CHARS = 16_000_000
#: Pairs of equal seeds that are looked at at once.
CHUNK = 1 << 20
#: Entries in a worker's dictionary of words.
CACHE = 400_000
WORDS = re.compile(r"\w+").findall
BASE = 0x9E3779B97F4A7C15


class WordIds(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = n = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 3)
        return n


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k ids, modulo 2**64."""
    out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for j in range(k if len(out) else 0):
        out = out * np.uint64(BASE) + ids[j : j + len(out)]
    return out


def tile(matches: list[tuple[int, int, int]], k: int, doc_words: int, item_words: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of maximal matches (doc place, item place, words): disjoint tiles of k words or more, longest first."""
    heap = [(-n, i, j) for i, j, n in matches]
    heapq.heapify(heap)
    in_doc, in_item, tiles, left = bytearray(doc_words), bytearray(item_words), [], item_words
    while heap and left >= k:
        less, i, j = heapq.heappop(heap)
        length = -less
        free = [not (in_doc[i + t] or in_item[j + t]) for t in range(length)]
        if all(free):
            in_doc[i : i + length] = in_item[j : j + length] = b"\1" * length
            tiles.append((i, j, length))
            left -= length
            continue
        start = None
        for t, ok in enumerate([*free, False]):
            if ok and start is None:
                start = t
            elif not ok and start is not None:
                if t - start >= k:
                    heapq.heappush(heap, (start - t, i + start, j + start))
                start = None
    return tiles


class Benchmark:
    """Items of one block, with their seeds in order."""

    def __init__(self, items: list[tuple], k: int):
        self.k, self.ids, words = k, [], WordIds()
        seeds, owner, place, self.lengths = [], [], [], []
        for item, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            ids = np.array(list(map(words.__getitem__, WORDS((text or "").lower()))), np.uint64)
            grams = rolling(ids, k)
            seeds.append(grams)
            owner.append(np.full(len(grams), len(self.ids)))
            place.append(np.arange(len(grams)))
            self.ids.append(item)
            self.lengths.append(len(ids))
        self.grams, owner, place = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (seeds, owner, place))
        self.order = np.argsort(self.grams, kind="stable")
        self.seeds, self.owner, self.place = self.grams[self.order], owner.astype(int), place.astype(int)
        self.last = np.append(self.owner[1:] != self.owner[:-1], True) if len(self.owner) else np.zeros(0, bool)

    def matches(self, grams: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, doc place, item place, words) of the maximal matches, in order of item, diagonal and place."""
        at = np.searchsorted(self.seeds, grams)
        found = np.flatnonzero(self.seeds[np.minimum(at, len(self.seeds) - 1)] == grams)
        left, counts = at[found], np.searchsorted(self.seeds, grams[found], "right") - at[found]
        upto, starts, ends, k = np.cumsum(counts), [], [], 0
        while k < len(found):
            e = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + CHUNK, "right")))
            n = counts[k:e]
            i = np.repeat(found[k:e], n)
            seed = self.order[np.repeat(left[k:e], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
            first = (i == 0) | (self.place[seed] == 0) | (grams[i - 1] != self.grams[seed - 1])
            final = (i == len(grams) - 1) | self.last[seed] | (grams[(i + 1) % len(grams)] != self.grams[(seed + 1) % len(self.grams)])
            starts.append((i[first], seed[first]))
            ends.append((i[final], seed[final]))
            k = e
        (i, seed), (stop, seed_stop) = (tuple(np.concatenate(x) for x in zip(*part, strict=True)) if part else (np.zeros(0, int),) * 2 for part in (starts, ends))
        a, b = np.lexsort((i, i - self.place[seed], self.owner[seed])), np.lexsort((stop, stop - self.place[seed_stop], self.owner[seed_stop]))
        return self.owner[seed[a]], i[a], self.place[seed[a]], stop[b] - i[a] + self.k

    def covered(self, text: str | None, words: WordIds, least: float) -> list[tuple[float, int]]:
        """(coverage, item) of the items that tiles cover by at least `least`."""
        ids = np.array(list(map(words.__getitem__, WORDS((text or "").lower()))), np.uint64)
        grams = rolling(ids, self.k)
        if not len(self.seeds) or not len(grams):
            return []
        owner, i, j, n = self.matches(grams)
        out, edges = [], np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
        for s, e in itertools.pairwise(edges.tolist()):
            item, words_in = int(owner[s]), self.lengths[owner[s]]
            reach = np.zeros(words_in + 1, np.int64)
            np.add.at(reach, j[s:e], 1)
            np.add.at(reach, j[s:e] + n[s:e], -1)
            if (np.cumsum(reach[:-1]) > 0).sum() < least * words_in:  # no tiling can cover more than the matches do
                continue
            tiles = tile(list(zip(i[s:e].tolist(), j[s:e].tolist(), n[s:e].tolist(), strict=True)), self.k, len(ids), words_in)
            coverage = sum(x for _, _, x in tiles) / words_in
            if coverage >= least:
                out.append((coverage, item))
        return out


def leak_column(spark, text: Column, items: list[tuple], min_match: int, coverage: float) -> Column:
    """struct(n_items, item_id, coverage): items covered, and the one that is covered most."""
    sent = spark.sparkContext.broadcast(Benchmark(items, min_match))

    @F.pandas_udf("n_items long, item_id long, coverage double")
    def leaks(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        benchmark, words = sent.value, WordIds()
        for batch in texts:
            rows = []
            for text in batch:
                found = benchmark.covered(text, words, coverage)
                best = min(found, key=lambda x: (-x[0], x[1]), default=None)
                rows.append((len(found), None if best is None else benchmark.ids[best[1]], 0.0 if best is None else best[0]))
            out = pd.DataFrame(rows, columns=["n_items", "item_id", "coverage"])
            yield out.astype({"n_items": "int64", "item_id": "Int64", "coverage": "float64"})

    return leaks(text)


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS, into: str = "_leak") -> DataFrame:
    """docs with a column `into`, a name that docs doesn't have: struct(n_items, item_id, coverage)."""
    spark, second = docs.sparkSession, free_name(docs, f"{into}2")
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()
        one = leak_column(spark, F.col(text_col).cast("string"), [(r["id"], r["text"]) for r in block], min_match, coverage)
        if b == 0:
            docs = docs.withColumn(into, one)
        else:
            docs = cut(docs.withColumn(second, one), "leaks")
            old, new = F.col(into), F.col(second)
            smaller = new["item_id"].isNotNull() & (old["item_id"].isNull() | (new["item_id"] < old["item_id"]))
            better = (new["coverage"] > old["coverage"]) | ((new["coverage"] == old["coverage"]) & smaller)
            best = F.when(better, new).otherwise(old)
            docs = docs.withColumn(into, F.struct((old["n_items"] + new["n_items"]).alias("n_items"), best["item_id"].alias("item_id"), best["coverage"].alias("coverage"))).drop(second)
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, n_items, item_id, coverage, contaminated."""
    found = with_leaks(docs.select(F.col(id_col), F.col(text_col).alias("text")), benchmark, **how)
    return found.select(id_col, "_leak.n_items", "_leak.item_id", "_leak.coverage", (F.col("_leak.n_items") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay."""
    leak = free_name(docs, "_leak")
    return with_leaks(docs, benchmark, text_col, into=leak, **how).where(F.col(leak)["n_items"] == 0).drop(leak)
