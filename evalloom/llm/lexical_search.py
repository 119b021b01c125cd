"""Ranked lexical search: an index in shards, searched document by document, and one ranking over all shards.

A shard holds the documents that one task reads until they have SHARD_TERMS terms, so its memory is bounded and no text is
shuffled. Its documents are in order of their ids; a term's postings are the gaps between its documents and its counts in them
as variable-length bytes. A search takes the queries in blocks, and for each shard merges the postings of an item's terms by a
heap of their next documents. The best documents so far are in a heap of `k`, keyed by score, then id; lists that together can't
lift a document above the worst of these leave the merge and are only looked up. The shards' best are ranked together at the end.

Scores are whole numbers. A term's weight w is floor(1000 ln((2N+2) / (2df+1))) with N documents that have a term; of n terms in
a document and L in all, m is 10 + (90 n N) div L; a document's score sums w ((10**9 tf) div (1000 tf + 8 m)) over the
item's terms, each once.

Defined cases: a term is a run of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. Documents and items
that are null or have no term are in no result. Documents that repeat an id are documents of their own, and one without an id
comes after all others of its score. Rows of an item id that repeats are one item; a null item id is an item. Texts of any length
are indexed whole, a very long one in a shard of its own. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.llm.shared import cut, discard, small_batches

#: Terms, with repeats, that close a shard; characters of queries that are searched at once; most tasks that search shards.
SHARD_TERMS, BLOCK_CHARS, TASKS = 2_000_000, 1_000_000, 10_000
#: Every ASCII character that isn't a letter or a digit becomes a space, and A-Z becomes a-z.
LETTERS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
INDEX = "shard long, term string, n_docs long, n_terms long, postings binary"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(LETTERS).split()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as variable-length bytes, seven bits in each, and the place of each number's first byte (one more at the end)."""
    values = values.astype(np.uint64)
    sizes = np.maximum(1, (np.frexp(values.astype(np.float64))[1] + 6) // 7)  # rounding up to a power of two costs at most a byte
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    own = np.repeat(np.arange(len(values)), sizes)
    step = np.arange(starts[-1]) - starts[own]
    out = ((values[own] >> (7 * step).astype(np.uint64)) & np.uint64(127)).astype(np.uint8)
    out[step + 1 < sizes[own]] |= 128
    return out, starts


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    own = np.cumsum(last) - last
    starts = np.concatenate([[0], np.flatnonzero(last) + 1])[: int(last.sum())]
    step = np.arange(len(raw)) - starts[own]
    parts = (raw & 127).astype(np.uint64) << (7 * step).astype(np.uint64)
    return (np.add.reduceat(parts, starts) if len(starts) else parts).view(np.int64)


def zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def unzigzag(x: np.ndarray) -> np.ndarray:
    return (x.view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(x & 1)


class ShardBuilder:
    """Documents of a shard to be: numbers of their terms, one array a document."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(lambda: len(self.numbers))
        self.ids, self.docs, self.size = [], [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        found = terms_of(text)
        if found:
            self.ids.append(doc_id)
            self.docs.append(np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found)))
            self.size += len(found)

    def rows(self, shard: int) -> pa.RecordBatch:
        """The shard's rows: the documents under a null term, then each term's postings, gaps and counts in turn."""
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        lengths = np.array([len(self.docs[k]) for k in order], np.int64)
        ids = np.array([self.ids[k] for k in order if self.ids[k] is not None], np.int64)
        keys = np.concatenate([self.docs[k] for k in order]) * len(order) + np.repeat(np.arange(len(order)), lengths)
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        counts, (term, doc) = np.diff(first, append=len(keys)), np.divmod(keys[first], len(order))
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = doc[starts]
        data, at = packed(np.stack([gaps, counts], 1).ravel())
        data, edges = data.tobytes(), at[2 * np.append(starts, len(term))].tolist()
        header = packed(np.concatenate([[len(ids)], zigzag(np.diff(ids, prepend=0)).view(np.int64), lengths]))[0].tobytes() if len(order) else b""
        words = [w.decode() for w in self.numbers]
        n_terms = np.add.reduceat(counts, starts)
        columns = [[shard] * (len(words) + 1), [None, *words], [len(order), *np.diff(np.append(starts, len(term))).tolist()], [self.size, *n_terms.tolist()], [header, *(data[a:b] for a, b in zip(edges, edges[1:]))]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "term", "n_docs", "n_terms", "postings"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(shard, term, n_docs, n_terms, postings): every document in one shard; a null term has the shard's documents.

    Shards are named by the tasks that make them, so the index is written to the shared folder once, and read from there.
    """
    small_batches(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, building = TaskContext.get().partitionId() << 32, ShardBuilder()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                building.add(doc_id, text)
                if building.size >= shard_terms:
                    yield building.rows(shard)
                    shard, building = shard + 1, ShardBuilder()
        if building.ids:
            yield building.rows(shard)

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return cut(plain.where("text is not null").mapInArrow(build, INDEX), "index")


def item_terms(queries: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each once."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([list({w.decode(): 0 for w in terms_of(t or "")}) for t in texts.to_pylist()], pa.list_(pa.string()))

    return queries.select(F.col(item_col).cast("long").alias("item_id"), F.explode(split(F.col(text_col).cast("string"))).alias("term")).distinct()


class Postings:
    """A term's documents in a shard in order, what it adds to each one's score, and the most that it adds."""

    __slots__ = ("docs", "adds", "most")

    def __init__(self, data: bytes, weight: int, m: np.ndarray):
        both = unpacked(data).reshape(-1, 2)
        docs, tf = np.cumsum(both[:, 0]), both[:, 1]
        adds = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
        self.docs, self.adds, self.most = docs.tolist(), adds.tolist(), int(adds.max())


def best(lists: list[Postings], k: int) -> list[tuple[int, int]]:
    """The k best (score, -document) above 0, documents taken in order. Earlier documents win among equals."""
    lists = sorted((x for x in lists if x.most), key=lambda x: x.most)
    together = list(accumulate(x.most for x in lists))
    n, bits, found, least, out = len(lists), len(lists).bit_length(), [], 0, 0
    mask, at = (1 << bits) - 1, [0] * n
    heap = [x.docs[0] << bits | i for i, x in enumerate(lists)]
    heapq.heapify(heap)
    while heap:
        doc, score = heap[0] >> bits, 0
        while heap and heap[0] >> bits == doc:
            i = heap[0] & mask
            p = at[i]
            docs = lists[i].docs
            score += lists[i].adds[p]
            at[i] = p = p + 1
            if p < len(docs):
                heapq.heapreplace(heap, docs[p] << bits | i)
            else:
                heapq.heappop(heap)
        for i in range(out - 1, -1, -1):
            if score + together[i] <= least:
                break
            docs = lists[i].docs
            at[i] = p = bisect_left(docs, doc, at[i])
            if p < len(docs) and docs[p] == doc:
                score += lists[i].adds[p]
        if score > least:
            heapq.heappush(found, (score, -doc))
            if len(found) > k:
                heapq.heappop(found)
            if len(found) == k and found[0][0] > least:
                least, before = found[0][0], out
                while out < n and together[out] <= least:
                    out += 1
                if out > before:
                    heap = [x for x in heap if x & mask >= out]
                    heapq.heapify(heap)
    return found


def search_block(index: DataFrame, wanted: DataFrame, n_docs: int, n_terms: int, k: int, tasks: int) -> DataFrame:
    """(item_id, doc_id, score): each shard's k best documents of each item. `wanted` has (item_id, term, w) and is sent to all tasks."""
    items = defaultdict(list)
    for r in wanted.collect():
        items[r["item_id"]].append(r["term"])
    sent = index.sparkSession.sparkContext.broadcast(dict(items))
    weights = F.broadcast(wanted.select("term", "w").distinct())
    needed = index.join(weights, "term").select("shard", "term", "w", "postings")
    needed = needed.unionByName(index.where("term is null").select("shard", "term", F.lit(0).cast("long").alias("w"), "postings"))

    def shard_best(rows: pa.Table) -> pa.Table:
        plain = list(zip(*(rows.column(c).to_pylist() for c in ("term", "w", "postings")), strict=True))
        numbers = unpacked(next(p for t, _, p in plain if t is None))
        n_ids = int(numbers[0])
        ids, lengths = np.cumsum(unzigzag(numbers[1 : n_ids + 1])), numbers[n_ids + 1 :]
        m = 10 + (90 * lengths * n_docs) // n_terms
        known = {t: Postings(p, w, m) for t, w, p in plain if t is not None and w}
        out = []
        for item, terms in sent.value.items():
            for score, less in best([known[t] for t in terms if t in known], k):
                out.append((item, int(ids[-less]) if -less < n_ids else None, score))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("item_id", "doc_id", "score"), columns, strict=True)})

    # a shard is few bytes and much work, so shards aren't brought together by their size
    return needed.repartition(tasks, "shard").groupBy("shard").applyInArrow(shard_best, "item_id long, doc_id long, score long")


def search(index: DataFrame, queries: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of the whole index with a score above 0.

    Items are dealt to blocks of about block_chars characters of distinct terms, which bounds what is sent to all tasks.
    """
    pairs = cut(item_terms(queries, item_col, text_col), "items")
    n_docs, n_terms, shards = index.where("term is null").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(1)), F.count(F.lit(1))).first()
    blocks = -(-(pairs.agg(F.sum(F.length("term") + 1)).first()[0] or 0) // block_chars) or 1
    df = index.join(pairs.select("term").distinct(), "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = cut(pairs.join(df, "term").select("item_id", "term", weight.alias("w")), "items")
    found = [search_block(index, weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), n_docs, n_terms, k, min(max(shards, 1), TASKS)) for b in range(blocks)]
    down = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of all documents for each item; the index is deleted at the end."""
    index = build_index(docs, id_col, text_col, shard_terms)
    found = cut(search(index, queries, k), "ranked")
    discard(index)
    return found
