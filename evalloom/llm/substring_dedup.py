"""Substring dedup: words covered by a window of WIDTH words that also starts elsewhere are removed.

A window's fingerprint is its anchor: its smallest hash of GRAM consecutive words, the first one on ties, so equal windows
have equal anchors. Windows that follow each other with one anchor are a segment, and a segment is an entry of the index:
(anchor, 128-bit digest of the segment's words). The index is log-structured. A batch of documents is cut into segments
once; they are merge-joined with the immutable runs of history, which lie in order of (anchor, digest), and matches are
verified: two segments are the same only if the digests of their words agree, and where an anchor has different segments
the windows themselves are compared, one copy of each segment, by the digest of their words. What a batch repeats is
marked in the batch and, where it is news to them, in documents of history. Then the batch becomes a run, and two runs of
one level are merged to one of the next. Judging batches one by one marks the same windows as judging all at once.

Defined cases: words are runs of anything but space and U+0009 to U+000D; a null text has none, and texts of fewer words
than WIDTH lose nothing. Rows that repeat, exact copies too, are occurrences of their own. Ids may be null, repeat or be
no whole numbers; rows are then numbered in a written copy. Other columns are ignored; an empty table gives an empty
result. A text is read whole; besides one text a worker holds the word numbers of PACK bytes of texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.shared import cut, discard, exists, has_repeated_ids, new_path, small_batches, utf8

WIDTH = 35
GRAM = 6
#: Batches that a whole table is indexed in.
BATCHES = 2
#: Entries in a worker's dictionary of words, and bytes of texts whose words are numbered at once.
CACHE = 400_000
PACK = 1 << 22
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


class WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = n = xxhash.xxh64_intdigest(word, 5)
        return n


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


class Windows:
    """Hashes over the joined words of some texts. Places count words over all of them."""

    def __init__(self, texts: list[bytes | None], words: WordIds, width: int, gram: int):
        split = [(x or b"").split() for x in texts]
        self.joined = b" ".join(w for x in split for w in x)
        self.width, self.lengths = width, np.array([len(x) for x in split], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)))
        n = int(self.first[-1])
        ids = np.fromiter((words[w] for x in split for w in x), np.uint64, n)
        self.bytes = np.concatenate(([0], np.cumsum(np.fromiter((len(w) + 1 for x in split for w in x), np.int64, n))))
        self.down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, UNBASE, np.uint64))))
        up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, BASE, np.uint64))))[:n]
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(ids * up, dtype=np.uint64)))
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        windows = max(0, n - width + 1)
        self.whole = self.doc[:windows] == self.doc[width - 1 :] if windows else np.zeros(0, bool)
        if windows:
            value = mixed(self.run(np.arange(n - gram + 1), gram))
            self.grams, place, span = value, np.arange(len(value)), 1
            while span < width - gram + 1:
                shift = min(span, width - gram + 1 - span)
                later = value[shift:] < value[:-shift]
                value, place = np.where(later, value[shift:], value[:-shift]), np.where(later, place[shift:], place[:-shift])
                span += shift
            self.anchor = place[:windows]

    def run(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of `length` words from each start, the same wherever they stand."""
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def digests(self, start: np.ndarray, length) -> np.ndarray:
        """128-bit digests of `length` words from each start, as rows of two numbers."""
        joined, digest = self.joined, xxhash.xxh3_128_digest
        spans = zip(self.bytes[start].tolist(), (self.bytes[start + length] - 1).tolist(), strict=True)
        return np.frombuffer(b"".join([digest(joined[s:e]) for s, e in spans]), np.int64).reshape(-1, 2)

    def segments(self) -> pd.DataFrame:
        """(doc, start, n, a, d1, d2): first window and number of windows of each segment, the anchor's hash, the words' digest."""
        at = np.flatnonzero(self.whole)
        new = np.concatenate(([True], (np.diff(at) != 1) | (self.anchor[at[1:]] != self.anchor[at[:-1]]))) if len(at) else np.zeros(0, bool)
        start = at[new]
        count = np.diff(np.concatenate((np.flatnonzero(new), [len(at)])))
        return self.rows(start, count + self.width - 1).assign(n=count)

    def rows(self, place: np.ndarray, length) -> pd.DataFrame:
        doc = self.doc[place]
        d = self.digests(place, length)
        anchor = self.grams[self.anchor[place]].view(np.int64) if len(place) else np.zeros(0, np.int64)
        return pd.DataFrame({"doc": doc, "start": place - self.first[doc], "a": anchor, "d1": d[:, 0], "d2": d[:, 1]})


def packs(texts: list[bytes | None]) -> Iterator[slice]:
    """Slices of texts of about PACK bytes, or of one longer text."""
    first = held = 0
    for k, text in enumerate(texts):
        if held and held + len(text or b"") > PACK:
            yield slice(first, k)
            first, held = k, 0
        held += len(text or b"")
    if len(texts) > first:
        yield slice(first, len(texts))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text as bytes): key is the id if ids are whole numbers that tell rows apart, else a number in a written copy."""
    own = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    if dict(own.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint") and not has_repeated_ids(docs, id_col):
        return own.select(F.col("id").cast("long").alias("key"), "id", "text")
    return cut(own.select(F.monotonically_increasing_id().alias("key"), "id", "text"), "keyed")


def segments(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(key, span, a, d1, d2) of each segment of keyed documents; span is 64 * start + windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordIds()
        for pdf in batches:
            key, texts = pdf["key"].to_numpy(), pdf["text"].tolist()
            for part in packs(texts):
                found = Windows(texts[part], words, width, gram).segments()
                yield pd.DataFrame({"key": key[part][found["doc"]], "span": found["start"] * 64 + found["n"]}).join(found[["a", "d1", "d2"]])

    return docs.select("key", "text").mapInPandas(run, "key long, span long, a long, d1 long, d2 long")


def chosen_windows(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(key, span, a, d1, d2) of the windows of keyed documents that their column `spans` names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordIds()
        for pdf in batches:
            key, texts, asked = pdf["key"].to_numpy(), pdf["text"].tolist(), [np.asarray(x) for x in pdf["spans"]]
            for part in packs(texts):
                found, own = Windows(texts[part], words, width, gram), asked[part]
                doc, packed = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
                count = packed % 64
                doc = np.repeat(doc, count)
                start = np.repeat(packed // 64, count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                rows = found.rows(start + found.first[doc], width)
                yield pd.DataFrame({"key": key[part][doc], "span": start * 64 + 1}).join(rows[["a", "d1", "d2"]])

    return docs.select("key", "text", "spans").mapInPandas(run, "key long, span long, a long, d1 long, d2 long")


ENTRY = ["a", "d1", "d2"]
#: Buckets of a run, by anchor; an index of many terabytes has some ten thousand.
BUCKETS = 64


def merged(entries: DataFrame) -> DataFrame:
    """One row for each entry: how often it occurs, and the smallest document with it and a place there."""
    return entries.groupBy(*ENTRY).agg(F.sum("n").alias("n"), F.min_by("span", "key").alias("span"), F.min("key").alias("key"))


def table_name(run: str) -> str:
    return "evalloom_" + run.rsplit("/", 1)[1].replace("-", "_")


class FingerprintIndex:
    """Immutable runs (a, d1, d2, n, span, key) in order of (a, d1, d2), listed in a manifest under `path`.

    A run is a table in buckets by anchor, sorted inside, so a batch is met with history where history lies: only the batch's
    anchors are shuffled, to the buckets, and what history has at others is passed over in the merge.

    An index is opened again by its path; `documents` must then give the keyed documents of history, whose windows are
    looked up where a new batch has an anchor of theirs in other words.
    """

    def __init__(self, spark: SparkSession, width: int = WIDTH, gram: int = GRAM, path: str | None = None, documents: DataFrame | None = None, buckets: int = BUCKETS):
        if width - gram + 1 > 63:
            raise ValueError("a segment may have at most 63 windows: width - gram must be below 63")
        self.spark, self.width, self.gram, self.path = spark, width, gram, path or new_path(spark, "index")
        self.runs, self.version, self.documents, self.buckets = [], 0, documents, buckets
        if path and exists(spark, f"{path}/manifest"):
            stored = spark.read.parquet(f"{path}/manifest")
            self.version = stored.agg(F.max("version")).first()[0]
            rows = stored.where(F.col("version") == self.version).orderBy("place").collect()
            if any((r["width"], r["gram"]) != (width, gram) for r in rows):
                raise ValueError("the stored index has another width or gram")
            self.runs = [(r["level"], r["run"]) for r in rows]
            self.buckets = rows[0]["buckets"] if rows else buckets

    def save(self) -> None:
        """Adds a version of the manifest: which runs there are."""
        self.version += 1
        rows = [(self.version, k, level, run, self.width, self.gram, self.buckets) for k, (level, run) in enumerate(self.runs)]
        listed = self.spark.createDataFrame(rows, "version int, place int, level int, run string, width int, gram int, buckets int")
        listed.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def write(self, entries: DataFrame, level: int) -> None:
        run = f"{self.path}/run-{uuid.uuid4().hex}"
        dealt = entries.select(*ENTRY, "n", "span", "key").repartition(self.buckets, "a")
        dealt.write.format("parquet").bucketBy(self.buckets, "a").sortBy(*ENTRY).option("path", run).saveAsTable(table_name(run))
        self.runs.append((level, run))

    def table(self, run: str) -> DataFrame:
        """A run as a bucketed table; one that another session has written is made known to this one."""
        if not self.spark.catalog.tableExists(table_name(run)):
            self.spark.sql(f"CREATE TABLE {table_name(run)} (a BIGINT, d1 BIGINT, d2 BIGINT, n BIGINT, span BIGINT, key BIGINT) USING parquet CLUSTERED BY (a) SORTED BY ({', '.join(ENTRY)}) INTO {self.buckets} BUCKETS LOCATION '{run}'")
        return self.spark.table(table_name(run))

    def at(self, anchors: DataFrame) -> DataFrame:
        """Entries of history at the given anchors (a), each run met in its buckets; those of several runs are merged."""
        near = [self.table(run).join(anchors.hint("merge"), "a", "left_semi") for _, run in self.runs]
        return near[0] if len(near) == 1 else merged(reduce(DataFrame.unionByName, near))

    def entries(self) -> DataFrame:
        """All entries; those of several runs are merged."""
        if not self.runs:
            return self.spark.createDataFrame([], "a long, d1 long, d2 long, n long, span long, key long")
        found = self.spark.read.parquet(*[p for _, p in self.runs])
        return found if len(self.runs) == 1 else merged(found)

    def add(self, docs: DataFrame) -> DataFrame:
        """Judges a batch of keyed documents, new ones, against themselves and history, then makes it a run and compacts.

        Gives (key, span) of windows that start at least twice: those of the batch, and those of history that the batch
        is the first to repeat.
        """
        own = cut(segments(docs, self.width, self.gram), "segments")
        fresh = cut(merged(own.withColumn("n", F.lit(1).cast("long"))), "fresh")
        marks = self.judge(docs, own, fresh)
        self.write(fresh, 0)
        discard(own, fresh)
        self.documents = docs if self.documents is None else self.documents.unionByName(docs)
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            self.compact(2)
        self.save()
        return marks

    def judge(self, docs: DataFrame, own: DataFrame, fresh: DataFrame) -> DataFrame:
        if self.runs:
            near = cut(self.at(fresh.select("a").distinct()), "near")
            history = near.select(*ENTRY, F.col("n").alias("old_n"), F.col("span").alias("old_span"), F.col("key").alias("old_key"))
            #: A full join, so that anchors of the batch see all that history has at them.
            both = cut(fresh.hint("merge").join(history, ENTRY, "full"), "matches")
            discard(near)
        else:
            both = fresh.select("*", *[F.lit(None).cast("long").alias(c) for c in ("old_n", "old_span", "old_key")])
        several = cut(both.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a", F.lit(True).alias("several")), "anchors")
        known = both.hint("merge").join(several, "a", "left").withColumn("several", F.coalesce("several", F.lit(False)))
        known = known.withColumn("total", F.coalesce("n", F.lit(0)) + F.coalesce("old_n", F.lit(0))).where("total > 1 or several")
        known = cut(known, "known")
        discard(several, *([both] if self.runs else []))
        repeated = known.where("n is not null and total > 1").select(*ENTRY)
        marks = own.join(repeated.hint("merge"), ENTRY, "left_semi").select("key", "span")
        old = known.where("n is not null and old_n = 1").select(F.col("old_key").alias("key"), F.col("old_span").alias("span"))
        #: One copy of each segment is asked for its windows, from history where history has it.
        place = F.when(F.col("old_n").isNotNull(), F.struct(F.col("old_key").alias("key"), F.col("old_span").alias("span"))).otherwise(F.struct("key", "span"))
        asked = known.where("several").select(place.alias("at")).groupBy("at.key").agg(F.collect_set("at.span").alias("spans"))
        texts = docs if self.documents is None else self.documents.unionByName(docs)
        windows = cut(chosen_windows(texts.join(asked.hint("merge"), "key"), self.width, self.gram), "windows")
        twice = cut(windows.groupBy(*ENTRY).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*ENTRY), "twice")
        found = windows.join(twice.hint("merge"), ENTRY, "left_semi").select("key", "span")
        result = cut(marks.union(old).union(found), "marks")
        discard(known, windows, twice)
        return result

    def compact(self, last: int | None = None) -> None:
        """Merges the last runs, or all, to one. Older versions of the manifest still name the merged runs, so their files stay."""
        old = self.runs[-last:] if last else self.runs[:]
        if len(old) < 2:
            return
        self.runs = self.runs[: len(self.runs) - len(old)]
        self.write(merged(reduce(DataFrame.unionByName, [self.table(p) for _, p in old])), max(level for level, _ in old) + 1)


def kept_udf(width: int):
    @F.pandas_udf("kept string, n_words long, n_removed long")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            rows = []
            for text, own in zip(texts, spans, strict=True):
                words = (text or b"").split()
                if own is None or not len(own):
                    rows.append((b" ".join(words).decode(), len(words), 0))
                    continue
                packed, edge = np.asarray(own), np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, packed // 64, 1)
                np.add.at(edge, packed // 64 + packed % 64 + width - 1, -1)
                stay = np.cumsum(edge[:-1]) == 0
                rows.append((b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s]).decode(), len(words), int((~stay).sum())))
            yield pd.DataFrame(rows, columns=["kept", "n_words", "n_removed"])

    return kept


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """One row per document: id, kept (its words that stay, joined by single spaces), n_words, n_removed."""
    spark = docs.sparkSession
    small_batches(spark)
    rows, index = keyed(docs, id_col, text_col), FingerprintIndex(spark, width, gram)
    marks = [index.add(rows.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == b)) for b in range(batches)]
    spans = cut(reduce(DataFrame.union, marks).groupBy("key").agg(F.collect_set("span").alias("spans")), "spans")
    discard(*marks)
    result: Column = kept_udf(width)("text", "spans")
    out = rows.join(spans, "key", "left").select(F.col("id").alias(id_col), result.alias("r"))
    return out.select(id_col, "r.kept", "r.n_words", "r.n_removed")
