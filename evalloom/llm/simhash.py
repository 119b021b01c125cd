"""SimHash near-dedup: fingerprints over word shingles, compared bit-sliced.

Fingerprints within `radius` bits agree on all but `radius` of any blocks of bits, so each is dealt to one bucket for
every choice of the other blocks; buckets with one member are left out and hot buckets are dealt to tiles. A task packs
tiles into one block of fingerprints, turns it into vertical bit planes (bit b of 64 fingerprints in one word) and
counts the differing bits of many pairs at once: a carry-save counter of two planes and an overflow plane. A row of
comparisons is abandoned as soon as all its words have exceeded the radius. What a task sends on is a spanning forest.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; a text of fewer words than a
shingle is one shingle. Equal fingerprints are one class before the comparison. A null id never represents a group that
has another id. Where near copies are dropped, rows with a null or repeated id are rows of their own, judged by their
texts. An empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.forest import unite
from evalloom.llm.shared import components, cut, free_name, small_batches, tiles, utf8

#: Fingerprints in a tile's block, and in what a task compares at once at least.
BLOCK = 256
PACK = 512
#: Shingles whose bits are counted at once, and those that a sketch takes at once.
CHUNK = 16_384
PART = 1024
SEED = 42
#: For a given similarity: least hashes of a sketch, and how many of them make up a bucket's key.
SKETCH, BAND = 120, 5
#: Standard errors by which a candidate's sketches may agree less than the similarity calls for.
MARGIN = 4.5
#: Odd factors, one for each least hash of a sketch.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (SKETCH, 1), np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits in which fingerprints of distinct shingles may differ; at similarity 0.8 about 10 do, with a standard error of 3.
WIDE = 26


def shingle_hashes(text: bytes | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, some at a time."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    if n == 1:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
        return
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[words - 1 :].tolist()
    starts, digest = starts[:n].tolist(), xxhash.xxh64_intdigest
    for k in range(0, n, CHUNK):
        yield np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)), np.uint64, min(CHUNK, n - k))


def bit_counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, words: int) -> int:
    """Bits set in over half the hashes of the text's shingles, as an unsigned integer."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        counts += bit_counts(h)
        n += len(h)
    return majority(counts, n)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The text's distinct shingle hashes in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def sketch(text: bytes | None, words: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(fingerprint of the distinct shingles, their hashes, the least product of them with each of FACTORS)."""
    own, least, counts = shingle_set(text, words), np.full(SKETCH, ~np.uint64(0)), np.zeros(64, np.int64)
    for k in range(0, len(own), PART):
        part = own[k : k + PART]
        counts += bit_counts(part)
        least = np.minimum(least, (part * FACTORS).min(axis=1))
    return majority(counts, len(own)), own, least


def fingerprints_udf(words: int):
    @F.pandas_udf("long")
    def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(x, words) for x in batch], dtype="uint64").astype("int64")

    return fingerprints


def fingerprint_column(text_col: str, words: int) -> Column:
    return fingerprints_udf(words)(utf8(text_col))


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows of words: bit i of word w in row b is bit b of values[64 * w + i]."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def close_pairs(values: np.ndarray, radius: int, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of fingerprints that differ in at most `radius` bits.

    A block is one query against one word, which is 64 fingerprints; it is abandoned once all 64 exceed the radius.
    The counter has just the planes that hold the radius and starts so high that exceeding it overflows.
    """
    planes, n = bit_planes(values), len(values)
    words, full = planes.shape[1], ~np.uint64(0)
    depth = max(1, radius.bit_length())
    start = (1 << depth) - 1 - radius
    place = np.arange(words * 64)
    for k in range(0, n, rows):
        own = np.arange(k, min(k + rows, n))
        query, word = (x.ravel() for x in np.meshgrid(own, np.arange(words), indexing="ij"))
        over = np.packbits((place <= own[:, None]) | (place >= n), axis=1, bitorder="little").view("<u8").ravel()
        counter = [np.full(len(over), full if start >> p & 1 else 0, np.uint64) for p in range(depth)]
        for b in range(64):
            if b % 4 == 0 and not (alive := over != full).all():
                query, word, over = query[alive], word[alive], over[alive]
                counter = [c[alive] for c in counter]
            if not len(query):
                break
            carry = planes[b][word] ^ (np.uint64(0) - (values[query] >> np.uint64(b) & np.uint64(1)))
            for p in range(depth):
                counter[p], carry = counter[p] ^ carry, counter[p] & carry
            over |= carry
        near = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        block, bit = np.nonzero(near)
        yield query[block], word[block] * 64 + bit


def link_packs(radius: int):
    def forest(reps: list, values: list) -> pd.DataFrame:
        value, first = np.unique(np.array(values, np.int64).view(np.uint64), return_index=True)
        rep = np.array(reps, np.int64)[first]
        order = np.argsort(rep, kind="stable")
        value, rep = value[order], rep[order]
        root = np.arange(len(rep))
        for i, j in close_pairs(value, radius):
            unite(root, i, j)
        return pd.DataFrame({"a": rep, "b": rep[root]})[root != np.arange(len(rep))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of their tile; a pack ends only between tiles. All links of a pack are true links, within a tile or not."""
        reps, values, last = [], [], None
        for pdf in batches:
            tile = pdf["_tile"].to_numpy()
            cuts = np.flatnonzero(np.diff(tile)) + 1
            for s, e in itertools.pairwise([0, *cuts.tolist(), len(tile)]):
                if s == e:
                    continue
                if tile[s] != last and len(values) >= PACK:
                    yield forest(reps, values)
                    reps, values = [], []
                last = tile[s]
                reps += pdf["rep"].iloc[s:e].tolist()
                values += pdf["fp"].iloc[s:e].tolist()
        if values:
            yield forest(reps, values)

    return run


def bucket_keys(radius: int) -> list[Column]:
    """Bits of all blocks but `radius`, for each choice of them; radius + 2 blocks."""
    blocks = radius + 2
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << e) - 1) ^ ((1 << s) - 1) for s, e in itertools.pairwise(edges)]
    kept = [sum(c) for c in itertools.combinations(masks, blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in kept]
    return [F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(signed)]


def groups_of(fps: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """(fp, component_id) of every class of equal fingerprints in fps(id, fp)."""
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("rep")), "fingerprints")
    live = classes.where("rep is not null")
    keys = live.select("fp", "rep", F.explode(F.array(*bucket_keys(radius))).alias("key")).select("fp", "rep", "key.choice", "key.bits")
    dealt = tiles(keys, ["choice", "bits"], F.xxhash64("fp"), block).select("_tile", "rep", "fp")
    edges = dealt.repartition("_tile").sortWithinPartitions("_tile").mapInPandas(link_packs(radius), "a long, b long")
    joined = components(edges)
    return classes.join(joined, F.col("rep") == F.col("id"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: id, fp (signed long), component_id (smallest id reachable over links)."""
    small_batches(docs.sparkSession)
    fps = cut(docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col, words).alias("fp")), "fps")
    groups = cut(groups_of(fps, radius), "groups")
    return fps.join(groups, "fp", "left").select(F.col("id").alias(id_col), "fp", F.coalesce("component_id", "id").alias("component_id"))


def sketches_udf(words: int):
    @F.pandas_udf("node long, fp long, sketch binary, bands array<long>")
    def sketches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                value, own, least = sketch(text, words)
                bands = [xxhash.xxh64_intdigest(least[k : k + BAND].tobytes(), k) for k in range(0, SKETCH, BAND)]
                node = xxhash.xxh3_64_intdigest(own.tobytes(), SEED)
                rows.append((node, value, (least >> np.uint64(24)).astype(np.uint8).tobytes(), np.array(bands, np.uint64).view(np.int64)))
            out = pd.DataFrame(rows, columns=["node", "fp", "sketch", "bands"])
            yield out.assign(node=out["node"].astype("uint64").astype("int64"), fp=out["fp"].astype("uint64").astype("int64"))

    return sketches


def least_agreement(similarity: float) -> float:
    """How many bytes of two sketches agree at least where texts are that similar, but for MARGIN standard errors."""
    share = (similarity * 255 + 1) / 256
    return share * SKETCH - MARGIN * (share * (1 - share) * SKETCH) ** 0.5


def link_candidates(similarity: float):
    """Candidate links of a pack: near fingerprints, bit-sliced, whose sketches agree in nearly the share that the similarity calls for."""

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("node", ignore_index=True)
        node, values = rows["node"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), SKETCH)
        root, least = np.arange(len(node)), least_agreement(similarity)
        for i, j in close_pairs(values, WIDE):
            for k in range(0, len(i), CHUNK):
                a, b = i[k : k + CHUNK], j[k : k + CHUNK]
                same = (sketches[a] == sketches[b]).sum(axis=1) >= least
                unite(root, a[same], b[same])
        return pd.DataFrame({"a": node, "b": node[root]})[root != np.arange(len(node))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None
        for pdf in batches:
            for tile, part in pdf.groupby("_tile", sort=False):
                if tile != last and sum(map(len, held)) >= PACK:
                    yield forest(pd.concat(held))
                    held = []
                last = tile
                held.append(part)
        if held:
            yield forest(pd.concat(held))

    return run


def similar_sets(sets: list[np.ndarray], similarity: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of sets of hashes, none empty, whose exact Jaccard similarity is `similarity` or more."""
    sizes = np.array([len(x) for x in sets], np.int64)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts, own = np.concatenate(([0], np.cumsum(sizes))), np.zeros(len(values), bool)
    p, q = similarity.numerator, similarity.denominator
    for i in range(len(sets) - 1):
        mine = place[starts[i] : starts[i + 1]]
        own[mine] = True
        both = np.add.reduceat(own[place[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1], dtype=np.int64)
        own[mine] = False
        j = np.flatnonzero(both * (p + q) >= p * (sizes[i] + sizes[i + 1 :])) + i + 1
        yield np.full(len(j), i), j


def link_verified(words: int, similarity: float):
    """Links of each tile whose texts' whole shingle sets are similar enough, as a spanning forest."""
    exact = Fraction(str(similarity))

    def forest(nodes: list, texts: list) -> pd.DataFrame:
        node, first = np.unique(np.array(nodes, np.int64), return_index=True)
        root = np.arange(len(node))
        if len(node) > 1:
            for i, j in similar_sets([shingle_set(texts[k], words) for k in first], exact):
                unite(root, i, j)
        return pd.DataFrame({"a": node, "b": node[root]})[root != np.arange(len(node))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, texts, last, made = [], [], None, []
        for pdf in batches:
            tile = pdf["_tile"].to_numpy()
            cuts = np.flatnonzero(np.diff(tile)) + 1
            for s, e in itertools.pairwise([0, *cuts.tolist(), len(tile)]):
                if s == e:
                    continue
                if tile[s] != last and nodes:
                    made.append(forest(nodes, texts))
                    nodes, texts = [], []
                last = tile[s]
                for node, text in zip(pdf["node"].iloc[s:e], pdf["text"].iloc[s:e], strict=True):
                    if not nodes or node != nodes[-1]:  # rows that repeat an id and a text come once
                        nodes.append(node)
                        texts.append(text)
            if made:
                yield pd.concat(made)
                made = []
        if nodes:
            yield forest(nodes, texts)

    return run


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(id, text_hash, group) of each row: rows of one group are joined by pairs whose distinct shingles are similar.

    Texts with one set of shingles are a node, the hash of that set. Nodes meet in a bucket if a band of their sketches
    agrees (0.9999 of pairs at similarity 0.8, more above it); there fingerprints are compared bit-sliced within WIDE bits
    and near ones by their sketches, MARGIN standard errors below the similarity. That only finds candidates: all pairs
    of nodes joined by them are then judged on their whole sets of shingles, and only true pairs are links.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), utf8(text_col).alias("text"))
    made = own.select("id", "text_hash", sketches_udf(words)("text").alias("s"))
    rows = cut(made.select("id", "text_hash", "s.node", "s.fp", "s.sketch", "s.bands"), "sketches")
    classes = rows.groupBy("node").agg(F.min(F.struct("text_hash", "id")).alias("rep"), *[F.first(c).alias(c) for c in ("fp", "sketch", "bands")])
    classes = cut(classes, "texts")
    keys = classes.select("node", F.explode("bands").alias("key"))
    dealt = tiles(keys, ["key"], F.xxhash64("node"), block).select("_tile", "node")
    dealt = dealt.join(classes.select("node", "fp", "sketch"), "node").select("_tile", "node", "fp", "sketch")
    edges = dealt.repartition("_tile").sortWithinPartitions("_tile").mapInPandas(link_candidates(similarity), "a long, b long")
    joined = cut(components(edges), "candidates").withColumnRenamed("id", "node")
    asked = joined.join(classes.select("node", "rep"), "node")
    dealt = cut(tiles(asked, ["component"], F.xxhash64("node"), block).select("_tile", "node", F.col("rep.id").alias("_id"), F.col("rep.text_hash").alias("_hash")), "asked")
    texts = own.join(dealt.hint("merge"), (F.col("text_hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id"))).select("_tile", "node", "text")
    edges = texts.repartition("_tile").sortWithinPartitions("_tile", "node").mapInPandas(link_verified(words, similarity), "a long, b long")
    groups = components(edges).withColumnRenamed("id", "node")
    return rows.select("id", "text_hash", "node").join(groups, "node", "left").select("id", "text_hash", F.coalesce("component", "node").alias("group"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but one row of each group of similar texts: the smallest id, nulls last, then the smallest hash
    of the text, and any one of rows that repeat both. Rows without a similar text all stay, as do all columns.
    """
    found = cut(similar_documents(docs, id_col, text_col, words, similarity), "groups")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash"))
    least = cut(found.groupBy("group").agg(first.alias("least"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "least")
    stays = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("text_hash") == F.col("least.text_hash"))
    gone = found.join(least, "group").where(~stays).select(F.col("id").alias(free_name(docs, "_gone")), F.col("text_hash").alias(free_name(docs, "_gone_text")))
    gone, at = cut(gone.distinct(), "gone"), free_name(docs, "_text_hash")
    own = docs.withColumn(at, F.xxhash64(F.col(text_col).cast("string")))
    kept = own.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col(gone.columns[0])) & (F.col(at) == F.col(gone.columns[1])), "left_anti")
    repeated = found.groupBy("id", "text_hash").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates([id_col, at]) if repeated else kept).drop(at)
