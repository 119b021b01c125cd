"""BPE encoding and decoding, with certain cuts where no token of the vocabulary can lie.

A text is cut at its white space, each piece is normalised and cut into pre-tokens, and a pre-token becomes symbols: a letter
for each byte, the last one with the mark of a word's end. Two symbols that are side by side in no string of the vocabulary
can never be merged, nor can anything across them, so a pre-token is cut between them for certain. The fragments are encoded
by themselves, by the library's merges, and their tokens are put one after another.

Defined cases: a null text counts as empty, without tokens. Special strings inside a text are one token each, as the library
has it by default. Pieces that aren't plain ASCII are normalised and cut into pre-tokens by the library's functions, whose
letters and white space they are. A text or a word of any length is encoded whole; only pieces up to PIECE characters are remembered. Decoding joins the tokens by spaces, since this vocabulary has no decoder;
a null list of ids is empty and ids that the vocabulary lacks are left out. Rows, repeated ones too, and other columns pass
unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from evalloom.llm.shared import small_batches
from evalloom.llm.token_counts import byte_letters

#: Entries in a worker's dictionaries of pieces and of fragments, and the longest one that is remembered.
CACHE, PIECE = 300_000, 64
#: What splits a text for certain, here and in the library.
PIECES = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Fixed value: this vocabulary's pre-tokens, as far as ASCII goes.
PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall


class Recent(dict):
    """A dictionary that makes missing values and forgets: beyond CACHE entries, those not used since the last time go."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= PIECE:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Merges:
    """The pairs of symbols that occur inside a token, and encoding of pre-tokens by their fragments."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        self.end, self.vocab = model["end_of_word_suffix"] or "", model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inside = BPE(vocab=self.vocab, merges=merges)
        self.last = BPE(vocab=self.vocab, merges=merges, end_of_word_suffix=self.end) if self.end else self.inside
        self.inner = frozenset(pair for token in self.vocab for pair in pairwise(self.symbols(token)))
        self.fragments = Recent(self.of_fragment)

    def symbols(self, token: str) -> list[str]:
        """A token's letters; the mark of a word's end belongs to the last one."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            return self.marked(token[: -len(self.end)])
        return list(token)

    def marked(self, letters: str) -> list[str]:
        return [*letters[:-1], letters[-1] + self.end]

    def cut(self, letters: str) -> list[str]:
        """A pre-token's fragments between certain cuts; the last one is marked by a space at its end."""
        symbols, found, start = self.marked(letters), [], 0
        if not self.inner.issuperset(pairwise(symbols)):
            for k, pair in enumerate(pairwise(symbols), 1):
                if pair not in self.inner:
                    found.append(letters[start:k])
                    start = k
        return [*found, letters[start:] + " "]

    def of_fragment(self, fragment: str) -> list[int]:
        """Tokens of a fragment: merged by rank, leftmost first."""
        model, letters = (self.last, fragment[:-1]) if fragment[-1] == " " else (self.inside, fragment)
        return [t.id for t in model.tokenize(letters)]

    def pretoken(self, letters: str) -> list[int]:
        """Tokens of a pre-token written in the letters that stand for bytes."""
        whole = letters + " "
        if whole in self.fragments:  # a fragment has no cut inside
            return self.fragments[whole]
        return [k for f in self.cut(letters) for k in self.fragments[f]]


class Encoder:
    """Token ids of texts, piece by piece between white space, each as the bytes of 32-bit numbers."""

    def __init__(self, path: str):
        self.merges, self.library = Merges(path), Tokenizer.from_file(path)
        self.letter = {b: c for c, b in byte_letters().items()}
        self.specials = {t.content: k for k, t in self.library.get_added_tokens_decoder().items() if t.special}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.known = Recent(self.of_piece)

    def pretokens(self, piece: str) -> list[str]:
        """Pre-tokens in the letters that stand for bytes; an ASCII character stands for itself unless it is a control character."""
        if piece.isascii():
            found = PRETOKENS(piece.lower())
            return found if piece.isprintable() else ["".join(self.letter[ord(c)] for c in p) for p in found]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))]

    def of_piece(self, piece: str) -> bytes:
        found = array("i")
        for part in self.special.split(piece) if self.special and "|" in piece else [piece]:
            if part in self.specials:
                found.append(self.specials[part])
            elif part:
                for pretoken in self.pretokens(part):
                    found.extend(self.merges.pretoken(pretoken))
        return found.tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, PIECES(text)))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@cache
def tokens(path: str) -> pa.Array:
    """Each id's token; null where an id isn't used."""
    known = {k: s for s, k in Tokenizer.from_file(path).get_vocab(with_added_tokens=True).items()}
    return pa.array([known.get(k) for k in range(max(known) + 1)], pa.large_string())


def encode(spark: SparkSession, text: Column, path: str) -> Column:
    """array<int>: the token ids of a text column. Executors read the vocabulary at `path` too."""
    small_batches(spark)

    @F.arrow_udf("array<int>")
    def ids_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = encoder(path)
        for batch in texts:
            found = [known.ids(t or "") for t in batch.to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
            yield pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(found), np.int32))

    return ids_of(text)


def decode(spark: SparkSession, ids: Column, path: str) -> Column:
    """The text that a column of token ids stands for."""
    small_batches(spark)

    @F.arrow_udf("string")
    def text_of(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = tokens(path)
        for batch in lists:
            each = batch.fill_null([]) if batch.null_count else batch
            values, rows = each.flatten(), pc.list_parent_indices(each)
            there = pc.fill_null(pc.and_(pc.greater_equal(values, 0), pc.less(values, len(known))), False)
            values, rows = known.take(values.filter(there)), rows.filter(there)
            used = values.is_valid()
            ends = np.searchsorted(rows.filter(used).to_numpy(), np.arange(len(each) + 1))
            words = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), values.filter(used))
            yield pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string())

    return text_of(ids)


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """docs with a column of token ids."""
    return docs.withColumn(into, encode(docs.sparkSession, F.col(text_col).cast("string"), path))


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the text that the ids stand for."""
    return encoded.withColumn(into, decode(encoded.sparkSession, F.col(ids_col).cast("array<int>"), path))
