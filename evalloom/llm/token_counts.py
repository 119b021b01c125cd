"""Token counts of a byte-level BPE, with a shortcut for pre-tokens that are one token.

Offline, on the driver, every vocabulary string is encoded by itself; those that give exactly their own id form the
set of proven single tokens, whose size the vocabulary bounds. A text is cut at its single spaces, where a pre-token
always begins, each piece is cut into pre-tokens, proven ones count one and only the rest are merged. Counts of pieces
are kept in a dictionary of bounded size.

Defined cases: a null text counts as empty, with no bytes and no tokens. Special strings inside a text are one token
each, as the library has it by default. Rows, nulls in other columns and repeated rows pass unchanged; an empty table
gives an empty result. A text of any length is counted whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalloom.llm.shared import small_batches

#: Entries in a worker's dictionary of pieces before it is emptied.
CACHE = 400_000
#: The Unicode White_Space characters, and the pre-token pattern of this vocabulary.
WHITE = "\\t-\\r" + "".join(map(chr, [0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself where printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def single_tokens(path: str) -> frozenset[str]:
    """Strings of the vocabulary that are one pre-token and encode alone as exactly their own token."""
    letters, vocab = byte_letters(), json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
    texts = {}
    for token, number in vocab.items():
        try:
            texts[bytes(letters[c] for c in token).decode()] = number
        except (KeyError, UnicodeDecodeError):
            continue
    whole = regex.compile(PRETOKEN)
    strings = [s for s in texts if s and whole.fullmatch(s)]
    encoded = tokenizer(path).encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded, strict=True) if e.ids == [texts[s]])


class PieceCounts(dict):
    """Tokens of each piece seen."""

    def __init__(self, path: str, proven: frozenset[str]):
        super().__init__()
        self.encode, self.proven = tokenizer(path).encode, proven
        self.pretokens, self.latin = regex.compile(PRETOKEN).findall, re.compile(f"[\\t-\\r -~{chr(0xA1)}-{chr(0x24F)}]*").fullmatch
        self.specials = [t.content for t in tokenizer(path).get_added_tokens_decoder().values() if t.special]
        self.odd = re.compile(rf"^ | $| [{WHITE}]|[{WHITE}] ").search
        self.pieces, self.chunks = re.compile(" ?[^ ]+").findall, re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]").findall

    def merged(self, piece: str) -> int:
        return len(self.encode(piece, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        if not self.latin(piece):  # letters and digits beyond Latin are the library's to tell apart
            n = self.merged(piece)
        else:
            n = sum(1 if p in self.proven else self.merged(p) for p in self.pretokens(piece))
        self[piece] = n
        return n

    def of(self, text: str) -> int:
        for special in self.specials:
            if special in text:
                parts = text.split(special)
                return len(parts) - 1 + sum(map(self.of, parts))
        if not text:
            return 0
        return sum(map(self.__getitem__, self.chunks(text) if self.odd(text) else self.pieces(text)))


@cache
def piece_counts(path: str, proven: frozenset[str]) -> PieceCounts:
    return PieceCounts(path, proven)


def token_count(spark: SparkSession, text: Column, path: str) -> Column:
    """Tokens of a text column as a long. Executors read the vocabulary at `path` too."""
    proven = spark.sparkContext.broadcast(single_tokens(path))

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = piece_counts(path, proven.value)
        for batch in texts:
            yield pd.Series([counts.of(x or "") for x in batch], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), token_count(docs.sparkSession, text, path).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
