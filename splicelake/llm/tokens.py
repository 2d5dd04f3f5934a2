"""Encoding a corpus with a public byte-level BPE vocabulary.

Texts are cut into pieces by the vocabulary's pattern; each distinct piece is
merged once (and remembered within a bounded memory). Merging keeps a segment
tree over the byte positions whose root is the leftmost minimum pair rank: a
merge costs three point updates on live neighbours, logarithmic each, so a piece
of n bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.session import spread

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 400_000
"""Most pieces remembered by a worker."""
SHORT = 64
"""Longer pieces, in characters, are not remembered."""


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    none = 1 << 62
    size = 1
    while size < n:
        size *= 2
    # leaf: rank << 32 | position, so a plain minimum is the leftmost one
    tree = [none] * (2 * size)
    get = ranks.get
    token = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def point(i: int, v: int) -> None:
        k = size + i
        tree[k] = v
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            v = a if a < b else b
            if tree[k] == v:
                return
            tree[k] = v
            k >>= 1

    def rank(i: int) -> int:
        j = after[i]
        r = get(token[i] + token[j]) if j < n else None
        return none if r is None else r << 32 | i

    while tree[1] < none:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        token[i] += token[j]
        nxt = after[j]
        after[i] = nxt
        if nxt < n:
            before[nxt] = i
        point(j, none)
        point(i, rank(i))
        if before[i] >= 0:
            point(before[i], rank(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i]])
        i = after[i]
    return out


class _Known(dict):
    """Ids by piece, merged where they are first asked for."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def __missing__(self, piece: str) -> list[int]:
        ids = merge_piece(piece.encode("utf-8", "replace"), self.ranks)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts; special tokens are never produced."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.known = _Known(ranks)
        self.pieces = regex.compile(PATTERN).findall

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.pieces(text or ""))))


def encode_corpus(df: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(ident, ids) of every row; null and empty texts have the empty list.

    The vocabulary (fixed size, about 50,000 entries) is read on the driver and
    sent once to each executor. No shuffle, no length limit.
    """
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    held: dict[str, Encoder] = {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = held.get("e") or held.setdefault("e", Encoder(ranks.value))
        for b in batches:
            flat, ends = array("i"), array("i", [0])
            for t in b.column(1).to_pylist():
                if t:
                    flat.extend(enc.encode(t))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["__id", "ids"])

    base = df.select(F.col(ident).alias("__id"), F.col(text).cast("string").alias("__text"))
    kind = base.schema["__id"].dataType.simpleString()
    return spread(base).mapInArrow(run, f"__id {kind}, ids array<int>").withColumnRenamed("__id", ident)
