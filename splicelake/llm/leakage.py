"""Held-out test items inside corpus documents.

Texts are read as sequences of words (folded form, punctuation removed). A
passage of ``least`` words of which at most one in ten is edited must hold an
exact run of ``SEED`` words, so all runs of that many words of the items are
searched by a multi-pattern matcher after Wu and Manber over words: a shift
table on blocks of two words skips positions where no pattern can end, the
suffix block selects a bucket, and the bucket is compared directly. Each hit is
then extended to both sides, furthest-reaching by number of edits, which decides
exactly whether it belongs to a passage.

A passage of ``FAR`` words or more can be cut between two neighbouring words that agree into
two of at least ``LEAST``: of L words there are L - 35 such cuts, and an edit, of which there are
at most L / 10, spoils two at most. One of both has no more than one edit in ten. So a
shorter passage lies in each, and an extension needs no more than four edits, however long
item and document are.

Items are the stated query set. While they are few (``ITEM_CHARS``, measured), one matcher
goes to all executors and documents are read once, without a shuffle. Beyond that the
runs of items and documents are joined by hash, a bitmap of fixed size holding back
those of documents that no item has; only documents left by this join are searched,
block by block of items.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.llm.normal import folded
from splicelake.session import cut, spread

LEAST, PER_EDIT, SEED = 18, 10, 6
FAR = 44
ITEM_CHARS = 2_000_000
"""Characters of items in one matcher."""
BITMAP_BITS = 27
"""Binary logarithm of the bits of the bitmap: 16 MB."""
KNOWN, SHORT = 300_000, 40
"""Most pieces between white space remembered by a worker, and their longest."""


class _Letters(dict):
    """Keeps letters, digits and marks; removes punctuation and symbols."""

    def __missing__(self, o: int) -> str | None:
        c = chr(o)
        k = unicodedata.category(c)
        to = c if k[0] in "LNM" else " " if k[0] == "Z" or c.isspace() else ""
        self[o] = to
        return to


_LETTERS = _Letters()


_SEEN: dict[str, list[str]] = {}


def words(text: str | None) -> list[str]:
    """Words of a text: case, punctuation, emphasis, quotes and white space don't count.

    Nothing composes across white space, so pieces between it are read one by one, each
    distinct one once."""
    out: list[str] = []
    for piece in (text or "").split():
        got = _SEEN.get(piece)
        if got is None:
            got = folded(piece).translate(_LETTERS).split()
            if len(piece) <= SHORT:
                if len(_SEEN) >= KNOWN:
                    _SEEN.clear()
                _SEEN[piece] = got
        out += got
    return out


class _Pieces(dict):
    """The ids of the words of a piece between white space, worked out once per distinct piece."""

    def __init__(self, ids: dict[str, int]) -> None:
        self.ids = ids

    def __missing__(self, piece: str) -> tuple[int, ...]:
        got = tuple(self.ids.get(w, 0) for w in folded(piece).translate(_LETTERS).split())
        if len(piece) <= SHORT:
            if len(self) >= KNOWN:
                self.clear()
            self[piece] = got
        return got


@dataclass
class Matcher:
    """Wu-Manber tables over the words of all items."""

    items: list[tuple[int, list[int]]] = field(default_factory=list)
    ids: dict[str, int] = field(default_factory=dict)
    shift: dict[tuple[int, int], int] = field(default_factory=dict)
    bucket: dict[tuple[int, int], dict[tuple[int, ...], list[tuple[int, int]]]] = field(default_factory=dict)

    pieces: _Pieces | None = None

    @classmethod
    def build(cls, rows: Iterable[tuple[int, str | None]]) -> Matcher:
        m = cls()
        for item, text in rows:
            seq = [m.ids.setdefault(w, len(m.ids) + 1) for w in words(text)]
            if len(seq) < LEAST:
                continue
            k = len(m.items)
            m.items.append((item, seq))
            for i in range(len(seq) - SEED + 1):
                pat = tuple(seq[i : i + SEED])
                for j in range(SEED - 1):
                    block, s = (pat[j], pat[j + 1]), SEED - 2 - j
                    if s < m.shift.get(block, SEED):
                        m.shift[block] = s
                m.bucket.setdefault(pat[-2:], {}).setdefault(pat, []).append((k, i))
        return m

    def search(self, text: str | None) -> list[int]:
        """Items of which the text holds a passage."""
        if self.pieces is None:
            self.pieces = _Pieces(self.ids)
        seq = list(chain.from_iterable(map(self.pieces.__getitem__, (text or "").split())))
        n, i, found = len(seq), SEED - 1, set()
        # last maximal run per (item, diagonal), so a run is extended once
        runs: dict[tuple[int, int], int] = {}
        shift, bucket = self.shift, self.bucket
        far = SEED - 1
        while i < n:
            s = shift.get((seq[i - 1], seq[i]), far)
            if s:
                i += s
                continue
            at = i - SEED + 1
            for k, p in bucket[seq[i - 1], seq[i]].get(tuple(seq[at : i + 1]), ()):
                if k in found or runs.get((k, at - p), -1) > at:
                    continue
                ok, end = self._passage(self.items[k][1], p, seq, at)
                runs[k, at - p] = end
                if ok:
                    found.add(k)
            i += 1
        return sorted({self.items[k][0] for k in found})

    @staticmethod
    def _passage(item: list[int], p: int, doc: list[int], d: int) -> tuple[bool, int]:
        """Whether the exact run around a seed belongs to a passage; where the run ends in the document."""
        a, b = p, d
        while a and b and item[a - 1] == doc[b - 1]:
            a, b = a - 1, b - 1
        e, f = p + SEED, d + SEED
        while e < len(item) and f < len(doc) and item[e] == doc[f]:
            e, f = e + 1, f + 1
        run = e - a
        if run >= LEAST:
            return True, f
        most = min(len(item), FAR - 1) // PER_EDIT
        right = _reach(item, e, doc, f, most, 1)
        left = _reach(item, a - 1, doc, b - 1, most, -1)
        for x, lx in enumerate(left):
            for y, ry in enumerate(right):
                if run + lx + ry >= max(LEAST, PER_EDIT * (x + y)):
                    return True, f
        return False, f


def _reach(item: list[int], p: int, doc: list[int], d: int, most: int, step: int) -> list[int]:
    """Most words of the item, from ``p`` on, that follow from ``d`` with 0, 1, ... ``most`` edits,
    going forward (step 1) or back (-1).

    A passage ends with words that agree, so a count is taken where a run of
    equal words ends; edits count between such runs only."""
    n, m = (len(item) - p, len(doc) - d) if step > 0 else (p + 1, d + 1)
    n, m = min(n, FAR + most), min(m, FAR + 2 * most)
    front = {0: 0}  # diagonal (document minus item) -> words of the item used
    out, best = [0], 0
    for _ in range(most):
        new: dict[int, int] = {}
        for g, x in front.items():
            for h, y in ((g, x + 1), (g - 1, x + 1), (g + 1, x)):
                if y <= n and 0 <= y + h <= m and y > new.get(h, -1):
                    new[h] = y
        front = {}
        for g, x in new.items():
            y = x
            while y < n and y + g < m and item[p + step * y] == doc[d + step * (y + g)]:
                y += 1
            front[g] = y
            if y > x and y > best:
                best = y
        out.append(best)
    return out


_WORD_HASHES: dict[str, int] = {}
_BASE = 0x9E3779B97F4A7C15


def seed_hashes(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``SEED`` words of a text."""
    known = _WORD_HASHES
    if len(known) > KNOWN:
        known.clear()
    h = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words(text)], dtype=np.uint64)
    if len(h) < SEED:
        return np.empty(0, np.int64)
    n = len(h) - SEED + 1
    out = np.zeros(n, np.uint64)
    for k in range(SEED):
        out = out * np.uint64(_BASE) + h[k : k + n]
    return np.unique(out ^ (out >> np.uint64(29))).view(np.int64)


def _seeds(df: DataFrame, bitmap=None) -> DataFrame:
    """(seed, id) of a frame of i and t; only seeds in the bitmap where one is given."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for b in batches:
            found, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = seed_hashes(t)
                if bits is not None and len(h):
                    at = h.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
                    h = h[(bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                found.append(h)
                ids.append(np.full(len(h), i, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(ids))], names=["seed", "id"])

    return df.mapInArrow(run, "seed long, id long")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """A bitmap of the leading bits of all seeds, of fixed size whatever their number."""
    at = F.shiftrightunsigned("seed", 64 - BITMAP_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    cells = seeds.groupBy(F.shiftright(at, 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(max(1 << (BITMAP_BITS - 6), 1), np.uint64)
    out[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _searched(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) by one matcher of all ``items``, which must be few."""
    rows = [(r["i"], r["t"]) for r in items.collect()]
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher.build(rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = matcher.value.search
        for b in batches:
            ds, its = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in search(t):
                    ds.append(d)
                    its.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ds, pa.int64()), pa.array(its, pa.int64())], names=["doc_id", "item_id"])

    return docs.select("i", "t").mapInArrow(run, "doc_id long, item_id long")


def leaked_items(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row (doc_id, item_id) per document and item of which it holds a passage.

    Null and short texts hold no passage; items of fewer than ``LEAST`` words can't leak;
    repeated items are reported each, as are repeated rows of documents. The same rows come
    out on either side of ``ITEM_CHARS``.
    """
    named = lambda df, i, t: df.select(F.col(i).cast("long").alias("i"), F.col(t).cast("string").alias("t")).where("t IS NOT NULL")
    q = named(items, item, item_text).where("i IS NOT NULL")
    base = spread(named(docs, ident, text))
    total = q.agg(F.sum(F.length("t"))).first()[0] or 0
    if total <= ITEM_CHARS:
        return _searched(base, q)
    seeds = cut(_seeds(q).select("seed").distinct())
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(seeds))
    # documents are told apart by id and text, so that ids may repeat or be null
    key = F.xxhash64("i", "t")
    near = _seeds(base.select(key.alias("i"), "t"), bits).join(seeds, "seed", "left_semi").select(F.col("id").alias("__k")).distinct()
    left = cut(base.withColumn("__k", key).join(near, "__k", "left_semi"))
    # one block may exceed the size by a little: blocks are dealt by hash
    blocks = -(-total // ITEM_CHARS) * 2
    out = None
    for k in range(blocks):
        part = q.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        found = cut(_searched(left, part))
        out = found if out is None else out.unionByName(found)
    return out
