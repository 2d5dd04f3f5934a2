"""Deeply nested JSON records into related flat tables.

A record is read once as a stream of tokens and leaves path-value-ordinal
triples; nothing is materialised but the triples asked for. Triples are grouped by
the repeated ancestor their path names and by its ordinals, whatever ancestors there
are, and each group is pivoted to one row of the ancestor's table, which keeps the
ordinals of all its parents. All tables share one shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# one token: a mark, a string, a bare word, or a character that fits nowhere
_TOKEN = re.compile(r'[{}\[\],:]|"[^"\\]*(?:\\.[^"\\]*)*"|[^\s{}\[\],:"]+|"', re.S)
_WORD = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")

Triple = tuple[str, list[int], str | None]


def shred(record: str | None, arrays: frozenset[str], wanted: frozenset[str] | None = None) -> list[Triple]:
    """Path-value-ordinal triples of one JSON record.

    A path names keys joined by ``.``, with ``[]`` for each array on the way;
    ordinals are the positions in these arrays, from 0. Every element of an
    array gives a triple of its own (value None unless it is a scalar), so
    elements without any leaf stay visible. At a path in ``arrays`` (written
    without the final ``[]``) a bare object or scalar is an array of one. A
    record that is null or not JSON gives no triples; null leaves give none; of
    a key given twice the first holds its place and both give triples.
    ``wanted`` restricts the result to these paths.
    """
    if record is None:
        return []
    out: list[Triple] = []
    # above what is wanted paths are kept; below a path that leads to nothing wanted it is None
    leads = None if wanted is None else {""} | {p[:i] for p in wanted for i in range(1, len(p) + 1) if p[i : i + 1] in ("", ".", "[")}
    # a frame: whether an array, path, ordinals, position, key
    stack: list[list] = []
    top: list | None = None
    state = "value"

    def text(token: str) -> str:
        if token == '"':
            raise ValueError("a string that is not closed")
        return json.loads(token, strict=False) if "\\" in token else token[1:-1]

    def place(bare: bool) -> tuple[str | None, list[int], bool]:
        """Path and ordinals of the value that begins now; whether it is an element."""
        if top is None:
            return "", [], False
        path, ords, element = top[1], top[2], top[0]
        if element:
            at = top[3]
            top[3] = at + 1
            if path is not None:
                path, ords = path + "[]", [*ords, at]
        elif path is not None:
            path = f"{path}.{top[4]}" if path else top[4]
            if bare and path in arrays:
                path, ords, element = path + "[]", [*ords, 0], True
        if leads is not None and path not in leads:
            path = None
        return path, ords, element

    try:
        for token in map(itemgetter(0), _TOKEN.finditer(record)):
            c = token[0]
            if state in ("value", "first") and c not in "]},:":
                if c == "{" or c == "[":
                    path, ords, element = place(c == "{")
                    if element and path is not None and (wanted is None or path in wanted):
                        out.append((path, ords, None))
                    top = [c == "[", path, ords, 0, ""]
                    stack.append(top)
                    state = "first" if c == "[" else "key0"
                    continue
                if c == '"':
                    val = text(token)
                elif _WORD.fullmatch(token):
                    val = None if token == "null" else token
                else:
                    return []
                path, ords, element = place(val is not None)
                if path is not None and (element or val is not None) and (wanted is None or path in wanted):
                    out.append((path, ords, val))
                state = "next" if stack else "done"
            elif c == '"' and state in ("key", "key0"):
                top[4] = text(token)
                state = "colon"
            elif c == ":" and state == "colon":
                state = "value"
            elif c == "," and state == "next":
                state = "value" if top[0] else "key"
            elif stack and ((c == "]" and top[0] and state in ("next", "first")) or (c == "}" and not top[0] and state in ("next", "key0"))):
                stack.pop()
                top = stack[-1] if stack else None
                state = "next" if stack else "done"
            else:
                return []
    except ValueError:
        return []
    return out if state == "done" else []


_SHRED_SCHEMA = "__id long, __seq int, __path string, __ords array<int>, __val string"
_SHRED_ARROW = pa.schema([("__id", pa.int64()), ("__seq", pa.int32()), ("__path", pa.string()), ("__ords", pa.list_(pa.int32())), ("__val", pa.string())])


def path_triples(df: DataFrame, ident: str, record: str, arrays: Iterable[str], wanted: Iterable[str] | None = None) -> DataFrame:
    """Triples (__id, __seq, __path, __ords, __val) of all records; __seq counts within a record."""
    arr, want = frozenset(arrays), None if wanted is None else frozenset(wanted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out += [(i, k, *t) for k, t in enumerate(shred(r, arr, want))]
                if len(out) > 50_000:
                    yield _arrow(out)
                    out = []
            yield _arrow(out)

    base = df.select(F.col(ident).cast("long").alias("__id"), F.col(record).alias("__rec")).where(F.col("__rec").isNotNull())
    return base.mapInArrow(run, _SHRED_SCHEMA)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SHRED_ARROW)], schema=_SHRED_ARROW)


def pivot_paths(triples: DataFrame, leaves: Sequence[str] = (), children: Sequence[str] = ()) -> DataFrame:
    """The rows of all tables: __id, ancestor, ords, value, a string column per leaf, and
    ``n_<name>`` per child array (the number of its elements).

    The repeated ancestor of a triple is its path up to the last ``[]`` (none: the record
    itself); what follows is the leaf's name. Which ancestors there are comes from the
    paths. A row's ords are the positions of all arrays down to its element, so those of
    its parent are the same without the last. ``value`` is a scalar element. Of a key
    given twice the first counts; elements without any leaf have rows as well.
    """
    path, ords = F.col("__path"), F.col("__ords")

    def halves(p: Column) -> tuple[Column, Column]:
        """A path up to its last ``[]``, and the name behind it."""
        rest = F.substring_index(p, "[]", -1)
        name = F.when(rest.startswith("."), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
        return F.left(p, F.length(p) - F.length(rest)), name

    own, leaf = halves(path)
    role = lambda anc, at, name, kind: F.struct(anc.alias("ancestor"), at.alias("ords"), name.alias("name"), F.lit(kind).alias("kind"))
    roles = F.array(role(own, ords, leaf, 1))
    if children:
        # an element counts for the row of its parent, too
        above, name = halves(F.left(path, F.length(path) - 2))
        up = role(above, F.slice(ords, F.lit(1), F.greatest(F.size(ords) - 1, F.lit(0))), name, 2)
        ours = F.lit(False)
        for c in children:
            ours = ours | path.endswith(f".{c}[]") | (path == f"{c}[]")
        roles = F.when(ours, F.array(role(own, ords, leaf, 1), up)).otherwise(roles)
    x = triples.select("__id", "__seq", "__val", F.explode(roles).alias("r")).select("__id", "__seq", "__val", "r.*")
    first = lambda n: F.min_by(F.when((F.col("kind") == 1) & (F.col("name") == n), F.col("__val")), F.when((F.col("kind") == 1) & (F.col("name") == n) & F.col("__val").isNotNull(), F.col("__seq")))
    aggs = [first(n).alias(n) for n in leaves]
    aggs += [F.count(F.when((F.col("kind") == 2) & (F.col("name") == n), 1)).alias(f"n_{n}") for n in children]
    return x.groupBy("__id", "ancestor", "ords").agg(first("").alias("value"), *aggs)


def pivot_ancestor(triples: DataFrame, ancestor: str, leaves: Sequence[str] = (), counts: Sequence[str] = ()) -> DataFrame:
    """The table of one repeated ancestor (a path that ends in ``[]``): __id, ords, value, leaves, counts."""
    return pivot_paths(triples, leaves, counts).where(F.col("ancestor") == ancestor).drop("ancestor")
