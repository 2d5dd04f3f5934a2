"""Loading delimited lines, with the failing ones set aside and their reason.

A line is parsed at minimum cost by dynamic programming over its characters. The
machine has the states *start of a column*, *plain*, *quoted*, *just closed* and
*closed, blanks read*, each with the number of columns so far. Besides the moves of
the format, which cost nothing, quotes may be inserted or deleted anywhere, and
delimiters inserted or deleted; the latter correct the number of columns and don't
change how the quotes of the line are read. A quote edit weighs more than any
number of delimiter edits, so the edits state the reason: with a quote edit it is
``quoting``, with delimiter edits only ``column_count``; a line of cost zero loads
if all its values are valid, else it is ``bad_value`` at the leftmost column at fault.

A line without any quote and of the right number of columns has cost zero by its
delimiters alone; it is split by built-in expressions, and so are the types of all
lines checked. Only the rest reaches Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIG = 1 << 20
"""Cost of a quote edit, in delimiter edits."""

_START, _PLAIN, _QUOTED, _CLOSED, _AFTER = range(5)


@dataclass(frozen=True)
class Layout:
    """Columns of a delimited table: names, their patterns (none: any text) and further
    tests, by the column at fault, on all values by name (true where at fault)."""

    columns: tuple[str, ...]
    patterns: dict[str, str] = field(default_factory=dict)
    faults: dict[str, Callable[[dict[str, Column]], Column]] = field(default_factory=dict)
    delimiter: str = "\t"


def scan(line: str, delimiter: str = "\t") -> list[str] | None:
    """Values along the moves that cost nothing (at most one leads on from any state), or
    None where they don't lead to the end of the line."""
    out, state, buf = [], _START, []
    for c in line:
        if state == _QUOTED:
            if c == '"':
                state = _CLOSED
            else:
                buf.append(c)
        elif c == delimiter:
            out.append("".join(buf).strip(" "))
            buf, state = [], _START
        elif state == _START:
            if c == '"':
                state = _QUOTED
            elif c != " ":
                state = _PLAIN
                buf.append(c)
        elif state == _PLAIN:
            buf.append(c)
        elif c == '"' and state == _CLOSED:
            state = _QUOTED
            buf.append(c)
        elif c == " ":
            state = _AFTER
        else:
            return None
    return None if state == _QUOTED else [*out, "".join(buf).strip(" ")]


def repair(line: str, columns: int, delimiter: str = "\t") -> tuple[int, list[str]]:
    """Least cost of reading a line as ``columns`` columns, and the edits.

    The number of columns never falls, so states beyond ``columns`` can't end well and are
    left out: the work grows with the line alone. Runs of characters that all states read
    alike are one step. Ties: no delimiter deleted,
    then a quote closed rather than dropped.
    """
    # best[state][columns so far]: cost and edits as a linked list
    best: list[dict[int, tuple[int, tuple | None]]] = [{1: (0, None)}, {}, {}, {}, {}]
    step = re.compile(f'"|{re.escape(delimiter)}| +|[^" {re.escape(delimiter)}]+')

    def put(to: dict, c: int, cost: int, edits: tuple | None) -> None:
        if c <= columns and (c not in to or cost < to[c][0]):
            to[c] = (cost, edits)

    def insert_quotes(at: int) -> None:
        start, _, quoted, closed, _ = best
        was = dict(quoted)
        note = f"insert quote at {at}"
        for x in (start, closed):
            for c, (cost, e) in x.items():
                put(quoted, c, cost + BIG, (note, e))
        for c, (cost, e) in was.items():
            put(closed, c, cost + BIG, (note, e))
        for c, (cost, e) in start.items():
            put(closed, c, cost + 2 * BIG, (note, (note, e)))

    for m in step.finditer(line):
        at, run = m.start(), m[0]
        insert_quotes(at)
        new: list[dict[int, tuple[int, tuple | None]]] = [{}, {}, {}, {}, {}]
        for state in range(5):
            for c, (cost, e) in best[state].items():
                if run == '"':
                    to = (_QUOTED, _PLAIN, _CLOSED, _QUOTED, None)[state]
                    if to is not None:
                        put(new[to], c, cost, e)
                    put(new[state], c, cost + BIG, (f"delete quote at {at}", e))
                elif run == delimiter and state != _QUOTED:
                    put(new[_START], c + 1, cost, e)
                    put(new[_START], c, cost + 1, ("", e))
                elif run[0] == " ":
                    put(new[_AFTER if state == _CLOSED else state], c, cost, e)
                elif state in (_START, _PLAIN):
                    put(new[_PLAIN], c, cost, e)
                elif state == _QUOTED:
                    put(new[_QUOTED], c, cost, e)
        best = new
    insert_quotes(len(line))
    # what is missing is inserted at the end: the place of a delimiter changes no cost
    ends = [(cost + columns - c, -c, k, e) for k, s in enumerate((_CLOSED, _AFTER, _START, _PLAIN)) for c, (cost, e) in best[s].items()]
    cost, c, _, edits = min(ends, key=lambda x: x[:3])
    steps: list[str] = []
    cuts = 0
    while edits:
        if edits[0]:
            steps.append(edits[0])
        else:
            cuts += 1
        edits = edits[1]
    steps.reverse()
    for what, k in (("delete", cuts), ("insert", columns + c)):
        if k:
            steps.append(f"{what} {k} delimiter{'s' * (k > 1)}")
    return cost, steps


def parse(line: str, columns: int, delimiter: str = "\t") -> tuple[int, list[str], list[str] | None]:
    """Least cost, edits, and the values where it costs nothing: a path without edits is the
    least there is, so only where none leads to the end are edits weighed."""
    values = scan(line, delimiter)
    if values is not None and len(values) == columns:
        return 0, [], values
    return *repair(line, columns, delimiter), None


_PARSED = "cost bigint, edits string, vals array<string>"


def _parser(columns: int, delimiter: str) -> Callable[[Column], Column]:
    @F.pandas_udf(_PARSED)
    def run(lines: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if x is None else (*(got := parse(x, columns, delimiter))[:1], "; ".join(got[1]), got[2]) for x in lines]
        return pd.DataFrame(rows, columns=["cost", "edits", "vals"]).astype({"cost": "Int64"})

    return run


def judge_lines(df: DataFrame, layout: Layout, ident: str = "line_id", raw: str = "raw") -> DataFrame:
    """One row per record line: ident, reason ('' if it loads), field, edits (the least
    edits that mend it, '' where none are needed), and the columns of the layout as
    strings (null unless it loads).

    A carriage return at the end and blanks around values don't count. Null and blank
    lines, lines that start with ``#`` and header lines give no row; repeated lines are
    judged each; other columns are not looked at. One pass, no shuffle.
    """
    n, sep = len(layout.columns), layout.delimiter
    text = F.col(raw).cast("string")
    line = F.when(text.endswith("\r"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    bare = F.trim(F.col("__line"), F.lit(" \t\r\n"))
    header = F.ltrim(bare, F.lit('"')).startswith(layout.columns[0])
    base = df.select(F.col(ident).cast("long").alias("__id"), line.alias("__line")).where(F.col("__line").isNotNull())
    parts = F.split("__line", f"\\Q{sep}\\E", -1)
    base = base.where((bare != "") & ~bare.startswith("#") & ~header)
    base = base.withColumn("__hard", F.contains("__line", F.lit('"')) | (F.size(parts) != n))
    x = base.withColumn("__p", _parser(n, sep)(F.when(F.col("__hard"), F.col("__line"))))
    plain = F.transform(parts, lambda v: F.trim(v, F.lit(" ")))
    parsed = F.struct(
        F.when(F.col("__hard"), F.col("__p.cost")).otherwise(F.lit(0)).alias("__cost"),
        F.coalesce("__p.edits", F.lit("")).alias("edits"),
        F.when(F.col("__hard"), F.col("__p.vals")).otherwise(plain).alias("__v"),
    )
    # one generated row each: filters on the result stay above, so a line is parsed once
    x = x.select("__id", F.explode(F.array(parsed)).alias("__r")).select("__id", "__r.*")
    value = {c: F.get("__v", F.lit(i)) for i, c in enumerate(layout.columns)}
    at_fault = F.lit("")
    for c in reversed(layout.columns):
        tests = [~value[c].rlike(f"(?s)^(?:{layout.patterns[c]})\\z")] if c in layout.patterns else []
        tests += [layout.faults[c](value)] if c in layout.faults else []
        if tests:
            at_fault = F.when(reduce(lambda a, b: a | b, tests), F.lit(c)).otherwise(at_fault)
    loads = F.col("__cost") == 0
    x = x.withColumn("field", F.when(loads, at_fault).otherwise(F.lit("")))
    reason = F.when(F.col("__cost") >= BIG, "quoting").when(F.col("__cost") > 0, "column_count").when(F.col("field") != "", "bad_value").otherwise("")
    x = x.withColumn("reason", reason)
    kept = [F.when(F.col("reason") == "", value[c]).alias(c) for c in layout.columns]
    return x.select(F.col("__id").alias(ident), "reason", "field", "edits", *kept)
