"""Splitting several values packed in one field.

A field is reduced to its *delimiter skeleton*: values (runs of ordinary characters,
and quoted stretches that stand where a value can stand) are masked, and the delimiter
runs that remain are told apart by their place: before the first value, between
values (each distinct run once), after the last. Skeletons depend on the layouts in
use, not on the number or content of the values, so there are few. A splitting rule
is resolved once per distinct skeleton: what to cut off in front and behind, which runs
separate, and which quotes enclose values. Rules are joined back (broadcast while their
number is within a checked bound, an ordinary join beyond it) and applied: the field is
cut at the separators its rule names, so a value's position is that of its slot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.session import spread

BROADCAST_SKELETONS = 20_000
"""Most skeletons, with a short rule each, that are broadcast."""
LONGEST_SKELETON = 1_000
"""Longest skeleton, in characters, that is broadcast."""


@dataclass(frozen=True)
class Packing:
    """What a value of a packed field is made of.

    ordinary: regex class body of the characters of a value (outside quotes).
    value: regex that one unquoted value matches as a whole.
    atomic: values never hold separators, so quotes are only wrapping, around a
    value or around the whole field. Otherwise a quoted stretch is one value.
    """

    ordinary: str
    value: str
    atomic: bool = True


SPANS = Packing(ordinary="0-9-", value="[0-9]+-[0-9]+")
INTEGERS = Packing(ordinary="0-9", value="[0-9]+")
NAMES = Packing(ordinary=r"^\s,;|/\"'\[\]{}", value=r"[^\s,;|/\"'\[\]{}]+", atomic=False)

# characters that stand for masked values: ordinary, double-quoted, single-quoted
_PLAIN, _DOUBLE, _SINGLE = "\u0001", "\u0002", "\u0003"
_MASKS = f"[{_PLAIN}{_DOUBLE}{_SINGLE}]"
_PART, _SEP = "\u0004", "\u0005"


@dataclass(frozen=True)
class Rule:
    """How fields of one skeleton are split: characters to cut off in front and behind,
    the separators (a regex, null: the field is one value), and the regex of one slot
    where quotes enclose values (null: slots are cut at the separators)."""

    front: int
    behind: int
    separator: str | None
    slot: str | None


_RULE = "front int, behind int, sep string, slot string"


def _body(packing: Packing) -> str:
    """The regex class of the characters of an unquoted value; masks are none."""
    masks = _PLAIN + _DOUBLE + _SINGLE
    return f"[^{masks}{packing.ordinary[1:]}]" if packing.ordinary.startswith("^") else f"[{packing.ordinary}]"


def _quoted(packing: Packing, q: str) -> str:
    """A quoted stretch in the place of a value: no character of a value touches it."""
    return f"(?<!{_body(packing)}){q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}(?!{_body(packing)})"


def _bare(packing: Packing) -> str:
    """An unquoted value. A quote between its characters encloses nothing and belongs to it."""
    body = _body(packing)
    return f"{body}++" if packing.atomic else f"{body}++(?:[\"']++{body}++)*+"


def skeleton(field: Column, packing: Packing) -> Column:
    """The delimiter skeleton of a field: kinds of values, the delimiter runs before, after
    and between them, the latter distinct and in order."""
    x = field
    if not packing.atomic:
        x = F.regexp_replace(x, _quoted(packing, '"'), _DOUBLE)
        x = F.regexp_replace(x, _quoted(packing, "'"), _SINGLE)
    runs = F.regexp_replace(x, _bare(packing), _PLAIN)
    between = F.split(runs, _MASKS, -1)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(runs, F.lit(_MASKS), F.lit(0)))), "")
    n = F.size(between)
    seps = F.array_join(F.array_sort(F.array_distinct(F.slice(between, F.lit(2), F.greatest(n - 2, F.lit(0))))), _SEP)
    return F.concat_ws(_PART, kinds, F.get(between, F.lit(0)), F.when(n > 1, F.try_element_at(between, F.lit(-1))).otherwise(""), seps)


def resolve_rule(sk: str, packing: Packing) -> Rule | None:
    """The splitting rule of a skeleton; None where it holds no value.

    Delimiters before the first and after the last value are cut off. Every run that
    stands between two values separates, the longest first, so that one run is never
    taken for a shorter one with an empty place behind it. Where quotes enclose values,
    separators may stand inside them, so slots are described instead."""
    kinds, front, behind, seps = sk.split(_PART)
    if not kinds:
        return None
    runs = sorted(seps.split(_SEP), key=lambda x: (-len(x), x)) if seps else []
    sep = "|".join(re.escape(x) for x in runs) or None
    if kinds == _PLAIN and (packing.atomic or not set("\"'") & set(seps)):
        return Rule(len(front), len(behind), sep, None)
    ways = [_quoted(packing, q) for k, q in ((_DOUBLE, '"'), (_SINGLE, "'")) if k in kinds]
    return Rule(0, 0, None, "|".join([*ways, _bare(packing)]))


def _rules(packing: Packing):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(x, *astuple(r)) for x in b["__sk"] if (r := resolve_rule(x, packing))]
            yield pd.DataFrame(rows, columns=["__sk", "front", "behind", "sep", "slot"]).astype({"front": "int32", "behind": "int32"})

    return run


def _extract(field: Column, packing: Packing) -> Column:
    """Values in order, by the rule in the columns front, behind, sep and slot."""
    inner = F.substring(field, F.col("front") + 1, F.length(field) - F.col("front") - F.col("behind"))
    cut = F.when(F.col("sep").isNull(), F.array(inner)).otherwise(F.split(inner, F.col("sep"), -1))
    if packing.atomic:
        # what stands in a slot and is no value is left out, as is an empty place
        return F.filter(cut, lambda v: v.rlike(f"^(?:{packing.value})$"))
    slots = F.when(F.col("slot").isNull(), cut).otherwise(F.regexp_extract_all(field, F.col("slot"), F.lit(0)))

    def clean(x: Column) -> Column:
        q = F.substring(x, 1, 1)
        body = F.substring(x, F.lit(2), F.length(x) - 2)
        whole = F.length(x) >= 2
        return F.trim(
            F.when(whole & (q == '"') & x.endswith('"'), F.replace(body, F.lit('""'), F.lit('"')))
            .when(whole & (q == "'") & x.endswith("'"), F.replace(body, F.lit("''"), F.lit("'")))
            .otherwise(x)
        )

    return F.filter(F.transform(slots, clean), lambda v: ~v.isin("", "-", "."))


def split_packed(df: DataFrame, ident: str, field: str, packing: Packing) -> DataFrame:
    """One row (ident, pos, val) per value of ``field``, pos counting from 1.

    Null, blank, ``-`` and ``.`` fields hold no value; empty places, and what stands
    in a place and is no value, are left out and don't count; other columns are not
    looked at. Rows with equal ident are split independently.
    """
    f = F.trim(F.col(field).cast("string"))
    base = (
        spread(df.select(F.col(ident).alias("__id"), f.alias("__f")))
        .where(F.col("__f").isNotNull() & ~F.col("__f").isin("", "-", "."))
        # never null, so the join adds no filter that would work the skeleton out twice
        .withColumn("__sk", F.coalesce(skeleton(F.col("__f"), packing), F.lit("")))
    )
    known = base.select("__sk").distinct()
    # a long skeleton (a field that is no packing) comes as null
    short = known.select(F.when(F.length("__sk") <= LONGEST_SKELETON, F.col("__sk")))
    few = [r[0] for r in short.limit(BROADCAST_SKELETONS + 1).collect()]
    if len(few) <= BROADCAST_SKELETONS and None not in few:
        rows = [(sk, *astuple(r)) for sk in few if (r := resolve_rule(sk, packing))]
        rules = F.broadcast(df.sparkSession.createDataFrame(rows, f"__sk string, {_RULE}"))
    else:
        rules = known.mapInPandas(_rules(packing), f"__sk string, {_RULE}")
    parts = base.join(rules, "__sk").select("__id", _extract(F.col("__f"), packing).alias("__v"))
    # the outer form keeps the optimiser from testing the extracted array beforehand
    rows = parts.select(F.col("__id").alias(ident), F.posexplode_outer("__v").alias("__p", "val")).where("val IS NOT NULL")
    return rows.select(ident, (F.col("__p") + 1).alias("pos"), "val")


def split_one(text: str | None, packing: Packing) -> list[str]:
    """Plain one-value reading of the same definition, used to check the operator."""
    t = (text or "").strip(" ")
    if t in ("", "-", "."):
        return []
    if packing.atomic:
        return re.findall(packing.value, t)
    out, i = [], 0
    while i < len(t):
        c = t[i]
        if c in "\"'":
            j, buf = i + 1, []
            while j < len(t):
                if t[j] == c and t[j + 1 : j + 2] == c:
                    buf.append(c)
                    j += 2
                elif t[j] == c:
                    break
                else:
                    buf.append(t[j])
                    j += 1
            if j < len(t):
                out.append("".join(buf).strip(" "))
                i = j + 1
                continue
            i += 1
            continue
        m = re.compile(packing.value).match(t, i)
        if m:
            out.append(m[0])
            i = m.end()
        else:
            i += 1
    return [x for x in out if x not in ("", "-", ".")]
