"""One consistent form for texts that look the same.

Two forms are made of every distinct value:

* the *folded* form: compatibility normalisation (composed), full case folding,
  every kind of space mapped to the plain one, default-ignorable characters
  removed, look-alike letters mapped to one of them. It ignores more than the
  eye does (letter case, raised digits) and serves to find candidates;
* the *visible* form: the same without what the eye can tell apart. Case stays,
  and only those compatibility mappings are applied that change the width or
  the drawing technique of a character, never raised, lowered or circled ones.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.session import cut, spread

# Letters drawn alike, each group beside the Latin letter it resembles. Greek, Cyrillic,
# Armenian, Cherokee, Lisu and Coptic capitals and the small letters of the first three, as far as common text
# faces draw them alike. Left out: letters that only resemble one (small Cherokee letters, Greek small alpha, rho
# and gamma), styled mathematical letters, digits and marks, which TESTDATA counts as visible differences.
LOOKALIKES = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐ", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "ꓝ", "G": "Ꮐꓖ", "H": "ΗНᎻꓧⲎ", "I": "ΙІӀꓲⲒ",
    "J": "ЈͿᎫꓙ", "K": "ΚКᏦꓗⲔ", "L": "Ꮮꓡ", "M": "ΜМᎷꓟⲘ", "N": "ΝꓠⲚ", "O": "ΟОꓳⲞՕ", "P": "ΡРᏢꓑⲢ", "Q": "Ԛ", "R": "Ꭱꓣ",
    "S": "ЅՏᏚꓢ", "T": "ΤТᎢꓔⲦ", "U": "Սꓴ", "V": "Ꮩꓦ", "W": "ԜᎳꓪ", "X": "ΧХꓫⲬ", "Y": "ΥҮᎩꓬⲨ", "Z": "ΖᏃꓜ",
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "οоօ", "p": "р",
    "q": "ԛզ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у",
}

# The ranges of Default_Ignorable_Code_Point.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
# Compatibility tags whose characters differ in width or technique only.
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")

_LATIN = {ord(x): a for a, xs in LOOKALIKES.items() for x in xs}


def _ignorable(o: int) -> bool:
    return any(a <= o <= b for a, b in IGNORABLE)


class Table(dict):
    """A character map for str.translate that fills itself, once per distinct character."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        if o < 128:
            to = c
        elif _ignorable(o):
            to = ""
        elif unicodedata.category(c) == "Zs":
            to = " "
        else:
            tag = unicodedata.decomposition(c).partition(" ")[0]
            other_look = tag.startswith("<") and tag not in SAME_LOOK
            x = c if other_look else unicodedata.normalize("NFKC", c)
            # accents apart, so that look-alike letters are found under them
            to = "".join(_LATIN.get(ord(y), y) for y in unicodedata.normalize("NFD", x))
        self[o] = to
        return to


_VISIBLE = Table()


def visible(text: str) -> str:
    """The form in which texts that read the same are equal."""
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(_VISIBLE))


def fold(seen: str) -> str:
    """The folded form of a visible form."""
    if seen.isascii():
        return seen.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", seen).casefold())


def folded(text: str) -> str:
    """The folded form: equal for all texts with equal visible form, and for more."""
    return fold(visible(text))


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _forms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0), b.column(1).to_pylist()
        seen: dict[str, tuple[bytes, bytes, bytes] | None] = {}
        for t in set(texts):
            if t is None:
                continue
            v = visible(t)
            seen[t] = (_digest(t), _digest(fold(v)), _digest(v)) if v.strip() else None
        keep = [i for i, t in enumerate(texts) if t is not None and seen[t] is not None]
        rows = [seen[texts[i]] for i in keep]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(keep, pa.int32())), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(3)]],
            names=["doc_id", "stored", "folded", "seen"],
        )


def form_keys(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """128-bit keys of the stored, folded and visible form of every text with visible characters."""
    base = df.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return base.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).mapInArrow(
        _forms, "doc_id long, stored binary, folded binary, seen binary"
    )


def consistent_text(df: DataFrame, text: str = "text", into: str = "text_norm", case_fold: bool = False) -> DataFrame:
    """``df`` with the visible (or folded) form of ``text`` in a further column; null stays null.

    Worked out once per distinct value of a batch."""
    if into in df.columns:
        raise ValueError(f"column {into} exists")
    form = folded if case_fold else visible

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map({t: form(t) for t in s.dropna().unique()})

    return df.withColumn(into, run(F.col(text).cast("string")))


def look_alike_classes(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, folded, seen, stored) of documents whose class holds several stored texts.

    Candidates are classes of equal folded form with more than one stored text;
    the exact check is equality of the visible form. Only keys are shuffled, and
    counting is combined map-side, so a class of any size is no burden.
    """
    keys = cut(form_keys(spread(df), ident, text))

    def several(x: DataFrame, by: list[str]) -> DataFrame:
        g = x.groupBy(*by).agg(F.min("stored").alias("__a"), F.max("stored").alias("__b"))
        return g.where("__a <> __b").select(*by)

    candidates = keys.join(several(keys, ["folded"]), "folded", "left_semi")
    return candidates.join(several(candidates, ["folded", "seen"]), ["folded", "seen"], "left_semi")


def look_alike_members(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_texts, n_docs): documents of the classes of more than one stored text,
    named by their smallest doc_id; the form of the result that grows with the documents only."""
    c = cut(look_alike_classes(df, ident, text))
    g = c.groupBy("folded", "seen").agg(F.min("doc_id").alias("class_id"), F.countDistinct("stored").alias("n_texts"), F.count(F.lit(1)).alias("n_docs"))
    return c.join(g, ["folded", "seen"]).select("doc_id", "class_id", "n_texts", "n_docs")


def look_alike_pairs(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (doc_id_a < doc_id_b) of documents that differ as stored but read the same.

    Texts are paired first and documents attached afterwards, so copies of one
    text never meet each other: no more rows are made than the result holds.
    Null texts and texts without visible characters pair with nothing.
    """
    docs = cut(look_alike_classes(df, ident, text).select("seen", "stored", "doc_id"))
    texts = docs.select("seen", "stored").distinct()
    other = texts.select("seen", F.col("stored").alias("stored_b"))
    pairs = texts.join(other, "seen").where("stored < stored_b").select("stored", "stored_b")
    left = pairs.join(docs.select("stored", F.col("doc_id").alias("x")), "stored").select("x", "stored_b")
    right = docs.select(F.col("stored").alias("stored_b"), F.col("doc_id").alias("y"))
    both = left.join(right, "stored_b")
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).where("doc_id_a < doc_id_b")
