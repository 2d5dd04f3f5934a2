"""Corpus encoding, test-item leakage and look-alike texts against brute force."""

import itertools
import os
import random
import unicodedata

import pytest

pytest.importorskip("splicelake.llm")
from splicelake.llm import leakage, normal, tokens  # noqa: E402
from splicelake.llm.queries import QUERIES  # noqa: E402

VOCAB = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# encoding -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.load_ranks(VOCAB), special_tokens={}).encode_ordinary


def test_encoding_equals_the_library(reference):
    enc = tokens.Encoder(tokens.load_ranks(VOCAB))
    rng = random.Random(1)
    texts = ["", " ", "a", "<|endoftext|>", "it's we'll  \n\n x", "é" * 50, "\U0001f9ec\U0001f44d", "１２３ abc", "a" * 3000, "​﻿", "\r\n\t", "naïve coöperate"]
    texts += ["".join(rng.choice("abcdef 12.,\n'üж中") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    texts.append("".join(rng.choice("abcdefgh") for _ in range(20_000)))
    for t in texts:
        assert enc.encode(t) == reference(t), t[:50]


def slow_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_segment_tree_merges_leftmost_first():
    ranks = {bytes([c]): c for c in range(256)}
    for i, p in enumerate([b"ab", b"bc", b"aa", b"aab", b"abab", b"bcbc", b"cab"]):
        ranks[p] = 300 + i
    rng = random.Random(2)
    for _ in range(2000):
        s = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        if s not in ranks:
            assert tokens.merge_piece(s, ranks) == slow_merge(s, ranks), s


def test_encode_corpus(spark, reference, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 2)
    data = [(1, "one two two"), (2, None), (3, ""), (4, "  "), (5, "one two two"), (None, "x")]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "'z' AS ids", "1 AS __id")
    got = {(r["doc_id"]): r["ids"] for r in tokens.encode_corpus(df).collect()}
    assert got == {i: reference(t or "") for i, t in data}
    assert tokens.encode_corpus(df).count() == 6
    assert tokens.encode_corpus(df.limit(0)).count() == 0


# leakage ---------------------------------------------------------------------------


def edit_ok(item, doc, least=18):
    """Whether some run of the item's words of length L >= least, with both ends kept, has
    an alignment with a run of the document of at most L / 10 edits. Plain dynamic program."""
    n, m = len(item), len(doc)
    for a in range(n):
        for b in range(m):
            if item[a] != doc[b]:
                continue
            # rows: words of the item used from a on; columns: words of the document from b on
            prev = {0: 0}
            for j in range(1, 14):
                prev[j] = j
            prev = {j: c for j, c in prev.items()}
            for i in range(1, n - a + 1):
                cur = {}
                for j in range(0, min(m - b, i + 13) + 1):
                    if j < i - 13:
                        continue
                    c = min(prev.get(j, 99) + 1, cur.get(j - 1, 99) + 1, 99)
                    if j:
                        c = min(c, prev.get(j - 1, 99) + (item[a + i - 1] != doc[b + j - 1]))
                    cur[j] = c
                    if i >= least and j and item[a + i - 1] == doc[b + j - 1] and c <= i // 10:
                        return True
                prev = cur
    return False


def test_search_against_brute_force():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([10, 18, 25, 45])))) for k in range(12)]
    m = leakage.Matcher.build(items)
    hits = 0
    for _ in range(250):
        k, text = rng.choice(items)
        ws = text.split()
        a = rng.randint(0, max(0, len(ws) - 18))
        part = ws[a : a + rng.choice([12, 16, 17, 18, 19, 22, 30, 45])]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            i = rng.randrange(len(part))
            part[i : i + 1] = rng.choice([[], ["zz"], [part[i], "yy"]])
            part = part or ["zz"]
        doc = [rng.choice(vocab) for _ in range(rng.randint(0, 8))] + part + [rng.choice(vocab) for _ in range(rng.randint(0, 8))]
        want = [q for q, t in items if edit_ok(t.split(), doc)]
        assert m.search(" ".join(doc)) == want, (k, doc)
        hits += len(want)
    assert hits > 60


def test_marks_do_not_count():
    words = [f"word{chr(97 + i)}" for i in range(20)]
    m = leakage.Matcher.build([(7, " ".join(words))])
    assert m.search("> **" + "**,\n> ".join(w.upper() for w in words).replace("O", "Ｏ") + "!") == [7]
    assert m.search(" ".join("w​" + w[1:] for w in words)) == [7]
    assert m.search(" ".join(words[:15])) == []
    assert m.search(None) == m.search("") == []


def test_leaked_items(spark, monkeypatch):
    item = " ".join(f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " + item), (2, None), (3, ""), (4, item.upper()), (5, "t1 t2")], SCHEMA).selectExpr("*", "1 AS item_id", "2 AS d")
    items = spark.createDataFrame([(10, item), (11, item), (12, None), (None, item), (13, "short")], "item_id long, text string")
    want = [(1, 10), (1, 11), (4, 10), (4, 11)]
    assert rows(leakage.leaked_items(docs, items)) == want
    monkeypatch.setattr(leakage, "ITEM_CHARS", 40)
    assert rows(leakage.leaked_items(docs, items)) == want
    assert leakage.leaked_items(docs, items.limit(0)).count() == 0
    assert leakage.leaked_items(docs.limit(0), items).count() == 0


def test_long_passages_and_repetition():
    """Extensions stay short: long items, long documents and one word repeated are searched quickly and exactly."""
    rng = random.Random(9)
    long = [f"v{rng.randrange(4000)}" for _ in range(30_000)]
    edited = [w for i, w in enumerate(long[5_000:25_000]) if i % 11] + ["end"]
    m = leakage.Matcher.build([(1, " ".join(long)), (2, "ha " * 400), (3, " ".join(f"u{i}" for i in range(40)))])
    assert m.search(" ".join(edited)) == [1]
    assert m.search("ha " * 20_000) == [2]
    assert m.search("ha " * 17 + "x") == []
    # two edits after each six words that agree: no passage
    sparse = [w if i % 8 > 1 else f"z{i}" for i, w in enumerate(long[:4_000])]
    assert m.search(" ".join(sparse)) == []


def test_pieces_read_one_by_one():
    rng = random.Random(4)
    pool = "aÉé ﬁ²½Ⅳ\u0301\u00a8\u200b\u3000\u00a0.,*’-_ⅷ中\u0130ΣςЖ\n\t"
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        assert leakage.words(t) == normal.folded(t).translate(leakage._LETTERS).split(), ascii(t)


def test_leaked_items_of_the_table(spark):
    """Every fifth document of the smallest table and all items against the plain dynamic program, which is slow."""
    from splicelake.sources.tables import table

    d = os.environ.get("SPLICELAKE_TESTDATA", "/root/testdata") + "/sf0.001"
    docs = [(r.doc_id, leakage.words(r.text)) for r in table(spark, d, "documents").where("doc_id % 5 = 0").collect()]
    items = [(r.item_id, leakage.words(r.text)) for r in table(spark, d, "eval_items").collect()]
    # a passage keeps ten runs of three words or more
    grams = {k: set(zip(w, w[1:], w[2:])) for k, w in items}
    want = []
    for i, w in docs:
        own = set(zip(w, w[1:], w[2:]))
        want += [(i, k) for k, t in items if len(grams[k] & own) >= 8 and edit_ok(t, w)]
    got = [tuple(r) for r in QUERIES["p8_found"](spark, d).collect() if r.doc_id % 5 == 0]
    assert sorted(got) == sorted(want) and want


# look-alike text ------------------------------------------------------------------------

SAME = [
    ("abc", "ａｂｃ"), ("é", "é"), ("a b", "a b"), ("a b", "a　b"), ("ab", "a​b"), ("ab", "a­b"), ("ab", "﻿ab"), ("Peace", "Реасе"),
    ("o", "ο"), ("ACE", "ᎪᏟᎬ"), ("BTN", "ꓐꓔꓠ"), ("fi", "ﬁ"), ("K", "K"), ("Å", "Å"), ("i", "ⅰ"), ("g", "ɡ"), ("ё", "ë"), ("µ", "μ"), ("ç", "ç"),
]
DIFFERENT = [
    ("a", "A"), ("e", "é"), ("n2", "n²"), ("1", "l"), ("O", "0"), ("a b", "a  b"), ("a b", "ab"), ("a\nb", "a b"), ("a.", "a!"), ("'", "’"), ("a\tb", "a b"), ("rn", "m"), ("½", "1/2"), ("①", "1"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert normal.visible(a) == normal.visible(b) and normal.folded(a) == normal.folded(b)
    assert normal.visible(normal.visible(b)) == normal.visible(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert normal.visible(a) != normal.visible(b)


def test_folded_is_coarser():
    rng = random.Random(3)
    pool = [c for o in [*range(32, 0x600), *range(0x2000, 0x2200), *range(0xFB00, 0xFB10), *range(0xFF00, 0xFFF0)] if unicodedata.category(c := chr(o)) != "Cn"]
    texts = ["".join(rng.choice(pool) for _ in range(3)) for _ in range(3000)]
    by = {}
    for t in texts:
        by.setdefault(normal.visible(t), set()).add(normal.folded(t))
        assert normal.folded(normal.visible(t)) == normal.folded(t)
    assert all(len(x) == 1 for x in by.values())
    assert normal.folded('Ά') == normal.folded('Á')


def test_pairs(spark):
    texts = ["abc", "abc", "ａbc", "abс", "ABC", None, "", " ", "​", " ", "xyz", "abc"]
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS stored", "2 AS seen")
    want = [
        (i, j) for (i, a), (j, b) in itertools.combinations(data, 2)
        if a and b and a != b and normal.visible(a).strip() and normal.visible(a) == normal.visible(b)
    ]
    assert sorted(map(tuple, normal.look_alike_pairs(df).collect())) == want and len(want) == 7
    assert normal.look_alike_pairs(df.limit(0)).count() == 0 and normal.look_alike_members(df.limit(0)).count() == 0
    assert rows(normal.look_alike_members(df)) == [(i, 0, 3, 5) for i in (0, 1, 11, 2, 3)]
    got = {r["doc_id"]: r["text_norm"] for r in normal.consistent_text(df).collect()}
    assert got[2] == got[3] == "abc" and got[5] is None and got[4] == "ABC"
    assert normal.consistent_text(df, case_fold=True).where("doc_id = 4").first()["text_norm"] == "abc"


def test_pairs_and_classes_of_the_table(spark):
    from splicelake.sources.tables import table

    d = os.environ.get("SPLICELAKE_TESTDATA", "/root/testdata") + "/sf0.01"
    by = {}
    for r in table(spark, d, "documents").collect():
        if r.text and normal.visible(r.text).strip():
            by.setdefault(normal.visible(r.text), []).append((r.doc_id, r.text))
    want = sorted((min(a, b), max(a, b)) for g in by.values() for (a, s), (b, t) in itertools.combinations(g, 2) if s != t)
    assert sorted(map(tuple, QUERIES["p9_found"](spark, d).collect())) == want and want
    members = {}
    for g in by.values():
        if len({t for _, t in g}) > 1:
            members.update({i: (min(g)[0], len({t for _, t in g}), len(g)) for i, _ in g})
    assert {r.doc_id: (r.class_id, r.n_texts, r.n_docs) for r in QUERIES["p9_classes"](spark, d).collect()} == members


def test_ids_of_the_table(spark, reference):
    d = os.environ.get("SPLICELAKE_TESTDATA", "/root/testdata") + "/sf0.01"
    got = QUERIES["p7_ids"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert len(got) > 900 and all(r.ids == reference(r.text or "") for r in got)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    d = os.environ.get("SPLICELAKE_TESTDATA", "/root/testdata") + "/sf0.001"
    a = QUERIES[name](spark, d)
    assert a.schema == QUERIES[name](spark, d).schema
    assert a.count() > 0
