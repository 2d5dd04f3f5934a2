"""Records: logs, snapshots, lines with rejects, packed fields, spans, hot keys."""

import datetime as dt
import json
import random

import pytest
from conftest import rows

from splicelake.operators import logs
from splicelake.operators.islands import periods_and_gaps
from splicelake.operators.nested import path_triples, pivot_ancestor, pivot_paths, shred
from splicelake.operators.packed import INTEGERS, NAMES, SPANS, Rule, resolve_rule, split_one, split_packed
from splicelake.operators.rejects import BIG, judge_lines, repair, scan
from splicelake.operators.skew import heavy_keys, per_key_report
from splicelake.plans.records import CHAINS, PARITY

# logs ---------------------------------------------------------------------------


def us(*a):
    return int(dt.datetime(*a, tzinfo=dt.UTC).timestamp()) * 1_000_000


LINES = [
    ("E20260105 08:00:05.534000  78322 isofrac] reads moved: 312", (us(2026, 1, 5, 8, 0, 5) + 534000, "ERROR", "isofrac", "reads moved: 312")),
    ("05.01.2026 10:10:03.000 | WARN | a::b | x | y", (us(2026, 1, 5, 10, 10, 3), "WARN", "a::b", "x | y")),
    ("2026-01-05 11:36:41,007 INFO  [a/b] hi", (us(2026, 1, 5, 11, 36, 41) + 7000, "INFO", "a/b", "hi")),
    ("2026-01-05 11:36:41,000 \x1b[31mFATAL\x1b[0m [c] hi", (us(2026, 1, 5, 11, 36, 41), "FATAL", "c", "hi")),
    ("2026-01-05T10:13:44.897000Z critical x::graph: a: b", (us(2026, 1, 5, 10, 13, 44) + 897000, "FATAL", "x::graph", "a: b")),
    ("2026-01-05T10:13:44+02:00 err x: m", (us(2026, 1, 5, 8, 13, 44), "ERROR", "x", "m")),
    ("[05/Jan/2026:10:26:45 +0100] (q) info: m", (us(2026, 1, 5, 9, 26, 45), "INFO", "q", "m")),
    ("[TRACE_ABUND] t=1", (-1, "", "TRACE_ABUND", "t=1")),
    ("--- f: KEEP n=2", (-1, "", "f", "KEEP n=2")),
    ('ts=2026-01-05T03:03:05.950-05:00 lvl=warning comp=iso msg="say \\"hi\\"  now" dur=3', (us(2026, 1, 5, 8, 3, 5) + 950000, "WARN", "iso", 'say "hi" now')),
    ('{"ts":1767602632308,"ctx":{"level":2,"msg":"no"},"lvl":"I","comp":"p","msg":"a\\n\\tb \\u00e9"}', (1767602632308000, "INFO", "p", "a b é")),
    ("2026-01-05 10:00:00 INFO comp: msg", (us(2026, 1, 5, 10), "INFO", "comp", "msg")),
    ("2026-01-05 10:00:00,250 - a.b - WARNING - msg", (us(2026, 1, 5, 10) + 250000, "WARN", "a.b", "msg")),
    ("Jan  5 10:00:00 host prog[12]: msg", (-1, "", "prog", "msg")),
    ("Feb 29 10:00:00 host prog: msg", (-1, "", "prog", "msg")),
    ("ts=x lvl=info msg=a", (-1, "INFO", "", "a")),
    ('{"message": "m", "time": "2026-01-05T10:53:29.930Z", "component": "z", "level": "trace"}', (us(2026, 1, 5, 10, 53, 29) + 930000, "TRACE", "z", "m")),
]


@pytest.mark.parametrize(("line", "want"), LINES)
def test_layouts(line, want):
    import re

    plain = re.sub("\x1b\\[[0-9;?]*[A-Za-z]", "", line)
    assert logs.is_header(plain)
    assert logs.parse_entry(plain) == want


@pytest.mark.parametrize(
    "line", ["", " [a] x", "exons: 1-2; 3-4", "Caused by: x", "... 3 more", "| 1 | 2 |", "}", "99.99.2026 10:00:00.0 | INFO | x | y", "2026-01-05 11:36:41,000 LOUD [a] b", "t=133 mode=x",
             "{ not json", '{"a": 1}', "{", "[1,2,3]", "ts=x", "[1] x", "Jan 32 10:00:00 h p: m", "Jan  5 10:00:00 h p[x]: m", "Jan  5 10:00:00 h p[12: m"]
)
def test_no_header(line):
    assert not logs.is_header(line)


def test_entries(spark):
    data = [
        ("r", 1, 10, "orphan"),
        ("r", 2, 11, "[A] one"),
        ("r", 4, 13, "  three\r"),
        ("r", 3, 12, None),
        ("r", 4, 99, "  three\r"),
        ("r", 5000, 14, "late  tail"),
        ("r", 5001, 15, 'ts=2026-01-05T08:00:00Z comp=c msg="open'),
        ("r", 5002, 16, 'closed" k=v'),
        ("r", 5003, 17, "more"),
        ("r", None, 18, "[B] nowhere"),
        (None, 1, 19, "[N] null run"),
        ("q", 1, 20, '{"msg": "cut'),
    ]
    df = spark.createDataFrame(data, "run_id string, line_no int, line_id long, raw string").selectExpr("*", "'x' AS level", "1 AS __run")
    assert rows(logs.log_entries(df)) == rows_of(
        [
            ("r", 2, -1, "", "A", "one three late tail"),
            ("r", 5001, us(2026, 1, 5, 8), "", "c", "open closed more"),
            (None, 1, -1, "", "N", "null run"),
            ("q", 1, -1, "", "", "cut"),
        ]
    )
    assert logs.log_entries(df.limit(0)).count() == 0


@pytest.mark.parametrize("base", [1, logs.BLOCK - 2, logs.BLOCK - 1, logs.BLOCK])
def test_lookahead(spark, base):
    """An object over several lines is a header if a known name follows soon, wherever blocks end."""
    texts = ["[A] one", "{", '  "ctx": {', '    "x": 1', "  },", "", '  "msg": "two"', "}", "{", '  "payload": 1', "}", "{ open", '{"x": {', '"msg": "three"', "}}"]
    data = [("r", base + i, i, x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(data, "run_id string, line_no int, line_id long, raw string")
    got = [(r.line_no - base, r.component, r.message) for r in logs.log_entries(df).orderBy("line_no").collect()]
    assert got == [(0, "A", "one"), (1, "", 'two { "payload": 1 } { open'), (12, "", "")]
    kinds = {r.kind: r.n_lines for r in logs.line_kinds(df).collect()}
    assert kinds == {"tag": 1, "object": 2, "continues": 12}


def test_no_lines_at_all(spark):
    df = spark.createDataFrame([], "run_id string, line_no int, line_id long, raw string, __state int, kind string")
    assert logs.log_entries(df).count() == 0 and logs.line_kinds(df).count() == 0
    one = spark.createDataFrame([(None, 5, None, None, 1, "x")], df.schema)
    assert logs.log_entries(one).count() == 0 and [tuple(r) for r in logs.line_kinds(one).collect()] == [("continues", 1)]


def test_unknown_layouts_are_counted(spark):
    lines = ["[A] x", "2026/01/05 10:00:00 something", "2026-01-05 10:00:00 LOUD y", "  2026-01-05 10:00:00 quoted", None]
    df = spark.createDataFrame([("r", i, i, x) for i, x in enumerate(lines)], "run_id string, line_no int, line_id long, raw string")
    assert {r.kind: r.n_lines for r in logs.line_kinds(df).collect()} == {"tag": 1, "unknown time": 2, "continues": 2}


def rows_of(x):
    return sorted(x, key=repr)


def test_long_entry(spark):
    n = 20_000
    df = spark.range(n).selectExpr("'r' AS run_id", "cast(id AS int) AS line_no", "id AS line_id", "if(id = 0, '[A] go', concat('  l', id)) AS raw")
    got = logs.log_entries(df).collect()
    assert len(got) == 1 and got[0]["message"].split() == ["go", *[f"l{i}" for i in range(1, n)]]


# snapshots --------------------------------------------------------------------------


def test_shred():
    arrays = frozenset({"a", "a[].b"})
    rec = json.dumps({"x": 1, "a": [{"b": [5, None, "7"], "c": {"d": "é"}}, None, {"b": 9}]})
    assert shred(rec, arrays) == [
        ("x", [], "1"), ("a[]", [0], None), ("a[].b[]", [0, 0], "5"), ("a[].b[]", [0, 1], None), ("a[].b[]", [0, 2], "7"),
        ("a[].c.d", [0], "é"), ("a[]", [1], None), ("a[]", [2], None), ("a[].b[]", [2, 0], "9"),
    ]
    assert shred('{"a": {"b": []}}', arrays) == [("a[]", [0], None)]
    assert shred('{"a": null}', arrays) == []
    for bad in ('{"a": [1, 2,]}', '{"a": 1,}', '{"a": foo}', '{"a": 01}', '{"a": [1,,2]}', '{,}', '[,1]', '{"a"}', '{"a":}', '"', '{"x": "y}', "1 2", "{}{}", "]"):
        assert shred(bad, arrays) == [], bad
        assert shred(bad, arrays, frozenset({"b"})) == [], bad
    assert shred('{"a": [{"b": 1}, {"b": {"c": 2}}], "d": {"a": 3}}', arrays, frozenset({"a[].b[]"})) == [("a[].b[]", [0, 0], "1"), ("a[].b[]", [1, 0], None)]
    for bad in (None, "", "{", '{"a": [1,}', '{"a": 1} x', "[1", '{"a" 1}', '{"a": [1 2]}', "{'a': 1}"):
        assert shred(bad, arrays) == [], bad
    assert shred('{"a": ["]", "}"]}', arrays) == [("a[]", [0], "]"), ("a[]", [1], "}")]


def test_pivot(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": [1, 2], "k": "u"}, {"k": null}]}', "z"), (2, None, "z"), (3, "{", "z")], "id long, rec string, path string")
    t = path_triples(df, "id", "rec", ["a", "a[].b"])
    assert rows(pivot_ancestor(t, "a[]", ["k"], ["b"])) == [(1, [0], None, "u", 2), (1, [1], None, None, 0)]
    assert rows(pivot_ancestor(t, "a[].b[]")) == [(1, [0, 0], "1"), (1, [0, 1], "2")]


def test_pivot_of_nothing(spark):
    df = spark.createDataFrame([], "id long, rec string, ancestor string, kind int")
    assert pivot_paths(path_triples(df, "id", "rec", ["a"]), ["k"], ["b"]).count() == 0
    odd = spark.createDataFrame([(None, '{"a": [{"k": null}], "": {"": [1]}}', "z", 1), (2, "[]", "z", 1), (3, "7", "z", 1)], df.schema)
    got = rows(pivot_paths(path_triples(odd, "id", "rec", ["a"]), ["k"], ["a"]))
    assert (None, "a[]", [0], None, None, 0) in got and (None, "", [], None, None, 1) in got and (3, "", [], "7", None, 0) in got


def test_pivot_of_all_paths(spark):
    """Ancestors come from the paths; of a key given twice the first counts."""
    rec = '{"t": "top", "a": [{"k": 1, "k": 2, "b": [{"k": "x"}, {}]}, 7], "c": {"d": [{"k": "y"}]}}'
    df = spark.createDataFrame([(1, rec), (1, rec)], "id long, rec string")
    t = path_triples(df.limit(1), "id", "rec", [])
    got = rows(pivot_paths(t, ["k", "t"], ["a", "b", "d"]))
    assert got == rows_of(
        [
            (1, "", [], None, None, "top", 2, 0, 0), (1, "a[]", [0], None, "1", None, 0, 2, 0), (1, "a[]", [1], "7", None, None, 0, 0, 0),
            (1, "a[].b[]", [0, 0], None, "x", None, 0, 0, 0), (1, "a[].b[]", [0, 1], None, None, None, 0, 0, 0), (1, "c.d[]", [0], None, "y", None, 0, 0, 0),
        ]
    )


# rejects -------------------------------------------------------------------------------


def test_scan():
    assert scan('a\t "b""c" \t\td\te"f') == ["a", 'b"c', "", "d", 'e"f']
    assert scan('"x\ty"\t""') == ["x\ty", ""]
    for bad in ('"a', '"a"b\tc', 'a\t"b""', '"a" "b"', '"a "late" b"'):
        assert scan(bad) is None, bad


def test_repair_tells_the_reason():
    assert repair("a\tb", 2) == (0, [])
    assert repair("a\tb\tc", 2) == (1, ["delete 1 delimiter"])
    assert repair("a", 3) == (2, ["insert 2 delimiters"])
    cost, steps = repair('"a\tb', 2)
    assert cost >= BIG and any("quote" in s for s in steps)
    cost, steps = repair('"a"b\tc', 2)
    assert cost >= BIG


def test_scan_and_repair_agree():
    rng = random.Random(3)
    for _ in range(1500):
        s = "".join(rng.choice('ab"\t ') for _ in range(rng.randint(0, 9)))
        v = scan(s)
        cost, _ = repair(s, 2)
        assert (v is None) == (cost >= BIG), s
        if v is not None:
            assert cost == abs(2 - len(v)), s


def test_judge(spark):
    good = ["LOCG.1", "c", "5", "9", "+", "1", "2", "3", "4", "5", "6", "7", "x", ""]

    def line(**kw):
        v = list(good)
        for k, x in kw.items():
            v[PARITY.columns.index(k)] = x
        return "\t".join(v)

    cases = [
        (line(), "", ""), (line(end='" 9 "') + "\r", "", ""), (line(end="4"), "bad_value", "end"), (line(start="x", end="4"), "bad_value", "start"),
        (line(end="4", strand="*"), "bad_value", "end"), (line(gene_id="LOCG."), "bad_value", "gene_id"), (line(end="1" * 19), "bad_value", "end"),
        (line() + "\t", "column_count", ""), (line(divergence_detail='"a\tb\nc"'), "", ""), (line(chrom='"c'), "quoting", ""),
        (line(chrom='"c"x'), "quoting", ""), (line(start="٣"), "bad_value", "start"), ("x", "column_count", ""),
    ]
    skipped = [None, "", "  ", "# c", "gene_id\tx", "\r"]
    data = [(i, c[0]) for i, c in enumerate(cases)] + [(100 + i, s) for i, s in enumerate(skipped)]
    df = spark.createDataFrame(data, "line_id long, raw string").selectExpr("*", "1 AS reason", "2 AS gene_id")
    out = judge_lines(df, PARITY)
    got = {r["line_id"]: (r["reason"], r["field"]) for r in out.select("line_id", "reason", "field").collect()}
    assert got == {i: (c[1], c[2]) for i, c in enumerate(cases)}
    assert judge_lines(df.limit(0), PARITY).count() == 0
    assert all(r["edits"] for r in out.where("reason IN ('quoting', 'column_count')").collect())
    bad = spark.createDataFrame([(1, "LOCG.1\tLOCG.1.1\tc\t+\t9-5\texons=0\tintrons=1\t\t")], "line_id long, raw string")
    assert judge_lines(bad, CHAINS).select("field").first()[0] == "span"


# packed fields -----------------------------------------------------------------------------


def test_split_values(spark):
    fields = [
        "1-2,3-4", '"1-2","3-4"', "[1-2; 3-4]", " '1-2',3-4 ", "1-2,,3-4,", "|1-2+3-4||5-6|", "", None, "-", ".", " ", '"-"', "1-2\t3-4",
    ]
    df = spark.createDataFrame(list(enumerate(fields)), "row_id long, f string").selectExpr("*", "'x' AS val", "1 AS pos")
    got = rows(split_packed(df, "row_id", "f", SPANS))
    assert got == rows_of([(i, k + 1, v) for i, f in enumerate(fields) for k, v in enumerate(split_one(f, SPANS))])
    assert [r for r in got if r[0] == 5] == [(5, 1, "1-2"), (5, 2, "3-4"), (5, 3, "5-6")]
    assert split_packed(df.limit(0), "row_id", "f", SPANS).count() == 0


def test_split_names(spark):
    rng = random.Random(5)
    names = ["L.1", 'L.2 "b"', "L.3; copy 2", "L.4/rev", "L.5, alt", "ref:L.6", "L.7|b", "L.8 (late)", "it's"]
    fields, want = [], []
    for i in range(400):
        vals = [rng.choice(names) for _ in range(rng.randint(0, 6))]
        quoted = []
        for v in vals:
            if any(c in v for c in " ,;|/\"'(") or rng.random() < 0.3:
                quoted.append('"' + v.replace('"', '""') + '"' if '"' in v or "'" in v or rng.random() < 0.6 else f"'{v}'")
            else:
                quoted.append(v)
        text = ""
        for k, q in enumerate(quoted):
            text += (rng.choice([",", ", ", ";", " ; ", "|", " ", ",,", "/"]) if k else "") + q
        fields.append((i, text))
        want += [(i, k + 1, v) for k, v in enumerate(vals)]
    df = spark.createDataFrame(fields, "row_id long, f string")
    assert rows(split_packed(df, "row_id", "f", NAMES)) == rows_of(want)
    for i, f in fields:
        assert split_one(f, NAMES) == [v for j, _, v in want if j == i]


def test_the_rule_splits(spark):
    """Where the place of a delimiter matters, plain matching of values goes wrong."""
    names = ["x'1,y'2", "'x,1',y", '"a ""b"", c";d', 'x"1;2"y', "a,'b;c'd", '"a","b', "'p;q' 'r'"]
    df = spark.createDataFrame(list(enumerate(names)), "row_id long, f string")
    got = {}
    for i, _, v in rows(split_packed(df, "row_id", "f", NAMES)):
        got.setdefault(i, []).append(v)
    assert got == {0: ["x'1", "y'2"], 1: ["x,1", "y"], 2: ['a "b", c', "d"], 3: ['x"1', '2"y'], 4: ["a", "b", "c'd"], 5: ["a", "b"], 6: ["p;q", "r"]}
    spans = [(1, "1-2-3,4-5"), (2, "7-,8-9"), (3, "(1-2)(3-4)"), (4, "x" * 5000 + "1-2")]
    df = spark.createDataFrame(spans, "row_id long, f string")
    assert rows(split_packed(df, "row_id", "f", SPANS)) == [(1, 1, "4-5"), (2, 1, "8-9"), (3, 1, "1-2"), (3, 2, "3-4"), (4, 1, "1-2")]


def test_split_a_long_name(spark):
    name = '"' + 'a ""b"" ' * 30_000 + '"'
    df = spark.createDataFrame([(1, f"x,{name};y"), (2, ",".join(["1"] * 50_000))], "row_id long, f string")
    got = rows(split_packed(df, "row_id", "f", NAMES).where("row_id = 1"))
    assert [r[2] for r in got] == ["x", ('a "b" ' * 30_000).strip(), "y"]
    assert split_packed(df, "row_id", "f", INTEGERS).where("row_id = 2").count() == 50_000


def test_rules():
    rule = resolve_rule("\u0001\u0004[\u0004]\u0004,\u0005, ", SPANS)
    assert rule == Rule(1, 1, ",\\ |,", None)
    assert resolve_rule("\u0004--\u0004\u0004", SPANS) is None


def test_split_without_broadcast(spark, monkeypatch):
    from splicelake.operators import packed

    monkeypatch.setattr(packed, "BROADCAST_SKELETONS", 1)
    df = spark.createDataFrame([(1, "0->1"), (2, "[3, 4]"), (3, "5;6")], "row_id long, f string")
    assert rows(split_packed(df, "row_id", "f", INTEGERS)) == [(1, 1, "0"), (1, 2, "1"), (2, 1, "3"), (2, 2, "4"), (3, 1, "5"), (3, 2, "6")]


# spans --------------------------------------------------------------------------------------


def brute_periods(spans, closed):
    step = 1 if closed else 0
    out, cur = [], None
    for s, e in sorted((s, e) for s, e in spans if s is not None and e is not None and (s <= e if closed else s < e)):
        if cur and s - step <= cur[1]:
            cur[1] = max(cur[1], e)
        else:
            if cur:
                out.append(("period", *cur))
                out.append(("gap", cur[1] + step, s - step))
            cur = [s, e]
    return [*out, ("period", *cur)] if cur else out


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("bits", [2, 16])
def test_periods(spark, closed, bits):
    rng = random.Random(bits)
    data = []
    for k in ("a", "b", None):
        for _ in range(120):
            s = rng.choice([None, rng.randint(-300, 900)])
            e = None if s is None or rng.random() < 0.05 else s + rng.choice([-3, 0, 1, 2, 9, 60])
            data.append((k, s, e))
    df = spark.createDataFrame(data + data[:40], "k string, start long, end long").selectExpr("*", "1 AS kind", "2 AS p_start")
    got = rows(periods_and_gaps(df, ["k"], closed=closed, bin_bits=bits))
    want = [(k, *p) for k in ("a", "b", None) for p in brute_periods([(s, e) for q, s, e in data if q == k], closed)]
    assert got == rows_of(want)
    assert periods_and_gaps(df.limit(0), ["k"]).count() == 0


# hot keys ------------------------------------------------------------------------------------


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_per_key(spark, share):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 8 + ["b", "c", None]), rng.choice([None, *range(30)]), rng.choice([None, 1, 5])) for _ in range(3000)]
    df = spark.createDataFrame(data, "k string, t long, x long").selectExpr("*", "0 AS total")
    want = []
    for k in ("hot", "b", "c"):
        own = [r for r in data if r[0] == k]
        want.append((k, len(own), len({r[1] for r in own} - {None}), sum(r[2] or 0 for r in own)))
    assert rows(per_key_report(df, "k", "t", F.col("x"), share=share, salts=4)) == rows_of(want)
    assert per_key_report(df.limit(0), "k", "t", F.col("x")).count() == 0
    assert "hot" in {r[0] for r in heavy_keys(df, "k", 0.2).collect()}
    assert heavy_keys(df, "k", 0.02, sample_rows=100).count() <= 50
