"""Lines with rejects: the least cost."""

import random

from splicelake.operators.rejects import BIG, Layout, judge_lines, repair, scan


def test_repair_is_least():
    assert repair('a\t"x\ty', 2) == (BIG, ["insert quote at 6"])
    assert repair('a\t"x\ty', 3)[0] == BIG
    assert repair('"x\ty\tz', 2) == (BIG, ["insert quote at 4"])


def _brute(line: str, columns: int) -> int:
    """Least cost by trying all strings with one quote more or fewer, then two, and so on."""
    seen, level, k = {line}, {line}, 0
    while True:
        counts = [len(v) for v in map(scan, level) if v is not None]
        if counts:
            return k * BIG + min(abs(columns - n) for n in counts)
        nearby = {s[:i] + '"' + s[i:] for s in level for i in range(len(s) + 1)}
        nearby |= {s[:i] + s[i + 1 :] for s in level for i, c in enumerate(s) if c == '"'}
        level, k = nearby - seen, k + 1
        seen |= level


def test_repair_against_brute_force():
    rng = random.Random(11)
    for _ in range(600):
        s = "".join(rng.choice('a""\t\t ') for _ in range(rng.randint(0, 8)))
        for columns in (1, 2, 3):
            cost, steps = repair(s, columns)
            assert cost == _brute(s, columns), (s, columns, steps)
            assert bool(steps) == (cost > 0)
            assert any("quote" in x for x in steps) == (cost >= BIG)


def test_repair_of_a_long_line():
    line = "\t".join(['"x', *["y" * 50] * 20_000])
    cost, steps = repair(line, 9)
    assert cost == BIG and steps == [f"insert quote at {2 + 51 * 19_992}"]


def test_the_edits_decide(spark):
    """Reason and edits come from the dynamic program."""
    df = spark.createDataFrame([(1, 'a\t"b'), (2, "a\tb\tc"), (3, '"a"\tb'), (4, "a\tb")], "line_id long, raw string")
    out = judge_lines(df, Layout(columns=("x", "y")))
    got = {r.line_id: (r.reason, r.edits, r.x, r.y) for r in out.collect()}
    assert got == {
        1: ("quoting", "insert quote at 4", None, None),
        2: ("column_count", "delete 1 delimiter", None, None),
        3: ("", "", "a", "b"),
        4: ("", "", "a", "b"),
    }
