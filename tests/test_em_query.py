"""The weights of ``em_weights`` are settled; three rounds of the operator are those of SQL that unrolls three."""

import math
from collections import defaultdict

import oracle
from pyspark.sql import functions as F

from splicelake.operators import families as FA
from splicelake.plans import lifts, loci, loci_sql


def _placed(spark, d):
    return lifts.placements(lifts.reads(spark, d)).withColumnRenamed("locus", "copy")


def _settle(fit: dict, settled: float = 1e-3, floor: float = 0.01, rounds: int = 20) -> tuple[dict, int]:
    """The iteration in plain Python: weights by (read, copy), and the rounds used."""
    per = defaultdict(list)
    for read, copy in fit:
        per[read].append(copy)
    w = {(r, c): 1 / len(cs) for r, cs in per.items() for c in cs}
    for k in range(1, rounds + 1):
        mass = defaultdict(float)
        for (_, c), x in w.items():
            mass[c] += x
        score = {(r, c): (fit[r, c] + floor) * math.sqrt(mass[c]) for r, c in w}
        new = {(r, c): score[r, c] / sum(score[r, x] for x in per[r]) for r, c in w}
        delta = max(abs(new[p] - w[p]) for p in w)
        w = new
        if delta < settled:
            break
    return w, k


def test_weights_are_settled(spark, tiny):
    # sf0.01: in sf0.001 three rounds may do
    d = tiny.replace("sf0.001", "sf0.01")
    fit = {(r.read, r.copy): r.fit for r in _placed(spark, d).groupBy("read", "copy").agg(F.max("compat").alias("fit")).collect()}
    want, used = _settle(fit)
    assert 3 < used < 20
    got = {(r.read, r.copy): r.weight for r in loci.em_weights(spark, d).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[p] - want[p]) for p in want) < 2e-5


def test_three_rounds_same_as_sql(spark, tiny):
    x, used, _ = FA.em_reweight(_placed(spark, tiny), rounds=3, settled=0.0)
    assert used == 3
    x = x.select("read", "copy", F.round("weight", 5).alias("weight"))
    n, extra, missing = oracle.compare(x, oracle.connect(tiny), loci_sql.EM_THREE)
    assert not extra and not missing, (n, extra, missing)
