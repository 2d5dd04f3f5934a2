"""Every query with an SQL oracle gives the oracle's rows; the others run with a stable schema."""

import oracle
import pytest

import __spark_entry__ as entry
from splicelake.plans import alignments, audits, bundles, loci, records, structures

MODULES = (records, loci, alignments, structures, bundles, audits)
PAIRS = [(m, n) for m in MODULES for n in m.ORACLES]
ALONE = [(m, n) for m in MODULES for n in m.QUERIES if n not in m.ORACLES]


@pytest.fixture(scope="module")
def con(tiny):
    return oracle.connect(tiny)


def no_cartesian_product(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize(("module", "name"), PAIRS, ids=[n for _, n in PAIRS])
def test_same_as_sql(spark, tiny, con, module, name):
    df = module.QUERIES[name](spark, tiny)
    no_cartesian_product(df)
    n, extra, missing = oracle.compare(df, con, module.ORACLES[name])
    assert not extra and not missing, (n, extra, missing)


@pytest.mark.parametrize(("module", "name"), ALONE, ids=[n for _, n in ALONE])
def test_runs(spark, tiny, module, name):
    a, b = module.QUERIES[name](spark, tiny), module.QUERIES[name](spark, tiny)
    no_cartesian_product(a)
    assert a.schema == b.schema
    assert oracle.bag(a.columns, a.collect()) == oracle.bag(b.columns, b.collect())


def test_all_modules_are_tested():
    names = {n for m in MODULES for n in m.QUERIES}
    assert names <= set(entry.queries()) and not set(entry.oracle_sql()) - set(entry.queries())
