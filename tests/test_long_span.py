"""Spans of any number of digits are compared, not refused."""

import pytest

from splicelake.operators.rejects import judge_lines
from splicelake.plans.records import CHAINS


@pytest.mark.parametrize(("span", "want"), [(f"1-{'9' * 5000}", ""), (f"{'9' * 5000}-1", "span"), ("0010-9", "span"), ("9-0010", ""), ("7-07", "")])
def test_long_span(spark, span, want):
    line = f"LOCG.1\tLOCG.1.1\tc\t+\t{span}\texons=1\tintrons=0\t\t"
    assert judge_lines(spark.createDataFrame([(1, line)], "line_id long, raw string"), CHAINS).first()["field"] == want
