"""A record with an invalid escape is no JSON: it gives nothing and fails nothing else."""

import pytest

from splicelake.operators.nested import shred


@pytest.mark.parametrize("bad", [r'{"a": "\q"}', r'{"\q": 1}', r'{"a": 1, "b": {"c": "\u12"}}'])
def test_bad_escape(bad):
    assert shred(bad, frozenset()) == []
    assert shred(r'{"a": "\n"}', frozenset()) == [("a", [], "\n")]
