"""Every registered core query against its SQL, and what is registered."""

import pytest

import __spark_entry__ as entry
from halyard.plans import catalog
from tests.conftest import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(name, spark, duck, small):
    same(catalog.QUERIES[name](spark, small), duck.sql(catalog.ORACLES[name]))


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(catalog.QUERIES) <= set(q) and catalog.FLAGSHIP in q


def test_without_llm(monkeypatch):
    """The core stands alone where the other subpackage isn't there."""
    import sys

    for name in [m for m in sys.modules if m.startswith("halyard.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "halyard.llm", None)
    import halyard

    monkeypatch.delattr(halyard, "llm", raising=False)
    with pytest.raises(ImportError):
        import halyard.llm  # noqa: F401
    try:
        assert set(entry.queries()) == set(catalog.QUERIES)
    except ModuleNotFoundError as e:
        raise AssertionError(e) from None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
