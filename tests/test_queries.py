import sys
from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__
from marginalia import registry

from .oracle import from_duckdb, from_spark

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark, request):
    """The rows of every query that is to be tested; most of a small query is planning, so several run at a time."""
    names = [i.callspec.params["name"] for i in request.session.items if i.module is request.module and hasattr(i, "callspec")]
    with ThreadPoolExecutor(4) as pool:
        yield {n: pool.submit(lambda n=n: from_spark(registry.queries()[n](spark, SF))) for n in names}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_oracle(found, name):
    assert found[name].result() == from_duckdb(registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_have_rows(found, name):
    assert found[name].result()[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_works_without_the_llm_folder(monkeypatch):
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "marginalia.llm" or name.startswith("marginalia.llm."):
                raise ModuleNotFoundError(f"No module named {name!r}", name="marginalia.llm")

    for name in [m for m in sys.modules if m.startswith("marginalia.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    assert set(__spark_entry__.queries()) == set(registry.queries())
    assert set(__spark_entry__.oracle_sql()) == set(registry.oracle_sql())
