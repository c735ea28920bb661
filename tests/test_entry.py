"""The driver's contract: the entry runs, every query is callable, and twins belong to queries."""

import __spark_entry__


def test_contract(spark):
    queries, twins = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 60 and set(twins) <= set(queries) and all(map(callable, queries.values()))
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_corpus_operators(monkeypatch):
    real = __spark_entry__.importlib.util.find_spec

    def without(name, *a):
        if name.startswith("isopleth.llm."):
            raise ModuleNotFoundError(name)  # as of a module whose package is missing
        return None if name == "isopleth.llm" else real(name, *a)

    monkeypatch.setattr(__spark_entry__.importlib.util, "find_spec", without)
    assert not any(name.startswith("op") or name == "pipeline" for name in __spark_entry__.queries() if name[2:3].isdigit() or name == "pipeline")
    assert "knn_topk" in __spark_entry__.queries()
