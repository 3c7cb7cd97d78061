import re

import pytest

import __spark_entry__ as entry
import compare
from conftest import SF_SMALL

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, name):
    if name in ORACLES:
        assert compare.difference(spark, SF_SMALL, name, QUERIES[name], ORACLES[name]) is None
    else:
        assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns[:2] == ["type", "n"] and frame.count() > 0


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """Detection is done once, row-local work does not shuffle, scans read what is needed."""
    from veilframe.operators.validate import gate
    from veilframe.plans import flows
    from veilframe.plans.tables import table

    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    once = plan(flows.anonymise_only(docs, types=["EMAIL"])).count("regexp_replace")
    passed, _ = gate(flows.anonymise_only(docs, types=["EMAIL"]))
    whole = plan(passed)
    assert whole.count("regexp_replace") == once
    assert "Exchange" not in whole and "ArrowEvalPython" not in whole
    schema = re.search(r"ReadSchema: struct<([^>]*)>", whole)[1]
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["doc_id", "text"]
