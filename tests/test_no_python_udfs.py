"""Every registered query plans to JVM-side operators only: no Python UDF,
Pandas UDF or mapInPandas node anywhere in the executed physical plan."""

import pytest

from spanrisk.plans.catalog import load_all
from tests.conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "MapInArrow",
                "FlatMapGroupsInPandas", "AggregateInPandas", "WindowInPandas")
REG = load_all()
NAMES = sorted(n for n, e in REG.items() if e.sql is not None)


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_python_nodes(spark, name):
    plan = REG[name].fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [n for n in PYTHON_NODES if n in plan], name
