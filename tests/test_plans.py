"""Plan properties of every registered query: no cartesian or nested-loop
joins, no row-at-a-time Python UDFs, and pruned scans."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as ENTRY
from tests.conftest import SF_SMALL

QUERIES = ENTRY.queries()
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]
# MLlib's recommendForUserSubset multiplies blocks of user factors with blocks of item factors (4,096 a block) by a
# product of the two block tables: the one product these queries may hold
FACTOR_BLOCKS = ["als_recommendations", "als_implicit_recommendations"]


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="simple")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_forbidden_operators(spark, name):
    plan = plan_text(QUERIES[name](spark, SF_SMALL))
    for op in FORBIDDEN:
        if op == "CartesianProduct" and name in FACTOR_BLOCKS:
            continue  # its own test below
        assert op not in plan, f"{name} uses {op}"


@pytest.mark.parametrize("name", FACTOR_BLOCKS)
def test_only_factor_blocks_meet_in_a_product(spark, name):
    lines = plan_text(QUERIES[name](spark, SF_SMALL)).splitlines()
    at = [i for i, line in enumerate(lines) if "CartesianProduct" in line]
    assert len(at) == 1
    depth = lines[at[0]].index("CartesianProduct")
    below = []
    for line in lines[at[0] + 1:]:
        if len(line) - len(line.lstrip(" :+-*()0123456789")) <= depth:
            break
        below.append(line)
    # both sides are the model's own block tables; a product of anything else would lack one of them
    assert sum("MapPartitions org.apache.spark.ml.recommendation.ALSModel" in line for line in below) == 2, below


def test_scans_are_pruned(spark):
    # the trending query reads only the columns it needs from events and part
    plan = plan_text(QUERIES["trending_products"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas
    assert all("text" not in s and "html" not in s for s in schemas)
    events = [s for s in schemas if "props" in s]
    assert events and all("value" not in s for s in events)
