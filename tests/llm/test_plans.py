"""What the plans of the training-data queries must look like."""

import pytest

from tidemark.llm.queries import llm_queries

SF_DIR = "/root/testdata/sf0.001"
#: Operators whose main path is DataFrame functions alone.
NATIVE = {"op6_decontaminate", "op8_mixing"}


@pytest.mark.parametrize("name", sorted(llm_queries()))
def test_no_cross_join_no_single_task(spark, name):
    text = llm_queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "NestedLoop", "SinglePartition"):
        assert unwanted not in text
    if name in NATIVE:
        for unwanted in ("Python", "InArrow", "InPandas"):
            assert unwanted not in text
