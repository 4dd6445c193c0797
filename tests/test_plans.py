"""Plans: filters and columns reach the scan, nothing runs in Python that need not, top-k is no full sort."""

import re

import pytest

from corpusloom.queries import all_queries
from corpusloom.queries.common import active
from tests.oracle import DATA

SMALL = f"{DATA}/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_brain_filter_reaches_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(brain_id,default\)", plan(active(spark, SMALL, brain_id="default")))


def test_only_needed_columns_are_read(spark):
    p = plan(all_queries()["link_degrees"](spark, SMALL))
    assert all(set(re.findall(r"(\w+):", s)) <= {"from_path", "to_ref", "source"} for s in re.findall(r"ReadSchema: struct<([^>]*)>", p))
    p = plan(all_queries()["token_estimates"](spark, SMALL))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", p) == ["text:string,source:string"]


@pytest.mark.parametrize("name", ["kw_search_all", "vector_maxpool", "hotness", "chunk_text", "trend", "outcome_fold", "unique_links", "sync_plan", "exact_copies", "hash_embedding"])
def test_no_python_in_the_plan(spark, name):
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan(all_queries()[name](spark, SMALL)))


def test_top_k(spark):
    assert "TakeOrderedAndProject" in plan(all_queries()["event_list"](spark, SMALL))

