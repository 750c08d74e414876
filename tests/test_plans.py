"""Plans: what is read, what is shuffled, what runs in Python."""

import re

import pytest

from siltstone.plans import catalogue

QUERIES, SQL = catalogue.load()
#: Queries whose operators are kernels or ordered logs; all others stay in the JVM.
PYTHON = {
    "chunk_cdc",
    "commit_stream",
    "fsck_stripes",
    "header_scan",
    "read_record",
    "shard_rebuild",
    "stripe_scan",
    "compress_decide",
    "append_sessions_stream",
    "namespace_outcomes",
    "namespace_replay",
    "segment_pack_greedy",
    "segment_scan",
    "shard_route",
    "stripe_reconstruct",
}
STREAMS = {n for n in QUERIES if n.endswith("_stream")}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_joins_and_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert bool(re.search("Python|Pandas|Arrow", plan)) == (name in PYTHON)


def test_savings_read_two_columns_once(spark, sf_dir):
    df = QUERIES["dedup_savings"](spark, sf_dir)
    df.collect()
    plan = plan_of(df).split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<text:string,source:string>" in plan and "ReusedExchange" in plan


@pytest.mark.parametrize("name", ["segment_pack", "sweep_candidates", "preferred_replica", "delta_truncate", "segment_seal"])
def test_sums_are_not_in_one_partition(spark, sf_dir, name):
    assert "SinglePartition" not in plan_of(QUERIES[name](spark, sf_dir))


def test_payloads_are_hashed_once_where_sums_need_two_levels(spark, sf_dir):
    df = QUERIES["segment_pack"](spark, sf_dir)
    df.collect()
    plan = plan_of(df).split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_filters_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["corruption_top"](spark, sf_dir))
    assert "EqualTo(event_type,error)" in plan and "TakeOrderedAndProject" in plan
