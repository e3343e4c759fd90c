"""How often a plan spells out what is dear: deriving runs, quoting and parsing their texts."""

import re

import pytest

from paperlane.plans import catalog


def spelled(spark, sf_dir, name, what):
    return len(re.findall(what, catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()))


@pytest.mark.parametrize("name, quoted", [("json_sse_tokens", 1), ("json_sse", 1), ("json_all_parts", 2), ("json_stream_merge", 2), ("json_first_part", 2), ("json_last_part", 1), ("json_chat", 1)])
def test_a_reply_is_made_once(spark, sf_dir, name, quoted):
    assert spelled(spark, sf_dir, name, "StructsToJsonEvaluator") <= quoted
    assert not spelled(spark, sf_dir, name, "Join ")


def test_consistency_collects_no_runs(spark, sf_dir):
    assert not spelled(spark, sf_dir, "agg_consistency", "collect_list")


def test_exported_rows_are_scored_once(spark, sf_dir):
    assert spelled(spark, sf_dir, "prj_export_rows", "JsonToStructs") == spelled(spark, sf_dir, "eval_bundle", "JsonToStructs")
