"""What the changelog's queries share: parsed once, not met in one task by a name or a code, tasks cut by size."""

from pyspark.sql import functions as F

from rillhouse.functions import changelog as ch
from rillhouse.operators import facts, routing
from rillhouse.plans import fixtures as fx
from rillhouse.plans import queries
from rillhouse.sources import topics


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_change_is_parsed_once(spark):
    raw = spark.createDataFrame([('{"database":"shop","table":"t","type":"update","ts":1,"data":{"id":"a","s":"2"},"old":{"s":"1"}}',), ("{bad",), (None,), ("{}",)], "value string")
    parsed = ch.pick(ch.transition(topics.parse_changelog(raw), "t", "s", "1", "2"), "id")
    assert plan_of(parsed).count("from_json(") == 1
    assert [tuple(r) for r in parsed.collect()] == [("a", 1)]
    assert topics.parse_log(raw).count() == 4


def test_codes_and_configs_shuffle_no_rows(spark, sf):
    rows = spark.range(10).select(F.lit("1602").alias("code"), "id")
    assert "Exchange hashpartitioning(code" not in plan_of(facts.lookup_join(rows, fx.dic(spark), "code", {"dic_name": "name"}))
    log = spark.createDataFrame([], topics.CHANGELOG)
    config = queries._routes(spark, ("c", None, ("order_info", "ALL", "dim_order", "DIM", "id", "id")))
    plan = plan_of(routing.routed(log, routing.current_config(config, "DIM"), by_op=False))
    assert "Exchange hashpartitioning(table" not in plan and "BroadcastHashJoin" in plan


def test_versions_are_dealt_by_size(spark, sf):
    assert ", 1024)" in plan_of(fx.detail_versions(spark, sf))
    assert ", 1024)" in plan_of(queries.latest_version(spark, sf))
