"""The raw changes are made in one pass, whatever the number of kinds."""

from rillhouse.plans import fixtures as fx


def test_one_pass_over_lines_and_orders(spark, sf):
    plan = fx.changelog(spark, sf, *fx.KINDS)._jdf.queryExecution().optimizedPlan().toString()
    # one scan for the lines and one, joined to them, for their orders; one for the orders' own changes
    assert plan.count("l_linenumber#") > 0 and plan.count("Relation [l_orderkey") == 1 and plan.count("Relation [o_orderkey") == 2
