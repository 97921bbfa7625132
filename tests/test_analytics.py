"""Money in the analytic queries: unvalidated amounts are summed exactly and rounded once."""

from clickwise.operators import analytics as A


def _events(spark, amounts):
    return spark.createDataFrame([("purchase", a) for a in amounts] + [("view", 7.0)], "event_type string, amount double")


def test_parts_of_a_cent_add_up(spark):
    rows = {r.event_type: r for r in A.event_breakdown(_events(spark, [0.004] * 5 + [10.0])).collect()}
    assert rows["purchase"].event_count == 6 and rows["view"].event_count == 1
    assert rows["purchase"].total_revenue == rows["view"].total_revenue == 10.02


def test_amounts_that_do_not_fit_count_but_add_nothing(spark):
    rows = {r.event_type: r for r in A.event_breakdown(_events(spark, [1e300, float("nan"), float("-inf"), None, 2.5])).collect()}
    assert rows["purchase"].event_count == 5 and rows["purchase"].total_revenue == 2.5
