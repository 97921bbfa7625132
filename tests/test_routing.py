"""Routing does not bring events together by their few sources."""

import pytest

from clickwise.operators import orders as OP

RULES = [("a", "shop.web", None, ["Placed", "Placed"]), ("b", None, "shop.", ["Placed", "Shipped"]), ("c", "shop.web", "shop", ["Shipped"]), ("d", "x", None, ["Placed"])]


@pytest.mark.parametrize("broadcast", [100, 0])
def test_events_are_not_brought_together_by_source(spark, monkeypatch, broadcast):
    monkeypatch.setattr(OP, "BROADCAST_RULES", broadcast)
    monkeypatch.setattr(OP, "RULE_WAYS", 3)
    events = spark.createDataFrame([("1", "shop.web", "Placed"), ("1", "shop.web", "Placed"), ("2", "shop.app", "Shipped"), (None, "shop.web", "Shipped"),
                                    ("4", None, "Placed"), ("5", "sh", "Placed"), ("6", "x", None)], "event_id string, source string, detail_type string")
    rules = spark.createDataFrame(RULES, "target string, source_exact string, source_prefix string, detail_types array<string>")
    routed = OP.route_events(events, rules)
    assert sorted((str(r.event_id), r.target) for r in routed.collect()) == sorted(
        [("1", "a"), ("1", "a"), ("1", "b"), ("1", "b"), ("2", "b"), ("2", "c"), ("None", "b"), ("None", "c")])
    plan = routed._jdf.queryExecution().toString()
    assert "rightHint=(strategy=broadcast)" in plan if broadcast else "_way" in plan
