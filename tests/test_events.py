"""Event validation, redaction, enrichment and dead letters on records of our own."""

import base64
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from clickwise.functions import redaction as R
from clickwise.functions.payload import decode_payload
from clickwise.functions.validation import EVENT_REGISTRY, is_iso_timestamp
from clickwise.operators import events as EV

STAMP = "2033-07-04T05:06:07Z"
FULL = {
    "page_view": {"user_id": "zoe", "page_url": "/garden", "timestamp": STAMP},
    "purchase": {"user_id": "yan", "product_id": "kettle", "amount": 12, "currency": "SEK", "timestamp": STAMP},
    "search": {"user_id": "xia", "query": "blue lamp", "timestamp": STAMP},
    "error": {"error_code": 17, "message": "disk", "timestamp": STAMP},
}


def event(kind, **changes):
    e = {"event_type": kind, **(FULL.get(kind, {}) if isinstance(kind, str) else {}), **changes}
    return {k: v for k, v in e.items() if v is not ...}


def reasons(spark, events):
    rows = [(i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)]
    out = EV.validate_events(spark.createDataFrame(rows, "id long, payload string"), payload_col="payload")
    return [r.failure_reason for r in out.orderBy("id").collect()]


def test_each_required_key_is_missed_in_turn(spark):
    cases = [(kind, key) for kind, keys in EVENT_REGISTRY.items() for key in keys]
    assert reasons(spark, [event(kind) for kind in FULL]) == [None] * 4
    assert reasons(spark, [event(kind, **{key: ...}) for kind, key in cases]) == [f"Missing required field: {key}" for _, key in cases]
    # Of several the first of the list is named.
    assert reasons(spark, [{"event_type": k} for k in FULL]) == [f"Missing required field: {EVENT_REGISTRY[k][0]}" for k in FULL]


def test_event_types_of_any_json_kind(spark):
    shown = {"refund": "refund", 7: "7", True: "True", False: "False"}
    assert reasons(spark, [event(t) for t in shown]) == [f"Unknown event type: {s}" for s in shown.values()]
    assert reasons(spark, [event(None), {}]) == ["Unknown event type: None"] * 2
    assert reasons(spark, [event(["error"]), event({}), event([])]) == [EV.ERR_TYPE] * 3


def test_amounts(spark):
    good = [0, 3, 2.5, 1e3, None, True]
    assert reasons(spark, [event("purchase", amount=a) for a in good]) == [None] * len(good)
    bad = {-1: "-1", "12": "12", -0.25: "-0.25"}
    assert reasons(spark, [event("purchase", amount=a) for a in bad]) == [f"Invalid amount: {s}" for s in bad.values()]
    assert reasons(spark, [event("search", amount=-5)]) == [None]


def test_timestamps_as_python_reads_them(spark):
    base = datetime(2033, 7, 4, 5, 6, 7, 89_000)
    forms = [base.isoformat(), base.isoformat(" "), base.date().isoformat(), base.isoformat(timespec="minutes"), base.strftime("%Y%m%dT%H%M%S"),
             base.replace(tzinfo=timezone(timedelta(hours=-3, minutes=-30))).isoformat(), base.isoformat("\n"), STAMP, "0001-01-01",
             # not accepted
             STAMP + "\n", "0000-01-01", "2033-02-29", "2033-13-01", "04.07.2033", "2033-07-04T25:00", "2033-07-04T05:06:07+", "soon"]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, t string")
    got = [r.ok for r in df.select("i", is_iso_timestamp(F.col("t")).alias("ok")).orderBy("i").collect()]

    def python_reads(text):
        try:
            return bool(datetime.fromisoformat(text.replace("Z", "+00:00")))
        except ValueError:
            return False
    assert got == [python_reads(f) for f in forms] == [True] * 9 + [False] * 8


@pytest.mark.parametrize("data", ["", "!!", "eyJ!hIjoxfQ==", "eyJhIjoxfQ", "eyJhIjoxfQ==tail", "e yJh\nIjoxfQ=\t=", "4pyT", "/w==", "QQ=", "Q", "QUI=QUI=", "QUJD"])
def test_base64_as_python_reads_it(spark, data):
    try:
        want = base64.b64decode(data).decode("utf-8")
    except ValueError:
        want = None
    assert spark.createDataFrame([(data,)], "data string").select(decode_payload("data").alias("x")).first().x == want


def test_redaction(spark):
    cases = {
        "write to jo.lee-2@mail.test.org, please": "write to [REDACTED_EMAIL], please",
        "ünï@exämple.com": "[REDACTED_EMAIL]",
        "pay 4444-3333 2222-1111 now": "pay [REDACTED_CARD] now",
        "order 44443333222211110 is too long": "order 44443333222211110 is too long",
        "no at sign, 123 only": "no at sign, 123 only",
        "": "",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    for r in df.select("t", "want", R.redact("t").alias("x"), R.count_emails("t").alias("e"), R.count_cards("t").alias("c")).collect():
        assert r.x == r.want and (r.e, r.c) == (r.want.count(R.EMAIL_TOKEN), r.want.count(R.CARD_TOKEN))
    assert spark.createDataFrame([(None,)], "t string").select(R.redact("t").alias("x"), R.count_cards("t").alias("c")).first() == (None, None)


def records(spark, payloads):
    rows = [(i, base64.b64encode(p.encode()).decode()) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "record_id long, data string")


def test_enriched_and_dead(spark):
    payloads = [json.dumps(event("page_view", device_type="My MOBILE thing")),
                json.dumps(event("search", query="ask kim@shop.test", timestamp="2033-12-31T23:59:00-08:00")),
                "<xml/>", json.dumps(event("error", timestamp=...)), json.dumps(event("error", timestamp="")), json.dumps([1])]
    df = records(spark, payloads)
    both = EV.process_events(df, as_of="2033-08-01 02:00:00", keep=["record_id"])
    alone = EV.processed_events(df, as_of="2033-08-01 02:00:00"), EV.failed_events(df, as_of="2033-08-01 02:00:00")
    for a, b in zip(both, alone):
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    ok = {r.record_id: r for r in both[0].collect()}
    assert ok[0].s3_partition == "year=2033/month=07/day=04" and ok[0].device_category == "mobile"
    assert ok[1].s3_key == f"2033/12/31/23/{ok[1].event_hash}.json" and ok[1].device_category == "desktop"
    assert json.loads(ok[1].event)["query"] == "ask [REDACTED_EMAIL]" and ok[1].processed_at == "2033-08-01T02:00:00.000000+00:00"
    bad = {r.record_id: r for r in both[1].collect()}
    assert {k: r.failure_reason for k, r in bad.items()} == {
        2: EV.ERR_JSON, 3: "Missing required field: timestamp", 4: EV.ERR_TIMESTAMP, 5: EV.ERR_NOT_OBJECT}
    assert json.loads(bad[2].original_event) == {"raw": "<xml/>"} and bad[2].retry_count == 0
    assert all(r.s3_key.startswith("failed-events/2033/08/01/02/") for r in bad.values())


def test_fingerprint_ignores_key_order(spark):
    e = event("search")
    ok = EV.processed_events(records(spark, [json.dumps(e), json.dumps(dict(reversed([*e.items()]))), json.dumps(event("search", query="other"))]))
    hashes = [r.event_hash for r in ok.orderBy("record_id").collect()]
    assert hashes[0] == hashes[1] != hashes[2] and len(hashes[0]) == 16


def test_batch_summary(spark):
    payloads = [json.dumps(event("error")) if i % 3 else "-" for i in range(24)]
    outcomes = EV.validate_events(records(spark, payloads)).select("record_id", F.col("failure_reason").isNull().alias("ok"))
    r = EV.summarize_batch(outcomes, "record_id").first()
    assert (r.processed_count, r.failed_count) == (16, 8)
    assert r.processed_sample == [str(i) for i in range(24) if i % 3][:10] and r.failed_sample == [str(i) for i in range(0, 15, 3)]
