"""Zone writers, schema catalog, sinks, customer index and deduplication through a restart."""

import datetime as dt
import glob
import json
import os

from pyspark.sql import functions as F

from clickwise.operators import orders as OP
from clickwise.sources import events_io as IO
from clickwise.sources import schema_catalog as SC
from clickwise.sources import zone_writer as ZW
from clickwise.streaming import runners as RN
from stream_help import feed, replay_last, table

SCHEMA = "k long, body string, ts timestamp_ntz"


def hours(n_hot):
    hot, cold = dt.datetime(2034, 2, 3, 4), dt.datetime(2034, 2, 3, 9)
    return [(i, "x" * 400, hot + dt.timedelta(seconds=i % 3000)) for i in range(n_hot)] + [(-i, "y", cold) for i in range(1, 20)]


def files(path):
    return [f for f in glob.glob(f"{path}/**/part-*", recursive=True) if not f.endswith(".crc")]


def test_hot_hours_are_split_by_bytes(spark, tmp_dir):
    df = spark.createDataFrame(hours(3000), SCHEMA).repartition(7)
    df = IO.with_partitions(df, F.col("ts"))
    total = df.where("hour = '04'").select(F.sum(ZW.json_bytes(df))).first()[0]
    ZW.write_balanced(df, f"{tmp_dir}/zone", IO.PARTITION_COLS, "json", target_bytes=200_000)
    by_hour = {h: [os.path.getsize(f) for f in files(f"{tmp_dir}/zone") if f"hour={h}/" in f] for h in ("04", "09")}
    assert len(by_hour["04"]) == -(-total // 200_000) and len(by_hour["09"]) == 1
    assert max(by_hour["04"]) < 1.3 * 200_000 and min(by_hour["04"]) > 0.7 * total / len(by_hour["04"])
    assert table(spark.read.schema("k long, body string, ts timestamp_ntz, hour string").json(f"{tmp_dir}/zone").select("k", "body", "ts", "hour")) == table(df.select("k", "body", "ts", "hour"))


def test_raw_zone_stream_with_a_replay(spark, tmp_dir):
    rows = hours(400)
    stream = feed(spark, f"{tmp_dir}/in", [rows[:250], rows[250:]], SCHEMA)
    for _ in range(2):
        IO.write_raw(stream, f"{tmp_dir}/raw", event_ts_col="ts", checkpoint=f"{tmp_dir}/ck", trigger={"availableNow": True}, target_bytes=50_000).awaitTermination(200)
        replay_last(f"{tmp_dir}/ck")
    back = IO.read_raw(spark, f"{tmp_dir}/raw", "k long, body string, ts timestamp_ntz, year string, month string, day string, hour string")
    assert table(back.select("k", "body", "ts")) == table(spark.createDataFrame(rows, SCHEMA))
    assert all(f.endswith(".json.gz") for f in files(f"{tmp_dir}/raw"))
    assert {r.hour for r in back.where("hour = '04'").select("hour").distinct().collect()} == {"04"}


def test_processed_zone_batch_and_stream(spark, tmp_dir):
    rows = [(f"e{i}", f"year=2034/month=01/day={1 + i % 3:02d}", i) for i in range(60)]
    schema = "event string, s3_partition string, n int"
    IO.write_processed(spark.createDataFrame(rows, schema), f"{tmp_dir}/a")
    stream = feed(spark, f"{tmp_dir}/in", [rows[:20], rows[20:]], schema)
    IO.write_processed(stream, f"{tmp_dir}/b", checkpoint=f"{tmp_dir}/ck", trigger={"availableNow": True}).awaitTermination(200)
    for zone in "ab":
        back = spark.read.parquet(f"{tmp_dir}/{zone}")
        assert table(back.select("event", "n", "day")) == sorted((f"e{i}", str(i), f"{1 + i % 3:02d}") for i in range(60))


def test_other_sinks_round_trip(spark, tmp_dir):
    errors = spark.createDataFrame([("r1", "format-conversion-failed"), ("r2", "processing-failed")], "raw string, result string")
    IO.write_errors(errors, f"{tmp_dir}/errors")
    assert table(spark.read.json(f"{tmp_dir}/errors").select("raw", "result")) == table(errors)
    dead = spark.createDataFrame([("a", "2034-05-06T07:08:09.000000+00:00", "k")], "failure_reason string, failed_at string, s3_key string")
    IO.write_dlq(dead, f"{tmp_dir}/dlq")
    r = spark.read.json(f"{tmp_dir}/dlq").first()
    assert (r.year, r.month, r.day, r.hour, r.s3_key) == ("2034", "05", "06", "07", "k")
    IO.write_result(errors, f"{tmp_dir}/result")
    IO.write_result(errors.limit(1), f"{tmp_dir}/result")
    assert spark.read.parquet(f"{tmp_dir}/result").count() == 1
    users = spark.range(1000).select((F.col("id") % 37).cast("string").alias("user_id"))
    spread = IO.distribute_by_user(users, 5).withColumn("p", F.spark_partition_id()).groupBy("user_id").agg(F.count_distinct("p").alias("n"))
    assert {r.n for r in spread.collect()} == {1}


def zone(path, name, rows):
    os.makedirs(f"{path}/{name}", exist_ok=True)
    with open(f"{path}/{name}/part.json", "w") as fh:
        fh.writelines(json.dumps(r) + "\n" for r in rows)


def test_catalog_over_three_crawls(spark, tmp_dir):
    crawls = [
        [{"a": 1, "b": "x", "c": {"d": None}}],
        [{"a": 1.5, "c": {"d": True, "e": [1, {"f": 2}]}}, {"a": 2}],
        [{"a": "text", "b": 2, "c": 3}],
    ]
    catalog, seen = None, []
    for n, rows in enumerate(crawls):
        zone(f"{tmp_dir}/{n}", "data/year=2034", rows)
        zone(f"{tmp_dir}/{n}", "data/errors/day=01", [{"broken": 1}])
        zone(f"{tmp_dir}/{n}", "data/_temporary/0", [{"unfinished": 1}])
        catalog, changes = IO.discover_schema(spark, f"{tmp_dir}/{n}/data", catalog, n)
        seen.append({r.path: (r.change, r.new_type) for r in changes.collect()})
        catalog = catalog.checkpoint()
    assert seen[0] == {"a": ("added", "BIGINT"), "b": ("added", "STRING"), "c": ("added", "OBJECT"), "c.d": ("added", "VOID")}
    assert seen[1] == {"a": ("updated", "DOUBLE"), "b": ("deprecated", None), "c": ("unchanged", "OBJECT"), "c.d": ("updated", "BOOLEAN"),
                       "c.e": ("added", "ARRAY"), "c.e[]": ("added", "VARIANT"), "c.e[].f": ("added", "BIGINT")}
    assert seen[2]["a"] == ("updated", "STRING") and seen[2]["b"] == ("returned", "BIGINT") and seen[2]["c"] == ("updated", "BIGINT")
    rows = {r.path: r for r in catalog.collect()}
    assert (rows["c.d"].status, rows["c.d"].type, rows["c.d"].last_crawl) == ("deprecated", "BOOLEAN", 1)
    assert (rows["b"].status, rows["b"].first_crawl, rows["b"].last_crawl) == ("active", 0, 2)


def test_summaries_merge_in_any_order(spark):
    texts = ['{"a":1,"b":{"c":"x"}}', '{"a":2.5}', '{"a":null,"b":7}', "[1]", "broken", None, '{"d":[]}']
    frame = lambda t: spark.createDataFrame([(x,) for x in t], "value string")
    whole = SC.schema_summary(frame(texts))
    parts = [SC.schema_summary(frame(texts[k:k + 2])) for k in range(0, len(texts), 2)]
    for merged in (SC.merge_summaries(*parts), SC.merge_summaries(parts[3], SC.merge_summaries(parts[2], parts[0]), parts[1])):
        assert table(merged, "path", "kinds", "n") == table(whole, "path", "kinds", "n")


def test_customer_index_reads_one_bucket(spark, tmp_dir, capsys):
    rows = [(f"o{i}", f"2034-{1 + i % 12:02d}-01", f"c{i % 50}") for i in range(2000)]
    orders = spark.createDataFrame(rows, "orderId string, createdAt string, customerId string")
    spark.sql("DROP TABLE IF EXISTS orders_by_customer")
    # The planner reads the same bucket without this, but then does not name it in the plan.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        OP.write_customer_index(orders, "orders_by_customer", 8)
        found = OP.customer_orders(spark.table("orders_by_customer"), "2034-03-01", "2034-06-30", "c7")
        want = OP.customer_orders(orders, "2034-03-01", "2034-06-30", "c7")
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in want.collect()] and found.count() > 0
        capsys.readouterr()
        found.explain("formatted")
        plan = capsys.readouterr().out
        assert "SelectedBucketsCount: 1 out of 8" in plan and "GreaterThanOrEqual(createdAt,2034-03-01)" in plan and "EqualTo(customerId,c7)" in plan
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.sql("DROP TABLE IF EXISTS orders_by_customer")


def test_dedupe_through_a_restart(spark, tmp_dir):
    at = lambda m: dt.datetime(2034, 1, 1) + dt.timedelta(minutes=m)
    schema = "event_hash string, event_ts timestamp_ntz, n int"
    first = [("a", at(0), 1), ("a", at(0), 2), ("b", at(1), 3)]
    feed(spark, f"{tmp_dir}/in", [first], schema)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/in").withColumn("event_ts", F.col("event_ts").cast("timestamp"))
        RN.start_dedupe_stream(stream, f"{tmp_dir}/out", f"{tmp_dir}/ck", watermark="10 minutes", test=True).awaitTermination(200)
    run()
    # After the stop: a repeat inside the watermark, a new event that moves it on, then a repeat too late to matter.
    later = [[("b", at(2), 4), ("c", at(60), 5)], [("a", at(0), 6), ("c", at(61), 7), ("d", at(62), 8)]]
    for k, rows in enumerate(later):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_dir}/more{k}")
        (src,) = glob.glob(f"{tmp_dir}/more{k}/part-*.parquet")
        os.utime(src, (1_700_001_000 + k, 1_700_001_000 + k))
        os.rename(src, f"{tmp_dir}/in/later-{k}.parquet")
    run()
    got = spark.read.parquet(f"{tmp_dir}/out").collect()
    assert sorted(r.event_hash for r in got) == ["a", "b", "c", "d"]
