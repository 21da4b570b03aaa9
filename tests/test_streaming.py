"""Attempt limits in batch and stream form, and the streaming flows."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import latest, orders
from tidemark.streaming import attempts, flows

START = datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp_ntz, event_id bigint, success boolean"


def brute(events, window=900, limit=5):
    out, state = {}, {}
    for key, ts, eid, ok in sorted(events, key=lambda e: (e[1], e[2])):
        start, n = state.get(key, (None, 0))
        if start is None or (ts - start).total_seconds() >= window:
            start, n = ts, 0
        n += 1
        out[eid] = (n, n > limit)
        state[key] = (None, 0) if ok and n <= limit else (start, n)
    return out


def make(n, keys, span, seed):
    rng = random.Random(seed)
    return [(rng.choice(keys), START + timedelta(seconds=rng.uniform(0, span)), i, rng.random() < 0.15)
            for i in range(n)]


def test_batch_limit_equals_the_definition(spark):
    events = make(3000, ["hot"] * 8 + ["a", "b", "c"], 4 * 86400, 1)   # one dominant key, several days
    want = brute(events)
    assert any(b for _, b in want.values())
    df = spark.createDataFrame(events, SCHEMA)
    for bucket in (attempts.BUCKET, 16):
        got = rows(attempts.limit_attempts(df, bucket=bucket), "event_id")
        assert {k: (r["count"], r.blocked) for k, r in got.items()} == want


def test_key_without_pause_spreads_over_buckets(spark):
    even = [("k", START + timedelta(seconds=10 * i), i, False) for i in range(1500)]     # windows of 90 never meet
    busy = make(1500, ["b"], 3000, 4)
    events = even + [(k, t, 10_000 + i, ok) for k, t, i, ok in busy] + [("s", START, 30_000 + i, i % 2 == 0) for i in range(40)]
    got = rows(attempts.limit_attempts(spark.createDataFrame(events, SCHEMA), bucket=32), "event_id")
    assert {k: (r["count"], r.blocked) for k, r in got.items()} == brute(events)


def test_attempts_of_odd_rows(spark):
    df = spark.createDataFrame([(None, START, 1, True), ("a", START, 2, None), ("a", START, 2, None)], SCHEMA)
    assert sorted(r["count"] for r in attempts.limit_attempts(df).collect()) == [1, 2]
    assert attempts.limit_attempts(df.limit(0)).count() == 0


def test_window_is_anchored_and_not_extended(spark):
    at = [0, 100, 200, 300, 899, 900, 950]
    events = [("k", START + timedelta(seconds=s), i, False) for i, s in enumerate(at)]
    got = rows(attempts.limit_attempts(spark.createDataFrame(events, SCHEMA)), "event_id")
    assert [got[i]["count"] for i in range(7)] == [1, 2, 3, 4, 5, 1, 2]


def test_blocked_success_does_not_reset(spark):
    events = [("k", START + timedelta(seconds=i), i, i in (5, 6)) for i in range(8)]
    got = rows(attempts.limit_attempts(spark.createDataFrame(events, SCHEMA)), "event_id")
    assert [got[i]["count"] for i in range(8)] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert got[5].blocked


def write_batches(spark, events, path, n):
    events = sorted(events, key=lambda e: e[1])
    size = -(-len(events) // n)
    for i in range(n):
        part = events[i * size:(i + 1) * size]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stream_limit_equals_batch(spark, tmp_path):
    events = make(400, ["x", "y", "z"], 7200, 9)
    path = str(tmp_path / "in")
    write_batches(spark, events, path, 3)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    q = (
        attempts.limit_attempts_stream(stream).writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "event_id")
    assert {k: (r["count"], r.blocked) for k, r in got.items()} == brute(events)


def test_fill_log_restart_does_not_repeat(spark, tmp_path):
    path, log, cp = (str(tmp_path / n) for n in ("in", "log", "cp"))
    schema = "ts timestamp_ntz, ticker string, action string, quantity double, execution_price double"
    def add(cells):
        spark.createDataFrame(cells, schema).coalesce(1).write.mode("append").parquet(path)

    add([(START, "A", "BUY", 1.0, 2.0), (START, "B", "BUY", 0.0, 2.0),
         (START, "PORTFOLIO", "RISK_SNAPSHOT", 0.0, 0.0)])
    for extra in ([], [(START, "C", "SELL", 3.0, 1.0)]):
        if extra:
            add(extra)
        stream = spark.readStream.schema(schema).parquet(path)
        flows.log_fills(stream, log, cp).awaitTermination()
    got = sorted(r.ticker for r in spark.read.parquet(log).collect())
    assert got == ["A", "C", "PORTFOLIO"]


def test_order_resolution_takes_the_first_terminal_state(spark):
    e = [("1", "A", "buy", "new", 0.0, None, START, 1), ("1", "A", "buy", "filled", 2.0, 5.0, START, 2),
         ("1", "A", "buy", "canceled", 2.0, 5.0, START, 3)]
    e += [("2", "B", "buy", "new", 0.0, None, START + timedelta(seconds=i), i) for i in range(12)]
    e += [("2", "B", "buy", "filled", 1.0, 1.0, START + timedelta(seconds=99), 99)]
    e += [("3", "C", "buy", "new", 0.0, None, START + timedelta(milliseconds=i), i) for i in range(11)]
    e += [("3", "C", "buy", "filled", 3.0, 1.0, START + timedelta(milliseconds=300), 20)]
    df = spark.createDataFrame(e, "order_id string, symbol string, side string, status string, "
                               "filled_qty double, filled_avg_price double, ts timestamp_ntz, event_id int")
    got = rows(orders.resolve_orders(df), "order_id")
    assert (got["1"].status, got["1"].resolved) == ("filled", True)
    assert (got["2"].status, got["2"].resolved, got["2"].polls) == ("new", False, 10)
    assert (got["3"].status, got["3"].filled_qty, got["3"].polls) == ("filled", 3.0, 2)


def run_files(spark, tmp_path, parts, schema, transform, mode):
    """Rows that a stream writes when the parts arrive as files, one a micro-batch."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, cells in enumerate(parts):
        spark.createDataFrame(cells, schema).coalesce(1).write.mode("append").parquet(path)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    stream = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    stream.writeStream.foreachBatch(write).outputMode(mode).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(stream.columns)


def test_orders_resolved_on_a_stream_equal_batch(spark, tmp_path):
    rng, at = random.Random(6), lambda s: START + timedelta(seconds=s)
    schema = "order_id string, symbol string, side string, status string, filled_qty double, filled_avg_price double, " \
             "ts timestamp_ntz, event_id int"
    cells = []
    for o in range(40):
        begin = rng.uniform(0, 400)
        for _ in range(rng.randint(1, 9)):
            status = rng.choice(["new", "accepted", "partially_filled", "filled", "canceled", "expired"])
            cells.append((f"o{o}", "S", "buy", status, rng.uniform(0, 9), 1.0, at(begin + rng.choice([0, rng.uniform(0, 60)])), len(cells)))
    cells.append((None, "S", "buy", "filled", 1.0, 1.0, at(5), 9999))
    tick = [("tick", "S", "buy", "new", 0.0, 1.0, at(100_000), 10_000)]
    cells.sort(key=lambda c: c[6])
    parts = [cells[i:i + 60] for i in range(0, len(cells), 60)] + [tick]
    got = run_files(spark, tmp_path, parts, schema, lambda s: flows.resolutions_stream(s, 10, 4.0), "append")
    want = orders.resolve_orders(spark.createDataFrame(cells, schema).where("order_id is not null"), 10, 4.0)
    def shape(df):
        return sorted((r.order_id, r.status, r.filled_qty, r.resolved, r.polls) for r in df.collect())

    assert shape(got.where("order_id <> 'tick'")) == shape(want)
    assert {r.resolved for r in want.collect()} == {True, False}


def test_values_shown_on_a_stream_equal_batch(spark, tmp_path):
    rng = random.Random(7)
    schema = "user string, price double, ts timestamp_ntz"
    cells = [(f"u{rng.randrange(12)}", rng.choice([None, rng.uniform(1, 9)]), START + timedelta(seconds=rng.randrange(5000)))
             for _ in range(300)] + [("old", 1.0, START), (None, 2.0, START)]
    cells.sort(key=lambda c: c[2])
    parts = [cells[i:i + 70] for i in range(0, len(cells), 70)]
    changes = run_files(spark, tmp_path, parts, schema, lambda s: flows.latest_stream(s, "user", "price", "ts", 300), "update")
    changes = changes.cache()
    begin = int(START.replace(tzinfo=timezone.utc).timestamp())
    now = begin + max((c[2] - START).seconds for c in cells)
    got = {(r.user, r.at_us // 1_000_000) for r in flows.shown_at(changes, "user", "price", now * 1_000_000, 300).collect()}
    df = spark.createDataFrame(cells, schema).where("user is not null").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    want = latest.latest_fresh(df, ["user"], "price", "at", F.lit(now), 300).collect()
    assert got == {(r.user, r["at"]) for r in want} and 0 < len(got) < 12
    assert changes.where("not shown and user = 'old'").count() == 1          # forgotten when its time had passed


def test_ages_of_the_stream_are_whole_seconds_as_in_its_sql(spark, tmp_path):
    import duckdb

    from oracle.queries import load
    from tidemark import plans

    now, second = datetime(2024, 1, 30), timedelta(seconds=1)
    at = [now - 13 * 3600 * second, now - 43_200 * second, now - 43_200 * second + 0.5 * second, now - 43_199 * second,
          now - 5 * second, now, now + 0.5 * second, now + second]
    cells = [(i, t, i, "click", float(i)) for i, t in enumerate(at)] + [(20, at[6], 4, "purchase", 40.0)]
    spark.createDataFrame(cells, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(
        f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("t2_latest_fresh", "t2_latest_fresh_stream"):
        result = con.execute(load()[name])
        names = [c[0] for c in result.description]
        want = sorted(result.fetchall())
        got = plans.load()[name](spark, str(tmp_path)).select(names).collect()
        assert sorted(tuple(r) for r in got) == want and {3, 4, 5, 6} == {dict(zip(names, r))["user_id"] for r in want}
