"""A stream of several micro-batches equals the batch."""

import random

from pyspark.sql import functions as F

from pointloom.operators import events
from pointloom.streaming import events as streaming


def test_stream_equals_batch(spark, data, tmp_path):
    table = spark.read.parquet(f"{data}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    ids = [r.event_id for r in table.orderBy("ts", "event_id").select("event_id").collect()]
    folder = str(tmp_path / "in")
    for k in range(3):
        own = ids[k * len(ids) // 3 : (k + 1) * len(ids) // 3]
        table.where(F.col("event_id").isin(own)).coalesce(1).write.mode("append").parquet(folder)
    live = streaming.replay(spark, folder, table.schema)

    subs = spark.createDataFrame([("click", 1), ("view", 2), ("view", 2)], "event_type string, receiver_id long")
    streaming.dispatch(live, subs).writeStream.format("memory").queryName("dispatched").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("dispatched").count() == events.dispatch(table, subs).count()

    value = live.withColumn("value", F.when(F.col("event_type") == "view", F.col("value")))
    streaming.last_known(value, "user_id", "value").writeStream.format("memory").queryName("known").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    batch = events.last_known(table.withColumn("session", F.col("user_id")), F.when(F.col("event_type") == "view", F.col("value")), "last_value")
    assert sorted(map(tuple, spark.table("known").select("event_id", "last_value").collect())) == sorted(map(tuple, batch.select("event_id", "last_value").collect()))

    seen = []
    query = streaming.handled(live, {"click": lambda rows: seen.append(rows.count())}, str(tmp_path / "at"))
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == table.where("event_type = 'click'").count()


def test_orbit_clamps(spark):
    rows = spark.createDataFrame([(1, 0, i, 0.0, dy) for i, dy in enumerate((100.0, 100.0, -30.0))], "session long, ts long, event_id long, dx double, dy double")
    assert abs(events.orbit(rows, 1.0).first().state.elevation - 59.9) < 1e-9


def test_folds_across_batches(spark):
    """Sessions over many batches, one of a null key, against the same recurrences in plain Python."""
    rng = random.Random(3)
    rows = [(s, 0, i, rng.choice([None, rng.uniform(-400, 400)]), rng.uniform(-300, 300), rng.random() < 0.4) for i, s in enumerate(rng.choices([1, 2, 2, 3, None], k=300))]
    table = spark.createDataFrame(rows, "session long, ts long, event_id long, dx double, dy double, shift boolean")
    turned, zoomed = {}, {}
    for s, _, _, dx, dy, shift in rows:
        a, e = turned.get(s, (0.0, 0.0))
        a, e = a - (dx or 0.0) * 0.2, e + dy * 0.2
        turned[s] = (a + 360 if a < 0 else a - 360 if a >= 360 else a, -89.9 if e <= -90 else 89.9 if e >= 90 else e)
        radius, fov = zoomed.get(s, (5.0, 45.0))
        zoomed[s] = (radius, min(max(fov - (1 if dy > 0 else -1), 1), 90)) if shift else (radius * (0.9 if dy > 0 else 1.1), fov)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        assert {r.session: tuple(r.state) for r in events.orbit(table).collect()} == turned
        assert {r.session: tuple(r.state) for r in events.zoom(table).collect()} == zoomed
    finally:
        spark.conf.set(key, before)
