"""Events as a stream: replay of a table, dispatch to subscribers, keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "last_value double, n long, last_id long"
OUTPUT = "session string, event_id long, last_value double, n long"


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files, some at each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dispatch(stream: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Stream-static join: a row for each event and distinct subscriber to its type."""
    return stream.join(subscriptions.distinct(), "event_type")


def handled(stream: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str):
    """Starts a query that hands each micro-batch's rows of a type to that type's handler."""

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for kind, handler in handlers.items():
                handler(batch.where(F.col("event_type") == kind))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event time and type; rows later than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def last_known(stream: DataFrame, session: str, value: str) -> DataFrame:
    """As-of state by session: the last value that isn't null up to each event, 0 before any. Events of a
    micro-batch are taken in order of ts, event_id; files must arrive in that order."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, last_id = state.get if state.exists else (0.0, 0, -1)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event, x in zip(rows["event_id"], rows["value"], strict=True):
            last = last if pd.isna(x) else float(x)
            n, last_id = n + 1, int(event)
            out.append((key[0], last_id, last, n))
        state.update((last, n, last_id))
        yield pd.DataFrame(out, columns=["session", "event_id", "last_value", "n"])

    rows = stream.select(F.col(session).cast("string").alias("session"), "event_id", "ts", F.col(value).alias("value"))
    return rows.groupBy("session").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


MANIPULATOR = "x double, y double, left boolean, right boolean, middle boolean, keys string, radius double, azimuth double, elevation double, fov double"


def _moved(state: list, e, sensitivity: float) -> list:
    """The state after one event: kind `move` (x, y), `press` or `release` (button), `wheel` (dy, shift), `key_press` or
    `key_release` (key). A drag with the left button turns; the wheel changes the radius, with shift the field of view."""
    x, y, left, right, middle, keys, radius, azimuth, elevation, fov = state
    if e.kind == "move" and not pd.isna(e.x) and not pd.isna(e.y):
        if left:
            azimuth -= (e.x - x) * sensitivity
            azimuth += 360.0 if azimuth < 0 else -360.0 if azimuth >= 360 else 0.0
            elevation += (e.y - y) * sensitivity
            elevation = -89.9 if elevation <= -90 else 89.9 if elevation >= 90 else elevation
        x, y = float(e.x), float(e.y)
    elif e.kind in ("press", "release"):
        down = e.kind == "press"
        left, right, middle = (down if e.button == k else old for k, old in enumerate((left, right, middle)))
    elif e.kind == "wheel" and not pd.isna(e.dy):
        if e.shift:
            fov = min(max(fov - (e.dy > 0) + (e.dy < 0), 1.0), 90.0)
        else:
            radius *= 0.9 if e.dy > 0 else 1.1 if e.dy < 0 else 1.0
    elif e.kind in ("key_press", "key_release") and e.key is not None:
        held = set(filter(None, keys.split(",")))
        keys = ",".join(sorted(held | {e.key} if e.kind == "key_press" else held - {e.key}))
    return [x, y, left, right, middle, keys, radius, azimuth, elevation, fov]


def manipulator(stream: DataFrame, sensitivity: float = 0.2) -> DataFrame:
    """A camera manipulator's state after every event of each session: position, buttons, pressed keys, radius, azimuth,
    elevation and field of view. Events: session, ts, event_id, kind, x, y, button, dy, key, shift; those of a
    micro-batch are taken in order of ts, event_id; unknown kinds change nothing."""
    begin = (0.0, 0.0, False, False, False, "", 5.0, 0.0, 0.0, 45.0)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = list(state.get if state.exists else begin), []
        for e in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            now = _moved(now, e, sensitivity)
            out.append((str(key[0]), int(e.event_id), *now))
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=["session", "event_id", *(f.split()[0] for f in MANIPULATOR.split(", "))])

    return stream.groupBy("session").applyInPandasWithState(step, f"session string, event_id long, {MANIPULATOR}", MANIPULATOR, "append", GroupStateTimeout.NoTimeout)
