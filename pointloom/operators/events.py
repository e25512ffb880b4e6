"""Event streams replayed in batch. Rows are in sessions (a column `session`) and ordered by `order`
columns inside them, so every window is partitioned; a stream without sessions is one session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "event_id")
SESSION = "session"


def _over(order=ORDER):
    return Window.partitionBy(SESSION).orderBy(*order)


def dispatch(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """A row for each event and distinct subscriber to its type; Spark broadcasts subscriptions if they are small."""
    return events.join(subscriptions.distinct(), "event_type")


def latest_handlers(handlers: DataFrame) -> DataFrame:
    """(key, handler): the one registered last for each key."""
    return handlers.groupBy("key").agg(F.max_by("handler", "seq").alias("handler"))


def last_known(events: DataFrame, value: Column, name: str, initial=0.0, order=ORDER) -> DataFrame:
    """The last value that isn't null up to each row; as-of join with the stream itself."""
    over = _over(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(over), F.lit(initial)))


def delta(events: DataFrame, column: str, name: str, order=ORDER) -> DataFrame:
    """Less the row before; null on a session's first."""
    return events.withColumn(name, F.col(column) - F.lag(column).over(_over(order)))


def frame_ms(events: DataFrame, order=ORDER) -> DataFrame:
    micros = F.unix_micros("ts")
    return events.withColumn("ms", (micros - F.lag(micros).over(_over(order))) / 1000.0)


def count_windows(events: DataFrame, column: str, n: int = 10, order=ORDER) -> DataFrame:
    """Mean of each n rows in order; an incomplete window isn't emitted."""
    rows = events.withColumn("window", F.floor((F.row_number().over(_over(order)) - 1) / n).cast("long"))
    return rows.groupBy(SESSION, "window").agg(F.avg(column).alias("mean"), F.count("*").alias("n")).where(F.col("n") == n).drop("n")


def recent(means: DataFrame, n: int = 50, fill: float = 60.0) -> DataFrame:
    """Of each window the last n means up to it, oldest first, filled in front."""
    over = Window.partitionBy(SESSION).orderBy("window").rowsBetween(-(n - 1), 0)
    got = F.collect_list("mean").over(over)
    return means.withColumn("ring", F.concat(F.array_repeat(F.lit(fill), F.lit(n) - F.size(got)), got))


def pressed(events: DataFrame, order=ORDER) -> DataFrame:
    """Whether each event's key is down after it: its last action is 1; actions other than 0 and 1 are dropped."""
    kept = events.where(F.col("action").isin(0, 1))
    over = Window.partitionBy(SESSION, "key").orderBy(*order)
    return kept.withColumn("down", F.col("action") == 1).withColumn("changed", F.coalesce(F.col("action") != F.lag("action").over(over), F.lit(True)))


def folded(events: DataFrame, begin: Callable, step: Callable, fields: list[str], made: list[str], order=ORDER, every: bool = False, show: Callable = tuple) -> DataFrame:
    """A left fold of each session's rows in order from begin(); step(state, *fields) gives the next state, and show
    its numbers, the doubles `made`. A row for each session, the last state; with every, one after each row, with
    the order's columns.

    Recurrences with clamps depend on order and can't be split. Sorted rows stream through the fold, so a
    session takes a task's time but not its memory."""
    import pandas as pd

    shown = [SESSION, *order] if every else [SESSION]
    rows = events.select(SESSION, *order, *fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, None
        for batch in batches:
            states, ended = [], []
            for own, *values in zip(batch[SESSION], *[batch[f] for f in fields], strict=True):
                own = None if pd.isna(own) else own
                if state is None or own != session:
                    if state is not None and not every:
                        ended.append((session, *show(state)))
                    session, state = own, begin()
                state = step(state, *values)
                if every:
                    states.append(show(state))
            if every:
                yield pd.concat([batch[shown], pd.DataFrame(states, columns=made, dtype="float64", index=batch.index)], axis=1)
            elif ended:
                yield pd.DataFrame(ended, columns=[SESSION, *made])
        if state is not None and not every:
            yield pd.DataFrame([(session, *show(state))], columns=[SESSION, *made])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in shown), *(f"{c} double" for c in made)])
    return rows.repartition(SESSION).sortWithinPartitions(SESSION, *order).mapInPandas(run, schema)


def orbit(events: DataFrame, sensitivity: float = 0.2) -> DataFrame:
    """(session, state) with azimuth and elevation after the deltas dx, dy (null: 0): azimuth wraps once into [0, 360),
    elevation stops at 89.9."""

    def step(state: tuple, dx: float, dy: float) -> tuple:
        a, e = state[0] - dx * sensitivity, state[1] + dy * sensitivity
        a = a + 360.0 if a < 0 else a - 360.0 if a >= 360 else a
        return a, -89.9 if e <= -90 else 89.9 if e >= 90 else e

    moves = events.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("dx", "dy")})
    made = ["azimuth", "elevation"]
    return folded(moves, lambda: (0.0, 0.0), step, ["dx", "dy"], made).select(SESSION, F.struct(*made).alias("state"))


def zoom(events: DataFrame) -> DataFrame:
    """(session, state) with radius, 5 at first, and field of view, 45, after wheel steps dy: without shift the radius times
    0.9 or 1.1, with it the field of view by a degree within [1, 90]. Null is no step, and no shift."""

    def step(state: tuple, dy: float, shift: bool) -> tuple:
        radius, fov = state
        if shift:
            return radius, min(max(fov - ((dy > 0) - (dy < 0)), 1.0), 90.0)
        return radius * (0.9 if dy > 0 else 1.1 if dy < 0 else 1.0), fov

    wheel = events.withColumns({"dy": F.coalesce(F.col("dy").cast("double"), F.lit(0.0)), "shift": F.coalesce(F.col("shift"), F.lit(False))})
    made = ["radius", "fov"]
    return folded(wheel, lambda: (5.0, 45.0), step, ["dy", "shift"], made).select(SESSION, F.struct(*made).alias("state"))


def button_flags(events: DataFrame, order=ORDER) -> DataFrame:
    """Which of the left, right and middle buttons (0, 1, 2) are down after each row: the last action
    (1 press, 0 release) of each; rows of other buttons or actions change none."""
    over = _over(order).rowsBetween(Window.unboundedPreceding, 0)
    real = F.col("action").isin(0, 1)
    for k, name in enumerate(("left", "right", "middle")):
        own = F.when((F.col("button") == k) & real, F.col("action") == 1)
        events = events.withColumn(name, F.coalesce(F.last(own, ignorenulls=True).over(over), F.lit(False)))
    return events


def history(events: DataFrame, column: str, order=ORDER) -> DataFrame:
    """Each row's place in its session, and the column's value before and after: a history to step through."""
    over = _over(order)
    return events.withColumns({"at": F.row_number().over(over) - 1, "previous": F.lag(column).over(over), "next": F.lead(column).over(over)})


def dragged(events: DataFrame, order=ORDER) -> DataFrame:
    """Steps dx, dy from the last position that a move or a press (action 1) left; the position is reset by a press
    and 0 at first. Rows: kind (`move` or `press`), x, y."""
    over = _over(order)
    for c in "xy":
        before = F.coalesce(F.lag(c).over(over), F.lit(0.0))
        events = events.withColumn("d" + c, F.when(F.col("kind") == "move", F.col(c) - before).otherwise(F.lit(0.0)))
    return events


Triple = tuple[float, float, float]


def _plus(a: Triple, b: Triple, times: float = 1.0) -> Triple:
    return (a[0] + b[0] * times, a[1] + b[1] * times, a[2] + b[2] * times)


def _cross(a: Triple, b: Triple) -> Triple:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _unit(a: Triple) -> Triple:
    """A zero vector stays as it is."""
    n = sum(c * c for c in a) ** 0.5
    return (a[0] / n, a[1] / n, a[2] / n) if n else a


class Trackball:
    """A camera about a target. Drags with the right button turn it, with the middle one move it in its
    own plane; the wheel changes its distance, or with shift its field of view; W, S, A, D step."""

    TURN, PAN, STEP = 0.005, 0.01, 0.2

    def __init__(self):
        self.eye, self.target, self.up = (0.0, 0.0, 5.0), (0.0, 0.0, 0.0), (0.0, 1.0, 0.0)
        self.radius, self.fov, self.at = 10.0, 45.0, (0.0, 0.0)
        self.buttons, self.shifts = set(), set()

    def turn(self, dx: float, dy: float) -> None:
        """By -dx about up, after dy about the right: v turned by an angle about a unit axis k is
        v cos + (k x v) sin + k (k.v)(1 - cos)."""
        from math import cos, sin

        view = _unit(_plus(self.eye, self.target, -1.0))
        right = _unit(_cross(view, self.up))
        turned = view
        for axis, angle in ((right, dy * self.TURN), (self.up, -dx * self.TURN)):
            along = sum(p * q for p, q in zip(axis, turned, strict=True)) * (1 - cos(angle))
            turned = _plus(_plus(tuple(c * cos(angle) for c in turned), _cross(axis, turned), sin(angle)), axis, along)
        self.eye, self.up = _plus(self.target, turned, self.radius), _unit(_cross(right, turned))

    def shift(self, by: Triple) -> None:
        self.eye, self.target = _plus(self.eye, by), _plus(self.target, by)

    def pan(self, dx: float, dy: float) -> None:
        back = _unit(_plus(self.eye, self.target, -1.0))
        right = _unit(_cross(self.up, back))
        self.shift(_plus(tuple(-dx * self.PAN * c for c in right), _cross(back, right), dy * self.PAN))

    def wheel(self, dy: float) -> None:
        sign = (dy > 0) - (dy < 0)
        if self.shifts:
            self.fov = min(max(self.fov - sign, 1.0), 90.0)
            return
        self.radius *= (1.0, 0.9, 1.1)[sign]
        self.eye = _plus(self.target, _unit(_plus(self.eye, self.target, -1.0)), self.radius)

    def key(self, key: str) -> None:
        ahead = _unit(_plus(self.target, self.eye, -1.0))
        right = _unit(_cross(self.up, ahead))
        steps = {"W": (ahead, 1.0), "S": (ahead, -1.0), "D": (right, 1.0), "A": (right, -1.0)}
        if key in steps:
            way, sign = steps[key]
            self.shift(tuple(sign * self.STEP * c for c in way))

    def take(self, kind: str | None, x: float, y: float, button: int | None, dy: float, key: str | None) -> None:
        if kind == "move":
            d = (x - self.at[0], y - self.at[1])
            if 1 in self.buttons:
                self.turn(*d)
            if 2 in self.buttons:
                self.pan(*d)
            self.at = (x, y)
        elif kind == "press":
            self.buttons.add(button)
            self.at = (x, y)
        elif kind == "release":
            self.buttons.discard(button)
        elif kind == "wheel":
            self.wheel(dy)
        elif kind == "key_press":
            if key in ("LEFT_SHIFT", "RIGHT_SHIFT"):
                self.shifts.add(key)
            self.key(key)
        elif kind == "key_release":
            self.shifts.discard(key)


def trackball(events: DataFrame, order=ORDER) -> DataFrame:
    """(session, *order, eye_x .. up_z, radius, fov) after each row of (session, *order, kind, x, y, button, dy, key).

    kind is move, press, release, wheel, key_press or key_release; rows of another kind change nothing,
    null numbers are 0."""
    fields = ["kind", "x", "y", "button", "dy", "key"]
    numbers = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("x", "y", "dy")}
    rows = events.withColumns(numbers | {"button": F.coalesce(F.col("button").cast("int"), F.lit(-1))})
    made = [f"{p}_{a}" for p in ("eye", "target", "up") for a in "xyz"] + ["radius", "fov"]

    def step(ball: Trackball, *values) -> Trackball:
        ball.take(*values)
        return ball

    return folded(rows, Trackball, step, fields, made, order, True, lambda ball: (*ball.eye, *ball.target, *ball.up, ball.radius, ball.fov))
