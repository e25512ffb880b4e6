"""Typed object registry: instances (seq, type, name) and type edges (base, derived)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: base -> derived types (fixed values).
TYPES = {
    "Object": ["Entity", "ComponentBase", "SystemBase"],
    "ComponentBase": ["CameraBase", "CameraManipulatorBase", "Renderable", "Shader", "Transform", "GUIComponentBase"],
    "CameraBase": ["PerspectiveCamera", "OrthogonalCamera"],
    "CameraManipulatorBase": ["CameraManipulatorOrbit", "CameraManipulatorTrackball"],
    "GUIComponentBase": ["StatusPanel"],
    "SystemBase": ["EventSystem", "GUISystem", "ImmediateModeRenderSystem", "InputSystem", "RenderSystem"],
}


def type_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, d) for b, ds in TYPES.items() for d in ds], "base string, derived string")


def register(edges: DataFrame, base: str, derived: str) -> DataFrame:
    return edges.union(edges.sparkSession.createDataFrame([(base, derived)], "base string, derived string")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """All (base, derived) pairs, transitively; a type isn't its own subclass, also where edges have a cycle.

    A join for each level of the hierarchy, until one finds nothing new; levels are kept, as the next ones read them."""
    steps = edges.select(F.col("base").alias("derived"), F.col("derived").alias("next"))
    found = new = edges.select("base", "derived").distinct().cache()
    while True:
        new = new.join(steps, "derived").select("base", F.col("next").alias("derived")).distinct().join(found, ["base", "derived"], "left_anti").cache()
        if new.isEmpty():
            return found.where("base <> derived")
        found = found.union(new)


def create(instances: DataFrame, type_: str, name: str) -> DataFrame:
    """Appends a row after the last."""
    last = instances.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("seq"))
    return instances.unionByName(last.select("seq", F.lit(type_).alias("type"), F.lit(name).alias("name")))


def of_type(instances: DataFrame, edges: DataFrame, base: str) -> DataFrame:
    """Instances of a type and of its subclasses."""
    types = closure(edges).where(F.col("base") == base).select(F.col("derived").alias("type")).union(edges.sparkSession.createDataFrame([(base,)], "type string"))
    return instances.join(types, "type", "left_semi").select(*instances.columns)


def first_of_type(instances: DataFrame, edges: DataFrame, base: str) -> DataFrame:
    return of_type(instances, edges, base).orderBy("seq").limit(1)


def instance_map(instances: DataFrame) -> DataFrame:
    return instances.groupBy("type").agg(F.sort_array(F.collect_set("seq")).alias("seqs"))


def numbered(df: DataFrame, order: str, group: str) -> DataFrame:
    """Gapless ids from 0 in each group."""
    return df.withColumn("id", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def subscribe(subscriptions: DataFrame, event_type: str, receiver: int) -> DataFrame:
    return subscriptions.union(subscriptions.sparkSession.createDataFrame([(event_type, receiver)], "event_type string, receiver_id long")).distinct()


def unsubscribe(subscriptions: DataFrame, event_type: str, receiver: int) -> DataFrame:
    gone = subscriptions.sparkSession.createDataFrame([(event_type, receiver)], "event_type string, receiver_id long")
    return subscriptions.join(gone, ["event_type", "receiver_id"], "left_anti")


def ordered_map(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, entries): each group's entries in order of key, one a key, that of the largest value."""
    one = rows.groupBy(group, F.col(key).alias("key")).agg(F.max(value).alias("value"))
    return one.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("entries"))
