"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Each source's documents, in hash order, are one stream of words, cut into blocks of equal size. The
schedule has 2**m places; place i is the van der Corput point bitreverse(i), and falls to the source
whose interval of the cumulative block counts holds it, so every source gets exactly the blocks that
it needs, evenly spread. A source's slots are ranked, and rank r takes block r of its stream, which
starts over at its end. Prefix sums and ranks are made in two levels (inside bounded blocks, then
over the blocks' sums), so that a source with most of the rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark_util import cut

WORD = r"[^\x20\x09-\x0D]+"
MOST_EPOCHS = 3
#: Blocks have total / 2**16 words, between 1 and this.
LARGEST_BLOCK = 1024
RANK_BLOCK, SLOT_CHUNK = 2048, 4096


def targets(sources: DataFrame) -> DataFrame:
    """Adds target to (source, source_size, s): weights 1, 2, 3 by s share all words, but no source gets
    over MOST_EPOCHS times its size; what is over is shared again by weight.

    In order of the level at which they fill up, sources are full as long as that level is below the
    one that the rest would reach without them."""
    w = (F.col("s") % 3 + 1).cast("double")
    rows = sources.withColumn("w", w).withColumn("most", MOST_EPOCHS * F.col("source_size")).withColumn("fills", F.col("most") / F.col("w"))
    order = Window.orderBy("fills", "s")
    rows = rows.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    free = F.when(F.col("fills") > F.col("level"), F.struct("fills", "s", "level"))
    rows = rows.withColumn("free", F.min(free).over(Window.partitionBy())["level"])
    return rows.withColumn("target", F.when(F.col("fills") > F.col("level"), F.col("free") * F.col("w")).otherwise(F.col("most").cast("double"))).drop("w", "most", "fills", "level", "free")


def _running(df: DataFrame, group: str, block: str, order: list[str], value) -> DataFrame:
    """Adds before: the sum of value over earlier rows of the group, blocks first, then order inside them."""
    df = df.withColumn("value", value)
    sums = df.groupBy(group, block).agg(F.sum("value").alias("v"))
    sums = sums.withColumn("b0", F.coalesce(F.sum("v").over(Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("v")
    inside = Window.partitionBy(group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("b1", F.coalesce(F.sum("value").over(inside), F.lit(0)))
    return df.join(sums.hint("merge"), [group, block]).withColumn("before", F.col("b0") + F.col("b1")).drop("b0", "b1", "value")


def _bit_reverse(k, bits: int):
    return F.conv(F.reverse(F.lpad(F.bin(k), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def schedule(sources: DataFrame, block: int, bits: int) -> DataFrame:
    """(s, place, rank, epoch, b, begin, n): slots in places 0 .. 2**bits - 1; each takes n words from begin on.

    sources has s, source_size, taken_size, blocks, needed and first (blocks needed by earlier ones)."""
    chunks = sources.where("needed > 0").withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(needed - 1) div {SLOT_CHUNK}"))))
    slots = chunks.repartition("s", "c").withColumn("k", F.explode(F.sequence(F.col("c") * SLOT_CHUNK, F.least(F.col("needed"), (F.col("c") + 1) * SLOT_CHUNK) - 1)))
    slots = slots.withColumn("place", _bit_reverse(F.col("first") + F.col("k"), bits)).withColumn("part", F.expr(f"place div {1 << max(0, bits - 6)}"))
    slots = _running(slots, "s", "part", ["place"], F.lit(1).cast("long")).withColumnRenamed("before", "rank")
    slots = slots.withColumn("epoch", F.expr("rank div blocks")).withColumn("b", F.expr("rank % blocks")).withColumn("begin", F.col("b") * block)
    n = F.least(F.lit(block), F.col("source_size") - F.col("begin"), F.col("taken_size") - F.col("epoch") * F.col("source_size") - F.col("begin"))
    return slots.select("s", "place", "rank", "epoch", "b", "begin", n.alias("n"))


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The taken words of every row with its places, and the schedule.

    The first has doc_id, source, size (words; null text 0), source_size, target (of its source),
    taken and places, for every row of docs, repeated ids included; the second is schedule(). places
    are those of the first slot that takes words of the row, in each epoch in which one does, in order of
    the epochs: at most MOST_EPOCHS of them. Sources are ordered
    by code point with null last and weigh 1, 2, 3, repeating. taken adds up to each source's target,
    rounded, and is at most MOST_EPOCHS times size. Equal documents are ordered by hash, doc_id and
    size, so reruns agree. Other columns are ignored; empty in, empty out.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    total, count, n_sources = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.count_distinct(F.coalesce(F.concat(F.lit("."), "source"), F.lit("")))).first()
    block = max(1, min(LARGEST_BLOCK, total >> 16))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sources.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1))
    sources = sources.withColumn("taken_size", F.least(F.round("target").cast("long"), MOST_EPOCHS * F.col("source_size")))
    sources = sources.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    some = F.when(F.col("source_size") > 0, F.col("source_size"))
    sources = sources.withColumn("needed", F.coalesce(F.floor(F.col("taken_size") / some) * F.col("blocks") + F.expr(f"(taken_size % nullif(source_size, 0) + {block - 1}) div {block}"), F.lit(0)).cast("long"))
    sources = cut(sources.withColumn("first", F.coalesce(F.sum("needed").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    needed = sources.agg(F.coalesce(F.sum("needed"), F.lit(0))).first()[0]
    bits = max(0, int(needed - 1).bit_length()) if needed else 0

    keys = sources.select(F.col("source").alias("of"), "s", "source_size", "target")
    known = rows.join(keys, rows.source.eqNullSafe(keys.of)).drop("of")
    parts = max(1, count // RANK_BLOCK)
    known = known.withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.expr(f"shiftrightunsigned(h, 33) div {(1 << 31) // parts + 1}"))
    placed = cut(_running(known, "s", "part", ["h", "doc_id", "size"], F.col("size")).withColumnRenamed("before", "start"))

    slots = schedule(sources, block, bits)
    held = placed.where("size > 0").select("s", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("b"))
    # slots grow with the words: never broadcast
    met = held.join(slots.select("s", "b", "begin", "n", "epoch", "place").hint("merge"), ["s", "b"])
    overlap = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("begin") + F.col("n")) - F.greatest("start", "begin"))
    met = met.withColumn("overlap", overlap)
    first = [F.min(F.when((F.col("overlap") > 0) & (F.col("epoch") == e), F.col("place"))) for e in range(MOST_EPOCHS)]
    sums = met.groupBy("s", "start").agg(F.sum("overlap").alias("t"), F.array_compact(F.array(*first)).alias("p"))
    out = placed.join(sums.hint("merge"), ["s", "start"], "left")
    some = F.col("size") > 0
    taken = F.when(some, F.coalesce("t", F.lit(0))).otherwise(0).cast("long")
    places = F.when(some, F.coalesce("p", F.array().cast("array<long>"))).otherwise(F.array().cast("array<long>"))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), places.alias("places")), slots


def mixed(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them, in whole documents and in the schedule's order; all columns.

    Each row is taken taken / size times, rounded: its k-th copy stands at the place where the k-th epoch
    in which the schedule meets it begins to take its words (the last such epoch for a copy that only
    rounding gives). Rows of null doc_id, and those that repeat one, are taken as rows: the k-th of those
    of equal doc_id, source and size as often as the k-th such row of the mix, which doesn't tell them
    apart. Rows without words, and null texts, aren't taken; empty in, empty out."""
    shares, _ = mix(docs)
    shares = cut(shares.select("doc_id", "source", "size", F.coalesce(F.round(F.col("taken") / F.when(F.col("size") > 0, F.col("size"))), F.lit(0)).cast("int").alias("times"), "places"))
    by_id = shares.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("rows"), F.sum("times").cast("int").alias("times"), F.min("places").alias("places")).where("times > 0")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("key"))
    named = rows.join(by_id.hint("merge"), "key")
    once, others = named.where("rows = 1").select("doc", "times", "places"), named.where("rows > 1").select("doc", "key").union(rows.where("key is null"))

    equal = ["key", "source", "size"]
    others = others.select("doc", "key", F.col("doc.source").cast("string").alias("source"), F.coalesce(F.regexp_count("doc.text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    others = others.withColumn("k", F.row_number().over(Window.partitionBy(*equal).orderBy(F.xxhash64("doc.text")))).alias("o")
    ranked = shares.withColumnRenamed("doc_id", "key").withColumn("k", F.row_number().over(Window.partitionBy(*equal).orderBy("times", "places"))).where("times > 0").alias("r")
    met = others.join(ranked, [F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*equal, "k")]).select("doc", "times", "places")
    copies = once.union(met).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    at = F.expr("element_at(places, least(time, size(places)))")
    return copies.select("doc", at.alias("place"), "time").repartitionByRange("place").sortWithinPartitions("place", "time", "doc.doc_id").select("doc.*")
