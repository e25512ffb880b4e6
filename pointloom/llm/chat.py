"""Chat formatting into budgeted, turn-aligned windows. DataFrame functions only.

Template: each turn is `<s>`, the role (URL-encoded), a line feed, the text, `</s>`. A control string in a
text, or one that looks like an escaped one, gets one more backslash after its first character, so
that texts never hold a control string and unescaping takes one away.

Windows: prefix sums of the turns' tokens choose spans of whole turns within the budget; a window
is the conversation's system turn (unless the span holds it), up to `history` tokens of the turns
before the span, and the span. The loss mask is the texts of the span's assistant turns: repeated turns are
never targets, so each assistant text is a target once. A token here is a run of letters and digits or one
other character that is not white space, which needs no vocabulary and stays in SQL functions.

A conversation of any length is spread over tasks: turns are dealt by range of conversation and turn, prefix
sums are made in two levels, inside the ranges and over the ranges' totals, and windows are cut in
blocks of BLOCK tokens by the prefix sums, whatever the turns are numbered. A span doesn't cross a
block, which costs one window in about BLOCK / budget; the history does: a block takes over the turns at
the end of the one before, which is the one whose tokens end where its own begin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark_util import cut, shuffle_partitions

BUDGET, HISTORY, BLOCK = 512, 128, 32_768
#: The control strings of this and of related templates (fixed values).
CONTROL = r"/?s>|/?INST\]|<SYS>>|</SYS>>"
_ESCAPE = (rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")
_UNESCAPE = (rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")
_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: Tokens that the template adds to a turn: begin, role, end.
TURN_TOKENS = 3


def escape(text):
    return F.regexp_replace(text, *_ESCAPE)


def unescape(text):
    return F.regexp_replace(text, *_UNESCAPE)


def _summed(turns: DataFrame) -> DataFrame:
    """Adds p, the tokens of the conversation's turns before, in order of turn (null first) and tie."""
    order = ["turn", "tie"]
    dealt = turns.repartitionByRange(shuffle_partitions(turns.sparkSession), "conv_id", *order).withColumn("range", F.spark_partition_id())
    dealt = cut(dealt)  # so that the ranges are the same wherever they are read
    totals = dealt.groupBy("conv_id", "range").agg(F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("of"), F.col("range").alias("in"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("p0"))
    inside = Window.partitionBy("conv_id", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("p1", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    met = dealt.join(totals.hint("merge"), dealt.conv_id.eqNullSafe(totals.of) & (dealt.range == totals["in"]))
    return met.withColumn("p", F.col("p0") + F.col("p1")).drop("of", "in", "p0", "p1", "range")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, block, window, formatted, n_repeated, n_turns, n_tokens, loss) for each window.

    loss is an array of struct(start, length): code points of formatted. Turns are ordered by turn
    (null first), ties by the md5 of role, a line feed and text; null role or text is empty. A turn over the
    budget has a window of its own, whole. Repeated rows stay; null conv_id is one conversation; other
    columns are ignored; empty in, empty out.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    turns = turns.withColumn("tie", F.md5(F.concat("role", F.lit("\n"), "text").cast("binary"))).withColumn("body", escape(F.col("text")))
    turns = turns.select("conv_id", "turn", "tie", "role", F.length(F.concat(F.lit("<s>"), F.url_encode("role"), F.lit("\n"))).alias("head"), F.length("body").alias("size"), (F.regexp_count("text", F.lit(_TOKEN)) + TURN_TOKENS).cast("long").alias("tokens"), F.concat(F.lit("<s>"), F.url_encode("role"), F.lit("\n"), "body", F.lit("</s>")).alias("shown"))
    turns = _summed(turns)
    turn = F.struct("p", "turn", "tie", "role", "shown", "head", "size", "tokens")
    system = turns.where("role = 'system'").groupBy("conv_id").agg(F.min(turn).alias("system")).withColumnRenamed("conv_id", "of")
    blocks = turns.groupBy("conv_id", F.expr(f"p div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("own"))
    blocks = blocks.join(system, blocks.conv_id.eqNullSafe(system.of), "left").drop("of").withColumn("begin", F.expr("own[0].p")).withColumn("stop", F.expr("own[size(own) - 1].p + own[size(own) - 1].tokens"))
    # a block that begins in the middle of a conversation takes over the turns within `history` of its begin
    tails = blocks.select(F.col("conv_id").alias("of"), F.col("stop").alias("at"), F.expr(f"filter(own, x -> stop - x.p <= {history})").alias("before")).where("size(before) > 0")
    blocks = blocks.join(tails, blocks.conv_id.eqNullSafe(tails.of) & (blocks.begin == tails["at"]), "left").drop("of", "at")
    blocks = blocks.withColumn("before", F.coalesce("before", F.expr("slice(own, 1, 0)"))).withColumn("t", F.concat("before", "own")).withColumn("n0", F.size("before"))
    # p[i]: tokens of the first i turns
    blocks = blocks.withColumn("p", F.expr("aggregate(t, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x.tokens)))"))
    blocks = blocks.withColumn("room", F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce("system.tokens", F.lit(0))))
    blocks = blocks.withColumn("starts", F.expr("aggregate(slice(sequence(0, size(t)), n0 + 2, size(own) - 1), array(n0), (a, i) -> if(p[i + 1] - p[element_at(a, -1)] > room, concat(a, array(i)), a))"))
    rows = blocks.select("conv_id", "block", "t", "p", "system", "starts", F.posexplode("starts").alias("window", "first"))
    rows = rows.withColumn("end", F.expr("coalesce(try_element_at(starts, window + 2), size(t))"))
    rows = rows.withColumn("back", F.expr(f"size(filter(slice(p, 1, first), x -> p[first] - x <= {history}))"))
    # history: the last `back` turns before the span; the system turn comes first unless it is among them or the span
    rows = rows.withColumn("near", F.expr("slice(t, first - back + 1, end - first + back)"))
    rows = rows.withColumn("lead", F.expr("if(system is null or exists(near, x -> x.p = system.p), array(), array(system))"))
    rows = rows.withColumn("segments", F.concat("lead", "near")).withColumn("n_repeated", F.size("lead") + F.col("back"))
    at = "aggregate(segments, named_struct('n', 0, 'i', 0, 'l', cast(array() as array<struct<start:int,length:int>>)), (a, x) -> named_struct('n', a.n + length(x.shown), 'i', a.i + 1, 'l', if(a.i >= n_repeated and x.role = 'assistant', concat(a.l, array(named_struct('start', a.n + x.head, 'length', x.size))), a.l)), a -> a.l)"
    return rows.select(
        "conv_id",
        "block",
        "window",
        F.expr("array_join(transform(segments, x -> x.shown), '')").alias("formatted"),
        "n_repeated",
        (F.col("end") - F.col("first")).alias("n_turns"),
        F.expr("aggregate(segments, 0L, (a, x) -> a + x.tokens)").alias("n_tokens"),
        F.expr(at).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, block, window, turns array<struct<role, text>>, targets array<string>) parsed from windows()."""
    inner = F.expr("slice(split(formatted, '</s>', -1), n_repeated + 1, n_turns)")

    def turn(x):
        role = F.substring_index(F.substring(x, 4, 2147483647), "\n", 1)
        return F.struct(F.url_decode(role).alias("role"), unescape(F.substr(x, F.length(role) + F.lit(5))).alias("text"))

    return formatted.select(
        "conv_id",
        "block",
        "window",
        F.transform(inner, turn).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))).alias("targets"),
        F.length("formatted").alias("chars"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read back from its windows. Its digests are of the whole conversation,
    whose windows therefore meet in one row."""
    own = F.sort_array(F.collect_list(F.struct("block", "window", "turns", "targets")))
    rows = read_back(formatted).groupBy("conv_id").agg(own.alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    rows = rows.withColumn("turns", F.expr("flatten(transform(w, x -> x.turns))")).withColumn("loss", F.expr("array_join(flatten(transform(w, x -> x.targets)), '')"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
