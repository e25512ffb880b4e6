"""Near-duplicate documents: many universal-hash minima, banding, verification on full sets, and
connected components by large-star and small-star.

1. Every text becomes its set of distinct word shingles (64-bit hashes), a 128-bit digest of that
   set and BANDS * ROWS minima. Documents with equal sets form a class; a class goes on as one row.
2. Classes that share a band are candidates. Each class is first checked against one partner only,
   the most similar of its buckets' smallest ids; what that links is merged.
3. In each bucket that still spans several components, pairs of different components that the
   minima don't rule out are checked on their sets inside the task; members travel, pairs don't.
   A pair is checked in the first bucket that it shares only, told by the buckets themselves.
   A bucket of over CHUNK members is dealt out as pairs of chunks, so no task holds a hot bucket.
4. Components of all confirmed links.

The minima rule a pair out at an estimate more than 4.5 standard deviations below the threshold.
Two sets at the threshold share no band with probability (1 - t**ROWS)**BANDS, 2e-6 at 0.85.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import resident, words
from .components import components
from .spark_util import cut

BANDS, ROWS, CHUNK = 28, 6, 1024
_rng = np.random.default_rng(77)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_C = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MINIMA_BLOCK = 1 << 14


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, one row after the other, and the row offsets.

    Fewer words than width: the whole sequence is the one shingle; no words: none."""
    h, rows = words.hashed(column)
    counts = np.diff(rows)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    if len(h) >= width:
        rolled = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            rolled *= _C[0]
            rolled += h[k : len(h) - width + 1 + k]
        rolled = words.mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    # a row of n >= width words owns n - width + 1 consecutive windows
    flat = np.empty(at[-1], np.uint64)
    full = counts >= width
    if full.any():
        source = np.repeat(rows[:-1][full] - at[:-1][full], sizes[full]) + np.flatnonzero(np.repeat(full, sizes))
        flat[np.repeat(full, sizes)] = rolled[source]
    for i in np.flatnonzero((counts > 0) & ~full):
        one = np.array([counts[i]], np.uint64)
        for x in h[rows[i] : rows[i + 1]]:
            one = one * _C[1] + x
        flat[at[i]] = words.mix(one)[0]
    keep = np.ones(len(flat), bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        flat[a:b].sort()
    keep[1:] = flat[1:] != flat[:-1]
    keep[at[:-1][sizes > 0]] = True
    flat = flat[keep]
    return flat, np.concatenate([[0], np.cumsum(keep)])[at]


def minima(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each nonempty row the smallest value of each hash function; uint64 [rows, BANDS * ROWS]."""
    starts = offsets[:-1]
    out = np.empty((len(starts), len(_A)), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + MINIMA_BLOCK, side="right")) - 1)
        part, local = flat[offsets[at] : offsets[to]], starts[at:to] - offsets[at]
        scratch = np.empty_like(part)
        for k in range(len(_A)):
            np.multiply(part, _A[k], out=scratch)
            np.add(scratch, _B[k], out=scratch)
            out[at:to, k] = np.minimum.reduceat(scratch, local)
        at = to
    return out


_SIGNED = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, sig binary, bands array<long>"


def _sign(width: int):
    def run(batches):
        resident.release()
        for batch in batches:
            for part in words.slices(batch, "text"):
                flat, offsets = shingle_sets(part.column("text"), width)
                n = np.diff(offsets)
                some = np.flatnonzero(n > 0)
                h1, h2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                sigs = np.zeros((len(n), len(_A)), np.uint8)
                bands = np.zeros((len(n), BANDS), np.uint64)
                if len(some):
                    starts = offsets[:-1][some]
                    h1[some] = np.add.reduceat(words.mix(flat * _C[2]), starts)
                    h2[some] = np.add.reduceat(words.mix(flat * _C[3] + _C[4]), starts)
                    low = minima(flat, np.append(starts, len(flat)))
                    sigs[some] = (words.mix(low) & np.uint64(255)).astype(np.uint8)  # mixed: the leading bits of a large set's minima are all zero
                    key = np.zeros((len(some), BANDS), np.uint64)
                    for r in range(ROWS):
                        key = words.mix(key * _C[5] + low[:, r::ROWS])
                    bands[some] = words.mix(key + np.arange(BANDS, dtype=np.uint64) * _C[6])
                rows = len(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array(n.astype(np.int64)),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, (rows + 1) * len(_A), len(_A), dtype=np.int32)), pa.py_buffer(sigs.tobytes())]),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "sig", "bands"],
                )

    return run


def _gather_sets(width: int):
    def run(batches):
        resident.release()
        for batch in batches:
            for part in words.slices(batch, "text"):
                flat, offsets = shingle_sets(part.column("text"), width)
                raw = pa.py_buffer(flat.tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 8).astype(np.int64)), raw]).cast(pa.binary())], names=["id", "shingles"])

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, for ascending distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("sa"), batch.column("sb")
            yes = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return run


def _least_estimate(percent: int) -> int:
    """The fewest equal minima that don't rule a pair out."""
    t, k = percent / 100, BANDS * ROWS
    return int(k * max(0.0, t - 4.5 * (t * (1 - t) / k) ** 0.5))


class _Bucket:
    """One bucket's part in a task: members of two chunks (or of one), to be compared across."""

    def __init__(self, frame, percent: int):
        self.ids, self.comp, self.n = (frame[c].to_numpy() for c in ("id", "comp", "n_shingles"))
        self.side = frame["chunk"].to_numpy()
        self.sig = np.frombuffer(b"".join(frame["sig"]), np.uint8).reshape(len(self.ids), -1)
        self.earlier = np.stack(frame["earlier"].to_list()).astype(np.int64)
        self.percent = percent
        self.one = frame["left"].iloc[0] == frame["right"].iloc[0]
        self.left = frame["left"].iloc[0]

    def pairs(self):
        """(i, others): pairs of different components whose estimate and sizes allow a link and that meet in no earlier band's bucket."""
        least = _least_estimate(self.percent)
        own = np.arange(len(self.ids)) if self.one else np.flatnonzero(self.side == self.left)
        other = own if self.one else np.flatnonzero(self.side != self.left)
        for i in own:
            to = other[other > i] if self.one else other
            to = to[self.comp[to] != self.comp[i]]
            small, large = np.minimum(self.n[to], self.n[i]), np.maximum(self.n[to], self.n[i])
            to = to[100 * small >= self.percent * large]
            if not len(to):
                continue
            count = (self.sig[to] == self.sig[i]).sum(1)
            ok = count >= least
            to, count = to[ok], count[ok]
            ok = ~(self.earlier[to] == self.earlier[i]).any(1)
            if ok.any():
                yield i, to[ok], count[ok]


def _survivors(percent: int):
    import pandas as pd

    def run(frame):
        kept = np.zeros(len(frame), bool)
        for i, others, _ in _Bucket(frame, percent).pairs():
            kept[i] = True
            kept[others] = True
        return pd.DataFrame(frame.loc[kept, ["bucket", "left", "right", "chunk", "id", "comp", "n_shingles", "sig", "earlier"]])

    return run


def _confirm(percent: int):
    import pandas as pd

    def run(frame):
        frame = frame.reset_index(drop=True)
        bucket = _Bucket(frame, percent)
        sets = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        found, parent = [], {}

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for i, others, count in bucket.pairs():
            for j in others[np.argsort(-count, kind="stable")]:
                a, b = root(bucket.comp[i]), root(bucket.comp[j])
                if a != b and linked(sets[i], sets[j], percent):
                    parent[max(a, b)] = min(a, b)
                    found.append((bucket.ids[i], bucket.ids[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _pairs_of_chunks(members: DataFrame) -> DataFrame:
    """Deals each bucket out as pairs of chunks of about CHUNK members; one pair where it is small."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    parts = members.join(sizes.select("bucket", "m"), "bucket")
    parts = parts.withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = parts.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.select("bucket", "band", "id", "comp", "chunk", F.least("chunk", "with").alias("left"), F.greatest("chunk", "with").alias("right"))


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text, ...).

    Texts are lower-cased in A-Z; words are `[^\\x20\\x09-\\x0D]+`; a document is its set of distinct
    shingles of `width` words (of all its words, if fewer). Documents are linked when
    100 * |intersection| >= percent * |union|. Null or wordless texts have no shingle and stand
    alone. component_id is the smallest doc_id reachable; kept marks that one. Rows that repeat a
    doc_id are kept as rows, each linked by its own text, so with the same component where their sets
    are equal; a null doc_id is its own, null component. Other columns are ignored; empty in, empty out.
    """
    return _marked(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _marked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """near_duplicates' columns, text_hash, and one: true for the rows of one doc_id and text in each component."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = cut(texts.mapInArrow(_sign(width), _SIGNED))
    known = signed.where("n_shingles > 0 and doc_id is not null")
    key = ["h1", "h2", "n_shingles"]
    # a class has a number of its own: classes of different sets may have the same smallest doc_id
    classes = known.groupBy(*key).agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    heads = classes.select("id", "n_shingles", "sig", "bands")

    banded = heads.select("id", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("m"), F.min("id").alias("head")).where("m > 1")
    members = cut(banded.join(shared.select("bucket", "head"), "bucket"))

    sigs = heads.select("id", "n_shingles", "sig")
    wanted = members.select("id").distinct().join(classes.select("id", "least.*"), "id")
    texts_needed = texts.join(wanted, ["doc_id", "text_hash"]).select("id", "text")
    sets = cut(texts_needed.mapInArrow(_gather_sets(width), "id long, shingles binary").dropDuplicates(["id"]))

    first = members.where("id <> head").select(F.col("id").alias("b"), F.col("head").alias("a")).distinct()
    first = first.join(sigs.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("ga")), "a")
    first = first.join(sigs.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("gb")), "b")
    first = first.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    first = first.mapInArrow(_estimate(_least_estimate(percent)), "a long, b long, near int")
    first = first.groupBy("b").agg(F.max_by("a", F.struct("near", -F.col("a"))).alias("a"))
    first = first.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    links = cut(first.select("a", "b", "sa", "sb").mapInArrow(_verify(percent), "a long, b long"))

    merged = components(links)
    labelled = members.join(merged.withColumnRenamed("node", "id"), "id", "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("comp"))
    dealt = _pairs_of_chunks(cut(labelled)).join(heads, "id").withColumn("earlier", F.slice("bands", 1, F.col("band"))).drop("band", "bands")
    group = ["bucket", "left", "right"]
    schema = "bucket long, left int, right int, chunk int, id long, comp long, n_shingles long, sig binary, earlier array<long>"
    open_ = cut(_grouped(dealt, group, _survivors(percent), schema))
    more = _grouped(open_.join(sets, "id"), group, _confirm(percent), "a long, b long")
    last = components(cut(links.union(more)))

    of_class = classes.join(last.withColumnRenamed("node", "id"), "id", "left").select(*key, "least", F.coalesce("component", "id").alias("comp"))
    best = of_class.groupBy("comp").agg(F.min("least").alias("best"))
    of_class = of_class.join(best, "comp").select(*key, F.col("best.doc_id").alias("component_id"), F.col("best.text_hash").alias("best_hash"))
    out = signed.select("doc_id", "text_hash", *key).join(of_class, key, "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == own, F.lit(True))
    one = kept & F.coalesce(F.col("text_hash") == F.col("best_hash"), F.lit(True))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), kept.alias("kept"), "text_hash", one.alias("one"))


def _estimate(least: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            k = BANDS * ROWS
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, k) for c in ("ga", "gb"))
            near = (a == b).sum(1).astype(np.int32)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near)], names=["a", "b", "near"])
            yield out.filter(pa.array(near >= least))

    return run


def _grouped(df: DataFrame, keys: list[str], f, schema: str) -> DataFrame:
    """f over each group, many groups to a batch: rows are dealt by key, sorted, and cut at each new key."""
    import pandas as pd

    columns = df.columns

    def run(batches):
        rest = None
        for batch in batches:
            frame = batch.to_pandas()
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            change = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(change)
            if not len(starts):
                continue
            rest = frame.iloc[starts[-1] :]
            made = [f(frame.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            if made:
                yield from pa.Table.from_pandas(pd.concat(made), preserve_index=False).to_batches()
        if rest is not None and len(rest):
            yield from pa.Table.from_pandas(f(rest), preserve_index=False).to_batches()

    dealt = df.repartition(*keys).sortWithinPartitions(*keys).select(*columns)
    return dealt.mapInArrow(run, schema)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near duplicates of another row: one document of each group, all columns.

    Rows that repeat a doc_id are judged each by its own text; those of a kept doc_id with an equal text
    stay one row. Rows of null doc_id stay."""
    gone = _marked(docs, width, percent).where("doc_id is not null and not one").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    rows = docs.select("*", F.xxhash64(docs.text.cast("string")).alias("_text_hash"))
    left = rows.join(gone, (rows.doc_id == gone.gone_id) & (rows._text_hash == gone.gone_hash), "left_anti")
    nameless = left.where("doc_id is null")
    return left.where("doc_id is not null").dropDuplicates(["doc_id", "_text_hash"]).unionByName(nameless).drop("_text_hash")
