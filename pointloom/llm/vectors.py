"""Searches of a stated query set against all rows: exact top-k by pivot-table elimination, and
approximate neighbours by multiprobe p-stable hashing.

Exact: rows are dealt to cells of at most about CELL vectors by a hash of their id, queries to blocks of about
QUERIES; a task gets one block and one cell, so neither hot values nor many queries gather anywhere, and
a row moves once for QUERIES queries, a query once for CELL rows. Each returns its own best, and a
query's best are ranked from those.

Approximate: a row moves once a hash table, to its bucket, a query to the buckets that it probes; a large bucket
is cut into chunks by a hash of the id. Only what meets in a bucket is scored.

Both: vec_id null, vectors null, of no components, or with null or non-finite components take no part; shorter vectors
are filled up with zeros; rows that repeat a vec_id count once, as the smallest of their vectors; no
row is a candidate of a query of its own vec_id; ties go to the smaller vec_id. Other columns are
ignored; empty in, empty out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark_util import cut

CELL, LEAST_CELL, QUERIES = 32_768, 4_096, 8_192
#: Pivots of the exact search; bounds are made for so many queries at once.
PIVOTS, BOUND_QUERIES = 48, 64
#: Hash tables, projections a table, bucket width in units of a projection's spread, and levels of a projection, the outer ones open.
TABLES, PROJECTIONS, WIDTH, LEVELS = 8, 7, 0.5, 2
#: The chance that the probes are to give a query's k-th neighbour of being met; queries that are compared to all rows to estimate how near that is.
SUCCESS, PILOTS = 0.91, 64
CHUNK, MERGE = 4_096, 1_000_000


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): doubles, or floats where the vectors are of floats; all finite."""
    floats = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    v = F.transform("embedding", lambda x: x.cast("float" if floats else "double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def _search(rows: DataFrame, query, k: int, within, score_type: str) -> DataFrame:
    """rows: (vec_id, v), materialised. within(queries, q_ids, candidates, c_ids) yields (query, ids, scores)."""
    count, dim, asked = rows.agg(F.count("*"), F.max(F.size("v")), F.coalesce(F.sum(query.cast("int")), F.lit(0))).first()
    cells, blocks = max(1, -(-count // CELL), min(rows.sparkSession.sparkContext.defaultParallelism, count // LEAST_CELL)), max(1, -(-asked // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell, block = F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    candidates = rows.select("vec_id", "v", cell.alias("cell"), every(blocks).alias("block"))
    queries = rows.where(query).select("vec_id", "v", every(cells).alias("cell"), block.alias("block"))

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [(np.full(len(ids), a), ids, s) for a, ids, s in within(_matrix(q["v"], dim), q["vec_id"].to_numpy(), _matrix(c["v"], dim), c["vec_id"].to_numpy())] if len(q) and len(c) else []
        if not out:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64 if score_type == "long" else float)})
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    found = queries.groupBy("cell", "block").cogroup(candidates.groupBy("cell", "block")).applyInPandas(run, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def independent(pivots: np.ndarray) -> np.ndarray:
    """The pivots without those that lie in the span of the ones before."""
    if len(pivots) < 2:
        return pivots
    triangle = np.linalg.qr((pivots[1:] - pivots[0]).T, mode="r")
    size = np.zeros(len(pivots) - 1)
    size[: len(triangle)] = np.abs(np.diag(triangle))
    return pivots[np.concatenate([[True], size > 1e-6 * max(1.0, np.abs(pivots).max())])]


def simplex(pivots: np.ndarray):
    """f(distances) for distances [rows, pivots] to independent pivots: coordinates whose distances bound those of the rows.

    Squared distances to two pivots differ by a linear function of the row, so the distances to all of
    them fix the row's place in the pivots' span; what is left is its height above the span. Two rows are
    at least as far apart as these coordinates are, and these at least as far as the largest difference of
    two distances to one pivot."""
    own = pivots[1:] - pivots[0]
    lengths = (own * own).sum(1)
    solve = np.linalg.inv(np.linalg.qr(own.T, mode="r")) if len(own) else np.zeros((0, 0))

    def f(distances: np.ndarray) -> np.ndarray:
        squares = distances * distances
        first = squares[:, :1]
        at = (first - squares[:, 1:] + lengths) / 2 @ solve
        height = np.sqrt(np.maximum(0.0, first[:, 0] - (at * at).sum(1)))
        return np.concatenate([at, height[:, None]], 1)

    return f


def distances_to(pivots: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)))


def eliminate(q: np.ndarray, q_ids, x: np.ndarray, x_ids, pivots: np.ndarray, k: int, counts: list | None = None):
    """Exact k best by inner product of integer vectors.

    Half of |q|² + |x|² - |q - x|² is the score. Distances to the pivots, computed once for each row,
    bound |q - x| from below: candidates are evaluated in the order of the bound that this gives
    their score, until the next bound is below the k-th score found. counts gets the evaluated."""
    pivots = independent(pivots)
    place = simplex(pivots)
    table, own = place(distances_to(pivots, x)), place(distances_to(pivots, q))
    norms, q_norms = (x * x).sum(1), (q * q).sum(1)
    table_squares, own_squares = (table * table).sum(1), (own * own).sum(1)
    for a in range(0, len(q), BOUND_QUERIES):
        part = slice(a, a + BOUND_QUERIES)
        lower = np.maximum(0.0, own_squares[part, None] + table_squares[None] - 2 * (own[part] @ table.T))
        sums = q_norms[part, None] + norms[None]
        bounds = (sums - lower) / 2 + 1e-6 * sums + 1e-6  # and rounding
        bounds[x_ids[None] == q_ids[part, None]] = -np.inf
        for i, bound in enumerate(bounds, a):
            ids, scores, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 64
            rest = np.flatnonzero(bound > -np.inf)
            while len(rest):
                if len(ids) >= k:
                    rest = rest[bound[rest] >= scores[-1]]
                if not len(rest):
                    break
                if len(rest) > step:
                    order = np.argpartition(-bound[rest], step - 1)
                    now, rest = rest[order[:step]], rest[order[step:]]
                else:
                    now, rest = rest, rest[:0]
                at += len(now)
                ids, scores = np.concatenate([ids, x_ids[now]]), np.concatenate([scores, x[now] @ q[i]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores, step = ids[best], scores[best], step * 2
            if counts is not None:
                counts.append(at)
            yield q_ids[i], ids, np.round(scores).astype(np.int64)


def exact_top_k(vectors: DataFrame, query="vec_id % 50 = 0", k: int = 5, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of floor(scale * x).

    Pivots are the vectors of `pivots` rows of lowest hash, or fewer, at most as many as there are rows. Scores are exact while sums of products
    stay below 2**53."""
    rows = cut(valid(vectors).select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
    chosen = _matrix([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()], dim)

    def within(q, q_ids, x, x_ids):
        return eliminate(q, q_ids, x, x_ids, chosen, k)

    return _search(rows, F.expr(query), k, within, "long")


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 3e-4."""
    return 0.5 * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))


class Hashes:
    """TABLES p-stable hash tables of PROJECTIONS projections for candidates lengthened by the component that
    makes all norms equal to the largest, queries by a zero: the nearest has the largest inner product.

    near: the cosine, so lengthened, between a query and a neighbour that is to be met; extra: the
    lengthening component of most rows, over the largest norm. Projections are taken from what it gives
    them all. Those of such a neighbour are normal around near times the query's own, those of any row around
    zero, which gives each bucket's chances of holding the one and the other."""

    def __init__(self, dim: int, largest: float, near: float, extra: float):
        rng = np.random.default_rng(20)
        self.a = rng.standard_normal((dim + 1, TABLES * PROJECTIONS))
        self.shift = rng.random(TABLES * PROJECTIONS) - 0.5
        self.scale = math.sqrt(max(1e-6, 1 - extra * extra))
        self.largest, self.near, self.extra = largest, min(0.999, near / self.scale), extra
        self.powers = LEVELS ** np.arange(PROJECTIONS)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """[rows, TABLES]: the bucket of each candidate."""
        rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1) / self.largest**2)) - self.extra
        at = (x @ self.a[:-1] / self.largest + rest[:, None] * self.a[-1]) / self.scale
        level = np.clip(np.floor(at / WIDTH + self.shift) + LEVELS // 2, 0, LEVELS - 1).astype(np.int64)
        return level.reshape(len(x), TABLES, PROJECTIONS) @ self.powers

    def _chances(self, centre: np.ndarray, spread: float) -> np.ndarray:
        """[rows, projections, LEVELS] of normal projections around the rows' centres."""
        edge = (np.arange(1, LEVELS)[None, :] - LEVELS // 2 - self.shift[:, None]) * WIDTH
        below = _normal((edge[None] - centre[:, :, None]) / spread)
        one = np.zeros((*below.shape[:2], 1))
        return np.diff(np.concatenate([one, below, one + 1], 2), axis=2)

    def _of_buckets(self, chances: np.ndarray, table: int, buckets: np.ndarray) -> np.ndarray:
        out = np.ones((len(chances), len(buckets)))
        for j in range(PROJECTIONS):
            out *= chances[:, table * PROJECTIONS + j, buckets // self.powers[j] % LEVELS]
        return out

    def probes(self, q: np.ndarray, held: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(table, places in q, places in held[table]): the buckets to visit.

        A query's home bucket and the perturbed ones around it are taken in the order of their estimated
        success, the chance of holding a neighbour over that of holding any row, among the buckets that
        hold rows, until the chances of all tables add up to SUCCESS."""
        own = self.near * ((q / np.sqrt((q * q).sum(1))[:, None]) @ self.a[:-1])
        theirs, any_row = self._chances(own, math.sqrt(1 - self.near**2)), self._chances(np.zeros((1, TABLES * PROJECTIONS)), 1.0)
        each = 1 - (1 - SUCCESS) ** (1 / TABLES)
        for t, of in enumerate(held):
            p = self._of_buckets(theirs, t, of)
            order = np.argsort(-p / np.maximum(self._of_buckets(any_row, t, of), 1e-12), axis=1, kind="stable")
            reached = np.cumsum(np.take_along_axis(p, order, 1), 1)
            take = np.concatenate([np.ones((len(q), 1), bool), reached[:, :-1] < each], 1)
            i, r = np.nonzero(take)
            yield t, i, order[i, r]


def _rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """A matrix of a list column, rows filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, each candidate once."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])  # equal scores: copies of a candidate are neighbours
    q, ids, scores = q[new], ids[new], scores[new]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
    return q[keep], ids[keep], scores[keep]


def score_buckets(batches, dim: int, k: int, met: bool = False):
    """batches sorted by bucket, then candidates before queries: each query's best among those it meets there.

    Candidates of one bucket are held (CHUNK or so), queries stream past them. Best rows are merged from
    bucket to bucket, MERGE at most. With met, only (query, candidates met) counts."""
    now, held_ids, held = None, np.zeros(0, np.int64), np.zeros((0, dim))
    out, n = [], 0
    for batch in batches:
        bucket, kind, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "kind", "vec_id"))
        v = _rows_of(batch.column("v"), dim)
        change = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])])) if len(bucket) else []
        for a, b in zip(change, [*change[1:], len(bucket)], strict=True):
            if bucket[a] != now:
                now, held_ids, held = bucket[a], np.zeros(0, np.int64), np.zeros((0, dim))
            if kind[a] == 0:
                held_ids, held = np.concatenate([held_ids, ids[a:b]]), np.concatenate([held, v[a:b]])
                continue
            for c in range(a, b, 256):
                d = min(b, c + 256)
                if not len(held_ids):
                    continue
                own = held_ids[None] != ids[c:d, None]
                if met:
                    out.append((np.repeat(ids[c:d], own.sum(1)), np.broadcast_to(held_ids, own.shape)[own], np.zeros(int(own.sum()))))
                else:
                    scores = np.where(own, v[c:d] @ held.T, -np.inf)
                    some = min(len(held_ids), k + 8)  # a few more, as the product of matrices rounds otherwise
                    near = np.argpartition(-scores, some - 1, axis=1)[:, :some]
                    least = np.take_along_axis(scores, near, 1).min(1)
                    # ties at the edge: all that equal the least, up to rounding
                    i, j = np.nonzero((scores >= least[:, None] - 1e-12 * (1 + np.abs(least[:, None]))) & own)
                    exact = np.einsum("ij,ij->i", held[j], v[c:d][i])
                    out.append(_best(ids[c:d][i], held_ids[j], exact, k))
                n += len(out[-1][0])
            if n > MERGE and not met:
                out = [_best(*(np.concatenate(x) for x in zip(*out, strict=True)), k)]
                n = len(out[0][0])
                if n > MERGE // 2:  # many queries: what there is goes on
                    yield out.pop()
                    n = 0
    if out:
        merged = tuple(np.concatenate(x) for x in zip(*out, strict=True))
        yield merged if met else _best(*merged, k)


def _pilots(rows: DataFrame, query, k: int, dim: int, largest: float) -> tuple[float, float]:
    """How near, as a cosine between lengthened vectors, the k-th neighbour of a query is, and the typical
    lengthening component: from PILOTS queries against all rows, of which the tenth part has none
    nearer (many queries may be copies, whose neighbours are), and the mean of the rows."""
    pilots = [(r.vec_id, r.v) for r in rows.where(query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOTS).collect()]
    if not pilots:
        return 0.5, 0.0
    ids, q = np.array([a for a, _ in pilots]), _matrix([v for _, v in pilots], dim)
    q = q / np.sqrt((q * q).sum(1))[:, None]

    def run(batches):
        held, extras = np.zeros((len(q), 0)), []
        for batch in batches:
            x = _rows_of(batch.column("v"), dim)
            extras.append(np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1) / largest**2)))
            s = np.where(ids[:, None] == batch.column("vec_id").to_numpy()[None], -np.inf, q @ x.T / largest)
            held = -np.sort(-np.concatenate([held, s], 1), axis=1)[:, :k]
        if extras:
            e = np.concatenate(extras)
            yield pa.RecordBatch.from_pylist([{"s": h[np.isfinite(h)].tolist(), "e": float(e.sum()), "n": len(e)} for h in held])

    got = rows.mapInArrow(run, "s array<double>, e double, n long").collect()  # PILOTS rows a task
    parts = len(got) // len(pilots)
    kth = [sorted((x for p in range(parts) for x in got[p * len(pilots) + i].s), reverse=True)[:k] for i in range(len(pilots))]
    lasts = sorted(x[-1] for x in kth if x)
    extra = sum(r.e for r in got) / max(1, sum(r.n for r in got))
    return (min(0.999, max(0.0, lasts[len(lasts) // 10])) if lasts else 0.5), min(0.999, extra)


def _met(rows: DataFrame, query, k: int, counted: bool = False) -> DataFrame:
    """(query_id, vec_id, score): each query's best of the buckets that it probes, from each task that it meets."""
    spark = rows.sparkSession
    largest, dim = rows.agg(F.max(F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + cast(x as double) * x))")), F.max(F.size("v"))).first()
    largest, dim = float(largest or 1.0), dim or 1
    hashes = Hashes(dim, largest, *_pilots(rows, query, k, dim, largest))
    kind = rows.schema["v"].dataType.simpleString()

    def home(batches):
        for batch in batches:
            of = hashes.buckets(_rows_of(batch.column("v"), dim)) + np.arange(TABLES) * LEVELS**PROJECTIONS
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(pa.array(np.arange(0, of.size + 1, TABLES, dtype=np.int32)), pa.array(of.ravel()))], names=["vec_id", "v", "buckets"])

    homes = cut(rows.mapInArrow(home, f"vec_id long, v {kind}, buckets array<long>"))
    sizes = homes.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    # at most TABLES * LEVELS ** PROJECTIONS numbers, whatever the input
    chunks = {r.b: -(-r.n // CHUNK) for r in sizes.collect()}
    held = [np.array(sorted(b - t * LEVELS**PROJECTIONS for b in chunks if b // LEVELS**PROJECTIONS == t), np.int64) for t in range(TABLES)]

    def ask(batches):
        for batch in batches:
            ids, v = batch.column("vec_id").to_numpy(), batch.column("v")
            q = _rows_of(v, dim)
            for a in range(0, len(ids), 512):
                part = q[a : a + 512]
                for t, i, at in hashes.probes(part, held):
                    buckets = held[t][at] + t * LEVELS**PROJECTIONS
                    for c in range(0, len(i), 8192):
                        own = pa.array(i[c : c + 8192] + a)
                        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(own), v.take(own), pa.array(buckets[c : c + 8192])], names=["vec_id", "v", "b"])

    asked = rows.where(query).mapInArrow(ask, f"vec_id long, v {kind}, b long")
    parts = spark.createDataFrame(list(chunks.items()) or [(-1, 1)], "b long, chunks long")
    most = 1 << 20  # chunks that a bucket's number leaves room for
    asked = asked.join(F.broadcast(parts), "b").select(F.explode(F.expr(f"sequence(b * {most}, b * {most} + chunks - 1)")).alias("bucket"), F.lit(1).alias("kind"), "vec_id", "v")
    there = homes.select("vec_id", "v", F.explode("buckets").alias("b")).join(F.broadcast(parts), "b")
    there = there.select((F.col("b") * most + F.pmod(F.xxhash64("vec_id"), "chunks")).alias("bucket"), F.lit(0).alias("kind"), "vec_id", "v")

    def run(batches):
        for q, ids, scores in score_buckets(batches, dim, k, counted):
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    dealt = there.union(asked).repartition("bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def _usable(vectors: DataFrame) -> DataFrame:
    return cut(valid(vectors).where(F.exists("v", lambda x: x != 0)))


def nearest(vectors: DataFrame, query="vec_id % 20 = 0", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): k nearest by inner product, approximately; zero vectors take no part.

    A query gets fewer only where there are fewer candidates, and then all: one that meets fewer than k in
    its buckets is held against all rows."""
    rows = _usable(vectors)
    condition = F.expr(query)
    found = cut(_met(rows, condition, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    whole = found.groupBy("query_id").agg(F.count("*").alias("n")).where(f"n >= {k}").select("query_id")
    short = cut(rows.where(condition).join(whole, F.col("vec_id") == F.col("query_id"), "left_anti").select("vec_id", "v"))
    if short.isEmpty():
        return ranked

    def within(q, q_ids, x, x_ids):
        for i in range(len(q)):
            own = (x * q[i]).sum(1)
            best = np.lexsort((x_ids, -own))
            best = best[x_ids[best] != q_ids[i]][:k]
            yield q_ids[i], x_ids[best], own[best]

    marked = rows.join(short.select(F.col("vec_id").alias("of")), F.col("vec_id") == F.col("of"), "left").select("vec_id", "v", F.col("of").isNotNull().alias("short"))
    rest = _search(cut(marked), F.col("short"), k, within, "double")
    return ranked.join(whole, "query_id").select(*ranked.columns).unionByName(rest)


def share_met(vectors: DataFrame, query="vec_id % 20 = 0", k: int = 20) -> float:
    """The part of a query's candidates that nearest() scores, on average."""
    rows = _usable(vectors)
    pairs = _met(rows, F.expr(query), k, True).select("query_id", "vec_id").distinct().count()
    return pairs / max(1, rows.where(query).count() * (rows.count() - 1))
