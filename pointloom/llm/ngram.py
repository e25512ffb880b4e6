"""Language-model scoring with an Elias-Fano n-gram trie of order 3.

The trie has three levels: words t, their successors u, and the successors w of both, in shards by the hash of
t. A shard is one file in the shared folder. Its first level holds word hashes, cumulative counts and
pointers into the second as Elias-Fano sequences; the second, in each word's range, ascending 32-bit
keys, quantised probabilities, quantised back-off weights and Elias-Fano pointers into the third, which
holds keys and quantised probabilities. Scoring tasks memory-map the files and look words up by
Elias-Fano search and successors by binary search within their context's range. The node of (u, w) that
one token finds is the context of the next.

Absolute discounting, interpolated, over the V known words and one class of all others:
P(w | t, u) = max(c(t, u, w) - D3, 0) / c(t, u) + D3 n(t, u) / c(t, u) * P(w | u), n the distinct successors,
P(w | u) = max(c(u, w) - D2, 0) / c(u) + D2 n(u) / c(u) * P(w), and
P(w) = max(c(w) - D1, 0) / N + D1 V / N / (V + 1). Each adds up to one. A context that training hasn't seen
is left out. Rows begin after two BOS, which is no word, and end with END, which is one.

Counting tasks combine before the shuffle. Words that a bounded sample finds frequent have their
successors spread over all shards by the hash of (t, u); only these few words' counts reach the driver.
"""

from __future__ import annotations

import collections
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resident, words
from .elias_fano import EliasFano, encode
from .spark_util import checkpoint_dir, crc_bucket, cut

#: What is taken off the counts of words, pairs and trigrams; most of a large corpus's pairs occur once.
DISCOUNTS = D1, D2, D3 = 0.75, 0.95, 0.95
#: Tokens that a task counts at once before it hands counts on; bytes of text for a shard; bytes scored at once.
COUNT_TOKENS, SHARD_BYTES, SCORE_BYTES = 3_000_000, 16 << 20, 4 << 20
#: The sample that tells frequent words: about so many rows, so many characters of each; and at most so many words.
SAMPLE_ROWS, SAMPLE_CHARS, MOST_HOT = 512, 4_000, 256
#: Shards that a worker holds where the store isn't a file system that it can map.
FETCHED = 8
#: Steps of the codes: log10 probabilities from LEAST_LOG to 0.
LEAST_LOG, CODES = -12.0, 65535
BOS, END, PAD = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D), np.uint64(0x9FB21C651E98DF25)
_TOP = np.uint64(32)
_SALT = np.uint64(0xA24BAED4963EE407)


def key_of(h: np.ndarray) -> np.ndarray:
    return (words.mix(h) >> _TOP).astype(np.uint32)


_BOS, _END = (key_of(np.array([x]))[0] for x in (BOS, END))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row's words and then END, and the rows' offsets."""
    h, rows = words.hashed(column)
    at = rows + np.arange(len(rows))
    out = np.empty(len(h) + len(rows) - 1, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[at[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = h
    return out, at


def shard_of(t: np.ndarray, u: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of the second-level node (t, u): that of t, or for a frequent word (hot, ascending) that of both."""
    at = np.searchsorted(hot, t)
    at[at == len(hot)] = 0
    frequent = hot[at] == t
    h = words.mix(t ^ _SALT)
    h[frequent] = words.mix(h[frequent] + u[frequent])
    return ((h >> _TOP) * np.uint64(shards) >> _TOP).astype(np.int64)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, key of u, key of w) for each token w and the two before it; and one for each row's last word, END and PAD.

    So each word's and each pair's count is the sum of those of the successors."""
    h, at = tokens(column)
    rows = len(at) - 1
    begin = at[:-1] + 3 * np.arange(rows)  # a row is BOS, BOS, its tokens, PAD
    line = np.empty(len(h) + 3 * rows, np.uint64)
    own = np.ones(len(line), bool)
    line[begin], line[begin + 1] = BOS, BOS
    own[begin] = own[begin + 1] = False
    last = at[1:] + 3 * np.arange(1, rows + 1) - 1
    line[last] = PAD
    own[last] = False
    line[own] = h
    key = key_of(line)
    ends = np.ones(len(line), bool)  # where a trigram ends: from a row's third element on
    ends[begin] = ends[begin + 1] = False
    i = np.flatnonzero(ends)
    return line[i - 2], key[i - 1], key[i]


def counted(t: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray | None = None):
    """Distinct trigrams, ascending, and their counts: the words, for each pair its word's place and u, for
    each trigram its pair's place, w and the count."""
    first, rank = np.unique(t, return_inverse=True)
    pairs, rank = np.unique(rank.astype(np.uint64) << _TOP | u, return_inverse=True)
    triple = rank.astype(np.uint64) << _TOP | w
    if c is None:
        triple, c = np.unique(triple, return_counts=True)
    else:
        triple, rank = np.unique(triple, return_inverse=True)
        c = np.bincount(rank, c, len(triple)).astype(np.int64)
    low = np.uint64(0xFFFFFFFF)
    return first, (pairs >> _TOP).astype(np.int64), (pairs & low).astype(np.uint32), (triple >> _TOP).astype(np.int64), (triple & low).astype(np.uint32), c


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 on, mostly below 255: bytes, then the others."""
    big = x[x >= 255].astype(np.int64)
    return np.int64(len(big)).tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes() + big.tobytes()


def _read_small(blob: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    m = int(np.frombuffer(blob, np.int64, 1, at)[0])
    out = np.frombuffer(blob, np.uint8, n, at + 8).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, np.int64, m, at + 8 + n)
    return out, at + 8 + n + 8 * m


def _per(ranks: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(ranks, minlength=n)


def _count(shards: int, hot: np.ndarray):
    def emit(parts):
        first, of, u, pair, w, c = counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        shard = shard_of(first[of], u.astype(np.uint64), hot, shards)
        per, starts = _per(pair, len(u)), np.searchsorted(pair, np.arange(len(u)))
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        rows, blobs = [], []
        for s in range(shards):
            own = order[cuts[s] : cuts[s + 1]]
            if len(own):
                n = per[own]
                at = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
                new = np.concatenate([[True], of[own][1:] != of[own][:-1]])
                contexts = first[of[own][new]]
                rows.append(s)
                blobs.append(b"".join([np.array([len(contexts), len(own), len(at)], np.int64).tobytes(), contexts.tobytes(), _small(np.diff(np.append(np.flatnonzero(new), len(own)))), u[own].tobytes(), _small(n), w[at].tobytes(), _small(c[at])]))
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "counts"])

    def run(batches):
        resident.release()
        parts, n = [], 0
        for batch in batches:
            for part in words.slices(batch, "text"):
                parts.append(trigrams(part.column("text")))
                n += len(parts[-1][0])
                if n >= COUNT_TOKENS:
                    yield emit(parts)
                    parts, n = [], 0
        if parts:
            yield emit(parts)

    return run


def _decode(blob: bytes) -> tuple[np.ndarray, ...]:
    k, p, n = map(int, np.frombuffer(blob, np.int64, 3))
    contexts = np.frombuffer(blob, np.uint64, k, 24)
    pairs, at = _read_small(blob, k, 24 + 8 * k)
    u = np.frombuffer(blob, np.uint32, p, at)
    triples, at = _read_small(blob, p, at + 4 * p)
    w = np.frombuffer(blob, np.uint32, n, at)
    c, _ = _read_small(blob, n, at + 4 * n)
    return np.repeat(np.repeat(contexts, pairs), triples), np.repeat(u, triples), w, c


def code(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.round((log10 - LEAST_LOG) / -LEAST_LOG * CODES), 0, CODES).astype(np.uint16)


def decoded(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** (codes.astype(np.float64) / CODES * -LEAST_LOG + LEAST_LOG)


def _levels(t: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray, hot: np.ndarray) -> tuple[dict[str, np.ndarray], dict]:
    """A shard's arrays, and its numbers: words and tokens (those of frequent words apart), and the counts of these."""
    first, of, u, pair, w, c = counted(t, u, w, c)
    n_pairs = len(u)
    total, distinct = np.bincount(pair, c, n_pairs).astype(np.int64), _per(pair, n_pairs)
    # (BOS, BOS) is a context but no bigram; a pair that ends a row has no successor but PAD
    real = ~((first[of] == BOS) & (u == _BOS))
    context = np.bincount(of, total * real, len(first)).astype(np.int64)
    inner = u != _END
    stays = inner[pair]
    arrays = {}
    for name, values, universe in (
        ("words", first, 1 << 64),
        ("counts", np.cumsum(context).astype(np.uint64), int(context.sum()) + 1),
        ("pairs", np.cumsum(_per(of, len(first))).astype(np.uint64), n_pairs + 1),
        ("triples", np.cumsum(distinct * inner).astype(np.uint64), int(stays.sum()) + 1),
    ):
        arrays |= {f"{name}.{k}": v for k, v in encode(values, universe).items()}
    arrays |= {
        "second": u,
        "second.codes": code(np.log10(np.where(real, total - D2, 1e-12) / np.maximum(context[of], 1))),
        "second.back": code(np.log10(np.where(inner, D3 * distinct / total, 1.0))),
        "third": w[stays],
        "third.codes": code(np.log10((c[stays] - D3) / total[pair[stays]])),
    }
    frequent = np.isin(first, hot)
    some = np.flatnonzero(frequent)
    successors = np.bincount(of, real, len(first)).astype(np.int64)
    return arrays, {"n_words": int((~frequent).sum()), "n_tokens": int(context[~frequent].sum()), "hot": first[some].view(np.int64).tolist(), "hot_counts": context[some].tolist(), "hot_successors": successors[some].tolist()}


def serialise(arrays: dict[str, np.ndarray]) -> bytes:
    """A header with each array's type, place and length, and the arrays, 8 bytes aligned."""
    head, body, at = {}, [], 0
    for k, v in arrays.items():
        raw = v.tobytes()
        head[k] = [v.dtype.str, at, len(v)]
        body += [raw, b"\0" * (-len(raw) % 8)]
        at += len(raw) + -len(raw) % 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_BUILT = "shard long, n_words long, n_tokens long, hot array<long>, hot_counts array<long>, hot_successors array<long>"


def _build(uri: str, hot: np.ndarray):
    def run(batches):
        resident.release()
        parts: dict[int, list] = {}
        for batch in batches:
            for s, blob in zip(batch.column("shard").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                parts.setdefault(s, []).append(blob)
        for s in sorted(parts):
            arrays, numbers = _levels(*(np.concatenate(x) for x in zip(*map(_decode, parts.pop(s)), strict=True)), hot)
            store, folder = _store(uri)
            own = f"{folder}/.{s}-{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(serialise(arrays))
            store.move(own, f"{folder}/{s}.trie")
            yield pa.RecordBatch.from_pylist([{"shard": s} | numbers], schema=_BUILT_ARROW)

    return run


_BUILT_ARROW = pa.schema([(n, pa.int64() if k == "long" else pa.list_(pa.int64())) for n, k in (x.split() for x in _BUILT.split(", "))])


def _frequent(docs: DataFrame, rows: int, shards: int) -> np.ndarray:
    """BOS and the words that hold half a shard's share or more of a sample, at most MOST_HOT; ascending.

    The sample is the rows with a hash below what SAMPLE_ROWS of them are expected to have, and twice as many at
    most (rows may repeat an id); it decides where counts are kept, not what they are."""
    text = F.substring(F.col("text").cast("string"), 1, SAMPLE_CHARS).alias("text")
    below = min((1 << 63) - 1, (1 << 64) * SAMPLE_ROWS // max(1, rows) - (1 << 63))
    sample = docs.where(F.xxhash64(F.col("doc_id").cast("long")) <= F.lit(below)).select(text).where("text is not null").limit(2 * SAMPLE_ROWS).collect()
    h, _ = words.hashed(pa.array([r.text for r in sample], pa.string()))
    word, n = np.unique(h, return_counts=True)
    order = np.argsort(-n, kind="stable")[:MOST_HOT]
    order = order[n[order] * 2 * shards >= len(h)]
    return np.unique(np.append(word[order], BOS))


def train(docs: DataFrame) -> dict:
    """Counts the texts of docs and writes the trie; the model is its place, the shards that exist, the numbers of
    tokens and words, and the counts of the frequent words. Null text is the text of no words (one END).

    The files stay in the shared folder."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size, rows = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-size // SHARD_BYTES))
    hot = _frequent(texts, rows, shards)
    uri = f"{checkpoint_dir(spark)}/ngram-{uuid.uuid4().hex}"
    store, folder = _store(uri)
    store.create_dir(folder)
    counts = texts.select("text").mapInArrow(_count(shards, hot), "shard int, counts binary")
    rows = cut(counts.repartition(shards, "shard").mapInArrow(_build(uri, hot), _BUILT)).collect()  # a row a shard
    frequent: dict[int, list[int]] = {}
    for r in rows:
        for h, c, n in zip(r.hot, r.hot_counts, r.hot_successors, strict=True):
            have = frequent.setdefault(h, [0, 0])
            have[0] += c
            have[1] += n
    begins = frequent.get(int(np.array([BOS]).view(np.int64)[0]), [0, 0])[0]  # each row's END is counted by its BOS
    others = [c for h, (c, _) in frequent.items() if h != int(np.array([BOS]).view(np.int64)[0])]
    return {
        "uri": uri,
        "shards": shards,
        "present": sorted(r.shard for r in rows),
        "rows": begins,
        "tokens": sum(r.n_tokens for r in rows) + sum(others) + begins,
        "words": sum(r.n_words for r in rows) + len(others) + (begins > 0),
        "hot": hot.view(np.int64).tolist(),
        "frequent": frequent,
    }


class Shard:
    """One file: memory-mapped, or held where the store isn't a file system."""

    def __init__(self, uri: str, shard: int):
        store, folder = _store(uri)
        path = f"{folder}/{shard}.trie"
        self.mapped = type(store).__name__ == "LocalFileSystem"
        if self.mapped:
            raw = np.memmap(path, np.uint8, "r")
        else:
            with store.open_input_stream(path) as source:
                raw = np.frombuffer(source.read(), np.uint8)
        size = int(raw[:8].view("<i8")[0])
        head = json.loads(raw[8 : 8 + size].tobytes())
        get = lambda k: np.frombuffer(raw, head[k][0], head[k][2], 8 + size + head[k][1])
        level = lambda name: EliasFano({k: get(f"{name}.{k}") for k in ("meta", "low", "high", "ones")})
        self.words, self.counts, self.pairs, self.triples = map(level, ("words", "counts", "pairs", "triples"))
        self.second, self.second_codes, self.back = get("second"), get("second.codes"), get("second.back")
        self.third, self.third_codes = get("third"), get("third.codes")

    @staticmethod
    def _range(level: EliasFano, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = level.access(i).astype(np.int64)
        begin = np.where(i > 0, level.access(np.maximum(i - 1, 0)).astype(np.int64), 0)
        return begin, end

    def find(self, h: np.ndarray) -> np.ndarray:
        """[3, words]: of each word its count here (0 if unknown) and its successors' range."""
        i = self.words.find(h)
        known = i >= 0
        out = np.zeros((3, len(h)), np.int64)
        begin, end = self._range(self.counts, i[known])
        out[0, known] = end - begin
        out[1, known], out[2, known] = self._range(self.pairs, i[known])
        return out

    @staticmethod
    def search(keys: np.ndarray, begin: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The place of each key in its range of keys, or -1."""
        low, high = begin.copy(), end.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            less = keys[mid] < key[live]
            low[live[less]] = mid[less] + 1
            high[live[~less]] = mid[~less]
            live = live[low[live] < high[live]]
        out = np.full(len(key), -1, np.int64)
        ok = np.flatnonzero(low < end)
        ok = ok[keys[low[ok]] == key[ok]]
        out[ok] = low[ok]
        return out


class Trie:
    def __init__(self, model: dict):
        self.model, self.open, self.present = model, collections.OrderedDict(), set(model["present"])
        self.hot = np.array(model["hot"], np.int64).view(np.uint64)
        self.hot_counts = np.array([model["frequent"].get(h, (0, 0)) for h in model["hot"]], np.int64).reshape(-1, 2)

    def shard(self, s: int) -> Shard | None:
        if s not in self.present:
            return None
        if s not in self.open:
            self.open[s] = Shard(self.model["uri"], s)
            if not self.open[s].mapped and len(self.open) > FETCHED:
                self.open.popitem(last=False)
        return self.open[s]

    def _by_shard(self, shard: np.ndarray):
        order = np.argsort(shard.astype(np.int32), kind="stable")
        own = shard[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        for a, b in zip(starts, np.append(starts[1:], len(own)), strict=True):
            if part := self.shard(int(own[a])):
                yield part, order[a:b]

    def score(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        h, at = tokens(column)
        if len(at) < 2:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
        n, v, shards = self.model["tokens"], self.model["words"], self.model["shards"]
        distinct, inverse = np.unique(np.append(h, BOS), return_inverse=True)
        bos = int(inverse[-1])
        # of each distinct word: its count, its distinct successors, their range in its shard
        place = np.minimum(np.searchsorted(self.hot, distinct), len(self.hot) - 1)
        frequent = self.hot[place] == distinct
        count, fan, begin, end = np.zeros((4, len(distinct)), np.int64)
        count[frequent], fan[frequent] = self.hot_counts[place[frequent]].T
        cold = np.flatnonzero(~frequent)
        for part, rows in self._by_shard(shard_of(distinct[cold], np.zeros(len(cold), np.uint64), self.hot, shards)):
            own = cold[rows]
            count[own], begin[own], end[own] = part.find(distinct[own])
            fan[own] = end[own] - begin[own]
        key = key_of(distinct)
        # each row is BOS and its tokens; (word before, word) is a bigram, and the context of the next word
        rows = len(at) - 1
        first = at[:-1] + np.arange(rows)
        line = np.full(len(h) + rows, bos, np.int64)
        is_token = np.ones(len(line), bool)
        is_token[first] = False
        line[is_token] = inverse[:-1]
        before = np.empty_like(line)
        before[1:] = line[:-1]
        before[first] = bos
        last = np.append(first[1:], len(line)) - 1
        p2, p3, back = np.zeros((3, len(line)))
        for part, own in self._by_shard(shard_of(distinct[before], key[line].astype(np.uint64), self.hot, shards)):
            t = before[own]
            low, high, scale = begin[t], end[t], np.ones(len(own))
            some = np.flatnonzero(frequent[t])
            if len(some):  # a frequent word's successors are in many shards
                which, of = np.unique(t[some], return_inverse=True)
                here, low_, high_ = part.find(distinct[which])
                low[some], high[some] = low_[of], high_[of]
                scale[some] = here[of] / np.maximum(count[t[some]], 1)
            node = part.search(part.second, low, high, key[line[own]])
            hit = np.flatnonzero(node >= 0)
            node, where = node[hit], own[hit]
            p2[where] = decoded(part.second_codes[node]) * scale[hit]
            more = np.flatnonzero(~np.isin(where, last, assume_unique=True))
            node, where = node[more], where[more]
            back[where + 1] = decoded(part.back[node])
            low, high = part._range(part.triples, node)
            third = part.search(part.third, low, high, key[line[where + 1]])
            hit = np.flatnonzero(third >= 0)
            p3[where[hit] + 1] = decoded(part.third_codes[third[hit]])
        u = before[is_token]
        c = count[inverse[:-1]]
        c[h == END] = self.model["rows"]
        p = np.where(c > 0, c - D1, 0) / max(n, 1) + (D1 * v / n if n else 1.0) / (v + 1)
        p = p2[is_token] + np.where(count[u] > 0, D2 * fan[u] / np.maximum(count[u], 1), 1.0) * p
        seen = back[is_token] > 0
        p = np.where(seen, p3[is_token] + back[is_token] * p, p)
        base = np.log10((c + 1) / (n + v + 1))
        starts = at[:-1]
        return np.diff(at), np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Words are folded in A-Z; END closes each text and counts as a token; null text has END alone.
    base_score is add-one over the training counts, score the trie's log10 probability. Repeated rows
    stay; other columns are ignored; empty in, empty out; an untrained model knows nothing."""

    def run(batches):
        trie = resident.keep(("trie", model["uri"]), lambda: Trie(model))
        for batch in batches:
            for part in words.slices(batch, "text", SCORE_BYTES):
                n, known, base, own = trie.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), model["tokens"], np.int64)), pa.array(base), pa.array(own)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train_and_score(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod modulus isn't held_out (null ids learn), scores all."""
    held = F.coalesce(crc_bucket(F.col("doc_id").cast("long"), modulus) == held_out, F.lit(False))
    model = train(docs.where(~held))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), *out.columns[1:])
