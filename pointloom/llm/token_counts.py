"""Token counts under a unigram tokenizer, by trie-shared dynamic programming.

A pre-token is a maximal run of non-space, read as UTF-8 bytes after a word-begin mark. The distinct
pre-tokens of a slice are inserted in a trie, level by level; the best score of a segmentation of a
prefix is computed once for its node, from its ancestors, and the node where a pre-token ends stores
its count. Terminal counts are kept from slice to slice, up to KEPT of them.

The trie is LONGEST levels deep, which is the longest piece too; what a longer pre-token has below that is a
path without branches. The same recurrence goes on there from the node's scores, in blocks of TAIL
bytes side by side: each is first scored as if a token began with it, then again from the scores that the block
before it really ended with, up to where the last LONGEST scores differ by one constant from the first
ones', which is then added to the rest. So scores are those of the whole pre-token, whatever its length.

Pieces are those of a public vocabulary file, whose scores are ranks; a piece's unigram score is the
Zipf law's log probability of its rank, in ten-thousandths (so sums are exact). Any byte is a token at
BYTE_SCORE. Of segmentations with the best score the one with the fewest tokens counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

MARK = "▁".encode()
UNIT = 10_000
#: A combined value is score * COUNT - tokens: the greatest has the best score, then the fewest tokens.
COUNT = 1 << 16
LONGEST, CHUNK, KEPT = 64, 50_000, 1_000_000
_R = np.uint64(0xD6E8FEB86659FD93)
_V = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.int64(-(1 << 62))
TAIL, TAIL_BLOCKS = 512, 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """pieces: combined values by bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranked = sorted(usual, key=lambda i: (-sp.get_score(i), i))
        self.byte = self._value(len(ranked), 10)
        self.pieces = {sp.id_to_piece(i).encode(): self._value(rank) for rank, i in enumerate(ranked)}
        for b in range(256):
            self.pieces.setdefault(bytes([b]), self.byte)
        keys = list(self.pieces)
        self.sizes = sorted({len(k) for k in keys if len(k) <= LONGEST})
        h = np.array([self.hash(k) for k in keys], np.uint64)
        order = np.argsort(h)
        self.hashes, self.values = h[order], np.array([self.pieces[k] for k in keys], np.int64)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.window = self.sizes[-1]
        self.powers = np.array([pow(int(_R), n, 1 << 64) for n in range(LONGEST + 1)], np.uint64)

    @staticmethod
    def _value(rank: int, less: float = 0) -> int:
        return -round(UNIT * (math.log(rank + 2) + less)) * COUNT - 1

    @staticmethod
    def hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_R) + int(_V[b])) & 0xFFFFFFFFFFFFFFFF
        return h

    def lookup(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), _NONE)
        some = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.hashes, h[some])
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == h[some]
        out[some[hit]] = self.values[at[hit]]
        return out

    def one(self, word: bytes) -> tuple[int, int]:
        """Tokens and score of one pre-token, by plain dynamic programming on pairs: what tests hold many() against."""
        text = MARK + word
        best: list[tuple[int, int]] = [(0, 0)]
        for i in range(1, len(text) + 1):
            top = None
            for n in self.sizes:
                if n > i:
                    break
                v = self.pieces.get(text[i - n : i])
                if v is not None:
                    score, less = best[i - n]
                    way = (score - (-v // COUNT), less - 1)
                    if top is None or way > top:
                        top = way
            best.append(top)
        return -best[-1][1], best[-1][0]

    def many(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and scores of pre-tokens, by a trie of them all and, below it, by tails()."""
        order = np.argsort(-sizes, kind="stable")
        starts, whole = starts[order], sizes[order] + len(MARK)
        sizes = np.minimum(whole, LONGEST)
        n, deep = len(starts), int(sizes[0])
        prefix, best = np.zeros((deep + 1, n), np.uint64), np.zeros((deep + 1, n), np.int64)
        live = np.searchsorted(-sizes, -np.arange(deep + 1), side="right")
        for d in range(1, deep + 1):
            m = live[d]
            byte = np.full(m, MARK[d - 1], np.uint8) if d <= len(MARK) else data[starts[:m] + (d - 1 - len(MARK))]
            prefix[d, :m] = prefix[d - 1, :m] * _R + _V[byte]
            _, node, of = np.unique(prefix[d, :m], return_index=True, return_inverse=True)
            own, top = prefix[d, node], np.full(len(node), _NONE)
            for k in self.sizes:
                if k > d:
                    break
                value = self.lookup(own - prefix[d - k, node] * self.powers[k])
                hit = np.flatnonzero(value != _NONE)
                top[hit] = np.maximum(top[hit], best[d - k, node[hit]] + value[hit])
            best[d, :m] = top[of]
        value = best[sizes, np.arange(n)]
        tokens, scores = np.empty(n, np.int64), np.empty(n, np.int64)
        tokens[order], scores[order] = self.apart(value)
        long = int(np.searchsorted(-whole, -LONGEST, side="left"))
        if long:
            last = (best[-self.window :, :long] - best[-1, :long]).T
            more = self.tails(data, starts[:long], whole[:long], last)
            tokens[order[:long]] += more[0]
            scores[order[:long]] += more[1]
        return tokens, scores

    @staticmethod
    def apart(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens and scores of combined values of fewer than COUNT tokens."""
        return (-value) % COUNT, -((-value) // COUNT)

    def _step(self, best: np.ndarray, prefix: np.ndarray, rows: np.ndarray, at: np.ndarray, i: int) -> None:
        """best[rows, i] from the columns before; at: the rows' places in prefix."""
        own, top = prefix[at, i], np.full(len(rows), _NONE)
        for k in self.sizes:
            value = self.lookup(own - prefix[at, i - k] * self.powers[k])
            hit = np.flatnonzero(value != _NONE)
            top[hit] = np.maximum(top[hit], best[rows[hit], i - k] + value[hit])
        best[rows, i] = top

    def tails(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and scores of what follows byte LONGEST of pre-tokens of `sizes` bytes with their mark.

        last: the window (as many scores as the longest piece has bytes) up to there, less its last one."""
        w = self.window
        count = -(-(sizes - LONGEST) // TAIL)
        of = np.repeat(np.arange(len(sizes)), count)
        number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        begin = LONGEST + number * TAIL
        size = np.minimum(TAIL, sizes[of] - begin)
        tokens, scores = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        fresh = np.full(w, _NONE)
        fresh[-1] = 0
        for lo in range(0, len(of), TAIL_BLOCKS):
            own = slice(lo, lo + TAIL_BLOCKS)
            o, n, m = of[own], size[own], len(of[own])
            # column i stands for byte begin - w + i of the pre-token; columns 1 .. w are the window before the block
            at = begin[own, None] - w + np.arange(w + TAIL)
            byte = data[np.clip(starts[o, None] + at - len(MARK), 0, len(data) - 1)]
            for i, b in enumerate(MARK):
                byte[at == i] = b
            prefix = np.zeros((m, w + TAIL + 1), np.uint64)
            for i in range(w + TAIL):
                prefix[:, i + 1] = prefix[:, i] * _R + _V[byte[:, i]]
            best = np.full((m, w + TAIL + 1), _NONE)
            best[:, 1 : w + 1] = fresh
            heads = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            best[heads, 1 : w + 1] = last[o[heads]]
            every = np.arange(m)
            for i in range(w + 1, w + int(n.max()) + 1):
                self._step(best, prefix, every, every, i)
            ends = lambda rows: self._window(best, rows, w + n[rows])
            again = np.setdiff1d(every, heads)
            while len(again):
                new = np.full((len(again), w + TAIL + 1), _NONE)
                new[:, 1 : w + 1] = ends(again - 1)
                before, live, changed = ends(again), np.arange(len(again)), []
                i = w
                while len(live):
                    i += 1
                    self._step(new, prefix, live, again[live], i)
                    over = n[again[live]] == i - w
                    if (i - w) % 8 == 0 or over.any():
                        rows = again[live]
                        same = (self._window(new, live, np.full(len(live), i)) == self._window(best, rows, np.full(len(live), i))).all(1)
                        for k in np.flatnonzero(same | over):
                            r, x = rows[k], new[live[k]]
                            if same[k]:
                                best[r, i + 1 :] += x[i] - best[r, i]
                            best[r, : i + 1] = x[: i + 1]
                            if not same[k]:
                                changed.append(live[k])
                        live = live[~(same | over)]
                changed = np.array(changed, np.int64)
                changed = changed[(ends(again[changed]) != before[changed]).any(1)]
                follows = again[changed] + 1
                again = follows[(follows < m) & ~np.isin(follows, heads)]
            got = self.apart(best[every, w + n])
            np.add.at(tokens, o, got[0])
            np.add.at(scores, o, got[1])
            last[o[-1]] = ends(np.array([m - 1]))[0]
        return tokens, scores

    def _window(self, best: np.ndarray, rows: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The scores up to column end of each row, less the last of them."""
        out = best[rows[:, None], end[:, None] - np.arange(self.window - 1, -1, -1)] - best[rows, end][:, None]
        out[out < _NONE >> 1] = _NONE
        return out


class Counter:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.hashes, self.tokens, self.scores = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens, tokens and score (in units) of each row."""
        data, offsets = words.utf8(column)
        starts, ends, rows = words.spans(data, offsets)
        distinct, first, inverse = np.unique(words.hash_spans(data, starts, ends, fold=False), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        tokens, scores = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        tokens[known], scores[known] = self.tokens[at[known]], self.scores[at[known]]
        new = np.flatnonzero(~known)
        s, n = starts[first[new]], (ends - starts)[first[new]]
        for a in range(0, len(new), CHUNK):
            part = slice(a, a + CHUNK)
            tokens[new[part]], scores[new[part]] = self.vocabulary.many(data, s[part], n[part])
        if len(self.hashes) + len(new) > KEPT:
            self.hashes, self.tokens, self.scores = distinct, tokens, scores
        elif len(new):
            h = np.concatenate([self.hashes, distinct[new]])
            order = np.argsort(h, kind="stable")
            self.hashes, self.tokens, self.scores = h[order], np.concatenate([self.tokens, tokens[new]])[order], np.concatenate([self.scores, scores[new]])[order]
        total = np.zeros((2, len(inverse) + 1), np.int64)
        np.cumsum(tokens[inverse], out=total[0, 1:])
        np.cumsum(scores[inverse], out=total[1, 1:])
        return np.diff(rows), np.diff(total[0][rows]), np.diff(total[1][rows])


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, score) for every row of docs; score is the sum of log probabilities.

    Null and empty texts have no pre-token and count 0. Repeated rows stay; other columns are ignored;
    empty in, empty out. Pre-tokens of any length are whole."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        if path not in _counters:
            _counters[path] = Counter(path)
        counter = _counters[path]
        for batch in batches:
            for part in words.slices(batch, "text"):
                n, tokens, score = counter.count(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(tokens), pa.array(score / UNIT)], names=["doc_id", "n_words", "n_tokens", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_words long, n_tokens long, score double")
