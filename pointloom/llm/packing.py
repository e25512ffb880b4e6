"""Sequence packing by minimum bin slack.

Documents become token ids, are cut only where longer than a sequence, and the pieces are counted by
length: at most `capacity` numbers, whatever the input. The plan is made on that histogram: bitset
subset sums over the available lengths find the fullest feasible bin, which is taken as often as the
histogram allows and then removed. Pieces are ranked within their length, and a rank's place in the
plan is its sequence and offset; ranks are counted in blocks, so that a length that most pieces have
is spread over tasks.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import resident, words
from .spark_util import cut, short_batches

CAPACITY = 2048
#: Pieces that a worker remembers, the bits of their table's places (over twice as many), and pieces looked up at once.
CACHE_PIECES, BITS, PIECES = 1_200_000, 22, 1 << 18
#: What a tokenizer must have for pieces of words to be encoded alone (fixed values).
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _DIGIT, _OTHER, _WORD = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _LETTER
#: A byte-level vocabulary's letters: bytes that print stand for themselves, the others for those from 256 on, in order.
_PRINTS = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_LETTERS = {b: b for b in _PRINTS} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_PRINTS))}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Tokens:
    """The ids of pieces of text, found by the pieces' hashes in an open-addressing table; forgets all when full.

    With PATTERN and NORMALIZERS a tokenizer never looks across white space. A word (a run of bytes other than
    ASCII white space) of printable ASCII and the letters from U+00C0 to U+00FF is cut as PATTERN cuts it, folded
    to lower case, and its pieces go to the merging alone; one with other characters, an apostrophe or a
    character that begins a special token is encoded as a whole. Other tokenizers get whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normalizers = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_piece = normalizers == NORMALIZERS and split.get("pattern") == {"Regex": PATTERN} and split.get("behavior") == "Removed"
        self.odd = np.zeros(256, bool)  # bytes whose words are encoded as a whole
        self.odd[:9] = self.odd[14:32] = self.odd[127:] = True
        self.odd[[39, *(t["content"].encode()[0] for t in spec.get("added_tokens", []))]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(1 << BITS, np.uint64), np.zeros(1 << BITS, np.int32)
        self.ends, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)  # a slot's ids end where the next one's begin

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def piece(self, raw: bytes) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(raw.decode("latin-1").translate(_LETTERS))]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Of each hash its slot, or -1."""
        at = (h >> np.uint64(64 - BITS)).astype(np.int64)
        key = self.keys[at]
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << BITS) - 1)
            key = self.keys[at[open_]]
            open_ = open_[(key != h[open_]) & (key != 0)]
        return np.where(self.keys[at] == h, self.slots[at], -1)

    def learn(self, h: np.ndarray, ids: list[list[int]]) -> None:
        """Takes in the ids of distinct unknown hashes."""
        at, todo, slot = (h >> np.uint64(64 - BITS)).astype(np.int64), np.arange(len(h)), np.arange(len(h)) + len(self.ends) - 1
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            _, one = np.unique(at[free], return_index=True)
            own = free[one]
            self.keys[at[own]], self.slots[at[own]] = h[own], slot[own]
            todo = todo[self.keys[at[todo]] != h[todo]]
            at[todo] = (at[todo] + 1) & ((1 << BITS) - 1)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in ids])])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.uint32)])

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """The bytes, folded but for whole words; each piece's begin and end; whether it is a whole word; and the pieces before each row."""
        starts, ends, _ = words.spans(data, offsets)
        kind = _CLASS[data]
        if not len(starts):
            return data, starts, ends, np.zeros(0, bool), np.zeros(len(offsets), np.int64)
        odd = self.odd[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        lead = lead[(after != 0x97) & (after != 0xB7)]  # the signs of times and division are no letters
        odd[lead] = odd[lead + 1] = False
        folded = data.copy()
        folded[(data >= 65) & (data <= 90)] += 32
        folded[lead[data[lead + 1] < 0x9F] + 1] += 32
        whole = np.flatnonzero(np.logical_or.reduceat(odd, starts))
        if len(whole):
            long = ends[whole] - starts[whole]
            at = np.arange(long.sum()) + np.repeat(starts[whole] - np.cumsum(long) + long, long)
            kind[at], folded[at] = _WORD, data[at]
        begins = kind != _SPACE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins[starts] = True  # a row's first word may touch the last of the row before
        begin = np.flatnonzero(begins)
        of = np.searchsorted(starts, begin, side="right") - 1
        end = np.minimum(np.append(begin[1:], len(data)), ends[of])
        return folded, begin, end, kind[begin] == _WORD, np.searchsorted(begin, offsets)

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by a 0, as little-endian unsigned 32-bit numbers, and the rows' offsets."""
        if not self.by_piece:
            ids = [[*self.whole(text or ""), 0] for text in column.to_pylist()]
            return np.array([i for x in ids for i in x], "<u4"), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        data, begin, end, whole, rows = self.cut(*words.utf8(column))
        parts, counts = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for a in range(0, len(begin), PIECES):
            own = slice(a, a + PIECES)
            ids, count = self._of(data, begin[own], end[own], whole[own])
            parts.append(ids)
            counts.append(count)
        ids, before = np.concatenate(parts), np.cumsum(np.concatenate(counts))[rows]
        out = np.zeros(len(ids) + len(rows) - 1, "<u4")
        out[np.arange(len(ids)) + np.repeat(np.arange(len(rows) - 1), np.diff(before))] = ids
        return out, before + np.arange(len(rows))

    def _of(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces, one after the other, and how many each has."""
        h = words.hash_spans(data, begin, end, fold=False)
        h[h == 0] = 1  # 0 marks a free place
        slot = self.find(h)
        unknown = np.flatnonzero(slot < 0)
        if len(unknown):
            new, first = np.unique(h[unknown], return_index=True)
            if len(self.ends) + len(new) > CACHE_PIECES + 1:
                self.forget()
                unknown = np.arange(len(h))
                new, first = np.unique(h, return_index=True)
            first = unknown[first]
            spelt = [data[a:b].tobytes() for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
            self.learn(new, [self.whole(raw.decode()) if is_word else self.piece(raw) for raw, is_word in zip(spelt, whole[first].tolist(), strict=True)])
            slot[unknown] = self.find(h[unknown])
        start = self.ends[slot]
        count = self.ends[slot + 1] - start
        return self.ids[np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)], count


def _tokens(path: str) -> _Tokens:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return resident.keep(("tokens", path), lambda: _Tokens(path))


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a closing 0, cut every `capacity`."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        for batch in batches:
            for part in words.slices(batch, "text"):
                doc, number, start, length, crc = [], [], [], [], []
                ids, rows = _tokens(path).rows(part.column("text"))
                raw = memoryview(ids).cast("B")
                for i, a, b in zip(part.column("doc_id").to_pylist(), rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                    for k, at in enumerate(range(a, b, capacity)):
                        to = min(at + capacity, b)
                        doc.append(i)
                        number.append(k)
                        start.append(at - a)
                        length.append(to - at)
                        crc.append(zlib.crc32(raw[4 * at : 4 * to]))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, _PIECES)


def _fullest(counts: list[int], capacity: int) -> list[int]:
    """Lengths of the fullest bin that the histogram allows, longest first; each length up to its count.

    Sums reachable are bits of an integer, one integer for each length taken into account; walking
    them back finds the lengths. It stops taking lengths in once the bin is full. The longest length
    left is always taken, so that long pieces don't remain for last."""
    top = max(n for n in range(1, capacity + 1) if counts[n])
    room = capacity - top
    limit = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in range(min(room, top), 0, -1):
        left = counts[n] - (n == top)
        k = 1
        left = min(left, room // n)
        while left > 0:  # binary splitting: 1, 2, 4, ... copies
            take = min(k, left)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & limit
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, [top]
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            out += [n] * take
            total -= n * take
    return sorted(out, reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths of a bin), together using each length exactly as often as the histogram says.

    Each entry exhausts a length for bins of its kind, so there are few, whatever the counts."""
    counts = [0] * (capacity + 1)
    for n, c in histogram.items():
        counts[n] = c
    out = []
    while any(counts):
        bin_ = _fullest(counts, capacity)
        used = {n: bin_.count(n) for n in bin_}
        times = min(counts[n] // u for n, u in used.items())
        for n, u in used.items():
            counts[n] -= times * u
        out.append((times, bin_))
    return out


def _places(plans: list[tuple[int, list[int]]]):
    """For each length: first ranks, sequences, copies in a bin and offsets of the plan's entries."""
    at: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, bin_ in plans:
        offset = 0
        for n in dict.fromkeys(bin_):
            u = bin_.count(n)
            at.setdefault(n, []).append((ranks.get(n, 0), sequence, u, offset))
            ranks[n] = ranks.get(n, 0) + times * u
            offset += n * u
        sequence += times
    return {n: np.array(v, np.int64).T for n, v in at.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, block: int = 50_000) -> DataFrame:
    """Every piece of docs with its sequence_id and offset; see pieces() for the other columns.

    Null text is empty (one token, the closing 0). Rows that repeat a doc_id are packed as rows of
    their own; a null doc_id is kept. Ties in length are ranked by hash, doc_id, piece. Sequences are
    gapless from offset 0. Other columns are ignored; empty in, empty out."""
    with short_batches(docs.sparkSession):
        cutted = cut(pieces(docs, capacity, tokenizer))
    sizes = {int(r.length): int(r.c) for r in cutted.groupBy("length").agg(F.count("*").alias("c")).collect()}  # capacity rows at most
    places = _places(plan(sizes, capacity))
    blocks = max(1, -(-sum(sizes.values()) // block))
    ranked = cutted.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy("length", "b").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    inside = Window.partitionBy("length", "b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = ranked.withColumn("r", F.row_number().over(inside) - 1).join(starts, ["length", "b"]).withColumn("rank", F.col("before") + F.col("r"))

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first, seq, u, off = places[int(n)]
                k = np.searchsorted(first, rank[own], side="right") - 1
                inner = rank[own] - first[k]
                sequence[own] = seq[k] + inner // u[k]
                offset[own] = off[k] + inner % u[k] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, _PIECES + ", sequence_id long, offset long")
