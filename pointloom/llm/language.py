"""Language identification by cross-parsing entropy.

A suffix automaton of a bounded sample of labelled text per language accepts exactly the substrings
of that sample. A text is parsed greedily into phrases, each the longest match from where the last
one ended; the language that needs the fewest normalised phrases wins: a phrase costs the logarithm
of its sample's length, the bits of a pointer into it, so that unequal samples compare.

The automaton is completed with restart transitions, so that a parse is one table lookup a byte. Blocks of
BLOCK bytes are parsed side by side, each as if a phrase began with it; then each is parsed again
from the state in which the one before it really ended, beside its first parse, up to where both are in the
same state, and what the two counted differently is made good. That is repeated for blocks whose
end it changed, so the phrases are those of one parse of the whole text, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resident, words
from .spark_util import crc_bucket, cut

#: The sample: for each language the rows of lowest hash in this many hash classes, and so many bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES, ROW_BYTES = 64, 32_000, 1_000
#: At most so many languages are learned, those with the most labelled rows, and so many bytes of samples in all.
MOST_LANGS, ALL_BYTES = 256, 512_000
BLOCK = 512
#: A text whose best language matches fewer bytes than this a phrase is in no learned language.
LEAST_PHRASE = 1.5


def _symbols(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z folded, and everything in ASCII but letters made a space."""
    return _CLASS[data]


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[:128] = 32
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings of text; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return go


class CrossParser:
    """Phrase counts of byte blocks against each language's sample."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        texts = {k: _symbols(np.frombuffer(v, np.uint8)).tobytes() for k, v in samples.items()}
        seen = sorted(set().union(*[set(t) for t in texts.values()], {32}))
        self.code = np.full(256, len(seen), np.uint8)
        self.code[seen] = np.arange(len(seen))
        self.code = self.code[_CLASS]
        width = self.width = len(seen) + 1
        at = {c: i for i, c in enumerate(seen)}
        self.weights = np.array([np.log2(len(texts[k]) + 2) for k in self.langs])
        tables, self.roots, base = [], [], 0
        for lang in self.langs:
            go = suffix_automaton(texts[lang])
            table = np.full((len(go), width), -1, np.int32)
            for i, row in enumerate(go):
                for c, j in row.items():
                    table[i, at[c]] = j
            first = np.where(table[0] >= 0, table[0], 0)
            restart = table < 0
            restart[0] = True
            # entries are row offsets times 2, and odd where a phrase begins with this byte
            table = (np.where(restart, first, table) + base) * (2 * width) + restart
            tables.append(table)
            self.roots.append(base * width)
            base += len(go)
        self.kind = np.int32 if base * 2 * width < 1 << 31 else np.int64
        self.table = np.concatenate([t.astype(self.kind) for t in tables]).ravel()

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[rows, languages]: phrases of each row's bytes, parsed whole."""
        sizes = np.diff(offsets)
        blocks = -(-sizes // BLOCK)
        row = np.repeat(np.arange(len(sizes)), blocks)
        first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
        begin = offsets[:-1][row] + (np.arange(len(row)) - first[row]) * BLOCK
        size = np.minimum(BLOCK, offsets[1:][row] - begin)
        order = np.argsort(-size, kind="stable")
        begin, size, coded = begin[order], size[order], self.code[data]
        counts = np.zeros((len(self.langs), len(row)), np.int32)
        state = np.repeat(np.array(self.roots, self.kind)[:, None], len(row), 1)
        live = np.searchsorted(-size, -np.arange(BLOCK), side="left")
        for t in range(int(size[0]) if len(size) else 0):
            n = live[t]
            symbol = coded[begin[:n] + t]
            step = self.table[state[:, :n] + symbol]
            counts[:, :n] += step & 1
            state[:, :n] = step >> 1
        self._carry(coded, begin, size, order, row, counts, state)
        out = np.zeros((len(sizes), len(self.langs)), np.int64)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(row[order], weights=counts[k], minlength=len(sizes))
        return out


    def _carry(self, coded, begin, size, order, row, counts, state) -> None:
        """Corrects counts and end states of blocks parsed from the root to those of one parse a row, in place."""
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))  # of a block among the sorted
        after = np.full(len(order), -1)  # the sorted place of the block that follows a sorted one in its row
        follows = np.flatnonzero(row[1:] == row[:-1])
        after[place[follows]] = place[follows + 1]
        roots = np.array(self.roots, self.kind)
        # what each block was last parsed from: (language, block) pairs whose start has changed
        lang, block = np.nonzero((after >= 0)[None] & (state != roots[:, None]))
        block = after[block]
        started = np.repeat(roots[:, None], len(order), 1)
        while len(block):
            # the block before each of these
            before = place[order[block] - 1]
            new, old = state[lang, before], started[lang, block]
            moved = np.flatnonzero(new != old)
            lang, block, new, old = lang[moved], block[moved], new[moved], old[moved]
            started[lang, block] = new
            more = np.zeros(len(block), np.int64)
            live, t, end = np.arange(len(block)), 0, np.full(len(block), -1, self.kind)
            while len(live):
                b = block[live]
                symbol = coded[begin[b] + t]
                a, c = self.table[new[live] + symbol], self.table[old[live] + symbol]
                more[live] += (a & 1).astype(np.int64) - (c & 1)
                new[live], old[live] = a >> 1, c >> 1
                t += 1
                apart = new[live] != old[live]
                over = apart & (size[b] <= t)
                end[live[over]] = new[live[over]]
                live = live[apart & ~over]
            np.add.at(counts, (lang, block), more)
            changed = np.flatnonzero(end >= 0)
            lang, block = lang[changed], block[changed]
            state[lang, block] = end[changed]
            on = np.flatnonzero(after[block] >= 0)
            lang, block = lang[on], after[block[on]]


def fit(docs: DataFrame, modulus: int | None = 5) -> dict[str, bytes]:
    """The samples, from rows with text and lang whose crc32(doc_id as text) mod modulus is not 0.

    At most SAMPLE_ROWS rows a language reach the driver, for MOST_LANGS languages, and ROW_BYTES of each;
    their ids, two numbers each, are the only broadcast. With many languages each has a smaller sample."""
    known = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t"), F.col("lang").alias("l")).where("t is not null and l is not null and id is not null")
    if modulus:
        known = known.where(crc_bucket(F.col("id"), modulus) != 0)
    h = F.xxhash64("id")
    picked = cut(known.groupBy("l", F.pmod(h, F.lit(SAMPLE_ROWS)).alias("k")).agg(F.min(F.struct(h.alias("h"), "id")).alias("p"), F.count("*").alias("n")))
    langs = [r.l for r in picked.groupBy("l").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "l").limit(MOST_LANGS).collect()]
    most = min(SAMPLE_BYTES, ALL_BYTES // max(1, len(langs)))
    if len(langs) == MOST_LANGS:
        picked = picked.where(F.col("l").isin(langs))
    picked = picked.select(F.col("p.id").alias("id"), F.col("p.h").alias("h"))
    rows = known.join(F.broadcast(picked.distinct()), "id").select("l", "h", "id", F.encode(F.substring("t", 1, ROW_BYTES), "utf-8").alias("b")).collect()
    samples: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r.h, r.id, bytes(r.b))):
        have = samples.get(r.l, b"")
        if len(have) < most:
            samples[r.l] = have + b" " + bytes(r.b)[: most - len(have)]
    return samples


def _parser(samples: dict[str, bytes]) -> CrossParser | None:
    """The worker's parser for these samples, kept from task to task; None for no samples."""
    return resident.keep(("parser", tuple(sorted(samples.items()))), lambda: CrossParser(samples) if samples else None)


def judge(texts: pa.Array, letters: pa.Array, samples: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the winner's place among the sorted languages (-1: `und`), score and bytes a phrase."""
    parser = _parser(samples)
    data, offsets = words.utf8(texts)
    some = np.array(letters.to_pylist(), bool)
    n = len(some)
    if parser is None or not n:
        return np.full(n, -1), np.zeros(n), np.zeros(n)
    p = parser.phrases(data, offsets)
    bits = p * parser.weights
    best, least = bits.argmin(1), bits.min(1)
    second = np.partition(bits, 1, axis=1)[:, 1] if p.shape[1] > 1 else least
    score = np.where(some, 1 - least / np.maximum(second, 1) if p.shape[1] > 1 else 1.0, 0.0)
    return np.where(some, best, -1), score.astype(np.float64), np.diff(offsets) / np.maximum(p[np.arange(n), best], 1)


#: A name of this column's own: an input column of a plain name would clash.
LETTERS = "__pointloom_has_letters"


def _with_letters(docs: DataFrame) -> DataFrame:
    return docs.withColumn(LETTERS, F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))


def predict(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, phrase_len) for every row.

    lang_pred is `und`, with score 0, where the text is null or has no letter, or nothing was learned;
    ties go to the smaller lang. score is 1 - fewest / second fewest normalised phrases (1 where one language
    was learned); phrase_len is bytes a phrase in the winner. Empty in, empty out."""
    names = pa.array(["und", *sorted(samples)])

    def run(batches):
        for batch in batches:
            for part in words.slices(batch, "text"):
                best, score, size = judge(part.column("text"), part.column(LETTERS), samples)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), names.take(pa.array(best + 1)), pa.array(score), pa.array(size)], names=["doc_id", "lang_pred", "score", "phrase_len"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_letters(texts).mapInArrow(run, "doc_id long, lang_pred string, score double, phrase_len double")


def identify(docs: DataFrame, modulus: int = 5) -> DataFrame:
    """Fits on docs and predicts every row: doc_id, held_out, lang_pred, score, phrase_len."""
    out = predict(docs, fit(docs, modulus))
    held = F.coalesce(crc_bucket(F.col("doc_id"), modulus) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "phrase_len")


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text is in no learned language; all columns, judged row by row in place.

    Gone are texts that are null or have no letter, and those whose best language matches fewer than
    LEAST_PHRASE bytes a phrase. Rows of null doc_id are judged like any other."""
    samples, columns = fit(docs, None), docs.columns

    def run(batches):
        for batch in batches:
            for part in words.slices(batch, "text"):
                best, _, size = judge(part.column("text"), part.column(LETTERS), samples)
                yield part.select(columns).filter(pa.array((best >= 0) & (size >= LEAST_PHRASE)))

    return _with_letters(docs).mapInArrow(run, docs.schema)
