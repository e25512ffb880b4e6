"""The training-data operators against brute-force versions, round trips and held-out rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.llm import chat, components, elias_fano, html_main, language, mixing, near_dup, ngram, packing, token_counts, vectors, words

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty, blank, very short and very long texts, repeated rows, null keys.
ODD = [
    (-1, None, None, None, 0),
    (-2, "", "en", "", 0),
    (-3, " \n\t", "en", "zz", 3),
    (-4, "Aa b", "en", None, 4),
    (-5, "aA  B", None, "a", 5),
    (-6, "x " * 30_000, "fr", "a", 60_000),
    (-7, "y" * 5_000, "de", "b", 5_000),
    (-8, "One two three four.", "en", "b", 19),
    (-8, "One two three four.", "en", "b", 19),
    (-9, "I'LL don't İSTANBUL ΣΑΣ <|endoftext|>x a\x1cb \x85 z 日本語 12 ﬁ", "es", "c", 50),
]


def low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(ODD, DOC)).withColumn("id", F.lit(7)).withColumn("size", F.lit("x")).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_words(texts):
    column = pa.array(list(texts.values()))
    h, rows = words.hashed(column)
    want = [[low(w) for w in split(t)] for t in texts.values()]
    assert np.diff(rows).tolist() == list(map(len, want))
    of = {}
    assert all(of.setdefault(w, x) == x for w, x in zip(itertools.chain(*want), h.tolist(), strict=True)) and len(set(of.values())) == len(of)


def test_boosting_and_pages():
    model, r, exact = html_main.trained(), random.Random(99), 0
    for _ in range(60):
        page = html_main.invented(r)
        labels = page.labels
        got = page.decode(model.scores(page.features()))
        assert all(got[i] == 2 or got[page.parent[i]] != 2 for i in range(1, len(got)))
        exact += page.text(got) == page.text(labels)
    assert exact >= 55


#: Hand-made pages, none by the generator that trains the trees, and their main texts.
_P = "Some words of an article that go on for a while, so that it reads like prose."
PAGES = [
    ("<head><title>t</title><article><h1>T</h1><p>" + _P + "</article>", "T\n" + _P),  # the head is never closed
    ("<html><head><meta charset=utf-8><p>" + _P, _P),
    ("<body><article data-y=left><p data-y>" + _P + "</p><p data-y='3'>" + _P + "</p></article></body>", _P + "\n" + _P),
    ("<body><div id=nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div><div class=content><h2>Head &amp; line</h2><p>" + _P + "</p><p>" + _P + "</p></div><div class=footer>c 2020</div></body>", "Head & line\n" + _P + "\n" + _P),
    ("<body><header><h1>Site</h1></header><main><h1>Title</h1><p>" + _P + "</p><div class=comments><p>me too</p></div></main><aside>see also</aside><footer>x</footer></body>", "Title\n" + _P),
    ("<body><section class=post-body><p>" + _P + "</p><div class='ad banner'>buy</div><p>a &lt;b&gt;&#233;\n c<br>d</p></section><form><input><p>Sign up</p></form></body>", _P + "\na <b>\xe9 c d"),
    ("<article><p>" + "<b>" * 3000 + _P, _P),
]


def test_html_of_hand_made_pages(spark):
    long = "<body><nav><a href=x>m</a></nav><article><h1>L</h1>" + "".join(f"<p>{_P} {i}</p>" for i in range(20_000)) + "</article></body>"
    made = [*PAGES, (long, "\n".join(["L", *(f"{_P} {i}" for i in range(20_000))]))]
    rows = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(made)] * 2, "page_id long, url string, html string")
    got = html_main.extract(rows).collect()
    assert len(got) == 2 * len(made)
    assert [t for *_, t in html_main.Page("<head><title>x</title> a<p>b").texts] == [" a", "b"]  # text ends a head, too
    for r in got:
        assert (r.text, r.n_chars) == (made[r.page_id][1], len(made[r.page_id][1])), r.page_id


def test_html(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html")
    own = [(-1, None, None), (-2, "u", ""), (-3, "u", "<html><body><nav><a href=x>m</a></nav><article><h1>T</h1><p>a &lt;b&gt;\n  c<p>d<aside>no</aside><form>n</form><section class=comments><p>c</p></section></article><footer>f</footer>"), (-4, "u", "<" * 50)]
    rows = {r.page_id: r for r in html_main.extract(pages.union(spark.createDataFrame(own, "page_id long, url string, html string")).withColumn("text", F.lit(1))).collect()}
    assert (rows[-1].text, rows[-2].text, rows[-3].text) == ("", "", "T\na <b> c\nd")
    import html

    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert rows[r.page_id].text == "\n".join(x for x in want if x) and rows[r.page_id].n_chars == len(rows[r.page_id].text)
    assert html_main.extract(pages.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"
BAD_VECTORS = [(-20, None, 1), (-40, [], 1), (-60, [None] * 64, 1), (-80, [float("nan")] * 64, 1), (-100, [float("inf")] * 64, 1), (-120, [0.0] * 64, 1), (None, [1.0] * 64, 1)]


@pytest.fixture(scope="module")
def embeddings(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    copies = e.where("vec_id < 3").withColumn("vec_id", F.col("vec_id") + 10_000)
    return e.union(copies).union(copies).union(spark.createDataFrame(BAD_VECTORS, VECTORS)).withColumn("score", F.lit("x")).cache()


def ranked(rows, queries, k, score, zero=True):
    out = []
    for a, x in rows.items():
        if queries(a):
            best = sorted(((-score(x, y), b) for b, y in rows.items() if b != a))[:k]
            out += [(a, i + 1, b, -s) for i, (s, b) in enumerate(best)]
    return out


def test_exact_top_k(embeddings):
    rows = {r.vec_id: np.floor(np.array(r.embedding, np.float64) * 256).astype(np.int64) for r in embeddings.where("vec_id >= 0").collect()} | {-120: np.zeros(64, np.int64)}
    want = ranked(rows, lambda a: a % 50 == 0, 5, lambda x, y: int(x @ y))
    got = [tuple(r) for r in vectors.exact_top_k(embeddings).orderBy("query_id", "rank").collect()]
    assert got == sorted(want)
    assert vectors.exact_top_k(embeddings.limit(0)).count() == 0


def test_nearest(embeddings):
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in embeddings.where("vec_id >= 0").collect()}
    want = ranked(rows, lambda a: a % 20 == 0, 20, lambda x, y: float((x * y).sum()))
    got = [tuple(r) for r in vectors.nearest(embeddings).collect()]
    assert len({(a, b) for a, _, b, _ in got} & {(a, b) for a, _, b, _ in want}) >= 0.9 * len(want)
    for a, _, b, s in got:
        assert s == pytest.approx(float(rows[a] @ rows[b]), abs=1e-12)
    by = collections.defaultdict(list)
    for a, i, b, s in sorted(got):
        by[a].append((-s, b))
    assert all(v == sorted(v) for v in by.values())
    assert vectors.nearest(embeddings.limit(0)).count() == 0


def test_eliminate():
    """Exact at any number of pivots, also dependent and repeated ones, and evaluates less the more there are."""
    r = np.random.default_rng(4)
    x = np.floor(256 * (lambda v: v / np.sqrt((v * v).sum(1))[:, None])(r.standard_normal((3000, 64))))
    x[5] = x[6] = x[7]
    q, ids, shares = x[:40], np.arange(len(x)), []
    for pivots in (x[100:101], np.concatenate([x[5:8], x[10:20], x[10:20]]), x[100:124], x[100:148], np.zeros((3, 64))):
        counts = []
        for a, found, scores in vectors.eliminate(q, ids[:40], x, ids, pivots, 5, counts):
            best = sorted(((-int(x[a] @ x[b]), b) for b in ids if b != a))[:5]
            assert list(zip((-scores).tolist(), found.tolist(), strict=True)) == best
        shares.append(np.mean(counts) / len(x))
    assert shares[3] < 0.2 < shares[2]


def test_nearest_gives_k_or_all(spark, monkeypatch):
    r = np.random.default_rng(6)

    def unit(n):
        x = r.standard_normal((n, 64))
        return x / np.sqrt((x * x).sum(1))[:, None]

    def table(x):
        return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)

    for n in (2, 15, 21):
        got = collections.Counter(x.query_id for x in vectors.nearest(table(unit(n)), "vec_id % 2 = 0").collect())
        assert got == ({i: min(20, n - 1) for i in range(0, n, 2)})
    x = unit(1500)
    x[7] *= 1000  # one long vector: what lengthens the others is nearly all of them
    got = collections.defaultdict(set)
    for a in vectors.nearest(table(x), "vec_id % 50 = 0").collect():
        got[a.query_id].add(a.vec_id)
    best = {q: set(sorted((b for b in range(1500) if b != q), key=lambda b: -float(x[q] @ x[b]))[:20]) for q in range(0, 1500, 50)}
    assert set(got) == set(best) and all(len(v) == 20 for v in got.values())
    assert sum(len(got[q] & best[q]) for q in best) >= 0.9 * 20 * len(best)
    monkeypatch.setattr(vectors, "SUCCESS", 1e-9)  # one bucket a table: some queries meet fewer than k there
    monkeypatch.setattr(vectors, "CHUNK", 7)
    x = unit(200)
    got = collections.defaultdict(list)
    for a in vectors.nearest(table(x), "vec_id % 10 = 0").collect():
        got[a.query_id].append((a["rank"], a.vec_id, a.score))
    assert all(len(got[q]) == 20 == len({b for _, b, _ in got[q]}) and [s for *_, s in sorted(got[q])] == pytest.approx(sorted((float(np.float32(x[q]).astype(float) @ np.float32(x[b]).astype(float)) for _, b, _ in got[q]), reverse=True), abs=1e-12) for q in range(0, 200, 10))


def test_nearest_routes_queries(spark):
    """Recall of 0.9 and more while a good part of the rows is never scored; a third of the rows equal, and ids that repeat."""
    r = np.random.default_rng(9)
    x = r.standard_normal((4000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    x = np.float32(x)
    x[2000:3300] = x[2000]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows + [(17, x[3].tolist(), 1), (17, x[17].tolist(), 1)], VECTORS).repartition(3)
    x[17] = min(x[3].tolist(), x[17].tolist())
    x = x.astype(float)
    queries, hits = range(0, 4000, 20), 0
    got = collections.defaultdict(dict)
    for a in vectors.nearest(table).collect():
        got[a.query_id][a.vec_id] = a.score
    for q in queries:
        s = x @ x[q]
        s[q] = -9
        assert len(got[q]) == 20 and all(v == pytest.approx(s[b], abs=1e-12) for b, v in got[q].items())
        hits += sum(v >= np.sort(s)[-20] - 1e-9 for v in got[q].values())
    assert hits >= 0.9 * 20 * len(queries)
    assert vectors.share_met(table) < 0.75


CHAT = "conv_id long, turn long, role string, text string"


def chat_by_hand(turns, budget, history, block):
    """Windows of one conversation, plainly: (formatted, loss texts) in order; turns are (role, text)."""
    import urllib.parse

    control = r"([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)"
    # letters and digits are those of Unicode; the underscore is neither
    cost = [len(re.findall(r"[^\W_]+|[^\s\w]|_", t)) + 3 for _, t in turns]
    show = [f"<s>{urllib.parse.quote_plus(a, safe='*-._')}\n" + re.sub(control, r"\1\\\2\3", t) + "</s>" for a, t in turns]
    first_system = next((i for i, (a, _) in enumerate(turns) if a == "system"), None)
    room = max(1, budget - history - (cost[first_system] if first_system is not None else 0))
    out, i = [], 0
    while i < len(turns):
        j = i + 1
        while j < len(turns) and sum(cost[:j]) // block == sum(cost[:i]) // block and sum(cost[i : j + 1]) <= room:
            j += 1
        k = i
        while k > 0 and sum(cost[k - 1 : i]) <= history:
            k -= 1
        lead = [first_system] if first_system is not None and not k <= first_system < j else []
        out.append(("".join(show[x] for x in [*lead, *range(k, j)]), [t for a, t in turns[i:j] if a == "assistant"]))
        i = j
    return out


def test_chat(spark, data, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4096)
    own = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (-2, 1, "as\ni<s>x", None), (-2, 0, None, "<\\/s> <\\\\s> <<SYS>> <<</SYS>> [INST[INST]"), (-2, 2, "assistant", "<"), (-2, 3, "assistant", ""), (-2, 3, "assistant", ""), (-2, 4, "assistant", "a\n</s"), (-2, 5, "system", "z"), (-3, None, "assistant", "é" * 3000), (None, 1, "user", "q"), (None, 0, "assistant", None)]
    own += [(-4, i, "user" if i % 2 else "assistant", "w " * (i % 97)) for i in range(700)]
    own += [(-5, 1000 * i, "user" if i % 2 else "assistant", f"short {i}") for i in range(20)] + [(-6, i, "user" if i % 2 else "assistant", f"short {i}") for i in range(20)]
    own += [(-7, None, "user", f"u {i % 50}") for i in range(400)] + [(-8, 3, "assistant", f"v {i}") for i in range(400)]  # all turns null, or the same
    own += [(-9, 0, "system", "be kind " * 20), (-9, 1, "user", "x " * 100_000), (-9, 2, "assistant", "y " * 5000), (-9, 3, "user", "z")]
    table = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").union(spark.createDataFrame(own, CHAT)).repartition(5).withColumn("window", F.lit(1)).withColumn("p", F.lit("x"))
    windows = chat.windows(table).cache()
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    back = collections.defaultdict(list)
    for r in windows.orderBy("conv_id", "block", "window").collect():
        back[r.conv_id].append((r.formatted, [re.sub(r"([<\[])\\(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)", r"\1\2\3", r.formatted[x.start : x.start + x.length]) for x in r.loss]))
    by = collections.defaultdict(list)
    for r in table.collect():
        a, b = r.role or "", r.text or ""
        by[r.conv_id].append((-1 if r.turn is None else r.turn, hashlib.md5(f"{a}\n{b}".encode()).hexdigest(), a, b))
    assert set(by) == set(got)
    for k, turns in by.items():
        turns = [x[2:] for x in sorted(turns)]
        told, loss = "".join(f"{a}\n{b}\n" for a, b in turns), "".join(b for a, b in turns if a == "assistant")
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        plain = chat_by_hand(turns, chat.BUDGET, chat.HISTORY, 4096)
        assert back[k] == plain, k
        assert r.formatted_chars == sum(len(x) for x, _ in plain)
    assert windows.where(f"n_tokens > {chat.BUDGET} and n_turns > 1 and conv_id = -4").count() == 0
    assert windows.where("conv_id in (-5, -6)").count() == 2  # however turns are numbered
    assert windows.where("conv_id = -4 and window = 0 and block > 0 and n_repeated > 0").count() > 0  # history crosses blocks
    assert windows.where("conv_id = -7").groupBy("block").count().count() > 0 and max(len(x.loss) for x in windows.where("conv_id = -8").select("loss").collect()) < 120
    assert chat.digests(chat.windows(table.limit(0))).count() == 0


def test_token_counts(docs):
    v = token_counts.Vocabulary(token_counts.default_vocabulary())
    got = sorted(tuple(r) for r in token_counts.token_counts(docs.where("doc_id < 30")).collect())
    want = []
    for r in docs.where("doc_id < 30").collect():
        each = [v.one(w.encode()) for w in split(r.text)]
        want.append((r.doc_id, len(each), sum(a for a, _ in each), sum(b for _, b in each) / token_counts.UNIT))
    assert got == sorted(want)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_long_pre_tokens(docs):
    v = token_counts.Vocabulary(token_counts.default_vocabulary())
    r = random.Random(7)
    prose = "".join(split(" ".join(x.text or "" for x in docs.where("doc_id < 20 and doc_id >= 0").collect())))
    long = ["a" * 61, "a" * 62, "a" * 573, "a" * 5000, prose[:4000], prose[:4000] + "x", prose[:60] + "日本語" * 900, "日" * 400, "".join(r.choice("ABCDabcd0123+/") for _ in range(3000)), "the" * 1000, "=" * 2000, "é" * 31, "b"]
    data, ends = b" ".join(x.encode() for x in long), np.cumsum([len(x.encode()) + 1 for x in long])
    sizes = np.array([len(x.encode()) for x in long])
    for blocks in (4096, 3):
        token_counts.TAIL_BLOCKS = blocks
        tokens, scores = v.many(np.frombuffer(data, np.uint8), ends - 1 - sizes, sizes)
        assert list(zip(tokens.tolist(), scores.tolist(), strict=True)) == [v.one(x.encode()) for x in long]
    token_counts.TAIL_BLOCKS = 4096


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs).collect()
    want, total = [], 0
    for r in docs.select("doc_id", "text").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        want += [(r.doc_id, k, k * 2048, len(own := ids[k * 2048 : (k + 1) * 2048]), zlib.crc32(np.array(own, "<u4").tobytes())) for k in range(-(-len(ids) // 2048))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * -(-total // 2048) + 1
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_tokenizers(name, monkeypatch):
    """Texts of letters, signs, marks, control characters and special tokens in any order; with room for all pieces and for few."""
    import public_tokenizers

    r = random.Random(11)
    some = [*"aAbZ'sStT’.,!%9 0½²éÉßÿÀ×÷þÞ\u0301\xadçİΣς日\u200b\n\x0b\x1c\x85\xa0_-ªµº€", "<|endoftext|>", "don't", "ÉCOLE ", " the"]
    odd = ["".join(r.choices(some, k=r.randint(0, 40))) for _ in range(2_000)]
    column = pa.array([None, "", " ", "é" * 50_000, *odd])
    for room in (packing.CACHE_PIECES, 50):
        monkeypatch.setattr(packing, "CACHE_PIECES", room)
        monkeypatch.setattr(packing, "PIECES", min(room, packing.PIECES))
        tokens = packing._Tokens(public_tokenizers.path(name))
        assert tokens.by_piece == name.startswith("word")
        ids, rows = tokens.rows(column)
        assert rows[0] == 0 and rows[-1] == len(ids)
        for text, a, b in zip(column.to_pylist(), rows[:-1], rows[1:], strict=True):
            assert ids[a:b].tolist() == [*tokens.whole(text or ""), 0]


def test_fullest_bin():
    r = random.Random(3)
    for _ in range(60):
        sizes = collections.Counter(r.randint(1, 30) for _ in range(r.randint(1, 9)))
        plans = packing.plan(dict(sizes), 40)
        used = collections.Counter()
        for times, bin_ in plans:
            assert sum(bin_) <= 40
            used.update({n: c * times for n, c in collections.Counter(bin_).items()})
        assert used == sizes
        top = max(sizes)
        rest = list((sizes - collections.Counter([top])).elements())
        assert sum(plans[0][1]) == top + max(s for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if (s := sum(c)) <= 40 - top)


def mixed_by_hand(rows, taken_size):
    """{(doc_id, place in the stream): (taken, places)} of one pass over each source's schedule, plainly; rows are
    (source, hash, doc_id, size), taken_size by source; sources in order."""
    total = sum(r[3] for r in rows)
    block = max(1, min(mixing.LARGEST_BLOCK, total >> 16))
    names = sorted({r[0] for r in rows}, key=lambda x: (x is None, x))
    sizes = {k: sum(r[3] for r in rows if r[0] == k) for k in names}
    slots = {k: [(e, b) for e in range(-(-taken_size[k] // sizes[k])) for b in range(-(-min(sizes[k], taken_size[k] - e * sizes[k]) // block))] if sizes[k] else [] for k in names}
    needed = sum(map(len, slots.values()))
    bits, first, out = max(0, (needed - 1).bit_length()), 0, {}
    for k in names:
        places = sorted(int(f"{first + i:b}".zfill(bits)[::-1], 2) if bits else 0 for i in range(len(slots[k])))
        first += len(slots[k])
        start = 0
        for own in sorted(r[1:] for r in rows if r[0] == k):
            n, met = 0, {}
            for place, (e, b) in zip(places, slots[k], strict=True):
                end = min(b * block + block, sizes[k], taken_size[k] - e * sizes[k])
                over = min(start + own[2], end) - max(start, b * block)
                if over > 0:
                    n += over
                    met.setdefault(e, place)
            out[k, start, *own] = (n, list(met.values()))
            start += own[2]
    return out


def test_mixing(docs, spark, monkeypatch):
    shares, slots = mixing.mix(docs)
    rows = shares.collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(rows, key=key) == sorted(mixing.mix(docs.repartition(7))[0].collect(), key=key)  # reruns agree
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
    size, taken, target = collections.Counter(), collections.Counter(), {}
    real = {r.doc_id: len(split(r.text)) for r in docs.collect()}
    for r in rows:
        assert r.size == real[r.doc_id] and 0 <= r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = [*sorted(k for k in size if k is not None), None]
    weight, total, full = {k: i % 3 + 1 for i, k in enumerate(names)}, sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[k] for k in full)
        want = {k: 3 * size[k] if k in full else rest * weight[k] / sum(weight[x] for x in names if x not in full) for k in names}
        over = {k for k in names if want[k] > 3 * size[k] + 1e-9}
        if not over:
            break
        full |= over
    for k in names:
        assert target[k] == pytest.approx(want[k], rel=1e-9, abs=1e-6) and abs(taken[k] - want[k]) <= 1
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    plain = mixed_by_hand([(r.source, hashes[r.doc_id], r.doc_id, r.size) for r in rows], {k: min(math.floor(want[k] + 0.5), 3 * size[k]) for k in names})
    shown = lambda x: sorted(x, key=str)
    assert shown((r.source, r.doc_id, r.size, r.taken, r.places) for r in rows) == shown((k, d, n, t, p if n else []) for (k, _, _, d, n), (t, p) in plain.items())
    # any run of places holds about its share of each source
    places = slots.select("place", "s").collect()
    counts, half = collections.Counter(p.s for p in places), max(p.place for p in places) // 2
    first = collections.Counter(p.s for p in places if p.place <= half)
    assert all(abs(first[s] - counts[s] / 2) <= 12 for s in counts)
    assert mixing.mix(docs.limit(0))[0].count() == 0
    mixed = [r.doc_id for r in mixing.mixed(docs).collect()]
    monkeypatch.setattr(mixing, "_bit_reverse", lambda k, bits: k)  # without the schedule the mix is another
    assert {r.doc_id: r.places for r in mixing.mix(docs)[0].collect()} != {r.doc_id: r.places for r in rows}
    other = [r.doc_id for r in mixing.mixed(docs).collect()]
    assert sorted(other) == sorted(mixed) and other != mixed


def test_mixed_is_in_schedule_order(docs):
    once = [r.doc_id for r in mixing.mixed(docs.where("doc_id >= 0")).collect()]
    at = {r.doc_id: r.places for r in mixing.mix(docs.where("doc_id >= 0"))[0].collect()}
    seen, got = collections.Counter(), []
    for d in once:
        got.append(at[d][min(seen[d], len(at[d]) - 1)])
        seen[d] += 1
    assert got == sorted(got) and len(set(got)) > 100


def test_mixing_without_words(spark):
    rows = spark.createDataFrame([(1, "", None, "a", 0), (2, None, None, "a", 0), (None, " ", None, None, 0)], DOC)
    got = mixing.mix(rows)[0].collect()
    assert sorted((r.size, r.source_size, r.target, r.taken, r.places) for r in got) == [(0, 0, 0.0, 0, [])] * 3
    assert mixing.mixed(rows).count() == 0 and mixing.mixed(rows).columns == rows.columns


def test_mixed_takes_rows_of_null_and_repeated_id(spark):
    r = random.Random(2)
    rows = [(None if i % 3 else i % 12 * 50, "w " * r.choice([2, 7, 7, 30]) + str(i), None, r.choice(["a", "b", "c", None]), 0) for i in range(300)]
    rows += [(1000 + i, "v " * r.randint(0, 40), None, "a", 0) for i in range(100)] + [(None, None, None, "a", 0)]
    table = spark.createDataFrame(rows, DOC).withColumn("times", F.lit("x")).withColumn("size", F.lit(1))
    want = collections.Counter()
    for x in mixing.mix(table)[0].collect():
        want[x.doc_id, x.source, x.size] += math.floor(x.taken / x.size + 0.5) if x.size else 0
    mixed = mixing.mixed(table)
    got = mixed.collect()
    assert mixed.columns == table.columns
    assert collections.Counter((x.doc_id, x.source, len(split(x.text))) for x in got) == +want
    assert {tuple(x)[:5] for x in got} <= set(rows) and sum(x.doc_id is None for x in got) > 100


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1), (5, 100), (1000, 1 << 62), (5000, 6000), (3000, 1 << 20)):
        values = np.sort(r.integers(0, universe, n, dtype=np.uint64))
        e = elias_fano.EliasFano(elias_fano.encode(values, universe))
        if n:
            assert (e.access(np.arange(n)) == values).all()
            asked = np.concatenate([values, r.integers(0, universe, 200, dtype=np.uint64)])
            have = set(values.tolist())
            assert all((b >= 0) == (a in have) and (b < 0 or values[b] == a) for a, b in zip(asked.tolist(), e.find(asked).tolist(), strict=True))


class PlainModel:
    """Trigrams with interpolated absolute discounting, from the formulas, on dictionaries; rows are lists of words."""

    def __init__(self, rows):
        self.c = [collections.Counter() for _ in range(3)]  # by length of the context
        for row in rows:
            line = ["<s>", "<s>", *row, "</s>"]
            for i in range(2, len(line)):
                for k in range(3):
                    self.c[k][tuple(line[i - k : i + 1])] += 1
        self.total, self.fan = collections.Counter(), collections.Counter()
        for k in range(3):
            for g, n in self.c[k].items():
                self.total[k, g[:-1]] += n
                self.fan[k, g[:-1]] += 1
        self.n, self.v = sum(self.c[0].values()), len(self.c[0])

    def p(self, context, w):
        out = (0.75 * self.v / self.n if self.n else 1) / (self.v + 1)
        out += max(self.c[0][(w,)] - 0.75, 0) / max(self.n, 1)
        for k, d in ((1, 0.95), (2, 0.95)):
            own = (k, tuple(context[2 - k :]))
            if self.total[own]:
                out = max(self.c[k][(*own[1], w)] - d, 0) / self.total[own] + d * self.fan[own] / self.total[own] * out
        return out

    def score(self, row):
        line = ["<s>", "<s>", *row, "</s>"]
        return sum(math.log10(self.p(line[i - 2 : i], line[i])) for i in range(2, len(line)))


def test_plain_model_is_a_distribution():
    r = random.Random(2)
    model = PlainModel([[r.choice("abcde") for _ in range(r.randint(0, 6))] for _ in range(40)])
    words_ = [g[0] for g in model.c[0]] + ["unknown"]
    for context in itertools.product(["<s>", "a", "c", "never"], repeat=2):
        assert sum(model.p(context, w) for w in words_) == pytest.approx(1, abs=1e-12)


def test_lm(docs, monkeypatch):
    table = docs.select("doc_id", "text").collect()
    token = {r.doc_id: [low(w) for w in split(r.text)] for r in table}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in token}
    plain = PlainModel([token[r.doc_id] for r in table if not held[r.doc_id]])
    for size in (1 << 30, 60_000):  # one shard; several, with frequent words spread over them
        monkeypatch.setattr(ngram, "SHARD_BYTES", size)
        monkeypatch.setattr(ngram, "COUNT_TOKENS", size // 4)
        rows = ngram.train_and_score(docs).collect()
        better = []
        for r in rows:
            t = token[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t) + 1, sum(plain.c[0][(w,)] > 0 for w in [*t, "</s>"]), plain.n)
            assert r.base_score == pytest.approx(sum(math.log10((plain.c[0][(w,)] + 1) / (plain.n + plain.v + 1)) for w in [*t, "</s>"]), rel=1e-9)
            assert abs(r.score - plain.score(t)) <= 5e-4 * len(t) + 1e-3
            if r.held_out:
                better.append(r.score - r.base_score)
        assert sum(better) > 0 and sum(x > 0 for x in better) > 0.7 * len(better) and len(rows) == len(table)
    assert ngram.train_and_score(docs.limit(0)).count() == 0


def test_lm_scores_noise_below_text(spark, docs):
    model = ngram.train(docs)
    assert len(model["frequent"]) >= 1 and model["rows"] == docs.count()
    r = random.Random(3)
    noise = [(-i, " ".join("".join(r.choice("bcdfghjklm") for _ in range(7)) for _ in range(50)), None, None, 0) for i in range(1, 9)]
    a = [x.score / x.n_tokens for x in ngram.score(spark.createDataFrame(noise, DOC), model).collect()]
    b = [x.score / x.n_tokens for x in ngram.score(docs.where("length(text) > 200 and doc_id >= 0"), model).collect()]
    assert max(a) < -4 < sorted(b)[len(b) // 20]
    empty = ngram.train(docs.limit(0))
    assert {(x.n_known, x.score) for x in ngram.score(docs, empty).collect()} == {(0, 0.0)}


def components_of(links, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_components(spark):
    r = random.Random(4)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(200, x) for x in range(201, 260)] + [(7, 7)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame([*links, *links], "a long, b long")).collect()}
    want = components_of(links, {x for p in links for x in p})
    assert all(want[k] == v for k, v in got.items()) and all(k in got or v == k for k, v in want.items())


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_dup(spark, docs, texts, width, percent):
    r = random.Random(5)
    base = [f"w{r.randint(0, 400)}" for _ in range(120)]
    near = []
    for i in range(150):  # a group whose members differ by more and less than the threshold
        own = list(base)
        for _ in range(r.randint(0, 12)):
            own[r.randrange(120)] = f"z{r.randint(0, 10_000)}"
        near.append((1_000_000 + i, " ".join(own), None, None, 0))
    own = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(near, DOC))
    all_texts = texts | {a: t for a, t, *_ in near}

    def shingles(text):
        w = [low(x) for x in split(text)]
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = {k: shingles(t) for k, t in all_texts.items()}
    links = []
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                links.append((a, b))
    want = components_of(links, sets)
    rows = near_dup.near_duplicates(own, width, percent).collect()
    assert len(rows) == own.count()
    for x in rows:
        assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), want[x.doc_id], want[x.doc_id] == x.doc_id)
    if width == 5:
        kept = near_dup.keep_one(own, width, percent)
        assert sorted(x.doc_id for x in kept.select("doc_id").collect()) == sorted(k for k in want if want[k] == k) and kept.columns == own.columns
    assert near_dup.near_duplicates(own.limit(0), width, percent).count() == 0


def test_near_dup_of_long_texts(spark):
    """Chains of long texts, each a copy of the one before with some words changed, beside brute force."""
    r, rows, k = random.Random(8), [], 0
    for n, chains in ((3_000, 6), (8_000, 4), (20_000, 3)):
        for _ in range(chains):
            own = [f"w{r.randint(0, 10**6)}" for _ in range(n)]
            for _ in range(7):
                rows.append((k, " ".join(own), None, None, 0))
                k += 1
                for i in r.sample(range(n), int(n * 0.0215)):  # similarity of about 0.88 at width 3
                    own[i] = f"z{r.randint(0, 10**6)}"
    sets = {a: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for a, t, *_ in rows for w in [t.split()]}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if abs(a - b) < 7 and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert len(links) > 60
    want = components_of(links, sets)
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, DOC), 3, 85).collect()}
    assert got == want


def test_near_dup_of_repeated_ids(spark):
    """Rows of one doc_id and different texts are linked, and stay or go, each by its own text."""
    r = random.Random(1)
    a, b, c, d, e, f = ([f"w{r.randint(0, 10**6)}" for _ in range(200)] for _ in range(6))
    near = lambda x, k: " ".join([*x[:-2], f"z{k}", "z"])
    own = [(5, " ".join(a)), (5, " ".join(b)), (6, near(b, 0)), (7, near(a, 1)), (5, " ".join(b))]  # both texts have copies
    own += [(2, " ".join(c)), (9, near(c, 2)), (9, " ".join(d)), (10, near(d, 3))]  # one of 9's is a copy of 2
    own += [(20, " ".join(e)), (20, near(e, 4)), (21, " ".join(f).upper()), (21, " ".join(f)), (22, ""), (22, None)]
    rows = spark.createDataFrame([(i, t, None, None, 0) for i, t in own], DOC)
    got = collections.Counter((x.doc_id, x.component_id) for x in near_dup.near_duplicates(rows, 5, 80).collect())
    assert got == {(5, 5): 3, (6, 5): 1, (7, 5): 1, (2, 2): 1, (9, 2): 1, (9, 9): 1, (10, 9): 1, (20, 20): 2, (21, 21): 2, (22, 22): 2}
    kept = near_dup.keep_one(rows, 5, 80).collect()
    assert collections.Counter(x.doc_id for x in kept) == {5: 2, 2: 1, 9: 1, 20: 1, 21: 1, 22: 2}
    assert {x.text for x in kept} >= {" ".join(x) for x in (a, b, c, d)}


def test_suffix_automaton():
    text = b"abcabxabcd"
    go = language.suffix_automaton(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            state = 0
            for c in text[i:j]:
                state = go[state][c]
    assert ord("z") not in go[0] and ord("x") not in go[go[0][ord("c")]]


def test_language(docs, spark):
    parser = language.CrossParser({"a": b"hello world", "b": b"guten tag"})
    tx = ["hello world", "guten", "", "zzz"]
    data, offsets = words.utf8(pa.array(tx))
    counts = parser.phrases(data, offsets)

    def greedy(text, sample):
        n, i = 0, 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i : j + 1] in sample:
                j += 1
            n, i = n + 1, j
        return n

    for t, row in zip(tx, counts.tolist(), strict=True):
        assert row == [greedy(t, "hello world"), greedy(t, "guten tag")]
    r = random.Random(3)  # one parse of the whole text, across blocks, where phrases are as long as a block and where they never fall in step
    sample = {"a": ("ab" * 900 + "abc" * 200).encode(), "b": "".join(r.choice("abcd ") for _ in range(3000)).encode()}
    parser = language.CrossParser(sample)
    tx = ["ab" * 2000, "b" + "ab" * 1500 + "abc" * 700, "a" * 1400, "".join(r.choice("abcd ") for _ in range(5000)), "cab" * 1111, sample["b"].decode()[7:2900] + "z" + "ab" * 600, "x"]
    counts = parser.phrases(*words.utf8(pa.array(tx)))
    assert counts.tolist() == [[greedy(t, sample[k].decode()) for k in "ab"] for t in tx]
    assert parser.weights[0] < parser.weights[1]  # phrases of a longer sample cost more
    rows = language.identify(docs).join(docs.select("doc_id", "lang", "text").distinct(), "doc_id").collect()
    held = [r.lang == r.lang_pred for r in rows if r.held_out and r.lang and r.doc_id >= 0]
    assert sum(held) >= 0.95 * len(held)
    for r in rows:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert language.identify(docs.limit(0)).count() == 0


def test_keep_known(docs, spark):
    """Brute force: the rows whose prediction is a language with long enough phrases, all columns as they were."""
    odd = docs.withColumn("_has_letters", F.lit(False)).withColumn("lang_pred", F.lit("x"))
    samples = language.fit(odd, None)
    good = {r.doc_id for r in language.predict(odd, samples).collect() if r.lang_pred != "und" and r.phrase_len >= language.LEAST_PHRASE}
    kept = language.keep_known(odd)
    assert kept.columns == odd.columns
    key = lambda r: str(tuple(r))
    assert sorted(map(key, kept.collect())) == sorted(key(r) for r in odd.collect() if r.doc_id in good)
    assert {-1, -2, -3}.isdisjoint(good) and len(good) > 150
    assert language.keep_known(odd.limit(0)).count() == 0


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGS", 3)
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["lo", "mi", "ra"]) + k for _ in range(30)), k, None, 0) for i, k in enumerate(["a", "b", "c"] * 20 + ["d", "e"] * 3)]
    samples = language.fit(spark.createDataFrame(rows, DOC), None)
    assert sorted(samples) == ["a", "b", "c"] and all(len(x) <= language.SAMPLE_BYTES for x in samples.values())


@pytest.mark.parametrize("name", ["op2_exact_top_k", "op9_near_dedup"])
def test_sql(spark, data, name):
    import duckdb

    from pointloom.llm import queries

    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries.queries()[name](spark, data)
    want = db.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()) != []


def test_pipeline(spark, data, tmp_path):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "near_dedup", "mix_sources", "pack_sequences"]
    frames = [spark.read.parquet(f"{data}/documents.parquet")]
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, frames[-1], data).write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
    docs, known, single, mixed, packed = frames
    assert all(f.columns == docs.columns for f in (known, single, mixed))
    kept = {r.doc_id for r in single.collect()}
    assert kept == {r.doc_id for r in near_dup.near_duplicates(known, 5, 80).where("kept").collect()}
    shares = mixing.mix(single)[0].collect()
    times = {r.doc_id: int(math.floor(r.taken / r.size + 0.5)) for r in shares if r.size and r.taken >= r.size / 2}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter(times)
    assert packed.where("piece = 0").count() == mixed.count()
    assert sorted(map(tuple, p.run(spark, data).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_pipeline_of_odd_rows(spark, docs, tmp_path):
    """Null, empty, very short and very long texts, repeated rows and ids, names that clash, and no rows at all."""
    import corpus_pipeline as p

    words_ = "the of and to in that was his with for as had you not be her is but at on".split()
    r = random.Random(12)
    more = [(None, " ".join(r.choice(words_) for _ in range(60)) + f" {i}", "en", None, 0) for i in range(3)] + [(7_000, " ".join(r.choice(words_) for _ in range(50)), "en", "a", 0) for _ in range(2)]
    odd = docs.where("doc_id < 60").drop("id", "size").union(spark.createDataFrame(more, DOC))
    odd = odd.withColumns({"place": F.lit("x"), "times": F.lit(1), "h1": F.lit(2), "gone_id": F.lit(None).cast("string"), "doc": F.lit("y")})
    for name, rows in (("odd", odd), ("none", odd.limit(0))):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        stages, now = [], spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for k, (_, stage) in enumerate(p.STAGES):
            stage(spark, now, f"{tmp_path}/{name}").write.parquet(f"{tmp_path}/{name}/{k}")
            now = spark.read.parquet(f"{tmp_path}/{name}/{k}")
            stages.append(now)
        assert all(x.columns == odd.columns for x in stages[:3])
        known, single, mixed = (x.select("doc_id", "text").collect() for x in stages[:3])
        if name == "none":
            assert not known and not single and not mixed and not stages[3].count()
            continue
        assert {-1, -2, -3}.isdisjoint(x.doc_id for x in known)
        # of null ids and of a repeated one with different texts all stay; of equal rows one does
        texts_ = collections.Counter((x.doc_id, x.text) for x in single)
        assert sum(k[0] is None for k in texts_) == 3 and sum(k[0] == 7_000 for k in texts_) == 2 and max(texts_.values()) == 1
        assert {(x.doc_id, x.text) for x in mixed} <= set(texts_) and stages[3].where("piece = 0").count() == len(mixed) > 0
