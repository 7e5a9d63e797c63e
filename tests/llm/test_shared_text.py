"""Alignment, line deduplication and collocations against brute force; recall of a shard of full size."""

import hashlib
import json
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import BYTES, ODD, PIECES, make_texts

from fieldspark.llm import alignment, collocations, hnsw, line_dedup, tokens

ROWS = "doc_id long, text string, lang string, n int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts, langs=("en", None)):
    """Some ids are null, some rows are repeated, and a column has a name that operators use themselves."""
    rows = [(i if i % 7 else None, t, langs[i % len(langs)], i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:9], ROWS).repartition(3)


# --- alignment ---


def naive_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(BYTES)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    back = {c: b for b, c in enumerate(tokens.byte_letters())}
    with open(BYTES, encoding="utf-8") as f:
        names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a, b = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)
        at = [bytes(back[c] for c in names[i]) for i in a]
        bt = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + t).encode()
        if b"".join(at) != want or b"".join(bt) != want:
            docs.append(None)
            continue
        ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (at, bt)]
        of = lambda side, e: int(np.searchsorted(np.cumsum([len(x) for x in side]), e))
        links = [(a[of(at, e)], b[of(bt, e)]) for e in sorted(ends[0] | ends[1])]
        groups, i, j = [], 0, 0
        for e in sorted(ends[0] & ends[1]):
            k, m = of(at, e) + 1, of(bt, e) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        docs.append((len(a), len(b), ";".join(groups), len(groups), links))
    count = Counter(x for d in docs if d for x in set(d[4]))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return [
        (d[0], d[1], d[3], len(d[4]), sum(count[x] == best[x[0]] for x in d[4]), sum(count[x] for x in d[4]), hashlib.sha256(d[2].encode()).hexdigest()) if d else none
        for d in docs
    ]


SPACED = ["foo  bar \n baz  ", " lead", "a  b   c  d", "tab\t x \t\t y", "x " * 400, "long " + "y" * 900 + " z", "▁ under", "foo▁ bar", "é 　 wide", "ends \n", "\r\n a\r\n"]


@pytest.mark.parametrize("segment, width", [(1 << 16, 1 << 14), (60, 17), (1, 1)])
def test_alignment(spark, segment, width):
    texts = ODD + SPACED + make_texts(6)[:12] + ["word " * 300 + "é" * 50 + " .\n  " * 40]
    df = table(spark, texts)
    got = alignment.align(df, BYTES, PIECES, segment=segment, width=width).drop("doc_id").collect()
    every = [r["text"] for r in df.select("text").collect()]
    assert sorted(map(tuple, got)) == sorted(naive_alignment(every))


def test_alignment_sends_a_shard_at_a_time(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"shard {i} of short texts " * 8) for i in range(100)], "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, alignment.align(df, BYTES, PIECES).collect()))
    monkeypatch.setattr(alignment, "BATCH_BYTES", 2000)
    assert alignment.shards(df, BYTES, PIECES).count() >= 8
    assert sorted(map(tuple, alignment.align(df, BYTES, PIECES).collect())) == want


def test_alignment_rows_of_shards_are_bounded(spark):
    """A row holds less than the text of its shard, also where nearly every word is another one."""
    rng = np.random.default_rng(7)
    letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (600_000, 7))
    words = ["".join(x) for x in letters[rng.integers(0, 100_000, 600_000)].tolist()]
    texts = [(i, " ".join(words[i * 5000 : i * 5000 + 5000])) for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    parts = alignment.shards(df, BYTES, PIECES)
    size = sum((F.length(c) for c in alignment._NUMBERS), F.lit(0))
    rows, most = parts.select(F.count("*"), F.max(size)).first()
    assert rows >= 2 and most < 2 << 20


def test_numbers_are_packed_and_read_again():
    for x in ([], [0], [255], [256] * 9, range(70_000), [3, 1 << 40, 0]):
        x = np.array(x, np.int64)
        packed = alignment._pack_numbers(x)
        assert alignment._numbers(packed).tolist() == x.tolist() and alignment._numbers(pa.py_buffer(packed)).dtype == np.int64


def test_alignment_texts_and_empty(spark):
    df = spark.createDataFrame([(1, "Hello", "x", 0), (1, "Hello", "x", 0), (None, None, None, 0)], ROWS)
    got = sorted(map(tuple, alignment.align(df, BYTES, PIECES, texts=True).select("doc_id", "n_a", "groups").collect()), key=str)
    assert got == [(1, 1, got[0][2]), (1, 1, got[0][2]), (None, 0, "")] and got[0][2].count("|") == 1
    assert alignment.align(df.limit(0), BYTES, PIECES).collect() == []


def test_encoder_holds_a_block_of_words(monkeypatch):
    """Many distinct words at once: the same ids as in small blocks, and no lists of all of them."""
    import tracemalloc

    tools = alignment.encoder(BYTES, PIECES)
    words = [f"word{i}x{i * 7919 % 10007}" for i in range(60_000)]
    tools.encode(words[:10])
    tracemalloc.start()
    got = tools.encode(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * sum(x.nbytes for x in got)
    some = ["", "a", "Zürich", "\x00", "a  b"] + words[:20]
    want = tools.encode(some)
    monkeypatch.setattr(alignment, "WORDS", 3)
    assert all((x == y).all() for x, y in zip(tools.encode(some), want)) and len(tools.encode([])[0]) == 0


def test_fragments_compose_in_any_way():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a_end, b_end = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n)) for _ in range(2))
        a, b = np.arange(len(a_end)), 1000 + np.arange(len(b_end))
        edges = sorted({*rng.integers(1, n + 1, 5).tolist(), n})
        parts, lo = [], 0
        for hi in edges:
            x, y = (a_end > lo) & (a_end <= hi), (b_end > lo) & (b_end <= hi)
            parts.append(alignment.fragment(a[x], a_end[x], b[y], b_end[y]))
            lo = hi
        while len(parts) > 1:
            i = int(rng.integers(0, len(parts) - 1))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = alignment.aligned(a, a_end, b, b_end)
        assert all(np.array_equal(x, y) for x, y in zip(vars(parts[0].whole()).values(), vars(want).values()))


# --- lines ---


def naive_lines(rows, least=40, docs=5):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(strip).translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(i)
    held = {k: {i for i in v if i is not None} for k, v in held.items()}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(held.get(key(x), ())) < docs or (i is not None and i == max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [True, False])
def test_line_dedup(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(line_dedup, "BROADCAST_IDS", 0)
        monkeypatch.setattr(line_dedup, "HOT", 3)
    common, exact, short = "This Line is in many documents, É and all the rest", "x" * 40, "y" * 39
    texts = ODD + ["\n".join(["own %d" % i, common if i % 2 else f" \t{common.lower().replace('é', 'É')}\r", exact, short, exact]) for i in range(8)]
    texts += ["z" * 45, "\n" * 50, "\n".join(["rare line that only four documents hold, no more than that"] * 2)] + ["rare line that only four documents hold, no more than that"] * 3
    texts += [f"{exact}\n{common}"] * 3 + ["\n".join(f"line {k} of a long text that is unlike all the others {k * k}" for k in range(3000))]
    df = table(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = line_dedup.digests(line_dedup.drop_shared_lines(df))
    assert sorted(map(tuple, got.collect()), key=str) == naive_lines(rows)
    assert line_dedup.drop_shared_lines(df.limit(0)).collect() == []


# --- phrases ---


def naive_phrases(rows, least, share, top):
    found, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                found[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in found.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], a)
        ranked = []
        for p, a in frequent.items():
            if 100 * held[p] < share * a:
                s, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-s, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], s))
        out += [(lang, i + 1, p.decode(), a, x, y, words[lang], s) for i, (_, _, p, a, x, y, s) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least, top, held", [(3, 2000, 1 << 24), (2, 15, 3000)])
def test_collocations(spark, monkeypatch, least, top, held):
    monkeypatch.setattr(collocations, "HELD_BYTES", held)
    texts = ODD + make_texts(40) + ["a a a a a a. A a,a;b", "New York City. new york city! NEW YORK\tcity"] * 4
    df = table(spark, texts, ("en", None, "fr", "und"))
    got = collocations.collocations(df, least=least, top=top).collect()
    assert sorted(map(tuple, got)) == naive_phrases([(r["lang"], r["text"]) for r in df.collect()], least, 80, top)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([(1, None, None, 0), (2, " .,\n", "en", 0)], ROWS)
    assert collocations.collocations(df).collect() == [] and collocations.collocations(df.limit(0)).collect() == []


def test_index_grows_both_ways():
    ids = np.random.default_rng(1).integers(0, 6, 500)
    want = Counter()
    for k in (2, 3, 4):
        want.update(tuple(ids[i : i + k]) for i in range(len(ids) - k + 1) if all(ids[i : i + k]))
    index, got = collocations.FMIndex(ids, 4), {}
    for words, counts in index.phrases(4):
        got |= {tuple(w): c for w, c in zip(words.tolist(), counts.tolist())}
    assert got == want
    # both intervals of a phrase stay in step, whichever side it grew by
    symbol, lo, mirror, size = index.words()
    parent, right, lo2, mirror2, n = index.right(lo, mirror, size)
    other = {(s, p): (x, y) for p, s, x, y in zip(*[symbol[index.left(lo, mirror, size)[0]], *index.left(lo, mirror, size)[1:4]])}
    assert all(other[symbol[p], r] == (x, y) for p, r, x, y in zip(parent, right, lo2, mirror2))


# --- neighbours ---


@pytest.mark.parametrize("kind", ["free", "clusters"])
def test_recall_of_a_full_shard(kind):
    rng = np.random.default_rng(2)
    n = hnsw.SHARD_BYTES // (8 * 64)
    x = rng.normal(size=(n + 200, 64))
    if kind == "clusters":
        x = 2 * rng.normal(size=(10, 64))[rng.integers(0, 10, n + 200)] + 0.3 * x
    nodes, asked = x[:n], x[n:]
    graph = hnsw.Graph(nodes, hnsw._levels(np.arange(n)))
    ef = graph.build(20)
    found = graph.search(asked, ef)
    score = np.where(found >= 0, (nodes[np.maximum(found, 0)] * asked[:, None, :]).sum(axis=2), -np.inf)
    best = np.take_along_axis(found, np.argsort(-score, axis=1)[:, :20], axis=1)
    exact = np.argsort(-(asked @ nodes.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(exact, best)]) >= 0.9


def test_vectors_of_two_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i if i else None, rng.normal(size=8 if i % 3 else 5).tolist()) for i in range(400)]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 20, 5).collect()
    data = {i: np.array(v) for i, v in rows if i is not None}
    for q in [i for i in data if i % 20 == 0]:
        near = sorted((-float(data[q] @ v), i) for i, v in data.items() if i != q and len(v) == len(data[q]))[:5]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in near]
