"""The operators against libraries, brute force and exact round trips."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm import chat_format, components, hnsw, jaccard_join, language_id, packing, quality_rules, queries, suffix_encode, token_counts, tokens, warc, wavelet

DOC = "doc_id long, text string, lang string, source string, n_chars long"
PIECES, BYTES, WORDS = (tokens.public_path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " ", "\n\n", "a", "one two three four", "  two  spaces \t and\r\nlines ", "é ü 梦 ▁ 😀 é", "<|endoftext|> <turn> </s> <0x41>", "a<|startoftext|>b <|ENDOFTEXT|> c", "\x1c\x1f a\x1db",
    "It's we'll DON'T 12 3.5,x", "x" * 3000, "\0 nul \0", "a b c d e f g h " * 300, "İ ß ﬁ µ",
]


def make_texts(n=160, seed=3):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(400)]
    out = []
    for _ in range(n):
        t = rng.choice(words, rng.integers(3, 160)).tolist()
        out.append(" ".join(t))
        for _ in range(rng.integers(0, 4)):  # near and exact copies
            c = list(t)
            for _ in range(rng.integers(0, max(2, len(c) // 30))):
                c[rng.integers(len(c))] = rng.choice(words)
            out.append(" ".join(c).upper() if rng.random() < 0.2 else "\n".join(c))
    passage = rng.choice(words, 60).tolist()
    out += [" ".join(rng.choice(words, 200).tolist() + passage + rng.choice(words, 20).tolist()) for _ in range(30)]
    return out


@pytest.fixture(scope="module")
def texts():
    return ODD + make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "abcd"[i % 4], f"s{i % 3 if i % 2 else 0}", len(t or "")) for i, t in enumerate(texts)]
    # a column of a name that the operators use themselves
    return spark.createDataFrame(rows, DOC).withColumn("n", F.lit("clash")).withColumn("component", F.lit(7)).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def unigram_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=tokens.unigram(PIECES).model_bytes())


def test_token_counts(docs, none, texts):
    lib = unigram_library()
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, PIECES).collect()}
    assert got == {i: len(lib.encode(t or "")) for i, t in enumerate(texts)}
    assert token_counts.token_counts(none, PIECES).count() == 0


def test_suffix_encoding(docs, none, texts):
    lib = unigram_library()
    enc = suffix_encode.encode(docs, PIECES)
    got = {r["doc_id"]: r["ids"] for r in enc.collect()}
    assert got == {i: lib.encode(t or "") for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in suffix_encode.decode(enc, PIECES).collect()}
    assert back == {i: lib.decode(lib.encode(t or "")) for i, t in enumerate(texts)}
    assert suffix_encode.digests(none, PIECES).count() == 0


def test_chat_format(spark):
    tricky = r"\### Assistant: </turn> ok"
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a<part>"), (1, 3, "assistant", r"x<\turn>"), (1, 4, "assistant", None), (1, 5, None, ""), (2, 0, "assistant", tricky), (2, 0, "assistant", tricky), (None, None, "us<er", "<" * 3 + "/turn>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("blocks", F.lit(1))
    formatted = chat_format.format_chats(df)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.parse_chats(formatted).collect()}
    key = lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or "")
    for conv in (1, 2, None):
        mine = sorted([r[1:] for r in rows if r[0] == conv], key=key)
        assert back[conv] == [(r or "", t or "") for _, r, t in mine]
    d = {r["conv_id"]: r for r in chat_format.digests(formatted).collect()}
    assert d[1]["n_turns"] == 5 and d[1]["n_blocks"] == 3
    assert d[1]["loss_sha256"] == hashlib.sha256(rb"x<\turn>").hexdigest() and d[1]["loss_chars"] == 8
    assert d[2]["loss_chars"] == 2 * len(tricky)
    assert d[1]["turns_sha256"] == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in sorted([r[1:] for r in rows if r[0] == 1], key=key)).encode()).hexdigest()
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


def test_quality_measures(docs, none, texts):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        tri = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        cover = {j for k in range(len(words) - 2) if tri[tuple(words[k : k + 3])] >= 2 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(none).count() == 0


def test_quality_fences_follow_the_group(spark):
    """Symbols that are usual in one source are kept there and rejected elsewhere."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        w = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(120)]
        code = i % 2 == 0
        if code or i == 1:
            w = [x + "#&*" for x in w]
        rows.append((i, " ".join(w), "en", "code" if code else "prose", 0))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, DOC)).collect()}
    assert not got.pop(1) and all(got.values())


def brute_quality(rows):
    """kept of (doc_id, text, lang, source) rows: fences in plain Python."""
    measured, sketches = [], defaultdict(Counter)
    for i, t, lang, source in rows:
        words = WORD.findall(t or "")
        n, chars, lines = len(words), sum(map(len, words)), [x for x in (t or "").split("\n") if WORD.search(x)]
        tri = Counter(tuple(words[k : k + 3]) for k in range(n - 2))
        cover = {j for k in range(n - 2) if tri[tuple(words[k : k + 3])] >= 2 for j in (k, k + 1, k + 2)}
        rates = {
            "symbol_rate": 1000 * len(re.findall(r"[#*$%&|<>]", t or "")) // max(chars, 1), "dup_line_rate": 1000 * (len(lines) - len(set(lines))) // max(len(lines), 1),
            "repeat_rate": 1000 * len(cover) // max(n, 1), "word_length": 1000 * chars // max(n, 1),
        }
        failed = n < 50 or 100 * len(cover) > 50 * n
        measured.append((i, lang, source, failed, rates))
        if not failed:
            for m, v in rates.items():
                unit = 2 ** max(0, v.bit_length() - 7)
                for group in ((lang, source), (lang,), ()):
                    sketches[group, m][v - v % unit] += 1

    def quantile(sketch, p):
        upto = 0
        for b in sorted(sketch):
            upto += sketch[b]
            if 100 * upto >= p * sum(sketch.values()):
                return b

    out = []
    for i, lang, source, failed, rates in measured:
        kept = not failed
        for m, v in rates.items() if kept else ():
            sketch = next((s for s in (sketches[(lang, source), m], sketches[(lang,), m]) if sum(s.values()) >= 100), sketches[(), m])
            q10, q25, q75, q90 = (quantile(sketch, p) for p in (10, 25, 75, 90))
            grain = quality_rules.FLOORS[m]
            kept &= v <= max(q75 + 6 * (q75 - q25), q90 + grain)
            kept &= m != "word_length" or v >= min(q25 - 6 * (q75 - q25), q10 - grain)
        out.append((i, kept))
    return out


def test_quality_fences_by_brute_force(spark):
    """Realistic rates: what is usual in one source is rejected in another, by its quantiles."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1200):
        lang, source = ("en", "de", None)[i % 3], ("code", "prose", "rare")[i // 3 % 3] if i % 40 else None
        w = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(int(rng.integers(40, 160)))]
        marks = 0.4 if source == "code" else 0.0
        if i % 50 == 7:
            marks = 0.5
        w = [x + "#" if rng.random() < marks else x for x in w]
        if i % 61 == 0:
            w = [x * 3 for x in w]
        sep = rng.choice([" ", "\n"], len(w), p=[0.9, 0.1])
        t = "".join(a + b for a, b in zip(w, sep))
        rows.append((i, "\n".join([t[:60]] * 9 + [t]) if i % 70 == 3 else t, lang, source))
    rows += [rows[5], (None, *rows[6][1:]), (None, None, None, None), (9000, "word " * 400_000, "en", "prose")]
    df = spark.createDataFrame([(*r, 0) for r in rows], DOC)
    got = [(r["doc_id"], r["kept"]) for r in quality_rules.quality_rules(df).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = brute_quality(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = dict(want)
    odd = [i for i in range(1200) if i % 50 == 7 and rows[i][1].count(" ") > 60]
    assert any(kept[i] for i in odd if rows[i][3] == "code") and not any(kept[i] for i in odd if rows[i][3] == "prose")


def test_language_id(spark):
    rng = np.random.default_rng(0)
    letters = {"aa": "abcdef", "bb": "uvwxyz", "cc": "klmnop"}
    rows = []
    for i in range(300):
        lang = list(letters)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(30)), lang, f"h{i % 3}.org", 0))
    rows += [(1000, None, "aa", "h0.org", 0), (1001, "", None, None, 0), (1002, "!!! 123", "bb", "h1.org", 0)]
    df = spark.createDataFrame(rows, DOC)
    got = {r["doc_id"]: r for r in language_id.identify_documents(df).collect()}
    assert all(got[i]["lang_pred"] == list(letters)[i % 3] and got[i]["kept"] for i in range(300))
    assert not any(got[i]["kept"] for i in (1000, 1001, 1002)) and got[1000]["lang_pred"] == "aa"
    assert language_id.identify_documents(df.limit(0)).count() == 0
    # held out: fitted on even rows, tried on odd ones without any other evidence
    model = language_id.fit(df.filter("doc_id % 2 = 0"))
    odd = df.filter("doc_id % 2 = 1 AND doc_id < 1000").select(F.col("doc_id").alias("id"), "text", *[F.lit(None).cast("string").alias(c) for c in ("declared", "suffix", "host")])
    assert all(r["lang_pred"] == list(letters)[r["id"] % 3] for r in language_id.identify(odd, model).collect())


def test_language_evidence_of_pages(spark):
    rows = [(0, "https://www.shop.de/x", '<html lang="en-GB"><p>a', "en", "de"), (1, "http://a.com/fr/1", "<HTML LANG=fr>", "fr", "fr"), (2, None, None, None, None), (3, "https://x.org/", "<p>", "", None)]
    df = spark.createDataFrame(rows, "id int, url string, html string, d string, s string")
    for r in df.select("d", "s", language_id.declared_in(F.col("html")).alias("dd"), language_id.suffix_of(F.col("url")).alias("ss")).collect():
        assert (r["dd"], r["ss"]) == (r["d"], r["s"])


def brute_pages(pages, model):
    """Posteriors of (page_id, url, html) rows in plain Python."""
    languages, table = model
    k, found = len(languages), {}
    visible = re.compile(r"<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[a-z]+;", re.I | re.S)
    for i, url, html in pages:
        text = visible.sub(" ", html or "")
        raw = f"  {text.lower()} ".encode()
        sums = np.zeros(k)
        for x, y, z in zip(raw, raw[1:], raw[2:]):
            sums += table[(((x << 16) + (y << 8) + z) * 2654435761 % 2**32) >> 17]
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", url or "")
        said = re.search(r"""<html[^>]*\slang\s*=\s*["']?([A-Za-z]{2,3})""", html or "", re.I)
        folder = re.match(r"[a-z][a-z0-9+.-]*://[^/]+/([a-z]{2})(?:[/?#]|$)", (url or "").lower())
        host = host and host[1].lower()
        suffix = folder[1] if folder else language_id.SUFFIXES.get((host or "").rpartition(".")[2])
        found[i] = ((sums - sums.max()) / 3, sum(c.isalpha() for c in text), host, said and said[1].lower(), suffix)
    hosts, domains = defaultdict(lambda: np.zeros(k)), defaultdict(lambda: np.zeros(k))
    for scores, letters, host, _, _ in found.values():
        if letters and host:
            hosts[host][scores.argmax()] += 1
            domains[".".join(host.split(".")[-2:])][scores.argmax()] += 1
    every = sum(hosts.values())
    base = (every + 1) / (every.sum() + k)
    out, gains = {}, {}
    for at, usual in ((3, 0.9), (4, 0.8)):
        for x in languages:
            stated = [f for f in found.values() if f[1] and f[at] == x]
            right = (sum(languages[f[0].argmax()] == x for f in stated) + 20 * usual) / (len(stated) + 20)
            right = min(max(right, 1 / k), 0.995)
            gains[at, x] = np.log(right) - np.log((1 - right) / (k - 1))
    for i, (scores, letters, host, said, suffix) in found.items():
        logs = scores + np.log(base)
        if host in hosts:
            d = domains[".".join(host.split(".")[-2:])]
            p = (d + 20 * base) / (d.sum() + 20)
            logs = scores + np.log((hosts[host] + 20 * p) / (hosts[host].sum() + 20))
        for at, x in ((3, said), (4, suffix)):
            if x in languages:
                logs = logs + np.array([gains[at, x] if x == y else 0.0 for y in languages])
        posterior = 1 / np.exp(logs - logs.max()).sum()
        out[i] = (languages[logs.argmax()], posterior, languages[scores.argmax()] if letters else None, bool(letters) and posterior >= 0.6)
    return out


def test_language_id_takes_pages_whole(spark, tmp_path):
    """The registered query: all documents and all pages, the latter against brute force."""
    rng = np.random.default_rng(5)
    letters = {"de": "abcdefgh", "en": "efghijkl", "fr": "ijklmnop"}
    text = lambda x, n: " ".join("".join(rng.choice(list(letters[x]), 5)) for _ in range(n))
    langs = list(letters)
    docs = spark.createDataFrame([(i, text(langs[i % 3], 30), langs[i % 3], f"src{i % 5}", 0) for i in range(90)], DOC)
    pages = []
    for i in range(120):
        x, y = langs[i % 3], langs[(i + i // 40) % 3]
        mixed = text(x, i % 4) + " " + text(y, 1)
        url = [f"https://w{i % 2}.{x}a.org/{y}/{i}", f"http://shop{i % 4}.b.{x}", f"HTTP://{x}a.org:80/x?y", None][i // 2 % 4]
        pages.append((i, url, f'<html{f" lang={y!r}" if i % 5 else ""}><script>{text(y, 9)}</script><p>{mixed}&amp;</p>'))
    pages += [(200, "http://w0.dea.org/", None), (201, None, "<p>12 !</p>"), (202, "no address", ""), (203, "http://new.fr/", "<html lang=xx>9")]
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    rows = queries.op10_language_id(spark, f"file://{tmp_path}").collect()
    assert sorted(r["doc_id"] for r in rows if r["kind"] == "document") == list(range(90))
    got = {r["page_id"]: r for r in rows if r["kind"] == "page"}
    want = brute_pages(pages, language_id.fit(docs))
    assert len(rows) == 90 + len(pages) and got.keys() == want.keys()
    for i, (pred, posterior, text_lang, kept) in want.items():
        r = got[i]
        assert (r["lang_pred"], r["text_lang"], r["kept"]) == (pred, text_lang, kept)
        assert r["posterior"] == pytest.approx(posterior, abs=1e-4)


def test_language_id_many_languages_and_ties(spark, monkeypatch):
    """70 languages, texts over several steps, equal posteriors, repeated rows and rows without an id."""
    monkeypatch.setattr(language_id, "CELLS", 70 * 1024)
    rng = np.random.default_rng(6)
    words = {f"l{k:02d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for k in range(70)}
    langs = list(words)
    rows = [(i, " ".join(rng.choice(words[langs[i % 70]], 40)), langs[i % 70], None, 0) for i in range(490)]
    rows += [(1000, " ".join(rng.choice(words["l07"], 3000)), None, None, 0)] * 2 + [(None, rows[3][1], "l03", None, 0)]
    got = language_id.identify_documents(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert all(by[i][0]["lang_pred"] == langs[i % 70] and by[i][0]["kept"] for i in range(490))
    assert len(by[1000]) == 2 and by[1000][0] == by[1000][1] and by[1000][0]["lang_pred"] == "l07" and by[None][0]["lang_pred"] == "l03"
    # a model that knows nothing: equal posteriors, the first in the alphabet
    flat = (["aa", "bb"], np.zeros((language_id.BUCKETS, 2), np.float32))
    ask = spark.createDataFrame([(1, "some text")], "id long, text string").select("id", "text", *[F.lit(None).cast("string").alias(c) for c in ("declared", "suffix", "host")])
    (r,) = language_id.identify(ask, flat).collect()
    assert (r["lang_pred"], r["posterior"], r["kept"]) == ("aa", 0.5, False)


def brute_components(texts):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    for i, j in {p for ids in by.values() for p in itertools.combinations(sorted(ids), 2)}:
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join(docs, none, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute_components(texts)
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_join_small_sets(spark):
    """Sets of a few shingles, where bands are narrow and parts often empty."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(1, 24)).tolist()) for _ in range(250)] + ["", None, "A b", "a B"]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == brute_components(texts)


def test_partenum_signatures_meet():
    """Any two sets that link share a signature, and each at least its bound of them: sizes 1 to 1500."""
    rng = np.random.default_rng(12)
    sets, pairs = [], []
    for n in [*range(1, 60)] * 6 + [75, 79, 80, 100, 159, 160, 161, 200, 319, 320, 333, 420, 600, 639, 640, 700, 1000, 1279, 1500] * 3:
        r = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(3):
            # as many differences as a link allows, on one side or on both
            least = rng.integers(0, n // 4 + 1)
            both = np.delete(r, rng.choice(n, least, replace=False))
            more = max(0, (4 * len(both)) // 3 - n)
            s = np.sort(np.concatenate([both, rng.integers(0, 1 << 63, rng.integers(0, more + 1), dtype=np.uint64)]))
            if 4 * len(both) >= 3 * (n + len(s) - len(both)):
                pairs.append((len(sets), len(sets) + 1))
                sets += [r, s]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    sig, row, code = jaccard_join.signatures(np.concatenate(sets), bounds)
    of = defaultdict(lambda: defaultdict(set))
    for x, i, c in zip(sig.tolist(), row.tolist(), code.tolist()):
        of[i][c // jaccard_join.CODE].add((x, c % jaccard_join.CODE))
    met = 0
    for a, b in pairs:
        mine, other = of[a], {x for v in of[b].values() for x, _ in v}
        enough = [len({x for x, _ in v} & other) >= max(n for _, n in v) for v in mine.values() if {x for x, _ in v} & other]
        assert any(enough), (len(sets[a]), len(sets[b]))
        met += 1
    assert met > 500


def test_jaccard_documents_of_several_texts(spark):
    """A document links if any of its texts does, also where another of its texts is a copy."""
    rng = np.random.default_rng(13)
    a, b, c = (" ".join(f"{x}{i}" for i in rng.integers(0, 9999, 80)) for x in "abc")
    near = " ".join(b.split()[:-2] + ["other", "end"])
    rows = [(1, a), (5, a), (5, b), (9, near), (9, near), (12, c), (13, None), (13, c), (None, b), (20, "x y z"), (21, "X y\tz"), (21, a.upper())]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOC)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect())
    of = {1: 1, 5: 1, 9: 1, 12: 12, 13: 12, 20: 1, 21: 1, None: None}
    size = lambda t: 0 if not t else max(1, len(t.split()) - 4)
    want = sorted((i is None, i or 0, size(t), of[i]) for i, t in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and {g[1:] for g in got} == {w[1:] for w in want}


def brute_links(rows):
    """Links of (doc_id, text) rows; a document links if any of its texts does."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = defaultdict(set)
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i].add(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    out = Counter({i: 0 for i in sets})
    for i, j in itertools.combinations([i for i in sets if i is not None], 2):
        if any(a & b and 4 * len(a & b) >= 3 * len(a | b) for a in sets[i] for b in sets[j]):
            out[i] += 1
            out[j] += 1
    return out


@pytest.mark.parametrize("star", [2_000, 7])
def test_jaccard_link_counts(spark, tmp_path, monkeypatch, star):
    """The registered query gives all links: of near and exact copies, chains, repeated and null ids."""
    monkeypatch.setattr(jaccard_join, "STAR", star)
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(list("abc"), rng.integers(1, 24)).tolist()) for _ in range(80)]
    for _ in range(4):
        t = rng.choice(words, 150).tolist()
        for _ in range(16):  # each from the one before, so the ends are apart
            texts += [" ".join(t)] * int(rng.integers(1, 3))
            t[rng.integers(150)] = str(rng.choice(words))
    rows = list(enumerate([*texts, None, "", "One", "one"])) + [(90, texts[130]), (90, texts[-1]), (91, texts[91]), (91, texts[3]), (5, None), (None, texts[90])]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOC)
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op8_jaccard_join(spark, f"file://{tmp_path}").select("doc_id", "n_links").collect()
    assert len(got) == len(rows)
    want = brute_links(rows)
    assert {(r["doc_id"], r["n_links"]) for r in got} == set(want.items())


def test_jaccard_sets_with_a_passage_in_common_are_no_family(spark, monkeypatch):
    """They travel a few times at most, not once for each block of all that share the passage."""
    sent, written = {}, jaccard_join.written

    def counted(df, name="table"):
        out = written(df, name)
        sent[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "written", counted)
    monkeypatch.setattr(jaccard_join, "BLOCK", 1000)
    monkeypatch.setattr(jaccard_join, "LEAST_BLOCK", 1000)
    rng = np.random.default_rng(17)
    words = [f"w{i}" for i in range(5000)]
    passage = rng.choice(words, 70).tolist()
    texts = [" ".join(rng.choice(words, 20).tolist() + passage + rng.choice(words, 20).tolist()) for _ in range(150)]
    t = rng.choice(words, 150).tolist()
    for _ in range(20):
        texts.append(" ".join(t))
        t[rng.integers(150)] = str(rng.choice(words))
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, count_links=False).collect()}
    assert got == brute_components(texts)
    assert sent["blocks"] <= 3 * len(texts)


def test_linked_sets_share_a_tie(spark):
    """Also if an id comes twice with one text, and if most shingles are in one set only."""
    rng = np.random.default_rng(19)
    words, texts = [f"w{i}" for i in range(900)], []
    for n in (6, 9, 40, 41, 42, 43, 150):
        t = rng.choice(words, n).tolist()
        for _ in range(12):
            texts.append(" ".join(t))
            t[rng.integers(n)] = str(rng.choice(words))
    rows = [(i, t) for i, t in enumerate(texts) for _ in range(1 + i % 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    members = spark.range(len(texts)).select(F.lit(0).alias("sig"), F.col("id").alias("doc_id"), F.lit(0).alias("code"), F.col("id").alias("component"))
    ties = defaultdict(set)
    for r in jaccard_join._ties(members, docs).collect():
        ties[r["doc_id"]].add(r["sig"])
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    linked = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    assert len(linked) > 50 and all(ties[i] & ties[j] for i, j in linked)
    assert all(len(ties[i]) <= len(s) // 4 + 1 for i, s in enumerate(sets))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(300, 300)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}, 300: 300}


def byte_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing(docs, none, texts):
    got = packing.pack_documents(docs, BYTES, 2).toPandas()
    for i, ids in enumerate(byte_ids(texts)):
        p = got[got.doc_id == i].sort_values("piece")
        assert p.piece.tolist() == list(range(len(p))) and p.length.sum() == len(ids)
        assert all(n == 1024 for n in p.length.tolist()[1:])
        for s, n, c in zip(p.start, p.length, p.ids_crc32):
            assert zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 1024
    assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 1024) + 1
    assert packing.pack_documents(none, BYTES, 2).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(1024, 1024, 1024**2), (1024, 3, 1024**2), (1024, 50, 500_000)])
def test_packing_plan_keeps_every_capacity(rule, caps):
    rng = np.random.default_rng(2)
    counts = Counter(rng.integers(1, 700, 3000).tolist())
    used = Counter()
    for content, n in packing.plan(dict(counts), caps, rule=rule):
        assert sum(content) <= caps[0] and len(content) <= caps[1] and sum(x * x for x in content) <= caps[2]
        for x in content:
            used[x] += n
    assert used == counts


def test_packing_weights_choose_bins():
    """Residual documents and cost take part in the choice, not only tokens."""
    rng = np.random.default_rng(4)
    counts = dict(Counter(rng.integers(1, 900, 4000).tolist()))
    plans = [packing.plan(dict(counts), weights=w, rule="dot") for w in ((1.0, 0.0, 0.0), (1.0, 0.05, 0.05), (0.1, 1.0, 1.0))]
    assert len({tuple(sorted(p)) for p in plans}) == 3
    fewest = -(-sum(k * n for k, n in counts.items()) // 1024)
    assert all(fewest <= sum(n for _, n in p) <= 1.02 * fewest for p in plans[:2])
    tight = packing.plan(dict(counts), (1024, 2, 1024**2))
    assert max(len(c) for c, _ in tight) == 2 < max(len(c) for c, _ in plans[1])


def test_wavelet(docs, none, texts, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want, start = {}, 0
    for i, e in enumerate(t.encode_batch([x or "" for x in texts], add_special_tokens=False)):
        ids = np.array([*e.ids, 1], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = f"file://{tmp_path}/w"
    manifest = wavelet.write_shards(docs, WORDS, 1, path, shard_tokens=5000)
    assert manifest.count() > 3
    assert {r[0]: tuple(r[1:]) for r in wavelet.read_shards(manifest, path).collect()} == want
    assert wavelet.round_trip(none, WORDS, 1).count() == 0


def test_wavelet_rank_and_select():
    rng = np.random.default_rng(1)
    for n in (0, 1, 64, 700):
        a = rng.integers(0, 300, n).astype(np.uint32)
        s = wavelet.Shard(wavelet.dump(np.array([9]), np.array([0, n]), a, 9))
        assert (s.ids() == a).all() and all(s.access(i) == a[i] for i in range(0, n, 11))
        for v in (0, 17, 299, 600):
            at = np.flatnonzero(a == v)
            assert s.rank(v, n // 4, n) == (at >= n // 4).sum()
            assert [s.select(v, k) for k in range(len(at) + 1)] == [*at, -1]


def test_warc(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    long = "payload " * 40
    pages = [(1, "http://a/ b\r\nX: 1", fake * 3 + "tail"), (2, None, None), (3, "u", ""), (4, "é", long), (7, "x", long), (5, "y", long), (6, "z", "short"), (8, "z", "short"), (9, "q", "\r\n\r\n" + fake), (None, "n", long)]
    pages += [(100 + i, f"http://h/{i}", fake + "é" * i) for i in range(120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(df, path)
    for size in (1 << 20, 700):  # ranges that hold many records, and records that span ranges
        got = {r["page_id"]: r for r in warc.read_archives(spark, path, size).collect()}
        assert len(got) == len(pages)
        first = {}
        for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
            raw = (h or "").encode()
            r = got[i]
            assert (r["payload_bytes"], r["payload_digest"], r["digest_ok"]) == (len(raw), hashlib.sha256(raw).hexdigest(), True)
            of = first.setdefault(raw, i)
            twin = len(raw) >= 100 and of != i
            assert (r["record_type"], r["refers_to"]) == (("revisit", of) if twin else ("response", None))


def test_warc_long_urls(spark, tmp_path):
    """Headers longer than the window, also over many ranges, do not end the chain."""
    n = warc.HEADER_BYTES
    urls = ["http://a/", "data:," + "x" * (n + 5), "http://b/", "data:," + " " * n, "u" * (n - 200), "data:," + "WARC/1.1" * n, "http://c/"]
    pages = [(i, u, f"page {i} WARC/1.1\r\n" * 30) for i, u in enumerate(urls * 2)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(df, path)
    for size in (4 << 20, 1 << 16):
        got = {r["page_id"]: r for r in warc.read_archives(spark, path, size).collect()}
        assert {i: (r["payload_bytes"], r["digest_ok"]) for i, r in got.items()} == {i: (len(h), True) for i, _, h in pages}


def test_warc_damage_is_no_silent_loss(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"text {i} " * 20) for i in range(9)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/w")
    (file,) = [f for f in (tmp_path / "w").iterdir() if f.suffix == ".txt"]
    raw = file.read_bytes()
    at = raw.index(b"WARC/1.1", 10)
    (tmp_path / "damaged").mkdir()
    (tmp_path / "damaged" / "a.warc").write_bytes(raw[:at] + b"X" + raw[at + 1 :])
    with pytest.raises(ValueError, match="broken"):
        warc.read_archives(spark, f"file://{tmp_path}/damaged")
    assert warc.read_archives(spark, f"file://{tmp_path}/damaged", strict=False).count() == 1
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.warc").write_bytes(b"no archive")
    with pytest.raises(ValueError, match="broken"):
        warc.read_archives(spark, f"file://{tmp_path}/none")


def test_long_texts_null_and_repeated_rows(spark):
    """A text of megabytes, repeated rows, rows without an id, in all operators on documents."""
    long = " ".join(f"word{i % 977} {i}" for i in range(250_000)) + " " * 20_000 + "é" * 200_000
    rows = [(7, long), (7, "twice said"), (7, "twice said"), (None, "no id"), (None, None), (8, "x" * 1_000_000), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    key = lambda i, *x: (i is None, i or 0, *x)
    lib = unigram_library()
    want = sorted(key(i, len(lib.encode(t or ""))) for i, t in rows)
    assert sorted(key(r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(df, PIECES).collect()) == want
    assert sorted(key(r["doc_id"], r["n_tokens"]) for r in suffix_encode.digests(df, PIECES).collect()) == want
    assert len(language_id.identify_documents(df).collect()) == len(rows)
    got = [key(r["doc_id"], r["n_words"]) for r in quality_rules.quality_rules(df).collect()]
    assert sorted(got) == sorted(key(i, len(WORD.findall(t or ""))) for i, t in rows)
    packed = packing.pack_documents(df, BYTES, 2).toPandas()
    ids = byte_ids([t for _, t in rows])
    assert packed.length.sum() == sum(map(len, ids)) and (packed.groupby("sequence_id").length.sum() <= 1024).all()
    assert len(packed) == sum(-(-len(x) // 1024) for x in ids)
    for _, s in packed.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    back = wavelet.round_trip(df, WORDS, 1).toPandas().sort_values("start")
    assert back.start.tolist() == (back.n_tokens.cumsum() - back.n_tokens).tolist() and [None if np.isnan(i) else i for i in back.doc_id] == [None, None, 7, 7, 7, 8, 9]
    assert sorted(key(None if np.isnan(i) else i, n) for i, n in zip(back.doc_id, back.n_tokens)) == sorted(
        key(i, 1 + len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows
    )
    linked = jaccard_join.jaccard_components(df).collect()
    assert sorted(key(r["doc_id"], r["component_id"] or 0, r["n_links"]) for r in linked) == sorted(key(i, i or 0, 0) for i, _ in rows)


def test_warc_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hnsw_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 12)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[40] *= 5
    x[200:260] = x[40]  # more equal vectors than are asked for
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(20, x[20].tolist(), 0), (5000, None, 0), (5020, [0.0] * 12, 0), (5040, [float("nan")] * 12, 0), (5060, [1.0], 0), (5080, [None] * 12, 0)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("score", T.IntegerType())]))
    got = hnsw.nearest(df, "vec_id", "embedding", 20, 20).toPandas()
    assert set(got.query_id) == set(range(0, 1500, 20))
    hit = 0
    for q, g in got.groupby("query_id"):
        s = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, s[g.vec_id])
        hit += len(set(order) & set(g.vec_id))
    assert hit / len(got) >= 0.9
    assert got[got.query_id == 40].sort_values("rank").vec_id.tolist()[:20] == list(range(200, 220))
    assert hnsw.nearest(df.limit(0), "vec_id", "embedding", 20, 20).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_their_sql(spark, name):
    """Whole driver tables of the smallest size, row by row."""
    import duckdb

    sf = Path("/root/testdata/sf0.001")
    if not sf.exists():
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, str(sf)).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    clean = lambda x: [r.replace(".0,", ",").replace(".0]", "]") for r in rows(x)]
    assert clean(got) == clean(want)


def test_written_tables_leave_no_shuffle_files(spark):
    """What was shuffled for a table is gone soon after, though nobody collects garbage."""
    import time

    from fieldspark.sources import scratch

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: sum(f.getName().startswith("shuffle_") for f in (lambda a: [a.apply(i) for i in range(a.size())])(blocks.getAllFiles()))
    before, told = count(), spark.conf.get(scratch.CLEANUP, None)
    got = scratch.written(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count(), "k")
    assert sorted(got.collect()) == [(k, 100) for k in range(10)] and spark.conf.get(scratch.CLEANUP, None) == told
    for _ in range(50):
        if count() <= before:
            return
        time.sleep(0.1)
    raise AssertionError(f"{count() - before} shuffle files remain")
