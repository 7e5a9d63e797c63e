"""Language identification by fusing independent kinds of evidence.

posterior(l)  ~  prior(l | host) * P(text | l) * P(declared | l) * P(suffix | l)

* text: a multinomial model of hashed byte trigrams, fitted on a bounded
  sample of labelled rows;
* declared markup language: the ``lang`` attribute of ``<html>`` (or a column
  that states it).  How often a declaration of each language is right is
  counted over all rows, by agreement with the texts, and smoothed;
* address suffix: a language folder at the start of the path, or the country
  ending of the host; likewise;
* host: counts of the languages that the texts alone suggest, by grouped
  aggregation over all rows, smoothed from all rows to the host's domain and
  from the domain to the host.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import slices, small, written

#: Rows that the text model is fitted on, about; drawn by a hash of the id.
SAMPLE_ROWS = 8_000
#: Hash buckets of the text model.
BUCKETS = 1 << 15
#: Log-probabilities that a task looks up at once (trigrams x languages).
CELLS = 1 << 21
#: A text's log-likelihood is divided by this: trigrams overlap.
TEMPER = 3.0
#: How often a declaration and a suffix are right, before any is counted; and at most.
DECLARED_RIGHT, SUFFIX_RIGHT, MOST_RIGHT = 0.9, 0.8, 0.995
#: Pseudo-counts that the larger group lends to the smaller.
PRIOR_WEIGHT = 20.0
#: A row is rejected if its best language is less sure.
MIN_POSTERIOR = 0.6

#: Country endings of hosts and the language most used there.
SUFFIXES = {
    "ar": "es", "at": "de", "au": "en", "bg": "bg", "br": "pt", "cl": "es", "cn": "zh", "co": "es", "cz": "cs", "de": "de",
    "dk": "da", "ec": "es", "ee": "et", "eg": "ar", "es": "es", "fi": "fi", "fr": "fr", "gr": "el", "hr": "hr", "hu": "hu",
    "id": "id", "ie": "en", "il": "he", "ir": "fa", "is": "is", "it": "it", "jp": "ja", "kr": "ko", "lt": "lt", "lv": "lv",
    "mx": "es", "nl": "nl", "no": "no", "nz": "en", "pe": "es", "pl": "pl", "pt": "pt", "ro": "ro", "rs": "sr", "ru": "ru",
    "sa": "ar", "se": "sv", "si": "sl", "sk": "sk", "th": "th", "tr": "tr", "tw": "zh", "ua": "uk", "uk": "en", "us": "en",
    "uy": "es", "ve": "es", "vn": "vi",
}


_NO_LETTER = re.compile(r"[\W\d_]+")


def _buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram of each lower-cased text, and the bounds."""
    raw = [f"  {t.lower()} ".encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw])
    a = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64), np.zeros(len(raw) + 1, np.int64)
    h = a[:-2] * np.uint32(65536) + a[1:-1] * np.uint32(256) + a[2:]
    h = (h * np.uint32(2654435761)) >> np.uint32(17)
    ends = np.cumsum(sizes)
    inside = np.ones(len(a), bool)
    inside[ends - 1] = inside[ends - 2] = False
    keep = inside[: len(h)]
    bounds = np.concatenate([[0], np.cumsum(sizes - 2)])
    return h[keep].astype(np.int64), bounds


def fit(labelled: DataFrame, id_column: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [bucket, language]) from rows of text and lang.

    The sample is drawn by a hash of id and text, about ``sample_rows`` rows,
    the same at any size of cluster, equal rows once; it is the only bounded
    input here.  Nothing is sorted or gathered to draw it.  Any number of
    languages: the driver gets one row per language and bucket of the sample.
    """
    rows = labelled.filter("lang IS NOT NULL")
    share = min(1.0, sample_rows / max(1, rows.count()))
    last = min(-(1 << 63) + int(share * (1 << 64)), (1 << 63) - 1)
    sample = rows.filter((F.xxhash64(id_column, "text") <= last) & F.col("text").isNotNull()).select("text", "lang").distinct()
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            b, bounds = _buckets(batch.column("text").to_pylist())
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            for k, lang in enumerate(names):
                n = np.bincount(b[np.repeat(number == k, np.diff(bounds))], minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], schema=schema)

    counts = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    languages = sorted(got["lang"].unique().tolist())
    place = {x: i for i, x in enumerate(languages)}
    n = np.full((BUCKETS, max(1, len(languages))), 0.5)
    n[got["bucket"].to_numpy(), [place[x] for x in got["lang"]]] += got["n"].to_numpy()
    return languages, np.log(n / n.sum(axis=0)).astype(np.float32)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def declared_in(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z]{2,3})""", 1))


def suffix_of(url: Column) -> Column:
    """Language by a two-letter folder at the start of the path, else by the host's ending."""
    folder = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/]+/([a-z]{2})(?:[/?#]|$)", 1)
    ending = F.regexp_extract(host_of(url), r"\.([a-z]{2})$", 1)
    known = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return F.when(folder != "", folder).otherwise(F.try_element_at(known, ending))


def text_scores(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Keeps all columns of ``rows`` but text; adds scores (array of tempered
    log-likelihoods less the best) and letters (letters in the text)."""
    languages, table = model
    others = [c for c in rows.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            b, bounds = _buckets(texts)
            sums = np.zeros((len(texts), table.shape[1]))
            step = max(1024, CELLS // table.shape[1])
            for lo in range(0, len(b), step):  # a text may lie in several steps
                hi = min(lo + step, len(b))
                first, last = np.searchsorted(bounds, lo, "right") - 1, np.searchsorted(bounds, hi, "left")
                at = np.maximum(bounds[first:last], lo) - lo
                some = np.append(at[1:], hi - lo) > at
                sums[first:last][some] += np.add.reduceat(table[b[lo:hi]], at[some], axis=0, dtype=np.float64)
            sums = np.round((sums - sums.max(axis=1, keepdims=True)) / TEMPER, 6)
            letters = [len(_NO_LETTER.sub("", t)) for t in texts]
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * sums.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel())), pa.array(letters, pa.int64())],
                [*others, "scores", "letters"],
            )

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.drop("text").dtypes)
    return rows.mapInArrow(work, f"{fields}, scores array<double>, letters long")


def _by_language(counts: DataFrame, key: str, name: str) -> DataFrame:
    """key and a map from language number to count; ``counts`` has (key, best, n)."""
    sums = counts.groupBy(key, "best").agg(F.sum("n").alias("n"))
    # at most one entry per language
    return sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias(name))


def _gains(scored: DataFrame, column: str, languages: list[str], usual: float) -> list[float]:
    """Log-odds that evidence naming each language adds to it, from its agreement with the texts."""
    stated = scored.filter((F.col("letters") > 0) & F.col(column).isin(languages))
    agree = F.count(F.when(F.get(F.array(*[F.lit(x) for x in languages]), F.col("best")) == F.col(column), 1))
    found = {r[column]: (r["a"], r["n"]) for r in stated.groupBy(column).agg(agree.alias("a"), F.count("*").alias("n")).collect()}
    out = []
    for x in languages:
        a, n = found.get(x, (0, 0))
        right = (a + PRIOR_WEIGHT * usual) / (n + PRIOR_WEIGHT)
        right = min(max(right, 1 / len(languages)), MOST_RIGHT)
        out.append(math.log(right) - math.log((1 - right) / max(1, len(languages) - 1)))
    return out


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Posterior language of every row.

    ``rows``: id, text, declared, suffix and host; the last three may be null
    (no such evidence).  Returns id, lang_pred (null if nothing is known),
    posterior, text_lang, and kept: the row has letters and the posterior
    reaches MIN_POSTERIOR.  Null or empty text: evidence of the other kinds
    only, and not kept.  Ties go to the language first in the alphabet.
    Repeated rows, and rows without an id, are judged alike.
    """
    languages, _ = model
    if not languages:
        return rows.select(
            "id", F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("posterior"),
            F.lit(None).cast("string").alias("text_lang"), F.lit(False).alias("kept"),
        )
    names = F.array(*[F.lit(x) for x in languages])
    k = len(languages)
    scored = written(text_scores(rows.select("id", "text", "declared", "suffix", "host"), model), "language")
    scored = scored.withColumn("best", F.array_position("scores", F.array_max("scores")).cast("int") - 1)
    known = scored.filter((F.col("letters") > 0) & F.col("host").isNotNull())
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$|(^[^.]+$)", 0)
    counts = written(known.groupBy("host", domain.alias("domain"), "best").agg(F.count("*").alias("n")), "hosts")
    every = {r["best"]: r["n"] for r in counts.groupBy("best").agg(F.sum("n").alias("n")).collect()}
    total = sum(every.values())
    base = F.array(*[F.lit((every.get(i, 0) + 1) / (total + k)) for i in range(k)])
    hosts = _by_language(counts, "host", "here").join(counts.select("host", "domain").distinct(), "host")
    hosts = hosts.join(_by_language(counts, "domain", "around"), "domain")
    weight = F.lit(PRIOR_WEIGHT)
    size = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)
    n_of = lambda m, i: F.coalesce(F.try_element_at(F.col(m), i), F.lit(0))
    smooth = lambda i: (n_of("around", i) + weight * F.get(base, i)) / (size("around") + weight)
    prior = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.log((n_of("here", i) + weight * smooth(i)) / (size("here") + weight)))
    priors = written(hosts.select("host", prior.alias("prior")), "priors")

    fused = scored.join(small(priors), "host", "left").withColumn("prior", F.coalesce("prior", F.transform(base, lambda x: F.log(x))))
    logs = F.zip_with("scores", "prior", lambda a, b: a + b)
    for column, usual in (("declared", DECLARED_RIGHT), ("suffix", SUFFIX_RIGHT)):
        gains = F.array(*[F.lit(g) for g in _gains(scored, column, languages, usual)])
        said = F.array_position(names, F.coalesce(F.col(column), F.lit(""))).cast("int") - 1
        added = F.transform(gains, lambda g, i: F.when(i == said, g).otherwise(0.0))  # noqa: B023
        logs = F.zip_with(logs, added, lambda a, b: a + b)
    fused = fused.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    fused = fused.withColumn("posterior", F.lit(1.0) / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    return fused.select(
        "id",
        F.get(names, F.array_position("logs", F.col("top")).cast("int") - 1).alias("lang_pred"),
        F.round("posterior", 6).alias("posterior"),
        F.when(F.col("letters") > 0, F.get(names, F.col("best"))).alias("text_lang"),
        ((F.col("letters") > 0) & (F.col("posterior") >= MIN_POSTERIOR)).alias("kept"),
    )


def identify_documents(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """``identify`` over documents: lang is the declared language, source the host.
    Without a model one is fitted on them."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), "text", F.lower("lang").alias("declared"),
        suffix_of(F.regexp_extract("text", r"^\s*(https?://\S+)", 1)).alias("suffix"), F.col("source").alias("host"),
    )
    return identify(rows, model or fit(docs)).withColumnRenamed("id", "doc_id")


def identify_pages(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``identify`` over raw pages (page_id, url, html) with a fitted model."""
    visible = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")
    rows = pages.select(
        F.col("page_id").cast("long").alias("id"), visible.alias("text"), declared_in(F.col("html")).alias("declared"),
        suffix_of(F.col("url")).alias("suffix"), F.nullif(host_of(F.col("url")), F.lit("")).alias("host"),
    )
    return identify(rows, model).withColumnRenamed("id", "page_id")


def identify_all(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``identify_documents`` and ``identify_pages`` with the model of the documents.

    kind is document or page; doc_id is null for pages, page_id for documents.
    Hosts of documents and of pages have priors of their own.
    """
    model = fit(docs)
    d = identify_documents(docs, model).withColumns({"kind": F.lit("document"), "page_id": F.lit(None).cast("long")})
    p = identify_pages(pages, model).withColumns({"kind": F.lit("page"), "doc_id": F.lit(None).cast("long")})
    return d.unionByName(p).select("kind", "doc_id", "page_id", "lang_pred", "posterior", "text_lang", "kept")
