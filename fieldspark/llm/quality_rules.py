"""Quality rules with thresholds that follow each language and source.

Every text gets integer measures.  Per (lang, source) each measure goes into
a mergeable quantile sketch: a histogram whose bin is the measure's seven
leading binary digits (relative error below 1/64, counts simply add up).
Groups too small to stand alone take the merged sketch of their language,
then that of all rows.  Upper and lower fences around the quartiles replace
fixed cutoffs, and the fences are joined back to filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import written

#: White space between words; all else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: A (lang, source) or lang group with fewer texts uses the next larger one.
MIN_GROUP = 100
#: Fence = quartile -+ this many quartile ranges, and never nearer to the outer
#: tenth of the group than the measure's own grain (in its unit, thousandths):
#: what one phrase or line said twice does to a short text, a few marks, one
#: letter a word.
FENCE = 6
FLOORS = {"symbol_rate": 30, "dup_line_rate": 400, "repeat_rate": 300, "word_length": 1000}
LOW_SIDED = ("word_length",)


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text.

    n_words; word_chars: code points in words; n_symbols; n_lines: lines with
    a word; n_dup_lines: those that equal an earlier line; n_repeat_words:
    words inside three-word windows that the text holds twice or more.  A null or empty
    text has zeros.  Any other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", "lang", "source", text.alias("text"))
    df = df.select(
        "doc_id", "lang", "source",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda s: s.rlike(WORD)).alias("lines"),
    )
    windows = F.when(
        F.size("words") >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size("words") - 3),
                lambda i: F.struct(
                    F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("w"),
                    i.alias("at"),
                ),
            )
        ),
    ).otherwise(F.array().cast("array<struct<w:string,at:int>>"))
    df = df.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # equal windows are neighbours once sorted; a covered run of words counts once
    twice = F.sort_array(
        F.transform(
            F.filter(
                "windows",
                lambda x, i: F.coalesce(x["w"] == F.get("windows", i - 1)["w"], F.lit(False))
                | F.coalesce(x["w"] == F.get("windows", i + 1)["w"], F.lit(False)),
            ),
            lambda x: x["at"],
        )
    )
    df = df.withColumn("twice", twice).drop("windows")
    covered = F.aggregate(
        "twice",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, at: F.struct((acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n"), at.alias("last")),
    )["n"]
    return df.withColumn("n_repeat_words", covered).drop("twice")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _rates() -> dict[str, Column]:
    def rate(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.floor(1000 * F.col(a) / F.col(b))).otherwise(0).cast("long")

    return {
        "symbol_rate": rate("n_symbols", "word_chars"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "word_length": rate("word_chars", "n_words"),
    }


def sketch(measures: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: the mergeable sketches of all groups.

    Texts that fail the base rules are left out.  Null lang or source form
    groups of their own.
    """
    rates = _rates()
    long = measures.filter(~base_failed()).select(
        "lang", "source", F.explode(F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), v)])).alias("measure", "value")
    )
    unit = F.expr("shiftleft(1L, greatest(0, length(bin(value)) - 7))")
    return long.groupBy("lang", "source", "measure", (F.col("value") - F.col("value") % unit).alias("bin")).agg(
        F.count("*").alias("n")
    )


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    """Merges sketches into those of larger groups."""
    return sketches.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))


def _fences(sketches: DataFrame, *by: str) -> DataFrame:
    """Per group and measure: rows, and the allowed range."""
    w = Window.partitionBy(*by, "measure")
    up = sketches.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    q = {p: F.min(F.when(100 * F.col("upto") >= p * F.col("all"), F.col("bin"))) for p in (10, 25, 75, 90)}
    out = up.groupBy(*by, "measure").agg(F.max("all").alias("all"), *[c.alias(f"q{p}") for p, c in q.items()])
    floor = F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv])[F.col("measure")]
    spread = FENCE * (F.col("q75") - F.col("q25"))
    return out.select(
        *by, "measure", "all",
        F.greatest(F.col("q75") + spread, F.col("q90") + floor).alias("hi"),
        F.when(F.col("measure").isin(*LOW_SIDED), F.least(F.col("q25") - spread, F.col("q10") - floor))
        .otherwise(F.lit(-1)).cast("long").alias("lo"),
    )


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row per (lang, source): columns lo_<measure> and hi_<measure>."""
    own = _fences(sketches, "lang", "source").alias("o")
    lang = _fences(merge(sketches, "lang"), "lang").alias("l")
    every = _fences(merge(sketches)).alias("e")
    t = own.join(
        lang, F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.measure") == F.col("l.measure")), "left"
    ).join(every, F.col("o.measure") == F.col("e.measure"), "left")
    pick = lambda c: (
        F.when(F.col("o.all") >= MIN_GROUP, F.col(f"o.{c}")).when(F.col("l.all") >= MIN_GROUP, F.col(f"l.{c}")).otherwise(F.col(f"e.{c}"))
    )
    t = t.select("o.lang", "o.source", "o.measure", pick("lo").alias("lo"), pick("hi").alias("hi"))
    return t.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}") for m in FLOORS for c in ("lo", "hi")]
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measures, base_failed and kept for every row of ``docs``.

    kept: the base rules hold and every measure lies within the fences of the
    row's (lang, source).  Repeated rows, and rows without a doc_id, are
    judged alike; an empty table gives an empty result.
    """
    measured = written(base_measures(docs), "quality")
    limits = thresholds(sketch(measured))
    d, t = measured.alias("d"), limits.alias("t")
    joined = d.join(
        t, F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source")), "left"
    )
    within = F.lit(True)
    for name, value in _rates().items():
        within &= value.between(F.col(f"lo_{name}"), F.col(f"hi_{name}"))
    return joined.select(
        "d.doc_id", "d.n_words", "d.word_chars", "d.n_symbols", "d.n_dup_lines", "d.n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(within, F.lit(False))).alias("kept"),
    )


#: The same rows as ``quality_rules(documents)``, for an SQL engine with lists.
SQL = r"""
WITH w AS (
  SELECT doc_id, lang, source,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
tri AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t
  FROM w, range(1, len(words) - 1) r(i)),
rep AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c >= 2)
  GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbol_rate,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_rate,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_rate,
    CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length
  FROM m),
v AS (
  SELECT lang, source, 'symbol_rate' AS measure, symbol_rate AS value FROM r WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'dup_line_rate', dup_line_rate FROM r WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'repeat_rate', repeat_rate FROM r WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'word_length', word_length FROM r WHERE NOT base_failed),
b AS (
  SELECT lang, source, measure, value - value % CAST(2 ** greatest(0, length(bin(value)) - 7) AS BIGINT) AS bin, count(*) AS n
  FROM v GROUP BY ALL),
g AS (
  SELECT 1 AS tier, lang, source, measure, bin, n FROM b
  UNION ALL SELECT 2, lang, NULL, measure, bin, sum(n) FROM b GROUP BY lang, measure, bin
  UNION ALL SELECT 3, NULL, NULL, measure, bin, sum(n) FROM b GROUP BY measure, bin),
c AS (
  SELECT *, sum(n) OVER (PARTITION BY tier, lang, source, measure ORDER BY bin) AS upto,
    sum(n) OVER (PARTITION BY tier, lang, source, measure) AS total FROM g),
q AS (
  SELECT tier, lang, source, measure, max(total) AS total,
    min(bin) FILTER (100 * upto >= 10 * total) AS q10, min(bin) FILTER (100 * upto >= 25 * total) AS q25,
    min(bin) FILTER (100 * upto >= 75 * total) AS q75, min(bin) FILTER (100 * upto >= 90 * total) AS q90,
    CASE measure WHEN 'symbol_rate' THEN 30 WHEN 'word_length' THEN 1000 WHEN 'repeat_rate' THEN 300 ELSE 400 END AS grain
  FROM c GROUP BY tier, lang, source, measure),
f AS (
  SELECT tier, lang, source, measure, total, greatest(q75 + 6 * (q75 - q25), q90 + grain) AS hi,
    CASE WHEN measure = 'word_length' THEN least(q25 - 6 * (q75 - q25), q10 - grain) ELSE -1 END AS lo FROM q),
t AS (
  SELECT o.lang, o.source, o.measure,
    CASE WHEN o.total >= 100 THEN o.lo WHEN l.total >= 100 THEN l.lo ELSE e.lo END AS lo,
    CASE WHEN o.total >= 100 THEN o.hi WHEN l.total >= 100 THEN l.hi ELSE e.hi END AS hi
  FROM f o JOIN f l ON l.tier = 2 AND l.lang IS NOT DISTINCT FROM o.lang AND l.measure = o.measure
    JOIN f e ON e.tier = 3 AND e.measure = o.measure WHERE o.tier = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce((
    SELECT bool_and(CASE t.measure WHEN 'symbol_rate' THEN symbol_rate WHEN 'dup_line_rate' THEN dup_line_rate
        WHEN 'repeat_rate' THEN repeat_rate ELSE word_length END BETWEEN t.lo AND t.hi)
    FROM t WHERE t.lang IS NOT DISTINCT FROM r.lang AND t.source IS NOT DISTINCT FROM r.source), false) AS kept
FROM r
"""
