"""Chat formatting by Spark expressions only.

Template, for each run of turns by one role::

    <turn>ROLE<role>TEXT<part>TEXT...</turn>\\n

A role's name and the texts are escaped: ``<turn>``, ``<role>``, ``<part>``
and their closing forms get a backslash after ``<`` (one more if there are
some already), so that no control string is left in them and the way back is
exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CONTROL = r"(/?(?:turn|role|part)>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)" + _CONTROL, r"<$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\" + _CONTROL, r"<$1$2")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text).

    Returns conv_id, formatted (string), loss_spans (array of start and length
    in code points of every assistant text in ``formatted``, as escaped there)
    and n_blocks (runs of turns by one role).

    Turns are sorted by turn, then role and text: ties and repeated rows stay,
    in a defined order; a null turn comes first.  Null role or text: empty.
    Rows with a null conv_id form one conversation.  Other columns are
    ignored.  A conversation is one output row, so its turns meet in one row;
    nothing else is gathered.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # first position of each run of one role, then one past the last
    chats = chats.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(0), F.size("turns") - 1),
            lambda i: (i == 0) | (F.get("turns", i - 1)["role"] != F.get("turns", i)["role"]),
        ),
    )
    chats = chats.withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda s, k: F.struct(
                F.get("turns", s)["role"].alias("role"),
                F.transform(
                    F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s),
                    lambda t: escape(t["text"]),
                ).alias("parts"),
            ),
        ),
    )
    # formatted pieces, each with a flag: is it under the loss mask?
    chats = chats.withColumn(
        "pieces",
        F.flatten(
            F.transform(
                "blocks",
                lambda b: F.concat(
                    F.array(_piece(F.concat(F.lit("<turn>"), escape(b["role"]), F.lit("<role>")), F.lit(False))),
                    F.flatten(
                        F.transform(
                            b["parts"],
                            lambda p, i: F.array(
                                _piece(F.when(i > 0, F.lit("<part>")).otherwise(F.lit("")), F.lit(False)),
                                _piece(p, b["role"] == "assistant"),
                            ),
                        )
                    ),
                    F.array(_piece(F.lit("</turn>\n"), F.lit(False))),
                ),
            )
        ),
    )
    ends = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["s"])).alias("at"),
            F.when(
                p["loss"],
                F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.length(p["s"]).cast("long").alias("length")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return chats.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        ends["spans"].alias("loss_spans"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("s"), loss.alias("loss"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """The way back: conv_id, turns (array of role and text) read from ``formatted``."""
    blocks = F.filter(F.split("formatted", "</turn>\n", -1), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(b, "<role>", -1), "<part>", -1),
                lambda p: F.struct(
                    unescape(F.regexp_replace(F.substring_index(b, "<role>", 1), "^<turn>", "")).alias("role"),
                    unescape(p).alias("text"),
                ),
            ),
        )
    )
    return formatted.select("*", turns.alias("turns"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what can be read back from formatted chats."""
    back = parse_chats(formatted).withColumn(
        "loss",
        F.array_join(
            F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), ""
        ),
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


#: The same rows as ``digests(format_chats(conversations))`` with conversation -7.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, regexp_replace(text, '<(\\*)(/?(?:turn|role|part)>)', '<\1\\\2', 'g') AS out_text,
    regexp_replace(role, '<(\\*)(/?(?:turn|role|part)>)', '<\1\\\2', 'g') AS out_role,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM c),
b AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY n) IS DISTINCT FROM role THEN 1 ELSE 0 END AS first FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(out_text)) + sum(first * (20 + length(out_role))) + sum((1 - first) * 6) AS BIGINT) AS formatted_chars,
  CAST(sum(first) AS BIGINT) AS n_blocks
FROM b GROUP BY conv_id
"""
