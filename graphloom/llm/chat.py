r"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Each assistant turn becomes an example of its own: all turns up to it as text, and a loss span that covers its reply alone.
A conversation that does not end with an assistant turn also gives one example without a loss span, so that the output holds
every turn. A turn is written as

    ### role: text
    </turn>

and control strings inside texts are escaped: a backslash goes before each backslash, ``### `` and ``</turn>`` of a text,
and before each backslash, colon and ``<`` of a role. An unescaped end mark therefore never stands inside a turn, and taking the
backslashes away gives the text back, whatever it holds.

Turns are ordered by turn (nulls first), then role and text; null roles and texts count as empty; repeated rows are turns of
their own. Rows with a null conv_id are one conversation. A conversation is held as one row: its examples are texts of that
length anyway. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table

END = "\n</turn>\n"
TARGET = "assistant"
_HEAD = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): (.*)$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|### |</turn>)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|### |</turn>)", "$1")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([\\:<])", r"\\$1")


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"\\([\\:<])", "$1")


def examples(conversations: DataFrame, target: str = TARGET) -> DataFrame:
    """conv_id, example (from 0), n_turns (of the example), formatted, loss_start and loss_length (code points; null: nothing)."""
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    by_conv = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    written = by_conv.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit("### "), escape_role(t["role"]), F.lit(": ")).alias("head"), escape(t["text"]).alias("body"))).alias("turns"),
    )
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.element_at("turns", i)["role"] == target) | (i == F.size("turns")))
    one = written.select("conv_id", "turns", F.posexplode(places).alias("example", "n_turns")).withColumn("last", F.element_at("turns", F.col("n_turns")))
    text = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("n_turns")), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    is_target = F.col("last")["role"] == target
    body = F.length(F.col("last")["body"])
    return one.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("n_turns").cast("long").alias("n_turns"),
        text.alias("formatted"),
        F.when(is_target, F.length(text) - len(END) - body).cast("long").alias("loss_start"),
        F.when(is_target, body).cast("long").alias("loss_length"),
    )


def read_back(formatted: Column) -> Column:
    """Array of struct(role, text) from an example's text."""
    parts = F.split(formatted, END)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda s: F.struct(unescape_role(F.regexp_extract(s, _HEAD, 1)).alias("role"), unescape(F.regexp_extract(s, _HEAD, 2)).alias("text")),
    )


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    return F.coalesce(unescape(F.substring(formatted, (start + 1).cast("int"), length.cast("int"))), F.lit(""))


def digests(out: DataFrame) -> DataFrame:
    """One row a conversation, from the examples alone; they lie together already, so nothing is shuffled."""
    seen = out.select(
        "conv_id",
        F.struct("n_turns", "example", "formatted").alias("longest"),
        F.struct("example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    by_conv = seen.groupBy("conv_id").agg(F.max("longest").alias("longest"), F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"))
    turns = read_back(F.col("longest")["formatted"])
    loss = F.array_join(F.transform("loss", lambda x: x["loss"]), "")
    text = by_conv.select("conv_id", "formatted_chars", turns.alias("turns"), loss.alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return text.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """Conversation -7 tries control strings."""
    spark = conversations.sparkSession
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(probe)


def op2(spark, sf_dir: str) -> DataFrame:
    return digests(examples(with_probe(read_table(spark, sf_dir, "conversations"))))


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
w AS (SELECT *, sum(4 + length(regexp_replace(role, '([\\:<])', '\\\1', 'g')) + 2 + length(regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g')) + 9)
    OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""
