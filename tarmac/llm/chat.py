"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written ``[INST]role[/INST]text</s>``.  Inside roles and texts a
backslash is doubled and one is put after the first character of ``<s>``,
``</s>``, ``[INST]`` and ``[/INST]``, so no control string survives there and
removing each escaping backslash gives the text back.

Every assistant turn becomes an example: all turns before it as context, then
its reply; only the reply's text is trainable.  A conversation that does not end
with the assistant gives one more example, its whole transcript, with nothing
trainable, so no turn is lost.  All examples of a conversation are prefixes of one
transcript: a row holds where its prefix and its target lie, and the example's
text is cut from the transcript row by row, never held for all at once.

Edge cases: null texts and roles count as empty; turns tie by role, then text
(null turn first); a repeated row is a turn of its own; a null conv_id is a
conversation; a conversation without assistant turns has loss over nothing; an
empty table gives an empty result beside conversation -1; other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import table

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
CONTROL = r"(<(?=/?s>)|\[(?=/?INST\]))"
TARGET_ROLE = "assistant"
PROBE = "</s>[INST] ok [/INST]"


def escape(text: F.Column) -> F.Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def unescape(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def transcripts(turns: DataFrame) -> DataFrame:
    """conv_id, transcript, targets (array of end, loss_start, loss_len, last) for turns (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    t = t.withColumn("body", escape(F.col("text")))
    t = t.withColumn("piece", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE), "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("end", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("last", F.lead(F.lit(False), 1, True).over(order))
    trained = F.col("role") == TARGET_ROLE
    loss_len = F.when(trained, F.length("body")).otherwise(0).cast("long")
    target = F.struct("end", (F.col("end") - len(END) - loss_len).alias("loss_start"), loss_len.alias("loss_len"), "last")
    grouped = t.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("end", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(trained | F.col("last"), target))).alias("targets"),
    )
    return grouped.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("transcript"), "targets")


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_len, last: one training example a row; the loss covers text[loss_start:loss_start + loss_len]."""
    cut = transcripts(turns).select("conv_id", "transcript", F.posexplode("targets").alias("example", "t"))
    text = F.substring("transcript", F.lit(1), F.col("t.end").cast("int"))
    return cut.select("conv_id", "example", text.alias("text"), "t.end", "t.loss_start", "t.loss_len", "t.last")


def read_turns(text: F.Column) -> F.Column:
    """Role and text of every turn of a formatted text, as ``role\\ntext\\n`` strings."""
    pieces = F.filter(F.split(text, END), lambda p: p != "")
    role = lambda p: F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), CLOSE, 1)
    body = lambda p: F.substring_index(p, CLOSE, -1)
    return F.transform(pieces, lambda p: F.concat(unescape(role(p)), F.lit("\n"), unescape(body(p)), F.lit("\n")))


def read_back(made: DataFrame) -> DataFrame:
    """What the formatted examples say of each conversation, read from their texts and masks."""
    loss = unescape(F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), F.col("loss_len").cast("int")))
    seen = made.select(
        "conv_id", "end", F.length("text").cast("long").alias("chars"), loss.alias("loss"), F.when(F.col("last"), read_turns(F.col("text"))).alias("turns")
    )
    per = seen.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("end", "loss"))).alias("losses"), F.flatten(F.collect_list("turns")).alias("turns"), F.sum("chars").alias("formatted_chars")
    )
    text = F.array_join(F.col("losses.loss"), "")
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars",
    )


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of conversation -1, read back from the formatted examples."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET_ROLE).alias("role"), F.lit(PROBE).alias("text")
    )
    return read_back(examples(turns.unionByName(probe)))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, 17 + length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, '\\|</?s>|\[/?INST\]')) AS n FROM c
), p AS (
  SELECT *, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, lead(0, 1, 1) OVER w AS is_last
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR is_last = 1) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
