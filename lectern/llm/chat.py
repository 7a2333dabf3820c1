"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only
the reply is trainable. A conversation is collected once, in order, and exploded by its assistant
turns, so the only growth is that of the examples themselves.

A turn reads ``<|role|>`` newline text ``<|end|>`` newline. The prompt ends behind the reply's
role line; train_start and train_end are the reply's place, in characters, in prompt + completion.
What looks like a mark inside a text or a role is escaped, so no text can forge a turn: between ``<``
and ``|``, and between ``|`` and ``>``, one backslash is added to those that are there (none, mostly),
and ``unescape`` takes it away again.

Defined cases: rows without conv_id or turn are left out; roles are lower-cased and trimmed, a null
or blank role reads ``unknown``; a null text is empty; an assistant turn without text is context
only; equal rows (conv_id, turn, role, text) count once; turns with equal numbers go by role, then
text; a conversation without replies gives no example; texts may be of any length; an empty table
gives an empty result; further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|"), r"\|(\\*)>", r"|$1\\>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|"), r"\|\\(\\*)>", r"|$1>")


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, n_context, prompt, completion, train_start, train_end): one row per reply."""
    role = F.lower(F.trim(F.coalesce(F.col("role").cast("string"), F.lit(""))))
    rows = conversations.where("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.when(role == "", "unknown").otherwise(escape(role)).alias("role"), escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")
    )
    said = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("said"))
    one = said.select("conv_id", "said", F.posexplode("said").alias("n_context", "reply")).where("reply.role = 'assistant' and reply.text <> ''")
    before = F.transform(F.slice("said", F.lit(1), F.col("n_context")), lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n")))
    out = one.select(
        "conv_id", F.col("reply.turn").alias("turn"), F.col("n_context").cast("bigint").alias("n_context"),
        F.concat(F.array_join(before, ""), F.lit("<|assistant|>\n")).alias("prompt"), F.concat(F.col("reply.text"), F.lit("<|end|>\n")).alias("completion"),
    )
    return out.withColumn("train_start", F.length("prompt").cast("bigint")).withColumn("train_end", (F.length("prompt") + F.length("completion")).cast("bigint"))


def _sql_escape(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g')"


SQL = f"""
WITH r AS (SELECT DISTINCT conv_id, turn, {_sql_escape("coalesce(nullif(lower(trim(coalesce(role, ''))), ''), 'unknown')")} AS role, {_sql_escape("coalesce(text, '')")} AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT *, row_number() OVER w - 1 AS n_context,
    coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT conv_id, turn, n_context, before || '<|assistant|>' || chr(10) AS prompt, text || '<|end|>' || chr(10) AS completion FROM c WHERE role = 'assistant' AND text <> '')
SELECT *, length(prompt) AS train_start, length(prompt) + length(completion) AS train_end FROM e
"""
