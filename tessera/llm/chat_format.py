"""Chat formatting by relational operations: collected turns, merged runs, joined strings.

The turns of a conversation are collected as structs and sorted; runs of turns
with one role are merged into one block, whose turns stay marked; blocks are
joined into the text. Everything is a Spark expression.

Template: ``<|im_start|>ROLE<|im_sep|>TEXT<|im_next|>TEXT...<|im_end|>\\n``. Control strings
inside roles and texts are broken by one backslash after their first character,
after all backslashes were doubled: a lone backslash then marks an escape and
nothing else, so escaping is undone exactly.

The loss mask is the list of segments: strings that make up the text when
joined, each with a flag. Segments with the flag are the escaped texts of the
trained roles, one for each turn.

Defined results: null texts and roles are empty; turns with equal numbers are
ordered by role and text, and null numbers come first; repeated rows are turns
of their own; a conversation without turns does not exist; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import col, indices, let

START, SEP, NEXT, STOP = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>\n"
#: Strings that a tokenizer may take as control tokens: fixed values.
CONTROLS = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TRAINED = ("assistant",)


def _lit(text: str) -> Column:
    return F.lit(text)


def escape(text: Column, controls: list[str] | None = None) -> Column:
    """The text with control strings broken; :func:`unescape` undoes it."""
    doubled = F.replace(text, _lit("\\"), _lit("\\\\"))
    return reduce(lambda x, c: F.replace(x, _lit(c), _lit(c[0] + "\\" + c[1:])), controls or CONTROLS, doubled)


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"(?<!\\)\\(?!\\)", ""), _lit("\\\\"), _lit("\\"))


def format_chats(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """(conversation, text, segments): the formatted text, and the same as array of (text, loss)."""
    given = rows.select(
        col(conversation).alias(conversation),
        F.struct(col(turn).alias("turn"), F.coalesce(col(role), _lit("")).alias("role"), F.coalesce(col(text), _lit("")).alias("text")).alias("t"),
    )
    chats = given.groupBy(conversation).agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(turns: Column) -> Column:
        role = F.get(turns, F.lit(0))["role"]
        loss = role.isin(*trained)
        head = segment(F.concat(_lit(START), escape(role), _lit(SEP)), F.lit(False))
        body = F.flatten(F.transform(turns, lambda x, i: F.array(
            segment(F.when(i > 0, _lit(NEXT)).otherwise(_lit("")), F.lit(False)), segment(escape(x["text"]), loss),
        )))
        return F.concat(F.array(head), body, F.array(segment(_lit(STOP), F.lit(False))))

    def merged(turns: Column) -> Column:
        # A run begins where the role differs from the turn before; each run is one slice.
        begins = F.filter(indices(F.size(turns)), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
        return let(begins, lambda b: F.transform(b, lambda s, k: F.slice(turns, s + 1, F.coalesce(F.get(b, k + 1), F.size(turns)) - s)))

    segments = F.filter(F.flatten(F.transform(merged(F.col("turns")), block)), lambda x: (x["text"] != "") | x["loss"])
    out = chats.select(conversation, segments.alias("segments"))
    return out.select(conversation, F.array_join(F.col("segments.text"), "").alias("text"), "segments")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    blocks = F.split(text, r"<\|im_end\|>\n", -1)

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, len(START) + 1, 1 << 30), r"<\|im_sep\|>", 2)
        texts = F.split(F.get(parts, F.lit(1)), r"<\|im_next\|>", -1)
        return let(unescape(F.get(parts, F.lit(0))), lambda role: F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text"))))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescape(x["text"])), "")


OK = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(OK).alias("text"))
    out = format_chats(rows.unionByName(more)).select("conv_id", read_turns(F.col("text")).alias("turns"), read_loss(F.col("segments")).alias("loss"), F.char_length("text").cast("long").alias("formatted_chars"))
    again = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(again.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '{OK}'), (-1, 1, 'assistant', '{OK}')),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, length({_sql_escape('text')}) AS n_text, length({_sql_escape('role')}) AS n_role, before IS NOT DISTINCT FROM role AS follows FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n_text + CASE WHEN follows THEN {len(NEXT)} ELSE n_role + {len(START) + len(SEP) + len(STOP)} END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
