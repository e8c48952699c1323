"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has a row for each event of a conversation: conv_id, seq, message_id, kind,
role, text. Kinds: `message` sets a message's role and text, `delta` adds text to
it, `edit` replaces its text, `regenerate` empties it and waits for new deltas,
`delete` takes it out. Events are partitioned by conversation and sorted by seq
(ties by kind, role and text); a message keeps the place of its first event, and
messages of one place are in order of role, text and message_id.

Template: a turn is `### role`, a line feed, the text, `</turn>` and a line feed.
Inside roles and texts a backslash becomes `\\b`, the `#` that begins `###` `\\h`,
the `<` that begins `</turn` `\\l`, and in roles a line feed `\\n`, so neither mark
can occur in what is escaped, and the last replacement undone gives back the
backslash. The loss mask lists spans (turn, start, length) of code points over the
turns of the formatted text.

Defined results: null texts and roles are empty; rows with a null conv_id form one
conversation; an empty table gives no rows; repeated rows are repeated turns;
extra columns are ignored. One conversation is one output value, so it is
gathered in one row, and no more than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillon.llm.common import pick

START, END = "### ", "</turn>\n"
EVENTS = "conv_id long, seq long, message_id long, kind string, role string, text string"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.regexp_replace(out, "#(?=##)", "\\\\h")
    out = F.replace(out, F.lit("</turn"), F.lit("\\l/turn"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescaped(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if role else text
    out = F.replace(F.replace(out, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def folded(events: DataFrame, together: bool = False) -> DataFrame:
    """conv_id and messages, an array of (place, role, text, message_id): the final messages in order. together: a conversation's events are in one partition already."""
    e = pick(events, "conv_id", "seq", "message_id", "kind", "role", "text").fillna("", ["role", "text"])
    # one shuffle: grouping by conversation and message is local once a conversation's rows are together
    e = e if together else e.repartition(F.col("conv_id"))
    messages = e.groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    # the text is what came from the last event that set it onwards
    sets = lambda x: x["kind"].isin("message", "edit", "regenerate")
    last = F.array_max(F.transform("log", lambda x, i: F.when(sets(x), i).otherwise(F.lit(-1))))
    parts = F.transform(F.slice("log", F.greatest(last, F.lit(0)) + 1, F.size("log")), lambda x: F.when(x["kind"].isin("regenerate", "delete"), F.lit("")).otherwise(x["text"]))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda x: x != "")
    messages = messages.select(
        "conv_id", F.col("log")[0]["seq"].alias("place"), "message_id", F.when(F.size(roles) > 0, F.element_at(roles, -1)).otherwise(F.lit("")).alias("role"), F.array_join(parts, "").alias("text"),
        F.exists("log", lambda x: x["kind"] == "delete").alias("gone"),
    ).filter("not gone")
    return messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "message_id"))).alias("messages"))


def rendered(conversations: DataFrame) -> DataFrame:
    """formatted and loss_spans added to folded()'s rows."""
    turn = lambda m: F.concat(F.lit(START), escaped(m["role"], True), F.lit("\n"), escaped(m["text"]), F.lit(END))
    span = lambda m, i: F.struct(i.cast("int").alias("turn"), (F.char_length(escaped(m["role"], True)) + len(START) + 1).alias("start"), F.char_length(escaped(m["text"])).alias("length"), (m["role"] == "assistant").alias("loss"))
    spans = F.filter(F.transform("messages", span), lambda s: s["loss"])
    return conversations.withColumns({"formatted": F.array_join(F.transform("messages", turn), ""), "loss_spans": F.transform(spans, lambda s: F.struct(s["turn"], s["start"], s["length"]))})


def read_back(formatted: DataFrame) -> DataFrame:
    """turns (role, text) and loss_text, from formatted and loss_spans alone."""
    chunks = F.split(F.col("formatted"), END, -1)
    chunks = F.slice(chunks, 1, F.size(chunks) - 1)
    head = lambda c: F.substring_index(c, "\n", 1)
    turn = lambda c: F.struct(unescaped(F.substring(head(c), len(START) + 1, 1 << 30), True).alias("role"), unescaped(c.substr(F.char_length(head(c)) + 2, F.lit(1 << 30))).alias("text"))
    out = formatted.withColumn("_chunks", chunks)
    loss = F.transform("loss_spans", lambda s: unescaped(F.col("_chunks")[s["turn"]].substr(s["start"] + 1, s["length"])))
    return out.withColumns({"turns": F.transform("_chunks", turn), "loss_text": F.array_join(loss, "")}).drop("_chunks")


def turn_events(conversations: DataFrame) -> DataFrame:
    """The log of a table of turns: each row is a message, numbered within its conversation by turn, role and text."""
    c = pick(conversations, "conv_id", "turn", "role", "text").fillna("", ["role", "text"])
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return c.select("conv_id", F.col("turn").alias("seq"), number.cast("long").alias("message_id"), F.lit("message").alias("kind"), "role", "text")


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = r"\### Assistant: </turn> ok"
    fixed = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    back = read_back(rendered(folded(turn_events(given.unionByName(fixed)), together=True)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), esc AS (
  SELECT *, replace(regexp_replace(replace(text, '\', '\b'), '###', '\hhh', 'g'), '</turn', '\l/turn') AS e FROM given
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + 13
    + length(text) - length(replace(text, '\', ''))
    + greatest(0, length(text) - length(replace(text, '###', '##')))
    + (length(text) - length(replace(text, '</turn', ''))) // 6) AS BIGINT) AS formatted_chars
FROM given GROUP BY conv_id
"""
