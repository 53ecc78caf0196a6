"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all earlier turns are its context and
only its reply is trained.  A turn is rendered as ``<s>role[INST]text[/INST]</s>``; control
strings inside a role or text are escaped by a backslash after their first character (and
backslashes doubled), so that the rendering can be read back.

Cases: a null text or role counts as empty; an empty text is a turn; turns with equal
numbers are ordered by role and text, null numbers come first; repeated rows are repeated
turns; rows with a null conversation form one conversation; turns after the last reply
form a closing example without target, so that no turn is lost; an empty table has no
conversations; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.llm.texts import has_columns, let

# The control strings of the template.
OPEN, MIDDLE, END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (OPEN, CLOSE, MIDDLE, END)
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    result = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        result = F.replace(result, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return result


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role), F.lit(MIDDLE), escaped(text), F.lit(END + CLOSE))


def role_of(segment: Column) -> Column:
    """The role of a rendered turn."""
    begin = len(OPEN) + 1
    return unescaped(F.substring(segment, F.lit(begin), F.instr(segment, MIDDLE) - begin))


def text_of(segment: Column) -> Column:
    """The text of a rendered turn."""
    begin = F.instr(segment, MIDDLE) + len(MIDDLE)
    return unescaped(F.substring(segment, begin, F.length(segment) - begin + 1 - len(END + CLOSE)))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``segments`` (its rendered turns in order) and
    ``targets`` (the places, from 1, of the turns to train on).

    The formatted text is the segments' concatenation.  Texts are rendered before the
    shuffle; a conversation is one row, as its last example holds all of it anyway.
    """
    has_columns(turns, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(turns[c], F.lit("")) for c in ("role", "text"))
    marked = turns.select(
        "conv_id",
        F.struct("turn", role.alias("role"), rendered(role, text).alias("segment")).alias("_turn"),
    )
    ordered = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    places = F.filter(F.sequence(F.lit(1), F.size("_turns")),
                      lambda i: F.get(F.col("_turns.role"), i - 1) == TRAINED_ROLE)
    return ordered.select("conv_id", F.col("_turns.segment").alias("segments"), places.alias("targets"))


def example_ends() -> Column:
    """Places of the last turn of each example; one past the end for a closing example."""
    closing = F.size("segments") + 1
    ends_trained = F.coalesce(F.array_max("targets"), F.lit(0)) == F.size("segments")
    return F.when(ends_trained, F.col("targets")).otherwise(F.concat("targets", F.array(closing)))


def segments_of(formatted: Column) -> Column:
    """The rendered turns of a formatted text: a closing string inside a text is escaped."""
    return let(F.split(formatted, CLOSE), lambda parts: F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: F.concat(s, F.lit(CLOSE))))


def prefix_examples(conversations: DataFrame) -> DataFrame:
    """The training examples: ``conv_id``, ``example`` (from 0), ``context``, ``target``, ``last``.

    ``target`` is the rendered reply, empty in a closing example; the ``last`` one holds all turns.  Writing out every prefix
    takes, for a conversation, the square of its turns; ``format_conversations`` holds the
    same examples by reference.
    """
    placed = conversations.select("conv_id", "segments", F.size(example_ends()).alias("_n"),
                                  F.posexplode(example_ends()).alias("example", "_end"))
    return placed.select(
        "conv_id", "example",
        F.array_join(F.slice("segments", F.lit(1), F.col("_end") - 1), "").alias("context"),
        F.coalesce(F.get("segments", F.col("_end") - 1), F.lit("")).alias("target"),
        (F.col("example") == F.col("_n") - 1).alias("last"),
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """What the examples of each conversation say, parsed from their rendering.

    Every example is a row of its own; it hands on its target's text and its length, and the
    last one, which holds all turns, their texts.  ``formatted_chars`` counts the code points
    of all examples, contexts included.
    """
    examples = prefix_examples(conversations)
    turns = F.transform(segments_of(F.concat("context", "target")),
                        lambda s: F.concat(role_of(s), F.lit("\n"), text_of(s), F.lit("\n")))
    read = examples.select(
        "conv_id", (F.length("context") + F.length("target")).cast("long").alias("_chars"),
        F.struct("example", F.when(F.col("target") != "", text_of(F.col("target"))).otherwise("").alias("reply")).alias("_reply"),
        F.when(F.col("last"), turns).alias("_turns"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("_chars").alias("formatted_chars"), F.sort_array(F.collect_list("_reply")).alias("_replies"),
        F.first("_turns", ignorenulls=True).alias("_turns"))
    loss = F.array_join(F.col("_replies.reply"), "")
    return whole.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(F.array_join("_turns", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *,
    20 + length(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'),
                        '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
       + length(replace(replace(replace(replace(replace(txt, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'),
                        '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS chars
  FROM turns
), placed AS (
  SELECT *, sum(chars) OVER w AS upto, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(txt)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(txt, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR place = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""


def op8_chat_formatting(spark, sf_dir):
    """All conversations and one made of control strings, formatted and read back."""
    spoken = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    awkward = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return read_back(format_conversations(spoken.unionByName(awkward)))
