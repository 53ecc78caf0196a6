import hashlib

from tools.check_queries import compare, connect
from veriscope.llm import chat

AWKWARD = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<", "[", "</s", "a\nb", "", None, "[/INST]</s>", "[INST", "é😀", "user[INST]"]


def plain(turns):
    """Digests of (turn, role, text) in order."""
    said = [(role or "", text or "") for _, role, text in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0))]
    replies = "".join(text for role, text in said if role == "assistant")
    whole = "".join(f"{role}\n{text}\n" for role, text in said)
    return len(said), hashlib.sha256(whole.encode()).hexdigest(), len(replies), hashlib.sha256(replies.encode()).hexdigest()


def conversations(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", text) for i, text in enumerate(AWKWARD)]
    rows += [(2, 0, text, "x") for text in AWKWARD[:1]] + [(3, 0, None, None), (None, 1, "assistant", "lost"), (4, 5, "assistant", "only"),
             (5, 0, "user", "no reply"), (6, None, "user", "first"), (6, 0, "assistant", "second"), (7, 0, "user", "same"),
             (7, 0, "user", "same"), (7, 1, "assistant", "reply"), (7, 2, "user", "tail")]
    rows += [(8, i, "assistant" if i % 2 else "user", "word " * 20 + str(i)) for i in range(300)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segments")


def test_read_back(spark):
    rows, df = conversations(spark)
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert set(got) == {c for c, *_ in rows}
    for conv_id, r in got.items():
        want = plain([t[1:] for t in rows if t[0] == conv_id])
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want
    sizes = {}
    for r in chat.prefix_examples(formatted).collect():
        sizes[r.conv_id] = sizes.get(r.conv_id, 0) + len(r.context) + len(r.target)
    assert sizes == {c: r.formatted_chars for c, r in got.items()}
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a </s>"), (1, 3, "assistant", "b"), (1, 4, "user", "tail")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [(r.example, r.context, r.target) for r in chat.prefix_examples(chat.format_conversations(df)).orderBy("example").collect()]
    opening, first = "<s>system[INST]s[/INST]</s><s>user[INST]q[/INST]</s>", "<s>assistant[INST]a <\\/s>[/INST]</s>"
    second, tail = "<s>assistant[INST]b[/INST]</s>", "<s>user[INST]tail[/INST]</s>"
    assert got == [(0, opening, first), (1, opening + first, second), (2, opening + first + second + tail, "")]


def test_the_query_reads_every_example(spark, monkeypatch):
    """What is read back comes from the examples: without one, its context, reply and length are missing."""
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "one"), (1, 2, "assistant", "two"), (1, 3, "user", "tail")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole, = chat.read_back(formatted).collect()
    examples = chat.prefix_examples
    gone = examples(formatted).where("example = 1").first()
    monkeypatch.setattr(chat, "prefix_examples", lambda conversations: examples(conversations).where("example <> 1"))
    less, = chat.read_back(formatted).collect()
    assert whole.formatted_chars - less.formatted_chars == len(gone.context) + len(gone.target)
    assert (whole.loss_chars, less.loss_chars) == (6, 3) and less.n_turns == whole.n_turns == 4


def test_escapes_are_reversible(spark):
    df = spark.createDataFrame([(t or "",) for t in AWKWARD], "text string")
    got = df.select("text", chat.escaped(df.text).alias("e"), chat.unescaped(chat.escaped(df.text)).alias("back")).collect()
    for r in got:
        assert r.back == r.text and not any(mark in r.e for mark in chat.CONTROL)


def test_native_plan(spark, sf_dir):
    shown = chat.op8_chat_formatting(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in shown and "Arrow" not in shown


def test_query_equals_sql(spark, sf_dir):
    assert compare("op8", chat.op8_chat_formatting(spark, sf_dir), connect(sf_dir), chat.ORACLE).startswith("ok (")
