import re

from pyspark.sql import functions as F

from tools.check_queries import compare, connect
from veriscope.llm import quality

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [s for s in text.split("\n") if WORD.search(s)]
    windows, covered = {}, set()
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            covered.update(p + k for p in places for k in range(8))
    stop = {*quality.STOP_WORDS, *(w.capitalize() for w in quality.STOP_WORDS)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_stop_words": sum(w in stop for w in words),
    }


def plain_base_failed(c):
    return c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]


def plain_kept(c):
    return (not plain_base_failed(c) and 200 * c["n_words"] <= 100 * c["word_chars"] <= 1200 * c["n_words"]
            and 100 * c["n_symbols"] <= 20 * c["n_words"] and 100 * c["n_stop_words"] >= 2 * c["n_words"]
            and 100 * c["n_dup_lines"] <= 50 * c["n_lines"])


TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "x y " * 30,
    "a\na\n\n \n \na", "é ü z the", "#$%&*|<> ##", "The the THE und de\x1cla", "a b c d e f g h i " * 3 + "tail",
    " ".join(f"w{i % 17}" for i in range(200)), "w " * 3_000, "\n".join(["same line of the text and of it"] * 3 + ["other"]),
    "😀 😀😀 the 😀", " ".join(f"word{i}" for i in range(3_000)) + " the of",
]


def test_counts_against_a_plain_version(spark):
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate([*TEXTS, TEXTS[4]])], "doc_id long, text string, n_words string")
    got = quality.judged(df).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = plain_counts(r.text)
        assert {k: r[k] for k in want} == want, (r.text or "")[:60]
        assert r.base_failed == plain_base_failed(want) and r.kept == plain_kept(want)
        assert r.kept == (not r.failed_rules)
    assert quality.judged(df.limit(0)).count() == 0
    kept = quality.passed(df)
    assert kept.columns == df.columns and kept.where("n_words = 'mine'").count() == sum(r.kept for r in got)


def test_own_rules(spark):
    df = spark.createDataFrame([("a b c",), ("a b",)], "text string")
    rules = (quality.Rule("three", "n_words", "one", low=300),)
    assert [r.text for r in quality.passed(df, rules=rules, base_rules=()).collect()] == ["a b c"]


def test_native_plan(spark, sf_dir):
    shown = quality.op2_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in shown and "Arrow" not in shown and "Exchange" not in shown


def test_query_equals_sql(spark, sf_dir):
    assert compare("op2", quality.op2_quality_rules(spark, sf_dir), connect(sf_dir), quality.ORACLE).startswith("ok (")


def test_clean_documents_pass(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.op2_quality_rules(spark, sf_dir).join(labels, "doc_id").where((F.col("n_words") >= 20) & (F.col("quality") == 1))
    assert judged.where("NOT kept AND NOT base_failed").count() == 0
