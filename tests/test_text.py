"""Text features on hand-made edge cases, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from veriscope.functions import text as T
from veriscope.operators.lexicon import join_lexicon, mean_word_score, text_profile
from veriscope.operators.terms import frequent_words, kept_terms, term_table, tfidf, vocabulary
from veriscope.shared import settle

TEXTS = [
    (1, None), (2, ""), (3, "   "), (4, "a"), (5, 'He said ""no"".\nThen left!  Why? 3.5 km'),
    (6, "ÄÖ Éa"), (7, "one two three\tfour\x0bfive\x1csix"), (8, "The best, the worst; bestest Best"),
    (9, "I bought an iPhone from Apple for $999 in New York."),
    (10, " ".join(f"w{i}" for i in range(25))), (11, " ".join(["ten"] * 10)),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text_ string")


def test_features_match_python(texts):
    found = {r.id: r for r in T.without_helpers(T.with_native_features(texts)).collect()}
    for key, text in TEXTS:
        content = text or ""
        tokens = content.split()
        row = found[key]
        assert row.char_len == len(content)
        assert row.word_len == len(tokens)
        assert row.avg_word_len == pytest.approx(sum(map(len, tokens)) / len(tokens) if tokens else 0.0)
        assert row.exclamation_count == content.count("!")
        assert row.question_count == content.count("?")
        assert row.uppercase_ratio == pytest.approx(sum(c.isupper() for c in content) / max(len(content), 1))
        superlatives = len(re.findall(r"\b(?:" + "|".join(T.SUPERLATIVES) + r")\b", content.lower()))
        assert row.superlative_count == superlatives
        assert (row.superlative_density is None) == (not tokens)


def test_single_feature_functions_agree(texts):
    c = F.col("text_")
    single = texts.select(
        "id", T.word_count(c).alias("word_len"), T.mean_word_length(c).alias("avg_word_len"),
        T.type_token_ratio(c).alias("ttr"), T.uppercase_ratio(c).alias("uppercase_ratio"),
    )
    together = T.with_native_features(texts).select(*single.columns)
    assert single.exceptAll(together).count() == 0


def test_sentences_and_entities(texts):
    found = {r.id: r for r in T.with_native_features(texts).collect()}
    assert [found[k].sentence_count for k in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 4]
    assert found[9].entity_count == 3  # Apple, $999, New York
    assert found[6].ttr == 1.0


def test_wrapping(texts):
    found = dict(texts.select("id", T.wrapped(F.col("text_"))).collect())
    assert found[10] == "<br>".join(" ".join(f"w{i}" for i in range(s, min(s + 10, 25))) for s in (0, 10, 20))
    assert found[11] == " ".join(["ten"] * 10)
    assert found[1] == ""


def _lexicon(spark):
    return settle(spark.createDataFrame(
        [("good", 2.0, 0.8, "ADJ"), ("dog", 5.0, 0.0, "NOUN"), ("bad.", 1.0, None, None)],
        "word string, concreteness double, polarity double, pos string",
    ))


def test_lexicon_scores(spark):
    texts = spark.createDataFrame(
        [(1, "Good dog"), (2, "not good"), (3, "bad."), (4, ""), (5, None), (6, "good good dogs x")],
        "id long, text_ string",
    )
    found = {r.id: r for r in text_profile(texts, _lexicon(spark)).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6}
    assert found[1].concreteness_score == 3.5 and found[1].polarity == pytest.approx(0.4)
    assert found[2].polarity == pytest.approx(-0.4)
    assert found[3].concreteness_score == 1.0  # punctuation is part of a raw word
    assert found[4].concreteness_score is None and found[4].polarity == 0.0 and found[5].word_len == 0
    assert found[6].adj_ratio == 0.5 and found[6].adj_noun_ratio == 2.0
    scored = dict(mean_word_score(texts, _lexicon(spark), "concreteness").collect())
    assert scored == {1: 3.5, 2: 2.0, 3: 1.0, 4: None, 5: None, 6: 2.0}


def test_large_lexicon_is_joined_by_salt(spark):
    texts = spark.createDataFrame([(i, "good dog not good cat") for i in range(200)], "id long, text_ string")
    small = text_profile(texts, _lexicon(spark))
    salted = text_profile(texts, _lexicon(spark), max_rows=1)
    assert small.exceptAll(salted).count() == 0 and salted.count() == 200
    narrow = mean_word_score(texts, _lexicon(spark), "concreteness", max_rows=1)
    assert {r.concreteness for r in narrow.collect()} == {3.0}
    tokens = spark.createDataFrame([(1, "good")], "id long, word string")
    plan = join_lexicon(tokens, _lexicon(spark), "id", max_rows=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_terms_by_brute_force(spark):
    docs = {1: "a bb cc bb cc", 2: "bb cc dd", 3: "", 4: "cc cc cc ee_1 bb"}
    texts = spark.createDataFrame(list(docs.items()), "id long, text_ string")
    tokens = texts.select("id", kept_terms(F.col("text_")).alias("tokens"))
    found = {(r.id, r.term): r.tf for r in term_table(tokens).collect()}
    expected = {}
    for key, text in docs.items():
        parts = re.findall(r"\w\w+", text)
        for term in parts + [f"{a} {b}" for a, b in zip(parts, parts[1:])]:
            expected[key, term] = expected.get((key, term), 0) + 1
    assert found == expected


def test_pruned_vocabulary_is_the_whole_vocabulary(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS id", "text AS text_")
    tokens = texts.select("id", kept_terms(F.col("text_")).alias("tokens"))
    for top in (5, 60, 400):
        words = frequent_words(tokens, top)
        assert words is not None and len(words) >= top
        pruned = vocabulary(term_table(tokens, True, words), top).collect()
        assert pruned == vocabulary(term_table(tokens), top).collect()


def test_tfidf_rows_have_unit_length(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS id", "text AS text_")
    norms = tfidf(texts, 50).groupBy("id").agg(F.sum(F.col("tfidf") * F.col("tfidf")).alias("n"))
    assert norms.where(F.abs(F.col("n") - 1) > 1e-9).count() == 0
