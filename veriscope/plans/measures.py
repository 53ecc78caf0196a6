"""Text features, and how they relate to difficulty and to cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriscope.functions.bins import LENGTH_LABELS, bin_label, fixed_bin_no, with_quantile_bins
from veriscope.functions.stats import star_rating
from veriscope.functions.text import NATIVE_FEATURES, hover, with_native_features, without_helpers
from veriscope.operators.consolidate import CAUGHT, ESCAPED, GENUINE, cohort, difficulty
from veriscope.operators.lexicon import mean_word_score, text_profile
from veriscope.operators.metrics import rate_by, shares
from veriscope.operators.profiles import (
    cohort_summary, correlations, describe_by, mean_by_cohort, profile, profile_z,
)
from veriscope.operators.terms import cohort_term_difference, tfidf
from veriscope.plans.ctes import STOP_WORDS as STOP_SQL
from veriscope.plans.ctes import sql
from veriscope.plans.tables import (
    MODELS, NEGATORS, STOP_WORDS, SUPERLATIVES, dealt, documents, lexicon, rounded, stored, wide,
)
from veriscope.shared import broadcast_if_small, settle

LEXICON_FEATURES = ("concreteness_score", "polarity", "adj_ratio", "noun_ratio", "adj_noun_ratio")
PROFILE_FEATURES = (
    "word_len", "sentence_count", "avg_word_len", "entity_count", "entity_density", "adj_ratio",
    "adj_noun_ratio", "ttr", "superlative_density", "exclamation_count", "uppercase_ratio", "polarity",
)
CORRELATED = (
    "char_len", "word_len", "sentence_count", "avg_word_len", "uppercase_ratio", "exclamation_count", "question_count",
)
VOCABULARY = 500


def native_features(spark, sf_dir):
    """The features that need no lexicon, stored."""
    return stored(spark, sf_dir, "features", lambda: without_helpers(
        with_native_features(dealt(spark, sf_dir), superlatives=SUPERLATIVES)).drop("text_"), "documents")


def text_features(spark, sf_dir):
    return rounded(native_features(spark, sf_dir))


def _profiled(spark, sf_dir):
    return stored(spark, sf_dir, "profile", lambda: text_profile(
        dealt(spark, sf_dir), lexicon(spark, sf_dir), ["category", "rating"], superlatives=SUPERLATIVES, negators=NEGATORS), "documents")


def _scored(spark, sf_dir):
    """The lexicon scores alone, stored: no other feature is worked out or carried along with the tokens."""
    return stored(spark, sf_dir, "scores", lambda: text_profile(
        dealt(spark, sf_dir), lexicon(spark, sf_dir), ["category", "rating"], superlatives=SUPERLATIVES,
        negators=NEGATORS).select("id", *LEXICON_FEATURES), "documents")


def text_features_full(spark, sf_dir):
    return rounded(_profiled(spark, sf_dir))


def concreteness_scores(spark, sf_dir):
    return rounded(mean_word_score(documents(spark, sf_dir), lexicon(spark, sf_dir), "concreteness"))


def _judged(spark, sf_dir):
    return wide(spark, sf_dir).withColumns({"difficulty": difficulty(MODELS), "cohort": cohort(MODELS)})


def _judged_native(spark, sf_dir):
    """Labelled texts with native features: features first, so that no text is shuffled."""
    measured = native_features(spark, sf_dir).select("id", *NATIVE_FEATURES)
    return _judged(spark, sf_dir).join(measured, "id")


def _judged_full(spark, sf_dir):
    return _judged(spark, sf_dir).join(_profiled(spark, sf_dir).drop("category", "rating"), "id")


def _judged_scores(spark, sf_dir):
    return _judged(spark, sf_dir).join(_scored(spark, sf_dir), "id")


def feature_difficulty_corr(spark, sf_dir):
    return rounded(correlations(_judged_native(spark, sf_dir), CORRELATED))


def _described(spark, sf_dir, measure, source):
    return rounded(describe_by(settle(source(spark, sf_dir).select("difficulty", measure)), measure))


def entity_by_difficulty(spark, sf_dir):
    return _described(spark, sf_dir, "entity_count", _judged_native)


def concreteness_by_difficulty(spark, sf_dir):
    return _described(spark, sf_dir, "concreteness_score", _judged_scores)


def polarity_by_difficulty(spark, sf_dir):
    return _described(spark, sf_dir, "polarity", _judged_scores)


def cohorts(spark, sf_dir):
    return rounded(cohort_summary(_judged(spark, sf_dir)))


def cohort_profile(spark, sf_dir):
    return profile(_judged_full(spark, sf_dir), PROFILE_FEATURES, (GENUINE, CAUGHT, ESCAPED))


def cohort_profile_z(spark, sf_dir):
    return rounded(profile_z(_judged_full(spark, sf_dir), PROFILE_FEATURES), digits=4)


def cohort_rating_dist(spark, sf_dir):
    return rounded(shares(_judged(spark, sf_dir), "rating", ["cohort"]))


def cohort_sentiment_by_rating(spark, sf_dir):
    return rounded(mean_by_cohort(_judged_scores(spark, sf_dir), "polarity"))


def _fakes(spark, sf_dir):
    flagged = wide(spark, sf_dir, "wl").where("label = 'CG'")
    return flagged.withColumn("escaped", (difficulty(MODELS) >= 2).cast("int"))


def escape_rate_by_length(spark, sf_dir):
    binned = _fakes(spark, sf_dir).withColumn("bin_no", fixed_bin_no(F.col("wl")))
    named = binned.withColumn("length", bin_label(F.col("bin_no")))
    return rounded(rate_by(named, "escaped", "bin_no", "length"))


def escape_rate_by_category(spark, sf_dir):
    return rounded(rate_by(_fakes(spark, sf_dir), "escaped", "category"))


def length_bins(spark, sf_dir):
    """Every text in one of five equally filled length bins."""
    lengths = settle(with_native_features(documents(spark, sf_dir)).select("id", "word_len"))
    return with_quantile_bins(lengths, "word_len")


def tfidf_vectors(spark, sf_dir):
    return rounded(tfidf(documents(spark, sf_dir), VOCABULARY, STOP_WORDS))


def tfidf_cohort_diff(spark, sf_dir):
    chosen = settle(_judged(spark, sf_dir).where(F.col("cohort").isin(CAUGHT, ESCAPED)).select("id", "cohort"))
    texts = documents(spark, sf_dir).join(broadcast_if_small(chosen), "id")
    return rounded(cohort_term_difference(texts, ESCAPED, CAUGHT, VOCABULARY, STOP_WORDS))


def hover_text(spark, sf_dir):
    return documents(spark, sf_dir).select("id", hover(F.col("category"), F.col("text_")).alias("hover"))


def star_sentiment_from_logits(spark, sf_dir):
    """Star class and confidence from five class scores per vector."""
    scored = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.slice("embedding", 1, 5).cast("array<double>").alias("logits")
    )
    stars, confidence = star_rating(F.col("logits"))
    return rounded(scored.select("id", stars.alias("stars"), confidence.alias("confidence")))


QUERIES = {
    "text_features": text_features,
    "text_features_full": text_features_full,
    "concreteness_scores": concreteness_scores,
    "feature_difficulty_corr": feature_difficulty_corr,
    "entity_by_difficulty": entity_by_difficulty,
    "concreteness_by_difficulty": concreteness_by_difficulty,
    "polarity_by_difficulty": polarity_by_difficulty,
    "cohort_summary": cohorts,
    "cohort_profile": cohort_profile,
    "cohort_profile_z": cohort_profile_z,
    "cohort_rating_dist": cohort_rating_dist,
    "cohort_sentiment_by_rating": cohort_sentiment_by_rating,
    "escape_rate_by_length": escape_rate_by_length,
    "escape_rate_by_category": escape_rate_by_category,
    "length_bins": length_bins,
    "tfidf_vectors": tfidf_vectors,
    "tfidf_cohort_diff": tfidf_cohort_diff,
    "hover_text": hover_text,
    "star_sentiment_from_logits": star_sentiment_from_logits,
}

NATIVE_SQL = "id, category, rating, " + ", ".join(
    f"CAST({f} AS INTEGER) AS {f}" if f.endswith(("_count", "char_len", "word_len")) and f != "avg_word_len"
    else f"round({f}, 6) AS {f}" for f in NATIVE_FEATURES
)


def _described_sql(measure: str) -> str:
    return sql(f"""
        SELECT difficulty, count({measure}) AS count, round(avg({measure}), 6) AS mean,
               round(CAST(median({measure}) AS DOUBLE), 6) AS median FROM features GROUP BY difficulty""", "features")


LONG_MEANS = ",\n means AS (\n" + "\n UNION ALL ".join(
    f"SELECT cohort, '{f}' AS feature, CAST(avg({f}) AS DOUBLE) AS mean FROM features GROUP BY cohort"
    for f in PROFILE_FEATURES
) + ")\n"


def _tfidf_sql(source: str) -> str:
    return rf"""
    , tokens AS (
      SELECT id, list_filter(regexp_extract_all(lower(text_), '[\p{{L}}\p{{N}}_]{{2,}}'),
                             lambda t: t NOT IN ({STOP_SQL})) AS a FROM {source}),
    occurrences AS (
      SELECT id, unnest(a) AS term FROM tokens
      UNION ALL
      SELECT id, unnest(list_transform(list_zip(a[1:len(a) - 1], a[2:]), lambda p: p[1] || ' ' || p[2])) FROM tokens),
    counted AS (SELECT id, term, count(*) AS tf FROM occurrences GROUP BY id, term),
    vocabulary AS (
      SELECT term, sum(tf) AS cf, count(*) AS df FROM counted GROUP BY term ORDER BY cf DESC, term LIMIT {VOCABULARY}),
    raw AS (
      SELECT c.id, c.term, c.tf * (ln((1 + (SELECT count(*) FROM {source})) / CAST(1 + v.df AS DOUBLE)) + 1) AS w
      FROM counted c JOIN vocabulary v ON c.term = v.term),
    weighted AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS tfidf FROM raw)"""


FIXED_BIN = """CASE WHEN wl > 0 AND wl <= 20 THEN 1 WHEN wl > 20 AND wl <= 50 THEN 2 WHEN wl > 50 AND wl <= 100 THEN 3
    WHEN wl > 100 AND wl <= 200 THEN 4 WHEN wl > 200 AND wl <= 500 THEN 5 WHEN wl > 500 THEN 6 END"""

ORACLE = {
    "text_features": sql(f"SELECT {NATIVE_SQL} FROM native", "native"),
    "text_features_full": sql(f"""
        SELECT {NATIVE_SQL}, round(concreteness_score, 6) AS concreteness_score, round(polarity, 6) AS polarity,
               round(adj_ratio, 6) AS adj_ratio, round(noun_ratio, 6) AS noun_ratio,
               round(adj_noun_ratio, 6) AS adj_noun_ratio
        FROM native JOIN scores USING (id)""", "native", "scores"),
    "concreteness_scores": sql("SELECT id, round(concreteness_score, 6) AS concreteness FROM scores", "scores"),
    "feature_difficulty_corr": sql("\n UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(CAST(avg({f}) AS DOUBLE), 6) AS mean, "
        f"CASE WHEN min({f}) < max({f}) THEN round(corr({f}, difficulty), 6) END AS corr_with_difficulty FROM features" for f in CORRELATED), "features"),
    "entity_by_difficulty": _described_sql("entity_count"),
    "concreteness_by_difficulty": _described_sql("concreteness_score"),
    "polarity_by_difficulty": _described_sql("polarity"),
    "cohort_summary": sql("""
        SELECT label, cohort, count(*) AS count,
               round(count(*) * 100 / CAST((SELECT count(*) FROM wide) AS DOUBLE), 6) AS pct_of_all,
               round(count(*) * 100 / CAST((SELECT count(*) FROM wide x WHERE x.label = w.label) AS DOUBLE), 6) AS pct_of_label
        FROM wide w GROUP BY label, cohort""", "wide"),
    "cohort_profile": sql(LONG_MEANS + """
        SELECT feature, round(max(mean) FILTER (WHERE cohort = 'genuine'), 2) AS genuine,
               round(max(mean) FILTER (WHERE cohort = 'fake_caught'), 2) AS fake_caught,
               round(max(mean) FILTER (WHERE cohort = 'fake_escaped'), 2) AS fake_escaped
        FROM means GROUP BY feature""", "features"),
    "cohort_profile_z": sql(LONG_MEANS + """
        SELECT cohort, feature, round(mean, 4) AS mean,
               round((mean - avg(mean) OVER (PARTITION BY feature))
                     / (stddev_samp(mean) OVER (PARTITION BY feature) + 1e-9), 4) AS z FROM means""", "features"),
    "cohort_rating_dist": sql("""
        SELECT cohort, rating, count(*) AS count,
               round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY cohort) AS DOUBLE), 6) AS share
        FROM wide GROUP BY cohort, rating""", "wide"),
    "cohort_sentiment_by_rating": sql("""
        SELECT cohort, rating, round(avg(polarity), 6) AS mean_polarity, count(polarity) AS n
        FROM features GROUP BY cohort, rating""", "features"),
    "escape_rate_by_length": sql(f"""
        SELECT bin_no, ['{"', '".join(LENGTH_LABELS)}'][bin_no] AS length,
               round(avg(CASE WHEN difficulty >= 2 THEN 1 ELSE 0 END), 6) AS rate, count(*) AS n
        FROM (SELECT *, {FIXED_BIN} AS bin_no FROM wide WHERE label = 'CG') GROUP BY bin_no""", "wide"),
    "escape_rate_by_category": sql("""
        SELECT category, round(avg(CASE WHEN difficulty >= 2 THEN 1 ELSE 0 END), 6) AS rate, count(*) AS n
        FROM wide WHERE label = 'CG' GROUP BY category""", "wide"),
    "length_bins": sql("""
        , cuts AS (
          SELECT list_sort(list_distinct(list_transform(
                   quantile_cont(word_len, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), lambda q: round(CAST(q AS DOUBLE), 9)))) AS e
          FROM native),
        binned AS (
          SELECT id, word_len, e,
                 greatest(1, least(greatest(len(e) - 1, 1), len(list_filter(e, lambda q: q < word_len)))) AS b
          FROM native, cuts)
        SELECT id, CAST(word_len AS INTEGER) AS word_len, CAST(b AS INTEGER) AS bin_no,
               CAST(CASE WHEN b = 1 THEN floor(e[1] - 0.001) ELSE floor(e[b]) END + 1 AS BIGINT) || '–'
                 || CAST(floor(e[least(b + 1, len(e))]) AS BIGINT) || ' Wörter' AS bin_label
        FROM binned""", "native"),
    "tfidf_vectors": sql(_tfidf_sql("docs") + "SELECT id, term, round(tfidf, 6) AS tfidf FROM weighted", "docs"),
    "tfidf_cohort_diff": sql("""
        , fakes AS (SELECT r.id, r.text_, w.cohort FROM reviews r JOIN wide w ON r.id = w.id WHERE w.label = 'CG')"""
        + _tfidf_sql("fakes") + """,
        means AS (
          SELECT term,
                 coalesce(sum(tfidf) FILTER (WHERE cohort = 'fake_escaped'), 0)
                   / (SELECT count(*) FROM fakes WHERE cohort = 'fake_escaped') AS e,
                 coalesce(sum(tfidf) FILTER (WHERE cohort = 'fake_caught'), 0)
                   / (SELECT count(*) FROM fakes WHERE cohort = 'fake_caught') AS c
          FROM weighted JOIN fakes USING (id) GROUP BY term)
        SELECT term, round(e, 6) AS mean_fake_escaped, round(c, 6) AS mean_fake_caught, round(e - c, 6) AS diff
        FROM means""", "wide"),
    "hover_text": sql("""
        SELECT id, '<b>Label: ' || category || '</b><br><br>' || coalesce(array_to_string(list_transform(
                 range(0, len(w), 10), lambda i: array_to_string(w[i + 1:i + 10], ' ')), '<br>'), '') AS hover
        FROM (SELECT *, list_filter(regexp_split_to_array(text_, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+'), lambda x: x <> '') AS w
              FROM docs)""", "docs"),
    "star_sentiment_from_logits": """
        SELECT id, CAST(list_position(x, list_max(x)) AS INTEGER) AS stars,
               round(1.0 / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))), 6) AS confidence
        FROM (SELECT vec_id AS id, list_transform(embedding[1:5], lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)""",
}
