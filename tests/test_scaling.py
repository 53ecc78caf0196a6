"""What must not grow with the input: what is broadcast, written and read by one task."""

import pytest
from pyspark.sql import functions as F

from veriscope import shared
from veriscope.shared import fits_broadcast, settle


def test_arrays_and_binaries_count_as_what_they_hold(spark):
    one = spark.range(1)
    long_array = settle(one.select(F.array_repeat(F.lit(1.5), 200_000).alias("a")))
    nested = settle(one.select(F.array_repeat(F.struct(F.lit(1).alias("x"), F.array_repeat(F.lit(2), 100).alias("y")), 2000).alias("a")))
    blob = settle(one.select(F.repeat(F.lit("x"), 1_600_000).cast("binary").alias("b")))
    for table in (long_array, nested, blob):
        assert fits_broadcast(table) and not fits_broadcast(table, max_bytes=1_000_000)
    empty = settle(one.select(F.lit(None).cast("array<double>").alias("a"), F.lit(None).cast("map<string,binary>").alias("m")))
    assert fits_broadcast(empty, max_bytes=100)


def test_large_blocks_are_not_broadcast(spark, monkeypatch):
    table = settle(spark.range(4).select(F.array_repeat(F.col("id"), 100_000).alias("members")))
    assert fits_broadcast(table)
    monkeypatch.setattr(fits_broadcast, "__defaults__", (shared.MAX_BROADCAST_ROWS, 1_000_000))
    assert not fits_broadcast(table)
    assert "broadcast" not in shared.broadcast_if_small(table)._jdf.queryExecution().logical().toString().lower()


def test_what_is_too_large_to_broadcast_is_not_sent_where_its_file_looks_small(spark):
    """A file of equal values is far smaller than what the driver would hold of it."""
    table = settle(spark.range(200).select("id", F.array_repeat(F.lit(1.5), 1000).alias("cuts")))
    joined = spark.range(1000).join(shared.broadcast_if_small(table, max_bytes=1_000_000), "id")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 200
    small = spark.range(1000).join(shared.broadcast_if_small(table), "id")
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString() and small.count() == 200



def test_difficulty_importances_follow_the_rows_alone(spark):
    from veriscope.learning.evaluation import difficulty_importances

    def line(i):
        return i, float(i * 7 % 4), float(i * 7 % 4) + (i * 31 % 10) / 20, float(i * 17 % 23), None if i == 5 else float(i * 13 % 3)

    rows = spark.createDataFrame([line(i) for i in range(400)], "id long, difficulty double, a double, b double, c double")
    found = [difficulty_importances(df, ["a", "b", "c"], trees=12, depth=30, **how).collect() for df, how in (
        (rows, {}), (rows.repartition(3), {}), (rows, {"block_rows": 150}))]
    shares = {r.feature: r.importance_pct for r in found[0]}
    assert list(shares)[0] == "a" and shares["a"] > 60 and sum(shares.values()) == pytest.approx(100)
    for other in found[1:]:
        assert [r.feature for r in other] == list(shares)
        assert [r.importance_pct for r in other] == pytest.approx(list(shares.values()))
    constant = difficulty_importances(rows.withColumn("difficulty", F.lit(1.0)), ["a", "b"], trees=2).collect()
    assert [tuple(r) for r in constant] == [("a", 0.0), ("b", 0.0)]


def test_imported_files_grow_in_number_not_in_size(spark, sf_dir, monkeypatch):
    from veriscope.plans import selections

    written, write = [], selections.write_csv
    monkeypatch.setattr(selections, "write_csv", lambda df, path: (written.append(df.rdd.getNumPartitions()), write(df, path)))
    few = selections.imported_reviews(spark, sf_dir).orderBy("id").collect()
    monkeypatch.setattr(selections, "CSV_BYTES", 40_000, raising=False)
    many = selections.imported_reviews(spark, sf_dir).orderBy("id").collect()
    assert few == many and written[:2] == [3, 3]
    assert written[3] > written[2] and written[3] >= 8


def test_texts_of_one_row_group_are_dealt_out(spark, sf_dir, monkeypatch):
    from veriscope.plans import tables

    whole = tables.documents(spark, sf_dir)
    assert tables.dealt(spark, sf_dir).rdd.getNumPartitions() == whole.rdd.getNumPartitions()
    monkeypatch.setattr(tables, "TASK_BYTES", 60_000)
    spread = tables.dealt(spark, sf_dir)
    sizes = [r.n for r in spread.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text_")).alias("n")).collect()]
    assert len(sizes) >= 5 and max(sizes) < sum(sizes) / 2
    assert sorted(spread.collect()) == sorted(whole.collect())


def test_lexicon_of_whole_words(spark, tmp_path):
    from veriscope.plans import tables

    texts = ["Ab cd-ef ghijklm\tno pqrstu x, yz\n", "", None, "café AB a bb.", "  tv  "]
    spark.createDataFrame([(i, t, "s", 3, "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars int, lang string").write.parquet(
        f"{tmp_path}/documents.parquet")
    assert {r.word for r in tables.lexicon(spark, str(tmp_path)).collect()} == {"ab", "no", "pqrstu", "yz", "tv"}


def test_tokens_are_scored_without_interpreted_lambdas(spark):
    from veriscope.operators.lexicon import text_profile

    words = settle(spark.createDataFrame([("not", 1.0, 0.5, "OTHER"), ("good", 2.0, 0.8, "ADJ"), ("bag", 4.0, 0.0, "NOUN")],
                                         "word string, concreteness double, polarity double, pos string"))
    texts = spark.createDataFrame([(1, "Not good bag!"), (2, ""), (3, None), (4, "good not")], "id long, text_ string")
    found = text_profile(texts, words, negators=("not",))
    rows = {r.id: (r.concreteness_score, r.polarity, r.adj_ratio) for r in found.collect()}
    assert rows[1] == (1.5, pytest.approx((0.5 - 0.4 + 0.0) / 3), pytest.approx(1 / 3)) and rows[4] == (1.5, pytest.approx(0.65), 0.5)
    assert rows[2] == rows[3] == (None, 0.0, 0.0)
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_vector_is_not_sent_with_every_entry(spark):
    from veriscope.learning.word_vectors import multiplied

    entries = settle(spark.range(3000).select(
        F.concat(F.lit("w"), F.col("id") % 30).alias("word"), F.concat(F.lit("o"), F.floor(F.col("id") / 30)).alias("other"), (F.col("id") % 7).cast("double").alias("value")))
    vectors = settle(spark.range(99).select(F.concat(F.lit("o"), "id").alias("word"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector")))
    found = multiplied(entries, vectors)
    want = {}
    for i in range(99 * 30):  # no vector for the last word
        x = want.setdefault(f"w{i % 30}", [0.0, 0.0])
        x[0], x[1] = x[0] + (i % 7) * (i // 30), x[1] + i % 7
    assert {r.word: list(r.vector) for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert multiplied(entries.limit(0), vectors).count() == multiplied(entries, vectors.limit(0)).count() == 0
