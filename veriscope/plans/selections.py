"""Encodings, splits, samples and the prompts and answers of a remote scorer."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from veriscope.functions.answers import (
    answer_error, answer_field, cleaned_label, correctness, mistake_example, parsed_label,
    review_prompt, with_examples,
)
from veriscope.operators.consolidate import long_predictions
from veriscope.operators.selection import (
    first_rows, fold_no, holdout_split, number_rows, seeded_hash, seeded_sample, stratified_split,
)
from veriscope.plans.ctes import sql
from veriscope.plans.tables import documents, facts, labels, reviews, rounded, rules
from veriscope.shared import shared_folder
from veriscope.sources.predictions import write_csv
from veriscope.sources.reviews import category_columns, category_rows, encoded_label, import_reviews, one_hot_category, scaled_stars

TEMPLATE = "Decide whether a review is genuine.\nClassification rules:\n- Answer in JSON.\n"
# The answers given to texts by id modulo their number.
ANSWERS = ('{"label":"CG"}', '{"label":"OR"}', '{"label":"XX"}', "not json", '{"other":1}')

# An export's files at least, and the bytes of text that one of them holds: a quoted multi-line CSV is read by one task.
CSV_FILES, CSV_BYTES = 3, 32 * 1024 * 1024


def label_encoding(spark, sf_dir):
    return labels(spark, sf_dir).withColumn("label_encoded", encoded_label(F.col("label")))


def fitted_label_codes(spark, sf_dir):
    """Labels coded by a fitted encoder in alphabetical order, and decoded again."""
    keyed = labels(spark, sf_dir)
    encoder = StringIndexer(inputCol="label", outputCol="code", stringOrderType="alphabetAsc").fit(keyed)
    decoder = IndexToString(inputCol="code", outputCol="decoded", labels=encoder.labels)
    return decoder.transform(encoder.transform(keyed)).withColumn("code", F.col("code").cast("int"))


def category_vectors(spark, sf_dir):
    """One-hot category vectors: the position of the one, and the size."""
    dense = vector_to_array("category_onehot")
    coded = one_hot_category(documents(spark, sf_dir).select("id", "category"))
    return coded.select("id", "category", (F.array_position(dense, 1.0) - 1).cast("int").alias("place"),
                        F.size(dense).alias("size"))


def holdout_parts(spark, sf_dir):
    """Unstratified hold-out part and fold of every text, by hash."""
    keyed = documents(spark, sf_dir).select("id")
    return holdout_split(keyed).withColumn("fold", fold_no(3))


def one_hot_rating_norm(spark, sf_dir):
    """The ones of the category's coding as rows, with the scaled rating."""
    texts = documents(spark, sf_dir).drop("text_")
    scaled = texts.select("id", scaled_stars(F.col("rating")).alias("rating_norm"))
    return rounded(category_rows(texts).join(scaled, "id"))


def listed_categories(spark, sf_dir):
    """A 0/1 column for each category of a list."""
    return category_columns(documents(spark, sf_dir).select("id", "category"), ["src0", "src1", "none"])


def imported_reviews(spark, sf_dir):
    """All texts written as two CSV folders of different size and column order, imported by name."""
    folder = f"{shared_folder(spark)}/veriscope-csv-{uuid.uuid4().hex}"
    texts = documents(spark, sf_dir).withColumn("label", F.when(F.col("id") % 2 == 0, "OR").otherwise("CG"))
    small = F.col("id") % 5 == 0
    size = F.octet_length("text_").cast("long")
    sizes = texts.agg(F.sum(F.when(small, size)), F.sum(F.when(~small, size))).first()
    few, many = (max(CSV_FILES, -(-(n or 0) // CSV_BYTES)) for n in sizes)
    write_csv(texts.where(small).repartitionByRange(few, "id").sortWithinPartitions("id").select("label", "category", "text_", "rating"), f"{folder}/a")
    write_csv(texts.where(~small).repartitionByRange(many, "id").sortWithinPartitions("id").select("category", "rating", "label", "text_"), f"{folder}/b")
    numbered = import_reviews(spark, [f"{folder}/a", f"{folder}/b"])
    return numbered.select("id", "category", "rating", "label", F.md5("text_").alias("text_md5"))


def row_numbers(spark, sf_dir):
    stored = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return number_rows(stored).select("doc_id", "id")


def split(spark, sf_dir):
    keyed = labels(spark, sf_dir)
    return stratified_split(keyed).select("id", "label", "part")


def seeded_samples(spark, sf_dir):
    return seeded_sample(reviews(spark, sf_dir).select("id", "label"), 50)


def first_reviews(spark, sf_dir):
    return first_rows(reviews(spark, sf_dir).select("id", "category", "rating", "label"), 13)


def prompt_build(spark, sf_dir):
    return reviews(spark, sf_dir).select(
        "id", review_prompt(F.col("category"), F.col("rating"), F.col("text_")).alias("prompt")
    )


def canned_answer(key="id"):
    given = F.lit(None).cast("string")
    for number, answer in enumerate(ANSWERS):
        given = F.when(F.col(key) % len(ANSWERS) == number, F.lit(answer)).otherwise(given)
    return given


def answer_parse(spark, sf_dir):
    answered = labels(spark, sf_dir).withColumn("answer", canned_answer())
    return answered.select(
        "id", parsed_label(F.col("answer")).alias("predicted_label"),
        answer_field(F.col("answer"), "explanation").alias("explanation"),
        answer_error(F.col("answer")).alias("error"),
    )


def answer_correctness(spark, sf_dir):
    """Cleaned answers against labels; texts without a valid answer are dropped."""
    raw = labels(spark, sf_dir).withColumn(
        "predicted_label", cleaned_label(F.concat(F.lit(" "), F.get_json_object(canned_answer(), "$.label"), F.lit(" ")))
    )
    kept = raw.dropna(subset=["predicted_label"])
    return kept.withColumn("correct", correctness(F.col("label"), F.col("predicted_label")))


def few_shot_block(spark, sf_dir):
    """A prompt extended by ten numbered mistakes of one model."""
    narrow = long_predictions(facts(spark, sf_dir), {"rule_length": rules()["rule_length"]}, ["id", "label"])
    mistakes = seeded_sample(narrow.where("correct = 0").select("id", "label", "predicted_label"), 10, check=False)
    placed = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(seeded_hash(), "id"))
    numbered = mistakes.withColumn("number", placed + 12)  # ten rows
    shown = documents(spark, sf_dir).join(F.broadcast(numbered), "id").withColumn("example", mistake_example(
        F.col("number"), F.col("category"), F.col("rating"), F.col("text_"), F.col("label"), F.col("predicted_label")
    ))
    block = shown.agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("number", "example"))), lambda e: e["example"]), ""
    ).alias("examples"))
    return block.select(with_examples(F.lit(TEMPLATE), F.col("examples")).alias("prompt"))


QUERIES = {
    "label_encoding": label_encoding,
    "fitted_label_codes": fitted_label_codes,
    "one_hot_rating_norm": one_hot_rating_norm,
    "listed_categories": listed_categories,
    "category_vectors": category_vectors,
    "holdout_parts": holdout_parts,
    "imported_reviews": imported_reviews,
    "row_numbers": row_numbers,
    "stratified_split": split,
    "seeded_samples": seeded_samples,
    "first_reviews": first_reviews,
    "prompt_build": prompt_build,
    "llm_answer_parse": answer_parse,
    "answer_correctness": answer_correctness,
    "few_shot_block": few_shot_block,
}

HASH = "md5(concat('42:', CAST(id AS VARCHAR)))"
ORACLE = {
    "label_encoding": """
        SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'OR' ELSE 'CG' END AS label,
               CAST(quality = 1 AS INTEGER) AS label_encoded FROM labels""",
    "fitted_label_codes": """
        SELECT id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code, label AS decoded
        FROM (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'OR' ELSE 'CG' END AS label FROM labels)""",
    "category_vectors": """
        SELECT doc_id AS id, source AS category, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS place,
               CAST((SELECT count(DISTINCT source) FROM documents) AS INTEGER) AS size FROM documents""",
    "holdout_parts": f"""
        SELECT id, CASE WHEN x < 0.2 THEN 'test' ELSE 'train' END AS part, CAST(floor(x * 3) AS INTEGER) AS fold
        FROM (SELECT id, CAST(concat('0x', substr({HASH}, 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS x
              FROM (SELECT doc_id AS id FROM documents))""",
    "one_hot_rating_norm": sql("""
        SELECT id, category, CAST(1 AS DOUBLE) AS value, round((rating - 1) / 4, 6) AS rating_norm FROM docs
        WHERE category IS NOT NULL""", "docs"),
    "listed_categories": sql("""
        SELECT id, category, CAST(coalesce(category = 'src0', false) AS DOUBLE) AS category_src0,
               CAST(coalesce(category = 'src1', false) AS DOUBLE) AS category_src1, CAST(0 AS DOUBLE) AS category_none
        FROM docs""", "docs"),
    "imported_reviews": sql("""
        SELECT row_number() OVER (ORDER BY id % 5 <> 0, id) AS id, category, rating,
               CASE WHEN id % 2 = 0 THEN 'OR' ELSE 'CG' END AS label, md5(text_) AS text_md5 FROM docs""", "docs"),
    "row_numbers": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS id FROM documents",
    "stratified_split": f"""
        WITH keyed AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'OR' ELSE 'CG' END AS label FROM labels),
        counts AS (SELECT label, count(*) AS n FROM keyed GROUP BY label),
        parts AS (
          SELECT label, n, n // 5 AS base, n % 5 AS rest,
                 (SELECT (sum(n) + 4) // 5 FROM counts) - (SELECT sum(n // 5) FROM counts) AS missing FROM counts),
        quotas AS (
          SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= missing THEN 1 ELSE 0 END AS quota
          FROM parts)
        SELECT id, k.label,
               CASE WHEN row_number() OVER (PARTITION BY k.label ORDER BY {HASH}, id) <= quota THEN 'test' ELSE 'train' END AS part
        FROM keyed k JOIN quotas q ON k.label = q.label""",
    "seeded_samples": sql(f"SELECT id, label FROM reviews ORDER BY {HASH}, id LIMIT 50", "reviews"),
    "first_reviews": sql("SELECT id, category, rating, label FROM reviews ORDER BY id LIMIT 13", "reviews"),
    "prompt_build": sql("""
        SELECT id, chr(10) || 'Category: ' || category || chr(10) || 'Rating: ' || CAST(rating AS VARCHAR) || chr(10)
               || 'Review: ' || text_ || chr(10) AS prompt FROM reviews""", "reviews"),
    "llm_answer_parse": """
        SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'CG' WHEN 1 THEN 'OR' END AS predicted_label, '' AS explanation,
               CASE doc_id % 5 WHEN 2 THEN 'invalid label' WHEN 3 THEN 'not a JSON object' WHEN 4 THEN 'no label' END AS error
        FROM labels""",
    "answer_correctness": """
        SELECT id, label, predicted_label, CAST(label = predicted_label AS INTEGER) AS correct
        FROM (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'OR' ELSE 'CG' END AS label,
                     CASE doc_id % 5 WHEN 0 THEN 'CG' WHEN 1 THEN 'OR' END AS predicted_label FROM labels)
        WHERE predicted_label IS NOT NULL""",
    "few_shot_block": sql(f"""
        , wrong AS (
          SELECT p.*, r.text_, row_number() OVER (ORDER BY md5(concat('42:', CAST(p.id AS VARCHAR))), p.id) + 12 AS number
          FROM predictions p JOIN reviews r ON p.id = r.id WHERE model = 'rule_length' AND correct = 0),
        block AS (
          SELECT string_agg(
            concat(chr(10), CAST(number AS VARCHAR), '. Previous mistake: this review should be classified as ', label, '.',
                   chr(10), 'Example:', chr(10), 'Category: ', category, chr(10), 'Rating: ', CAST(rating AS VARCHAR),
                   chr(10), 'Review: ', text_, chr(10), 'Label: ', label, chr(10), 'Reason: The previous prediction was ',
                   predicted_label, ', but the correct label is ', label, '.', chr(10)), '' ORDER BY number) AS b
          FROM wrong WHERE number <= 22)
        SELECT concat('Decide whether a review is genuine.', chr(10), chr(10),
                      'Additional examples from previous model mistakes:', chr(10), b, chr(10), chr(10),
                      'Classification rules:', chr(10), chr(10), '- Answer in JSON.', chr(10)) AS prompt
        FROM block""", "predictions"),
}
