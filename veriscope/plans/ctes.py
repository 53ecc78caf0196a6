"""The given tables in the shape of the audited corpus, for the checking engine."""

from __future__ import annotations

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
STOP_WORDS = "'the','of','de','and','to','in','la','der','is','that','en','for','it','on'"

PARTS = {
    "docs": """docs AS (
        SELECT doc_id AS id, source AS category, CAST(1 + n_chars % 5 AS DOUBLE) AS rating, text AS text_
        FROM documents)""",
    "reviews": """reviews AS (
        SELECT d.*, CASE WHEN l.quality = 1 THEN 'OR' ELSE 'CG' END AS label
        FROM docs d JOIN labels l ON d.id = l.doc_id)""",
    "facts": rf"""facts AS (
        SELECT id, category, rating, label, len(w) AS wl, len(list_distinct(lw)) AS uq,
               length(text_) AS cl, len(regexp_extract_all(text_, '[^\p{{L}}\p{{N}}\s]')) AS pu
        FROM (SELECT *, list_filter(regexp_split_to_array(text_, '{SPACE}'), lambda x: x <> '') AS w,
                     list_filter(regexp_split_to_array(lower(text_), '{SPACE}'), lambda x: x <> '') AS lw
              FROM reviews))""",
    "predictions": """predictions AS (
        SELECT *, CAST(label = predicted_label AS INTEGER) AS correct FROM (
            SELECT id, category, rating, label, wl, 'rule_length' AS model,
                   CASE WHEN wl >= 250 THEN 'OR' ELSE 'CG' END AS predicted_label FROM facts
            UNION ALL
            SELECT id, category, rating, label, wl, 'rule_variety',
                   CASE WHEN uq * 100 >= 78 * wl THEN 'OR' ELSE 'CG' END FROM facts
            UNION ALL
            SELECT id, category, rating, label, wl, 'rule_punct',
                   CASE WHEN pu * 1000 < 24 * cl THEN 'OR' ELSE 'CG' END FROM facts))""",
    "wide": """wide AS (
        SELECT id, category, rating, label, wl,
               max(CASE WHEN model = 'rule_length' THEN correct END) AS rule_length,
               max(CASE WHEN model = 'rule_variety' THEN correct END) AS rule_variety,
               max(CASE WHEN model = 'rule_punct' THEN correct END) AS rule_punct,
               CAST(sum(correct) AS INTEGER) AS correct_count,
               CAST(3 - sum(correct) AS INTEGER) AS difficulty,
               CASE WHEN label = 'OR' THEN 'genuine' WHEN 3 - sum(correct) <= 1 THEN 'fake_caught'
                    ELSE 'fake_escaped' END AS cohort
        FROM predictions GROUP BY id, category, rating, label, wl)""",
    "lexicon": rf"""lexicon AS (
        SELECT word,
               CAST(1 + ((ascii(word) * 31 + length(word) * 7) % 401) / 100.0 AS DOUBLE) AS concreteness,
               CAST(((ascii(word) * 17 + length(word) * 5) % 201 - 100) / 100.0 AS DOUBLE) AS polarity,
               CASE (ascii(word) + length(word)) % 3 WHEN 0 THEN 'ADJ' WHEN 1 THEN 'NOUN' ELSE 'OTHER' END AS pos
        FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text_), '{SPACE}')) AS word FROM docs)
        WHERE regexp_full_match(word, '[a-z]{{2,6}}'))""",
    "native": rf"""native AS (
        SELECT *, CASE WHEN word_len > 0 THEN superlative_count / CAST(word_len AS DOUBLE) END AS superlative_density,
               CASE WHEN word_len > 0 THEN entity_count / CAST(word_len AS DOUBLE) END AS entity_density
        FROM (
            SELECT id, category, rating, length(text_) AS char_len, len(w) AS word_len,
                   len(regexp_extract_all(text_, '[.!?]+(?:\s|\z)'))
                     + CAST(regexp_matches(text_, '[^\s.!?]\s*\z') AS INTEGER) AS sentence_count,
                   CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / CAST(len(w) AS DOUBLE)
                        ELSE 0.0 END AS avg_word_len,
                   len(regexp_extract_all(text_, '!')) AS exclamation_count,
                   len(regexp_extract_all(text_, '\?')) AS question_count,
                   len(regexp_extract_all(text_, '\p{{Lu}}')) / CAST(greatest(length(text_), 1) AS DOUBLE) AS uppercase_ratio,
                   len(regexp_extract_all(lower(text_), '\b(?:the|that|and|there)\b')) AS superlative_count,
                   len(list_distinct(a)) / CAST(greatest(len(a), 1) AS DOUBLE) AS ttr,
                   len(regexp_extract_all(text_, '[\p{{Ll}}\p{{N}},;:)]\s+\p{{Lu}}[\p{{L}}''’-]*(?:\s+\p{{Lu}}[\p{{L}}''’-]*)*'))
                     + len(regexp_extract_all(text_, '(?:[$€£]\s?)?\d+(?:[.,]\d+)*')) AS entity_count
            FROM (SELECT *, list_filter(regexp_split_to_array(text_, '{SPACE}'), lambda x: x <> '') AS w,
                         regexp_extract_all(lower(text_), '\p{{L}}+') AS a FROM docs)))""",
    "scores": rf"""raw_tokens AS (
        SELECT id, unnest(regexp_split_to_array(lower(text_), '{SPACE}')) AS word FROM docs),
      concrete AS (
        SELECT id, avg(concreteness) AS concreteness_score FROM raw_tokens JOIN lexicon USING (word) GROUP BY id),
      spoken AS (
        SELECT id, unnest(a) AS word, unnest(list_prepend('', a[1:len(a) - 1])) AS prev
        FROM (SELECT id, regexp_extract_all(lower(text_), '\p{{L}}+') AS a FROM docs)),
      tones AS (
        SELECT s.id, avg(l.polarity * CASE WHEN s.prev IN ('not', 'no', 'la', 'in') THEN -0.5 ELSE 1 END) AS polarity,
               count(*) AS n, count(*) FILTER (WHERE l.pos = 'ADJ') AS n_adj, count(*) FILTER (WHERE l.pos = 'NOUN') AS n_noun
        FROM spoken s LEFT JOIN lexicon l ON s.word = l.word GROUP BY s.id),
      scores AS (
        SELECT d.id, c.concreteness_score, coalesce(t.polarity, 0.0) AS polarity,
               coalesce(t.n_adj / CAST(t.n AS DOUBLE), 0.0) AS adj_ratio,
               coalesce(t.n_noun / CAST(t.n AS DOUBLE), 0.0) AS noun_ratio,
               coalesce(t.n_adj / CAST(greatest(t.n_noun, 1) AS DOUBLE), 0.0) AS adj_noun_ratio
        FROM docs d LEFT JOIN concrete c ON d.id = c.id LEFT JOIN tones t ON d.id = t.id)""",
    "features": """features AS (
        SELECT n.*, s.* EXCLUDE (id), w.label, w.difficulty, w.cohort, w.correct_count
        FROM native n JOIN scores s ON n.id = s.id JOIN wide w ON n.id = w.id)""",
}

NEEDS = {
    "reviews": ["docs"], "facts": ["reviews"], "predictions": ["facts"], "wide": ["predictions"],
    "lexicon": ["docs"], "native": ["docs"], "scores": ["lexicon"], "features": ["native", "scores", "wide"],
    "docs": [],
}


def sql(body: str, *uses: str) -> str:
    """A query preceded by the common table expressions it uses."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS[name]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in uses:
        add(name)
    head = ",\n".join(PARTS[name] for name in ordered)
    return f"WITH {head}\n{body.strip()}" if ordered else body.strip()
