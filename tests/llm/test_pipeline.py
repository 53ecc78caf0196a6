"""The pipeline, stage by stage, against plain versions."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_packing import check_layout
from tests.llm.test_quality import plain_counts, plain_kept
from tests.llm.test_secret_scan import spans
from tests.llm.test_simhash import plain_components, plain_fingerprint
from veriscope.shared import settle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What goes into and comes out of every stage, as rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        result = settle(stage(spark, docs, sf_dir))
        found[name] = (docs.collect(), result.collect(), result.columns)
        docs = result
    return found


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        assert stages[name][2] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(stages):
    before, after, _ = stages["quality_rules"]
    assert sorted(after) == sorted(r for r in before if plain_kept(plain_counts(r.text)))
    assert 0 < len(after) < len(before)


def test_near_duplicates(stages):
    before, after, _ = stages["simhash_near_dedup"]
    root = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in before])
    assert sorted(after) == sorted(r for r in before if root[r.doc_id] == r.doc_id)


def test_secrets(stages):
    before, after, _ = stages["secret_scan"]
    want = {}
    for r in before:
        text, upto, out = r.text, 0, ""
        for _, start, end in spans(text):
            if start >= upto:
                out += text[upto:start] + "[SECRET]"
            upto = max(upto, end)
        want[r.doc_id] = out + text[upto:]
    assert {r.doc_id: r.text for r in after} == want and len(after) == len(before)
    assert all(r.n_chars == len(r.text) for r in after if "[SECRET]" in r.text)
    assert not any(spans(r.text) for r in after)


def test_mix(stages):
    before, after, _ = stages["source_mix"]
    texts, sizes, taken = {r.doc_id: r for r in before}, Counter(), Counter()
    for r in before:
        sizes[r.source] += len(WORD.findall(r.text))
    used = defaultdict(list)
    for r in after:
        words, whole = WORD.findall(r.text), WORD.findall(texts[r.doc_id].text)
        assert r.n_chars == len(r.text) and r.text in texts[r.doc_id].text
        assert any(whole[i:i + len(words)] == words for i in range(len(whole)))
        assert (r.lang, r.source) == (texts[r.doc_id].lang, texts[r.doc_id].source)
        taken[r.source] += len(words)
        used[r.doc_id].append(len(words))
    for doc_id, parts in used.items():
        assert sum(parts) <= 3 * len(WORD.findall(texts[doc_id].text))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    target, stopped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        share = sum(w for s, w in weights.items() if s not in stopped)
        target = {s: 3 * sizes[s] if s in stopped else left * w / share for s, w in weights.items()}
        if not (new := {s for s in sizes if target[s] > 3 * sizes[s]}):
            break
        stopped |= new
    for s, t in target.items():
        assert abs(taken[s] - t) <= 130 + 0.05 * t


def test_packing(stages):
    before, after, _ = stages["best_fit_packing"]
    least = -(-sum(r.length for r in after) // 2048)
    assert check_layout(after, 2048) <= least + 2
    assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)


def test_run_equals_its_stages(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages["best_fit_packing"][1]))


LONG = "Ein Satz mit der Zeit und den Leuten die das Haus von oben sehen. "


def test_cases(spark, sf_dir):
    prose = "the house of the old man and the sea is in a book that it is for everyone to read on a day like this one\n"
    rows = [
        (1, prose + "token=abcdef123", "en", "a", 5), (1, prose + "token=abcdef123", "en", "a", 5),
        (2, None, None, None, None), (3, "", "en", "a", 0), (None, prose * 2 + "x", None, None, None),
        (4, "".join(f"{LONG}{i} " for i in range(8000)), "de", "b", 1), (5, prose.upper(), "en", None, 7), (6, " \n ", "en", "c", 3),
    ]
    docs = settle(spark.createDataFrame(rows, SCHEMA).withColumns({
        "n_words": F.lit("mine"), "kept": F.lit(1), "size": F.lit(2), "block": F.lit(3), "fp": F.lit(4), "findings": F.lit(5),
        "source_no": F.lit(6), "_words": F.lit("w"), "_lines": F.lit("l"), "one": F.lit("1"), "digest": F.lit("d"), "_metadata": F.lit("m")}))
    columns = docs.columns
    mine = "n_words = 'mine' AND kept = 1 AND size = 2 AND _words = 'w' AND _lines = 'l' AND one = '1' AND digest = 'd' AND _metadata = 'm'"
    results = {}
    # every stage gets the rows as they are, not what the one before it leaves
    for name, stage in corpus_pipeline.STAGES:
        result = settle(stage(spark, docs, sf_dir))
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0 and empty.columns == result.columns
        if name != "best_fit_packing":
            assert result.columns == columns
            assert result.where(f"NOT coalesce({mine}, false)").count() == 0
        results[name] = result.collect()
    texts = [(r[0], r[1]) for r in rows]
    assert sorted((r.doc_id, r.text) for r in results["quality_rules"]) == sorted(
        (i, t) for i, t in texts if plain_kept(plain_counts(t)))
    root = plain_components([(i, plain_fingerprint(t)) for i, t in texts if i is not None])
    alone = Counter(i for i in root.values())
    found = Counter(r.doc_id for r in results["simhash_near_dedup"])
    assert found == Counter(alone.keys()) + Counter([None])
    assert Counter(r.doc_id for r in results["secret_scan"]) == Counter(i for i, _ in texts)
    assert [r.text for r in results["secret_scan"] if r.doc_id == 1] == [prose + "[SECRET]"] * 2
    assert all(r.text == dict(texts)[r.doc_id] for r in results["secret_scan"] if r.doc_id != 1)
    taken = {r.doc_id for r in results["source_mix"]}
    assert None in taken and 4 in taken and not taken & {2, 3, 6}
    check_layout(results["best_fit_packing"], 2048)
    assert Counter(r.doc_id for r in results["best_fit_packing"] if r.piece == 0) == Counter(i for i, _ in texts)
