"""Answers that were paid for once are not asked for again."""

import json
import os

import pytest

from veriscope.learning.remote import score_remotely


def counting_client(folder, dies_at=None):
    """Every question leaves a line; after ``dies_at`` lines the task dies."""
    def make():
        def ask(settings, prompt):
            with open(f"{folder}/asked", "a") as out:
                out.write(json.dumps([settings, prompt]) + "\n")
            if dies_at and sum(1 for _ in open(f"{folder}/asked")) > dies_at:
                raise KeyboardInterrupt
            if "number 7," in prompt:
                return "nothing"
            return '{"label": "%s", "explanation": "e"}' % ("OR" if settings["shift"] else "CG")

        return ask

    return make


@pytest.fixture
def texts(spark):
    rows = [(i, "c", 5.0, f"number {i}, text") for i in range(40)]
    return spark.createDataFrame(rows, "id long, category string, rating double, text_ string").coalesce(1)


def asked(folder):
    return [json.dumps(json.loads(line)) for line in open(f"{folder}/asked")]


def test_only_unanswered_rows_are_asked_again(texts, tmp_path):
    how = {"variants": {"a": {"shift": 0}, "b": {"shift": 1}}, "concurrency": 1, "retries": 0, "wait": 0.0, "batch": 10,
           "journal": str(tmp_path / "journal")}
    with pytest.raises(Exception):
        score_remotely(texts, counting_client(tmp_path, dies_at=35), **how).collect()
    first = asked(tmp_path)
    assert 36 <= len(first) < 40  # what was on its way may still have ended
    found = score_remotely(texts, counting_client(tmp_path), **how).collect()
    again = asked(tmp_path)[len(first):]
    # three batches of ten were written; the failed answer in them and the batch on its way are asked again
    kept = {a for a in first[:30] if "number 7," not in a}
    assert not kept & set(again) and len(again) == 80 - len(kept)
    assert len(found) == 80 and {(r.id, r.variant): r.predicted_label for r in found} == {
        (i, v): None if i == 7 else label for i in range(40) for v, label in (("a", "CG"), ("b", "OR"))}
    third = score_remotely(texts, counting_client(tmp_path), **how).collect()
    assert sorted(map(tuple, third)) == sorted(map(tuple, found))
    assert len(asked(tmp_path)) == len(first) + len(again) + 2  # failed answers are asked for again
    changed = how | {"variants": {"a": {"shift": 1}}}
    assert {r.predicted_label for r in score_remotely(texts, counting_client(tmp_path), **changed).collect()} <= {"OR", None}


def test_a_task_that_starts_again_reads_its_batches(tmp_path):
    from veriscope.learning.remote import Journal

    journal = Journal(str(tmp_path / "j"))
    questions = [("a", "x"), ("a", "y"), ("b", "x")]
    assert journal.read(questions) == {}
    journal.write(questions, [("1", 1, None), (None, 4, "down"), ("2", 2, None)])
    assert journal.read(questions) == {("a", "x"): ("1", 1, None), ("b", "x"): ("2", 2, None)}
    assert journal.read(questions[:2]) == {} and not [f for f in os.listdir(tmp_path / "j") if f.startswith("_draft")]


def test_equal_questions_are_asked_once(spark, tmp_path):
    rows = [(i, "c", 5.0, "the same") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, category string, rating double, text_ string").coalesce(1)
    found = score_remotely(df, counting_client(tmp_path), {"a": {"shift": 0}}, concurrency=1, wait=0.0, journal=str(tmp_path / "j")).collect()
    assert len(found) == 20 and {r.predicted_label for r in found} == {"CG"} and len(asked(tmp_path)) == 1


def test_waits_grow(spark, monkeypatch, tmp_path):
    rows = [(1, "c", 5.0, "number 7, text")]
    df = spark.createDataFrame(rows, "id long, category string, rating double, text_ string")
    import time

    started = time.perf_counter()
    found = score_remotely(df, counting_client(tmp_path), {"a": {"shift": 0}}, retries=3, wait=0.2).collect()
    assert found[0].attempts == 4 and time.perf_counter() - started >= 0.2 + 0.4 + 0.8
