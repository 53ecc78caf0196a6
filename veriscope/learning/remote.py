"""Texts scored by a remote service, as a distributed job.

With a journal, every few answers are written to a file of the shared folder as soon as they
are there.  A run leaves out what the journal holds; a task that starts again reads the files
of its own batches first.  Only answers that were on their way when a task died are asked
(and paid) for twice.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.functions.answers import answer_field, parsed_label, review_prompt


ANSWERS = pa.schema([("variant", pa.string()), ("asked", pa.string()), ("answer", pa.string()), ("attempts", pa.int32()), ("error", pa.string())])
LONGEST_WAIT = 60.0


class Journal:
    """Answers by what was asked, in files named by the batch they answer.

    A file appears under its name when it is whole.  Failed answers are not kept: a later run
    asks for them again.
    """

    def __init__(self, folder: str):
        self.files, self.folder = pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.files.create_dir(self.folder, recursive=True)

    def _name(self, asked: list[tuple[str, str]]) -> str:
        return f"{self.folder}/{hashlib.sha256(json.dumps(asked).encode()).hexdigest()}.parquet"

    def read(self, asked: list[tuple[str, str]]) -> dict[tuple[str, str], tuple]:
        if self.files.get_file_info(self._name(asked)).type == pa.fs.FileType.NotFound:
            return {}
        rows = pq.read_table(self._name(asked), filesystem=self.files).to_pylist()
        return {(r["variant"], r["asked"]): (r["answer"], r["attempts"], r["error"]) for r in rows}

    def write(self, asked: list[tuple[str, str]], answers: list[tuple]) -> None:
        rows = [{"variant": v, "asked": a, "answer": answer, "attempts": n, "error": error}
                for (v, a), (answer, n, error) in zip(asked, answers) if error is None]
        draft = f"{self.folder}/_draft-{uuid.uuid4().hex}"
        pq.write_table(pa.Table.from_pylist(rows, schema=ANSWERS), draft, filesystem=self.files)
        self.files.move(draft, self._name(asked))


def score_remotely(texts: DataFrame, make_client: Callable, variants: dict[str, dict], concurrency: int = 20,
                   retries: int = 3, wait: float = 3.0, allowed: Sequence[str] = ("CG", "OR"),
                   key: str = "id", journal: str | None = None, batch: int = 64) -> DataFrame:
    """One answer per (text, variant): (key, variant, answer, predicted_label, explanation, attempts, error).

    ``variants`` maps a name to what the client needs (model, system prompt).
    ``make_client()`` runs once per task and returns ``ask(settings, prompt) -> str``.
    A refused or failed answer is asked again ``retries`` times, after ``wait`` seconds and twice
    as long each further time; the last error is kept.
    The number of partitions times ``concurrency`` bounds the calls in flight.
    ``journal``, a folder all executors share, keeps the answers of every ``batch`` questions;
    equal questions (settings and prompt) are answered from it.  Without one, settle the result
    before using it twice, or the service is called again.
    """
    settings = {name: dict(given) for name, given in variants.items()}
    valid = list(allowed)

    def problem_with(answer: str) -> str | None:
        result = json.loads(answer)
        if not isinstance(result, dict):
            return "not a JSON object"
        if "label" not in result:
            return "no label"
        return None if result["label"] in valid else "invalid label"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, kept = make_client(), Journal(journal) if journal else None

        def answer_one(row):
            error = None
            for attempt in range(1, retries + 2):
                try:
                    answer = ask(settings[row.variant], row.prompt).strip()
                    error = problem_with(answer)
                    if error is None:
                        return answer, attempt, None
                except Exception as failure:  # recorded with the row
                    error = f"{type(failure).__name__}: {failure}"
                if attempt <= retries:
                    time.sleep(min(wait * 2 ** (attempt - 1), max(wait, LONGEST_WAIT)))
            return None, retries + 1, error

        def answered(part: pd.DataFrame) -> list[tuple]:
            if kept is None:
                return list(pool.map(answer_one, part.itertuples(index=False)))
            asked = list(zip(part["variant"], part["asked"]))
            known = kept.read(asked)
            if len(known) < len(set(asked)):
                # equal questions of a batch are asked once
                open_ = part[[a not in known for a in asked]].drop_duplicates(["variant", "asked"])
                found = list(pool.map(answer_one, open_.itertuples(index=False)))
                known |= dict(zip(zip(open_["variant"], open_["asked"]), found))
                kept.write(asked, [known[a] for a in asked])
            return [known[a] for a in asked]

        with ThreadPoolExecutor(concurrency) as pool:
            for whole in batches:
                for begin in range(0, len(whole), batch):
                    part = whole.iloc[begin:begin + batch]
                    out = part[[key, "variant"]].copy()
                    out["answer"], out["attempts"], out["error"] = zip(*answered(part))
                    yield out

    questions = texts.select(
        key, F.explode(F.array(*[F.lit(name) for name in settings])).alias("variant"),
        review_prompt(F.col("category"), F.col("rating"), F.col("text_")).alias("prompt"),
    )
    # a question is told by its settings and prompt: other settings under the same name are other questions
    said = F.create_map(*[F.lit(x) for name, given in settings.items() for x in (name, json.dumps(given, sort_keys=True, default=str))])
    questions = questions.withColumn("asked", F.sha2(F.concat_ws("|", said[F.col("variant")], "prompt"), 256))
    schema = f"{key} long, variant string, answer string, attempts int, error string"
    known = _journal_table(texts.sparkSession, journal) if journal else None
    if known is None:
        answers = questions.mapInPandas(run, schema)
    else:
        matched = questions.join(known, ["variant", "asked"], "left")
        fresh = matched.where("attempts IS NULL").select(*questions.columns).mapInPandas(run, schema)
        answers = fresh.unionByName(matched.where("attempts IS NOT NULL").select(key, "variant", "answer", "attempts", "error"))
    return answers.withColumns({
        "predicted_label": parsed_label(F.col("answer"), allowed),
        "explanation": answer_field(F.col("answer"), "explanation"),
    })


def _journal_table(spark, journal: str) -> DataFrame | None:
    """What the journal holds when a run begins, an answer per question; None if there is no journal yet."""
    try:
        stored = spark.read.schema("variant string, asked string, answer string, attempts int, error string").option(
            "pathGlobFilter", "*.parquet").parquet(journal)
    except AnalysisException:
        return None
    return stored.groupBy("variant", "asked").agg(F.min_by(F.struct("answer", "attempts", "error"), "answer").alias("a")).select(
        "variant", "asked", "a.*")
