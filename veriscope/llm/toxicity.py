"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read in overlapping windows of words.  A word enters by its own vector, if the
fitted vocabulary has it, and by the vectors of its character trigrams.  Two recurrent
passes, one in each direction, run over a window; attention pools their states; the text's
score is that of its most toxic window.  Everything is numpy: fitting runs on the driver on
a sample bounded by ``FIT_DOCUMENTS`` and ``FIT_WINDOWS``, scoring in the tasks, on whole
texts.  Fitting chooses a window of each toxic text (at first by the words' odds, then by the
network itself) and windows of clean texts, and ends with the logit that parts the sample
best; it gets the score 0.5.

Cases: a null or empty text has the score of an empty window; very long texts are read a
slice of windows at a time; repeated rows score alike; without labels of both classes every
score is the share of toxic labels; further columns stay; an empty table stays empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from string import punctuation as PUNCTUATION

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.llm.texts import has_columns

WINDOW, STRIDE = 32, 24
STATES, WORD_SIZE, CHAR_SIZE, TRIGRAMS = 8, 6, 6, 4096
VOCABULARY, LEAST_TEXTS = 20_000, 3
# Bounds of the sample for fitting: texts per class, windows per text (evenly spread).
FIT_DOCUMENTS, FIT_WINDOWS = 600, 256
EPOCHS, BATCH, RATE, FORGOTTEN_WORDS, DECAY, WORD_RATE = 6, 64, 0.01, 0.05, 0.02, 0.1
SEED = 42
# Scoring: windows at a time, words that a worker remembers.
SCORED_WINDOWS, REMEMBERED_WORDS = 4096, 200_000


def window_starts(n_words: int) -> np.ndarray:
    return np.arange(0, max(1, n_words - (WINDOW - STRIDE)), STRIDE)


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without the punctuation around them, unless they are nothing else."""
    return [w.strip(PUNCTUATION) or w for w in (text or "").lower().split()]


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def trigram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams of the words' bytes, with marked ends, and each word's first one."""
    marked = [b"<" + (w or " ").encode("utf-8", "replace") + b">" for w in words]
    sizes = np.array([len(m) for m in marked])
    octets = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.int64)
    ends = np.cumsum(sizes)
    inside = np.ones(len(octets), dtype=bool)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    codes = (octets[at] * 961 + octets[at + 1] * 31 + octets[at + 2]) * 2_654_435_761 % (1 << 32) >> 20
    return codes % TRIGRAMS, np.concatenate([[0], np.cumsum(sizes - 2)[:-1]])


class Network:
    """Weights by name; ``words`` maps the vocabulary to rows of the word vectors (0: others)."""

    def __init__(self, words: dict[str, int], odds: np.ndarray, seed: int = SEED):
        draw = np.random.default_rng(seed)
        size, gates = WORD_SIZE + CHAR_SIZE, 3 * STATES

        def some(*shape, scale=0.3):
            return (draw.normal(size=shape) * scale).astype(np.float32)

        self.words = words
        self.weights = {
            "word": some(len(words) + 1, WORD_SIZE, scale=0.05), "char": some(TRIGRAMS, CHAR_SIZE, scale=0.1),
            "in": some(2, size, gates), "own": some(2, STATES, gates), "bias": np.zeros((2, gates), np.float32),
            "look": some(2 * STATES, 2 * STATES), "gaze": some(2 * STATES),
            "out": some(2 * STATES), "shift": np.zeros(1, np.float32),
        }
        # what a word alone tells of a text is a good start
        self.weights["word"][:, 0] += odds
        self.limit = 0.0

    # inputs of words

    def word_inputs(self, words: list[str], known: np.ndarray | None = None):
        """The input of each word, and what it was made of."""
        w = self.weights
        rows = np.array([self.words.get(x, 0) for x in words]) if known is None else known
        codes, first = trigram_codes(words)
        sizes = np.diff(np.concatenate([first, [len(codes)]]))
        chars = np.add.reduceat(w["char"][codes], first, axis=0) / sizes[:, None].astype(np.float32)
        return np.concatenate([w["word"][rows], chars], axis=1), (rows, codes, first, sizes)

    def gate_inputs(self, words: list[str]) -> np.ndarray:
        """Gate inputs of both directions, a row per word."""
        inputs, _ = self.word_inputs(words)
        return np.concatenate([inputs @ self.weights["in"][d] + self.weights["bias"][d] for d in (0, 1)], axis=1)

    # forward

    def run(self, gates: np.ndarray, places: np.ndarray, mask: np.ndarray, d: int, keep: list | None = None) -> np.ndarray:
        """States of direction ``d`` over the windows: windows x WINDOW x STATES."""
        own, n, s = self.weights["own"][d], len(places), STATES
        state = np.zeros((n, s), np.float32)
        states = np.empty((places.shape[1], n, s), np.float32)
        steps = range(places.shape[1]) if d == 0 else range(places.shape[1] - 1, -1, -1)
        columns = gates[:, 3 * s * d:3 * s * (d + 1)]
        for t in steps:
            x, u = columns[places[:, t]], state @ own
            zr = sigmoid(x[:, :2 * s] + u[:, :2 * s])
            z, r = zr[:, :s], zr[:, s:]
            new = np.tanh(x[:, 2 * s:] + r * u[:, 2 * s:])
            following = new + z * (state - new)
            if not mask[:, t].all():
                following = np.where(mask[:, t, None], following, state)
            if keep is not None:
                keep.append((t, state, z, r, new, u[:, 2 * s:]))
            states[t] = state = following
        return states

    def pooled(self, states: np.ndarray, mask: np.ndarray):
        """Attention over the states, and the windows' logits."""
        w = self.weights
        looked = np.tanh(states @ w["look"])
        gaze = np.where(mask.T, looked @ w["gaze"], np.float32(-1e9))
        share = np.exp(gaze - gaze.max(axis=0))
        share /= share.sum(axis=0)
        summary = (share[:, :, None] * states).sum(axis=0)
        return looked, share, summary, summary @ w["out"] + w["shift"][0]

    def logits(self, gates: np.ndarray, places: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self.run(gates, places, mask, d) for d in (0, 1)], axis=2)
        return self.pooled(states, mask)[3]

    # backward

    def gradients(self, words: list[str], known: np.ndarray, places: np.ndarray, mask: np.ndarray,
                  target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, s = self.weights, STATES
        inputs, (rows, codes, first, sizes) = self.word_inputs(words, known)
        gates = np.concatenate([inputs @ w["in"][d] + w["bias"][d] for d in (0, 1)], axis=1)
        kept: tuple[list, list] = ([], [])
        states = np.concatenate([self.run(gates, places, mask, d, kept[d]) for d in (0, 1)], axis=2)
        looked, share, summary, logit = self.pooled(states, mask)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        wrong = ((sigmoid(logit) - target) * weight / len(target)).astype(np.float32)
        grad["out"], grad["shift"][0] = summary.T @ wrong, wrong.sum()
        to_summary = wrong[:, None] * w["out"]
        to_states = share[:, :, None] * to_summary
        to_share = (states * to_summary).sum(axis=2)
        to_gaze = share * (to_share - (share * to_share).sum(axis=0))
        grad["gaze"] = np.tensordot(to_gaze, looked, axes=([0, 1], [0, 1]))
        to_looked = to_gaze[:, :, None] * w["gaze"] * (1 - looked ** 2)
        grad["look"] = np.tensordot(states, to_looked, axes=([0, 1], [0, 1]))
        to_states += to_looked @ w["look"].T
        to_gates = np.zeros_like(gates)
        for d in (0, 1):
            own, later = w["own"][d], np.zeros((len(places), s), np.float32)
            for t, state, z, r, new, u in reversed(kept[d]):
                here = to_states[t, :, s * d:s * (d + 1)] + later
                live = mask[:, t, None]
                step = np.where(live, here, 0)
                to_new = step * (1 - z) * (1 - new ** 2)
                to_z = step * (state - new) * z * (1 - z)
                to_r = to_new * u * r * (1 - r)
                to_u = np.concatenate([to_z, to_r, to_new * r], axis=1)
                grad["own"][d] += state.T @ to_u
                later = step * z + to_u @ own.T + np.where(live, 0, here)
                to_x = np.concatenate([to_z, to_r, to_new], axis=1)
                np.add.at(to_gates[:, 3 * s * d:3 * s * (d + 1)], places[:, t], to_x)
        to_inputs = np.zeros_like(inputs)
        for d in (0, 1):
            part = to_gates[:, 3 * s * d:3 * s * (d + 1)]
            grad["in"][d], grad["bias"][d] = inputs.T @ part, part.sum(axis=0)
            to_inputs += part @ w["in"][d].T
        np.add.at(grad["word"], rows, to_inputs[:, :WORD_SIZE])
        each = np.repeat(to_inputs[:, WORD_SIZE:] / sizes[:, None].astype(np.float32), sizes, axis=0)
        np.add.at(grad["char"], codes, each)
        return grad


def window_arrays(windows: list[list[str]]):
    """Different words, each window's places among them, and which places are filled."""
    numbers: dict[str, int] = {"": 0}
    places, mask = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), bool)
    mask[:, 0] = True  # an empty window holds the empty word
    for i, window in enumerate(windows):
        places[i, :len(window)] = [numbers.setdefault(word, len(numbers)) for word in window]
        mask[i, :len(window)] = True
    return list(numbers), places, mask


class Fitting:
    """Fits a network to texts given by their windows."""

    def __init__(self, texts: list[list[list[str]]], toxic: np.ndarray, toxic_share: float, seed: int = SEED):
        self.texts, self.toxic, self.share, self.draw = texts, toxic, toxic_share, np.random.default_rng(seed)
        counts = [Counter(), Counter()]
        for text, label in zip(texts, toxic):
            counts[int(label)].update({word for window in text for word in window})
        n = [max(1, int((toxic == c).sum())) for c in (0, 1)]
        both = Counter(counts[0]) + counts[1]
        listed = sorted((w for w, k in both.items() if k >= LEAST_TEXTS), key=lambda w: (-both[w], w))[:VOCABULARY]
        # a word's odds as far as they are certain: two standard errors nearer to even
        a, b = (np.array([counts[c][w] for w in listed], dtype=float) + 0.5 for c in (1, 0))
        even, error = np.log(a / (n[1] + 1)) - np.log(b / (n[0] + 1)), np.sqrt(1 / a + 1 / b)
        odds = np.clip(np.sign(even) * np.maximum(0, np.abs(even) - 2 * error), -4, 4)
        odds = np.concatenate([[0.0], odds]).astype(np.float32)
        self.odds = dict(zip(listed, odds[1:]))
        self.network = Network({w: i + 1 for i, w in enumerate(listed)}, odds, seed)
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.network.weights.items()}
        self.step = 0

    def best_by_odds(self, text) -> int:
        return int(np.argmax([sum(max(0.0, self.odds.get(w, 0.0)) for w in window) for window in text]))

    def best_by_network(self) -> list[int]:
        return [int(np.argmax(s)) for s in self.scores()]

    def scores(self) -> list[np.ndarray]:
        result = []
        for at in range(0, len(self.texts), 100):
            part = self.texts[at:at + 100]
            words, places, mask = window_arrays([window for text in part for window in text])
            logits = self.network.logits(self.network.gate_inputs(words), places, mask)
            result += np.split(logits, np.cumsum([len(t) for t in part])[:-1])
        return result

    def learn(self, windows: list[list[str]], target: np.ndarray) -> None:
        """One pass over the windows, with some words made unknown and both classes weighing the same."""
        order = self.draw.permutation(len(windows))
        balance = {c: 0.5 / max(1e-9, (target == c).mean()) for c in (0.0, 1.0)}
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            words, places, mask = window_arrays([windows[i] for i in chosen])
            known = np.array([self.network.words.get(w, 0) for w in words])
            known[self.draw.random(len(words)) < FORGOTTEN_WORDS] = 0
            weight = np.array([balance[t] for t in target[chosen]])
            grad = self.network.gradients(words, known, places, mask, target[chosen], weight)
            self.step += 1
            for name, g in grad.items():
                mean, square = self.moments[name]
                mean += 0.1 * (g - mean)
                square += 0.001 * (g * g - square)
                even = mean / (1 - 0.9 ** self.step), square / (1 - 0.999 ** self.step)
                weights = self.network.weights[name]
                rate = RATE * (WORD_RATE if name in ("word", "char") else 1)
                weights -= rate * (even[0] / (np.sqrt(even[1]) + 1e-8) + DECAY * weights * (name != "word"))

    def fit(self) -> Network:
        best = [self.best_by_odds(t) for t in self.texts]
        for epoch in range(EPOCHS):
            windows, target = [[]], [0.0]
            for text, label, top in zip(self.texts, self.toxic, best):
                picked = {top} if label else {top, *self.draw.integers(0, len(text), 3)}
                windows += [text[i] for i in sorted(picked)]
                target += [float(label)] * len(picked)
            self.learn(windows, np.array(target))
            if epoch:
                best = self.best_by_network()
        self.network.limit = self.fitted_limit(np.array([s.max() for s in self.scores()]))
        return self.network

    def fitted_limit(self, tops: np.ndarray) -> float:
        """The logit to predict from: the middle of the widest gap between neighbouring texts
        among those with the fewest mistakes, at the true share of toxic texts."""
        weight = np.where(self.toxic == 1, self.share / max(1, (self.toxic == 1).sum()),
                          (1 - self.share) / max(1, (self.toxic == 0).sum()))
        order = np.argsort(tops, kind="stable")
        tops, toxic, weight = tops[order], self.toxic[order], weight[order]
        mistakes = np.cumsum(weight * toxic)[:-1] + np.cumsum((weight * (1 - toxic))[::-1])[::-1][1:]
        best = np.flatnonzero(mistakes <= mistakes.min() + 1e-9)
        cut = best[np.argmax(tops[best + 1] - tops[best])]
        return float((tops[cut] + tops[cut + 1]) / 2)


class Constant:
    """Scores every text alike."""

    def __init__(self, score: float):
        self.score = score

    def scores(self, texts) -> np.ndarray:
        return np.full(len(texts), self.score)


class Scorer:
    """Scores texts; remembers the gate inputs of words it has seen, up to a bound."""

    def __init__(self, network: Network):
        self.network = network
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {"": 0}
        self.gates = self.network.gate_inputs([""])

    def scores(self, texts) -> np.ndarray:
        """Score of each text: that of its highest window."""
        tops = np.full(len(texts), -np.inf)
        owners, places, mask, held = [], [], [], 0
        span = np.arange(WINDOW)

        def flush():
            nonlocal owners, places, mask, held
            if not held:
                return
            new = list(self.rows)[len(self.gates):]
            if new:
                self.gates = np.concatenate([self.gates, self.network.gate_inputs(new)])
            owner, place, filled = np.concatenate(owners), np.concatenate(places), np.concatenate(mask)
            for at in range(0, held, SCORED_WINDOWS):
                cut = slice(at, at + SCORED_WINDOWS)
                np.maximum.at(tops, owner[cut], self.network.logits(self.gates, place[cut], filled[cut]))
            owners, places, mask, held = [], [], [], 0
            if len(self.rows) > REMEMBERED_WORDS:
                self.forget()

        for i, text in enumerate(texts):
            words = words_of(text)
            rows = self.rows
            numbers = np.array([rows.setdefault(w, len(rows)) for w in words] or [0], dtype=np.int64)
            starts = window_starts(len(words))
            at = starts[:, None] + span
            filled = at < len(numbers)
            owners.append(np.full(len(starts), i))
            places.append(numbers[np.minimum(at, len(numbers) - 1)])
            mask.append(filled)
            held += len(starts)
            if held >= SCORED_WINDOWS:
                flush()
        flush()
        return sigmoid(tops - self.network.limit)


def fitted(texts: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS, windows: int = FIT_WINDOWS):
    """A network fitted to texts (doc_id, text) by labels (doc_id, toxic): the ``documents``
    labels of each class with the smallest hashes, at most ``windows`` windows of each text.

    Labels are drawn before texts are read, so that no text is shuffled; of texts that share
    a doc_id the smallest is used.
    """
    known = labels.where("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / max(1, total)
    if len(counts) < 2:
        return Constant(share)

    def cut(batches):
        for batch in batches:
            found = []
            for text in batch.column(0):
                words = words_of(text.as_py())
                starts = window_starts(len(words))
                if len(starts) > windows:
                    starts = starts[np.linspace(0, len(starts) - 1, windows).astype(int)]
                found.append([" ".join(words[s:s + WINDOW]) for s in starts])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1)], names=["windows", "toxic"])

    drawn = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents) for label in (0, 1)]
    # at most ``documents`` rows per class
    sample = texts.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    table = (
        sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("toxic", F.xxhash64("doc_id"), "doc_id")
        .select("text", "toxic").mapInArrow(cut, "windows array<string>, toxic int").toArrow()
    )
    read = [[window.split() for window in row] for row in table.column(0).to_pylist()]
    return Fitting(read, table.column(1).to_numpy().astype(float), share).fit()


def toxicity(text: Column, model) -> Column:
    """Score of a text, from 0 to 1."""
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model if isinstance(model, Constant) else Scorer(model)
        for texts in batches:
            yield pd.Series(scorer.scores(texts.tolist()), dtype="float64")

    return scored(F.coalesce(text, F.lit("")))


def with_toxicity(df: DataFrame, model, text: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted``."""
    has_columns(df, text)
    return df.withColumn("score", toxicity(df[text], model)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op7_toxicity(spark, sf_dir):
    """Every document with its score; fitted to the labelled ones that are not held out."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    model = fitted(documents, labels)
    return with_toxicity(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
