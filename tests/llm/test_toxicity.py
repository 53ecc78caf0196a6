import numpy as np

from veriscope.llm import toxicity

RUDE = ["idiot", "moron", "scum"]


def sample(n, seed=0):
    draw = np.random.default_rng(seed)
    words = ["".join(draw.choice(list("aeiounrstl"), draw.integers(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [str(w) for w in draw.choice(words, draw.integers(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(draw.integers(0, len(text)), str(draw.choice(RUDE)))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_gradients():
    """Against differences of the loss."""
    windows = [["a", "bad", "word"], ["b"], ["c", "d", "a"] * 10 + ["e", "f"], []]
    words, places, mask = toxicity.window_arrays(windows)
    net = toxicity.Network({"a": 1, "bad": 2}, np.array([0, 0.5, 2], dtype=np.float32))
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    known, target, weight = np.array([net.words.get(w, 0) for w in words]), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])

    def loss():
        p = toxicity.sigmoid(net.logits(net.gate_inputs(words), places, mask).astype(np.float64))
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).mean()

    grad = net.gradients(words, known, places, mask, target, weight)
    draw = np.random.default_rng(1)
    for name, values in net.weights.items():
        for _ in range(6):
            at = tuple(draw.integers(0, n) for n in values.shape)
            if name == "char":
                at = (int(draw.choice(toxicity.trigram_codes(words)[0])), at[1])
            kept, step = values[at], 1e-2
            values[at] = kept + step
            up = loss()
            values[at] = kept - step
            down = loss()
            values[at] = kept
            assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-3 + 0.05 * abs(grad[name][at]), (name, at)


def test_windows_overlap_and_cover_all():
    for n in (0, 1, 32, 33, 56, 57, 1000):
        starts = toxicity.window_starts(n)
        assert starts[0] == 0 and starts[-1] + toxicity.WINDOW >= n
        assert all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_fit_and_score(spark):
    rows = sample(400)
    df = spark.createDataFrame([*rows, (1000, None, 0), (1001, "", 0), (1002, "x", None)], "doc_id long, text string, toxic int")
    model = toxicity.fitted(df, df, documents=150)
    later = sample(200, seed=1)
    cases = [(2000, None, 0, 9), (2001, "", 0, 9), (2002, "fine words " * 20_000 + "idiot moron scum idiot", 1, 9), (2000, None, 0, 9)]
    test = spark.createDataFrame([(i, t, y, 9) for i, t, y in later] + cases, "doc_id long, text string, truth int, score int")
    got = toxicity.with_toxicity(test, model).collect()
    assert len(got) == len(later) + len(cases)
    assert np.mean([r.predicted == r.truth for r in got]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    assert toxicity.with_toxicity(test.limit(0), model).count() == 0


def test_one_class_and_no_labels(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "doc_id long, text string, toxic int")
    assert [r.score for r in toxicity.with_toxicity(df, toxicity.fitted(df, df)).collect()] == [0.0, 0.0]
    assert [r.score for r in toxicity.with_toxicity(df, toxicity.fitted(df, df.limit(0))).collect()] == [0.0, 0.0]


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.op7_toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in got if r.toxic]
    clean = [r for r in got if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
