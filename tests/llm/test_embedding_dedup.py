import numpy as np
import pytest

from veriscope.llm.embedding_dedup import (
    chosen_index, chosen_pivots, near_duplicates, nearest_pivots, op5_embedding_dedup, share_of_pairs, star_labels,
)


def plain(rows, limit=0.93):
    """Links and components of (vec_id, vector, label) by comparing all pairs."""
    fine = {}
    for n, (_, vector, label) in enumerate(rows):
        v = None if vector is None or any(x is None for x in vector) else np.array(vector, dtype=np.float32).astype(float)
        if label is not None and v is not None and len(v) and np.isfinite(v).all() and v.any():
            fine[n] = v / np.linalg.norm(v)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fine:
        for j in fine:
            if i < j and rows[i][2] == rows[j][2] and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] >= limit:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, (vec_id, _, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(vec_id)
    return sorted(((rows[i][0], links[i], min(ids[find(i)])) for i in range(len(rows))), key=str)


def found(df, **options):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(df, **options).collect()), key=str)


def test_cases(spark):
    rows = [
        (5, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (9, [2.0, 0.0, 0.0], 1), (4, [1.0, 0.1, 0.0], 1),
        (3, [1.0, 0.0, 0.0], 2), (6, [1.0, 0.0, 0.0], None), (7, None, 1), (8, [0.0, 0.0, 0.0], 1),
        (10, [float("nan"), 1.0, 0.0], 1), (11, [float("inf"), 1.0, 0.0], 1), (12, [], 1), (13, [1.0, 0.0], 1),
        (14, [None, 1.0, 0.0], 1), (15, [1e-30, 0.0, 0.0], 1), (16, [-1.0, 0.0, 0.0], 1), (17, [0.0, 1.0, 0.0], 1),
        (17, [0.0, 1.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS n", "2 AS class")
    assert found(df) == plain(rows)
    kept = {r.vec_id for r in near_duplicates(df).where("kept").collect()}
    assert kept == {2, 3, 6, 7, 8, 10, 11, 12, 13, 14, 16, 17}
    assert near_duplicates(df.limit(0)).count() == 0


def clusters(n, seed):
    draw = np.random.default_rng(seed)
    rows, vec_id = [], 0
    for label in (1, 2):
        for size in (n, 7, 3, 2, *[1] * 150):
            center = draw.normal(size=24)
            for _ in range(size):
                vector = center + draw.normal(size=24) * 0.18
                rows.append((vec_id, [float(np.float32(x)) for x in vector], label))
                vec_id += 1
    return rows


@pytest.mark.parametrize("tile_rows", [16, 1024])
def test_tiles_count_each_pair_once(spark, tile_rows):
    """With all pivots listed nothing is missed, and long lists give the same as short ones."""
    rows = clusters(90, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert found(df, n_pivots=6, nearest=6, tile_rows=tile_rows) == plain(rows)


def test_recall_and_precision(spark):
    rows = clusters(60, 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got, want = found(df), plain(rows)
    assert all(a[1] <= b[1] for a, b in zip(got, want))
    assert sum(a[1] for a in got) >= 0.9 * sum(b[1] for b in want)


def test_recall_at_the_limit():
    """Pairs just above the limit: over 0.98 share two of their nearest pivots."""
    draw = np.random.default_rng(0)
    points = draw.normal(size=(4000, 64))
    points /= np.linalg.norm(points, axis=1)[:, None]
    noise = draw.normal(size=points.shape)
    noise -= (noise * points).sum(1)[:, None] * points
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    others = 0.931 * points + np.sqrt(1 - 0.931 ** 2) * noise
    pivots = chosen_pivots(points)
    a, b = nearest_pivots(points, pivots), nearest_pivots(others, pivots)
    shared = (a[:, :, None] == b[:, None, :]).any(2).sum(1)
    assert (shared >= 2).mean() > 0.9


def test_star_labels():
    assert star_labels(5, np.array([0, 3, 1]), np.array([3, 4, 2])).tolist() == [0, 1, 1, 0, 0]


def test_query_against_plain_comparison(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in op5_embedding_dedup(spark, sf_dir).collect()), key=str)
    want = plain(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)


def cone(n, size, mean, draw):
    """Unit vectors whose mean cosine is ``mean``."""
    axis = np.eye(size)[0]
    rest = draw.normal(size=(n, size))
    rest -= (rest @ axis)[:, None] * axis
    return np.sqrt(mean) * axis + np.sqrt(1 - mean) * rest / np.linalg.norm(rest, axis=1)[:, None]


def turned(points, towards, cosine):
    across = towards - (towards * points).sum(1)[:, None] * points
    return cosine * points + np.sqrt(1 - cosine ** 2) * across / np.linalg.norm(across, axis=1)[:, None]


@pytest.mark.parametrize("size", [64, 256])
@pytest.mark.parametrize("mean", [0.0, 0.6, 0.8, 0.86, 0.9])
def test_recall_in_cones(size, mean):
    """Pairs just above the limit that the index was not fitted on, turned anywhere and into the cone."""
    draw = np.random.default_rng(9)
    points = cone(3_000, size, mean, draw)
    index = chosen_index(points[:2_000].astype(np.float32))
    own = points[2_000:]
    for towards in (draw.normal(size=own.shape), points[draw.integers(0, 2_000, len(own))]):
        assert share_of_pairs(index, own, turned(own, towards, 0.931)) > 0.9
    if mean == 0:
        assert share_of_pairs(index, own[:500], own[500:]) < 0.1


def test_near_pairs_planted_in_the_given_vectors(spark, sf_dir):
    """Each tenth vector once more, turned to just above the limit: at least nine in ten pairs are found."""
    given = [(r.vec_id, np.array(r.embedding, dtype=float), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
             if r.embedding is not None and r.label is not None and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    draw = np.random.default_rng(3)
    rows, planted = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in given], 0
    for i, v, label in given[::10]:
        u = v / np.linalg.norm(v)
        near = turned(u[None, :], draw.normal(size=(1, len(u))), 0.935)[0]
        rows.append((10**6 + i, [float(np.float32(x)) for x in near], label))
        planted += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    linked = {r.vec_id for r in near_duplicates(df).where("n_links > 0").collect()}
    assert planted > 10 and sum(10**6 + i in linked for i, _, _ in given[::10]) >= 0.9 * planted
