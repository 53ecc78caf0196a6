import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tools.check_queries import compare, connect
from veriscope.llm import mixing
from veriscope.shared import settle

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Shares by weight; sources above three times their size stop, their excess is reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, stopped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, set()
    while len(stopped) < len(sizes):
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        share = sum(w for s, w in weight.items() if s not in stopped)
        target = {s: float(3 * sizes[s]) if s in stopped else left * weight[s] / share for s in sizes}
        if not (new := {s for s in sizes if target[s] > 3 * sizes[s]}):
            break
        stopped |= new
    return target


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5}, {"a": 0, "b": 0}, {None: 7}, {"b": 90, None: 50, "Z": 1, "é": 2, "": 0}, {"x": 1}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = mixing.source_targets(df).collect()
        want = plain_targets(sizes)
        assert {r.source: r.source_size for r in got} == sizes
        for r in got:
            assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
            assert 0 <= r.quota <= 3 * r.n_blocks


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_permutation(spark, size):
    df = spark.range(3).crossJoin(spark.range(size).withColumnRenamed("id", "x"))
    rows = df.select("id", mixing.permuted(F.col("x"), F.lit(size), mixing.scrambled(F.col("id"), 1)).alias("y")).collect()
    for key in range(3):
        assert sorted(r.y for r in rows if r.id == key) == list(range(size))


def test_slots_meet_the_quotas_and_draws_differ_by_shard(spark):
    quotas = [(0, 40_000), (1, 20_000), (2, 0), (3, 3)]
    sources = settle(spark.createDataFrame(quotas, "source_no long, quota long"))
    slots = settle(mixing.drawn_slots(sources))
    numbers = defaultdict(list)
    for r in slots.collect():
        numbers[r.source_no].append(r.r)
    assert {s: sorted(n) for s, n in numbers.items()} == {s: list(range(q)) for s, q in quotas if q}
    shards = {(r.shard, r.source_no): r["count"] for r in slots.groupBy("shard", "source_no").count().collect()}
    size = 1 << mixing.SHARD_BITS
    for shard in range(3):
        # a multinomial draw: near its share, and seldom exactly there
        assert abs(shards[shard, 0] - size * 40 / 60) < 6 * math.sqrt(size * 2 / 9)
    assert len({shards[shard, 0] for shard in range(3)}) > 1


def test_cases(spark):
    rows = [(1, "a", "w " * 300, "mine"), (1, "a", "w " * 300, "mine"), (2, None, "x y\tz\n", None), (3, "b", None, "q"),
            (4, "b", "", "q"), (None, "b", "  lead and\n\nlast  ", "q"), (5, "c", "long " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    taken = mixing.Mix(mixing.sized(df), block_words=16).taken().collect()
    assert sorted((r.doc_id, r.size) for r in taken if r.doc_id) == [(1, 300), (1, 300), (2, 3), (3, 0), (4, 0), (5, 5000)]
    by_source = Counter()
    for r in taken:
        assert 0 <= r.taken <= 3 * r.size
        by_source[r.target] += r.taken
    for target, words in by_source.items():
        assert abs(words - target) <= 48
    mixed = mixing.mixed_documents(df, block_words=16)
    assert mixed.columns == df.columns
    got = mixed.collect()
    assert sum(len(WORD.findall(r.text)) for r in got) == sum(r.taken for r in taken)
    texts = {t for _, _, t, _ in rows if t}
    assert all(any(r.text in t for t in texts) for r in got)
    assert "  lead and\n\nlast  " in {r.text for r in got}
    assert mixing.mixed_documents(df.limit(0)).count() == 0
    assert mixing.Mix(mixing.sized(df.limit(0))).taken().count() == 0


def test_runs_agree(spark, sf_dir):
    first, second = (sorted(map(tuple, mixing.op1_mixing(spark, sf_dir).collect())) for _ in range(2))
    assert first == second


def test_query_equals_sql(spark, sf_dir):
    assert compare("op1", mixing.op1_mixing(spark, sf_dir), connect(sf_dir), mixing.ORACLE).startswith("ok (")
