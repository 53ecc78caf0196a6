import random
import re

import pytest
import xxhash

from veriscope.llm import simhash
from veriscope.llm.components import components
from veriscope.llm.simhash import deduplicated, fingerprint_links, near_duplicates, op6_simhash

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_fingerprint(text):
    found = WORD.findall((text or "").translate(LOWER))
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i:i + 3]), 42) for i in range(max(1, len(found) - 2))] if found else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable; ``prints`` are (id, fingerprint)."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (a, x) in enumerate(prints):
        for b, y in prints[n + 1:]:
            if (x ^ y).bit_count() <= 2:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in root}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("joined_rows", [4, 256])
def test_links_connect_what_plain_comparison_does(spark, joined_rows):
    """Both ways of linking, with chains, crowds and random fingerprints."""
    draw = random.Random(5)
    found = {draw.getrandbits(64) for _ in range(40)}
    for center in list(found)[:6]:
        for _ in range(25):
            found.add(center ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(8)))
    found |= {0, 1, 3, 7, 15, 1 << 63, (1 << 64) - 1, (1 << 64) - 4, 0xFFFFFFFF, 0xFFFFFFFC}
    prints = [(signed(x), x) for x in sorted(found, key=signed)]
    want = plain_components(prints)
    df = spark.createDataFrame([(i,) for i, _ in prints], "fp long")
    links = fingerprint_links(df, joined_rows)
    assert all(((u ^ v) & ((1 << 64) - 1)).bit_count() <= 2 for u, v in links.collect())
    got = {r.node: r.component for r in components(links).collect()}
    assert {i: got.get(i, i) for i, _ in prints} == want


def test_components_of_paths_cycles_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101), (101, 100)] + [(500, i) for i in range(501, 540)] + [(9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, **{i: 500 for i in range(500, 540)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_cases(spark):
    rows = [(5, "One two THREE four", "a"), (3, "one two three four", "b"), (3, "one two three four", "b"), (7, None, "c"),
            (8, "", "d"), (9, "x", "e"), (10, "X", "f"), (None, "one two three four", "g"), (None, "lonely", "h"),
            (11, "word " * 2_000, "i"), (12, "Á b c", "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    by_text = {(r[0], plain_fingerprint(r[1])) for r in rows}
    assert {(r.doc_id, r.fp & ((1 << 64) - 1)) for r in got} == by_text
    named = {(r.doc_id, r.component_id) for r in got}
    assert named == {(5, 3), (3, 3), (7, 7), (8, 7), (9, 9), (10, 9), (None, 3), (None, None), (11, 11), (12, 12)}
    kept = deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(3, rows[1][1]), (7, None), (9, "x"), (11, rows[9][1]), (12, "Á b c"), (None, "lonely"), (None, rows[7][1])], key=str)
    assert near_duplicates(df.limit(0)).count() == 0 and deduplicated(df.limit(0)).count() == 0


def test_query_against_plain_comparison(spark, sf_dir):
    texts = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain_components(texts)
    got = op6_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{x:016x}", want[i]) for i, x in texts}
    assert len(got) == len(texts)


def test_crowded_variants_are_counted_before_the_shuffle(spark, monkeypatch):
    """No window holds a variant: rows are counted in parts, and the counts joined to them."""
    plans, settle = [], simhash.settle

    def settled(df, compact=False):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, compact)

    monkeypatch.setattr(simhash, "settle", settled)
    near = spark.range(300).selectExpr("id AS fp")
    links = simhash.fingerprint_links(near, joined_rows=16).collect()
    assert plans and not any("Window" in plan for plan in plans)
    assert any("partial_count" in plan for plan in plans)
    # the numbers below 300 hang together by single bits
    reached, todo, of = {0}, [0], {}
    for u, v in links:
        of.setdefault(u, []).append(v)
        of.setdefault(v, []).append(u)
    while todo:
        new = {v for v in of.get(todo.pop(), []) if v not in reached}
        reached |= new
        todo += new
    assert reached == set(range(300)) and all((u ^ v).bit_count() <= 2 for u, v in links)


def test_rows_of_one_doc_id_and_different_texts_are_kept(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "one two three four five"), (2, "alpha beta gamma delta"), (1, "one two three four five")]
    for parts in (1, 3):
        got = deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
        assert sorted(map(tuple, got.collect())) == sorted(rows[:2])


def test_deduplicated_moves_no_texts(spark, sf_dir, monkeypatch):
    from veriscope import shared

    monkeypatch.setattr(shared, "MAX_BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "text" in plan and not any("Exchange" in line and "text" in line for line in plan.splitlines())
