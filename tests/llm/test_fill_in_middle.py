import hashlib
import random

import numpy as np

from tools.check_queries import compare, connect
from veriscope.llm import fill_in_middle as fim


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    """As the rules are stated, on code points."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def awkward_texts():
    draw = random.Random(3)
    texts = [None, "", "a", "é", "😀", "<P", "<P>", "x" * 63 + "<S>" + "y" * 200, "<<S", "a<M", ">" * 50, "a" * 20_000, "é" * 9_000, "😀" * 5_000 + "<",
             "\x00\n\r" * 100, "á" * 3_000]
    shared = "".join(draw.choice("abc déßx😀 \n") for _ in range(6_000))
    texts += [f"{i} {shared[i:]}{i}" for i in range(12)]
    texts += [shared[:k] + "<M>" + shared[k:] for k in draw.sample(range(6_000), 12)]
    texts += ["".join(draw.choice("<PSM>é") for _ in range(draw.randint(1, 4))) for _ in range(30)]
    texts += ["".join(draw.choice("ab <é漢") for _ in range(draw.randint(1, 900))) for _ in range(40)]
    return texts


def test_against_a_plain_version(spark):
    rows = [(i, t) for i, t in enumerate(awkward_texts())] + [(3, "again"), (3, "again"), (None, "no id at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'g' AS given", "1 AS n", "'k' AS key")
    got = fim.fill_in_middle(df.repartition(2)).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form")))
    assert got.columns == ["doc_id", "text", "given", "key", *fim.RESULTS, "back"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = sorted(((i, t, "g", "k", *plain(i, t), t or "") for i, t in rows), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert {r[5] for r in want} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_are_found_again_where_contents_are():
    draw = random.Random(5)
    passage = "".join(draw.choice("abcdefgh é") for _ in range(30_000)).encode()
    cache = fim.ChunkCache()
    for front in (b"", b"one", b"another beginning " * 9):
        text = front + passage
        ends = fim.chunk_ends(np.frombuffer(text, dtype=np.uint8))
        assert ends[-1] == len(text) and all(a < b for a, b in zip(ends, ends[1:]))
        assert max(b - a for a, b in zip([0, *ends], ends)) <= fim.LONGEST_CHUNK + 3
        assert fim.CutText(text, cache).chars == len(text.decode())
    assert cache.hits > 1.5 * cache.misses


def test_cache_is_bounded():
    cache = fim.ChunkCache(most_bytes=10_000)
    for i in range(2_000):
        assert cache[f"{i:05}é".encode()] == fim.Chunk(6, False, f"{i:05}"[:2].encode(), "é".encode())
        assert cache[f"{i % 3:05}é<S>".encode()].marked
    assert len(cache.young) + len(cache.old) < 100


def test_cuts_by_chunk_sums():
    for text in (t for t in awkward_texts() if t):
        cut = fim.CutText(text.encode(), fim.ChunkCache())
        for k in {0, 1, len(text) // 3, len(text) // 2, len(text) - 1, len(text)}:
            assert cut.place(k) == len(text[:k].encode())


def test_query_equals_sql(spark, sf_dir):
    got = fim.op11_fill_in_middle(spark, sf_dir)
    assert compare("op11", got, connect(sf_dir), fim.ORACLE).startswith("ok (")
    assert {r.form for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert got.where("restored_sha256 IS NULL").count() == 0


def test_shares():
    drawn = [fim.draws(i) for i in range(4_000)]
    assert abs(sum(d[2] % 100 < 90 for d in drawn) / 4_000 - 0.9) < 0.03
    assert sha("") == hashlib.sha256(b"").hexdigest()
