import random
import re
from collections import Counter

import numpy as np
import pytest

from tools.check_queries import compare, connect
from veriscope.llm import collocations as co
from veriscope.llm.quotient_filters import Filter, Packing

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, kept=2000, most=5, percent=100):
    """As the rules are stated."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in range(1, most + 1):
                counts.update((lang, tuple(ws[i:i + k])) for i in range(len(ws) - k + 1))
    frequent = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    gone = set()
    for (lang, longer), f in frequent.items():
        for n in range(2, len(longer)):
            for i in range(len(longer) - n + 1):
                if 100 * f >= percent * counts[lang, longer[i:i + n]]:
                    gone.add((lang, longer[i:i + n]))
    found = []
    for (lang, g), a in frequent.items():
        if (lang, g) not in gone:
            n = totals[lang]
            score, _, l, r = min((1000 * a * n // (counts[lang, g[:k]] * counts[lang, g[k:]]), k, counts[lang, g[:k]], counts[lang, g[k:]])
                                 for k in range(1, len(g)))
            found.append((lang, -score, -a, " ".join(g).encode(), l, r, n))
    ranked, result = Counter(), []
    for lang, score, a, phrase, l, r, n in sorted(found):
        ranked[lang] += 1
        if ranked[lang] <= kept:
            result.append((lang, ranked[lang], phrase.decode(), -a, l, r, n, -score))
    return sorted(result)


def made_rows():
    draw = random.Random(6)
    vocabulary = ["New", "york", "CITY", "hall", "of", "the", "a", "é", "ß\x00x", "Étude", "in", "und"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(400):
        ws = [draw.choice(vocabulary[:12] if draw.random() < 0.7 else vocabulary) for _ in range(draw.randint(0, 40))]
        if draw.random() < 0.5:
            ws += ["New", "York", "City", "Hall"] + (["of", "the"] if i % 3 else [])
        seps = [draw.choice([" ", " ", "  ", "\t", ", ", ".\n", " ! ", "\r"]) for _ in ws]
        rows.append((draw.choice(["en", "en", "de", None, "und"]), "".join(w + s for w, s in zip(ws, seps))))
    return rows + [("en", None), ("fr", "alone"), ("en", ""), (None, " \t "), ("xx", "ha " * 3_000), ("xx", "ha, " * 50), ("xx", "ho ho " * 90)] + rows[:3]


@pytest.mark.parametrize("how", [{}, {"lookup": False}, {"small": True}])
def test_against_plain_counts(spark, monkeypatch, how):
    """By dictionary and by join; with filters, ranges and word counts passed on early."""
    rows = made_rows()
    if how.pop("small", False):
        for name, value in (("COUNTED_PHRASES", 50), ("RANGE_KEYS", 400), ("COUNTED_WORDS", 5), ("SEGMENT_WORDS", 7)):
            monkeypatch.setattr(co, name, value)
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS ids", "2 AS a").repartition(3)
    for least, kept, percent in ((20, 2000, 100), (8, 5, 60)):
        got = sorted(map(tuple, co.collocations(df, kept=kept, percent=percent, least=least, **how).collect()))
        want = plain(rows, least, kept, percent=percent)
        assert got == want and want
        assert {r[0] for r in want} >= {"en", "und", "xx"}


def test_segments_of_joined_texts(spark):
    rows = made_rows()
    df = co._spoken(spark.createDataFrame(rows, "lang string, text string"), "text", "lang")
    words = co.numbered_words(co.word_counts(df).where("word IS NOT NULL"))
    assert sorted(r.id for r in words.collect()) == list(range(1, words.count() + 1))
    bits = words.count().bit_length()
    by_join = co.frequent_phrases(co.joined_up(df, words, 4, segment=7), 3, bits, 0, 5, None)
    by_lookup = co.frequent_phrases(co.looked_up(df, words), 3, bits, 2, 5, None)
    assert sorted((tuple(r.ids), r.a) for r in by_join.collect()) == sorted((tuple(r.ids), r.a) for r in by_lookup.collect()) != []


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert co.collocations(spark.createDataFrame([("en", "one two")], "lang string, text string")).count() == 0


def test_scores_pass_64_bits(spark):
    cases = [(10**15, 9 * 10**15, 10**15, 3 * 10**15), (7, 10**12 + 1, 3, 11), (100, 101, 100, 100), (10**17, 10**17, 10**17, 10**17 - 1)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long")
    got = df.select("a", "n", "l", "r", co.cut_score(*(co.F.col(c) for c in "anlr")).alias("s")).collect()
    assert [r.s for r in got] == [1000 * a * n // (left * r) for a, n, left, r in cases]


@pytest.mark.parametrize("words, bits", [(2, 1), (2, 7), (3, 13), (5, 12), (4, 16), (5, 13), (5, 25), (3, 25), (2, 25), (4, 25)])
def test_filters_lose_nothing(words, bits):
    draw = np.random.default_rng(words * 100 + bits)
    packing = Packing(words, bits)
    columns = [draw.integers(0, 1 << bits, 5_000) % (1 << int(draw.integers(1, bits + 1))) for _ in range(words)]
    wanted = Counter(zip(*(c.tolist() for c in columns)))
    keys = packing.permuted(*packing.packed(columns))
    for half, width in zip(keys, (packing.left_bits, packing.right_bits)):
        assert int(half.max()) < 1 << width
    for range_bits in {0, min(3, packing.left_bits)}:
        filters = Filter(packing, range_bits)
        blobs = []
        for part in np.array_split(np.arange(5_000), 3):
            ones = np.full(len(part), 100, dtype=np.int64)
            blobs += filters.split(*packing.ordered(keys[0][part], keys[1][part], ones))
        found = Counter()
        for no in {b[0] for b in blobs}:
            parts = [filters.decoded(b, no) for n, b in blobs if n == no]
            left, right, counts = packing.ordered(*(np.concatenate(c) for c in zip(*parts)), merging=True)
            for row, n in zip(zip(*(c.tolist() for c in packing.unpacked(*packing.restored(left, right)))), counts.tolist()):
                assert row not in found
                found[row] = n // 100
        assert found == wanted


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = co.op12_collocations(spark, sf_dir)
    assert compare("op12", got, connect(sf_dir), co.ORACLE).startswith("ok (")
    assert got.count() > 0
