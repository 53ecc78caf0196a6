import hashlib
import random

import numpy as np
import pytest

from tools.check_queries import compare, connect
from veriscope.llm import suffix_dedup as sd


def plain(rows, passage=50):
    """Spans that the rule removes, from all windows of all texts."""
    first = {}
    texts = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - passage + 1):
            w = t[p:p + passage]
            first[w] = min(i, first.get(w, i))
    found = []
    for i, t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - passage + 1):
            if first[t[p:p + passage]] < i:
                gone[p:p + passage] = True
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).reshape(-1, 2)
        found.append(([tuple(map(int, e)) for e in edges], t[:0].join([bytes([b]) for b, g in zip(t, gone) if not g])))
    return found


def made_rows():
    draw = random.Random(2)
    def text(n):
        return "".join(draw.choice("abcdefghij klmno é\n") for _ in range(n))
    passage, other = text(300), text(120)
    rows = [(i, text(draw.randint(0, 400))) for i in range(30)]
    rows += [(30 + i, text(draw.randint(0, 80)) + passage + text(draw.randint(0, 80))) for i in range(40)]
    rows += [(80 + i, text(5) + passage[i:i + 50 + i] + other[:49 + i % 3] + text(9)) for i in range(30)]
    rows += [(120 - i, "ab" * 300 + passage) for i in range(3)] + [(130, "a" * 5_000), (131, "b" + "a" * 1_500 + "c"), (132, "a" * 60 + other + "a" * 49)]
    rows += [(140, None), (141, ""), (142, passage[:49]), (143, passage[:50]), (None, "x" + passage), (None, passage), (None, "y" + passage[3:])]
    rows += [rows[35], (35, other * 2), (20, other), (7, rows[3][1] + other), (200, "é" * 200), (201, "x" + "é" * 120), (202, "\x00" * 100), (203, "\x00" * 90)]
    rows += [(300 + i, rows[40][1]) for i in range(5)] + [(1, text(3_000)), (400, rows[-1][1][100:2_500])]
    return rows


@pytest.mark.parametrize("group_bytes, crowded, held", [(6 << 20, 6_000, 24 << 20), (4_000, 6_000, 2_000), (20_000, 3, 24 << 20), (6 << 20, 0, 500)])
def test_against_all_windows(spark, monkeypatch, group_bytes, crowded, held):
    """One group and many, buckets sent as fragments and by windows, tasks that remember much and little."""
    monkeypatch.setattr(sd, "HELD_BYTES", held)
    rows = made_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'g' AS _given", "1 AS _row", "'s' AS spans", "2 AS begin")
    got = sd.without_repeats(df.repartition(3), group_bytes=group_bytes, crowded=crowded)
    assert got.columns == ["doc_id", "text", "_given", "_row", "begin", *sd.RESULTS]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    found = sorted(((r.doc_id, r.text, [(s.begin, s.end) for s in r.spans], bytes(r.kept), r.n_bytes, r._given, r._row, r.begin)
                    for r in got.collect()), key=key)
    want = sorted(((i, t, spans, kept, len((t or "").encode()), "g", 1, 2) for (i, t), (spans, kept) in zip(rows, plain(rows))), key=key)
    assert found == want


def test_long_texts_are_cut_in_overlapping_slices(spark, monkeypatch):
    monkeypatch.setattr(sd, "SLICE_BYTES", 200)
    rows = made_rows()
    got = sd.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=50_000)
    want = sorted((i is None, i or 0, t or "", spans) for (i, t), (spans, _) in zip(rows, plain(rows)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", [(s.begin, s.end) for s in r.spans]) for r in got.collect()) == want


def test_maximal_repeats_are_all_groups_with_all_occurrences():
    draw = random.Random(4)
    made = ["".join(draw.choice("ab") for _ in range(draw.randint(6, 30))).encode() for _ in range(25)]
    contents, least = list(dict.fromkeys(made)), 6
    docs = np.arange(len(contents))
    want = set()
    strings = {}
    for no, c in enumerate(contents):
        for i in range(len(c)):
            for j in range(i + least, len(c) + 1):
                strings.setdefault(c[i:j], []).append((no, i))
    for string, places in strings.items():
        before = {contents[n][i - 1] if i else 256 for n, i in places}
        after = {contents[n][i + len(string)] if i + len(string) < len(contents[n]) else (256, n, i) for n, i in places}
        if len({n for n, _ in places}) > 1 and (len(before) > 1 or 256 in before) and len(after) > 1:
            want.add((len(string), min(n for n, _ in places), tuple(sorted(places))))
    got = [(length, first, tuple(sorted(places))) for length, first, places in sd.maximal_repeats(contents, docs, least)]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_prefix_intervals():
    ordered = sorted([b"banana", b"anana", b"nana", b"ana", b"na", b"a"])
    leaves = [sd.Shared(97 + (i % 2), i, i) for i in range(6)]
    found = {(length, a, b): (s.before, s.least, s.most) for length, a, b, s in sd.prefix_intervals(ordered, 1, leaves)}
    assert found == {(1, 0, 2): (sd.DIVERSE, 0, 2), (3, 1, 2): (sd.DIVERSE, 1, 2), (2, 4, 5): (sd.DIVERSE, 4, 5)}
    assert sd.common_prefix(b"abc", b"abd") == 2 and sd.common_prefix(b"\x00a", b"\x00a") == 2 and sd.common_prefix(b"", b"a") == 0


def test_later_occurrences_cover_what_all_repeats_cover():
    """Taking each suffix's longest repeat only covers the same bytes."""
    draw = random.Random(8)
    contents = list(dict.fromkeys("".join(draw.choice("ab") for _ in range(draw.randint(5, 40))).encode() for _ in range(60)))
    docs, least = np.array([draw.randint(0, 20) for _ in contents]), 5
    want = set()
    for length, first, places in sd.maximal_repeats(contents, docs, least):
        want |= {(f, p + i) for f, p in places if docs[f] > first for i in range(length)}
    found = [*sd.later_occurrences(contents, docs, least)]
    assert {(f, p + i) for f, p, length in found for i in range(length)} == want and want
    assert len(found) == len({(f, p) for f, p, _ in found})


def test_fragments_cover_every_window_once():
    draw = np.random.default_rng(1)
    sizes = [0, 49, 50, 51, 500, 0, 3_000, 20]
    data = draw.integers(97, 101, sum(sizes)).astype(np.uint8)
    data[700:2_900] = 97
    ends = np.cumsum(sizes)
    at, until, value = sd.cut_fragments(data, ends - sizes, ends, 50)
    covered = [p for a, b in zip(at, until) for p in range(a, b)]
    assert covered == [p for e, n in zip(ends, sizes) for p in range(e - n, e - 49)]
    by_window = {}
    for a, b, v in zip(at, until, value):
        for p in range(a, b):
            assert by_window.setdefault(data[p:p + 50].tobytes(), v) == v
    assert (until - at).max() <= sd.LONGEST_RUN


def test_window_hashes():
    data = np.random.default_rng(3).integers(0, 3, 400).astype(np.uint8)
    for width in (1, 2, 3, 12, 49, 50, 64, 400, 401):
        found = sd.window_hashes(data, width)
        strings = [data[p:p + width].tobytes() for p in range(len(data) - width + 1)]
        some = np.arange(0, len(strings), 3)
        assert (sd.hashes_at(data, some, width) == found[some]).all()
        assert len(found) == len(strings) and len(set(zip(found.tolist(), strings))) == len(set(strings)) == len(set(found.tolist()))


def test_empty_table(spark):
    assert sd.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_sql(spark, sf_dir):
    got = sd.op13_suffix_dedup(spark, sf_dir)
    assert compare("op13", got, connect(sf_dir), sd.ORACLE).startswith("ok (")
    assert got.where(f"kept_sha256 = '{hashlib.sha256(b'').hexdigest()}'").count() > 0
