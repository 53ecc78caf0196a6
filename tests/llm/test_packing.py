import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.test_token_counts import AWKWARD
from veriscope.llm.packing import (
    TokenIds, cuts, op9_packing, pack_documents, packed, packed_sequences, packing_plan, plan_ranges, token_pieces,
)
from veriscope.llm.token_counts import default_vocabulary
from veriscope.shared import settle


def test_ids_are_the_librarys():
    """Awkward and random texts, and every character between words."""
    tokenizer, ids = Tokenizer.from_file(default_vocabulary()), TokenIds(default_vocabulary())
    draw = random.Random(7)
    characters = [chr(c) for c in range(0x3100) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = [*AWKWARD, *(f"a{c}b {c}{c} 1{c}" for c in characters)]
    for _ in range(300):
        alphabet = draw.choice([characters, "ab \n'st", "the of 12 .,!", "\u00e9\u00df\u00f1 \u00fca"])
        texts.append("".join(draw.choice(alphabet) for _ in range(draw.randrange(90))))
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids(text), dtype="<u4").tolist() == want, repr(text)


def check_layout(rows, capacity):
    """Every sequence gapless from 0 and within its capacity."""
    placed = defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=30))
@settings(max_examples=200, deadline=None)
def test_plan_uses_every_piece_once(counts):
    plan = packing_plan(counts, 40)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 40 and times > 0
        for length in pattern:
            used[length] += times
    assert used == Counter(counts)
    tokens = sum(length * n for length, n in counts.items())
    assert sum(times for _, times in plan) <= 2 * -(-tokens // 40) + 1


def test_exact_complements_are_found():
    assert packing_plan({30: 2, 10: 2}, 40) == [([30, 10], 2)]
    assert packing_plan({30: 1, 7: 1, 3: 1}, 40) == [([30, 7, 3], 1)]
    assert packing_plan({30: 1, 5: 1, 3: 1, 2: 1}, 40) == [([30, 5, 3, 2], 1)]
    assert packing_plan({20: 3}, 40) == [([20, 20], 1), ([20], 1)]
    assert packing_plan({}, 40) == []
    # no exact filling: the longest that fits
    assert packing_plan({30: 1, 9: 1, 8: 1}, 40) == [([30, 9], 1), ([8], 1)]


def test_plan_stays_short_for_many_pieces():
    counts = {length: 10_000_019 * (1 + length % 7) for length in range(1, 2049)}
    plan = packing_plan(counts)
    tokens = sum(length * n for length, n in counts.items())
    assert len(plan) < 3 * 2048
    assert sum(times for _, times in plan) <= 1.001 * tokens / 2048 + 2
    ranges = plan_ranges(plan)
    assert len(ranges) < 4 * len(plan)


def test_cuts():
    assert cuts(1, 4) == [(0, 1)]
    assert cuts(4, 4) == [(0, 4)]
    assert cuts(5, 4) == [(0, 1), (1, 5)]
    assert cuts(8, 4) == [(0, 4), (4, 8)]


def test_small_documents_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "a b c d e f g", 1), (1, "a b c d e f g", 1), (2, None, 2), (3, "", 3), (None, "x", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = pack_documents(df, capacity=4).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == Counter({
        (1, 0, 4): 2, (1, 1, 4): 2, (2, 0, 1): 1, (3, 0, 1): 1, (None, 0, 2): 1})
    assert check_layout(got, 4) == 5
    assert pack_documents(df.limit(0)).count() == 0


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(i, "word " * i) for i in range(1, 20)], "doc_id long, text string")
    pieces = settle(token_pieces(df, 16, with_ids=True))
    result = settle(packed(pieces, 16, ("doc_id", "piece", "ids_crc32")))
    sequences = {r.sequence_id: r.ids for r in packed_sequences(result).collect()}
    for r in result.collect():
        assert sequences[r.sequence_id][r.offset:r.offset + r.length] == r.ids


def test_query_against_library(spark, sf_dir):
    tokenizer = Tokenizer.from_file(default_vocabulary())
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for piece, (start, end) in enumerate(cuts(len(ids), 2048)):
            want[r.doc_id, piece] = (start, end - start, zlib.crc32(ids[start:end].tobytes()))
    got = op9_packing(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    least = -(-sum(length for _, length, _ in want.values()) // 2048)
    assert check_layout(got, 2048) <= least + 1
