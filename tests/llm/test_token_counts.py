import random
import sys
import unicodedata

import pytest
from tokenizers import Tokenizer

from veriscope.llm.token_counts import PairMerging, default_vocabulary, op4_token_counts, with_token_counts

AWKWARD = [
    "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "\n\n x\t y", "don't we'll I'M", "<|endoftext|>",
    "a<|endoftext|><|endoftext|> b", "x" * 3000, "ab" * 5000 + " c", "日本語 テキスト", "🤦🏼‍♂️ ok", "a\x85b c　d",
    "\x1c\x1d a", "1234567 89", "a­b", "  x", "​​", "naïve café", "...!!!", " ...  ", "\r\n\r\n",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


@pytest.fixture(scope="module")
def merging():
    return PairMerging(default_vocabulary())


def test_awkward_texts(library, merging):
    for text in AWKWARD:
        assert merging.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_random_texts(library, merging):
    draw = random.Random(1)
    some = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    for _ in range(400):
        alphabet = draw.choice([some, "ab \n'st", "the of 12 .,!", "éßñ üa"])
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(60)))
        assert merging.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_every_character(library, merging):
    """Between words, so that the class of the character decides where pieces end."""
    wrong = []
    for code in range(sys.maxunicode):
        c = chr(code)
        if code < 0x3100 and unicodedata.category(c) not in ("Cs", "Cn"):
            text = f"a{c}b {c}{c} 1{c}"
            if merging.count(text) != len(library.encode(text, add_special_tokens=False).ids):
                wrong.append(hex(code))
    assert not wrong


def test_columns_nulls_and_empty_tables(spark):
    rows = [(1, "a b", 5), (2, None, 6), (2, None, 6), (None, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long")
    got = with_token_counts(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=str) == [
        (1, 3, 2, False), (2, 0, 0, False), (2, 0, 0, False), (None, 0, 0, False)]
    assert with_token_counts(df.limit(0)).count() == 0
    assert with_token_counts(df.limit(1), limit=1).first().over_limit


def test_query_equals_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op4_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for row in got:
        n = len(library.encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(texts[row.doc_id].encode()), n, n > 1024)
