"""Ids are those of a plain tokenizer, the special token included."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from veritab.llm import packing, tokens, wordtok


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(wordtok.default_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_special_token_is_one_id(plain):
    t = wordtok.WordTokenizer(wordtok.default_path())
    ids, sizes = t.ids(["some text <|endoftext|> more"])
    assert ids.tolist() == plain("some text <|endoftext|> more") == [11246, 2420, 220, 50256, 517] and sizes.tolist() == [5]


def test_pieces_equal_plain_whole_texts(plain):
    t = wordtok.WordTokenizer(wordtok.default_path())
    rng = np.random.default_rng(8)
    parts = ["a", "B", " ", " ", " ", "\n", "b.", "'s", "1", "é", "\t", "..", "<|endoftext|>", "<|endoftext|>", " <|endoftext|> ", "<|endoftext", "|>", ", ", ". "]
    texts = ["".join(rng.choice(parts, int(n))) for n in rng.integers(0, 12, 3000)]
    for at in range(0, len(texts), 50):
        ids, sizes = t.ids(texts[at : at + 50], 7)
        want = [[*plain(x), 7] for x in texts[at : at + 50]]
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_operators_count_plain_ids(spark, plain):
    rows = spark.createDataFrame([(1, "some text <|endoftext|> more"), (2, "<|endoftext|><|endoftext|>"), (3, "x")], "doc_id long, text string")
    want = {r.doc_id: len(plain(r.text)) + 1 for r in rows.collect()}
    got = packing.pack(rows).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == want
    back = tokens.read_back(tokens.encoded(rows)).orderBy("doc_id").collect()
    assert [(r.start, r.n_tokens) for r in back] == [(0, want[1]), (want[1], want[2]), (want[1] + want[2], want[3])]
