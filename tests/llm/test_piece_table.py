"""The table of pieces: op10 keeps enough of them that a task's rare words aren't all encoded again, and what a table drops changes no ids."""

import numpy as np

from veritab.llm import tokens, wordtok


def test_more_pieces_than_other_operators_keep_are_encoded_once():
    t = wordtok.tokenizer(wordtok.default_path(), tokens.PIECES)
    t.clear()
    texts = [" ".join(f"w{k}" for k in range(at, at + 1000)) for at in range(0, wordtok.TABLE + 80_000, 1000)]
    first = [t.ids(texts[at], tokens.END)[0] for at in wordtok.batches(texts, tokens.BATCH)]
    encoded, run = [], t.encode_run
    t.encode_run = lambda text: encoded.append(text) or run(text)
    again = [t.ids(texts[at], tokens.END)[0] for at in wordtok.batches(texts, tokens.BATCH)]
    del t.encode_run
    assert not encoded and np.array_equal(np.concatenate(first), np.concatenate(again))


def test_ids_with_a_small_table():
    t = wordtok.WordTokenizer(wordtok.default_path())
    t.most = 40
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in ("ä", "word", "12", "X") for b in ("", "ing", ".", ",", "s'", "\n", "\n\n", "  ", "\x01")]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 30, 400)]
    for at in range(0, len(texts), 20):
        ids, sizes = t.ids(texts[at : at + 20], 2)
        want = [[*x, 2] for x in t.encode(texts[at : at + 20])]
        assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == list(map(len, want))
    assert len(t.number) < 100
