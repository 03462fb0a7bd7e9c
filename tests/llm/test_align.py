"""Alignment of two vocabularies against plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from veritab.llm import align, wordtok


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(wordtok.default_path()), SentencePieceProcessor(model_file=align.piece_path())
    a.encode_special_tokens = True
    byte = align._byte_of()
    entry = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab(with_added_tokens=True).items()}
    piece = {i: bytes.fromhex(b.id_to_piece(i)[3:5]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    return a, b, entry, piece


def groups(text, plain):
    """Lists of A ids and B ids by group."""
    a, b, entry, piece = plain
    if not text:
        return []
    left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)
    raw = (" " + text).encode()
    if b"".join(map(entry.get, left)) != raw or b"".join(map(piece.get, right)) != raw:
        return []
    ends = [dict(zip(np.cumsum([len(of[i]) for i in ids]).tolist(), range(len(ids)))) for ids, of in ((left, entry), (right, piece))]
    out, x, y = [], 0, 0
    for end in sorted(ends[0].keys() & ends[1].keys()):
        out.append((left[x : ends[0][end] + 1], right[y : ends[1][end] + 1]))
        x, y = ends[0][end] + 1, ends[1][end] + 1
    return out


def brute(docs, plain):
    found = [(d, groups(t, plain)) for d, t in docs]
    count = Counter((a[-1], b[-1]) for _, g in found for a, b in g)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for d, g in found:
        pairs = [(a[-1], b[-1]) for a, b in g]
        shown = ";".join("|".join(",".join(map(str, x)) for x in side) for side in g)
        digest = hashlib.sha256(shown.encode()).hexdigest() if g else ""
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), digest))
    return out


def same(got, want):
    names = [c.split()[0] for c in align.RESULT.split(", ")]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(None if x is None or x != x else x for x in r) for r in got[names].itertuples(index=False)), key=key) == sorted(want, key=key)


def test_query(spark, plain):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    same(align.op12_tokenizer_alignment(spark, SMALL).toPandas().astype(object), brute(list(zip(docs.doc_id.tolist(), docs.text)), plain))


def test_odd_rows(spark, plain, odd_docs, no_docs):
    more = spark.createDataFrame([(20 + k, t) for k, t in enumerate([" ", "  two  blanks ", "a▁b", "<s> </s> <unk> <0x41> <|endoftext|>", "\n\nx\n", "\x01 \x00", "ﬁ ｆ é", "x" * 5000, "　 ", ". ,"])], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(more)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = align.alignment(odd_docs.unionByName(more, allowMissingColumns=True).repartition(3)).toPandas().astype(object)
    same(got.where(got.notna(), None), brute(rows, plain))
    assert align.alignment(no_docs).count() == 0
    assert {r.n_groups for r in align.alignment(more.where("doc_id = 22")).collect()} == {0}


def test_cut_texts_equal_whole_ones(plain):
    _, b, _, _ = plain
    own = align.Pieces(align.piece_path())
    assert not own.whole
    rng = np.random.default_rng(8)
    parts = ["a", "The", " ", " ", " ", "\n", "b.", "'s", "1", "é", "\t", "..", "<s>", " of", ", ", ". ", "\U0001f600", "　", "é", "word,"]
    texts = ["".join(rng.choice(parts, int(n))) for n in rng.integers(1, 14, 3000)]
    for at in range(0, len(texts), 50):
        ids, sizes = own.ids(texts[at : at + 50])
        want = [b.encode(x, num_threads=1) for x in texts[at : at + 50]]
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    own.whole = True
    assert own.ids(texts[:9])[0].tolist() == [i for x in texts[:9] for i in b.encode(x, num_threads=1)]


def test_pair_numbers():
    """Vocabularies with equal bytes at several ids, and tokens that are longer on either side."""
    a, b = [b"x", b"yx", b"zyx", b"x", b""], [b"x", b"x", b"yx", b"wzyx", b""]
    pairs = align.Pairs(a, b)
    can = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x))]
    numbers = pairs.numbers(*np.array(can).T)
    assert len(set(numbers.tolist())) == len(can) and numbers.max() < pairs.size
    assert pairs.b_of(numbers).tolist() == [j for _, j in can]


def test_size_of_real_vocabularies():
    own = align.aligner(None, None)
    assert own.pairs.size <= 2 * sum(map(len, own.a.tokens)) + sum(map(len, own.b.tokens)) + 2 * len(own.a.tokens)
