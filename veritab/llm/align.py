"""Cross-tokenizer alignment: where the tokens of two vocabularies end together.

The texts of an Arrow batch are concatenated, and so are their tokens; one count of A's and of B's ends by byte offset shows where both end, and
sums up to there give each document's share. Two tokens that end together are a link. One of them ends with the other's bytes, so the pairs that can
ever link are numbered by the longer token and the length of the shorter: at most about twice the bytes of both vocabularies, however large the corpus.
Links are kept as such numbers in a written table; counting them takes an array of that size a task, and so does looking the counts up.

Defined results: a text that is null, empty, or whose tokens' bytes are not those of a blank and the text has no tokens, zeros and an empty
``groups_sha256``; strings of special tokens are plain text; repeated rows count each; a text of any length is taken whole; null doc_ids stay; only
doc_id and text are read, so other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm import wordtok
from veritab.llm.shared import documents, stored

#: What pieces write a blank as; as that is read back as a blank, no text that holds it comes back.
BLANK = "▁"
#: Pieces that a table holds before it is cut down; a worker has two tables.
PIECES_MOST = 180_000
#: Links that are looked up at a time.
LOOKED_UP = 1 << 20
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _byte_of() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class ByteLevel(wordtok.WordTokenizer):
    """A byte-level vocabulary; strings of special tokens are plain text. ``tokens``: bytes by id."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        byte, self.tokens = _byte_of(), [b""] * len(self.bytes_of)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.tokens[i] = bytes(map(byte.__getitem__, token))

    def ids(self, texts, end=None, led=False):
        if len(self.number) > PIECES_MOST:
            self._shrink()
        return super().ids(texts, end, led)


class Pieces(wordtok.WordTokenizer):
    """A piece vocabulary with byte fallback, whose library puts a blank before each text.

    No piece of it reaches over a place where texts are cut, or else texts are encoded whole.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        n, own = self.library.get_piece_size(), self.library
        names = [own.id_to_piece(i).replace(BLANK, " ") for i in range(n)]
        self.tokens = [bytes([int(x[3:5], 16)]) if own.is_byte(i) else x.encode() for i, x in enumerate(names)]
        self.bytes_of = np.array([len(x) for x in self.tokens], np.int64)
        over = regex.compile(r"[^ ] |.\n|\n.|[A-Za-z0-9À-ÿ][.,;:!?]", regex.DOTALL)
        self.whole = any(over.search(x) for i, x in enumerate(names) if not own.is_byte(i)) or not self.keeps_characters()
        self.clear()

    def keeps_characters(self) -> bool:
        """Whether the library leaves every character and run of blanks as it is, and a line feed is a token of its own."""
        every = "".join(map(chr, (*range(1, 0xD800), *range(0xE000, 0x110000)))) + " e\u0301  e "
        return self.library.normalize(every).replace(BLANK, " ").lstrip() == every.replace(BLANK, " ").lstrip() and len(self.library.encode("\n")) == 2

    def encode_heads(self, pieces):
        return [x[2:] for x in self.library.encode(["\n" + p for p in pieces], num_threads=1)]  # without the library's blank and the line feed

    def encode_run(self, run):
        return self.library.encode(run[1:], num_threads=1)

    def encode_led(self, texts):
        return self.library.encode(texts, num_threads=1)

    def ids(self, texts, end=None, led=True):
        if end is not None or not led:
            raise ValueError("texts have a blank before them and no end id")
        if not self.whole:
            if len(self.number) > PIECES_MOST:
                self._shrink()
            return super().ids(texts, led=True)
        got = self.encode_led(texts)
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(x, np.uint32) for x in got)]), np.array([len(x) for x in got], np.int64)


def _variants(tokens: list[bytes]) -> np.ndarray:
    """By id, how many smaller ids have the same bytes."""
    seen: dict[bytes, int] = defaultdict(int)
    out = np.zeros(len(tokens), np.int64)
    for i, token in enumerate(tokens):
        out[i] = seen[token]
        seen[token] += 1
    return out


class Pairs:
    """Numbers of the pairs of an A and a B token that can end together. ``size``: how many numbers there are."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.a, self.b = a, b
        self.variant_a, self.variant_b = _variants(a), _variants(b)
        self.most_a, self.most_b = int(self.variant_a.max()) + 1, int(self.variant_b.max()) + 1
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (a, b))
        room_a, room_b = (self.length_a + 1) * self.most_b, self.length_b * self.most_a
        self.first_a = np.cumsum(room_a) - room_a
        self.first_b = int(room_a.sum()) + np.cumsum(room_b) - room_b
        self.size = int(room_a.sum() + room_b.sum())

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The longer token's first number, plus the other's length and variant; of equally long ones A's."""
        n_a, n_b = self.length_a[a], self.length_b[b]
        longer_a = self.first_a[a] + n_b * self.most_b + self.variant_b[b]
        return np.where(n_a >= n_b, longer_a, self.first_b[b] + n_a * self.most_a + self.variant_a[a]).astype(np.int32)

    def b_of(self, numbers: np.ndarray) -> np.ndarray:
        """The B ids of pairs."""
        ids = defaultdict(list)
        for i, token in enumerate(self.b):
            ids[token].append(i)
        out, in_a = np.empty(len(numbers), np.int64), numbers < self.first_b[0]
        out[~in_a] = np.searchsorted(self.first_b, numbers[~in_a], "right") - 1
        longer = np.searchsorted(self.first_a, numbers[in_a], "right") - 1
        rest = numbers[in_a] - self.first_a[longer]
        out[in_a] = [ids[self.a[i][len(self.a[i]) - n :]][v] for i, n, v in zip(longer.tolist(), (rest // self.most_b).tolist(), (rest % self.most_b).tolist())]
        return out


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.pairs = Pairs(self.a.tokens, self.b.tokens)
        if self.pairs.size >= 1 << 31:
            raise ValueError("the vocabularies have too many pairs for 32-bit numbers")
        self.flat = {}
        for side in (self.a, self.b):
            self.flat[side] = np.frombuffer(b"".join(side.tokens), np.uint8), np.cumsum(side.bytes_of) - side.bytes_of
        #: A id and "," or "|" after it, then B id and "," or ";".
        self.shown = [f"{i}{mark}" for i in range(len(self.a.tokens)) for mark in ",|"] + [f"{i}{mark}" for i in range(len(self.b.tokens)) for mark in ",;"]

    def joined(self, side, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, one after another."""
        flat, first = self.flat[side]
        n = side.bytes_of[ids]
        last = np.cumsum(n)
        return flat[np.arange(last[-1] if len(last) else 0) + np.repeat(first[ids] - last + n, n)]

    def tokens(self, texts: list[str]):
        """A's and B's ids and their numbers by text, and the texts' byte counts; what doesn't give the text's bytes back has none."""
        led = pc.binary_join_element_wise(pa.scalar(" "), pa.array(texts, pa.string()), pa.scalar(""))
        n_bytes = pc.binary_length(led).to_numpy().astype(np.int64)
        data = np.frombuffer(led.buffers()[2], np.uint8)
        sides = [(side, *side.ids(texts, led=True)) for side in (self.a, self.b)]
        text = np.arange(len(texts))
        good = np.ones(len(texts), bool)
        for side, ids, n in sides:
            good &= np.bincount(np.repeat(text, n), side.bytes_of[ids], minlength=len(texts)) == n_bytes
        for side, ids, n in sides:
            want, owner = data[np.repeat(good, n_bytes)], np.repeat(text[good], n_bytes[good])
            good[owner[self.joined(side, ids[np.repeat(good, n)]) != want]] = False
        out = [(ids[np.repeat(good, n)], np.where(good, n, 0)) for _, ids, n in sides]
        return *out[0], *out[1], np.where(good, n_bytes, 0)

    def align(self, texts: list[str]):
        """n_a, n_b, n_groups and digest by text, and all links' numbers in the texts' order."""
        a, n_a, b, n_b, n_bytes = self.tokens(texts)
        end_a, end_b, ends = np.cumsum(self.a.bytes_of[a]), np.cumsum(self.b.bytes_of[b]), np.cumsum(n_bytes)
        size = int(n_bytes.sum()) + 1
        both = (np.bincount(end_a, minlength=size) > 0) & (np.bincount(end_b, minlength=size) > 0)
        cuts = np.cumsum(both)  # groups that end up to a byte offset
        n_groups = np.diff(cuts[ends], prepend=0)
        last_a, last_b = both[end_a], both[end_b]
        at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        links = self.pairs.numbers(a[at_a], b[at_b])
        # a group's A tokens come before its B tokens
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.concatenate([[0], at_b + 1])[cuts[end_a] - last_a]] = a.astype(np.int64) * 2 + last_a
        codes[np.arange(len(b)) + np.concatenate([at_a + 1, [0]])[cuts[end_b] - last_b]] = 2 * len(self.a.tokens) + b.astype(np.int64) * 2 + last_b
        stop = np.cumsum(n_a + n_b)
        shown = [self.shown[k] for k in codes.tolist()]
        digests = [hashlib.sha256("".join(shown[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip((stop - n_a - n_b).tolist(), stop.tolist())]
        return n_a, n_b, n_groups, digests, links


_KEPT: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str | None, path_b: str | None) -> Aligner:
    """A worker's aligner; its tables outlive a task."""
    key = path_a or wordtok.default_path(), path_b or piece_path()
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Aligner(*key)
    return _KEPT[key]


def _runs(sizes: np.ndarray, most: int) -> list[slice]:
    """Runs of rows whose sizes add up to about ``most``, a row at least."""
    ends = np.cumsum(sizes, dtype=np.int64)
    bounds = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(ends)]
    return [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:]) if a < b]


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> rows of ALIGNED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            for at in _runs(pc.utf8_length(column).to_numpy(zero_copy_only=False), wordtok.BATCH):
                texts = column[at].to_pylist()
                can = [bool(x) and BLANK not in x for x in texts]
                filled = np.array(can, bool)
                numbers, digests = np.zeros((3, len(filled)), np.int64), np.full(len(filled), "", object)
                links = np.zeros(0, np.int32)
                if filled.any():
                    *got, names, links = own.align([x for x, y in zip(texts, can) if y])
                    numbers[:, filled], digests[filled] = np.array(got), names
                ends = pa.array(np.concatenate([[0], np.cumsum(numbers[2])]), pa.int32())
                columns = [batch.column(0)[at], *(pa.array(x) for x in numbers), pa.array(digests, pa.string()), pa.ListArray.from_arrays(ends, pa.array(links))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about LOOKED_UP links: first row, row after the last, links, and how many links there are up to each row's end."""
    column = batch.column(batch.schema.get_field_index("links"))
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, links = np.concatenate([[0], np.cumsum(sizes)]), column.flatten().to_numpy()
    for at in _runs(sizes, LOOKED_UP):
        s, e = at.start, at.stop
        yield s, e, links[ends[s] : ends[e]], ends[s + 1 : e + 1] - ends[s]


def link_counts(rows: DataFrame, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """By pair, how many links of all rows hold it, and whether that is the most of its B id. Tasks add up their own; no more numbers than pairs reach the driver."""
    size = pairs.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, links, _ in _slices(batch):
                total += np.bincount(links, minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["pair", "n"])

    found = rows.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair, n = found.column("pair").to_numpy().astype(np.int64), found.column("n").to_numpy()
    count, best, b = np.zeros(size, np.int64), np.zeros(size, bool), pairs.b_of(pair)
    most = np.zeros(len(pairs.b), np.int64)
    np.maximum.at(most, b, n)
    count[pair], best[pair] = n, n == most[b]
    return count, best


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> rows of RESULT, a row per document."""
    rows = stored(aligned(docs, path_a, path_b), "aligned", compression="zstd")
    count, best = link_counts(rows, aligner(path_a, path_b).pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e, links, ends in _slices(batch):
                sums = [np.diff(np.concatenate([[0], np.cumsum(x[links], dtype=np.int64)])[ends], prepend=0) for x in (best, count)]
                part = batch.slice(s, e - s)
                n_groups = part.column("n_groups")
                columns = [part.column("doc_id"), part.column("n_a"), part.column("n_b"), n_groups, n_groups, *(pa.array(x) for x in sums), part.column("groups_sha256")]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(run, RESULT)


def op12_tokenizer_alignment(spark, sf_dir):
    return alignment(documents(spark, sf_dir))
