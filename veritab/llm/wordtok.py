"""Token ids of many texts by the tokenizers library, each distinct word encoded once.

A byte-level BPE vocabulary never merges across a blank that a non-blank follows, nor across a line feed between non-blanks, so a text may
be cut before each such blank and on both sides of each such line feed, and its pieces encoded apart. Nor does it merge a letter or digit with
the mark after it, so a mark at a word's end is a piece of its own. Pieces repeat, so a bounded table keeps their ids. A text with a piece
that is empty or starts with white space (two blanks in a row, an empty line, a blank at the end) is encoded whole.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker's table holds; beyond that the half that is used most is kept.
TABLE = 320_000
#: New pieces are encoded in runs of about so many characters.
RUN = 1 << 12
#: Texts are looked up in batches of about so many characters, so that a batch repeats its pieces.
BATCH = 1 << 19
#: A piece that starts with _BARE is a line's first piece or a mark, which has no blank; _LINE is a line feed.
_BARE, _LINE = "\x01", "\n"
#: A mark between a letter or digit and a blank; only letters that every version of Unicode calls so.
_MARK, _APART = r"([A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([.,;:!?]) ", rf"\1 {_BARE}\2 "


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordTokenizer:
    #: Pieces that the table holds.
    most = TABLE

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sentence_end = np.zeros(len(self.bytes_of), bool)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # byte-level: one character a byte
            self.sentence_end[i] = token[-1:] in (".", "!", "?", "\u010a")  # byte-level vocabularies write a line feed as U+010A
        self.clear()

    def sentence_ends(self) -> np.ndarray:
        """By id, whether its token ends a sentence or a line."""
        return self.sentence_end

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size, self.uses = (np.zeros(1 << 18, np.int32) for _ in range(3))

    def _shrink(self) -> None:
        """Keep the pieces that are used most, at most half a table, and only those used again; age their counts."""
        n, pieces = len(self.number), list(self.number)
        often = np.argsort(-self.uses[:n], kind="stable")[: self.most // 2]
        kept = np.sort(often[self.uses[often] > 1])
        size = self.size[kept]
        last = np.cumsum(size)
        flat = self.flat[np.arange(last[-1] if len(last) else 0) + np.repeat(self.start[kept] - last + size, size)]
        uses = self.uses[kept] // 2
        self.clear()
        self.number.update(zip(map(pieces.__getitem__, kept.tolist()), range(len(kept))))
        self._reserve(len(flat), len(kept))
        self.flat[: len(flat)], self.used = flat, len(flat)
        self.start[: len(kept)], self.size[: len(kept)], self.uses[: len(kept)] = last - size, size, uses

    def _reserve(self, ids: int, pieces: int) -> None:
        while ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while pieces > len(self.start):
            self.start, self.size, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.uses))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_heads(self, pieces: list[str]) -> list[list[int]]:
        """Pieces that no blank comes before."""
        return self.encode(pieces)

    def encode_run(self, run: str) -> list[int]:
        """Pieces with a blank before each."""
        return self.encode([run])[0]

    def encode_led(self, texts: list[str]) -> list[list[int]]:
        """Texts with a blank put before each."""
        return self.encode([" " + x for x in texts])

    def _numbers(self, pieces: np.ndarray) -> np.ndarray:
        """The pieces' numbers. New ones are encoded and get the next numbers; one that can't be encoded apart, as it is empty or starts with white space, has -1."""
        numbers = np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            shown = [p[1:2] if p[:1] == _BARE else p[:1] for p in pieces[fresh].tolist()]
            good = fresh[[x != "" and (not x.isspace() or p == _LINE) for x, p in zip(shown, pieces[fresh].tolist())]]
            numbers[good] = np.arange(len(self.number), len(self.number) + len(good))
            new = pieces[good].tolist()
            if new:
                self.number.update(zip(new, numbers[good].tolist()))
                self._learn(new)
        return numbers

    def _learn(self, new: list[str]) -> None:
        """Encode the new pieces, which have the last numbers: those with a blank in long runs, cut where the bytes of the ids reach a piece's end."""
        first = len(self.number) - len(new)
        later = np.fromiter((p[0] != _BARE and p != _LINE for p in new), bool, len(new))
        ids, sizes = [], np.zeros(len(new), np.int64)
        order, run = np.flatnonzero(~later), np.flatnonzero(later)
        heads = self.encode_heads([new[k].lstrip(_BARE) for k in order.tolist()])
        sizes[order] = [len(x) for x in heads]
        ids += [np.array(x, np.uint32) for x in heads]
        pieces = [new[k] for k in run.tolist()]
        width = pc.binary_length(pa.array(pieces, pa.string())).to_numpy().astype(np.int64) + 1  # with the blank
        ends = np.cumsum(width)
        cuts = [0, *(np.flatnonzero(np.diff(ends // RUN)) + 1).tolist(), len(pieces)] if len(pieces) else [0]
        for s, e in zip(cuts[:-1], cuts[1:]):
            got = np.array(self.encode_run(" " + " ".join(pieces[s:e])), np.uint32)
            reach = np.cumsum(self.bytes_of[got])
            last = np.searchsorted(reach, np.cumsum(width[s:e]), side="left") + 1
            ids.append(got)
            sizes[run[s:e]] = np.diff(last, prepend=0)
        place = np.concatenate([order, run])
        total = int(sizes.sum())
        self._reserve(self.used + total, len(self.number))
        if total:
            self.flat[self.used : self.used + total] = np.concatenate(ids)
        at = sizes[place]
        self.start[first + place] = self.used + np.cumsum(at) - at
        self.size[first + place] = at
        self.used += total

    def ids(self, texts: list[str], end: int | None = None, led: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, each text followed by ``end``; and the number of each text's. With ``led``, a blank is put before each text."""
        if len(self.number) > self.most:
            self._shrink()
        given = pa.array(texts, pa.string())
        marked = given if led else pc.binary_join_element_wise(pa.scalar(_BARE), given, pa.scalar(""))
        marked = pc.replace_substring(marked, _LINE, f" {_LINE} {_BARE}")
        marked = pc.replace_substring_regex(marked, _MARK, _APART)
        parts = pc.split_pattern(marked, " ")
        first = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        distinct, indices = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        numbers = self._numbers(distinct)
        apart = numbers >= 0
        odd = pc.match_substring(given, _BARE).to_numpy(zero_copy_only=False)
        if not apart.all():
            odd |= np.minimum.reduceat(apart[indices], first[:-1]) == 0
        self.uses[numbers[apart]] += np.bincount(indices, minlength=len(numbers))[apart]
        n = np.where(apart, self.size[numbers], 0)[indices]
        last = np.cumsum(n)
        flat = self.flat[np.arange(last[-1] if len(last) else 0) + np.repeat(self.start[numbers][indices] - last + n, n)]
        ends = np.concatenate([[0], last])[first].tolist()
        whole = dict(zip(np.flatnonzero(odd).tolist(), (self.encode_led if led else self.encode)([texts[k] for k in np.flatnonzero(odd)])))
        out, sizes = [], np.zeros(len(texts), np.int64)
        tail = [] if end is None else [np.array([end], np.uint32)]
        for k in range(len(texts)):
            ids = np.array(whole[k], np.uint32) if k in whole else flat[ends[k] : ends[k + 1]]
            out += [ids, *tail]
            sizes[k] = len(ids) + len(tail)
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), sizes


def batches(texts: list[str], size: int = BATCH) -> list[slice]:
    """Runs of texts of about ``size`` characters each, so that each holds at least one text."""
    ends = np.cumsum([len(x) for x in texts])
    bounds = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), len(texts)]
    return [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:]) if a < b]


_KEPT: dict[str, WordTokenizer] = {}


def tokenizer(path: str, most: int = TABLE) -> WordTokenizer:
    """A worker's tokenizer for a file, with a table of ``most`` pieces; its table outlives a task."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = WordTokenizer(path)
    _KEPT[path].most = most
    return _KEPT[path]
