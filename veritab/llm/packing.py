"""Packing documents into sequences by order-preserving dynamic programming.

Documents keep the order in which they are read. Each partition is packed by itself, so nothing is shuffled; its ids form one stream, which is
cut into windows of at most ``length`` ids. A cut may fall after a document (free), after a sentence (a small truncation penalty)
or, in long stretches without a sentence end, at regular places (a larger one). The programme minimises padding plus penalties:
least[j] = penalty[j] + min over i of least[i] + length - (at[j] - at[i]), the minimum taken from a monotone queue over
the cuts in reach. A window whose length is a power of two needs no padding; at document ends such windows are tried too.

The stream is cut in blocks; a block's last two windows are left to the next one, so blocks leave no seam.
Defined results: null and empty texts are documents of the end id alone; repeated rows are packed each; null doc_ids stay null; an empty table gives no
pieces; a text of any length is packed whole; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from veritab.llm import wordtok
from veritab.llm.shared import documents

LENGTH = 1024
END = 0
SENTENCE_CUT = 6
FORCED_CUT = 24
#: Stretches without a sentence end get a forced cut every so many ids.
FORCED_EVERY = 128
BLOCK = 1 << 18
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(at: list[int], penalty: list[int], length: int = LENGTH) -> list[int]:
    """Positions where windows end. ``at``: ascending positions that may end a window, at most ``length`` apart from 0 on; the last one does."""
    at, penalty = [0, *at], [0, *penalty]
    least, back, key = [0] * len(at), [0] * len(at), [0] * len(at)
    number = {p: i for i, p in enumerate(at)}
    powers = [1 << t for t in range(length.bit_length() - 1)]
    queue = deque([0])
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0]] < p - length:
            queue.popleft()
        i = queue[0]
        value = key[i] + length - p
        if not penalty[j]:
            for power in powers:
                k = number.get(p - power)
                if k is not None and least[k] < value:
                    value, i = least[k], k
        least[j], back[j] = value + penalty[j], i
        key[j] = least[j] + p
        while queue and key[queue[-1]] >= key[j]:
            queue.pop()
        queue.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


class Packer:
    """Packs one stream of documents. ``sentence_end``: by id, whether a sentence ends after it."""

    def __init__(self, sentence_end: np.ndarray, length: int, first_sequence: int):
        self.sentence_end, self.length, self.sequence = sentence_end, length, first_sequence
        self.names, self.begin, self.total, self.ids = [], np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.uint32)]
        self.size = 0

    def add(self, names: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.names += names
        self.begin = np.concatenate([self.begin, self.size + np.cumsum(sizes) - sizes])
        self.total = np.concatenate([self.total, sizes])
        self.ids.append(ids)
        self.size += len(ids)

    def places(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        penalty = np.zeros(len(ids) + 1, np.int64)
        penalty[1:][self.sentence_end[ids]] = SENTENCE_CUT
        penalty[ends] = -1
        at = np.flatnonzero(penalty)
        gaps = np.diff(at, prepend=0)
        more = [np.arange(p - g + FORCED_EVERY, p, FORCED_EVERY) for p, g in zip(at[gaps > 2 * FORCED_EVERY].tolist(), gaps[gaps > 2 * FORCED_EVERY].tolist())]
        if more:
            more = np.concatenate(more)
            penalty[more] = FORCED_CUT
            at = np.sort(np.concatenate([at, more]))
        return at, np.maximum(penalty[at], 0)

    def flush(self, final: bool) -> pd.DataFrame:
        """The pieces of the windows that are settled; all of them if ``final``."""
        ids = np.ascontiguousarray(np.concatenate(self.ids)).astype("<u4")
        ends = self.begin + self.total
        at, penalty = self.places(ids, ends)
        windows = np.array(cuts(at.tolist(), penalty.tolist(), self.length), np.int64) if len(ids) else np.zeros(0, np.int64)
        if not final:
            windows = windows[:-2]
        stop = int(windows[-1]) if len(windows) else 0
        starts = np.unique(np.concatenate([[0], windows, ends[ends < stop]])) if stop else np.zeros(0, np.int64)
        starts = starts[starts < stop].astype(np.int64)
        lasts = np.append(starts[1:], stop)[: len(starts)]
        doc = np.searchsorted(ends, starts, side="right")
        window = np.searchsorted(windows, starts, side="right")
        offset = starts - np.concatenate([[0], windows])[window]
        view = memoryview(ids).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), lasts.tolist())]
        out = pd.DataFrame({
            "doc_id": pd.array([self.names[k] for k in doc], "Int64"), "start": starts - self.begin[doc], "length": lasts - starts, "ids_crc32": np.array(crc, np.int64),
            "doc_tokens": self.total[doc], "sequence_id": self.sequence + window, "offset": offset,
        })
        self.sequence += len(windows)
        left = int(np.searchsorted(ends, stop, side="right"))
        self.names, self.begin, self.total = self.names[left:], self.begin[left:] - stop, self.total[left:]
        self.ids, self.size = [ids[stop:]], len(ids) - stop
        return out


def _packed(path: str | None, length: int, end: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = wordtok.tokenizer(path or wordtok.default_path())
        packer = Packer(tok.sentence_ends(), length, TaskContext.get().partitionId() << 32)
        for part in parts:
            texts = [x or "" for x in part["text"].tolist()]
            names = [None if pd.isna(x) else int(x) for x in part["doc_id"].tolist()]
            for at in wordtok.batches(texts):
                packer.add(names[at], *tok.ids(texts[at], end))
                if packer.size >= BLOCK:
                    yield packer.flush(False)
        yield packer.flush(True)

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """docs (doc_id, text) -> the pieces of their ids, as PIECE says."""
    return docs.select("doc_id", "text").mapInPandas(_packed(path, length, end), PIECE)


def op8_pack_windows(spark, sf_dir):
    return pack(documents(spark, sf_dir))
