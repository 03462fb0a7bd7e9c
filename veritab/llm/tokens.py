"""Token-id output: documents as ids in blocks of an adaptive context-mixing range coder.

Documents are sorted by doc_id over range partitions. Each task encodes its documents and writes rows of Parquet files, a row holding the
doc_ids and id counts of some documents and the coded blocks of their ids. Blocks are reset and checksummed one by one.
Reading decodes the rows and cuts the ids at the counts. Where a document starts follows from the partitions' totals, one number each.

Defined results: a null text is an empty one; an empty document is its end id alone; null doc_ids come first; rows that share a doc_id
follow each other in the order of their texts' hashes; an empty table gives no rows; a damaged block raises ValueError; only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm import rangecoder, wordtok
from veritab.llm.shared import documents, stored

END = 2
BLOCK_IDS = 2048
#: A row of the files is closed once it has so many ids.
ROW_IDS = 6_000_000
#: Pieces that a worker's table holds, and characters that are looked up at once: more than other operators take, as fewer pieces are encoded and looked up again.
PIECES, BATCH = 600_000, 1 << 22
FILES = "part int, seg int, n_ids long, doc_ids array<long>, sizes array<long>, blocks binary"
READ = "part int, seg int, doc_id long, local long, n_tokens long, ids_crc32 long"


def _encode(path: str | None, end: int, block_ids: int, row_ids: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = wordtok.tokenizer(path or wordtok.default_path(), PIECES)
        part_number, seg = TaskContext.get().partitionId(), 0
        names, sizes, ids, total = [], [], [], 0

        def row() -> pd.DataFrame:
            blocks = rangecoder.encode(np.concatenate(ids), block_ids)
            return pd.DataFrame({"part": [part_number], "seg": [seg], "n_ids": [total], "doc_ids": [names], "sizes": [np.concatenate(sizes)], "blocks": [blocks]})

        for part in parts:
            texts = [x or "" for x in part["text"].tolist()]
            known = [None if pd.isna(x) else int(x) for x in part["doc_id"].tolist()]
            for at in wordtok.batches(texts, BATCH):
                got, n = tok.ids(texts[at], end)
                names, total = names + known[at], total + len(got)
                ids.append(got)
                sizes.append(n)
                if total >= row_ids:
                    yield row()
                    seg += 1
                    names, sizes, ids, total = [], [], [], 0
        if names:
            yield row()

    return run


def encoded(docs: DataFrame, path: str | None = None, end: int = END, block_ids: int = BLOCK_IDS, row_ids: int = ROW_IDS) -> DataFrame:
    """docs (doc_id, text) -> rows of FILES, in ascending doc_id order over (part, seg)."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ("doc_id", "hash", "row")  # so that range partitions can part the rows of one doc_id, even rows that are all alike
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return dealt.mapInPandas(_encode(path, end, block_ids, row_ids), FILES)


def _decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for row in part.itertuples(index=False):
            ids, sizes = rangecoder.decode(row.blocks), np.asarray(row.sizes, np.int64)
            last = np.cumsum(sizes)
            view = memoryview(np.ascontiguousarray(ids)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((last - sizes).tolist(), last.tolist())]
            names = pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], "Int64")
            yield pd.DataFrame({"part": row.part, "seg": row.seg, "doc_id": names, "local": last - sizes, "n_tokens": sizes, "ids_crc32": np.array(crc, np.int64)})


def read_back(files: DataFrame) -> DataFrame:
    """Rows of FILES -> doc_id, start, n_tokens, ids_crc32 of every document, from the decoded ids.

    The windows run over one row per partition, and over the rows of one partition's file.
    """
    sizes = files.select("part", "seg", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.withColumn("_before", F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).drop("_n")
    segs = sizes.withColumn("_in", F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_ids"))
    starts = segs.join(parts, "part").select("part", "seg", (F.col("_before") + F.col("_in")).alias("_start"))
    read = files.select("part", "seg", "doc_ids", "sizes", "blocks").mapInPandas(_decode, READ)
    return read.join(starts, ["part", "seg"]).select("doc_id", (F.col("_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark, sf_dir):
    return read_back(stored(encoded(documents(spark, sf_dir)), "tokens", compression="none"))
