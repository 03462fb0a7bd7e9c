"""A corpus pipeline of five stages; each reads what its predecessor kept. The last returns packed pieces.

Defined results: a null text is scored, compared, scanned, mixed and packed as an empty one, and stays null until it is packed; null doc_ids, sources and
languages stay null. Of repeated rows, and of different documents that share a doc_id, near_duplicates keeps one row of each component, ties going to the
smaller text hash. Texts of any length go through whole. An empty table stays empty through all stages. Columns beside those of documents, whatever their names, are
carried to the mixing stage's output; the packing stage reads doc_id and text alone.
"""

from __future__ import annotations

from veritab.llm.credentials import without_secrets
from veritab.llm.mixing import mixed_documents
from veritab.llm.packing import pack
from veritab.llm.quality import good_documents
from veritab.llm.shared import documents, stored
from veritab.llm.simhash import one_of_each


def quality(spark, docs, sf_dir):
    """Documents that the classifier scores under 0.5 go."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each component stays."""
    return one_of_each(docs)


def secrets(spark, docs, sf_dir):
    """Found spans are masked; all documents stay."""
    return without_secrets(docs)


def mixing(spark, docs, sf_dir):
    """Documents are repeated, or left out, as the mix takes them."""
    return mixed_documents(docs)


def packing(spark, docs, sf_dir):
    """Documents become pieces of sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over documents, each written as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
