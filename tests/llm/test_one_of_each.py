"""One row of each component, also where doc_ids repeat or are null."""

from veritab.llm import simhash

A = "the quick brown fox jumps over the lazy dog and runs along the river until night falls on the old town " * 4
B = "a completely different story of ships and sailors who cross an ocean in winter to trade wool for salt " * 4


def kept(spark, rows):
    return sorted(tuple(r) for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).select("doc_id", "text").collect())


def test_texts_that_share_a_doc_id(spark):
    assert kept(spark, [(5, A, 1), (5, B, 2)]) == sorted([(5, A), (5, B)])
    assert kept(spark, [(3, A.upper(), 1), (5, A, 2), (5, B, 3), (5, B, 4)]) == sorted([(3, A.upper()), (5, B)])


def test_near_copies_without_doc_id(spark):
    long = " ".join(f"word{k}" for k in range(900))
    near = next(x for x in (f"{long} more{k}" for k in range(500)) if 0 < (simhash.fingerprint(long) ^ simhash.fingerprint(x)).bit_count() <= 3)
    rows = [(None, long, 1), (None, near, 2), (None, near, 3), (None, B, 4)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert len(got) == 2 and sum(r.text == B for r in got) == 1
    assert kept(spark, [*rows[:3], (9, near, 5)]) == [(9, near)]
