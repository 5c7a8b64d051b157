"""The pipeline's stages against plain versions, each on all that its predecessor kept."""

from collections import defaultdict

import brute
import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(rows):
    """The given documents, a line that many hold, near copies, a long shared passage, nulls, empties, repeats."""
    out = [r.asDict() for r in rows]
    body = " ".join(f"plain{i}" for i in range(120))
    out += [{"doc_id": 10_000 + i, "text": f"read more here\n{body} tail{i} " + " ".join(f"own{i}x{k}" for k in range(60)), "lang": "en", "source": "s", "n_chars": 1} for i in range(9)]
    out += [{"doc_id": 20_000 + i, "text": body + f" end{i}", "lang": "en", "source": "t", "n_chars": 1} for i in range(9)]
    out += [{"doc_id": 30_000, "text": None, "lang": None, "source": None, "n_chars": None}, {"doc_id": 30_001, "text": "", "lang": "", "source": "", "n_chars": 0}]
    return out


def check(spark, docs, rows):
    quality, near, passages, packed = (stage for _, stage in corpus_pipeline.STAGES)
    want = {r["doc_id"]: t for r, t in zip(rows, brute.quality(rows), strict=True) if t is not None}
    found = quality(spark, docs, DATA)
    assert found.columns == docs.columns
    got = {r.doc_id: r.text for r in found.collect()}
    assert got == want
    rows = [r | {"text": want[r["doc_id"]]} for r in rows if r["doc_id"] in want]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    stay = brute.near_copies(rows)
    assert {r.doc_id for r in near(spark, docs, DATA).collect()} == stay
    rows = [r for r in rows if r["doc_id"] in stay]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    want = brute.passages(rows)
    found = passages(spark, docs, DATA)
    assert found.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in found.collect()} == {i: (t, len(t)) for i, t in want.items()}
    t, pieces = Tokenizer.from_file(corpus_pipeline.WORDS), defaultdict(int)
    for r in packed(spark, found, DATA).collect():
        pieces[r.doc_id] += r.length
    assert pieces == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in want.items()}
    return len(want)


def test_stages_equal_plain_versions(spark):
    rows = planted(corpus_pipeline.documents(spark, DATA).collect())
    assert check(spark, spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), rows) > 100


def test_repeated_rows_and_an_empty_table(spark):
    docs = corpus_pipeline.documents(spark, DATA)
    twice = docs.union(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, twice = stage(spark, docs, DATA), stage(spark, twice, DATA)
        assert {r.doc_id: r.text for r in docs.collect()} == {r.doc_id: r.text for r in twice.collect()}
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_run_is_the_stages_one_after_another(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert len({r.doc_id for r in rows}) > 100 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


@pytest.mark.parametrize("clash", ["key", "host", "t", "label", "node", "kept", "frequent", "id", "lines", "_node", "_label", "_first"])
def test_columns_with_names_that_the_stages_use(spark, clash):
    docs = corpus_pipeline.documents(spark, DATA).limit(40).withColumnRenamed("lang", clash)
    want = {r.doc_id: r[clash] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
    assert all(r[clash] == want[r.doc_id] for r in docs.collect())


def test_fingerprints_equal_their_definition(spark):
    from weightloom.llm import simhash

    rows = corpus_pipeline.documents(spark, DATA).collect()
    texts = [r.text for r in rows] + [None, "", " \n", "one", "One two", "A b c", "a b c a b c"]
    for text in texts:
        assert np.int64(simhash.fingerprint(text)).view(np.uint64) == brute.fingerprint(text)
