"""Token ids, token files and packing against the library and brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weightloom.llm import packing, subwords, token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "B", "é", "é", "́", " ", "\n", "\t", "\x0b", "\x1c", "\x1e", "\x1f", "\x00", "\x85", "\xa0", " ", "　", "'s", "'", "Σ", "ς", "İ", "ı", "ß", "ſ", "漢", "1", "٣", "²", "µ", "<|endoftext|>", "<|ENDOFTEXT|>", "!!", "​", "한", "\r\n", "I'll", "</w>", "<", ">", "Word", "ing"]


def test_encoder_equals_the_library():
    rng, e, t = random.Random(7), subwords.Encoder(subwords.prepared(WORDS)), Tokenizer.from_file(WORDS)
    assert e.merged is not None and e.kind == np.dtype("<u2")
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(12))) for _ in range(8000)]
    texts += ["".join(chr(rng.randrange(33, 384)) for _ in range(30)) for _ in range(3000)]
    texts += ["x" * 70_000, "ab" * 40_000 + " end", ""]
    for text in texts:
        assert np.frombuffer(e.packed(text, None), e.kind).tolist() == t.encode(text, add_special_tokens=False).ids, text[:80]


def test_other_files_go_through_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    e, t = subwords.Encoder(subwords.prepared(path)), Tokenizer.from_file(path)
    assert e.merged is None
    assert np.frombuffer(e.packed(" two  words\n", None), e.kind).tolist() == t.encode(" two  words\n", add_special_tokens=False).ids


def test_token_files_keep_keys_and_roll(spark):
    rows = [(-5, "negative"), (None, "null key"), (None, None), (-1, "minus one"), (0, ""), (7, "tie b"), (7, "tie a"), (7, "tie a"), (2**62, "large " * 2000), (-(2**63), "least")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = token_files.write(df, WORDS, file_bytes=8)
    assert len(token_files.files(spark, out)) > 4
    got = sorted(token_files.read(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -(2**63), -5, -1, 0, 7, 7, 7, 2**62]
    t = Tokenizer.from_file(WORDS)
    want = defaultdict(list)
    for k, text in rows:
        want[k].append(zlib.crc32(np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()))
    found, at = defaultdict(list), 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        found[r.doc_id].append(r.ids_crc32)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_packing_is_gapless_padded_only_at_the_end_and_covers_each_id(spark):
    rng, t = random.Random(2), Tokenizer.from_file(WORDS)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma,"]) for _ in range(rng.choice([0, 3, 40, 900])))) for i in range(120)] + [(5, None), (5, "same key"), (None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    pieces, seqs, docs = packing.pack_texts(df, WORDS, tokens=256, with_ids=True).collect(), defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append(p)
        docs[p.doc_id].append(p)
        assert len(p.ids) == 4 * p.length and zlib.crc32(bytes(p.ids)) == p.ids_crc32 and p.loss_tokens == p.length
    for seq in seqs.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256 and at & (at - 1) == 0
    assert sum(sum(p.length for p in s) < 256 for s in seqs.values()) <= 4 * 8
    for k, text in rows[:120]:
        if k != 5:
            ids = [*t.encode(text, add_special_tokens=False).ids, 2]
            cover = [x for p in sorted(docs[k], key=lambda p: p.start) for x in np.frombuffer(p.ids, "<u4").tolist()]
            assert cover == ids and {p.doc_tokens for p in docs[k]} == {len(ids)}
    assert docs[None] and sum(p.start == 0 for p in docs[5]) == 3


@pytest.mark.parametrize("limits", [(512, 64, 512), (512, 64, 60), (512, 3, 512)])
def test_examples_stay_whole_and_each_limit_binds(spark, limits):
    conversations = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    from pyspark.sql import functions as F

    turns = F.sort_array(F.collect_list(F.struct("turn", "text", (F.col("role") == "assistant").alias("loss"))))
    examples = conversations.groupBy("conv_id").agg(F.transform(turns, lambda x: F.struct(x["text"], x["loss"])).alias("parts"))
    odd = spark.createDataFrame([(-1, None), (-2, [(None, None)]), (-3, [])], "conv_id long, parts array<struct<text:string,loss:boolean>>")
    examples = examples.unionByName(odd)
    got = packing.pack_examples(examples, WORDS, *limits).collect()
    seqs, docs = defaultdict(list), defaultdict(list)
    for p in got:
        seqs[p.sequence_id].append(p)
        docs[p.conv_id].append(p)
    for seq in seqs.values():
        assert sum(p.length for p in seq) <= limits[0] and len(seq) <= limits[1] and sum(p.loss_tokens for p in seq) <= limits[2]
    assert set(docs) == {r.conv_id for r in examples.collect()} and {docs[k][0].length for k in (-1, -2, -3)} == {1}
    assert all(len(d) == 1 for d in docs.values() if d[0].doc_tokens <= limits[0] and sum(p.loss_tokens for p in d) <= limits[2])
    assert any(0 < p.loss_tokens < p.length for p in got)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, parts array<struct<text:string,loss:boolean>>")
    assert packing.pack_examples(empty, WORDS, key="doc_id").count() == 0
    assert token_files.read(spark, token_files.write(empty, WORDS)).count() == 0
