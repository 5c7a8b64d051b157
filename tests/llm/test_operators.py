"""Operators against brute force, on planted and awkward rows."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from weightloom.llm import bpe, licenses, media, packing, quality, simhash, suffixes, token_files, urls, warc

MULTI, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix their potions "
TEXTS = [None, "", "a", " \n\n ", PASSAGE * 3, PASSAGE + "tail one", "head two " + PASSAGE, "x" * 500, "x" * 300, "Ünïcödé ß 漢字 " * 20, PASSAGE * 3, "line one\nline one\nother # $\n", "Released Under The MIT License, and cc-by-nc too"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s" if i % 3 else None, len(t or ""), "clash", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_bpe_equals_tiktoken(docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.digests(docs, MULTI, public_tokenizers.PATTERN))
    for i, t in enumerate(TEXTS):
        ids = own.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(empty, MULTI, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_finds_all_and_nothing_else():
    keys = [f"k{i}".encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert [table.find(k) for k in keys] == list(range(3000))
    assert table.find(b"missing") == -1


def test_quality_statistics(docs, empty):
    word, got = regex.compile(r"[^\x20\x09-\x0D]+"), by_id(quality.judge(docs))
    for i, t in enumerate(TEXTS):
        w, places, lines = word.findall(t or ""), defaultdict(list), [x for x in (t or "").split("\n") if word.search(x)]
        for at in range(len(w) - 7):
            places[tuple(w[at : at + 8])].append(at)
        repeat = {k for p in places.values() if len(p) > 1 for at in p for k in range(at, at + 8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeat))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert quality.judge(empty).count() == 0


def test_quality_removes_frequent_lines(spark):
    body = " ".join(f"w{{}}x{i}" for i in range(30))
    rows = [(i, ("Share this page\n" if i < 8 else "") + body.replace("{}", str(i)), "h") for i in range(10)]
    rows += [(99, "Share this page now and here again and again " + "\nshare this  PAGE" * 30, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = by_id(quality.clean(df, min_docs=5, share=0.5))
    assert sorted(kept) == list(range(10))
    assert not any("Share" in r.text for r in kept.values())


@pytest.mark.parametrize("limits", [(4096, 512, 4096), (16, 2, 9)])
def test_packing_keeps_limits_and_every_id(limits):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 40, 60).tolist()
    losses = [rng.integers(0, 2, n) for n in lengths]
    seqs, seen = packing.pack(lengths, losses, *limits), defaultdict(set)
    for seq in seqs:
        assert sum(n for *_, n in seq) <= limits[0] and len(seq) <= limits[1]
        assert sum(losses[i][s : s + n].sum() for i, s, n in seq) <= limits[2]
        for i, s, n in seq:
            assert not seen[i] & set(range(s, s + n))
            seen[i] |= set(range(s, s + n))
    assert all(len(seen[i]) == n for i, n in enumerate(lengths))


def test_token_files_and_packing_hold_the_tokenizers_ids(spark, docs, empty):
    t, start = Tokenizer.from_file(WORDS), 0
    files, pieces = by_id(token_files.read(spark, token_files.write(docs, WORDS))), defaultdict(list)
    for r in packing.pack_texts(docs, WORDS).collect():
        pieces[r.doc_id].append(r)
    for i, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        for p in pieces[i]:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        assert sum(p.length for p in pieces[i]) == len(ids)
    assert token_files.read(spark, token_files.write(empty, WORDS)).count() == packing.pack_texts(empty, WORDS).count() == 0


def test_url_rules(spark):
    given = {"http://A.NET/x": ("a.net", "/x", "net/", "block"), "https://m.example.net/en/1?q": ("m.example.net", "/en/1", "example.net/en/", "allow"), "http://example.com/de/#t": ("example.com", "/de/", "example.com/de/", "block"), "http://net": ("net", "", None, "allow"), "http://badnet/": ("badnet", "/", None, "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow")}
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    for r, want in zip(sorted(urls.judge(df).collect(), key=lambda r: r.page_id), given.values(), strict=True):
        assert (r.host, r.path, r.rule, r.verdict) == want


def test_url_rules_are_mined(spark):
    rows = [(i, f"http://{'spam' if i % 4 == 0 else f'fine{i}'}.example.org/p/{i}") for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(60)], "page_id long, blocked boolean")
    assert {r.page_id for r in urls.judge(df, labels, support=0.1).collect() if r.verdict == "block"} == set(range(0, 80, 4))
    assert {r.verdict for r in urls.judge(df, labels, least=16).collect()} == {"allow"}


def test_url_rules_see_all_tokens(spark):
    """The telling word stands last, behind words that all URLs hold and words of nested folders."""
    deep = "/".join(f"d{i}" for i in range(40))
    rows = [(i, f"http://a.b.c.example.org/{deep}/{'/'.join(f'n{k}' for k in range(i % 40))}/{'spam' if i % 4 == 0 else 'fine'}/{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(160)], "page_id long, blocked boolean")
    assert {r.page_id for r in urls.judge(df, labels).collect() if r.verdict == "block"} == set(range(0, 200, 4))


def test_url_rules_of_wide_urls_are_those_of_fp_growth(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(300):
        words = sorted(rng.choice(9, rng.integers(1, 8), replace=False).tolist())
        rows.append((i, [f"p:{w}" for w in words], bool({1, 2, 3} <= set(words) or {4, 7} <= set(words) or rng.integers(0, 9) == 0)))
    df = spark.createDataFrame(rows, "key long, tokens array<string>, blocked boolean")
    narrow = urls.mine(df)
    monkeypatch.setattr(urls, "WIDE", 0)
    assert urls.mine(df) == narrow and {len(parts) for parts, _ in narrow} >= {2, 3}


def test_url_rules_hold_on_labels_they_were_not_mined_from(spark):
    from pyspark.sql import functions as F

    from weightloom.llm import queries

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labels = {r.page_id: r.blocked for r in urls.html_labels(pages).collect()}
    mined = spark.createDataFrame([(k, v) for k, v in labels.items() if k % 2], "page_id long, blocked boolean")
    held = [r for r in urls.judge(pages, mined, least=4).collect() if r.page_id % 2 == 0 and r.mined is not None]
    assert len(held) >= 30 and sum(labels[r.page_id] for r in held) >= 0.9 * len(held)
    judged = queries.op4_url_filters(spark, "/root/testdata/sf0.1").filter(F.col("mined").isNotNull())
    assert judged.filter("rule is null and verdict = 'block'").count() > 0


def test_urls_without_rows_and_with_clashing_names(spark):
    schema = "page_id long, url string, key string, tokens string, labelled int, blocked string, mined int"
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "http://a.org/fr/" + "x/" * 20_000, "k", "t", 1, "b", 2)] * 2 + [(None, None, *[None] * 5)], schema)
    assert sorted(r.verdict for r in urls.judge(df, spark.createDataFrame([(1, True), (1, False)], "page_id long, blocked boolean")).collect()) == ["allow"] * 3


def test_licenses(docs, empty):
    got = by_id(licenses.digest(docs))
    r = got[12]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (10, 2, 1, 6, "cc-by-nc,mit")
    assert got[0].n_words == got[1].n_words == 0 and got[0].first_word is None and got[4].labels == ""
    n, _, found = licenses.scan("SPDX-License-Identifier: CC-BY-NC-SA-4.0 licensed under the terms of the Mozilla Public License 2.0")
    assert {x[2] for x in found} == {"cc-by-nc-sa", "mpl-2"} and n == 20
    assert len(licenses.signatures()) >= 200 and licenses.digest(empty).count() == 0


@pytest.mark.parametrize("length", [16, 50])
def test_suffixes_equal_brute_force(docs, empty, length):
    first, got = {}, by_id(suffixes.digests(docs, length))
    raws = [(t or "").encode() for t in TEXTS]
    for i, x in enumerate(raws):
        for at in range(len(x) - length + 1):
            first.setdefault(x[at : at + length], i)
    for i, x in enumerate(raws):
        gone = {k for at in range(len(x) - length + 1) if first[x[at : at + length]] < i for k in range(at, at + length)}
        kept = bytes(c for k, c in enumerate(x) if k not in gone)
        n_spans = sum(k - 1 not in gone for k in gone)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(x), len(gone), n_spans, hashlib.sha256(kept).hexdigest())
    assert suffixes.digests(empty, length).count() == 0
    assert suffixes.clean(docs, length).columns == docs.columns


@pytest.mark.parametrize("hot", [1, 3, 1 << 15])
def test_suffixes_over_parts_and_hot_groups(spark, hot):
    rng = np.random.default_rng(hot)
    words = [f"word{i} " for i in range(9)]
    shared = "".join(rng.choice(words, 40))
    texts = ["".join(rng.choice(words, n)) + shared[: rng.integers(0, 200)] + "ab" * int(rng.integers(0, 60)) for n in rng.integers(0, 60, 40)] + [shared] * 6
    rows = [(int(k) if k % 9 else None, t) for k, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    first, last = {}, 1 << 63
    for k, t in rows:
        for at in range(len(t) - 49):
            w = t[at : at + 50]
            first[w] = min(first.get(w, last), last if k is None else k)
    want = []
    for k, t in rows:
        gone = {i for at in range(len(t) - 49) if first[t[at : at + 50]] < (last if k is None else k) for i in range(at, at + 50)}
        want.append((k, len(gone), hashlib.sha256("".join(c for i, c in enumerate(t) if i not in gone).encode()).hexdigest()))
    got = [(r.doc_id, r.n_removed, r.kept_sha256) for r in suffixes.digests(df, 50, hot=hot).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_simhash_links_equal_brute_force(spark, distance):
    rng = np.random.default_rng(distance)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.int64).tolist()
    bits = sorted({c ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for c in centres for k in (0, 1, 2, 3, 4) for _ in range(4)})
    got = simhash.links(spark.createDataFrame(list(enumerate(bits)), "node long, bits long"), distance).collect()
    want = {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if (bits[i] ^ bits[j]).bit_count() <= distance}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_simhash_variants_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    joined = simhash.links(spark.range(1000).select(F.col("id").alias("node"), F.xxhash64("id").alias("bits")))
    assert joined.count() == 0
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_simhash_groups(spark, docs, empty):
    got = by_id(simhash.near_duplicates(docs))
    assert got[0].fingerprint == "0" * 16 and got[1].component_id == got[3].component_id == 0
    assert got[10].component_id == 4 and simhash.near_duplicates(empty).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.label for r in simhash.components(chain).collect()} == {0}


def test_media_is_lossless(docs, empty):
    got = by_id(media.digests(docs))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(want[-64:])
        frames, cut, spans, sound, digest = got[i].feature.split(":")
        _, mel, found, _ = media.features(media.wav(want))
        assert (int(frames), int(cut), int(spans)) == (len(mel), len(media.patches(mel)), len(found))
        assert digest == hashlib.sha256(media.patches(mel).astype(np.float16).tobytes()).hexdigest()[:16]
    assert got[4][1:-1] == got[10][1:-1] and media.digests(empty).count() == 0


def test_patches_are_stored_with_time_spans(spark, docs):
    out = media.store(docs)
    rows = media.featured(spark, out).collect()
    found = defaultdict(list)
    for r in media.read_patches(spark, out, media.featured(spark, out)).collect():
        found[r.key].append(r)
    for r in rows:
        mine = sorted(found[str(r.doc_id)], key=lambda x: x.patch)
        raw = (TEXTS[r.doc_id] or "").encode()
        _, mel, spans, step = media.features(media.wav(media.padded(raw)))
        assert len(mine) == r.patches and [x.patch for x in mine] == list(range(r.patches))
        assert np.array_equal(np.array([x.log_mel for x in mine], np.float32).reshape(-1, media.PATCH, media.MELS), media.patches(mel).astype(np.float16).astype(np.float32))
        assert all(abs(x.end_s - x.start_s - media.PATCH * step) < 1e-9 for x in mine)
        assert [x.sound for x in mine] == [any(a < x.end_s and b > x.start_s for a, b in spans) for x in mine]


def test_log_mel_equals_its_definition():
    x = np.random.default_rng(3).normal(size=1000).astype(np.float32)
    got, bank = media.log_mel(x, 8000), media.filterbank(8000)
    for f in range(len(got)):
        frame = np.zeros(media.FRAME)
        part = x[f * media.HOP : f * media.HOP + media.FRAME]
        frame[: len(part)] = part
        power = np.abs(np.fft.rfft(frame * np.hanning(media.FRAME))) ** 2
        assert np.allclose(got[f], np.log10(power @ bank + 1e-10), atol=1e-3)


@pytest.mark.parametrize("up, down", [(1, 2), (3, 2), (1, 1)])
def test_resampling_keeps_a_tone(up, down):
    t = np.arange(4000) / 8000
    got = media.resample(np.sin(2 * np.pi * 200 * t).astype(np.float32), up, down)
    want = np.sin(2 * np.pi * 200 * np.arange(len(got)) * down / up / 8000)
    assert np.abs(got - want)[200:-200].max() < 0.05


def test_segments_by_hysteresis():
    energy = np.zeros(100)
    energy[10:20], energy[15], energy[40:50] = media.CLOSE + 0.05, 2.0, media.CLOSE + 0.05
    assert media.segments(energy) == [(10, 20)]


def test_warc_round_trip(spark):
    big, other = "b" * 1500, "é" * 800
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://c/", "s"), (4, "x", "s"), (5, "u", None), (6, "v", big), (7, "w", other), (8, "w\r\nX: y", other), (None, "n", big), (None, "n", "only null" * 200), (None, "n2", "only null" * 200), (6, "v", "a second of six")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.write(df, limit=200)
    got = {r.page_id: r for r in warc.read(spark, out).collect()}
    got, all_rows = {r.page_id: r for r in warc.read(spark, out).collect() if r.payload_bytes != 15}, warc.read(spark, out).collect()
    for k, _, html in rows[:8]:
        raw = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {k: r.refers_to for k, r in got.items() if k is not None} == {1: 6, 2: 6, 3: None, 4: None, 5: None, 6: None, 7: 8, 8: None}
    assert {k for k, r in got.items() if r.record_type == "revisit" and k} == {1, 2, 7}
    assert sorted((r.record_type, r.refers_to or 0) for r in all_rows if r.page_id is None) == [("response", 0), ("response", 0), ("revisit", 6)]
    assert len(all_rows) == len(rows) and sum(r.page_id == 6 and r.record_type == "response" for r in all_rows) == 2

    def names(path):
        return sorted(r.name for r in spark.read.parquet(f"{path}/manifest").collect())

    assert names(out) == names(warc.write(df, limit=200))
    assert warc.read(spark, warc.write(df.limit(0))).count() == 0
