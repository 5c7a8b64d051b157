"""The pipeline's near-dedup against all pairs, on planted near copies that differ in many fingerprint bits."""

import random

import corpus_pipeline
import pytest
from weightloom.llm import jaccard, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], SCHEMA)


def expected(texts):
    """Ids that stay: the smallest of each group linked by a similarity of 0.8, by comparing all pairs."""
    def five(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets, first = {i: five(t) for i, t in texts}, {i: i for i, _ in texts}
    for _ in texts:
        for a in sets:
            for b in sets:
                if first[a] < first[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    first[b] = first[a]
    return {i for i in first if first[i] == i}


def planted():
    rng, texts = random.Random(5), []
    for g in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(200)]
        for k in range(7):
            copy = list(words)
            for at in rng.sample(range(200), k):
                copy[at] = f"x{rng.randrange(4000)}"
            texts.append((g * 10 + k, " ".join(copy)))
    return texts


def test_finds_all_pairs_of_similarity_080(spark):
    texts = planted()
    bits = [simhash.fingerprint(t, 5) for _, t in texts]
    far = [(bits[g * 7] ^ bits[g * 7 + k]).bit_count() for g in range(12) for k in range(1, 5)]
    assert max(far) > 3
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, table(spark, texts), "").collect()}
    assert got == expected(texts)


def test_a_large_group_is_one(spark):
    rng, words = random.Random(6), [f"w{i}" for i in range(200)]
    texts = []
    for i in range(150):
        copy = list(words)
        copy[rng.randrange(200)] = f"x{i}"
        copy[rng.randrange(200)] = f"y{i}"
        texts.append((i, " ".join(copy)))
    assert [r.doc_id for r in jaccard.representatives(table(spark, texts)).collect()] == [0]


def test_rows_without_an_id(spark):
    words = [[f"{g}w{i}" for i in range(60)] for g in "abc"]
    texts = [(None, " ".join(words[0])), (None, " ".join(words[0])), (None, " ".join([*words[0], "end"])), (None, " ".join(words[1])), (4, " ".join([*words[1], "end"])), (None, " ".join(words[2]))]
    got = [(r.doc_id, r.text.split()[0]) for r in corpus_pipeline.near_dedup(spark, table(spark, texts), "").collect()]
    assert sorted(got, key=str) == [(4, "bw0"), (None, "aw0"), (None, "cw0")]


def test_variants_of_fingerprints_find_near_copies(spark, monkeypatch):
    """Without keys of minimum hashes, fingerprints find copies within three bits; the similarity still decides."""
    rng, texts = random.Random(7), []
    for g in range(8):
        words = [f"w{rng.randrange(4000)}" for _ in range(400)]
        texts += [(g * 10, " ".join(words)), (g * 10 + 1, " ".join([*words, "end"])), (g * 10 + 2, " ".join([*words, "another", "end"]))]
    texts += [(90, "a b c d e f"), (91, "A B C D E F"), (92, ""), (93, " ")]
    # The same shingle over and over has its fingerprint, but the sets are far from alike.
    texts += [(94, "z " * 300), (95, "z " * 300 + " ".join(f"v{i}" for i in range(40)))]
    assert simhash.fingerprint(texts[-1][1], 5) == simhash.fingerprint(texts[-2][1], 5)
    real = jaccard.by_bands
    monkeypatch.setattr(jaccard, "by_bands", lambda texts: real(texts).limit(0))
    bits = {i: simhash.fingerprint(t, 5) for i, t in texts}
    close = {i + k for i in range(0, 80, 10) for k in (1, 2) if (bits[i] ^ bits[i + k]).bit_count() <= 3}
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, table(spark, texts), "").collect()}
    assert len(close) >= 8 and not got & (close | {91, 93}) and {90, 92, 94, 95} <= got


def sets_of(spark, sets):
    return spark.createDataFrame([(i, i, list(x)) for i, x in enumerate(sets)], "id long, label long, found array<bigint>")


@pytest.mark.parametrize(("similarity", "held"), [(0.5, 256), (0.8, 256), (0.8, 2), (1.0, 256)])
def test_prefixes_meet_all_pairs(spark, monkeypatch, similarity, held):
    monkeypatch.setattr(jaccard, "HELD", held)
    rng, sets = random.Random(9), []
    for _ in range(40):
        base = rng.sample(range(300), rng.randrange(1, 40))
        for k in range(4):
            sets.append(set(rng.sample(base, max(1, len(base) - rng.randrange(k + 1)))) | set(rng.sample(range(300), rng.randrange(k + 1))))
    got = {(r.a, r.b) for r in jaccard.prefixed(sets_of(spark, sets), similarity).collect()}
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}
    assert len(alike) >= 10 and alike <= got


def test_texts_with_a_frequent_passage_are_not_compared_in_pairs(spark):
    sets = [{*range(80), *range(1000 * i, 1000 * i + 30)} for i in range(1, 200)]
    assert jaccard.prefixed(sets_of(spark, sets), 0.8).count() == 0
    # A similarity of 0.7 by hashes that are all shared with others.
    rng, sets = random.Random(11), []
    for i in range(100):
        sets.append({*range(90), *rng.sample(range(1000, 1400), 20)})
    assert jaccard.prefixed(sets_of(spark, sets), 0.8).count() < 100


def test_a_frequent_passage_among_near_copies(spark):
    """Unlike texts around a passage, some with a near copy that isn't a leader's."""
    rng, texts = random.Random(10), []
    passage = [f"p{i}" for i in range(100)]
    for g in range(60):
        words = [f"{g}w{i}" for i in range(40)]
        texts.append((g * 10, " ".join([*passage, *words])))
        if g % 3 == 0:
            texts.append((g * 10 + 1, " ".join([*passage, *words[:-1], f"x{g}"])))
    rng.shuffle(texts)
    got = {r.doc_id for r in jaccard.representatives(table(spark, texts)).collect()}
    assert got == expected(texts) == set(range(0, 600, 10))
