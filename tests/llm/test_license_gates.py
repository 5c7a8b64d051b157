"""Gated and ungated scans agree on each alternative of each signature."""

import itertools
import re._constants as sre
import re._parser as parser

from weightloom.llm import licenses


def strings(parsed):
    """All strings of a regex of literals, sets, branches and optional parts."""
    parts = []
    for op, arg in parsed:
        if op is sre.LITERAL:
            parts.append([chr(arg)])
        elif op is sre.IN:
            parts.append(["3"] if arg[0][0] is sre.CATEGORY else [chr(x) for k, x in arg if k is sre.LITERAL])
        elif op is sre.BRANCH:
            parts.append([x for branch in arg[1] for x in strings(branch)])
        elif op is sre.SUBPATTERN:
            parts.append(strings(arg[3]))
        elif op is sre.MAX_REPEAT and arg[:2] == (0, 1):
            parts.append(["", *strings(arg[2])])
        else:
            raise ValueError(op)
    return ["".join(x) for x in itertools.product(*parts)]


def test_gates_are_implied_by_the_names():
    for label, words, name in licenses.NAMES:
        for x in strings(parser.parse(name)):
            assert any(word in x for word in words.split("|")), (label, x)


def test_gated_and_ungated_scans_agree():
    for form, _ in licenses.FORMS:
        for label, _, name in licenses.NAMES:
            for x in strings(parser.parse(name)):
                text = form.format(x).replace("(?:the )?", "").replace("(?:terms of )?", "").replace("(?: license)?", "").replace("(?: is)?", "").replace("licen[cs]e", "licence")
                for notice in strings(parser.parse(text)):
                    got = licenses.scan(notice)
                    assert got[2] and got == licenses.scan(notice, gated=False), (label, notice)


def test_notices_that_were_dropped():
    def labels(text):
        return {x[2] for x in licenses.scan(text)[2]}

    assert labels("SPDX-License-Identifier: AGPL-3.0") == {"agpl-3"}
    assert labels("licensed under the Expat license") == {"mit"}
    assert labels("licensed under Creative Commons Attribution-Non-Commercial") == {"cc-by-nc"}


def test_passages_are_gated_by_what_they_always_hold():
    for label, text, _ in licenses.TEXTS:
        word = licenses.required(text)
        assert len(word) >= 8, (label, text)
    assert len(licenses.signatures()) >= 390


def samples(pattern):
    """A string for each passage: first branches, options left out, repeats by their least number of a word."""
    out = ""
    for op, arg in parser.parse(pattern) if isinstance(pattern, str) else pattern:
        if op is sre.LITERAL:
            out += chr(arg)
        elif op is sre.IN:
            out += chr(arg[0][1])
        elif op is sre.BRANCH:
            out += samples(arg[1][0])
        elif op is sre.SUBPATTERN:
            out += samples(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            out += "any name"[: arg[1]] if arg[2][0][0] is sre.ANY else samples(arg[2]) * arg[0]
    return out


def test_every_passage_is_found_gated_and_ungated():
    for label, text, _ in licenses.TEXTS:
        notice = f"// header: {samples(text)}, and more."
        got = licenses.scan(notice)
        assert got == licenses.scan(notice, gated=False) and got[2], (label, notice)


def test_nested_detections_are_suppressed_at_any_distance():
    inner = [(2, -4, a, a + 4, "in", 0.5) for a in range(5, 3900, 37)]
    got = licenses.suppress(sorted([(1, -4000, 0, 4000, "out", 1.0), (1, -8, 10, 18, "in", 1.0), *inner, (3, -10, 3995, 4005, "over", 0.1)]))
    assert [x[2] for x in got] == ["out", "over"]


def brute(hits):
    taken = []
    for _, _, a, b, label, score in sorted(hits):
        if not any(x <= a and b <= y for x, y, *_ in taken):
            taken.append((a, b, label, score))
    return sorted(taken)


def test_suppression_equals_brute_force():
    import random

    for seed in range(200):
        rng, hits = random.Random(seed), []
        for i in range(30):
            a, n = rng.randrange(60), rng.randrange(1, 25)
            hits.append((rng.randrange(4), -n, a, a + n, str(i), 0.5))
        assert licenses.suppress(sorted(hits)) == brute(hits)


def test_base_places_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    words = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "UNDER", "é", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "under the mit license " * 3000]
    for text in texts:
        found = [w.lower() for w in licenses._WORDS((text or "").lower())]
        want = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split())
        assert licenses.scan(text)[:2] == (len(found), want)
