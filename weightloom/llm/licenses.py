"""License scans by ordered signature rules.

A text is lower-cased and cut into words, which are joined by single spaces. Signatures are regexes over that form: TEXTS
are passages of licence bodies, headers and file notices, NAMES in FORMS are notices that name a licence. Each is gated
by keywords of which every match holds one (for a passage: the longest string that its regex always contains); all
keywords are looked for in one pass, and a signature runs only where one of its own occurs. Detections are intervals of
words. They are taken by priority, then length, then place; one that lies inside an interval taken before is suppressed.

Base phrases are found apart from the signatures, at every place, and their labels always stay.

Null and empty texts have no words, no detections and score 0; a very long text is scanned whole. Of detections of one
priority and length the first stands before later ones; equal intervals of several signatures go to the first signature.
Repeated rows are scanned alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weightloom.llm.common import ship, slices, spread

_WORDS = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
_UPPER = {c: c + 32 for c in range(65, 91)}

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, keywords (every match of the regex holds one), and regex of the name, in order of priority within a form.
NAMES = [
    ("agpl-3", "affero|agpl", r"(?:gnu )?(?:affero general public license|agpl)(?: v| version)? ?3(?: 0)?"),
    ("lgpl-2.1", "lesser|lgpl", r"(?:gnu )?(?:lesser general public license|lgpl)(?: v|v| version)? ?2 1"),
    ("lgpl-3", "lesser|lgpl", r"(?:gnu )?(?:lesser general public license|lgpl)(?: v| version)? ?3(?: 0)?"),
    ("gpl-2", "general public", r"(?:gnu )?general public license(?: v| version)? ?2(?: 0)?"),
    ("gpl-3", "general public", r"(?:gnu )?general public license(?: v| version)? ?3(?: 0)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?:v| v)?(?: ?[23])?"),
    ("apache-2", "apache", r"apache(?: software)? license(?: v| version)? ?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? license(?: v| version)? ?1 1"),
    ("mpl-2", "mozilla", r"mozilla public license(?: v| version)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: v| version)? ?1 1"),
    ("epl-2", "eclipse", r"eclipse public license(?: v| version)? ?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public license(?: v| version)? ?1(?: 0)?"),
    ("cddl", "common development", r"common development and distribution license"),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("isc", "isc", r"isc"),
    ("mit", "mit|expat", r"(?:mit|expat|x11 mit)"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("bsl-1", "boost", r"boost software license"),
    ("artistic-2", "artistic", r"artistic license(?: v| version)? ?2(?: 0)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: \d 0)?"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: \d 0)?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: \d 0)?"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: \d 0)?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: \d 0)?"),
    ("cc-by", "cc by", r"cc by(?: \d 0)?"),
    ("cc-by-nc", "noncommercial|non commercial", r"creative commons attribution non ?commercial"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike"),
    ("cc-by", "creative commons", r"creative commons attribution"),
    ("odbl", "open database", r"open database license"),
    ("ofl", "open font", r"sil open font license"),
    ("python-2", "python software foundation", r"python software foundation license"),
    ("openssl", "openssl", r"openssl license"),
    ("public-domain", "public domain", r"public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
]
#: Form of a notice around a name, and how sure it is, in order of priority.
FORMS = [
    (r"spdx license identifier {}", 1.0),
    (r"licensed under (?:the )?(?:terms of )?(?:the )?{}(?: license)?", 0.95),
    (r"(?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{}(?: license)?", 0.9),
    (r"subject to (?:the )?(?:terms of )?(?:the )?{}(?: license)?", 0.85),
    (r"(?:under|dedicated to) (?:the )?{}(?: license)?", 0.8),
    (r"license(?: is)? {}", 0.7),
    (r"(?:the )?{} licen[cs]e", 0.6),
]
#: Label, regex and how sure it is: passages of licence texts, headers and file notices, in order of priority.
TEXTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1.0),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise", 0.95),
    ("mit-0", r"permission is hereby granted free of charge to any person obtaining a copy of this software .{0,400}? sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is", 1.0),
    ("x11", r"except as contained in this notice the name of the x consortium shall not be used in advertising", 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 1.0),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)", 1.0),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted", 0.95),
    ("bsd-2", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce", 0.9),
    ("bsd-3", r"neither the name of .{1,120}? nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software", 1.0),
    ("bsd-4", r"all advertising materials mentioning features or use of this software must display the following acknowledg", 1.0),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd", r"use of this source code is governed by a bsd style license that can be found in the license file", 0.95),
    ("apache-2", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 1.0),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.95),
    ("apache-2", r"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 1.0),
    ("apache-2", r"apache license version 2 0 january 2004", 1.0),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", 0.9),
    ("apache-2", r"you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0", 1.0),
    ("gpl-2+", r"under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 1.0),
    ("gpl-3+", r"under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 1.0),
    ("lgpl-2.1+", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", 1.0),
    ("lgpl-3+", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", 1.0),
    ("lgpl-2+", r"under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version", 1.0),
    ("agpl-3+", r"under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", 1.0),
    ("gpl-2", r"under the terms of version 2 of the gnu general public license as published by the free software foundation", 1.0),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", 0.9),
    ("lgpl", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license for more details", 0.9),
    ("agpl-3", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details", 0.9),
    ("gpl-2", r"gnu general public license version 2 june 1991", 1.0),
    ("gpl-3", r"gnu general public license version 3 29 june 2007", 1.0),
    ("lgpl-2.1", r"gnu lesser general public license version 2 1 february 1999", 1.0),
    ("lgpl-3", r"gnu lesser general public license version 3 29 june 2007", 1.0),
    ("agpl-3", r"gnu affero general public license version 3 19 november 2007", 1.0),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("gpl-classpath", r"linking this library statically or dynamically with other modules is making a combined work based on this library", 0.95),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file", 1.0),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("mpl-2", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0", 1.0),
    ("npl", r"the contents of this file are subject to the netscape public license", 1.0),
    ("epl-1", r"this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0", 1.0),
    ("epl-2", r"this program and the accompanying materials are made available under the terms of the eclipse public license v?(?:ersion)? ?2 0", 1.0),
    ("cpl-1", r"the accompanying program is provided under the terms of this common public license", 1.0),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("eupl", r"licensed under the eupl version 1 [12] (?:or as soon they will be approved )?", 1.0),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license", 0.95),
    ("ms-rl", r"microsoft reciprocal license ms rl", 1.0),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 1.0),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1.0),
    ("libpng", r"this code is released under the libpng license", 1.0),
    ("bsl-1", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1.0),
    ("bsl-1", r"distributed under the boost software license version 1 0", 1.0),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("ssleay", r"this product includes cryptographic software written by eric young", 1.0),
    ("artistic-1", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", 1.0),
    ("artistic-2", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 1.0),
    ("perl", r"(?:this is free software you can|this program is free software you can|you can) redistribute it and or modify it under the same terms as perl(?: itself)?", 1.0),
    ("python-2", r"psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly", 1.0),
    ("php-3", r"this source file is subject to version 3 (?:01|0) of the php license", 1.0),
    ("ruby", r"you can redistribute it and or modify it under either the terms of the 2 clause bsdl", 1.0),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("ncsa", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", 1.0),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 1.0),
    ("icu", r"provided that the above copyright notice s and this permission notice appear in all copies of the software and that both the above copyright notice s", 1.0),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 1.0),
    ("w3c", r"permission to copy modify and distribute this (?:software|work) and its documentation with or without modification for any purpose and without fee or royalty is hereby granted", 1.0),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("wtfpl", r"do what the fuck you want to public license", 1.0),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", 1.0),
    ("json", r"the software shall be used for good not evil", 1.0),
    ("cc0", r"to the extent possible under law the .{1,200}? has waived all copyright and related or neighboring rights to this work", 1.0),
    ("cc0", r"creative commons legal code cc0 1 0 universal", 1.0),
    ("cc-by-4", r"this work is licensed under a creative commons attribution 4 0 international license", 1.0),
    ("cc-by-sa-4", r"this work is licensed under a creative commons attribution share ?alike 4 0 international license", 1.0),
    ("cc-by-nd-4", r"this work is licensed under a creative commons attribution no ?derivatives 4 0 international license", 1.0),
    ("cc-by-nc-4", r"this work is licensed under a creative commons attribution non ?commercial 4 0 international license", 1.0),
    ("cc-by-nc-sa-4", r"this work is licensed under a creative commons attribution non ?commercial share ?alike 4 0 international license", 1.0),
    ("cc-by-nc-nd-4", r"this work is licensed under a creative commons attribution non ?commercial no ?derivatives 4 0 international license", 1.0),
    ("cc-by-3", r"this work is licensed under (?:the|a) creative commons attribution 3 0 (?:unported|united states) license", 1.0),
    ("cc-by-sa-3", r"text is available under the creative commons attribution share ?alike license", 0.95),
    ("cc-by-4", r"creativecommons org licenses by 4 0", 0.95),
    ("cc-by-sa-4", r"creativecommons org licenses by sa 4 0", 0.95),
    ("cc-by-nc-4", r"creativecommons org licenses by nc 4 0", 0.95),
    ("cc-by-nd-4", r"creativecommons org licenses by nd 4 0", 0.95),
    ("cc-by-nc-sa-4", r"creativecommons org licenses by nc sa 4 0", 0.95),
    ("cc-by-nc-nd-4", r"creativecommons org licenses by nc nd 4 0", 0.95),
    ("cc0", r"creativecommons org publicdomain zero 1 0", 0.95),
    ("public-domain", r"creativecommons org publicdomain mark 1 0", 0.95),
    ("odbl", r"this database is made available under the open database license", 1.0),
    ("odc-by", r"made available under the open data commons attribution license", 1.0),
    ("pddl", r"made available under the public domain dedication and license", 1.0),
    ("ofl", r"this font software is licensed under the sil open font license version 1 1", 1.0),
    ("ogl-uk", r"contains public sector information licensed under the open government licence", 1.0),
    ("cecill", r"this software is governed by the cecill (?:b |c )?license under french law", 1.0),
    ("afl-3", r"licensed under the academic free license version 3 0", 1.0),
    ("osl-3", r"licensed under the open software license version 3 0", 1.0),
    ("upl-1", r"the universal permissive license upl version 1 0", 1.0),
    ("busl-1.1", r"business source license 1 1", 0.95),
    ("sspl-1", r"server side public license version 1", 0.95),
    ("elastic-2", r"elastic license 2 0", 0.9),
    ("commons-clause", r"the software is provided to you by the licensor under the license as defined below subject to the following condition", 1.0),
    ("polyform-nc", r"polyform noncommercial license 1 0 0", 1.0),
    ("openrail", r"creativeml open rail m", 1.0),
    ("llama-2", r"llama 2 community license agreement", 1.0),
    ("public-domain", r"(?:this (?:work|file|software|code) is|has been placed|placed|released) in(?:to)? the public domain", 0.95),
    ("public-domain", r"the authors? (?:hereby )?disclaims? copyright to this source code", 1.0),
    ("public-domain", r"no copyright is claimed", 0.7),
    ("proprietary", r"all rights reserved (?:unauthorized|no part of this)", 0.9),
    ("proprietary", r"no part of this (?:publication|work|book|document) may be reproduced", 0.9),
    ("proprietary", r"(?:unauthorized|unauthorised) (?:copying|use|distribution|reproduction) of this (?:file|software|material|document)", 0.9),
    ("proprietary", r"this (?:software|document|material) is (?:the )?confidential", 0.9),
    ("proprietary", r"this (?:software|document|material) is (?:the )?proprietary", 0.9),
    ("proprietary", r"confidential and proprietary", 0.7),
    ("non-commercial", r"for (?:personal and )?non ?commercial use only", 0.7),
    ("non-commercial", r"may not be used for commercial purposes", 0.7),
    ("research-only", r"for academic(?: and research)? (?:purposes|use) only", 0.7),
    ("research-only", r"for research(?: and academic)? (?:purposes|use) only", 0.7),
]


def required(pattern: str) -> str:
    """The longest string that every match of a regex holds; "" if there is none."""
    best = run = ""
    for op, arg in [*parser.parse(pattern), (sre.ANY, None)]:
        if op is sre.LITERAL:
            run += chr(arg)
        else:
            best, run = max(best, run, key=len), ""
    return best


@lru_cache(maxsize=1)
def signatures() -> list[tuple[str, tuple[str, ...], regex.Pattern, float, int]]:
    """(label, keywords, pattern, score, priority): all passages, then every form of every name. A keyword starts a word or stands in a passage."""
    out = [(label, (required(text),), regex.compile(rf"(?<= )(?:{text})"), score, n) for n, (label, text, score) in enumerate(TEXTS)]
    for form, score in FORMS:
        for label, words, name in NAMES:
            out.append((label, tuple(f" {w}" for w in words.split("|")), regex.compile(rf"(?<= )(?:{form.format(name)})(?= )"), score, len(out)))
    return out


@lru_cache(maxsize=1)
def keywords() -> tuple[ahocorasick.Automaton, frozenset[int]]:
    """An automaton from each keyword to the numbers of its signatures, and the signatures that are never gated."""
    by_word: dict[str, list[int]] = {}
    for i, (_, words, *_) in enumerate(signatures()):
        for w in words:
            by_word.setdefault(w, []).append(i)
    always, found = frozenset(by_word.pop("", ())), ahocorasick.Automaton()
    for w, numbers in by_word.items():
        found.add_word(w, numbers)
    found.make_automaton()
    return found, always


@lru_cache(maxsize=1)
def base_patterns() -> list[tuple[str, regex.Pattern]]:
    return [(label, regex.compile(rf"(?<= ){phrase}(?= )")) for phrase, label in BASE.items()]


def scan(text: str | None, gated: bool = True) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """Number of words, base places (first word, label), detections (first word, end word, label, score)."""
    found = _WORDS((text or "").translate(_UPPER))
    form = f" {' '.join(found)} "
    base = [(m.start(), label) for label, p in base_patterns() for m in p.finditer(form, overlapped=True)]
    if gated:
        automaton, always = keywords()
        open_ones = sorted(always.union(*{id(x): x for _, x in automaton.iter(form)}.values()))
    else:
        open_ones = range(len(signatures()))
    hits = []
    for i in open_ones:
        label, _, p, score, priority = signatures()[i]
        for m in p.finditer(form):
            # A passage may end within a word, which then counts whole.
            e = m.end() if form[m.end()] == " " else form.index(" ", m.end())
            hits.append((priority, m.start() - e, m.start(), e, label, score))
    taken = suppress(sorted(hits))
    marks = sorted({x for x, _ in base} | {x for hit in taken for x in hit[:2]})
    at, seen, word_of = 0, 0, {}
    for x in marks:
        seen += form.count(" ", at, x)
        word_of[x], at = seen - 1, x
    return len(found), sorted((word_of[x], label) for x, label in base), [(word_of[a], word_of[b] + 1, label, s) for a, b, label, s in taken]


def suppress(hits: list[tuple[int, int, int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Detections in order, without those inside one taken before. Taken ones lie in a sorted list of starts and ends."""
    taken: list[tuple[int, int, str, float]] = []
    spans: list[tuple[int, int]] = []
    longest = 0
    for _, _, a, b, label, score in hits:
        j = bisect_right(spans, (a, float("inf"))) - 1
        inside = False
        # One that starts further back than the longest taken interval ends before this one does.
        while j >= 0 and spans[j][0] >= b - longest and not inside:
            inside = spans[j][1] >= b
            j -= 1
        if not inside:
            insort(spans, (a, b))
            longest = max(longest, b - a)
            taken.append((a, b, label, score))
    return sorted(taken)


def scan_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, base: [(word, label)], found: [(first, end, label, score)]). No shuffle."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    places = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    spans = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                rows = [scan(t) for t in b.column("text").to_pylist()]
                base = [[{"word": w, "label": x} for w, x in r[1]] for r in rows]
                found = [[{"first": a, "end": e, "label": x, "score": s} for a, e, x, s in r[2]] for r in rows]
                columns = [b.column("key"), pa.array([r[0] for r in rows], pa.int64()), pa.array(base, places), pa.array(found, spans)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "base", "found"])

    schema = f"key {kind}, n_words long, base array<struct<word: long, label: string>>, found array<struct<first: long, end: long, label: string, score: double>>"
    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, schema).withColumnRenamed("key", key)


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    rows = scan_texts(df, key, text)
    base, all_labels = F.array_distinct(F.col("base.label")), F.array_union(F.col("base.label"), F.col("found.label"))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("found.score"), F.lit(0.0)))
    return rows.select(key, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"), F.array_join(F.sort_array(base), ",").alias("base_labels"), F.array_join(F.sort_array(all_labels), ",").alias("labels"), score.alias("score"))
