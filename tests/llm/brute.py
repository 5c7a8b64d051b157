"""Plain versions of what the operators decide, for small tables. Rows: dicts of the columns of documents."""

from collections import defaultdict

import regex
import xxhash

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def line_key(line):
    found = WORD.findall(line)
    return " ".join(found).lower() if found else None


def base_failed(text):
    words, places = WORD.findall(text), defaultdict(list)
    for at in range(len(words) - 7):
        places[tuple(words[at : at + 8])].append(at)
    repeat = {k for p in places.values() if len(p) > 1 for at in p for k in range(at, at + 8)}
    return len(words) < 20 or 100 * len(repeat) > 30 * len(words)


def quality(rows, min_docs=5, max_lost=0.75):
    """Text that stays of each row, in order; None for rows that go."""
    texts, holders = {}, defaultdict(set)
    for r in rows:
        own = (r["source"], r["text"] or "")
        texts[own] = min(texts.get(own, r["doc_id"]), r["doc_id"])
        for line in own[1].split("\n"):
            if line_key(line):
                holders[own[0], line_key(line)].add(own)
    frequent = {k for k, v in holders.items() if len(v) > min_docs}

    def lost(own, lines):
        return sum(len(WORD.findall(x)) for x in own[1].split("\n") if line_key(x) in lines)

    cut = {own: {line_key(x) for x in own[1].split("\n") if (own[0], line_key(x)) in frequent} for own in texts}
    total = {own: len(WORD.findall(own[1])) for own in texts}
    poor = [own for own in texts if not base_failed(own[1]) and total[own] - lost(own, cut[own]) < (1 - max_lost) * total[own]]
    first = {}
    for own in sorted(poor, key=lambda x: texts[x]):
        for line in cut[own]:
            first.setdefault((own[0], line), own)
    for (_, line), own in first.items():
        cut[own] = cut[own] - {line}
    out = []
    for r in rows:
        own = (r["source"], r["text"] or "")
        stays = not base_failed(own[1]) and total[own] - lost(own, cut[own]) >= (1 - max_lost) * total[own]
        out.append("\n".join(x for x in own[1].split("\n") if line_key(x) not in cut[own]) if stays else None)
    return out


def near_copies(rows, similarity=0.8, width=5):
    """Ids that stay: the smallest of each group linked by the Jaccard similarity of word shingles."""
    def shingles(text):
        words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    first = {i: i for i in sets}

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                first[y] = x
    return {i for i in ids if root(i) == i}


def passages(rows, length=200):
    """Text of each id without bytes covered by a string that a smaller id holds."""
    raws = {r["doc_id"]: (r["text"] or "").encode() for r in rows}
    first, out = {}, {}
    for i in sorted(raws):
        raw = raws[i]
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            if first.setdefault(raw[at : at + length], i) < i:
                gone[at : at + length] = b"\1" * length
        out[i] = bytes(c for c, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def fingerprint(text, width=3):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    parts = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
