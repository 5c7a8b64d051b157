"""Ids of a tokenizers file for whole texts, as a step inside Arrow functions.

The files meant here drop white space before they split a text, so no token crosses it and a text's ids are those of
its words one after another. Words of PLAIN characters, which normalisation only lowers, are cut by the file's own
pattern and merged by ranks, with a mark that stands for the end of a piece; all others, and words with an added token,
go through the library. What the driver makes of a file (`prepared`) is sent to the executors once.

Merging by the rank of what a pair makes equals merging by the list of pairs if each token's string, merged by the
tokens before it alone, ends in the pair that the list has for it. `rank_table` leaves out tokens for which that fails:
no text can bring them about. Files of another kind are encoded by the library alone.
"""

from __future__ import annotations

import json
import os
import pickle
import re
import tempfile
from functools import lru_cache
from itertools import groupby

import numpy as np
import regex
import tiktoken
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from weightloom.llm.bpe import merge
from weightloom.llm.common import ship_file, shipped

#: The id that ends a document.
END = 2
#: Ends a piece; not among the characters of PLAIN.
MARK = "\x1e"
_SUFFIX = "</w>"
#: Characters at which str.split cuts although they aren't white space to the library.
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
_WORDS = regex.compile(r"[^\x20\x09-\x0D]+").findall
_LETTERS = "!-~\xa1-įı-ž"
PLAIN, PLAIN_TEXT = regex.compile(f"[{_LETTERS}]+").fullmatch, regex.compile(f"[\x09-\x0d {_LETTERS}]*").fullmatch


def for_plain(pattern: str) -> re.Pattern:
    """A pattern with classes of letters and numbers as one for lower-cased PLAIN text, with these classes spelled out."""
    known = [chr(c) for c in range(0x180) if PLAIN(chr(c))]
    for kind in ("L", "N"):
        pattern = pattern.replace(rf"\p{{{kind}}}", re.escape("".join(c for c in known if regex.match(rf"\p{{{kind}}}", c))))
    return re.compile(pattern)


def words(text: str) -> list[str]:
    return _WORDS(text) if any(c in text for c in _CONTROLS) else text.split()


def byte_letters() -> dict[str, int]:
    """The byte for each letter: a printable byte is its own letter, the others have those from 256 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def piece_pattern(spec: dict) -> str | None:
    """The pattern of a file's pieces if its steps are those known here, else None."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in parts] != ["Split", "ByteLevel"]:
        return None
    (split, level), model = parts, spec["model"]
    known = steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " " and split["behavior"] == "Removed" and split["invert"]
    known = known and not level["add_prefix_space"] and not level["use_regex"]
    known = known and model["type"] == "BPE" and model["end_of_word_suffix"] == _SUFFIX and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
    pattern = split["pattern"].get("Regex", "")
    known = known and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    return pattern if known and not any(set(x["content"]) & set(" \t\n\r\v\f") for x in spec["added_tokens"]) else None


def rank_table(model: dict) -> tuple[list[bytes], list[int]] | None:
    """Tokens as bytes, a final one with the mark, in order of rank, and their ids; None if the file can't be put so."""
    byte_of, mark = byte_letters(), MARK.encode()

    def raw(token: str) -> bytes:
        final = token.endswith(_SUFFIX)
        return bytes(byte_of[c] for c in (token.removesuffix(_SUFFIX) if final else token)) + mark * final

    vocab = model["vocab"]
    if any(c not in vocab or c + _SUFFIX not in vocab for c in byte_of):
        return None
    tokens = [raw(c + _SUFFIX) for c in byte_of]
    ids = [vocab[c + _SUFFIX] for c in byte_of]
    singles = {raw(c): vocab[c] for c in byte_of} | {mark: -1}
    known = dict(singles) | dict(zip(tokens, range(len(tokens)), strict=True))
    numbers = dict(zip(tokens, ids, strict=True)) | singles
    ranks = {t: r for r, t in enumerate(tokens)} | {t: -1 for t in singles}
    for pair in model["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        if a.endswith(_SUFFIX) or (a + b).endswith(_SUFFIX) != b.endswith(_SUFFIX):
            return None
        token = raw(a + b)
        if token in known:
            continue
        # By the tokens so far, the string must end as the listed pair.
        if merge(token, ranks, parts=True) == [raw(a), raw(b)]:
            ranks[token] = len(tokens)
            numbers[token] = vocab[a + b]
            tokens.append(token)
            ids.append(vocab[a + b])
        known[token] = -1
    for t, n in singles.items():
        tokens.append(t)
        ids.append(max(n, 0))
    return tokens, ids


@lru_cache(maxsize=4)
def prepared(path: str) -> str:
    """Make the file that `Encoder` reads, on the driver; returns its path."""
    with open(path, "rb") as f:
        raw = f.read()
    spec = json.loads(raw)
    pattern = piece_pattern(spec)
    table = None if pattern is None else rank_table(spec["model"])
    out = os.path.join(tempfile.mkdtemp(prefix="weightloom-"), os.path.basename(path) + ".ranks")
    with open(out, "wb") as f:
        pickle.dump({"raw": raw, "pattern": pattern, "table": table, "added": [x["content"] for x in spec["added_tokens"]]}, f)
    return out


def ship_tokenizer(spark: SparkSession, path: str) -> str:
    """Send a tokenizers file to the executors; returns the name for `encoder`."""
    return ship_file(spark, prepared(os.path.abspath(path)))


class Encoder:
    """Texts to packed ids of the narrowest unsigned type that holds the vocabulary. path: a file made by `prepared`."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            made = pickle.load(f)
        self.library = Tokenizer.from_buffer(made["raw"])
        self.kind = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.added, self.merged = made["added"], None
        if made["table"]:
            tokens, ids = made["table"]
            self.cut, self.numbers = for_plain(made["pattern"]).findall, np.array(ids, self.kind)
            self.merged = tiktoken.Encoding("pieces", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks={t: r for r, t in enumerate(tokens)}, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def plain(self, text: str) -> bytes:
        pieces = self.cut(text.lower())
        if not pieces:
            return b""
        pieces.append("")
        return self.numbers[self.merged.encode_to_numpy(MARK.join(pieces), disallowed_special=())].tobytes()

    def body(self, text: str) -> bytes:
        if self.merged is None:
            return self.whole(text)
        special = any(x in text for x in self.added)
        if not special and PLAIN_TEXT(text):
            return self.plain(text)
        runs = groupby(words(text), lambda w: PLAIN(w) is not None and not (special and any(x in w for x in self.added)))
        return b"".join((self.plain if known else self.whole)(" ".join(run)) for known, run in runs)

    def packed(self, text: str | None, end: int | None = END) -> bytes:
        """A text's ids and the end id. Null counts as empty."""
        found = self.body(text or "")
        return found if end is None else found + np.array([end], self.kind).tobytes()


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """One encoder for each worker process and shipped file."""
    return Encoder(shipped(name))


def ids(name: str, texts: list[str | None], end: int | None = END) -> list[np.ndarray]:
    """Each text's ids and the end id, as little-endian unsigned 32-bit integers."""
    e = encoder(name)
    return [np.frombuffer(e.packed(x, end), e.kind).astype("<u4") for x in texts]
