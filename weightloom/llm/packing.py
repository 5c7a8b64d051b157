"""Packing by vector bin packing with the dot-product heuristic.

An example is a vector: its tokens, one segment, its loss-bearing tokens. A sequence has a limit on each. The open
sequence takes, of the examples that fit whole, that with the largest dot product of its vector and the room left,
both relative to the limits; where none fits, the one of the largest product is cut to fill the room, unless examples
are to stay whole. Of equal products the first row's is taken. Examples longer than a sequence are cut beforehand.

Each task packs the rows of its own input split, block by block (bounded tokens and pieces), so nothing is shuffled
unless there are fewer splits than cores, and a repeated task gives the same sequences. A sequence that a block leaves open goes on in the next one; only the last of
a task is cut at powers of two, which need no padding.

`pack_texts` takes whole texts, whose tokens all bear loss. `pack_examples` takes instruction data: parts with a mark
whether they bear loss, each encoded for itself, so the three limits bind apart.

Null texts, parts and marks are empty or don't bear loss (the end id alone is left of an empty example), so every row
has a piece. Repeated rows and keys are packed each for itself; a very long text is encoded whole and cut; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weightloom.llm import subwords
from weightloom.llm.common import ship, slices, spread

#: Pieces and tokens in a block.
BLOCK_PIECES, BLOCK_TOKENS = 2048, 4 << 20


def fitting(loss: np.ndarray | None, start: int, tokens: int, room: float) -> int:
    """How many of the next `tokens` ids can be taken with at most `room` loss-bearing ones."""
    if loss is None:
        return int(min(tokens, room))
    return int(np.searchsorted(np.cumsum(loss[start : start + tokens]), room, side="right"))


def cut(first: int, lengths: list[int], losses: list[np.ndarray | None], tokens: int, loss_tokens: int) -> list[tuple[int, int, int]]:
    """Pieces (example, start, length) that fit a sequence, of the examples from `first` on."""
    out = []
    for i in range(first, len(lengths)):
        s = 0
        while s < lengths[i]:
            take = max(1, fitting(losses[i], s, min(tokens, lengths[i] - s), loss_tokens))
            out.append((i, s, take))
            s += take
    return out


def pack(lengths: list[int], losses: list[np.ndarray | None], tokens: int = 4096, segments: int = 512, loss_tokens: int = 4096, whole: bool = False) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (example, start, length). losses: 0/1 for each id, or None where all bear loss."""
    pieces = cut(0, lengths, losses, tokens, loss_tokens)
    done, rest = placed(pieces, losses, tokens, segments, loss_tokens, whole)
    return done + ended(rest, tokens, whole)


def placed(pieces: list[tuple[int, int, int]], losses: list[np.ndarray | None], tokens: int, segments: int, loss_tokens: int, whole: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Closed sequences, and the pieces of the last one if it has room for more."""
    if min(tokens, segments, loss_tokens) < 1:
        raise ValueError("limits must be positive")

    def weigh(i: int, s: int, n: int) -> int:
        return n if losses[i] is None else int(losses[i][s : s + n].sum())

    limits = np.array([tokens, segments, loss_tokens], float)
    owner, start, size = ([p[k] for p in pieces] for k in range(3))
    weight = [weigh(*p) for p in pieces]
    vectors = np.stack([size, np.ones(len(size)), weight], 1) / limits if size else np.zeros((0, 3))
    live = np.ones(len(size), bool)
    left, out, seq = len(size), [], []
    while left:
        room, seq = limits.copy(), []
        while left and room[0] > 0 and room[1] > 0:
            score = vectors @ (room / limits)
            fits = live & (vectors * limits <= room + 1e-6).all(1)
            k = int(np.argmax(np.where(fits, score, -1.0)))
            if fits[k]:
                seq.append((owner[k], start[k], size[k]))
                room -= (size[k], 1, weight[k])
                live[k] = False
                left -= 1
                continue
            if whole:
                break
            k = int(np.argmax(np.where(live, score, -1.0)))
            n = fitting(losses[owner[k]], start[k], min(int(room[0]), size[k]), room[2])
            if n < 1:
                break
            lost = weigh(owner[k], start[k], n)
            seq.append((owner[k], start[k], n))
            room -= (n, 1, lost)
            start[k], size[k], weight[k] = start[k] + n, size[k] - n, weight[k] - lost
            vectors[k] = np.array([size[k], 1, weight[k]]) / limits
        if left or room[0] < 1 or room[1] < 1:
            out += [seq] if whole or room[0] < 1 else at_powers(seq, tokens)
            seq = []
    return out, seq


def ended(rest: list[tuple[int, int, int]], tokens: int, whole: bool) -> list[list[tuple[int, int, int]]]:
    return [rest] if whole and rest else at_powers(rest, tokens)


def at_powers(seq: list[tuple[int, int, int]], full: int) -> list[list[tuple[int, int, int]]]:
    """The sequence itself if it is full, else sequences whose lengths are the powers of two in its length."""
    total = sum(n for _, _, n in seq)
    if total in (0, full):
        return [seq] if seq else []
    out, queue = [], list(reversed(seq))
    for bit in reversed(range(total.bit_length())):
        need, part = total & (1 << bit), []
        while need:
            i, s, n = queue.pop()
            take = min(n, need)
            part.append((i, s, take))
            need -= take
            if take < n:
                queue.append((i, s + take, n - take))
        if part:
            out.append(part)
    return out


Read = Callable[[pa.Array], list[tuple[np.ndarray, np.ndarray | None]]]


def pack_texts(df: DataFrame, tokenizer: str, tokens: int = 4096, segments: int = 512, loss_tokens: int | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, and ids (packed unsigned 32-bit) on wish."""
    name = subwords.ship_tokenizer(df.sparkSession, tokenizer)

    def read(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray | None]]:
        return [(x, None) for x in subwords.ids(name, column.to_pylist())]

    return packed(df.select(F.col(key).alias("key"), F.col(text).alias("text")), read, key, tokens, segments, loss_tokens or tokens, False, with_ids)


def pack_examples(df: DataFrame, tokenizer: str, tokens: int = 4096, segments: int = 64, loss_tokens: int = 2048, key: str = "conv_id", parts: str = "parts", whole: bool = True, with_ids: bool = False) -> DataFrame:
    """As pack_texts, for parts: array<struct<text string, loss boolean>>. Examples that fit a sequence stay whole.

    The end id bears loss if the last part does. Sequences of whole examples are padded to `tokens`.
    """
    name = subwords.ship_tokenizer(df.sparkSession, tokenizer)

    def one(found: list[dict | None] | None) -> tuple[np.ndarray, np.ndarray]:
        texts, marks = [(p or {}).get("text") for p in found or ()], [bool((p or {}).get("loss")) for p in found or ()]
        ids = subwords.ids(name, texts, end=None) + [np.array([subwords.END], "<u4")]
        marks.append(marks[-1] if marks else False)
        return np.concatenate(ids), np.repeat(np.array(marks, np.int64), [len(x) for x in ids])

    def read(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray | None]]:
        return [one(x) for x in column.to_pylist()]

    return packed(df.select(F.col(key).alias("key"), F.col(parts).alias("parts")), read, key, tokens, segments, loss_tokens, whole, with_ids)


def packed(rows: DataFrame, read: Read, key: str, tokens: int, segments: int, loss_tokens: int, whole: bool, with_ids: bool) -> DataFrame:
    ship(rows.sparkSession)
    kind, content = rows.schema["key"].dataType.simpleString(), rows.columns[1]
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"] + ["ids"] * with_ids
    types = [None, *[pa.int64()] * 7, pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following, key_type = TaskContext.get().partitionId() << 40, pa.int64()
        keys, ids, losses, carried, fresh, n_tokens, n_pieces = [], [], [], [], 0, 0, 0

        def out(seqs: list[list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
            nonlocal following
            rows = []
            for seq in seqs:
                at = 0
                for i, s, n in seq:
                    raw = ids[i][s : s + n].tobytes()
                    rows.append((keys[i], s, n, zlib.crc32(raw), len(ids[i]), following, at, n if losses[i] is None else int(losses[i][s : s + n].sum()), raw))
                    at += n
                following += 1
            for i in range(0, len(rows), 4096):
                cols = list(zip(*rows[i : i + 4096], strict=True))[: len(names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t or key_type) for c, t in zip(cols, types, strict=False)], names)

        for whole_batch in batches:
            key_type = whole_batch.schema.field("key").type
            for b in slices(whole_batch, content):
                for k, (x, loss) in zip(b.column("key").to_pylist(), read(b.column(content)), strict=True):
                    keys.append(k)
                    ids.append(x)
                    losses.append(loss)
                    n_tokens += len(x)
                    n_pieces += 1 + len(x) // tokens
                    if n_pieces >= BLOCK_PIECES or n_tokens >= BLOCK_TOKENS:
                        done, carried = placed(carried + cut(fresh, [len(x) for x in ids], losses, tokens, loss_tokens), losses, tokens, segments, loss_tokens, whole)
                        yield from out(done)
                        stay = sorted({i for i, _, _ in carried})
                        carried = [(stay.index(i), s, n) for i, s, n in carried]
                        keys, ids, losses = ([held[i] for i in stay] for held in (keys, ids, losses))
                        fresh, n_tokens, n_pieces = len(keys), 0, 0
        if keys:
            done, rest = placed(carried + cut(fresh, [len(x) for x in ids], losses, tokens, loss_tokens), losses, tokens, segments, loss_tokens, whole)
            yield from out(done + ended(rest, tokens, whole))

    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids binary" * with_ids
    return spread(rows).mapInArrow(run, schema).withColumnRenamed("key", key)
