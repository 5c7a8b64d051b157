"""Suffix-array dedup: bytes covered by a string of a given length that also starts in a document with a smaller key.

The rows are first written to the shared folder as one file for each task, which is a part. Windows of `length` bytes
are dealt by their minimizer (the smallest hash of their shorter strings), so equal windows meet; consecutive windows
of one minimizer make a piece of text. What moves is narrow until it is known which text can matter:

1. Each part sends the packed hashes of its minimizers to buckets of hashes, which answer with those that two documents
   hold, and mark those with over HOT places.
2. Each part cuts pieces for these alone, equal ones once for each stretch of text, numbers them and sends them to the
   task of their minimizer. Their places stay behind in a file of the part. A minimizer marked hot is not one group:
   each of its windows is a piece and a group of its own, so no group has more than HOT pieces, exactly.
3. A task makes blocks of whole groups. A block's suffix array is built by prefix doubling, bounded by `length`; from
   level START, which the doubling passes, intervals of the Burrows-Wheeler transform are extended backwards
   breadth-first, one byte a level, and only intervals with two or more documents are kept. Those left at level `length`
   are the repeated strings, and the smallest key in each is its first document. Parts get them back by piece number.
4. Each part reads its rows again and cuts the bytes.

Hashes only decide what is compared; equality comes from the bytes. What a part writes depends on its rows alone, so a
repeated task writes the same. Long texts are worked through in stretches of windows.

Null texts are empty. Rows that repeat a key don't remove from each other. Null keys count as the largest. Of equal
strings those of the smallest key stay, in all its rows. Extra columns are kept by `clean`, whatever their names, and
ignored by `digests`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weightloom.llm.common import open_fs, ship, shuffle_partitions, slices, spread, work_dir

#: Bytes of the shortest string whose hashes are minimizers, of a block, and of texts cut at a time.
GRAM, BLOCK, STRETCH, LAST = 16, 1 << 19, 1 << 20, (1 << 63) - 1
#: Places of a minimizer from which its windows are dealt one by one; bytes of hashes in a bucket; of pieces sent at a time.
HOT, BUCKET, SENT = 1 << 15, 8 << 20, 8 << 20
#: Bytes of pieces that a task groups.
GROUPS = 64 << 20
#: Level from which intervals are extended; the doubling has those of 7 and 14 symbols at hand.
START = 14
#: Levels after which intervals are numbered anew and those of one document dropped; 257^LEVELS times a block fits 63 bits.
LEVELS = 4
_FOUND = np.dtype([("piece", "<i4"), ("start", "<i4"), ("n", "<i4"), ("first", "<i8")])
_PLACE = np.dtype([("row", "<i4"), ("at", "<i8"), ("piece", "<i4")])
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def grams(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of `size` bytes, put together from those of powers of two."""
    power, width, out, done = (raw.astype(np.uint64) + np.uint64(1)) * _A, 1, None, 0
    while width <= size:
        if size & width:
            part = power[done:]
            out = part if out is None else mixed(out[: len(part)], part)
            done += width
        if 2 * width <= size:
            power = mixed(power[:-width], power[width:])
        width *= 2
    return out[: len(raw) - size + 1] * _C


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * _B + right
    h ^= h >> np.uint64(31)
    return h


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """A bucket below n for each hash; minimizers are small, so they are mixed once more."""
    return (((h * _A) >> np.uint64(33)) * np.uint64(n)) >> np.uint64(31)


def cut(raws: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, start, end, minimizer) of each run of windows with one minimizer, a stretch at a time."""
    buf = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([len(x) for x in raws], np.int64)
    ends = np.cumsum(sizes)
    for lo in range(0, len(buf) - length + 1, STRETCH):
        hi = min(lo + STRETCH, len(buf) - length + 1)
        low, width, done = grams(buf[lo : hi + length - 1], gram), length - gram + 1, 1
        while done < width:
            step = min(done, width - done)
            low = np.minimum(low[:-step], low[step:])
            done += step
        at = np.arange(lo, hi)
        text = np.searchsorted(ends, at, side="right")
        ok = ends[text] - at >= length
        new = np.concatenate([[True], (low[1:] != low[:-1]) | (text[1:] != text[:-1])])
        heads = np.flatnonzero(ok & new)
        if len(heads):
            stops = np.flatnonzero(ok & np.concatenate([new[1:] | ~ok[1:], [True]]))
            of = text[heads]
            first = ends[of] - sizes[of]
            yield of, at[heads] - first, at[stops] - first + length, low[heads]


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes by their first `depth` symbols at least, and each one's rank by its first START.

    text: symbols below 512, 0 past the end. Suffixes that are equal so far may come in any order.
    """
    n, reach, early = len(text), 7, None
    key = np.zeros(n, np.int64)
    for k in range(7):
        key <<= 9
        key[: n - k] |= text[k:]
    while True:
        order = np.argsort(key)
        if reach >= depth and early is not None:
            return order.astype(np.int32), early
        key = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.concatenate([[1], np.cumsum(key[1:] != key[:-1], dtype=np.int32) + 1])
        del order
        if reach == START:
            early = rank
        key = rank.astype(np.int64) * (n + 1)
        key[: max(0, n - reach)] += rank[reach:]
        reach *= 2


def first_documents(parts: list[bytes], low: list[int], high: list[int], length: int) -> np.ndarray:
    """For each byte of the parts (a separator after each): the smallest key that holds the window from there, or LAST.

    low, high: each part's smallest and largest key. Strings held by a single key are left out.
    """
    sizes = np.array([len(p) + 1 for p in parts])
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
    text[np.cumsum(sizes) - 1] = 0
    order, early = suffix_array(text, length)
    n = len(text)
    part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)[order]
    room = (np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(n))[order] >= START
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    # To each suffix, the byte before it and the place in the order of the suffix that starts there.
    moves = place[order - 1].astype(np.int64) << 9 | text[order - 1]
    del place
    least, most = np.array(low)[part], np.array(high)[part]
    rows = np.flatnonzero(room)
    name = early[order[rows]].astype(np.int64)
    del early, room, part
    interval = np.full(n, -1, np.int64)
    level, smallest, number = START, np.empty(0, np.int64), np.empty(0, np.int64)
    while len(rows):
        heads = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        smallest, largest = np.minimum.reduceat(least[rows], heads), np.maximum.reduceat(most[rows], heads)
        number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(rows))))
        stays = (smallest < largest)[number]
        rows, number = rows[stays], number[stays]
        if level == length:
            break
        name = number
        for _ in range(min(LEVELS, length - level)):
            move = moves.take(rows)
            byte, to = move & 511, move >> 9
            interval[to] = np.where(byte, name * 257 + byte, -1)
            rows = np.flatnonzero(interval >= 0)
            name = interval.take(rows)
            interval[rows] = -1
            level += 1
    out = np.full(n, LAST, np.int64)
    if len(rows):
        out[order[rows]] = smallest[number]
    return out


def equal_runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal values."""
    if not len(values):
        return []
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def runs(first: np.ndarray, pieces: list[bytes], high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, rows): runs of windows with one first document below the piece's largest key, in order of the pieces."""
    sizes = np.array([len(x) + 1 for x in pieces])
    piece = np.repeat(np.arange(len(pieces)), sizes)
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (piece[1:] != piece[:-1])])
    heads = np.flatnonzero(new)
    n = np.diff(np.append(heads, len(first)))
    stays = first[heads] < high[piece[heads]]
    heads, n = heads[stays], n[stays]
    rows = np.empty(len(heads), _FOUND)
    rows["piece"], rows["start"], rows["n"], rows["first"] = 0, heads - (np.cumsum(sizes) - sizes)[piece[heads]], n, first[heads]
    return piece[heads], rows


def bounds_of(ids: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest key of each id below n; each id occurs."""
    order = np.argsort(ids, kind="stable")
    heads = np.searchsorted(ids[order], np.arange(n))
    keys = keys[order]
    return np.minimum.reduceat(keys, heads).astype("<i8"), np.maximum.reduceat(keys, heads).astype("<i8")


def windows_of(of: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, split: np.ndarray, raws: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces, those marked cut into their windows, each with a hash of its own as its group."""
    n = np.where(split, end - start - length + 1, 1)
    which = np.repeat(np.arange(len(of)), n)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    of, cut, start, h = of[which], split[which], start[which] + step, h[which]
    end = np.where(cut, start + length, end[which])
    for i in np.flatnonzero(cut).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raws[of[i]][start[i] : end[i]])
    return of, start, end, h


class Parts:
    """The rows as files in the shared folder, one for each part, and the steps over them."""

    def __init__(self, df: DataFrame, length: int, key: str, text: str, hot: int = HOT):
        self.spark: SparkSession = df.sparkSession
        self.hot = hot
        ship(self.spark)
        self.length, self.gram, self.text = length, max(GRAM, length // 3), text
        if length < GRAM:
            raise ValueError(f"strings must have {GRAM} bytes at least")
        self.base, self.k = work_dir(self.spark, "suffixes"), f"k_{uuid.uuid4().hex}"
        rows = spread(df).withColumn(self.k, F.coalesce(F.col(key).cast("long"), F.lit(LAST)))
        self.schema: StructType = df.schema
        rows.write.option("compression", "zstd").option("parquet.block.size", str(BUCKET)).parquet(f"{self.base}/rows")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.base}/rows")
        self.files = sorted(written.inputFiles())
        self.n_bytes = int(written.agg(F.sum(F.octet_length(text))).first()[0] or 0)

    def list(self, schema: str = "p int, file string") -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(self.files)), schema).repartitionById(max(1, len(self.files)), "p")

    def reader(self) -> Callable[[int], Iterator[pa.RecordBatch]]:
        """A function from a part to its rows in small batches."""
        files = self.files

        def read(p: int, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
            fs, at = open_fs(files[p])
            with fs.open_input_file(at) as f:
                yield from pq.ParquetFile(f).iter_batches(batch_size=1024, columns=columns)

        return read

    def live(self) -> DataFrame:
        """Rows (p, hashes, hot): the minimizers of part p that two documents hold, packed, and whether they are hot."""
        read, k, text, length, gram = self.reader(), self.k, self.text, self.length, self.gram
        limit = self.hot
        n_buckets = max(shuffle_partitions(self.spark), -(-self.n_bytes * 16 // ((length - gram + 1) * BUCKET)))

        def dealt(p: int, hashes: np.ndarray, counts: np.ndarray, several: np.ndarray) -> Iterator[pa.RecordBatch]:
            columns = [[], [], [], [], []]
            for kind in (0, 1):
                pick = several == kind
                h, c = hashes[pick], counts[pick]
                b = bucket_of(h, n_buckets)
                order = np.argsort(b, kind="stable")
                h, c, b = h[order], c[order], b[order]
                for lo, hi in equal_runs(b):
                    for column, value in zip(columns, (int(b[lo]), p, kind, h[lo:hi].tobytes(), c[lo:hi].tobytes() if kind else b""), strict=True):
                        column.append(value)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "p", "several", "hashes", "counts"])

        def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for p in b.column("p").to_pylist():
                    hashes, owners, held, seen = [], [], 0, 0

                    def sent() -> Iterator[pa.RecordBatch]:
                        h, d = np.concatenate(hashes), np.concatenate(owners)
                        order = np.argsort(h, kind="stable")
                        h, d = h[order], d[order]
                        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                        several = np.maximum.reduceat(d, heads) != np.minimum.reduceat(d, heads)
                        yield from dealt(p, h[heads], np.diff(np.append(heads, len(h))).astype("<u4"), several)

                    for whole in read(p, [k, text]):
                        for part in slices(whole, text, STRETCH):
                            raws = [(x or "").encode() for x in part.column(text).to_pylist()]
                            for of, _, _, h in cut(raws, length, gram):
                                hashes.append(h)
                                owners.append((of + seen).astype(np.int32))
                                held += len(h)
                            seen += len(raws)
                            if held * 8 >= 4 * BUCKET:
                                yield from sent()
                                hashes, owners, held = [], [], 0
                    if held:
                        yield from sent()

        def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, counts, several, owner = [], [], [], []
            for b in batches:
                for p, kind, h, c in zip(*(b.column(x).to_pylist() for x in ("p", "several", "hashes", "counts")), strict=True):
                    h = np.frombuffer(h, "<u8")
                    hashes.append(h)
                    counts.append(np.frombuffer(c, "<u4") if kind else np.ones(len(h), "<u4"))
                    several.append(np.full(len(h), kind, bool))
                    owner.append(np.full(len(h), p, np.int32))
            if not hashes:
                return
            h = np.concatenate(hashes)
            order = np.argsort(h)
            h, n, kind, p = h[order], np.concatenate(counts)[order], np.concatenate(several)[order], np.concatenate(owner)[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            heads = np.flatnonzero(new)
            many = (np.diff(np.append(heads, len(h))) > 1) | np.logical_or.reduceat(kind, heads)
            hot = np.add.reduceat(n.astype(np.int64), heads) > limit
            number = np.cumsum(new) - 1
            stays = many[number]
            h, p, hot = h[stays], p[stays], hot[number][stays]
            order = np.argsort(p, kind="stable")
            h, p, hot = h[order], p[order], hot[order]
            for lo, hi in equal_runs(p):
                yield pa.RecordBatch.from_arrays([pa.array([int(p[lo])], pa.int32()), pa.array([h[lo:hi].tobytes()], pa.binary()), pa.array([hot[lo:hi].tobytes()], pa.binary())], ["p", "hashes", "hot"])

        found = self.list().mapInArrow(send, "bucket int, p int, several int, hashes binary, counts binary")
        return found.repartitionById(n_buckets, "bucket").mapInArrow(answer, "p int, hashes binary, hot binary")

    def pieces(self) -> DataFrame:
        """Rows (bucket, p, block): the pieces of live minimizers, packed, by their group's bucket. Places go to a file of the part."""
        read, k, text, length, gram, base, n_groups = self.reader(), self.k, self.text, self.length, self.gram, self.base, self.n_groups()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for b in batches:
                for p, h, hot in zip(*(b.column(x).to_pylist() for x in ("p", "hashes", "hot")), strict=True):
                    known.setdefault(p, []).append((np.frombuffer(h, "<u8"), np.frombuffer(hot, bool)))
            for p, blocks in known.items():
                live, first = np.unique(np.concatenate([h for h, _ in blocks]), return_index=True)
                hot = np.concatenate([x for _, x in blocks])[first]
                yield from of_part(p, live, hot)

        def of_part(p: int, live: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
            held: dict[bytes, int] = {}
            group, ids, keyed, places, size, number, seen = [], [], [], [], 0, 0, 0

            def sent() -> pa.RecordBatch:
                nonlocal number
                g, names = np.array(group, np.uint64), list(held)
                low, high = bounds_of(np.array(ids), np.concatenate(keyed), len(names))
                bucket = bucket_of(g, n_groups)
                order = np.argsort(bucket, kind="stable")
                bucket, blocks, edges = bucket[order], [], equal_runs(bucket[order])
                for lo, hi in edges:
                    i = order[lo:hi]
                    these = [names[x] for x in i.tolist()]
                    arrays = (g[i], low[i], high[i], (number + i).astype("<i4"), np.array([len(x) for x in these], "<i4"))
                    blocks.append(zstandard.compress(b"".join([np.array([len(i)], "<i8").tobytes(), *(x.tobytes() for x in arrays), *these]), 3))
                number += len(names)
                return pa.RecordBatch.from_arrays([pa.array(bucket[[lo for lo, _ in edges]].astype(np.int32)), pa.array(np.full(len(edges), p, np.int32)), pa.array(blocks, pa.binary())], ["bucket", "p", "block"])

            for whole in read(p, [k, text]):
                for b in slices(whole, text, STRETCH):
                    raws, keys = [(x or "").encode() for x in b.column(text).to_pylist()], np.array(b.column(k).to_pylist(), np.int64)
                    for of, start, end, h in cut(raws, length, gram):
                        at = np.minimum(np.searchsorted(live, h), len(live) - 1)
                        pick = np.flatnonzero(live[at] == h)
                        split = hot[at[pick]]
                        if split.any():
                            of, start, end, h = windows_of(of[pick], start[pick], end[pick], h[pick], split, raws, length)
                        else:
                            of, start, end, h = of[pick], start[pick], end[pick], h[pick]
                        first = len(ids)
                        for t, a, e, g in zip(of.tolist(), start.tolist(), end.tolist(), h.tolist(), strict=True):
                            piece = raws[t][a:e]
                            i = held.get(piece)
                            if i is None:
                                i = held[piece] = len(held)
                                group.append(g)
                                size += e - a
                            ids.append(i)
                        keyed.append(keys[of])
                        place = np.empty(len(of), _PLACE)
                        place["row"], place["at"], place["piece"] = seen + of, start, number + np.array(ids[first:], np.int64)
                        places.append(place)
                        if size >= SENT:
                            yield sent()
                            held, group, ids, keyed, size = {}, [], [], [], 0
                    seen += len(raws)
            if held:
                yield sent()
            fs, at = open_fs(f"{base}/places")
            fs.create_dir(at, recursive=True)
            name = f"{at}/{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(name, compression=None) as f:
                f.write(zstandard.compress((np.concatenate(places) if places else np.empty(0, _PLACE)).tobytes(), 3))
            fs.move(name, f"{at}/{p:08d}")

        found = self.live().repartitionById(max(1, len(self.files)), "p")
        return found.mapInArrow(run, "bucket int, p int, block binary")

    def n_groups(self) -> int:
        """Buckets of groups: so many that one has about GROUPS bytes if all text is live."""
        return max(shuffle_partitions(self.spark), -(-4 * self.n_bytes // GROUPS))

    def found(self) -> DataFrame:
        """Rows (p, found): for pieces of part p, runs of windows whose first document has a smaller key than the piece's largest."""
        length = self.length

        def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays, bodies, owners = [], [], []
            for b in batches:
                for p, packed in zip(b.column("p").to_pylist(), b.column("block").to_pylist(), strict=True):
                    raw = zstandard.decompress(packed)
                    n = int(np.frombuffer(raw, "<i8", 1)[0])
                    at, found = 8, []
                    for kind in ("<u8", "<i8", "<i8", "<i4", "<i4"):
                        found.append(np.frombuffer(raw, kind, n, at))
                        at += found[-1].nbytes
                    arrays.append(found)
                    bodies.append(raw[at:])
                    owners.append(np.full(n, p, np.int32))
            if not bodies:
                return
            g, low, high, number, size_of = (np.concatenate(x) for x in zip(*arrays, strict=True))
            body, p = b"".join(bodies), np.concatenate(owners)
            del arrays, bodies, owners
            order = np.argsort(g, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1]]))
            many = np.minimum.reduceat(low[order], heads) != np.maximum.reduceat(high[order], heads)
            order = order[np.repeat(many, np.diff(np.append(heads, len(order))))]
            ends = np.cumsum(size_of, dtype=np.int64)
            starts = ends - size_of
            # Whole groups up to BLOCK bytes together; a larger one alone.
            total = np.cumsum(size_of[order], dtype=np.int64)
            heads = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1]])) if len(order) else np.zeros(0, np.int64)
            before = total[heads] - size_of[order][heads]
            for lo, hi in equal_runs(before // BLOCK):
                rows = order[heads[lo] : heads[hi] if hi < len(heads) else len(order)]
                seen: dict[bytes, int] = {}
                ids = np.array([seen.setdefault(body[a:e], len(seen)) for a, e in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)])
                names = list(seen)
                least, most = bounds_of(ids, low[rows], len(names))[0], bounds_of(ids, high[rows], len(names))[1]
                first = first_documents(names, least, most, length)
                yield from answered(*runs(first, names, most), ids, p[rows], number[rows])

        def answered(piece: np.ndarray, rows: np.ndarray, ids: np.ndarray, owners: np.ndarray, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Each piece's runs for all parts that hold it."""
            lo, hi = (np.searchsorted(piece, ids, side=s) for s in ("left", "right"))
            n = hi - lo
            if not n.sum():
                return
            which = np.repeat(np.arange(len(ids)), n)
            out = rows[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            out["piece"], owner = numbers[which], owners[which]
            order = np.argsort(owner, kind="stable")
            out, owner = out[order], owner[order]
            edges = equal_runs(owner)
            yield pa.RecordBatch.from_arrays([pa.array(owner[[a for a, _ in edges]]), pa.array([out[a:b].tobytes() for a, b in edges], pa.binary())], ["p", "found"])

        dealt = self.pieces().repartitionById(self.n_groups(), "bucket")
        dealt.mapInArrow(expand, "p int, found binary").write.parquet(f"{self.base}/found")
        return self.spark.read.schema("p int, found binary").parquet(f"{self.base}/found")

    def mapped(self, work: Callable[[pa.RecordBatch, list[list[tuple[int, int]]]], pa.RecordBatch], schema: StructType | str, columns: list[str]) -> DataFrame:
        """What `work` makes of each batch of rows and the sorted, disjoint ranges to cut from each row's text."""
        read, k, text, length, base = self.reader(), self.k, self.text, self.length, self.base

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, list[np.ndarray]] = {}
            for b in batches:
                for p, x in zip(b.column("p").to_pylist(), b.column("found").to_pylist(), strict=True):
                    known.setdefault(p, []).extend([np.frombuffer(x, _FOUND)] if x else [])
            for p, blocks in known.items():
                found, places = np.zeros(0, _FOUND), np.zeros(0, _PLACE)
                if blocks:
                    found = np.concatenate(blocks)
                    found = found[np.argsort(found["piece"], kind="stable")]
                    fs, at = open_fs(f"{base}/places/{p:08d}")
                    with fs.open_input_file(at) as f:
                        places = np.frombuffer(zstandard.decompress(f.read()), _PLACE)
                seen = 0
                for whole in read(p, [*columns, k]):
                    for b in slices(whole, text):
                        ours = places[np.searchsorted(places["row"], seen) : np.searchsorted(places["row"], seen + len(b))]
                        yield work(b, ranges(ours, found, np.array(b.column(k).to_pylist(), np.int64), seen, length))
                        seen += len(b)

        rows = self.found().unionByName(self.list().select("p", F.lit(None).cast("binary").alias("found")))
        return rows.repartitionById(max(1, len(self.files)), "p").mapInArrow(run, schema)


def ranges(places: np.ndarray, found: np.ndarray, keys: np.ndarray, first: int, length: int) -> list[list[tuple[int, int]]]:
    """The maximal ranges of each row's bytes that strings of documents with smaller keys cover."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(keys))]
    lo, hi = (np.searchsorted(found["piece"], places["piece"], side=s) for s in ("left", "right"))
    n = hi - lo
    if not n.sum():
        return out
    which = np.repeat(np.arange(len(places)), n)
    hit = found[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    row, a = places["row"][which] - first, places["at"][which] + hit["start"]
    e = a + hit["n"] + length - 1
    pick = hit["first"] < keys[row]
    row, a, e = row[pick], a[pick], e[pick]
    order = np.lexsort((a, row))
    for r, x, y in zip(row[order].tolist(), a[order].tolist(), e[order].tolist(), strict=True):
        spans = out[r]
        if spans and x <= spans[-1][1]:
            if y > spans[-1][1]:
                spans[-1] = (spans[-1][0], y)
        else:
            spans.append((x, y))
    return out


def kept(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in cut for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def digests(df: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept_sha256)."""
    kind = df.schema[key].dataType.simpleString()
    parts = Parts(df.select(F.col(key).alias("key"), F.col(text).alias("text")), length, "key", "text", hot)

    def work(b: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        out = []
        for t, s in zip(b.column("text").to_pylist(), spans, strict=True):
            raw = (t or "").encode()
            out.append((len(raw), sum(e - a for a, e in s), len(s), hashlib.sha256(kept(raw, s)).hexdigest()))
        columns = [pa.array([r[i] for r in out], pa.int64() if i < 3 else pa.string()) for i in range(4)]
        return pa.RecordBatch.from_arrays([b.column("key"), *columns], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return parts.mapped(work, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", ["key", "text"]).withColumnRenamed("key", key)


def clean(df: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """All rows in the table's own columns; of a character that is cut in part, nothing stays. Null texts stay null."""
    parts = Parts(df, length, key, text, hot)
    schema = to_arrow_schema(df.schema)

    def work(b: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        texts = [t if not s else kept(t.encode(), s).decode("utf-8", "ignore") for t, s in zip(b.column(text).to_pylist(), spans, strict=True)]
        columns = [pa.array(texts, f.type) if f.name == text else b.column(f.name).cast(f.type, safe=False) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return parts.mapped(work, df.schema, df.columns)
