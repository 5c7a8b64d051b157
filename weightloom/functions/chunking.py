"""Content-defined chunks: a rolling hash cuts where its masked bits are zero.

The hash of a byte depends on the 64 bytes up to it, h = sum of GEAR[b] << distance, so it is put together for all
places at once by doubling. Between the least and the mean size the stricter mask holds, from there to the largest size
the looser one, so sizes gather around the mean. Chunks cover the data without gap or overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weightloom.runtime import ship

MEAN = 65536
#: Bytes hashed at a time, after the 64 that their hashes need.
BLOCK = 1 << 16


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """For each byte, the first 64 bits of the MD5 of 64 such bytes."""
    return np.array([int.from_bytes(hashlib.md5(bytes([i]) * 64).digest()[:8], "big") for i in range(256)], np.uint64)


def masks(mean: int) -> tuple[int, int]:
    """Masks with one bit more and one less than the mean has, spread over the upper bits."""
    bits = max(6, round(np.log2(mean)))

    def spaced(n: int) -> int:
        return sum(1 << int(p) for p in np.linspace(16, 47, n).round())

    return spaced(bits + 1), spaced(bits - 1)


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash at each byte, of the 64 bytes that end there."""
    h, width = gear()[data], 1
    while width < 64:
        later = h.copy()
        later[width:] += h[:-width] << np.uint64(width)
        h, width = later, 2 * width
    return h


def cuts(data: bytes, mean: int = MEAN) -> list[int]:
    """The end of each chunk."""
    least, most = max(1, mean // 4), mean * 4
    strict, loose = masks(mean)
    raw, n = np.frombuffer(data, np.uint8), len(data)
    hard, soft = [], []
    for lo in range(0, n, BLOCK):
        first = max(0, lo - 63)
        h = rolling(raw[first : lo + BLOCK])[lo - first :]
        hard.append(np.flatnonzero((h & np.uint64(strict)) == 0) + lo + 1)
        soft.append(np.flatnonzero((h & np.uint64(loose)) == 0) + lo + 1)
    hard, soft = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hard, soft))
    out, at = [], 0
    while at < n:
        end = min(n, at + most)
        if n - at > least:
            i = np.searchsorted(hard, at + least + 1)
            if i < len(hard) and hard[i] <= min(end, at + mean):
                end = int(hard[i])
            else:
                j = np.searchsorted(soft, max(at + mean, at + least) + 1)
                if j < len(soft) and soft[j] <= end:
                    end = int(soft[j])
        else:
            end = n
        out.append(end)
        at = end
    return out


def chunks(df: DataFrame, data: str = "data", mean: int = MEAN) -> DataFrame:
    """The other columns, with (seq, digest, length) for each chunk of the binary column. A null has no chunks."""
    ship(df.sparkSession)
    others = [c for c in df.columns if c != data]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                raw = b.column(data)[i].as_py()
                ends = cuts(raw, mean) if raw else []
                if not ends:
                    continue
                starts = [0, *ends[:-1]]
                columns = [pa.repeat(b.column(c)[i], len(ends)) for c in others]
                columns += [pa.array(range(len(ends)), pa.int64()), pa.array([hashlib.sha256(raw[a:e]).hexdigest() for a, e in zip(starts, ends, strict=True)]), pa.array([e - a for a, e in zip(starts, ends, strict=True)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*others, "seq", "digest", "length"])

    return df.select(*others, F.col(data)).mapInArrow(run, f"{fields}{', ' if fields else ''}seq long, digest string, length long")
