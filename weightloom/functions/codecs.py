"""Codecs of tensor bytes: two byte planes of 16-bit words against a base, zstd, and their containers.

The pair codec takes the exclusive or of two tensors' 16-bit words and puts the bits 14 to 7 (a bfloat16's exponent) in
one plane and the sign with the bits 6 to 0 in the other. Equal bits vanish, so both planes compress well where a
tensor has been tuned only a little. A codec is registered by name, so others can be added.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard

LEVEL = 3
#: Bytes of a tensor that are encoded at a time; even, so a word is never split.
CHUNK = 16 << 20
#: Fixed values of the format with several frames.
MAGIC = b"ZIDX"


def content_hash(data: bytes) -> str:
    """XXH3 with 64 bits, unseeded, as 16 hex digits."""
    return xxhash.xxh3_64_hexdigest(data)


def compress(data: bytes, level: int = LEVEL) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def decompress(data: bytes) -> bytes:
    """All frames of a blob, one after another, whether or not they say their size."""
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as r:
        return r.read()


def words(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2", n)


def planes(base: bytes, tuned: bytes) -> tuple[bytes, bytes]:
    """The two planes of the exclusive or, over the even length that both have. Less than one word is an error."""
    n = min(len(base), len(tuned)) // 2
    if n < 1:
        raise ValueError("a pair needs two bytes at least")
    x = words(base, n) ^ words(tuned, n)
    return (x >> 7).astype(np.uint8).tobytes(), (((x >> 8) & 0x80) | (x & 0x7F)).astype(np.uint8).tobytes()


def joined(base: bytes, exponents: bytes, rest: bytes) -> bytes:
    """The tuned tensor from its base and the planes."""
    if len(exponents) != len(rest):
        raise ValueError("planes differ in length")
    n = len(exponents)
    if len(base) < 2 * n:
        raise ValueError("the base is shorter than the planes")
    low = np.frombuffer(rest, np.uint8).astype(np.uint16)
    x = (np.frombuffer(exponents, np.uint8).astype(np.uint16) << 7) | ((low & 0x80) << 8) | (low & 0x7F)
    return (x ^ words(base, n)).astype("<u2").tobytes()


def framed(exponents: bytes, rest: bytes) -> bytes:
    """A pair blob: the first part's length as 64 bits, both parts."""
    return struct.pack("<Q", len(exponents)) + exponents + rest


def unframed(blob: bytes) -> tuple[bytes, bytes]:
    if len(blob) < 8:
        raise ValueError("a pair blob has 8 bytes at least")
    (n,) = struct.unpack_from("<Q", blob)
    if len(blob) < 8 + n:
        raise ValueError("a pair blob is cut short")
    return blob[8 : 8 + n], blob[8 + n :]


def encode_pair(base: bytes, tuned: bytes) -> bytes:
    """Exact for even lengths that are equal; `choose` gives others to the solo codec."""
    return framed(*(compress(p) for p in planes(base, tuned)))


def decode_pair(base: bytes, blob: bytes) -> bytes:
    return joined(base, *(decompress(p) for p in unframed(blob)))


def parts(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """Pieces of an even size."""
    step = max(2, size & ~1)
    for at in range(0, len(data), step):
        yield data[at : at + step]


def several(frames: list[bytes], sizes: list[int]) -> bytes:
    """The container of several frames: magic, count, (compressed, plain) sizes, the frames."""
    head = MAGIC + struct.pack("<I", len(frames)) + b"".join(struct.pack("<II", len(f), n) for f, n in zip(frames, sizes, strict=True))
    return head + b"".join(frames)


def decompress_several(blob: bytes) -> bytes:
    """The content of a container; a blob whose sizes don't fit one is taken as plain frames."""
    if blob[:4] == MAGIC and len(blob) >= 8:
        (n,) = struct.unpack_from("<I", blob, 4)
        at = 8 + 8 * n
        if len(blob) >= at:
            sizes = [struct.unpack_from("<II", blob, 8 + 8 * i) for i in range(n)]
            if at + sum(a for a, _ in sizes) == len(blob):
                out = []
                for size, plain in sizes:
                    out.append(decompress(blob[at : at + size]))
                    if len(out[-1]) != plain:
                        raise ValueError("a frame doesn't have the size its container says")
                    at += size
                return b"".join(out)
    return decompress(blob)


def encode_pair_chunked(base: bytes, tuned: bytes, size: int = CHUNK) -> tuple[bytes, bytes]:
    """Both planes, as one frame each, or as containers with a frame for each chunk of a tensor over `size`."""
    n = min(len(base), len(tuned)) & ~1
    if n <= max(2, size & ~1):
        return tuple(compress(p) for p in planes(base, tuned))
    cut = [planes(a, b) for a, b in zip(parts(base[:n], size), parts(tuned[:n], size), strict=True)]
    return tuple(several([compress(x[k]) for x in cut], [len(x[k]) for x in cut]) for k in (0, 1))


def decode_pair_chunked(base: bytes, exponents: bytes, rest: bytes) -> bytes:
    return joined(base, decompress_several(exponents), decompress_several(rest))


def split_planes(data: bytes) -> tuple[bytes, bytes, bytes]:
    """One tensor's own planes and its odd last byte, if any: the baseline without a base."""
    n = len(data) // 2
    exponents, rest = planes(bytes(2 * n), data) if n else (b"", b"")
    return exponents, rest, data[2 * n :]


def encode_split(base: bytes | None, data: bytes) -> bytes:
    exponents, rest, odd = split_planes(data)
    return framed(compress(exponents), compress(rest + odd))


def decode_split(base: bytes | None, blob: bytes) -> bytes:
    exponents, rest = (decompress(p) for p in unframed(blob))
    n = len(exponents)
    return joined(bytes(2 * n), exponents, rest[:n]) + rest[n:]


@dataclass(frozen=True)
class Codec:
    """encode(base, data) and decode(base, blob); base is None where none is needed."""

    encode: Callable[[bytes | None, bytes], bytes]
    decode: Callable[[bytes | None, bytes], bytes]
    needs_base: bool = False


CODECS: dict[str, Codec] = {
    "pair": Codec(encode_pair, decode_pair, True),
    "solo": Codec(lambda _, data: compress(data), lambda _, blob: decompress(blob)),
    "raw": Codec(lambda _, data: data, lambda _, blob: blob),
    "split": Codec(encode_split, decode_split),
}


def register(name: str, codec: Codec) -> None:
    """Add a codec; a name is taken once."""
    if name in CODECS:
        raise ValueError(f"codec {name} exists")
    CODECS[name] = codec
