"""Words of a text and the Arrow plumbing the Python operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

PIECE_BYTES = 1 << 20
# ASCII punctuation and controls become blanks, A-Z lower case; other bytes are letters.
PLAIN = bytes(
    ord(chr(b).lower()) if chr(b).isalnum() or b >= 128 else 32 for b in range(128)
) + bytes(range(128, 256))


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores before it while a column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each row, NULL as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def portions(sizes: list[int], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each, one row at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def words_of(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, A-Z in lower case."""
    return data.lower().split()


def plain_words(data: bytes) -> list[bytes]:
    """Words of letters and digits in lower case, punctuation ignored."""
    return data.translate(PLAIN).split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes, cut at blanks, so that a very
    long text needs little memory at a time."""
    start = 0
    while len(data) - start > size:
        stop = start + size
        while stop < len(data) and not data[stop : stop + 1].isspace():
            stop += 1
        yield data[start:stop]
        start = stop
    yield data[start:]


def word_hashes(data: bytes, split: Callable[[bytes], list[bytes]] = words_of) -> np.ndarray:
    """64-bit hash of each word in order."""
    if len(data) <= PIECE_BYTES:
        return hashed(split(data))
    return np.concatenate([hashed(split(part)) for part in pieces(data)])


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (splitmix finaliser)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of the whole sequence if it is shorter."""
    if len(hashes) == 0:
        return hashes
    size = min(size, len(hashes))
    count = len(hashes) - size + 1
    out = np.full(count, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count])
    return out


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of their places: the upper bytes are
    nearly all zero and vanish when the exchange is compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def read_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)
