"""The hash draws of `scalars` in numpy, for many replicates of the same keys at once: MD5 of a whole batch, a step at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import POISSON, share

SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
PLACES = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
BOUNDS = [int(share(p), 16) for p in POISSON]
#: Rows hashed at once: a few arrays of so many words stay in a core's cache.
CHUNK = 32_768
#: A task draws for so many rows at most; `dealt` makes the tasks.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame) -> DataFrame:
    """df dealt out evenly, over all cores at least: however few files or row groups hold it, tasks stay as small as TASK_ROWS."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS)))


def prefix(key: str) -> Column:
    """What comes before a draw's other parts: the key and a colon; a null key adds nothing, as in concat_ws."""
    return F.coalesce(F.concat(F.col(key).cast("string"), F.lit(":")), F.lit(""))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Arrow's small batches put together to about CHUNK rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks()


def _compress(state: list[np.ndarray], words: list) -> list[np.ndarray]:
    """One MD5 block; words are arrays or numbers."""
    a, b, c, d = (x.copy() for x in state)
    f = np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        word = words[PLACES[i]]
        if isinstance(word, np.ndarray):
            np.add(a, word, out=a)
            word = 0
        np.add(a, np.uint32((SINES[i] + word) & 0xFFFFFFFF), out=a)
        np.left_shift(a, np.uint32(SHIFTS[i]), out=f)
        np.right_shift(a, np.uint32(32 - SHIFTS[i]), out=a)
        np.bitwise_or(a, f, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def _heads(heads: np.ndarray, suffixes: list[bytes]) -> Iterator[np.ndarray]:
    """By suffix: the first four bytes of the MD5 of each row of heads (bytes, all of one length) and the suffix, as numbers."""
    n, length = heads.shape
    padded = np.zeros((n, -(-length // 4) * 4), np.uint8)
    padded[:, :length] = heads
    own = np.ascontiguousarray(padded.view("<u4").T)
    for suffix in suffixes:
        size = length + len(suffix)
        tail = bytes(length) + suffix + b"\x80" + bytes(-(size + 9) % 64) + (8 * size).to_bytes(8, "little")
        fixed = np.frombuffer(tail, "<u4").tolist()
        words = [own[i] | np.uint32(x) if i < len(own) else x for i, x in enumerate(fixed)]
        state = [np.full(n, x, np.uint32) for x in START]
        for at in range(0, len(words), 16):
            state = _compress(state, words[at : at + 16])
        yield state[0].byteswap()


def poisson_weights(prefixes: pa.Array | pa.ChunkedArray, suffixes: list[str]) -> np.ndarray:
    """By suffix and row: the Poisson(1) weight that `scalars.poisson` gives for the prefix (see `prefix`) and the suffix."""
    if isinstance(prefixes, pa.ChunkedArray):
        prefixes = prefixes.combine_chunks()
    out = np.zeros((len(suffixes), len(prefixes)), np.uint8)
    if not len(prefixes):
        return out
    prefixes = prefixes.cast(pa.large_binary())
    _, offsets, data = prefixes.buffers()
    starts = np.frombuffer(offsets, np.int64)[prefixes.offset : prefixes.offset + len(prefixes) + 1]
    lengths, text = np.diff(starts), np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    ends = [s.encode() for s in suffixes]
    for length in np.unique(lengths):
        same = np.flatnonzero(lengths == length)
        for at in range(0, len(same), CHUNK):
            rows = same[at : at + CHUNK]
            for b, u in enumerate(_heads(text[starts[rows][:, None] + np.arange(length)], ends)):
                w = (u >= BOUNDS[0]).view(np.uint8)
                for bound in BOUNDS[1:]:
                    w += u >= bound
                out[b, rows] = w
    return out
