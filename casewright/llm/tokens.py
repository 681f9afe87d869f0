"""Words and terms of texts as exact numbers, inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of words: all but ASCII white space.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of terms: ASCII letters and digits, and whatever is not ASCII.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and length of each maximal run, and the runs before each text.

    ``inside`` tells of each byte whether it belongs to a run, ``offsets`` where
    texts begin and end. No run goes from one text into the next.
    """
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    first = inside & edge[:-1]
    first[1:] |= inside[1:] & ~inside[:-1]
    last = inside & edge[1:]
    last[:-1] |= inside[:-1] & ~inside[1:]
    begins = np.flatnonzero(first)
    return begins, np.flatnonzero(last) + 1 - begins, np.searchsorted(begins, offsets)


def coded(packed: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each run, equal for equal bytes, and the distinct runs.

    ``packed`` holds the bytes of all runs without gaps. Runs are compared as they
    are, not by a hash.
    """
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    runs = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(packed))]
    ).dictionary_encode()
    return runs.indices.to_numpy(), runs.dictionary
