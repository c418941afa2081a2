"""Words of whole columns of texts at once: cut, mapped and numbered without a loop over words."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Words(NamedTuple):
    """The words of a column: the number of each in ``distinct``, its first byte and the one after its last in the column's
    bytes, and at which word and byte each text begins (one more entry for the end)."""

    codes: np.ndarray
    distinct: pa.Array
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    texts: np.ndarray


def byte_map(*kept: str) -> np.ndarray:
    """What each byte of UTF-8 becomes: A-Z their small letters, ASCII characters of ``kept`` and all bytes of other characters
    themselves; 0 ends a word."""
    out = np.zeros(256, np.uint8)
    out[128:] = np.arange(128, 256)
    for c in "".join(kept).encode():
        out[c] = c
    out[65:91] = np.arange(97, 123)
    return out


LETTERS = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"


def cut(texts: pa.Array, kept: np.ndarray) -> Words:
    """The longest stretches of kept bytes; none crosses the end of a text. Null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    size = int(at[-1] - at[0])
    data = kept[np.frombuffer(texts.buffers()[2], np.uint8, size, int(at[0]))] if size else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = data != 0
    edge = at[at < size]
    before = np.empty(size, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = before
    after[:-1] = inside[1:]
    after[-1:] = False
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=places[1:])
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[inside])]).dictionary_encode()
    return Words(coded.indices.to_numpy(), coded.dictionary, starts, ends, np.searchsorted(starts, at), at)
