"""Words of many texts at once: byte classes, word bounds and a dictionary, all on Arrow buffers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Classes of bytes.
WORD, GAP, BREAK = 0, 1, 2


def byte_classes(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """A class for each byte: those of ``breaks`` end a piece, those of ``gaps`` only a word, all others belong to words."""
    out = np.zeros(256, np.uint8)
    out[np.frombuffer(gaps, np.uint8)] = GAP
    out[np.frombuffer(breaks, np.uint8)] = BREAK
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z


@dataclass
class Words:
    """Words in order: ``code`` indexes ``names``, ``text`` is the number of the text, ``fresh`` tells the first word of a piece."""

    code: np.ndarray
    text: np.ndarray
    fresh: np.ndarray
    names: pa.Array


def split_words(texts: pa.Array, classes: np.ndarray) -> Words:
    """The words of an array of non-null strings, A-Z lower-cased; no word or piece crosses texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = classes[raw]
    word = kind == WORD
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    starts[first] |= word[first]  # a text begins anew
    at = np.flatnonzero(starts)
    text = np.searchsorted(offsets, at, "right") - 1
    fresh = np.ones(len(at), bool)
    if len(at):
        broken = np.cumsum(kind == BREAK, dtype=np.int32)[at]
        fresh[1:] = (text[1:] != text[:-1]) | (broken[1:] != broken[:-1])
    inside = np.cumsum(word, dtype=np.int64)
    ends = np.append(inside[at] - 1, inside[-1] if len(raw) else 0)
    data = _LOWER[raw[word]]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), text, fresh, coded.dictionary)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (ascending, non-negative integers), each key's place among them, and how often each occurs."""
    if len(keys) and int(keys.max()) < 4 * len(keys) + 65_536:  # a table is faster than a sort
        counts = np.bincount(keys)
        own = np.flatnonzero(counts)
        place = np.zeros(len(counts), np.int64)
        place[own] = np.arange(len(own))
        return own, place[keys], counts[own]
    own, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return own, place, counts
