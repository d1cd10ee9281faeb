"""Tokenising whole texts with public tokenizers, fast on natural text through a chunk cache."""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from geoloom.llm import common

#: Marks that may follow a word; with a letter before them there is always a cut.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Longer chunks (in bytes) are encoded but not kept.
CACHED_CHARS = 48
#: Chunks the cache keeps when it is full; it is full at twice as many (some 25 MB).
CACHED_CHUNKS = 350_000
#: Words encoded in one call.
_WORDS_AT_ONCE = 20_000
#: These letters are one pre-token together in every mode, whatever Unicode version is in use.
_LATIN = "^ [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
#: ASCII in lower case, lines joined: safe before a tokenizer that drops case and white space itself.
_LOWER = bytes(range(256)).lower().replace(b"\n", b" ")
#: Bytes that are white space by themselves, to Python or to the tokenizer.
_WHITE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
#: Other white space, of two and of three bytes in UTF-8.
_WHITE_2 = [0x85, 0xA0]
_WHITE_3 = [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_TEXT, _BYTES = pa.large_string(), pa.large_binary()

#: Ids and texts of a batch; words recur more within larger parts.
texts_of = functools.partial(common.texts_of, size=6_000_000)


def _strings(offsets: np.ndarray, data, kind: pa.DataType = _BYTES) -> pa.Array:
    """The strings between ascending offsets into data, which is not copied."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def _parts(strings: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Offsets and data of an array of strings."""
    offsets, data = strings.buffers()[1:]
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1] if offsets else np.zeros(1, np.int64)
    return at, data if data is not None else pa.py_buffer(b"")


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to white space."""
    out = _WHITE.take(data)
    two = np.flatnonzero(data == 0xC2)
    two = two[np.isin(data[two + 1], _WHITE_2)]
    three = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
    code = sum((data[three + k].astype(np.int32) & m) << s for k, m, s in ((0, 15, 12), (1, 63, 6), (2, 63, 0)))
    three = three[np.isin(code, _WHITE_3)]
    for at, n in ((two, 2), (three, 3)):
        for k in range(n):
            out[at + k] = True
    return out


class _Cache:
    """Ids by chunk. When full, what was used again stays, in the order it came, so frequent chunks outlive rare ones."""

    def __init__(self, most: int):
        self.most = most
        self.chunks, self.ids, self.used = pa.array([], _BYTES), pa.array([], _BYTES), np.zeros(0, bool)

    def find(self, wanted: pa.Array) -> np.ndarray:
        """Where each wanted chunk is; -1 if nowhere."""
        at = pc.fill_null(pc.index_in(wanted, value_set=self.chunks), -1).to_numpy().astype(np.int64)
        self.used[at[at >= 0]] = True
        return at

    def add(self, chunks: pa.Array, ids: pa.Array) -> None:
        """Keeps new chunks, as far as there is room."""
        if len(self.chunks) + len(chunks) > 2 * self.most:
            stay = pa.array(np.flatnonzero(self.used)[: self.most])
            self.chunks, self.ids, self.used = self.chunks.take(stay), self.ids.take(stay), np.zeros(len(stay), bool)
        room = 2 * self.most - len(self.chunks)
        small = pa.array(np.flatnonzero(np.diff(_parts(chunks)[0]) <= CACHED_CHARS)[:room])
        self.chunks = pa.concat_arrays([self.chunks, chunks.take(small)])
        self.ids = pa.concat_arrays([self.ids, ids.take(small)])
        self.used = np.concatenate([self.used, np.zeros(len(small), bool)])


class ChunkEncoder:
    """Exact token ids of whole texts as little-endian arrays.

    A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the ids of the
    chunks joined are the ids of the text; chunks recur, so a bounded cache saves most of the
    work. Chunks are found, counted and put together again as Arrow arrays, many texts at a time,
    with no Python object per word. ``mode``: "spaced" for byte-level BPE whose pre-tokens carry their leading space,
    "dropped" for BPE that drops case and white space, "whole" to cut nothing. Added tokens within
    a text are matched as the tokenizer does; what lies between them is cut.
    """

    def __init__(self, path: str, mode: str, cached: int = CACHED_CHUNKS):
        from tokenizers import Tokenizer, pre_tokenizers

        if mode not in ("spaced", "dropped", "whole"):
            raise ValueError(f"unknown mode {mode}")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; its threads would take others'
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(x.normalized or x.lstrip or x.rstrip or x.single_word for x in added.values()):
            mode = "whole"  # these tokens take more than their own characters to match
        self.mode = mode
        self.added = {x.content: k for k, x in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        #: The same without added tokens, which a chunk could only hold by its change of case.
        self.plain = Tokenizer(self.tokenizer.model)
        for part in ("normalizer", "pre_tokenizer"):
            if getattr(self.tokenizer, part) is not None:
                setattr(self.plain, part, getattr(self.tokenizer, part))
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 65536 else "<u4")
        self.cache = _Cache(cached)
        self.ends: dict[str, bool] = {}
        #: The same model behind plain white space, for words that need no more.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=mode == "spaced", use_regex=False)]
        )
        #: For words of ASCII letters, which are their own byte-level symbols.
        self.barest = Tokenizer(self.tokenizer.model)
        self.barest.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: Ids that end a word ("dropped") or begin one ("spaced").
        self.edge = np.zeros(size, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.edge[k] = token.endswith("</w>") if mode == "dropped" else token.startswith("Ġ")

    def _batch(self, chunks: list[str]) -> pa.Array:
        out: list[bytes] = []
        for i in range(0, len(chunks), 4096):
            done = self.plain.encode_batch_fast(chunks[i : i + 4096], add_special_tokens=False)
            out += [np.array(x.ids, self.dtype).tobytes() for x in done]
        return pa.array(out, _BYTES)

    def _ends_word(self, letter: str) -> bool:
        """Whether a mark after this letter always begins a new pre-token, as the tokenizer's own parts say.

        Some letters don't: their normal form ends in a combining mark, which keeps company with punctuation.
        """
        if letter not in self.ends:
            normal, cut = self.plain.normalizer, self.plain.pre_tokenizer
            parts = [
                [x for x, _ in cut.pre_tokenize_str(normal.normalize_str(y) if normal is not None else y)]
                for y in (letter, letter + ".", letter + "'.")
            ]
            self.ends[letter] = parts[1] == [*parts[0], "."] and parts[2] == [*parts[0], "'."]
        return self.ends[letter]

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of words of Latin letters alone, each after a space: encoded in one go, cut at word edges."""
        at, data = _parts(words)
        text = data.to_pybytes()[at[0] : at[-1]].decode()
        if self.mode == "dropped":
            text = text.lower()
        if not text.isascii():
            coder = self.bare
        else:
            coder = self.barest
            if self.mode == "spaced":
                text = text.replace(" ", " Ġ")
        ids = np.array(coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(words):
            return self._batch(words.to_pylist())
        cuts = np.append(0, edges + 1) if self.mode == "dropped" else np.append(edges, len(ids))
        return _strings(cuts * self.dtype.itemsize, ids)

    def _encode(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks; words of Latin letters, those of ASCII apart, are encoded together."""
        latin = pc.match_substring_regex(chunks, _LATIN).to_numpy(zero_copy_only=False)
        plain = pc.string_is_ascii(chunks).to_numpy(zero_copy_only=False)
        order, done = [], [pa.array([], _BYTES)]
        for some in (latin & plain, latin & ~plain):
            at = np.flatnonzero(some)
            for i in range(0, len(at), _WORDS_AT_ONCE):
                order.append(at[i : i + _WORDS_AT_ONCE])
                done.append(self._words(chunks.take(pa.array(order[-1]))))
        order.append(np.flatnonzero(~latin))
        done.append(self._batch(chunks.take(pa.array(order[-1])).to_pylist()))
        place = np.empty(len(chunks), np.int64)
        place[np.concatenate(order)] = np.arange(len(chunks))
        return pa.concat_arrays(done).take(pa.array(place))

    def _split(self, chunks: pa.Array) -> pa.Array:
        """Each chunk as two strings: up to the letter that ends its word, and the marks after it; or the chunk and nothing."""
        at, data = _parts(chunks)
        cores = pc.utf8_rtrim(chunks, characters=_MARKS)
        sizes, own = np.diff(_parts(cores)[0]), np.diff(at)
        marked = np.flatnonzero((sizes < own) & (sizes > 0))
        last = pc.utf8_slice_codeunits(cores.take(pa.array(marked)), start=-1).dictionary_encode()
        ends = np.array([x.isalpha() and self._ends_word(x) for x in last.dictionary.to_pylist()], bool)
        marked = marked[ends[last.indices.to_numpy()]]
        cuts = np.repeat(at, 2)[:-1]
        cuts[1::2] = at[1:]
        cuts[1::2][marked] = at[marked] + sizes[marked]
        return _strings(np.append(cuts, at[-1]), data)

    def _ids(self, chunks: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
        """Ids of distinct chunks, as offsets and bytes."""
        pieces = self._split(chunks.cast(_TEXT)).dictionary_encode()
        at = self.cache.find(pieces.dictionary)
        missing = np.flatnonzero(at < 0)
        fresh = pieces.dictionary.take(pa.array(missing))
        new = self._encode(fresh.cast(_TEXT))
        at[missing] = len(self.cache.ids) + np.arange(len(missing))
        ids = pa.concat_arrays([self.cache.ids, new]).take(pa.array(at)).take(pieces.indices)
        self.cache.add(fresh, new)
        ends, data = _parts(ids)
        return ends[::2], data

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        texts = ["" if x is None else x for x in texts]
        if self.mode == "whole":
            return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        holds = [any(map(x.__contains__, self.added)) for x in texts]
        if not any(holds):
            return self._between(texts)
        # Odd parts are the added tokens themselves.
        parts = [self.at_added.split(x) if held else [x] for x, held in zip(texts, holds, strict=True)]
        ids = iter(self._between([y for x in parts for y in x[::2]]))
        out = []
        for x in parts:
            own = [next(ids)]
            for token in x[1::2]:
                own += [np.array([self.added[token]], self.dtype), next(ids)]
            out.append(np.concatenate(own) if len(own) > 1 else own[0])
        return out

    def _cuts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where chunks begin and end: at the texts' ends, and where the tokenizer cuts whatever stands around.

        What drops white space is cut before every space; else a lone space begins a chunk and a lone line feed is one.
        """
        cut = np.zeros(len(data) + 1, bool)
        if self.mode == "dropped":
            cut[:-1] = data == 32
        else:
            ink = np.ones(len(data) + 2, bool)
            np.logical_not(_white(data), out=ink[1:-1])
            lone = ink[:-2] & ink[2:]
            line = lone & (data == 10)
            cut[:-1] = (lone & (data == 32)) | line
            cut[1:] |= line
        cut[ends] = True
        return np.flatnonzero(cut)

    def _between(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without added tokens, through the cache."""
        ends, raw = _parts(pa.array(texts, _TEXT))
        if ends[-1] == 0:
            return [np.zeros(0, self.dtype) for _ in texts]
        raw = raw.slice(0, int(ends[-1]))
        if self.mode == "dropped":
            raw = raw.to_pybytes().translate(_LOWER)
        cuts = self._cuts(np.frombuffer(raw, np.uint8), ends)
        coded = _strings(cuts, raw).dictionary_encode()
        at, ids = _parts(_strings(*self._ids(coded.dictionary)).take(coded.indices))
        stops = (at[np.searchsorted(cuts, ends)] // self.dtype.itemsize).tolist()
        flat = np.frombuffer(ids, self.dtype, stops[-1])
        return [flat[a:b] for a, b in zip(stops, stops[1:], strict=False)]


_ENCODERS: dict[tuple[str, str, int], ChunkEncoder] = {}
common.keeps("tokens", _ENCODERS.clear)


def encoder(path: str, mode: str, cached: int = CACHED_CHUNKS) -> ChunkEncoder:
    """One encoder per Python worker; tasks share its cache of ``cached`` chunks."""
    key = (path, mode, cached)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, mode, cached)
    return _ENCODERS[key]
