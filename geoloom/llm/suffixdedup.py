"""Exact repeated strings by a common-prefix-aware distributed merge sort of sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import batch_rows, hash_unit, materialise, pieces, settle, trim

_U = np.uint64
_TOP = np.iinfo(np.uint64).max
#: Bytes of a suffix that the first sort compares; two equal strings of the least length share one such sample.
GRAM = 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position; positions near the end are left out."""
    n = len(buf) - GRAM + 1
    if n <= 0:
        return np.zeros(0, _U)
    raw = buf.tobytes() + bytes(8)
    words = np.empty(len(buf) + 1, _U)
    for k in range(8):
        part = np.frombuffer(raw, "<u8", (len(raw) - k) // 8, k)
        words[k::8] = part[: len(words[k::8])]
    h = _mix(words[:n] * _U(0x9E3779B97F4A7C15) + words[8 : 8 + n])
    return _mix(h ^ (words[GRAM - 8 : GRAM - 8 + n] * _U(0xC2B2AE3D27D4EB4F)))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + width], by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(buf: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions and their hashes: in every string of ``least`` bytes within a text, the
    positions whose gram has the least hash. The choice depends on the string alone, so equal
    strings are sampled at the same places, about two in ``least - GRAM + 2`` positions."""
    width = least - GRAM + 1
    h = gram_hashes(buf)
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    low = _sliding(h, width, np.minimum)
    ends = np.cumsum(lengths)
    inside = np.zeros(len(buf) + 1, np.int32)
    long = lengths >= least
    np.add.at(inside, (ends - lengths)[long], 1)
    np.add.at(inside, (ends - least + 1)[long], -1)
    ok = np.cumsum(inside[: len(low)]) > 0  # a string of the least length begins here, within one text
    low = np.where(ok, low, _U(0))
    padded = np.concatenate([np.zeros(width - 1, _U), low, np.zeros(width - 1, _U)])
    at = np.flatnonzero(_sliding(padded, width, np.maximum)[: len(h)] == h)
    return at, h[at]


# --- Sorted runs -----------------------------------------------------------------------------


class Run:
    """A sorted run of fixed-width keys: distinct keys, their common prefixes with the one before,
    and the (id, position) pairs of each."""

    def __init__(self, keys: np.ndarray, lcp: np.ndarray, starts: np.ndarray, ids: np.ndarray, pos: np.ndarray):
        self.keys, self.lcp, self.starts, self.ids, self.pos = keys, lcp, starts, ids, pos


def _words(keys: np.ndarray) -> np.ndarray:
    """Keys as big-endian 64-bit words, word by word: (words, n)."""
    n, k = keys.shape
    wide = np.zeros((n, -(-k // 8) * 8), np.uint8)
    wide[:, :k] = keys
    return np.ascontiguousarray(wide.view(">u8").astype(_U).T)


def sort_run(keys: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> Run:
    """Sorts by key; keys that share their first word are ordered by the rest."""
    w = _words(keys)
    order = np.argsort(w[0], kind="stable")
    first = w[0][order]
    tie = np.zeros(len(order), bool)
    same = first[1:] == first[:-1]
    tie[1:] |= same
    tie[:-1] |= same
    at = np.flatnonzero(tie)
    if len(at) and len(w) > 1:
        part = order[at]
        order[at] = part[np.lexsort(tuple(w[k][part] for k in range(len(w) - 1, -1, -1)))]
    keys = keys[order]
    lcp = common(keys[:-1], keys[1:])
    fresh = np.concatenate([[0], lcp]) < keys.shape[1] if len(keys) else np.zeros(0, bool)
    if len(keys):
        fresh[0] = True
    starts = np.flatnonzero(fresh)
    return Run(keys[starts], np.concatenate([[0], lcp])[starts].astype(np.int16) if len(starts) else np.zeros(0, np.int16), starts, ids[order], pos[order])


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows."""
    if not len(a):
        return np.zeros(0, np.int64)
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _planes(x: np.ndarray) -> bytes:
    """An integer array by byte planes, so that unused high bytes vanish in compression."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_run(run: Run) -> bytes:
    """Front coding: each key without the prefix it shares with the one before; ids by a table."""
    k = run.keys.shape[1]
    rest = run.keys.ravel().take(np.flatnonzero((np.arange(k) >= run.lcp[:, None]).ravel()))
    table, index = np.unique(run.ids, return_inverse=True)
    counts = np.diff(np.append(run.starts, len(run.ids))).astype("<u4")
    steps = np.diff(table, prepend=table[:1]).astype("<i8")
    parts = [run.lcp.astype(np.uint8).tobytes(), rest.tobytes(), _planes(counts), _planes(index.astype("<u4")), _planes(run.pos.astype("<u4")), _planes(steps), table[:1].astype("<i8").tobytes()]
    head = np.array([k, *map(len, parts)], "<u4").tobytes()
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack_run(raw: bytes) -> Run:
    head = np.frombuffer(raw, "<u4", 8)
    body, at, parts = zstandard.ZstdDecompressor().decompress(raw[32:], max_output_size=int(head[1:].astype(np.int64).sum())), 0, []
    k = int(head[0])
    for n in head[1:].tolist():
        parts.append(body[at : at + n])
        at += n
    lcp = np.frombuffer(parts[0], np.uint8).astype(np.int16)
    n = len(lcp)
    keys = np.zeros((n, k), np.uint8)
    keys.ravel()[np.flatnonzero((np.arange(k) >= lcp[:, None]).ravel())] = np.frombuffer(parts[1], np.uint8)
    rows = np.arange(n, dtype=np.int32)
    for j in range(k):  # a byte within the shared prefix is that of the last key that spelled it out
        keys[:, j] = keys[:, j].take(np.maximum.accumulate(np.where(lcp <= j, rows, 0)))
    counts = _unplanes(parts[2], "<u4").astype(np.int64)
    steps = _unplanes(parts[5], "<i8")
    table = (np.frombuffer(parts[6], "<i8")[0] + np.cumsum(steps)) if len(steps) else steps
    return Run(keys, lcp, np.cumsum(counts) - counts, table[_unplanes(parts[3], "<u4")], _unplanes(parts[4], "<u4").astype(np.int64))


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit words that aren't 0, by halving."""
    small = x < _U(1 << 32)
    out = small * np.int16(4)
    x = np.where(small, x, x >> _U(32))
    small = x < _U(1 << 16)
    out += small * np.int16(2)
    return out + (np.where(small, x, x >> _U(16)) < _U(1 << 8))


def merge_runs(runs: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """Merges sorted runs with loser trees that know common prefixes.

    Returns, in key order, indices into the runs' keys laid end to end, and the common prefix
    of each key with the one before. The key space is split into lanes at sampled keys, and the
    lanes' loser trees play in step, one array operation a move. A candidate and a stored loser
    are compared by their common prefixes with the last winner alone; only if those are
    equal are bytes looked at, from there on, so no known prefix is compared again.
    """
    k = runs[0].keys.shape[1]
    n = sum(len(r.keys) for r in runs)
    keys = np.concatenate([r.keys for r in runs])
    own = np.concatenate([r.lcp for r in runs])
    if len(runs) == 1 or not n:
        return np.arange(n), own
    w = _words(keys)
    flat = w.ravel()
    text = [np.ascontiguousarray(r.keys).view(f"V{k}").ravel() for r in runs]
    lanes = max(1, min(8192, n // 160))
    sample = np.sort(np.ascontiguousarray(keys[:: max(1, n // (8 * lanes))]).view(f"S{k}").ravel())
    cuts = sample[(np.arange(1, lanes) * len(sample)) // lanes]
    cuts = np.unique(cuts)
    lanes = len(cuts) + 1
    leaves = 1 << (len(runs) - 1).bit_length()
    cur, end, at = np.zeros((lanes, leaves), np.int64), np.zeros((lanes, leaves), np.int64), 0
    for r, t in enumerate(text):
        edges = np.concatenate([[0], np.searchsorted(t.view(f"S{k}"), cuts, "left"), [len(t)]])
        cur[:, r], end[:, r] = edges[:-1] + at, edges[1:] + at
        at += len(t)
    total = (end - cur).sum(1)

    def play(c_run, c_lcp, s_run, s_lcp, lane):
        """Winner and loser of candidates against stored losers, with their common prefixes."""
        win = c_lcp >= s_lcp
        c_lcp, s_lcp = c_lcp.copy(), s_lcp.copy()
        even = np.flatnonzero((c_lcp == s_lcp) & (c_lcp >= 0))
        if len(even):
            a, b = cur[lane[even], c_run[even]], cur[lane[even], s_run[even]]
            word = (c_lcp[even] >> 3).astype(np.int64)
            left = np.arange(len(even))
            got, less = np.full(len(even), k, np.int16), np.ones(len(even), bool)
            while len(left):
                x, y = flat[word[left] * n + a[left]], flat[word[left] * n + b[left]]
                hit = x != y
                f = left[hit]
                less[f] = x[hit] < y[hit]
                got[f] = (word[f] * 8).astype(np.int16) + _shared_bytes(x[hit] ^ y[hit])
                left = left[~hit]
                word[left] += 1
                left = left[word[left] < len(w)]
            got = np.minimum(got, k)
            win[even] = less
            s_lcp[even[less]], c_lcp[even[~less]] = got[less], got[~less]
        return (
            np.where(win, c_run, s_run), np.where(win, c_lcp, s_lcp),
            np.where(win, s_run, c_run), np.where(win, s_lcp, c_lcp),
        )

    lane = np.arange(lanes)
    loser_run, loser_lcp = np.zeros((lanes, leaves), np.int16), np.zeros((lanes, leaves), np.int16)
    now_run = np.tile(np.arange(leaves, dtype=np.int16), (lanes, 1))
    now_lcp = np.where(cur < end, 0, -1).astype(np.int16)
    size = leaves
    while size > 1:  # the first tournament, level by level
        half = size // 2
        who = np.repeat(lane, half)
        a, b, c, d = play(now_run[:, 0::2].ravel(), now_lcp[:, 0::2].ravel(), now_run[:, 1::2].ravel(), now_lcp[:, 1::2].ravel(), who)
        loser_run[:, half:size], loser_lcp[:, half:size] = c.reshape(lanes, half), d.reshape(lanes, half)
        now_run, now_lcp, size = a.reshape(lanes, half), b.reshape(lanes, half), half
    win_run, win_lcp = now_run[:, 0], now_lcp[:, 0]
    out_at, out_lcp = np.zeros(n, np.int64), np.zeros(n, np.int16)
    place = np.cumsum(total) - total
    alive = np.flatnonzero(total > 0)
    left = total[alive]
    win_run, win_lcp = win_run[alive].astype(np.int64), win_lcp[alive]
    levels = leaves.bit_length() - 1
    while len(alive):
        here = cur[alive, win_run]
        out_at[place[alive]], out_lcp[place[alive]] = here, win_lcp
        place[alive] += 1
        left = left - 1
        if not left.all():
            go = left > 0
            alive, left, win_run, here = alive[go], left[go], win_run[go], here[go]
            if not len(alive):
                break
        nxt = here + 1
        cur[alive, win_run] = nxt
        c_run = win_run.astype(np.int16)
        c_lcp = np.where(nxt < end[alive, win_run], own[np.minimum(nxt, n - 1)], -1).astype(np.int16)
        node = (win_run + leaves) >> 1
        for _ in range(levels):
            s_run, s_lcp = loser_run[alive, node], loser_lcp[alive, node]
            c_run, c_lcp, loser_run[alive, node], loser_lcp[alive, node] = play(c_run, c_lcp, s_run, s_lcp, alive)
            node >>= 1
        win_run, win_lcp = c_run.astype(np.int64), c_lcp
    first = (np.cumsum(total) - total)[total > 0]
    if len(first) > 1:  # lanes begin without a known prefix
        f = first[1:]
        out_lcp[f] = common(keys[out_at[f - 1]], keys[out_at[f]])
    return out_at, out_lcp


# --- The three steps -------------------------------------------------------------------------


def _concat(texts: list) -> tuple[np.ndarray, np.ndarray]:
    raw = [("" if x is None else x).encode("utf-8", "surrogatepass") for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


#: Ranges of suffixes at most, which bounds the cuts that the driver draws; beyond, a range is dealt by a hash of the gram.
MAX_RANGES = 4096


class Deal:
    """Which task a suffix goes to: ranges of the sorted order between sampled cuts, and hot grams over several tasks.

    Buckets from 0 on are ranges, in the order of the suffixes (each dealt by a hash of the gram if there
    are more than ``MAX_RANGES``). A gram that fills more than half a bucket in the sample is hot:
    its suffixes go to buckets below 0 by a hash of the text's id, as many as its share asks for.
    """

    def __init__(self, keys: list[bytes], buckets: int):
        ranges = min(buckets, MAX_RANGES)
        self.sub = -(-buckets // ranges)
        drawn = np.sort(np.array(keys, f"S{GRAM}"))
        cuts = drawn[np.arange(1, ranges) * len(drawn) // ranges] if len(drawn) else drawn
        self.cuts = np.unique(cuts)
        distinct, n = np.unique(drawn, return_counts=True)
        often = n > max(3, len(drawn) / (2 * buckets))
        self.hot = distinct[often]
        self.parts = 2 + np.ceil(n[often] / max(1, len(drawn)) * buckets * 2).astype(np.int64)
        self.first = np.cumsum(self.parts) - self.parts

    def __call__(self, keys: np.ndarray, gram_hash: np.ndarray, ids: np.ndarray) -> np.ndarray:
        gram = np.ascontiguousarray(keys[:, :GRAM]).view(f"S{GRAM}").ravel()
        out = np.searchsorted(self.cuts, gram, "right") * self.sub
        if self.sub > 1:
            out = out + (gram_hash % _U(self.sub)).astype(np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, gram), len(self.hot) - 1)
            own = np.flatnonzero(self.hot[at] == gram)
            part = (_mix(ids[own].astype(np.int64).view(_U) + _U(1)) % self.parts[at[own]].astype(_U)).astype(np.int64)
            out[own] = -1 - self.first[at[own]] - part
        return out


def _by_bucket(keys, gram_hash, ids, pos, deal: Deal) -> Iterator[tuple[int, bytes]]:
    """One packed run per bucket."""
    bucket = deal(keys, gram_hash, ids)
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, int)
    for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(ordered)], strict=True):
        part = order[lo:hi]
        yield int(ordered[lo]), pack_run(sort_run(keys[part], ids[part], pos[part]))


def _to_texts(ids: np.ndarray, columns: list[np.ndarray], groups: int) -> Iterator[tuple[int, bytes]]:
    """Results sorted into the groups of texts they belong to, packed."""
    dest = ids % groups
    order = np.argsort(dest, kind="stable")
    edges = np.searchsorted(dest[order], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(edges)).tolist():
        part = order[edges[g] : edges[g + 1]]
        raw = [_planes(ids[part].astype("<i8"))] + [_planes(c[part].astype("<u4")) for c in columns]
        yield g, np.array([len(part)], "<u4").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _from_blobs(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in range(columns + 1)]
    for raw in blobs:
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        body = zstandard.ZstdDecompressor().decompress(raw[4:], max_output_size=n * (8 + 4 * columns))
        parts[0].append(_unplanes(body[: 8 * n], "<i8"))
        for k in range(columns):
            parts[k + 1].append(_unplanes(body[8 * n + 4 * n * k : 8 * n + 4 * n * (k + 1)], "<u4").astype(np.int64))
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


def _occurrences(runs: list[Run]):
    """All (id, position) pairs and, per distinct key of a run, where its pairs begin and how many they are."""
    ids, pos = np.concatenate([r.ids for r in runs]), np.concatenate([r.pos for r in runs])
    base = np.cumsum([0] + [len(r.ids) for r in runs[:-1]])
    starts = np.concatenate([r.starts + b for r, b in zip(runs, base, strict=True)])
    return ids, pos, starts, np.diff(np.append(starts, len(ids)))


def _repeat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _places(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How a group's rows (id, text) are told apart: ids, one row for each id and text in order, each row's first equal, and where its text begins.

    The distinct texts of an id count as laid end to end in byte order, so a position in them names one text, whichever task asks.
    """
    column = texts["id"].combine_chunks()
    real = column.is_valid().to_numpy(zero_copy_only=False)
    own, first, base = column.fill_null(0).to_numpy(zero_copy_only=False), np.arange(len(column)), np.zeros(len(column), np.int64)
    order = np.flatnonzero(real)
    order = order[np.argsort(own[order], kind="stable")]
    heads = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]])) if len(order) else order
    size = np.diff(np.append(heads, len(order)))
    for a, k in zip(heads[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        words = {r: (texts["text"][r].as_py() or "").encode("utf-8", "surrogatepass") for r in order[a : a + k].tolist()}
        seen: dict[bytes, int] = {}
        at = 0
        for r in sorted(words, key=words.__getitem__):
            if words[r] not in seen:
                seen[words[r]], base[r] = r, at
                at += len(words[r])
            first[r] = seen[words[r]]
            base[r] = base[first[r]]
    first[~real] = -1
    lead = np.flatnonzero(first == np.arange(len(first)))
    return own, lead[np.lexsort((base[lead], own[lead]))], first, base


def repeated_grams(runs: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, positions) of the samples whose gram occurs in two documents or more."""
    at, lcp = merge_runs(runs)
    ids, pos, starts, counts = _occurrences(runs)
    low, high = np.minimum.reduceat(ids, starts)[at], np.maximum.reduceat(ids, starts)[at]
    heads = np.flatnonzero(np.concatenate([[True], lcp[1:] < GRAM]))
    several = np.minimum.reduceat(low, heads) < np.maximum.reduceat(high, heads)
    size = np.diff(np.append(heads, len(at)))
    keep = at[np.repeat(several, size)]
    rows = _repeat_ranges(starts[keep], counts[keep])
    return ids[rows], pos[rows]


class Surroundings:
    """The distinct surroundings of samples in merged runs: gram, what follows, what precedes (backwards), and
    the bounds the text's ends set; with the least id of each, and per string around a sample the
    least id that holds it. Bit l stands for the string that begins l bytes before the sample."""

    def __init__(self, runs: list[Run], least: int):
        self.least, self.reach = least, least - GRAM
        at, lcp = merge_runs(runs)
        keys = np.concatenate([r.keys for r in runs])
        self.ids, self.pos, starts, self.counts = _occurrences(runs)
        low = np.minimum.reduceat(self.ids, starts)[at]
        fresh = np.concatenate([[True], lcp[1:] < keys.shape[1]])
        heads = np.flatnonzero(fresh)  # distinct surroundings over all runs
        which = np.cumsum(fresh) - 1
        self.owner = which[np.argsort(at, kind="stable")]  # distinct surroundings of each run's key
        self.least_id = np.minimum.reduceat(low, heads)
        self.around = keys[at[heads]]
        self.group = np.cumsum(np.concatenate([[True], lcp[heads][1:] < GRAM])) - 1
        self.lo, self.hi = self.around[:, -2].astype(np.int64), self.around[:, -1].astype(np.int64)
        self.best = np.repeat(self.least_id[:, None], self.reach + 1, 1)
        many = np.flatnonzero(np.bincount(self.group)[self.group] > 1)
        for part in _whole_groups(many, self.group[many], 60_000):
            self.best[part] = _least_per_window(self.around[part], self.group[part], self.least_id[part], self.lo[part], self.hi[part], least)

    def codes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(surroundings, bit, code, code): 128 bits for each string that lies within its text."""
        line = _line(self.around, self.reach)
        bits = np.arange(self.reach + 1)
        i, b = np.nonzero((self.lo[:, None] <= bits) & (bits <= self.hi[:, None]))
        two = []
        for seed in (1, 2):
            prefix, power = _prefixes(line, self.least, seed)
            start = self.reach - b
            two.append(_mix(prefix[start + self.least, i] - prefix[start, i] * power))
        return i, b, *two

    def windows(self) -> list[np.ndarray]:
        """Distinct strings by code, with the least id here that holds them."""
        i, b, c, d = self.codes()
        order = np.lexsort((self.best[i, b], d, c))
        c, d, low = c[order], d[order], self.best[i, b][order]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])]) if len(c) else np.zeros(0, bool)
        return [c[new].view(np.int64), d[new].view(np.int64), low[new]]

    def learn(self, c: np.ndarray, d: np.ndarray, low: np.ndarray) -> None:
        """Takes in least ids that other tasks hold for strings by code."""
        if not len(c):
            return
        order = np.lexsort((d.view(_U), c.view(_U)))
        c, d, low = c.view(_U)[order], d.view(_U)[order], low[order]
        i, b, mine, too = self.codes()
        at = np.searchsorted(c, mine)
        for step in range(2):  # two strings may share their first 64 bits
            k = np.minimum(at + step, len(c) - 1)
            hit = (c[k] == mine) & (d[k] == too)
            self.best[i[hit], b[hit]] = np.minimum(self.best[i[hit], b[hit]], low[k[hit]])

    def removed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, positions, masks): which of the strings around each sample also start in a smaller id."""
        who = np.repeat(self.owner, self.counts)
        mask = np.zeros(len(self.ids), np.int64)
        for bit in range(self.reach + 1):
            mask |= ((self.best[who, bit] < self.ids) & (self.lo[who] <= bit) & (bit <= self.hi[who])).astype(np.int64) << bit
        hit = np.flatnonzero(mask)
        return self.ids[hit], self.pos[hit], mask[hit]


def removed_windows(runs: list[Run], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return Surroundings(runs, least).removed()


def _line(around: np.ndarray, reach: int) -> np.ndarray:
    """Surroundings in the order of the text."""
    return np.concatenate([around[:, GRAM + reach : GRAM + 2 * reach][:, ::-1], around[:, : GRAM + reach]], 1)


def _prefixes(line: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.uint64]:
    """Polynomial hashes of all prefixes of each line: (length + 1, n), and the weight of a string's first byte."""
    base = (0x9E3779B97F4A7C15 * (2 * seed - 1) & (1 << 64) - 1) | 1
    table = _mix(np.arange(1, 257, dtype=_U) * _U(base) + _U(seed - 1))
    prefix = np.zeros((line.shape[1] + 1, len(line)), _U)
    for j in range(line.shape[1]):
        prefix[j + 1] = prefix[j] * _U(base) + table[line[:, j]]
    return prefix, _U(pow(base, least, 1 << 64))


def _whole_groups(rows: np.ndarray, group: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Parts of about ``most`` rows that end between groups."""
    at = 0
    while at < len(rows):
        end = min(len(rows), at + most)
        if end < len(rows):
            end = int(np.searchsorted(group, group[end - 1], "right"))
        yield rows[at:end]
        at = end


def _least_per_window(around, group, least_id, lo, hi, least: int) -> np.ndarray:
    """The least id per surroundings and string, over all surroundings of the group that hold the string."""
    reach, n = least - GRAM, len(around)
    line = _line(around, reach)
    prefix, power = _prefixes(line, least, 1)
    salt = _mix(group.astype(_U) + _U(1))
    bits = np.arange(reach + 1)
    start = reach - bits
    code = _mix((prefix[start + least] - prefix[start] * power) ^ salt)  # (bit, n)
    valid = (lo <= bits[:, None]) & (bits[:, None] <= hi)
    out = np.repeat(least_id[:, None], reach + 1, 1)
    b, i = np.nonzero(valid)
    order = np.lexsort((least_id[i], code[b, i] + b.astype(_U)))
    b, i = b[order], i[order]
    c = code[b, i] + b.astype(_U)
    if not len(c):
        return out
    head = np.maximum.accumulate(np.where(np.concatenate([[True], c[1:] != c[:-1]]), np.arange(len(c)), 0))
    other = i[head]
    change = np.flatnonzero(least_id[other] < least_id[i])
    for s in range(0, len(change), 200_000):  # equal hashes are taken on trust nowhere
        part = change[s : s + 200_000]
        span = (reach - b[part])[:, None] + np.arange(least)
        same = (line[i[part][:, None], span] == line[other[part][:, None], span]).all(1)
        ok = part[same]
        out[i[ok], b[ok]] = least_id[other[ok]]
    return out


def drawn_grams(base: DataFrame, least: int, wanted: int, total: int) -> list[bytes]:
    """About ``wanted`` grams of samples, from texts drawn by a hash of the id; one in eight of a text's samples counts."""
    chance = min(1.0, 192.0 * wanted / max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                buf, n = _concat(part.column(1).to_pylist())
                at, h = anchors(buf, n, least)
                at = at[_mix(h + at.astype(_U)) % _U(8) == 0]
                keys = np.lib.stride_tricks.sliding_window_view(buf, GRAM)[at] if len(at) else np.zeros((0, GRAM), np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary())], ["gram"])

    drawn = base.filter(hash_unit(F.col("id"), seed="cuts") < chance).mapInArrow(run, "gram binary")
    return [bytes(r["gram"]) for r in drawn.orderBy(F.xxhash64("gram", F.lit(7)), "gram").limit(4 * wanted).collect()]


def repeated_strings(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 50,
    run_samples: int = 1_500_000,
    group_bytes: int = 8_000_000,
    bucket_bytes: int = 16_000_000,
) -> DataFrame:
    """Removes every byte covered by a ``least``-byte string that also starts in a smaller id.

    Returns the id, n_bytes, n_removed, n_spans and kept_sha256 (of the bytes that remain). Texts
    are UTF-8; strings lie within one text and are judged on the input. Three exchanges:

    1. Suffixes are sampled where, within some string of ``least`` bytes, a gram of 20 bytes has the
       least hash; equal strings are sampled alike. Tasks send sorted, front-coded runs of the
       samples to ranges of their order, cut at a sample of suffixes so that a range holds those of some ``bucket_bytes``; loser
       trees merge a range's runs, and grams found in two documents go on.
    2. The surroundings of those samples (all strings of ``least`` bytes around them) are
       sorted and merged in the same way; equal surroundings count once, with their least id.
       Strings of different surroundings of one gram are matched among those alone.
    3. Each text gets a mask of strings per sample, removes what they cover and is hashed.

    A gram too frequent for one range skips the first merge and is dealt over several tasks by id;
    these tell each other the least id per string (by 128 bits of hash, distinct strings only) before they decide.
    Runs hold at most ``run_samples`` samples, texts are handled in groups of about
    ``group_bytes``; copies cost a pair of numbers each, never a pair of documents.

    Edge cases: null text counts as empty; texts shorter than ``least`` stay whole; rows with null
    id stay whole and cause no removal; rows that share an id never cause removal in one
    another, whether their texts are equal or not, and count each for larger ids; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    reach = least - GRAM
    if not 0 < reach < 32:
        raise ValueError("strings must have 21 to 51 bytes")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total / bucket_bytes), 1)
    deal = Deal(drawn_grams(base.filter("id is not null"), least, 64 * min(buckets, MAX_RANGES), total), buckets)
    groups = _prime(max(2, int(total / group_bytes)))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("suffixes")
        held, count = [], 0

        def flush():
            keys, h, ids, pos = (np.concatenate(c) for c in zip(*held, strict=True))
            rows = list(_by_bucket(keys, h, ids, pos, deal))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "run"])

        for batch in batches:
            ids_all, texts_all = batch.column(0), batch.column(1).to_pylist()
            ids_np = ids_all.fill_null(0).to_numpy(zero_copy_only=False)
            real = np.array([v is not None for v in ids_all.to_pylist()], bool)
            i = 0
            while i < len(texts_all):
                j, size = i, 0
                while j < len(texts_all) and size < 3_000_000:
                    size += len(texts_all[j] or "")
                    j += 1
                buf, n = _concat([x if ok else None for x, ok in zip(texts_all[i:j], real[i:j], strict=True)])
                at, h = anchors(buf, n, least)
                if len(at):
                    ends = np.cumsum(n)
                    doc = np.searchsorted(ends, at, "right")
                    keys = np.lib.stride_tricks.sliding_window_view(buf, GRAM)[at]
                    held.append((keys, h, ids_np[i:j][doc], at - (ends - n)[doc]))
                    count += len(at)
                if count >= run_samples:
                    yield flush()
                    held, count = [], 0
                i = j
        if held:
            yield flush()

    def repeats(key, rows):
        trim()
        runs = [unpack_run(x) for x in rows["run"].to_pylist()]
        ids, pos = repeated_grams(runs) if key[0].as_py() >= 0 else _occurrences(runs)[:2]
        out = list(_to_texts(ids, [pos], groups))
        return pa.table({"dest": pa.array([r[0] for r in out], pa.int32()), "found": pa.array([r[1] for r in out], pa.binary())})

    def surround(key, texts, found):
        trim()
        ids, pos = _from_blobs(found["found"].to_pylist(), 1)
        out: list[tuple[int, bytes]] = []
        if len(ids) and texts.num_rows:
            buf, n = _concat(texts["text"].to_pylist())
            own, order, _, base_at = _places(texts)
            lo, hi = np.searchsorted(own[order], ids, "left"), np.searchsorted(own[order], ids, "right")
            row, several = order[_repeat_ranges(lo, hi - lo)], np.repeat(hi - lo > 1, hi - lo)
            ids, pos = np.repeat(ids, hi - lo), np.repeat(pos, hi - lo)
            ok = pos + GRAM <= n[row]
            if several.any():  # which of the id's texts a sample is from isn't told, but each text's own samples are known
                some = np.unique(row[several])
                part = np.concatenate([buf[a : a + k] for a, k in zip((np.cumsum(n) - n)[some], n[some], strict=True)])
                at, _ = anchors(part, n[some], least)
                ends = np.cumsum(n[some])
                of = np.searchsorted(ends, at, "right")
                ok &= ~several | np.isin(row * (1 << 33) + pos, some[of] * (1 << 33) + at - (ends - n[some])[of])
            ids, pos, row = ids[ok], pos[ok], row[ok]
            start = (np.cumsum(n) - n)[row]
            padded = np.concatenate([np.zeros(reach, np.uint8), buf, np.zeros(least, np.uint8)])
            view = np.lib.stride_tricks.sliding_window_view(padded, least + reach)
            for s in range(0, len(ids), 300_000):
                part = slice(s, s + 300_000)
                p, length = pos[part], n[row[part]]
                line = view[start[part] + p].copy()
                offset = p[:, None] - reach + np.arange(least + reach)
                line[(offset < 0) | (offset >= length[:, None])] = 0
                lo, hi = np.maximum(0, p + least - length), np.minimum(reach, p)
                keys = np.concatenate([line[:, reach:], line[:, :reach][:, ::-1], lo[:, None].astype(np.uint8), hi[:, None].astype(np.uint8)], 1)
                fit = lo <= hi
                gram = np.ascontiguousarray(line[:, reach : reach + GRAM])
                h = gram_hashes(gram.ravel())[::GRAM]
                out += _by_bucket(keys[fit], h[fit], ids[part][fit], (p + base_at[row[part]])[fit], deal)
        return pa.table({"bucket": pa.array([r[0] for r in out], pa.int64()), "run": pa.array([r[1] for r in out], pa.binary())})

    def found_table(ids, pos, mask):
        out = list(_to_texts(ids, [pos, mask], groups))
        return {"dest": pa.array([r[0] for r in out], pa.int32()), "found": pa.array([r[1] for r in out], pa.binary())}

    def decide(key, rows):
        """Masks of a range; of a hot gram's task its runs and what it knows of its strings."""
        trim()
        runs = rows["run"].to_pylist()
        if key[0].as_py() >= 0:
            out = found_table(*removed_windows([unpack_run(x) for x in runs], least))
            return pa.table(out | {"bucket": pa.nulls(len(out["dest"]), pa.int64()), "run": pa.nulls(len(out["dest"]), pa.binary())})
        told = Surroundings([unpack_run(x) for x in runs], least).windows()
        own = [None] * len(runs)
        blob = np.stack(told).astype("<i8").tobytes()
        return pa.table({"dest": pa.array([*own, None], pa.int32()), "found": pa.array([*own, blob], pa.binary()), "bucket": pa.array([key[0].as_py()] * (len(runs) + 1), pa.int64()), "run": pa.array([*runs, None], pa.binary())})

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c, d, low = np.frombuffer(batch.column(1)[k].as_buffer(), "<i8").reshape(3, -1)
                for at in range(0, len(c), 100_000):
                    part = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c[part]), batch.column(0)[k].as_py()), pa.int64()), pa.array(c[part]), pa.array(d[part]), pa.array(low[part])], ["bucket", "c", "d", "low"])

    def decide_hot(key, rows, known):
        if not rows.num_rows:
            return pa.table({"dest": pa.array([], pa.int32()), "found": pa.array([], pa.binary())})
        s = Surroundings([unpack_run(x) for x in rows["run"].to_pylist()], least)
        s.learn(*[np.ascontiguousarray(known[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)) for c in ("c", "d", "low")])
        return pa.table(found_table(*s.removed()))

    def cut(key, texts, found):
        trim()
        ids, pos, mask = _from_blobs(found["found"].to_pylist(), 2)
        buf, n = _concat(texts["text"].to_pylist())
        own, order, first, base_at = _places(texts)
        starts = np.cumsum(n) - n
        change = np.zeros(len(buf) + least + 1, np.int32)
        if len(ids) and len(order):
            known, place = np.unique(own[order], return_inverse=True)
            of = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            at = np.searchsorted(place * (1 << 33) + base_at[order], of * (1 << 33) + pos, "right") - 1
            ok = known[of] == ids
            lead, pos, mask = order[at[ok]], pos[ok], mask[ok]
            pos = pos - base_at[lead]
            copies = np.argsort(first, kind="stable")
            lo, hi = np.searchsorted(first[copies], lead, "left"), np.searchsorted(first[copies], lead, "right")
            row = copies[_repeat_ranges(lo, hi - lo)]  # rows that share id and text all get its masks
            pos, mask = np.repeat(pos, hi - lo), np.repeat(mask, hi - lo)
            begins = []
            for bit in range(reach + 1):
                on = np.flatnonzero(mask >> bit & 1)
                at = pos[on] - bit
                fit = (at >= 0) & (at + least <= n[row[on]])
                begins.append(starts[row[on]][fit] + at[fit])
            at = np.concatenate(begins)
            change += np.bincount(at, minlength=len(change)).astype(np.int32)
            change -= np.bincount(at + least, minlength=len(change)).astype(np.int32)
        gone = np.cumsum(change)[: len(buf)] > 0
        kept = buf.take(np.flatnonzero(~gone)).tobytes()
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[starts + n] - before[starts]
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        inner = starts[(n > 0) & (starts > 0)]
        rise[inner] = gone[inner]
        rises = np.concatenate([[0], np.cumsum(rise)])
        spans = rises[starts + n] - rises[starts]
        at, sums = 0, []
        for k in (n - removed).tolist():
            sums.append(hashlib.sha256(kept[at : at + k]).hexdigest())
            at += k
        return pa.table({"id": texts["id"], "n_bytes": pa.array(n), "n_removed": pa.array(removed.astype(np.int64)), "n_spans": pa.array(spans.astype(np.int64)), "kept_sha256": pa.array(sums, pa.string())})

    dest = F.coalesce(F.pmod(F.col("id"), F.lit(groups)), F.pmod(F.xxhash64("text"), F.lit(groups))).cast("int")
    by_dest = base.withColumn("dest", dest).groupBy("dest")
    with batch_rows(spark, 2000):
        runs = base.mapInArrow(sample, "bucket long, run binary")
        first = materialise(runs.groupBy("bucket").applyInArrow(repeats, "dest int, found binary"), "repeats")
        second = by_dest.cogroup(first.groupBy("dest")).applyInArrow(surround, "bucket long, run binary")
        masks = second.groupBy("bucket").applyInArrow(decide, "dest int, found binary, bucket long, run binary")
        masks = materialise(masks, "masks")  # with or without hot grams, so that every size takes one path
        plain = masks.filter("dest is not null").select("dest", "found")
        if len(deal.hot):
            strings = masks.filter("bucket is not null and run is null").select("bucket", "found").mapInArrow(told, "bucket long, c long, d long, low long")
            strings = materialise(strings, "strings")
            lowest = strings.groupBy("c", "d").agg(F.min("low").alias("m"), F.max("low").alias("most")).filter("m < most").select("c", "d", "m")
            news = strings.join(lowest, ["c", "d"]).filter("m < low").select("bucket", "c", "d", F.col("m").alias("low"))
            hot = masks.filter("run is not null").select("bucket", "run").groupBy("bucket").cogroup(news.groupBy("bucket"))
            plain = plain.unionByName(hot.applyInArrow(decide_hot, "dest int, found binary"))
        done = by_dest.cogroup(plain.groupBy("dest")).applyInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        done = materialise(done, "kept")
    return done.withColumnRenamed("id", id_col)
