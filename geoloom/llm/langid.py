"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import batch_rows, hash_unit, keeps, settle, texts_of

#: Symbols of a text that one lane walks; what a lane enters with is set right afterwards.
SEGMENT = 1024
#: Bytes that all dense transition tables may take together; rarer letters' transitions are kept as sorted edges.
DENSE_BYTES = 100_000_000
#: Letters of a language that the dense table has columns for, where the bytes suffice.
DENSE_LETTERS = 64
#: So few lanes are walked one by one.
FEW_LANES = 48
GAP, UNKNOWN = 0, 1
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x10000)]))
    return _LETTERS[0]


class SuffixAutomaton:
    """The smallest automaton of all substrings of a sequence of symbols."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new


class Walk:
    """The greedy longest-match parse as a transition function, for one language.

    Where a match can't go on, its phrase ends and the symbol begins the next; a symbol
    that the sample lacks is a phrase by itself. The sample's most frequent letters have a column each in a
    dense table, all letters that it lacks share one, and transitions by its other letters are
    sorted edges: so memory grows with the sample and not with its alphabet.
    """

    def __init__(self, symbols: list[int], alphabet: int, letters: int):
        counts = np.bincount(np.array(symbols, np.int64), minlength=alphabet)
        own = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
        dense, rare = own[:letters], own[letters:]
        self.width = len(dense) + 1
        #: Column of each symbol; rare letters are numbered from ``width`` on.
        self.column = np.full(alphabet, len(dense), np.int32)
        self.column[dense] = np.arange(len(dense))
        self.column[rare] = self.width + np.arange(len(rare))
        automaton = SuffixAutomaton(symbols)
        root = np.full(self.width + len(rare), 1 << 29, np.int64)
        for c, q in automaton.next[0].items():
            root[self.column[c]] = q
        ended = np.where(root >> 29, 2 << 29, root | 1 << 29)
        self.root, self.ended = root, ended
        table = np.empty((len(automaton.next), self.width), np.int32)
        table[:] = ended[: self.width]
        table[0] = root[: self.width]
        edges = []
        for p, moves in enumerate(automaton.next):
            for c, q in moves.items():
                k = int(self.column[c])
                if k < self.width:
                    table[p, k] = q
                else:
                    edges.append((p * len(root) + k, q))
        self.table = table
        edges.sort()
        self.edge_from = np.array([e for e, _ in edges], np.int64)
        self.edge_to = np.array([q for _, q in edges], np.int64)

    def rare(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Transitions by letters without a column."""
        key = state * len(self.root) + column
        at = np.minimum(np.searchsorted(self.edge_from, key), len(self.edge_from) - 1)
        return np.where(self.edge_from[at] == key, self.edge_to[at], np.where(state > 0, self.ended[column], self.root[column]))


class CrossParser:
    """Parses texts against one automaton per language, all lanes in step.

    With ``literals`` a phrase may also be a letter of the alphabet that the sample lacks, and
    is paid for as such: however short a sample, no phrase is cheaper than a letter.
    """

    def __init__(self, samples: dict[str, str], literals: bool = False):
        self.languages = sorted(samples)
        seen = sorted({c for x in samples.values() for c in x.lower() if c.isalpha() and ord(c) < 0x10000})
        index = {c: k + 2 for k, c in enumerate(seen)}
        table = np.zeros(0x10000, np.int32)
        table[_letters()] = UNKNOWN
        for c in np.nonzero(_letters())[0].tolist():
            k = index.get(chr(c).lower()[0])
            if k:
                table[c] = k
        self.table, self.alphabet = table, len(seen) + 2
        codes = {lang: self.symbols([samples[lang]])[0].tolist() for lang in self.languages}
        states = sum(2 * len(x) for x in codes.values())
        letters = max(4, min(DENSE_LETTERS, DENSE_BYTES // (4 * max(states, 1)) - 1))
        self.walks = [Walk(codes[lang], self.alphabet, letters) for lang in self.languages]
        self.weight = [np.log2(max(len(codes[lang]), 2) + (self.alphabet if literals else 0)) for lang in self.languages]
        self.moves = np.concatenate([w.table.ravel() for w in self.walks]) if self.walks else np.zeros(0, np.int32)
        sizes = np.array([w.table.size for w in self.walks], np.int64)
        self.base, self.width = np.cumsum(sizes) - sizes, np.array([w.width for w in self.walks], np.int64)
        self.sparse = any(len(w.edge_from) for w in self.walks)
        for w in self.walks:
            del w.table

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters in lower case, runs of anything else as one gap; and symbols per text."""
        n = np.array([len(x) for x in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.table[np.minimum(points, 0xFFFF)]
        high = np.nonzero(points > 0xFFFF)[0]
        codes[high] = [UNKNOWN if chr(points[i]).isalpha() else GAP for i in high]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)
        keep[(np.cumsum(n) - n)[n > 0]] = True
        total = np.concatenate([[0], np.cumsum(keep)])
        ends = np.cumsum(n)
        return codes[keep], total[ends] - total[ends - n]

    def _first_walk(self, columns: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End states and phrases ended of all segments (``count`` descending) from the root, per language."""
        state, ended = (np.zeros((len(columns), len(at)), np.int64) for _ in range(2))
        active = len(at) - np.searchsorted(count[::-1], np.arange(count[0]), side="right")
        base, width = self.base[:, None], self.width[:, None]
        for t, k in enumerate(active.tolist()):
            column = columns[:, at[:k] + t]
            if self.sparse:
                lane = np.repeat(np.arange(len(columns)), k)
                got = self._move(lane, state[:, :k].ravel(), column.ravel()).reshape(column.shape)
            else:
                got = self.moves[base + state[:, :k] * width + column]
            ended[:, :k] += got >> 29
            state[:, :k] = got & ((1 << 29) - 1)
        return state, ended

    def _second_walk(self, columns, lane, at, count, entry, before) -> tuple[np.ndarray, np.ndarray]:
        """Walks lanes (``count`` descending) from ``entry`` beside their walks from ``before`` until both agree.

        Returns the end states, -1 where both agreed, and by how many phrases the walks differ.
        """
        state, other, ended = entry.copy(), before.copy(), np.zeros(len(lane), np.int64)
        out, live, t = np.full(len(lane), -1, np.int64), np.arange(len(lane)), 0
        while len(live):
            k = int(np.searchsorted(-count[live], -t, "left"))  # those with more than t symbols
            out[live[k:]] = state[live[k:]]
            live = live[:k]
            if k <= FEW_LANES:
                for i in live.tolist():
                    out[i], more = self._finish(columns[lane[i], at[i] + t : at[i] + count[i]], int(lane[i]), int(state[i]), int(other[i]))
                    ended[i] += more
                break
            who = lane[live]
            column = columns[who, at[live] + t]
            got, was = self._move(who, state[live], column), self._move(who, other[live], column)
            ended[live] += (got >> 29) - (was >> 29)
            state[live], other[live] = got & ((1 << 29) - 1), was & ((1 << 29) - 1)
            live = live[state[live] != other[live]]
            t += 1
        return out, ended

    def _finish(self, column: np.ndarray, lane: int, state: int, other: int) -> tuple[int, int]:
        """The same for one lane, step by step."""
        base, width, ended, low = int(self.base[lane]), int(self.width[lane]), 0, (1 << 29) - 1
        read, rare = self.moves.item, self.walks[lane].rare
        for c in column.tolist():
            if c < width:
                got, was = read(base + state * width + c), read(base + other * width + c)
            else:
                got, was = rare(np.array([state, other]), c).tolist()
            ended += (got >> 29) - (was >> 29)
            state, other = got & low, was & low
            if state == other:
                return -1, ended
        return state, ended

    def _move(self, lane: np.ndarray, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        width = self.width[lane]
        rare = column >= width
        got = self.moves[self.base[lane] + state * width + np.where(rare, 0, column)].astype(np.int64)
        if self.sparse and rare.any():
            for k in np.unique(lane[rare]).tolist():
                some = np.flatnonzero(rare & (lane == k))
                got[some] = self.walks[k].rare(state[some], column[some])
        return got

    def _phrases(self, codes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Phrases of the greedy parse of each text, whole, by language.

        Texts are cut into segments that walk at once from the root. Then every segment that its
        predecessor enters in another state is walked again beside its first walk until both
        meet, mostly after a few phrases, and so on until all entries are right.
        """
        lanes, parts = len(self.languages), -(-n // SEGMENT)
        doc = np.repeat(np.arange(len(n)), parts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        seg_start, seg_len = starts[doc] + nth * SEGMENT, np.minimum(SEGMENT, n[doc] - nth * SEGMENT)
        size = len(doc)
        if not size or not lanes:
            return np.zeros((lanes, len(n)), np.int64)
        columns = np.stack([w.column[codes] for w in self.walks])
        order = np.argsort(-seg_len, kind="stable")
        end, phrases, entry = (np.zeros((lanes, size), np.int64) for _ in range(3))
        end[:, order], phrases[:, order] = self._first_walk(columns, seg_start[order], seg_len[order])
        follows = np.flatnonzero(nth > 0)
        while len(follows):
            k, j = np.nonzero(end[:, follows - 1] != entry[:, follows])
            if not len(k):
                break
            j = follows[j]
            longest = np.argsort(-seg_len[j], kind="stable")
            k, j = k[longest], j[longest]
            new = end[k, j - 1]
            got, more = self._second_walk(columns, k, seg_start[j], seg_len[j], new, entry[k, j])
            entry[k, j] = new
            phrases[k, j] += more
            open_ = got >= 0
            end[k[open_], j[open_]] = got[open_]
        last = nth == parts[doc] - 1
        phrases[:, last] += end[:, last] > 0
        return np.stack([np.bincount(doc, phrases[k], len(n)) for k in range(lanes)]).astype(np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language whose phrases, times the log of its sample's length, are fewest; its lead over the next."""
        texts = [x or "" for x in texts]
        codes, n = self.symbols(texts)
        starts = np.cumsum(n) - n
        lettered = np.array([np.any(codes[a : a + k] != GAP) for a, k in zip(starts, n, strict=True)], bool)
        lanes = len(self.languages)
        phrases = self._phrases(codes, starts, n)
        cost = np.stack([phrases[k] * self.weight[k] for k in range(lanes)]) if lanes else np.zeros((0, len(texts)))
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if lanes:
            best = np.argmin(cost, 0)
            ranked = np.sort(cost, 0)
            lead = 1 - ranked[0] / np.maximum(ranked[1], 1e-9) if lanes > 1 else np.ones(len(texts))
            for i in np.nonzero(lettered)[0].tolist():
                names[i], score[i] = self.languages[best[i]], lead[i]
        return names, np.clip(score, 0, 1)


_PARSERS: dict[int, CrossParser] = {}
keeps("language", _PARSERS.clear)


def _parser(samples: dict[str, str]) -> CrossParser:
    """The parser of these samples, built once per worker."""
    key = hash(tuple(sorted(samples.items())))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(samples, literals=True)
    return _PARSERS[key]


def fill_samples(rows: Iterator[tuple[str, str]], sample_chars: int) -> Iterator[tuple[str, str]]:
    """Per language of (language, text) rows in a row, the texts that fill ``sample_chars`` in their order.

    A text that no longer fits is passed over for later ones; where these leave room, the starts
    of the passed ones fill it.
    """
    lang, used, held, spare = None, 0, 0, []

    def rest():
        room = sample_chars - used
        for text in spare:
            if room > 1:
                yield lang, text[: room - 1]
                room -= len(text) + 1

    for own, text in rows:
        if own != lang:
            yield from rest()
            lang, used, held, spare = own, 0, 0, []
        if used + len(text) + 1 <= sample_chars:
            used += len(text) + 1
            yield lang, text
        elif held < sample_chars:
            held += len(text) + 1
            spare.append(text)
    yield from rest()


def language_samples(docs: DataFrame, *, fold: int, held_out: int, sample_docs: int, sample_chars: int) -> dict[str, str]:
    """Texts with letters per language, drawn by hash over all rows, up to ``sample_chars`` characters in all.

    Counting first turns the draw into a filter: some ``sample_docs`` texts per language, or as
    many more as hold twice the bound where texts are short. Texts count from their first letter.
    """
    rows = docs.filter(F.col("lang").isNotNull() & (F.crc32(F.col("id").cast("string").cast("binary")) % fold != held_out) & F.col("text").rlike(r"\p{L}"))
    chars = F.sum(F.least(F.length("text"), F.lit(sample_chars)) + 1)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), chars.alias("chars")).collect()
    if not counts:
        return {}
    chance = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, max(sample_docs / r["n"], 2 * sample_chars / r["chars"])))])
    picked = (
        rows.withColumn("u", hash_unit(F.col("id"), seed="language-sample"))
        .filter(F.col("u") < F.element_at(chance, F.col("lang")))
        .select("lang", "u", F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, sample_chars).alias("text"))
        .repartition("lang")
        .sortWithinPartitions("lang", "u", "text")
        .select("lang", "text")
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for k, (lang, text) in enumerate(fill_samples(each, sample_chars)):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([k], pa.int64()), pa.array([text])], ["lang", "k", "text"])

    out: dict[str, list] = {}
    with batch_rows(docs.sparkSession, 256):
        for r in sorted(picked.mapInArrow(fill, "lang string, k long, text string").collect(), key=lambda r: (r["lang"], r["k"])):
            out.setdefault(r["lang"], []).append(r["text"])
    return {k: " ".join(v) for k, v in out.items()}


def identify(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fold: int = 5,
    held_out: int = 0,
    sample_docs: int = 96,
    sample_chars: int = 24_000,
) -> DataFrame:
    """Predicts the language of every whole text: the id, held_out, lang_pred and score.

    Each language's automaton holds at most ``sample_chars`` characters of labelled rows whose
    crc32(id as text) mod ``fold`` is not ``held_out``; it is built in the workers from the
    sample, once per worker. The longest-match parse of a whole text is a walk through a table, in which
    segments of ``SEGMENT`` symbols walk at once and entries are set right after. Phrases are normalised by the log of the sample's length and
    the alphabet's, as in the cross-entropy estimate, so that a sample of a few symbols is not
    cheap to fail with; the score is 1 - cost of the best / cost of the next.

    Edge cases: null text, or text without letters, is "und" with score 0; ties go to the
    smaller language name; a null id is never learned from nor held out; with no labelled rows
    all is "und"; repeated rows and empty tables need no care; other columns are ignored.
    """
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    )
    samples = language_samples(rows, fold=fold, held_out=held_out, sample_docs=sample_docs, sample_chars=sample_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("language")
        for batch in batches:
            parser = _parser(samples)
            for some, texts in texts_of(batch):
                names, score = parser.predict(texts)
                yield pa.RecordBatch.from_arrays([pa.array(some, batch.column(0).type), pa.array(names), pa.array(score)], ["id", "lang_pred", "score"])

    out = rows.select("id", "text").mapInArrow(run, f"id {id_type}, lang_pred string, score double")
    rest = F.crc32(F.col("id").cast("string").cast("binary")) % fold
    return out.select(F.col("id").alias(id_col), F.coalesce(rest == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
