"""Token files as wavelet matrices: succinct bit-planes with rank and select."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import materialise, settle
from geoloom.llm.tokens import encoder, texts_of

MAGIC = b"GLWM2\0"
#: Bits between two entries of a plane's rank directory.
BLOCK = 512


class WaveletShard:
    """One shard: documents' token counts and a wavelet matrix over all their ids.

    Ids are numbered anew by rank among the shard's distinct ids, which are stored, so there are
    as many levels as those need. Level 0 holds the highest bit. Each level stores its bits, the
    count of zeros and, for every block of 512 bits, the ones before it; zeros go left and ones
    right, stably, to make the next level.
    """

    def __init__(self, doc_lengths: np.ndarray, n: int, alphabet: np.ndarray, planes: list[np.ndarray], zeros: list[int]):
        self.doc_lengths, self.n, self.alphabet, self.planes, self.zeros = doc_lengths, n, alphabet, planes, zeros
        self.levels = len(planes)
        self.ranks = [self._directory(p) for p in planes]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        counts = np.bitwise_count(plane).astype(np.uint32)
        padded = np.zeros(-(-len(counts) // (BLOCK // 8)) * (BLOCK // 8), np.uint32)
        padded[: len(counts)] = counts
        return np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK // 8).sum(1))]).astype(np.uint32)

    @classmethod
    def build(cls, ids: np.ndarray, doc_lengths) -> WaveletShard:
        seen = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
        seen[ids] = True
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        levels = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 1
        number = (np.cumsum(seen) - 1).astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros, now = [], [], number[ids]
        for level in range(levels):
            bit = (now & now.dtype.type(1 << (levels - 1 - level))) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            ones = np.flatnonzero(bit)
            zeros.append(len(bit) - len(ones))
            # Taking by positions is several times faster here than taking by a mask.
            now = np.concatenate([now.take(np.flatnonzero(~bit)), now.take(ones)])
        return cls(np.asarray(doc_lengths, np.uint32), len(ids), alphabet, planes, zeros)

    def to_bytes(self, level: int = 1) -> bytes:
        """Header, lengths, alphabet, then per level zeros, rank directory and bits; one zstd frame per section."""
        squeeze = zstandard.ZstdCompressor(level=level).compress
        parts = [squeeze(self.doc_lengths.astype("<u4").tobytes()), squeeze(np.diff(self.alphabet, prepend=0).astype("<u4").tobytes())]
        for plane, ranks in zip(self.planes, self.ranks, strict=True):
            parts += [squeeze(np.diff(ranks.astype("<i4")).astype("<u2").tobytes()), squeeze(plane.tobytes())]
        head = MAGIC + struct.pack("<IQB", len(self.doc_lengths), self.n, self.levels)
        head += struct.pack(f"<{self.levels}Q", *self.zeros) + struct.pack(f"<{len(parts)}Q", *map(len, parts))
        return head + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletShard:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        at = len(MAGIC)
        docs, n, levels = struct.unpack_from("<IQB", data, at)
        at += struct.calcsize("<IQB")
        zeros = list(struct.unpack_from(f"<{levels}Q", data, at))
        at += 8 * levels
        sizes = struct.unpack_from(f"<{2 * levels + 2}Q", data, at)
        at += 8 * len(sizes)
        parts, loosen = [], zstandard.ZstdDecompressor().decompress
        for size in sizes:
            parts.append(loosen(data[at : at + size]))
            at += size
        self = cls.__new__(cls)
        self.doc_lengths, self.n, self.levels, self.zeros = np.frombuffer(parts[0], "<u4"), n, levels, zeros
        self.alphabet = np.cumsum(np.frombuffer(parts[1], "<u4"), dtype=np.uint32)
        self.planes = [np.frombuffer(x, np.uint8) for x in parts[3::2]]
        self.ranks = [np.concatenate([[0], np.cumsum(np.frombuffer(x, "<u2"), dtype=np.uint32)]) for x in parts[2::2]]
        return self

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i."""
        plane, block = self.planes[level], i // BLOCK
        first, last = block * BLOCK // 8, i // 8
        ones = int(self.ranks[level][block]) + int(np.bitwise_count(plane[first:last]).sum())
        return ones + (int(plane[last] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.levels):
            bit = self.planes[level][i // 8] >> (i % 8) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            token = token << 1 | int(bit)
        return int(self.alphabet[token])

    def _number(self, token: int) -> int:
        """A token's rank in the alphabet; -1 if it never occurs."""
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else -1

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        token = self._number(token)
        if token < 0:
            return 0, 0
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in [lo, hi)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence (from 0)."""
        start, end = self._range(token, 0, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        at, token = start + k, self._number(token)
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            want = at - self.zeros[level] if bit else at
            lo, hi = 0, self.n  # the smallest i whose prefix [0, i] holds want + 1 such bits
            while lo < hi:
                mid = (lo + hi) // 2
                ones = self._ones(level, mid + 1)
                lo, hi = (lo, mid) if (ones if bit else mid + 1 - ones) > want else (mid + 1, hi)
            at = lo
        return at

    def locate(self, token: int) -> list[int]:
        """All positions of a token, ascending."""
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, by undoing the stable partitions from the lowest level up."""
        ids = np.zeros(self.n, np.uint32 if self.levels > 16 else np.uint16)
        for level in reversed(range(self.levels)):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(ids)
            up[np.flatnonzero(~bit)] = ids[: self.zeros[level]]
            up[np.flatnonzero(bit)] = ids[self.zeros[level] :] | ids.dtype.type(1 << (self.levels - 1 - level))
            ids = up
        return self.alphabet.take(ids)


def write_shards(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    mode: str = "dropped",
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    shard_tokens: int = 400_000,
) -> DataFrame:
    """Encodes all documents in ascending id order and writes the shards; returns the table of them.

    Rows: part (range of ids), seq (within it), doc_ids, n_tokens and payload, the compressed
    file of one shard. A range exchange on the id orders the documents; a task closes a shard
    at ``shard_tokens`` tokens, so it holds one shard, and documents are never cut.
    Spark's writer commits the shards to the shared folder, whatever store that is in.
    """
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        settle("tokens")
        coder, part, seq = encoder(tokenizer_path, mode), TaskContext.get().partitionId(), 0
        end = np.array([end_id], coder.dtype)
        ids, rows, held, kind = [], [], 0, None

        def flush():
            shard = WaveletShard.build(np.concatenate(rows), [len(x) for x in rows])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([held], pa.int64()), pa.array([shard.to_bytes()], pa.binary())],
                ["part", "seq", "doc_ids", "n_tokens", "payload"],
            )

        for batch in batches:
            kind = batch.column(0).type
            for some, texts in texts_of(batch):
                for i, x in zip(some, coder.encode(texts), strict=True):
                    ids.append(i)
                    rows.append(np.concatenate([x, end]))
                    held += len(rows[-1])
                    if held >= shard_tokens:
                        yield flush()
                        seq, ids, rows, held = seq + 1, [], [], 0
        if rows:
            yield flush()

    ordered = (
        docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
        .repartitionByRange(F.col("i").asc_nulls_first())
        .sortWithinPartitions(F.col("i").asc_nulls_first(), "t")
    )
    shards = ordered.mapInArrow(run, f"part long, seq long, doc_ids array<{id_type}>, n_tokens long, payload binary")
    return materialise(shards, "tokens")


def read_shards(shards: DataFrame) -> DataFrame:
    """Decodes the shards' files: part, seq, doc_id, start (within the shard), n_tokens, ids_crc32."""
    id_type = dict(shards.dtypes)["doc_ids"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = WaveletShard.from_bytes(batch.column(3)[k].as_py())
                ids, ends = shard.decode().astype("<u4"), np.cumsum(shard.doc_lengths.astype(np.int64))
                starts = ends - shard.doc_lengths
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                same = lambda x, n=len(ends): pa.array(np.full(n, x.as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [same(batch.column(0)[k]), same(batch.column(1)[k]), batch.column(2)[k].values, pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())],
                    ["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    schema = f"part long, seq long, doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    return shards.select("part", "seq", "doc_ids", "payload").mapInArrow(run, schema)


def encode_corpus(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes the shards, reads them back and gives each document its place in the whole stream.

    Returns doc_id, start (ids of all documents before it), n_tokens and ids_crc32, all from the
    files. Shard offsets add up per range of ids, and ranges among themselves: the only
    unpartitioned window has one row per range.

    Edge cases: null or empty text is the end id alone; null ids come first; equal ids are
    ordered by text; an empty table gives no rows; other columns are ignored.
    """
    shards = write_shards(docs, tokenizer_path, **options)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        shards.groupBy("part")
        .agg(F.sum("n_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    )
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("shard_start"))
        .join(parts, "part")
        .select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("base"))
    )
    return (
        read_shards(shards)
        .join(materialise(offsets, "offsets"), ["part", "seq"])
        .select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
    )
