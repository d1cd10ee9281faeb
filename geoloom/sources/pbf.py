"""OpenStreetMap PBF files: blocks of zlib-packed protobuf, read and written without a package.

A file is a row of blobs, each behind its length. Finding the blobs reads only their headers;
decoding them is one task's work per share of blobs, so a large file is read by many tasks.
"""

from __future__ import annotations

import contextlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.storage import committed

SCHEMA = "element string, id long, tags map<string,string>, lon double, lat double, refs array<long>, members array<struct<type:string,ref:long,role:string>>"
# Fixed values of the format.
NODE, DENSE, WAY, RELATION = 1, 2, 3, 4
MEMBER_TYPES = ("node", "way", "relation")
PER_BLOCK = 8000


# --- Protobuf --------------------------------------------------------------------------------


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: integers as they are on the wire, everything else as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def packed(data: bytes) -> np.ndarray:
    """A packed list of varints."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    parts = (b & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, starts)


def signed(x: np.ndarray) -> np.ndarray:
    """Zigzag to signed."""
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def _put(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _message(*pairs: tuple[int, int | bytes]) -> bytes:
    return b"".join(_put(k << 3) + _put(v) if isinstance(v, int) else _put(k << 3 | 2) + _put(len(v)) + v for k, v in pairs)


def _zigzag(values) -> bytes:
    return b"".join(_put((v << 1) ^ (v >> 63)) for v in values)


def _steps(values: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *values[:-1]], values, strict=True)]


# --- Reading ---------------------------------------------------------------------------------


def decode_block(data: bytes) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` of a primitive block."""
    names: list[str] = []
    groups, grain, lat0, lon0 = [], 100, 0, 0
    for k, v in fields(data):
        if k == 1:
            names = [x.decode() for n, x in fields(v) if n == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            grain = v
        elif k in (19, 20):
            v = v - (1 << 64) if v >> 63 else v
            lat0, lon0 = (v, lon0) if k == 19 else (lat0, v)
    place = lambda raw, zero: (raw * grain + zero) * 1e-9
    for group in groups:
        for kind, body in fields(group):
            if kind == DENSE:
                f = dict(fields(body))
                ids, lat, lon = (np.cumsum(signed(packed(f.get(k, b"")))) for k in (1, 8, 9))
                tags, own = [], {}
                pairs = iter(packed(f.get(10, b"")).tolist())
                for k in pairs:
                    if k == 0:
                        tags.append(own)
                        own = {}
                    else:
                        own[names[k]] = names[next(pairs)]
                tags += [{}] * (len(ids) - len(tags))
                for row in zip(ids.tolist(), tags, place(lon, lon0).tolist(), place(lat, lat0).tolist(), strict=True):
                    yield ("node", *row, None, None)
            elif kind in (NODE, WAY, RELATION):
                f = dict(fields(body))
                tags = {names[a]: names[b] for a, b in zip(packed(f.get(2, b"")).tolist(), packed(f.get(3, b"")).tolist(), strict=True)}
                if kind == NODE:
                    one = lambda k: int(signed(np.array([f[k]], np.uint64))[0])  # noqa: B023, E731
                    yield ("node", one(1), tags, place(one(9), lon0), place(one(8), lat0), None, None)
                elif kind == WAY:
                    yield ("way", f[1], tags, None, None, np.cumsum(signed(packed(f.get(8, b"")))).tolist(), None)
                else:
                    roles, types = packed(f.get(8, b"")).tolist(), packed(f.get(10, b"")).tolist()
                    refs = np.cumsum(signed(packed(f.get(9, b"")))).tolist()
                    members = [{"type": MEMBER_TYPES[t], "ref": r, "role": names[s]} for t, r, s in zip(types, refs, roles, strict=True)]
                    yield ("relation", f[1], tags, None, None, None, members)


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(inner)


def blobs(path: str) -> Iterator[tuple[int, int]]:
    """(offset, size) of the data blobs of a file, from their headers."""
    with _open(path) as f:
        size, at = f.size(), 0
        while at < size:
            (n,) = struct.unpack(">I", f.read_at(4, at))
            head = dict(fields(f.read_at(n, at + 4)))
            at += 4 + n
            if head[1] == b"OSMData":
                yield at, head[3]
            at += head[3]


def unpack_blob(raw: bytes) -> bytes:
    f = dict(fields(raw))
    if 1 in f:
        return f[1]
    if 3 in f:
        return zlib.decompress(f[3])
    raise ValueError("blobs must be raw or zlib-packed")


def read_pbf(spark: SparkSession, path: str, *, blobs_per_task: int = 64) -> DataFrame:
    """Elements of PBF files: element, id, tags, lon and lat (nodes), refs (ways), members (relations).

    Paths need a file system that pyarrow opens (local or mounted folders, object stores).
    """
    found = spark.read.format("binaryFile").load(path).select("path")

    def index(batches):
        import pandas as pd

        for b in batches:
            for p in b["path"]:
                yield pd.DataFrame([(p, a, n) for a, n in blobs(p)], columns=["path", "at", "size"])

    def decode(batches):
        import pandas as pd

        for b in batches:
            for p, part in b.groupby("path", sort=False):
                with _open(p) as f:
                    for a, n in zip(part["at"].tolist(), part["size"].tolist(), strict=True):
                        rows = list(decode_block(unpack_blob(f.read_at(n, a))))
                        yield pd.DataFrame(rows, columns=["element", "id", "tags", "lon", "lat", "refs", "members"])

    places = found.mapInPandas(index, "path string, at long, size long")
    share = F.floor(F.col("at") / F.lit(blobs_per_task * 65_536))
    return places.repartition("path", share).mapInPandas(decode, SCHEMA)


# --- Writing ---------------------------------------------------------------------------------


def _blob(kind: bytes, body: bytes) -> bytes:
    blob = _message((2, len(body)), (3, zlib.compress(body)))
    head = _message((1, kind), (3, len(blob)))
    return struct.pack(">I", len(head)) + head + blob


def encode_block(rows: list[tuple]) -> bytes:
    """A primitive block of (element, id, tags, lon, lat, refs) rows."""
    names: dict[str, int] = {"": 0}
    at = lambda s: names.setdefault(s, len(names))
    nodes, ways = [r for r in rows if r[0] == "node"], [r for r in rows if r[0] == "way"]
    groups = []
    if nodes:
        pairs = b"".join(b"".join(_put(at(k)) + _put(at(v)) for k, v in r[2].items()) + b"\0" for r in nodes)
        grid = lambda k: _zigzag(_steps([round(r[k] * 1e7) for r in nodes]))
        groups.append(_message((DENSE, _message((1, _zigzag(_steps([r[1] for r in nodes]))), (8, grid(4)), (9, grid(3)), (10, pairs)))))
    if ways:
        body = []
        for r in ways:
            keys, values = (b"".join(_put(at(x)) for x in side) for side in (r[2].keys(), r[2].values()))
            body.append((WAY, _message((1, r[1]), (2, keys), (3, values), (8, _zigzag(_steps(r[5]))))))
        groups.append(_message(*body))
    table = _message(*[(1, n.encode()) for n in names])
    return _message((1, table), *[(2, g) for g in groups])


def write_pbf(elements: DataFrame, folder: str) -> str:
    """Nodes and ways (element, id, tags, lon, lat, refs) as one PBF file per task in a folder, each of which appears once it is whole.

    The folder is any that Arrow's file systems open and all executors share.
    """

    def save(batches):
        import pandas as pd
        from pyspark import TaskContext

        count = 0
        with contextlib.ExitStack() as files:
            out = None
            for b in batches:
                if out is None:
                    out = files.enter_context(committed(f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.pbf"))
                    out.write(_blob(b"OSMHeader", _message((4, b"OsmSchema-V0.6"), (4, b"DenseNodes"))))
                refs = [[] if r is None else list(map(int, r)) for r in b["refs"]]
                rows = list(zip(b["element"], map(int, b["id"]), map(dict, b["tags"]), b["lon"], b["lat"], refs, strict=True))
                for k in range(0, len(rows), PER_BLOCK):
                    out.write(_blob(b"OSMData", encode_block(rows[k : k + PER_BLOCK])))
                count += len(rows)
        yield pd.DataFrame({"n": [count]})

    elements.select("element", "id", "tags", "lon", "lat", "refs").mapInPandas(save, "n long").agg(F.sum("n")).collect()
    return folder
