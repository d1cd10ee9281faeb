"""Learned embedders. Fitting runs on the driver over at most ``max_rows`` rows, chosen by a hash
of the id; inference maps over the whole table in batches."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.errors import NotFittedError
from geoloom.operators.autograd import Adam, Tensor, xavier
from geoloom.operators.embedders import mean_vectors, neighbour_pairs

MAX_ROWS = 50_000


def chosen(df: DataFrame, key: str, max_rows: int = MAX_ROWS) -> DataFrame:
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(max_rows)


def sample(df: DataFrame, key: str, max_rows: int = MAX_ROWS) -> pd.DataFrame:
    return chosen(df, key, max_rows).toPandas()


def _weights(params: dict[str, Tensor]) -> dict[str, np.ndarray]:
    return {k: p.data for k, p in params.items()}


class Model:
    """Named weights and a configuration, stored as one .npz and one .json file."""

    def __init__(self, **config):
        self.config, self.params = config, {}

    def _need(self):
        if not self.params:
            raise NotFittedError(f"{type(self).__name__} is not fitted")

    def save(self, path: str) -> None:
        self._need()
        folder = Path(path)
        folder.mkdir(parents=True, exist_ok=True)
        np.savez(folder / "model.npz", **_weights(self.params))
        (folder / "config.json").write_text(json.dumps({"class": type(self).__name__, **self.config, **self.extra()}))

    @classmethod
    def load(cls, path: str):
        config = json.loads((Path(path) / "config.json").read_text())
        if config.pop("class") != cls.__name__:
            raise ValueError("the folder holds another model")
        own = cls.__new__(cls)
        own.restore(config)
        with np.load(Path(path) / "model.npz") as z:
            own.params = {k: Tensor(z[k]) for k in z.files}
        return own

    def extra(self) -> dict:
        return {"columns": getattr(self, "columns", [])}

    def restore(self, config: dict) -> None:
        self.columns = config.pop("columns", [])
        self.config, self.params = config, {}

    def _map(self, df: DataFrame, key: str, forward) -> DataFrame:
        """Adds the array column ``embedding`` by a function of the features' matrix."""
        columns = self.columns
        kind = dict(df.dtypes)[key]

        def run(batches):
            for b in batches:
                x = b[columns].fillna(0).to_numpy(float)
                yield pd.DataFrame({key: b[key], "embedding": list(forward(x).astype(np.float32))})

        return df.select(key, *columns).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def _dense(x: Tensor, p: dict[str, Tensor], sizes: int, prefix: str) -> Tensor:
    for k in range(sizes):
        x = x @ p[f"{prefix}w{k}"] + p[f"{prefix}b{k}"]
        if k < sizes - 1:
            x = x.relu()
    return x


def _dense_params(rng, sizes: list[int], prefix: str) -> dict[str, Tensor]:
    out = {}
    for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
        out[f"{prefix}w{k}"], out[f"{prefix}b{k}"] = xavier(rng, a, b), Tensor(np.zeros(b))
    return out


def _np_dense(x: np.ndarray, w: dict[str, np.ndarray], n: int, prefix: str) -> np.ndarray:
    for k in range(n):
        x = x @ w[f"{prefix}w{k}"] + w[f"{prefix}b{k}"]
        if k < n - 1:
            x = np.maximum(x, 0)
    return x


def _batches(rng, n: int, size: int):
    order = rng.permutation(n)
    for i in range(0, n, size):
        yield order[i : i + size]


class AutoEncoder(Model):
    """Two-layer encoder and decoder, mean squared error: the timetable embedder's model."""

    def __init__(self, hidden: int = 48, embedding: int = 64, batch: int = 24, epochs: int = 10, rate: float = 1e-3, seed: int = 0):
        super().__init__(hidden=hidden, embedding=embedding, batch=batch, epochs=epochs, rate=rate, seed=seed)

    def fit(self, df: DataFrame, key: str) -> AutoEncoder:
        c, rng = self.config, np.random.default_rng(self.config["seed"])
        self.columns = [x for x in df.columns if x != key]
        x = sample(df, key)[self.columns].fillna(0).to_numpy(float)
        n = len(self.columns)
        self.params = _dense_params(rng, [n, c["hidden"], c["embedding"]], "e") | _dense_params(rng, [c["embedding"], c["hidden"], n], "d")
        adam = Adam(list(self.params.values()), c["rate"])
        self.losses = []
        for _ in range(c["epochs"]):
            total = 0.0
            for rows in _batches(rng, len(x), c["batch"]):
                t = Tensor(x[rows])
                e = _dense(_dense(t, self.params, 2, "e"), self.params, 2, "d") - x[rows]
                loss = (e * e).mean()
                loss.backward()
                adam.step()
                total += float(loss.data) * len(rows)
            self.losses.append(total / max(len(x), 1))
        return self

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        self._need()
        if [x for x in df.columns if x != key] != self.columns:
            raise ValueError(f"the model was fitted on {len(self.columns)} columns: {self.columns}")
        w = _weights(self.params)
        return self._map(df, key, lambda x: _np_dense(x, w, 2, "e"))


class Highway2Vec(AutoEncoder):
    """Autoencoder over road features; a region's vector is the mean of its roads'."""

    def __init__(self, hidden: int = 64, embedding: int = 30, batch: int = 128, epochs: int = 10, rate: float = 1e-3, seed: int = 0):
        super().__init__(hidden, embedding, batch, epochs, rate, seed)

    def embed_regions(self, features: DataFrame, joint: DataFrame, *, region_id: str = "region_id", feature_id: str = "feature_id") -> DataFrame:
        vectors = self.transform(features, feature_id)
        dims = [f"e{k}" for k in range(self.config["embedding"])]
        wide = vectors.select(feature_id, *[F.col("embedding")[k].cast("double").alias(d) for k, d in enumerate(dims)])
        out = mean_vectors(joint, wide, dims, region_id=region_id, feature_id=feature_id)
        return out.select(region_id, F.array(*[F.col(d).cast("float") for d in dims]).alias("embedding"))

    def fit_transform(self, features: DataFrame, joint: DataFrame, *, region_id: str = "region_id", feature_id: str = "feature_id") -> DataFrame:
        return self.fit(features, feature_id).embed_regions(features, joint, region_id=region_id, feature_id=feature_id)


class Hex2Vec(Model):
    """Skip-gram over regions: neighbours close, others far, by the dot product of encoded counts."""

    def __init__(self, sizes: tuple[int, ...] = (150, 75, 50), batch: int = 32, epochs: int = 3, rate: float = 1e-3, negative_distance: int = 2, seed: int = 0):
        if not sizes or any(s <= 0 for s in sizes):
            raise ValueError("encoder sizes must be positive")
        if negative_distance < 1:
            raise ValueError("negatives must lie beyond distance 1 or more")
        super().__init__(sizes=list(sizes), batch=batch, epochs=epochs, rate=rate, negative_distance=negative_distance, seed=seed)

    def _too_near(self, regions: DataFrame, edges: DataFrame, key: str) -> DataFrame:
        """All edges between the regions that exclude each other as negatives."""
        out = edges.filter((F.col("distance") <= self.config["negative_distance"]) & (F.col("distance") > 0)).select("region_id", "neighbour_id")
        for end in ("region_id", "neighbour_id"):
            out = out.join(regions.select(F.col(key).alias(end)), end, "left_semi")
        return out.select("region_id", "neighbour_id")

    def fit(self, counts: DataFrame, edges: DataFrame, key: str = "region_id") -> Hex2Vec:
        c, rng = self.config, np.random.default_rng(self.config["seed"])
        self.columns = [x for x in counts.columns if x != key]
        rows = sample(counts, key)
        x, at = rows[self.columns].fillna(0).to_numpy(float), {r: k for k, r in enumerate(rows[key])}
        pairs = neighbour_pairs(edges).orderBy(F.md5(F.concat_ws("|", "anchor", "positive"))).limit(4 * MAX_ROWS).toPandas()
        near = {}
        for r in self._too_near(chosen(counts.select(key), key), edges, key).toLocalIterator():
            near.setdefault(at[r[0]], set()).add(at[r[1]])
        pairs = np.array([(at[a], at[b]) for a, b in zip(pairs["anchor"], pairs["positive"], strict=True) if a in at and b in at], int).reshape(-1, 2)
        n = len(c["sizes"])
        self.params = _dense_params(rng, [len(self.columns), *c["sizes"]], "e")
        adam = Adam(list(self.params.values()), c["rate"])
        self.losses = []
        for _ in range(c["epochs"]):
            total = 0.0
            for part in _batches(rng, len(pairs), c["batch"]):
                a, b = pairs[part].T
                neg = rng.integers(0, len(x), len(a))
                for k in range(len(a)):  # drawn again while too near
                    for _ in range(8):
                        if neg[k] != a[k] and neg[k] not in near.get(int(a[k]), ()):
                            break
                        neg[k] = rng.integers(0, len(x))
                ea, eb, en = (_dense(Tensor(x[i]), self.params, n, "e") for i in (a, b, neg))
                loss = ((ea * eb).sum(1) * -1.0).softplus().mean() + (ea * en).sum(1).softplus().mean()
                loss.backward()
                adam.step()
                total += float(loss.data) * len(part)
            self.losses.append(total / max(len(pairs), 1))
        return self

    def transform(self, counts: DataFrame, key: str = "region_id") -> DataFrame:
        self._need()
        w, n = _weights(self.params), len(self.config["sizes"])
        return self._map(counts, key, lambda x: _np_dense(x, w, n, "e"))

    def fit_transform(self, counts: DataFrame, edges: DataFrame, key: str = "region_id") -> DataFrame:
        return self.fit(counts, edges, key).transform(counts, key)


class GeoVex(Model):
    """Hexagonal patches through a convolutional autoencoder with a zero-inflated Poisson loss.

    A patch is a region's cells within ``radius`` on the H3 or the axial grid; regions with missing cells are
    left out. Convolutions gather a cell's six neighbours and itself.
    """

    def __init__(self, radius: int = 4, embedding: int = 32, hidden: int = 256, conv_layers: int = 2, batch: int = 32, epochs: int = 5, rate: float = 1e-3, seed: int = 0):
        if radius < 2 or conv_layers < 2:
            raise ValueError("the radius and the convolutional layers must be at least 2")
        super().__init__(radius=radius, embedding=embedding, hidden=hidden, conv_layers=conv_layers, batch=batch, epochs=epochs, rate=rate, seed=seed)

    @staticmethod
    def disk(radius: int) -> list[tuple[int, int]]:
        span = range(-radius, radius + 1)
        return [(q, r) for q in span for r in span if abs(q + r) <= radius]

    def patches(self, counts: DataFrame) -> DataFrame:
        """(q, r, patch): features of every cell of the disk, cell by cell, for whole disks.

        One explode of each cell to the patches it belongs to and one grouped collect.
        """
        cells = self.disk(self.config["radius"])
        features = [c for c in counts.columns if c not in ("q", "r")]
        offsets = F.array(*[F.struct(F.lit(q).alias("dq"), F.lit(r).alias("dr"), F.lit(k).alias("k")) for k, (q, r) in enumerate(cells)])
        spread = counts.select("q", "r", F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("v"), F.explode(offsets).alias("o"))
        spread = spread.select((F.col("q") - F.col("o.dq")).alias("q"), (F.col("r") - F.col("o.dr")).alias("r"), F.struct(F.col("o.k").alias("k"), "v").alias("s"))
        whole = spread.groupBy("q", "r").agg(F.array_sort(F.collect_list("s")).alias("s")).filter(F.size("s") == len(cells))
        return whole.select("q", "r", F.flatten(F.transform("s", lambda x: x["v"])).alias("patch"))

    def h3_patches(self, counts: DataFrame) -> DataFrame:
        """(cell, patch) of H3 cells: as ``patches``, with each cell's disk laid out by local i and j.

        Cells whose disk is incomplete, or reaches beyond a pentagon or a border of faces, are left out.
        """
        from geoloom.functions import h3

        radius = self.config["radius"]
        places = {c: k for k, c in enumerate(self.disk(radius))}
        features = [c for c in counts.columns if c != "cell"]

        def lay(batches):
            for b in batches:
                own, near, _ = h3.disks(b["cell"].to_numpy(np.int64), radius)
                out = []
                for n in range(len(b)):
                    ring = near[own == n]
                    try:
                        ij = h3.local_ij(int(b["cell"].iloc[n]), ring)
                    except ValueError:
                        continue
                    # i and j stand 120 degrees apart, q and r of the patch 60.
                    spots = [places.get((int(i - j), int(j))) for i, j in ij]
                    if len(ring) == len(places) and None not in spots:
                        out += [(int(b["cell"].iloc[n]), c, k) for c, k in zip(ring.tolist(), spots, strict=True)]
                yield pd.DataFrame(out, columns=["cell", "near", "k"])

        laid = counts.select("cell").mapInPandas(lay, "cell long, near long, k int")
        values = counts.select(F.col("cell").alias("near"), F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("v"))
        whole = laid.join(values, "near").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s")).filter(F.size("s") == len(places))
        return whole.select("cell", F.flatten(F.transform("s", lambda x: x["v"])).alias("patch"))

    def _neighbours(self) -> np.ndarray:
        cells = self.disk(self.config["radius"])
        at = {c: k for k, c in enumerate(cells)}
        around = [(0, 0), (1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)]
        return np.array([[at.get((q + a, r + b), -1) for a, b in around] for q, r in cells])

    def _weight(self) -> np.ndarray:
        d = np.array([max(abs(q), abs(r), abs(q + r)) for q, r in self.disk(self.config["radius"])])
        return (1 / (1 + d)) * np.where(d > 0, 1 / (6 * np.maximum(d, 1)), 1)

    def _encode(self, x: Tensor, p: dict[str, Tensor]) -> Tensor:
        near, n, cells = self._neighbours(), x.shape[0], x.shape[1]
        for k in range(self.config["conv_layers"]):
            g = x.take(near, 1)
            x = (g.reshape(n, cells, -1) @ p[f"c{k}"] + p[f"cb{k}"]).norm().relu()
        return x.reshape(n, -1) @ p["ew"] + p["eb"]

    def fit(self, patches: DataFrame, features: int) -> GeoVex:
        c, rng = self.config, np.random.default_rng(self.config["seed"])
        cells = len(self.disk(c["radius"]))
        self.features = c["features"] = features
        self.columns = []
        keys = [c for c in patches.columns if c != "patch"]
        rows = patches.orderBy(F.md5(F.concat_ws("|", *keys)), *keys).limit(MAX_ROWS // 10).toPandas()
        x = np.array(rows["patch"].tolist(), float).reshape(len(rows), cells, features)
        sizes = [features] + [c["hidden"]] * c["conv_layers"]
        p = {}
        for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
            p[f"c{k}"], p[f"cb{k}"] = xavier(rng, 7 * a, b), Tensor(np.zeros(b))
        p |= {"ew": xavier(rng, cells * c["hidden"], c["embedding"]), "eb": Tensor(np.zeros(c["embedding"]))}
        p |= {"dw": xavier(rng, c["embedding"], c["hidden"]), "db": Tensor(np.zeros(c["hidden"]))}
        p |= {f"{h}w": xavier(rng, c["hidden"], cells * features) for h in ("pi", "la")} | {f"{h}b": Tensor(np.zeros(cells * features)) for h in ("pi", "la")}
        self.params, weight = p, np.repeat(self._weight(), features)
        adam = Adam(list(p.values()), c["rate"])
        self.losses = []
        for _ in range(c["epochs"]):
            total = 0.0
            for part in _batches(rng, len(x), c["batch"]):
                y = x[part].reshape(len(part), -1)
                h = (self._encode(Tensor(x[part]), p) @ p["dw"] + p["db"]).relu()
                pi, rate = (h @ p["piw"] + p["pib"]).sigmoid(), (h @ p["law"] + p["lab"]).softplus()
                zero = (pi + (pi * -1.0 + 1.0) * (rate * -1.0).exp()).log() * (y == 0)
                some = ((pi * -1.0 + 1.0).log() + rate.log() * y - rate) * (y > 0)
                loss = ((zero + some) * -weight).sum(1).mean()
                loss.backward()
                adam.step()
                total += float(loss.data) * len(part)
            self.losses.append(total / max(len(x), 1))
        return self

    def transform(self, patches: DataFrame) -> DataFrame:
        self._need()
        own, w = self, {k: Tensor(p.data) for k, p in self.params.items()}
        cells, features = len(self.disk(self.config["radius"])), self.config["features"]
        keys = [c for c in patches.columns if c != "patch"]

        def run(batches):
            for b in batches:
                x = np.array(b["patch"].tolist(), float).reshape(len(b), cells, features)
                yield b[keys].assign(embedding=list(own._encode(Tensor(x), w).data.astype(np.float32)))

        return patches.mapInPandas(run, ", ".join(f"{c} long" for c in keys) + ", embedding array<float>")

    def fit_transform(self, counts: DataFrame) -> DataFrame:
        """Embeddings of cells (q, r) of the axial grid, or of H3 cells (cell), with features in the other columns."""
        patches = self.h3_patches(counts) if "cell" in counts.columns else self.patches(counts)
        return self.fit(patches, len(counts.columns) - (len(patches.columns) - 1)).transform(patches)


class S2Vec(Model):
    """Masked autoencoder of transformer blocks over an image's patches, with their 2-D positions.

    Rows: img_id, patch_id, place (raster order in a grid by grid image) and features, which are
    scaled to z-scores of the fitted data. Missing patches are zeros.
    """

    def __init__(self, grid: int = 16, dim: int = 256, decoder_dim: int = 128, heads: int = 8, layers: int = 6, decoder_layers: int = 2, mask: float = 0.75, batch: int = 64, epochs: int = 3, rate: float = 5e-4, decay: float = 1e-3, seed: int = 0):
        if dim % heads or dim % 4 or not 0 <= mask < 1:
            raise ValueError("dim must be a multiple of the heads and of 4, mask in [0, 1)")
        super().__init__(grid=grid, dim=dim, decoder_dim=min(decoder_dim, dim), heads=heads, layers=layers, decoder_layers=decoder_layers, mask=mask, batch=batch, epochs=epochs, rate=rate, decay=decay, seed=seed)

    @staticmethod
    def position(dim: int, grid: int) -> np.ndarray:
        def line(pos):
            w = 1 / 10000 ** (np.arange(dim // 4) / (dim / 4))
            return np.concatenate([np.sin(pos[:, None] * w), np.cos(pos[:, None] * w)], 1)

        y, x = np.divmod(np.arange(grid * grid), grid)
        return np.concatenate([line(x), line(y)], 1)

    def _block(self, x: Tensor, p: dict[str, Tensor], name: str, heads: int) -> Tensor:
        n, t, d = x.shape
        h = x.norm()
        q, k, v = ((h @ p[f"{name}{c}"]).reshape(n, t, heads, d // heads).transpose(0, 2, 1, 3) for c in "qkv")
        a = (q @ k.transpose(0, 1, 3, 2) * (1 / np.sqrt(d // heads))).softmax() @ v
        x = x + a.transpose(0, 2, 1, 3).reshape(n, t, d) @ p[f"{name}o"]
        return x + ((x.norm() @ p[f"{name}1"] + p[f"{name}b1"]).relu() @ p[f"{name}2"] + p[f"{name}b2"])

    def _block_params(self, rng, d: int, name: str) -> dict[str, Tensor]:
        out = {f"{name}{c}": xavier(rng, d, d) for c in "qkvo"}
        return out | {f"{name}1": xavier(rng, d, 2 * d), f"{name}b1": Tensor(np.zeros(2 * d)), f"{name}2": xavier(rng, 2 * d, d), f"{name}b2": Tensor(np.zeros(d))}

    def _encode(self, x: np.ndarray, keep: np.ndarray, p: dict[str, Tensor]) -> Tensor:
        c = self.config
        t = Tensor(x) @ p["in"] + p["inb"] + self.position(c["dim"], c["grid"])
        if keep.shape[1] < x.shape[1]:
            n, m = keep.shape
            t = t.reshape(-1, c["dim"]).take((keep + np.arange(n)[:, None] * x.shape[1]).ravel()).reshape(n, m, c["dim"])
        for k in range(c["layers"]):
            t = self._block(t, p, f"e{k}", c["heads"])
        return t.norm()

    def _images(self, rows: pd.DataFrame) -> tuple[list, np.ndarray]:
        c = self.config
        ids = list(dict.fromkeys(rows["img_id"]))
        at = {i: k for k, i in enumerate(ids)}
        x = np.zeros((len(ids), c["grid"] ** 2, len(self.columns)))
        x[[at[i] for i in rows["img_id"]], rows["place"].to_numpy()] = (rows[self.columns].fillna(0).to_numpy(float) - c["mean"]) * c["scale"]
        return ids, x

    def fit(self, patches: DataFrame, columns: list[str]) -> S2Vec:
        c, rng = self.config, np.random.default_rng(self.config["seed"])
        self.columns = list(columns)
        images = patches.select("img_id").distinct().orderBy(F.md5("img_id")).limit(max(1, MAX_ROWS // c["grid"] ** 2))
        rows = patches.join(images, "img_id", "left_semi").orderBy("img_id", "place").toPandas()
        values = [F.coalesce(F.nanvl(F.col(f"`{x}`").cast("double"), F.lit(0.0)), F.lit(0.0)) for x in self.columns]
        facts = patches.agg(*[F.avg(v) for v in values], *[F.stddev_pop(v) for v in values]).first()
        mean, std = np.nan_to_num(np.array(facts, float)).reshape(2, -1)
        c["mean"], c["scale"] = mean.tolist(), np.where(std < 1e-8, 0, 1 / np.maximum(std, 1e-8)).tolist()
        _, x = self._images(rows)
        d, e, f, t = c["dim"], c["decoder_dim"], len(self.columns), c["grid"] ** 2
        p = {"in": xavier(rng, f, d), "inb": Tensor(np.zeros(d)), "mid": xavier(rng, d, e), "token": Tensor(np.zeros(e)), "out": xavier(rng, e, f), "outb": Tensor(np.zeros(f))}
        for k in range(c["layers"]):
            p |= self._block_params(rng, d, f"e{k}")
        for k in range(c["decoder_layers"]):
            p |= self._block_params(rng, e, f"d{k}")
        self.params = p
        adam, place = Adam(list(p.values()), c["rate"], c["decay"]), self.position(e // 4 * 4, c["grid"])
        place = np.pad(place, ((0, 0), (0, e - place.shape[1])))
        self.losses = []
        for _ in range(c["epochs"]):
            total = 0.0
            for part in _batches(rng, len(x), c["batch"]):
                n, m = len(part), max(1, int(t * (1 - c["mask"])))
                order = rng.permuted(np.tile(np.arange(t), (n, 1)), axis=1)
                keep = order[:, :m]
                back = np.full((n, t), -1)
                np.put_along_axis(back, keep, np.arange(m) + np.arange(n)[:, None] * m, 1)
                seen = self._encode(x[part], keep, p).reshape(n * m, d) @ p["mid"]
                hidden = (back < 0)[:, :, None]
                y = seen.take(back.ravel()).reshape(n, t, e) + p["token"] * hidden + place
                for k in range(c["decoder_layers"]):
                    y = self._block(y, p, f"d{k}", min(c["heads"], e) if e % min(c["heads"], e) == 0 else 1)
                error = (y.norm() @ p["out"] + p["outb"] - x[part]) * hidden
                loss = (error * error).sum() * (1 / max(hidden.sum() * f, 1))
                loss.backward()
                adam.step()
                total += float(loss.data) * n
            self.losses.append(total / max(len(x), 1))
        return self

    def transform(self, patches: DataFrame) -> DataFrame:
        """One vector per patch, image by image (a group is one image, of bounded size)."""
        self._need()
        own, w, columns = self, {k: Tensor(v.data) for k, v in self.params.items()}, self.columns

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            _, x = own._images(rows)
            z = own._encode(x, np.arange(x.shape[1])[None], w).data[0]
            return pd.DataFrame({"img_id": rows["img_id"], "patch_id": rows["patch_id"], "embedding": list(z[rows["place"].to_numpy()].astype(np.float32))})

        types = dict(patches.dtypes)
        return patches.select("img_id", "patch_id", "place", *columns).groupBy("img_id").applyInPandas(run, f"img_id {types['img_id']}, patch_id {types['patch_id']}, embedding array<float>")

    def fit_transform(self, patches: DataFrame, columns: list[str]) -> DataFrame:
        return self.fit(patches, columns).transform(patches)
