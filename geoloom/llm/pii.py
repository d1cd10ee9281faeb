"""Personal data: fixed patterns plus a character-level bidirectional LSTM with CRF transitions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import hash_unit, pieces, settle, texts_of

KINDS = ("email", "ip", "card", "phone")
TRIGGER = re.compile(r"[0-9@]")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Window and step, in characters; reach of a trigger on either side; farther triggers begin a new region.
WINDOW, STEP, REACH = 96, 48, 32


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    """Whether a match of the kind is kept."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    n = len(d := digits(text))
    return 13 <= n <= 19 and luhn(d) if kind == "card" else 9 <= n <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed patterns, ordered by kind and start; linear in the text.

    For e-mail, a leftmost match begins where the run of local-part characters before its "@"
    does (or where the match before ended), so only the "@" are visited. A dotted number can only
    begin where a run of digits does. Both give what the plain patterns give, without their
    quadratic search.
    """
    if not TRIGGER.search(text):
        return []
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(KINDS[kind], m[0])]
    return out


# --- The model -----------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_CODES: list[np.ndarray] = []


def encode(text: str) -> np.ndarray:
    """Symbols: ASCII as such with all digits alike, 128 other letters, 129 the rest; 0 pads."""
    if not _CODES:
        table = np.array([c if c < 128 else 128 if chr(c).isalpha() else 129 for c in range(0x10000)], np.uint8)
        table[48:58], table[0] = 48, 129
        _CODES.append(table)
    return _CODES[0][np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """BiLSTM emissions and linear-chain CRF, all float32 numpy; arrays are time by batch."""

    def __init__(self, hidden: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 0.25, s).astype(np.float32)
        self.h = hidden
        self.p = {"out": f(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        for d in "fb":
            x = f(130, 4 * hidden)
            x[:, hidden : 2 * hidden] += 1  # forget gates start open
            self.p |= {f"x{d}": x, f"r{d}": f(hidden, 4 * hidden)}

    def _lstm(self, codes: np.ndarray, d: str, keep: bool):
        n, b, h = codes.shape[0], codes.shape[1], self.h
        x, r = self.p[f"x{d}"], self.p[f"r{d}"]
        hs, c, now, past = np.zeros((n, b, h), np.float32), np.zeros((b, h), np.float32), np.zeros((b, h), np.float32), []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = x[codes[t]] + now @ r
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            old = c
            c = f * c + i * g
            tc = np.tanh(c)
            if keep:
                past.append((t, i, f, o, g, old, tc, now))
            now = o * tc
            hs[t] = now
        return hs, past

    def emissions(self, codes: np.ndarray, keep: bool = False):
        (hf, pf), (hb, pb) = self._lstm(codes, "f", keep), self._lstm(codes, "b", keep)
        both = np.concatenate([hf, hb], 2)
        return both @ self.p["out"] + self.p["bias"], both, pf, pb

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Viterbi paths for a batch of windows."""
        e = self.emissions(codes)[0]
        n, b, _ = e.shape
        best, back = self.p["first"] + e[0], np.zeros((n, b, TAGS), np.int8)
        for t in range(1, n):
            s = best[:, :, None] + self.p["trans"]
            back[t] = s.argmax(1)
            best = s.max(1) + e[t]
        path, rows = np.zeros((n, b), np.int8), np.arange(b)
        path[-1] = best.argmax(1)
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t, rows, path[t]]
        return path

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood: forward-backward over tags, then back through time."""
        p, h = self.p, self.h
        e, both, pf, pb = self.emissions(codes, True)
        n, b, k = e.shape
        a, z = np.zeros_like(e), np.zeros_like(e)
        lse = lambda x, ax: (m := x.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(x - m).sum(ax))
        a[0] = p["first"] + e[0]
        for t in range(1, n):
            a[t] = lse(a[t - 1][:, :, None] + p["trans"], 1) + e[t]
        for t in range(n - 2, -1, -1):
            z[t] = lse(p["trans"] + (e[t + 1] + z[t + 1])[:, None, :], 2)
        total = lse(a[-1], 1)
        marginal = np.exp(a + z - total[None, :, None])
        gold = np.eye(k, dtype=np.float32)[tags]
        de = (marginal - gold) / b
        g = {"first": de[0].sum(0), "trans": np.zeros((k, k), np.float32)}
        for t in range(1, n):
            pair = np.exp(a[t - 1][:, :, None] + p["trans"] + (e[t] + z[t] - total[:, None])[:, None, :])
            g["trans"] += (pair.sum(0) - gold[t - 1].T @ gold[t]) / b
        g["out"], g["bias"] = np.einsum("tbh,tbk->hk", both, de), de.sum((0, 1))
        dboth = de @ p["out"].T
        for d, past, dh in (("f", pf, dboth[:, :, :h]), ("b", pb, dboth[:, :, h:])):
            gx, gr = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"r{d}"])
            next_h, next_c = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
            for t, i, f, o, c_new, old, tc, before in reversed(past):
                dh_t = dh[t] + next_h
                dc = next_c + dh_t * o * (1 - tc * tc)
                dz = np.concatenate([dc * c_new * i * (1 - i), dc * old * f * (1 - f), dh_t * tc * o * (1 - o), dc * i * (1 - c_new * c_new)], 1)
                np.add.at(gx, codes[t], dz)
                gr += before.T @ dz
                next_h, next_c = dz @ p[f"r{d}"].T, dc * f
            g |= {f"x{d}": gx, f"r{d}": gr}
        return g

    def fit(self, codes: np.ndarray, tags: np.ndarray, *, steps: int = 160, batch: int = 48, rate: float = 0.02, seed: int = 11) -> Tagger:
        """Adam over random batches of windows (window by time)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(codes), min(batch, len(codes)))
            for k, g in self.gradients(codes[pick].T, tags[pick].T).items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                now = rate * (1 - step / (steps + 1)) + 0.001
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def windows(text: str) -> list[int]:
    """Starts of overlapping windows over every place within reach of a digit or an "@".

    A span of any kind holds one of these characters, so no other place can hold a span.
    """
    out, start, end = [], -1, -1
    for m in TRIGGER.finditer(text):
        at = m.start()
        if start < 0 or at - REACH > end:
            if start >= 0:
                out += range(start, max(start + 1, end - (WINDOW - STEP)), STEP)
            start = max(0, at - REACH)
        end = at + REACH
    if start >= 0:
        out += range(start, max(start + 1, end - (WINDOW - STEP)), STEP)
    return out


def tags_of(spans: list[tuple[int, int, int]], start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int8)
    for kind, a, b in spans:
        a, b = max(a - start, -1), min(b - start, WINDOW)
        if b > 0 and a < WINDOW:
            out[max(a, 0) : b] = 2 + 2 * kind
            if a >= 0:
                out[a] = 1 + 2 * kind
    return out


def augment(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """A variant of a window with each span written as people also write it."""
    done, at, out = "", 0, []
    for kind, a, b in sorted(spans, key=lambda x: x[1]):
        if a < at:
            continue
        done += text[at:a]
        new = text[a:b]
        if kind == 0:
            new = new.replace("@", " @ ", 1)
        elif kind == 1:
            new = new.replace(".", " . ")
        elif kind == 2:
            d = digits(new)
            new = ".".join(d[i : i + 4] for i in range(0, len(d), 4))
        else:
            new = new[new.find("(") :] if "(" in new else new.lstrip("+")
        out.append((kind, len(done), len(done) + len(new)))
        done, at = done + new, b
    return done + text[at:], out


def training_set(texts: list[tuple[str, list[tuple[int, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    codes, tags = [], []
    for text, spans in texts:
        for t, s in (text, spans), augment(text, spans):
            c = np.zeros(WINDOW, np.uint8)
            got = encode(t[:WINDOW])
            c[: len(got)] = got
            codes.append(c)
            tags.append(tags_of(s, 0))
            if not spans:
                break
    return np.array(codes, np.uint8).reshape(-1, WINDOW), np.array(tags, np.int8).reshape(-1, WINDOW)


def plausible(kind: int, text: str) -> bool:
    """What a span found by the model must hold to count."""
    if kind == 0:
        local, at, domain = text.partition("@")
        return bool(at and local.strip() and "." in domain.strip(" .") and len(text) <= 80)
    d = digits(text)
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and len(text) <= 24
    if not d or not re.fullmatch(r"[+(]?[0-9][\x20().0-9-]*[0-9]", text):
        return False
    return 13 <= len(d) <= 19 and luhn(d) if kind == 2 else 10 <= len(d) <= 15 and bool(re.search(r"[\x20().-]", text))


def reconcile(found: list[tuple[int, int, int, float]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """One consistent set over all windows: the spans of greatest total weight that overlap
    neither each other nor a fixed one. Spans agreed on by several windows add their weights."""
    votes: dict[tuple[int, int, int], float] = {}
    for kind, a, b, w in found:
        votes[a, b, kind] = votes.get((a, b, kind), 0) + w
    fixed = sorted((a, b) for _, a, b in base)
    free, at = [], 0
    for a, b, kind in sorted(votes):
        while at < len(fixed) and fixed[at][1] <= a:
            at += 1
        if not any(x < b and a < y for x, y in fixed[max(0, at - 4) : at + 4]):
            free.append((a, b, kind))
    free.sort(key=lambda x: x[1])
    ends, best, take = [x[1] for x in free], [0.0], []
    for a, b, kind in free:
        k = int(np.searchsorted(ends, a, side="right"))
        k = min(k, len(take))
        with_it = best[k] + votes[a, b, kind] * (b - a)
        take.append((with_it > best[-1], k))
        best.append(max(best[-1], with_it))
    out, i = [], len(free)
    while i:
        used, k = take[i - 1]
        if used:
            a, b, kind = free[i - 1]
            out.append((kind, a, b))
            i = k
        else:
            i -= 1
    return out


def find_spans(texts: list[str], model: Tagger | None, batch: int = 2048) -> list[tuple[list, list]]:
    """Per text: its base spans, and all spans."""
    base = [base_spans(x) for x in texts]
    where = [(i, s) for i, x in enumerate(texts) for s in windows(x)] if model else []
    found: list[list] = [[] for _ in texts]
    for k in range(0, len(where), batch):
        part = where[k : k + batch]
        codes = np.zeros((len(part), WINDOW), np.uint8)
        for j, (i, s) in enumerate(part):
            got = encode(texts[i][s : s + WINDOW])
            codes[j, : len(got)] = got
        paths = model.decode(codes.T).T
        for j in np.nonzero((paths > 0).any(1))[0].tolist():
            (i, s), path = part[j], paths[j].tolist()
            last = min(WINDOW, len(texts[i]) - s)
            t = 0
            while t < last:
                if path[t] and path[t] % 2:
                    u = t + 1
                    while u < last and path[u] == path[t] + 1:
                        u += 1
                    kind = (path[t] - 1) // 2
                    if (u < WINDOW or s + u == len(texts[i])) and plausible(kind, texts[i][s + t : s + u]):
                        found[i].append((kind, s + t, s + u, 1.0 + min(t, WINDOW - u) / WINDOW))
                    t = u
                else:
                    t += 1
    return [(b, sorted(b + reconcile(f, b)) if f else sorted(b)) for b, f in zip(base, found, strict=True)]


#: A text without this holds no span of the fixed patterns.
LIKELY = r"@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|([0-9][\x20-]?){13}"


def train(docs: DataFrame, *, sample_windows: int = 900, per_text: int = 4) -> Tagger | None:
    """Fits the tagger on the driver from at most ``sample_windows`` windows, drawn by hash over
    all texts with a digit or "@" and labelled by the fixed patterns; None where there is none.

    Texts in which a pattern may match are drawn apart from others, so that they teach the model however rare they are."""
    candidate, likely = docs.filter(F.col("text").rlike("[0-9@]")), F.col("text").rlike(LIKELY)
    counts = {r["likely"]: r["n"] for r in candidate.groupBy(likely.alias("likely")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = {k: min(1.0, 2.0 * sample_windows / max(1, counts.get(k, 0))) for k in (True, False)}
    chance = F.when(likely, F.lit(share[True])).otherwise(F.lit(share[False]))
    seen = candidate.filter(hash_unit(F.col("id"), seed="pii-sample") < chance)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("pii")
        for batch in batches:
            rows = []
            for text in (x or "" for _, part in texts_of(batch) for x in part):
                starts = windows(text)
                starts = starts[:: max(1, -(-len(starts) // per_text))]
                spans = base_spans(text) if starts else []
                for s in starts:
                    inside = [[k, a - s, b - s] for k, a, b in spans if a >= s and b <= s + WINDOW]
                    if all(b <= s or a >= s + WINDOW or (a >= s and b <= s + WINDOW) for _, a, b in spans):
                        rows.append((text[s : s + WINDOW], [x for y in inside for x in y]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["w", "s"])

    got = seen.mapInArrow(cut, "w string, s array<int>").orderBy(F.md5(F.col("w")), "w", "s").limit(sample_windows).collect()
    if not got:
        return None
    codes, tags = training_set([(r["w"], [tuple(r["s"][i : i + 3]) for i in range(0, len(r["s"]), 3)]) for r in got])
    return Tagger().fit(codes, tags)


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), redact: bool = False) -> DataFrame:
    """Finds e-mail and IP addresses, card and phone numbers in every whole text.

    Returns the id, n_email, n_ip, n_card, n_phone and base_sha256 of the fixed patterns' spans,
    spans (those and the model's), n_spans (their number) and, with ``redact``, the text with each span replaced by
    "<EMAIL>", "<IP>", "<CARD>" or "<PHONE>". The model reads overlapping windows of 96 characters over every
    stretch that can hold a span; windows are decoded by Viterbi and their spans reconciled per
    text. Spans are in code points, end exclusive.

    Edge cases: null text counts as empty (and stays null when redacting); empty tables give no
    rows and no model; without any digit or "@" to learn from, the fixed patterns work alone;
    equal rows give equal results; overlapping spans of different kinds are all reported and
    redacted as one stretch under the first kind; other columns are ignored but for ``carry``.
    """
    types = dict(docs.dtypes)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")) if carry else docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    model = train(rows.select("id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("pii")
        for batch in batches:
            for part in pieces(batch):
                some, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                found = find_spans([x or "" for x in texts], model)
                counts = np.zeros((len(some), len(KINDS)), np.int64)
                for i, (base, _) in enumerate(found):
                    for k, _, _ in base:
                        counts[i, k] += 1
                cols = [pa.array(some, batch.column(0).type)] + [pa.array(c) for c in counts.T]
                cols.append(pa.array([hashlib.sha256(join_spans(b).encode()).hexdigest() for b, _ in found]))
                cols += [pa.array([join_spans(s) for _, s in found]), pa.array([len(s) for _, s in found], pa.int64())]
                names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]
                if redact:
                    cols.append(pa.array([None if x is None else cover(x, s) for x, (_, s) in zip(texts, found, strict=True)], pa.string()))
                    names.append("redacted")
                if carry:
                    cols.append(part.column(2))
                    names.append("row")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"id {types[id_col]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    schema += ", redacted string" * redact + (f", row {rows.schema['row'].dataType.simpleString()}" if carry else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def cover(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with its spans replaced; overlapping ones as one."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]
