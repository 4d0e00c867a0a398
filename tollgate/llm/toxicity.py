"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

The input of a step is a word: the sum of an embedding of the whole word and the mean of
embeddings of its character n-grams (hashed), so unseen words are read by their characters.
A gated recurrent layer runs over a window of words in either direction, attention pools its
states, and a logistic output scores the window.  A text is cut into overlapping windows that
cover all of it; its score is that of its most toxic window.  Training picks that window in the
same way, from texts with few windows at first.

The model is fitted on a bounded sample of labelled rows (``SAMPLE`` per class at most, of texts
up to ``SAMPLE_CHARS`` characters, chosen by hash); texts are the only input.  Scoring covers
every text whole, in batches of windows.

Edge cases: null and empty texts are one window without words and get a score; rows with null or
repeated doc_id are scored like any other (a null doc_id isn't held out); labels other than 0 and
1 are left out; without labels of both classes every score is the training share of toxic rows
(0 without any); an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import column, map_batches, texts

SAMPLE = 2500           # labelled rows of each class that are fitted
SAMPLE_CHARS = 20_000   # longest text that is fitted on (any length is scored)
WINDOW, STRIDE = 256, 192  # words of a window, and from one window to the next
BUCKETS, DIM, HIDDEN, ATTEND = 1 << 14, 12, 8, 8
EPOCHS, RATE, BATCH = 12, 0.02, 128
DECAY = 1.5             # share of a parameter that goes in a step, times the rate: keeps the fit from learning texts by heart
GRAMS = (5, 6, 7)       # characters (bytes of the marked word) of an n-gram
MEMO = 1 << 17          # words remembered per worker
GROUP = 1024            # windows scored together
WORD = re.compile(r"[^\W_]+")


# ---- words as inputs ---------------------------------------------------------


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, ends): per word its own bucket and then those of its character n-grams."""
    raw = [b"<" + w.encode() + b">" for w in words]
    n = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    start = np.cumsum(n) - n
    word_of = np.repeat(np.arange(len(raw)), n)
    left = start[word_of] + n[word_of] - np.arange(len(data))  # bytes to the end of the word
    parts, owner = [], []
    whole = np.array([zlib.crc32(r) for r in raw], np.uint64)
    parts.append(whole)
    owner.append(np.arange(len(raw)))
    roll = np.zeros(len(data), np.uint64)
    for k in range(max(GRAMS)):  # a rolling hash of the k + 1 bytes from each place
        shifted = np.zeros(len(data), np.uint64)
        shifted[: max(0, len(data) - k)] = data[k:]
        roll = (roll * np.uint64(0x100000001B3) + shifted + np.uint64(1)) & np.uint64((1 << 40) - 1)
        if k + 1 in GRAMS:
            at = np.flatnonzero(left > k)
            h = roll[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            parts.append(h >> np.uint64(20))
            owner.append(word_of[at])
    buckets, owner = np.concatenate(parts), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=len(raw)))
    return (buckets[order] % np.uint64(BUCKETS)).astype(np.int64), ends


def inputs(table: np.ndarray, buckets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The word's own embedding plus the mean of its n-grams'."""
    starts = np.concatenate([[0], ends[:-1]])
    own = table[buckets[starts]]
    total = np.add.reduceat(table[buckets], starts, axis=0) - own
    return own + total / np.maximum(ends - starts - 1, 1)[:, None].astype(table.dtype)


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover n words."""
    if n <= WINDOW:
        return [(0, n)]
    starts = range(0, n - WINDOW, STRIDE)
    return [(a, a + WINDOW) for a in starts] + [(n - WINDOW, n)]


# ---- the network -------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_parameters(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    r = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
    h = HIDDEN
    return {
        "E": r(BUCKETS, DIM, s=0.1), "Wf": r(DIM, 3 * h), "Wb": r(DIM, 3 * h), "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32),
        "Uf": r(h, 3 * h), "Ub": r(h, 3 * h), "A": r(2 * h, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": r(ATTEND),
        "o": r(2 * h), "c": np.full(1, -1.0, np.float32),
    }


def run_direction(gates: np.ndarray, idx: np.ndarray, active: np.ndarray, u: np.ndarray, states: np.ndarray, steps, keep: list | None) -> None:
    """One gated recurrent layer over windows sorted by falling length; ``active[t]`` of them reach step t."""
    h = np.zeros((idx.shape[0], HIDDEN), np.float32)
    for t in steps:
        k = active[t]
        x, old = gates[idx[:k, t]], h[:k]
        hu = old @ u
        zr = sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        hn = hu[:, 2 * HIDDEN :]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * hn)
        new = n + z * (old - n)
        if keep is not None:
            keep.append((t, k, old.copy(), z, r, hn, n))
        h[:k] = new
        states[t, :k] = new


def forward(p: dict, gf: np.ndarray, gb: np.ndarray, idx: np.ndarray, length: np.ndarray, keep: bool = False):
    """Logits of windows sorted by falling length; idx (windows x steps) are rows of the gate inputs."""
    steps = int(length[0]) if len(length) else 0
    b = len(length)
    if not steps:
        return np.full(b, p["c"][0], np.float32), None
    active = (length[None, :] > np.arange(steps)[:, None]).sum(axis=1)
    s = np.zeros((steps, b, 2 * HIDDEN), np.float32)
    kf, kb = ([], []) if keep else (None, None)
    run_direction(gf, idx, active, p["Uf"], s[:, :, :HIDDEN], range(steps), kf)
    run_direction(gb, idx, active, p["Ub"], s[:, :, HIDDEN:], range(steps - 1, -1, -1), kb)
    q = np.tanh(s @ p["A"] + p["a"])
    e = q @ p["v"]
    there = np.arange(steps)[:, None] < length[None, :]
    e = np.where(there, e, -1e30)
    w = np.exp(e - e.max(axis=0)) * there
    w /= np.maximum(w.sum(axis=0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", w, s)
    return pooled @ p["o"] + p["c"][0], (s, q, w, pooled, kf, kb, steps) if keep else None


def backward_direction(keep: list, ds: np.ndarray, u: np.ndarray, idx: np.ndarray, rows: int, grad_u: np.ndarray):
    """Gradient of the gate inputs by row."""
    dgates = np.zeros((rows, 3 * HIDDEN), np.float32)
    dh = np.zeros((idx.shape[0], HIDDEN), np.float32)
    h3 = 3 * HIDDEN
    flat_i, flat_d = [], []
    for t, k, old, z, r, hn, n in reversed(keep):
        d = dh[:k] + ds[t, :k]
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (old - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dx = np.concatenate([dz, dr, dn], axis=1)
        du = np.concatenate([dz, dr, dn * r], axis=1)
        grad_u += old.T @ du
        dh[:k] = d * z + du @ u.T
        flat_i.append(idx[:k, t])
        flat_d.append(dx)
    i, d = np.concatenate(flat_i), np.concatenate(flat_d)
    for c in range(h3):
        dgates[:, c] = np.bincount(i, weights=d[:, c], minlength=rows)
    return dgates


def backward(p: dict, state, dlogit: np.ndarray, idx: np.ndarray, rows: int):
    s, q, w, pooled, kf, kb, steps = state
    g = {"o": pooled.T @ dlogit, "c": dlogit.sum(keepdims=True)}
    dpooled = dlogit[:, None] * p["o"]
    ds = w[:, :, None] * dpooled[None]
    dw = np.einsum("tbh,bh->tb", s, dpooled)
    de = w * (dw - (w * dw).sum(axis=0))
    g["v"] = np.einsum("tbk,tb->k", q, de)
    dq = de[:, :, None] * p["v"] * (1 - q * q)
    g["A"], g["a"] = np.einsum("tbh,tbk->hk", s, dq), dq.sum(axis=(0, 1))
    ds = ds + dq @ p["A"].T
    g["Uf"], g["Ub"] = np.zeros_like(p["Uf"]), np.zeros_like(p["Ub"])
    return g, backward_direction(kf, ds[:, :, :HIDDEN], p["Uf"], idx, rows, g["Uf"]), backward_direction(kb, ds[:, :, HIDDEN:], p["Ub"], idx, rows, g["Ub"])


def all_gates(p: dict, buckets: np.ndarray, ends: np.ndarray, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Gate inputs of many words, some at a time."""
    out = [np.zeros((len(ends), 3 * HIDDEN), np.float32) for _ in range(2)]
    for k in range(0, len(ends), step):
        at = ends[k - 1] if k else 0
        part = ends[k : k + step]
        for whole, some in zip(out, gates(p, inputs(p["E"], buckets[at : part[-1]], part - at))):
            whole[k : k + step] = some
    return out[0], out[1]


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after the other."""
    n = ends - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Sample:
    """Tokenised texts: words by number, their buckets, and the windows of each text."""

    def __init__(self, batch: list[str]):
        number: dict[str, int] = {}
        self.docs = [np.array([number.setdefault(w, len(number)) for w in WORD.findall(t.lower())], np.int64) for t in batch]
        names, parts, at = list(number), [], 0
        self.ends = np.zeros(len(names), np.int64)
        for k in range(0, len(names), 20_000):
            buckets, ends = word_buckets(names[k : k + 20_000])
            parts.append(buckets.astype(np.uint16))
            self.ends[k : k + 20_000] = at + ends
            at += len(buckets)
        self.buckets = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
        self.spans = [windows(len(d)) for d in self.docs]

    def stack(self, pick: list[tuple[int, int, int]]):
        """(idx, lengths, order) of windows (text, from, to), by falling length."""
        length = np.array([b - a for _, a, b in pick], np.int64)
        order = np.argsort(-length, kind="stable")
        idx = np.zeros((len(pick), int(length.max(initial=0))), np.int64)
        for row, k in enumerate(order.tolist()):
            d, a, b = pick[k]
            idx[row, : b - a] = self.docs[d][a:b]
        return idx, length[order], order


def gates(p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x @ p["Wf"] + p["bf"]).astype(np.float32), (x @ p["Wb"] + p["bb"]).astype(np.float32)


def worst_windows(p: dict, sample: Sample, gf, gb, chosen: list[int]) -> list[tuple[int, int, int]]:
    """For each chosen text the window that the model finds most toxic."""
    all_windows = [(d, a, b) for d in chosen for a, b in sample.spans[d]]
    logit = np.zeros(len(all_windows), np.float32)
    by_length = sorted(range(len(all_windows)), key=lambda k: all_windows[k][2] - all_windows[k][1])
    for at in range(0, len(by_length), GROUP):
        part = by_length[at : at + GROUP]
        idx, length, order = sample.stack([all_windows[k] for k in part])
        logit[np.array(part)[order]] = forward(p, gf, gb, idx, length)[0]
    best: dict[int, int] = {}
    for k, (d, _, _) in enumerate(all_windows):
        if d not in best or logit[k] > logit[best[d]]:
            best[d] = k
    return [all_windows[best[d]] for d in chosen]


def train(batch: list[str], toxic: list[int], seed: int = 7, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Fit the network to texts and their labels."""
    p = new_parameters(seed)
    y = np.array(toxic, np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        p["o"][:] = 0
        p["c"][:] = -30.0 if share == 0 else 30.0
        return p
    sample = Sample(batch)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    starts = np.concatenate([[0], sample.ends[:-1]])
    share_of = (1 / np.maximum(sample.ends - starts - 1, 1)).astype(np.float32)  # weight of a word's n-gram
    step = 0
    for epoch in range(epochs):
        limit = 3 if epoch < 2 else 10**9  # texts with few windows first: their label is about them
        pool = np.array([d for d in range(len(batch)) if len(sample.docs[d]) and len(sample.spans[d]) <= limit])
        if not len(pool):
            continue
        rate = RATE * (1 - epoch / epochs) + 0.002
        picks = None
        for at in range(0, len(pool), BATCH):
            if at % (BATCH * 16) == 0:  # the most toxic windows, by the model as it is now
                if at == 0:
                    rng.shuffle(pool)
                gf, gb = all_gates(p, sample.buckets, sample.ends)
                picks = worst_windows(p, sample, gf, gb, pool[at : at + BATCH * 16].tolist())
            part = picks[at % (BATCH * 16) : at % (BATCH * 16) + BATCH]
            idx, length, order = sample.stack(part)
            used, local = np.unique(idx, return_inverse=True)
            idx = local.reshape(idx.shape)
            rows = ranges(starts[used], sample.ends[used])
            ends = np.cumsum(sample.ends[used] - starts[used])
            x = inputs(p["E"], sample.buckets[rows], ends)
            gf, gb = gates(p, x)
            logit, state = forward(p, gf, gb, idx, length, keep=True)
            want = y[[part[k][0] for k in order]]
            dlogit = ((sigmoid(logit) - want) / len(part)).astype(np.float32)
            g, dgf, dgb = backward(p, state, dlogit, idx, len(used))
            g["Wf"], g["Wb"], g["bf"], g["bb"] = x.T @ dgf, x.T @ dgb, dgf.sum(axis=0), dgb.sum(axis=0)
            dx = dgf @ p["Wf"].T + dgb @ p["Wb"].T
            local_owner = np.repeat(np.arange(len(used)), sample.ends[used] - starts[used])
            touched, at_bucket = np.unique(sample.buckets[rows], return_inverse=True)
            weight = share_of[used][local_owner]
            weight[ends - (sample.ends[used] - starts[used])] = 1  # the word's own embedding
            de = dx[local_owner] * weight[:, None]
            ge = np.stack([np.bincount(at_bucket, weights=de[:, c], minlength=len(touched)) for c in range(DIM)], axis=1)
            step += 1
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            for k, grad in (*g.items(), ("E", ge)):
                at_rows = touched if k == "E" else slice(None)
                grad = np.clip(grad, -1, 1).astype(np.float32)
                m[k][at_rows] = 0.9 * m[k][at_rows] + 0.1 * grad
                s[k][at_rows] = 0.999 * s[k][at_rows] + 0.001 * grad * grad
                p[k][at_rows] *= np.float32(1 - rate * DECAY)
                p[k][at_rows] -= rate * (m[k][at_rows] / fix1) / (np.sqrt(s[k][at_rows] / fix2) + 1e-7)
    return p


# ---- scoring -----------------------------------------------------------------


class Scorer:
    """Scores whole texts; gate inputs of words are remembered in a bounded table."""

    def __init__(self, p: dict):
        self.p = p
        self.number: dict[str, int] = {}
        self.gf = np.zeros((0, 3 * HIDDEN), np.float32)
        self.gb = self.gf

    def learn(self, new: list[str]) -> None:
        fresh = [gates(self.p, inputs(self.p["E"], *word_buckets(new[k : k + 20_000]))) for k in range(0, len(new), 20_000)]
        at = len(self.number)
        self.number.update(zip(new, range(at, at + len(new))))
        if at + len(new) > len(self.gf):  # grow by half, so that rows are rarely copied
            size = max(at + len(new), len(self.gf) * 3 // 2)
            for name in ("gf", "gb"):
                grown = np.zeros((size, 3 * HIDDEN), np.float32)
                grown[:at] = getattr(self, name)[:at]
                setattr(self, name, grown)
        for f, b in fresh:
            self.gf[at : at + len(f)], self.gb[at : at + len(f)] = f, b
            at += len(f)

    def logits(self, batch: list[str]) -> np.ndarray:
        docs = [WORD.findall(t.lower()) for t in batch]
        if len(self.number) > MEMO:
            self.number = {}
        new = set().union(*docs).difference(self.number)
        if new:
            self.learn(sorted(new))
        known = self.number.__getitem__
        best = np.full(len(batch), -np.inf, np.float32)
        spans, flat, at = [], [], 0
        for d, found in enumerate(docs):
            spans += [(b - a, at + a, d) for a, b in windows(len(found))]
            flat.append(np.fromiter(map(known, found), np.int32, len(found)))
            at += len(found)
        words = np.concatenate([*flat, np.zeros(WINDOW, np.int32)])
        spans.sort(key=lambda x: -x[0])
        all_spans = np.array(spans, np.int64).reshape(-1, 3)
        for k in range(0, len(spans), GROUP):
            length, start, doc = all_spans[k : k + GROUP].T
            idx = words[start[:, None] + np.arange(length[0])[None, :]] if length[0] else np.zeros((len(length), 0), np.int32)
            logit, _ = forward(self.p, self.gf, self.gb, idx, length)
            np.maximum.at(best, doc, logit)
        return best

    def scores(self, batch: list[str]) -> np.ndarray:
        """Between 0 and 1, of any number of texts, a bounded number of characters at a time."""
        out, at = [], 0
        while at < len(batch):
            end, size = at, 0
            while end < len(batch) and (end == at or size + len(batch[end]) <= 1 << 20):
                size += len(batch[end])
                end += 1
            out.append(self.logits(batch[at:end]))
            at = end
        logit = np.concatenate(out).astype(np.float64) if out else np.zeros(0)
        return 1 / (1 + np.exp(-logit))


_scorers: dict[int, Scorer] = {}


def scorer(key: int, p: dict) -> Scorer:
    """One scorer per worker process and model."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(p)
    return _scorers[key]


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Train on a bounded sample of the labelled rows that aren't held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("by", F.xxhash64("doc_id"))
    of = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    parts = [usable.where(F.col("toxic") == c).orderBy("by", "doc_id").limit(sample) for c in (0, 1)]
    chosen = parts[0].union(parts[1]).select(F.col("doc_id").alias("_id"), "toxic")  # 2 * sample rows at most
    found = docs.select("doc_id", "text").where(F.char_length("text") <= SAMPLE_CHARS)
    rows = found.join(F.broadcast(chosen), found["doc_id"] == chosen["_id"])
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))  # a repeated doc_id: its first text in order
    rows = sorted((r.doc_id, r.text, r.toxic) for r in rows.collect())
    y = [y for *_, y in rows]
    model = train([t for _, t, _ in rows], y)
    if 0 < sum(y) < len(y) and of.get(0) and of.get(1):  # the sample holds the classes in other shares
        model["c"] += np.float32(np.log(of[1] / of[0]) - np.log(sum(y) / (len(y) - sum(y))))
    return model


def score_documents(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    key = zlib.crc32(b"".join(v.tobytes() for v in model.values()))

    def run(batch: pa.RecordBatch):
        ids = column(batch, "doc_id").cast(pa.int64())
        score = scorer(key, model).scores(texts(batch))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([held_out(d) for d in ids.to_pylist()], pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """The rows whose text isn't predicted toxic, all columns kept."""
    key = zlib.crc32(b"".join(v.tobytes() for v in model.values()))

    def run(batch: pa.RecordBatch):
        yield batch.filter(pa.array(scorer(key, model).scores(texts(batch)) < 0.5))

    return map_batches(docs, run, docs.schema)
