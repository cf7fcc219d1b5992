"""Quality classifier: attention-based multiple-instance learning over passages.

A text is a bag of passages of `PASSAGE` words. Every passage is encoded through a learned tanh layer h, from its words
(counts of `HASHED` hash buckets) and from measured shares (character classes, word shapes, repeats). Gated attention
weighs the passages, a = softmax(w . (tanh(V h) * sigmoid(U h))), and a logistic unit scores the weighted sum of the
encodings. Only documents are labelled; the encoder, the attention and the classifier are learned together from them by
Adam on the driver.

The caller bounds the labelled documents that are learned from, and `LEARNED` bounds their passages, so the driver's
memory doesn't grow with the length of texts: documents are taken in the order of a hash of their passages, and one that
no longer fits, or has over an eighth of `LEARNED` alone, is passed over. All passages of the documents taken are used;
a step adds up its gradient over groups of at most `GROUP` passages or one document. Scoring uses all passages of all
texts, encoded in parts of `PART`. Defined cases: null and empty texts are one passage without words; nothing to learn from, or one class
only: the score is the smoothed share of label 1; a score of just 0.5 predicts 1; repeated rows score alike; of equal
attention the first passage is the top one; an empty table gives an empty result; input columns are carried in `row`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.rows import map_text
from corvane.llm.shingles import mix
from corvane.scratch import stored

PASSAGE, HASHED, PART = 64, 256, 4096
LEARNED, GROUP = 262_144, 32_768  # passages: 324 bytes each on the driver, 2 KB each while a group's gradient is taken
CLASSES = (b"#*$%&", b"|<>", b"!?", b".,;:", b"\n", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"@/\\_=+-~^")
N_FEATURES = len(CLASSES) + 9
FIELDS = "score double, predicted int, n_passages long, top_passage long"

_CLASS = np.full(256, len(CLASSES), np.uint8)
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c)] = _i
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def passages(b: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Measured shares and counts of hashed words, one row per passage of a text."""
    x = np.frombuffer(b or b"", np.uint8)
    space = _SPACE[x]
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(x) else np.zeros(0, int)
    if not len(start):
        out = np.zeros((1, N_FEATURES), np.float32)
        out[0, -1] = 1
        return out, np.zeros((1, HASHED), np.uint8)
    length = np.diff(np.append(start, len(x)))
    place = np.arange(len(x)) - np.repeat(start, length) if start[0] == 0 else np.arange(len(x)) - np.concatenate((np.zeros(start[0], int), np.repeat(start, length)))
    value = np.where(space, 0, x.astype(np.uint64) * (np.uint64(0x9E3779B97F4A7C15) * (2 * place.astype(np.uint64) + np.uint64(1))))
    word = np.add.reduceat(value, start)  # sums of mixed bytes, modulo 2**64
    size = np.add.reduceat((~space).astype(np.int32), start)
    at = np.arange(0, len(start), PASSAGE)
    first = start[at]
    n_words = np.diff(np.append(at, len(start))).astype(float)
    n_bytes = np.diff(np.append(first, len(x))).astype(float)
    cls = _CLASS[x]
    out = np.empty((len(at), N_FEATURES), np.float32)
    for i in range(len(CLASSES)):
        out[:, i] = np.add.reduceat((cls == i).astype(np.int32), first) / n_bytes
    k = len(CLASSES)
    same = np.concatenate(([0], (word[1:] == word[:-1]).astype(np.int32)))
    out[:, k] = np.add.reduceat(same, at) / n_words
    order = np.lexsort((word, np.arange(len(word)) // PASSAGE))
    bag = order // PASSAGE
    fresh = np.concatenate(([1], ((word[order][1:] != word[order][:-1]) | (bag[1:] != bag[:-1])).astype(np.int32)))
    out[:, k + 1] = np.add.reduceat(fresh, at) / n_words
    out[:, k + 2] = np.add.reduceat(size, at) / n_words / 10
    out[:, k + 3] = np.add.reduceat((size <= 2).astype(np.int32), at) / n_words
    out[:, k + 4] = np.add.reduceat((size >= 10).astype(np.int32), at) / n_words
    out[:, k + 5] = np.add.reduceat((x >= 128).astype(np.int32), first) / n_bytes
    out[:, k + 6] = np.log1p(n_words) / 5
    out[:, k + 7] = np.log1p(len(start)) / 10
    out[:, k + 8] = 0
    slot = (mix(word) >> np.uint64(56)).astype(np.int64)
    counts = np.empty((len(at), HASHED), np.uint8)
    for lo in range(0, len(at), PART):
        part = slot[lo * PASSAGE : (lo + PART) * PASSAGE]
        n = min(PART, len(at) - lo)
        counts[lo : lo + n] = np.bincount(np.arange(len(part)) // PASSAGE * HASHED + part, minlength=n * HASHED).reshape(n, HASHED)
    return out, counts


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """p: mean, scale, W, b (encoder), V, U, w (gated attention), c, d (classifier)."""

    def __init__(self, p: dict):
        self.p = p

    def features(self, stats: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.hstack(((stats - self.p["mean"]) / self.p["scale"], np.sqrt(counts / np.float32(PASSAGE))))

    def encode(self, stats: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The encodings of passages."""
        return np.concatenate([np.tanh(self.features(stats[i : i + PART], counts[i : i + PART]) @ self.p["W"] + self.p["b"]) for i in range(0, len(stats), PART)])

    def bags(self, h: np.ndarray, first: np.ndarray) -> tuple:
        """Scores and attention of bags: encodings h, bags beginning at `first`."""
        p = self.p
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        size = np.diff(np.append(first, len(h)))
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
        a /= np.repeat(np.add.reduceat(a, first), size)
        z = np.add.reduceat(a[:, None] * h, first)
        return _sigmoid(z @ p["c"] + p["d"]), a, t, s, z, size

    def scorer(self):
        def score(texts: list) -> list:
            out: list = [[], [], [], []]
            for lo in range(0, len(texts), 64):
                rows = [self.encode(*passages(b)) for b in texts[lo : lo + 64]]
                first = np.cumsum([0, *[len(r) for r in rows[:-1]]])
                y, a, *_ = self.bags(np.concatenate(rows), first)
                for i, r in enumerate(rows):
                    v = float(y[i])
                    out[0].append(v), out[1].append(int(v >= 0.5)), out[2].append(len(r)), out[3].append(int(a[first[i] : first[i] + len(r)].argmax()))
            return out

        return score


def constant(share: float) -> Model:
    f = N_FEATURES
    return Model({"mean": np.zeros(f), "scale": np.ones(f), "W": np.zeros((f + HASHED, 1)), "b": np.zeros(1), "V": np.zeros((1, 1)), "U": np.zeros((1, 1)), "w": np.zeros(1), "c": np.zeros(1), "d": np.array(np.log(share / (1 - share)))})


def loss_and_gradient(model: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean logistic loss of bags of features x that begin at `first`, and its gradient."""
    p = model.p
    h = np.tanh(x @ p["W"] + p["b"])
    prob, a, t, s, z, n = model.bags(h, first)
    loss = -float(np.mean(np.where(y > 0.5, np.log(prob), np.log1p(-prob))))
    dz0 = (prob - y) / len(y)
    dz = np.repeat(dz0[:, None] * p["c"], n, 0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, first), n))
    dts = de[:, None] * p["w"]
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
    return loss, {"c": z.T @ dz0, "d": np.array(dz0.sum()), "w": (t * s).T @ de, "V": h.T @ dt, "U": h.T @ ds, "W": x.T @ dh, "b": dh.sum(0)}


def groups(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges (lo, hi) of consecutive bags with at most `most` passages, one bag at least."""
    ends, out, lo = np.cumsum(size), [], 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        out.append((lo, hi))
        lo = hi
    return out


def step_gradient(model: Model, stats: np.ndarray, counts: np.ndarray, first: np.ndarray, size: np.ndarray, y: np.ndarray, pick: np.ndarray, most: int = GROUP) -> dict:
    """The gradient of the mean loss of the picked bags, added up group by group."""
    total: dict = {}
    for lo, hi in groups(size[pick], most):
        part = pick[lo:hi]
        rows = np.concatenate([np.arange(first[i], first[i] + size[i]) for i in part])
        at = np.cumsum(np.append(0, size[part][:-1]))
        _, grad = loss_and_gradient(model, model.features(stats[rows], counts[rows]), at, y[part])
        for k, v in grad.items():
            total[k] = total.get(k, 0) + v * (len(part) / len(pick))
    return total


def fit(stats: np.ndarray, counts: np.ndarray, size: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 500, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Encoder, gated attention and classifier together, by Adam on the logistic loss; size: passages of each bag."""
    if not len(y) or y.min() == y.max():
        return constant((y.sum() + 1) / (len(y) + 2))
    rng = np.random.default_rng(seed)
    first = np.cumsum(np.append(0, size[:-1]))
    g = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"mean": stats.mean(0), "scale": stats.std(0) + np.float32(1e-3), "W": g(N_FEATURES + HASHED, hidden).astype(np.float32), "b": np.zeros(hidden), "V": g(hidden, gate), "U": g(hidden, gate), "w": np.zeros(gate), "c": g(hidden), "d": np.array(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))}
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k not in ("mean", "scale")}
    model = Model(p)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(y), min(batch, len(y)))
        grad = step_gradient(model, stats, counts, first, size, y, pick)
        lr = rate * (1 - step / (steps + 1))
        for k, v in grad.items():
            v = v + decay * p[k]
            m[k] = (0.9 * m[k][0] + 0.1 * v, 0.99 * m[k][1] + 0.01 * v * v)
            p[k] = p[k] - lr * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.99**step)) + 1e-8)
    return model


def taken(sizes: list[tuple[int, int]], most: int) -> set[int] | None:
    """Which hashes of (hash, passages) are learned from, in the order of hashes; None if all fit."""
    left, out = most, set()
    for h, n in sorted(sizes):
        if n <= min(left, most // 8):
            left -= n
            out.add(h)
    return None if len(out) == len(sizes) else out


def learn(train: DataFrame, learned: int = LEARNED, **how) -> Model:
    """A Model from (text, y) rows, which the caller has bounded, and `learned` passages of them at most.

    Passages are measured on the executors and written; the driver reads two numbers a row, then the passages it takes.
    """

    def make():
        def run(texts: list) -> list:
            got = [passages(b) for b in texts]
            return [[s.astype("<f4").tobytes() for s, _ in got], [c.tobytes() for _, c in got]]

        return run

    got = stored(map_text(train, make, "stats binary, counts binary", "text", ["y"]).select("row.y", "stats", "counts", F.xxhash64("stats", "counts").alias("h")), "passages")
    sizes = got.groupBy("h").agg(F.sum(F.length("counts") / HASHED).cast("long").alias("n")).collect()
    chosen = taken([(r["h"], r["n"]) for r in sizes], learned)
    if chosen is not None:
        got = got.join(F.broadcast(got.sparkSession.createDataFrame([(h,) for h in chosen], "h long")), "h", "left_semi")
    got = got.select("y", "stats", "counts").toPandas().sort_values(["y", "stats", "counts"], kind="stable")
    stats = np.frombuffer(b"".join(got["stats"]), "<f4").reshape(-1, N_FEATURES)
    counts = np.frombuffer(b"".join(got["counts"]), np.uint8).reshape(-1, HASHED)
    return fit(stats, counts, np.array([len(b) // HASHED for b in got["counts"]], np.int64), got["y"].to_numpy(float), **how)


def quality(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row` and the columns of FIELDS for every row."""
    return map_text(docs, model.scorer, FIELDS, text, carry)
