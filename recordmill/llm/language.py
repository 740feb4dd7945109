"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample: ``per_language`` texts of each language, the
first by a hash of their ids, and ``sample_chars`` characters of each. Every language of a learnable row is learned, up to ``max_languages``. Whole texts are cut into windows of ``WINDOW`` bytes; each position of each window gets
label log-probabilities from the forward and the backward state, and a document's are their means over all its
positions, so texts of any length are read in full and in bounded memory.

Null text and text without a letter give ``und`` with score 0, and so does every text if nothing can be learned. One
learned language gives that language. Repeated rows get one language, and scores equal to six digits, as products in
single precision depend on the batch; other columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold

WINDOW = 64
HIDDEN = 8
#: Windows that run side by side; bounds memory to a few MB.
BATCH = 4096


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (window x position), valid lengths and the text number of each window."""
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = -(-lengths // size)
    owner = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    padded = np.frombuffer(b"".join(t + b"\0" * (-len(t) % size) for t in texts), np.uint8).reshape(-1, size)
    return padded, np.minimum(size, lengths[owner] - within * size), owner


def init(langs: int, rng: np.random.Generator, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    p = {"out": rng.normal(0, 0.3, (langs, 2 * hidden)), "bias": np.zeros((langs, 1))}
    for d in "fb":
        p[f"w{d}"] = rng.normal(0, 0.3, (3 * hidden, 256))
        p[f"u{d}"] = rng.normal(0, 0.3, (3 * hidden, hidden))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(w: np.ndarray, u: np.ndarray, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (step x hidden x window) for bytes (step x window); update, reset and candidate rows in this order."""
    hidden, n = u.shape[1], steps.shape[1]
    out, h = np.empty((len(steps), hidden, n), np.float32), np.zeros((hidden, n), np.float32)
    a, hu = np.empty((3 * hidden, n), np.float32), np.empty((3 * hidden, n), np.float32)
    half = w.copy()
    half[: 2 * hidden] *= 0.5
    uh = u.copy()
    uh[: 2 * hidden] *= 0.5  # sigmoid(x) = (1 + tanh(x/2)) / 2
    for t, x in enumerate(steps):
        np.take(half, x, axis=1, out=a, mode="clip")
        np.matmul(uh, h, out=hu)
        gate = a[: 2 * hidden]
        gate += hu[: 2 * hidden]
        np.tanh(gate, out=gate)
        gate += 1
        gate *= 0.5
        z, r, c = a[:hidden], a[hidden : 2 * hidden], a[2 * hidden :]
        if keep is not None:
            keep.append((h.copy(), z.copy(), r.copy(), hu[2 * hidden :].copy()))
        r *= hu[2 * hidden :]
        c += r
        np.tanh(c, out=c)
        if keep is not None:
            keep[-1] += (c.copy(),)
        h -= c
        h *= z
        h += c
        out[t] = h
    return out


def log_probs(p: dict[str, np.ndarray], steps: np.ndarray) -> np.ndarray:
    """Log-probabilities (step x label x window) of every position."""
    f, b = _run(p["wf"], p["uf"], steps), _run(p["wb"], p["ub"], steps[::-1])[::-1]
    hidden = f.shape[1]
    z = np.matmul(p["out"][:, :hidden], f) + np.matmul(p["out"][:, hidden:], b) + p["bias"]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _backward(w, u, steps, kept, dh_all):
    """Gradients of the loss through time."""
    hidden = u.shape[1]
    dw, du, dh = np.zeros_like(w), np.zeros_like(u), np.zeros_like(kept[0][0])
    for t in range(len(steps) - 1, -1, -1):
        h, z, r, hc, c = kept[t]
        dh = dh + dh_all[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * hc * r * (1 - r)
        da = np.concatenate([dz, dr, dc])
        dhu = np.concatenate([dz, dr, dc * r])
        du += dhu @ h.T
        for k in range(3 * hidden):
            dw[k] += np.bincount(steps[t], weights=da[k], minlength=256).astype(np.float32)
        dh = dh * z + u.T @ dhu
    return dw, du


def loss_gradients(p, steps, label):
    kf, kb = [], []
    f, b = _run(p["wf"], p["uf"], steps, kf), _run(p["wb"], p["ub"], steps[::-1], kb)[::-1]
    hidden, n = f.shape[1], steps.size
    z = np.matmul(p["out"][:, :hidden], f) + np.matmul(p["out"][:, hidden:], b) + p["bias"]
    z -= z.max(axis=1, keepdims=True)
    q = np.exp(z)
    q /= q.sum(axis=1, keepdims=True)
    hot = np.arange(q.shape[1])[:, None] == label
    loss = float(-np.log(np.maximum((q * hot).sum(axis=1), 1e-30)).mean())
    dz = (q - hot) / n
    g = {"bias": dz.sum(axis=(0, 2))[:, None]}
    g["out"] = np.concatenate([np.einsum("tln,thn->lh", dz, f), np.einsum("tln,thn->lh", dz, b)], axis=1)
    df, db = np.matmul(p["out"][:, :hidden].T, dz), np.matmul(p["out"][:, hidden:].T, dz)
    g["wf"], g["uf"] = _backward(p["wf"], p["uf"], steps, kf, df)
    g["wb"], g["ub"] = _backward(p["wb"], p["ub"], steps[::-1], kb, db[::-1])
    return loss, g


@dataclass
class Model:
    langs: list[str]
    params: dict[str, np.ndarray]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Languages and pooled probabilities; equal texts of a call are read once."""
        order = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        raw = [t.encode("utf-8", "replace") for t in order]
        n = max(1, len(self.langs))
        total = np.zeros((len(raw), n))
        block: list[int] = []
        held = 0
        for i, t in enumerate(raw):
            for at in range(0, max(1, len(t)), WINDOW * BATCH) if len(t) > WINDOW * BATCH else ():
                self._add(total, [i], [t[at : at + WINDOW * BATCH]])
            if 0 < len(t) <= WINDOW * BATCH:
                block.append(i)
                held += -(-len(t) // WINDOW)
            if held >= BATCH:
                self._add(total, block, [raw[k] for k in block])
                block, held = [], 0
        if block:
            self._add(total, block, [raw[k] for k in block])
        size = np.array([max(1, len(t)) for t in raw])[:, None]
        mean = total / size
        prob = np.exp(mean - mean.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        best = prob.argmax(axis=1)
        said = [bool(self.langs) and any(c.isalpha() for c in t) for t in order]
        langs = [self.langs[b] if s else "und" for b, s in zip(best, said, strict=True)]
        scores = [float(prob[i, b]) if s else 0.0 for i, (b, s) in enumerate(zip(best, said, strict=True))]
        at = [order[t] for t in texts]
        return [langs[i] for i in at], [scores[i] for i in at]

    def _add(self, total: np.ndarray, which: list[int], texts: list[bytes]) -> None:
        if not self.langs:
            return
        data, valid, owner = windows(texts)
        number = np.array(which)[owner]
        for a in range(0, len(data), BATCH):
            lp = log_probs(self.params, np.ascontiguousarray(data[a : a + BATCH].T))
            lp *= (np.arange(WINDOW)[:, None] < valid[a : a + BATCH])[:, None, :]
            np.add.at(total, number[a : a + BATCH], lp.sum(axis=0).T)


def fit(samples: dict[str, list[bytes]], steps: int = 240, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Model:
    """Adam over balanced batches of full windows; ``samples`` gives texts by language."""
    langs = sorted(k for k, v in samples.items() if any(v))
    if len(langs) < 2:
        return Model(langs, init(max(1, len(langs)), np.random.default_rng(seed)))
    rng = np.random.default_rng(seed)
    pools = [windows(samples[k])[0] for k in langs]
    p = init(len(langs), rng)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    label = np.arange(batch) % len(langs)
    for t in range(1, steps + 1):
        x = np.stack([pools[k][rng.integers(len(pools[k]))] for k in label])
        _, g = loss_gradients(p, np.ascontiguousarray(x.T), label)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        now = rate * (1 - t / (steps + 1))
        for k in p:
            gk = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.99 * v[k] + 0.01 * gk * gk
            p[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return Model(langs, p)


def train(docs: DataFrame, held_out: int = 2, per_language: int = 300, sample_chars: int = 2048, max_languages: int = 200) -> Model:
    """Fit on rows with text and language whose crc32 fold (of 4) isn't ``held_out``.

    The fit alone reads a bounded sample: of each language the first ``per_language`` texts by a hash of their ids, and
    of each text ``sample_chars`` characters from a place that the same hash chooses. Of more than ``max_languages``
    languages those with most texts are learned, ties by name, so that what the driver holds and the network's outputs
    are bounded whatever the column holds.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != held_out)).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")  # the rank limit is met in each task before the shuffle
    learned = rows.where("text <> ''").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).select("lang")
    rows = rows.join(F.broadcast(learned), "lang")  # at most max_languages rows
    ids = rows.where("text <> ''").select("doc_id", "lang").withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).select("doc_id", "lang").distinct()
    start = 1 + F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - sample_chars)).cast("int")
    some = rows.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min(F.substring("text", start, F.lit(sample_chars))).alias("t"))  # at most per_language ids of each of max_languages languages
    samples: dict[str, list[bytes]] = {}
    for r in some.orderBy("lang", "doc_id").collect():
        samples.setdefault(r["lang"], []).append((r["t"] or "").encode("utf-8", "replace"))
    return fit(samples)


def identify_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """op6: id, fold, predicted language and score of every row."""
    model = train(docs) if model is None else model

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            langs, scores = model.predict(list(t.fillna("")))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    rows = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), predict(F.col("text").cast("string")).alias("r"))
    return rows.select("doc_id", "held_out", "r.*")
