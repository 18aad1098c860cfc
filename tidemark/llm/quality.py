"""Document quality by gated attention over encoded passages (attention-based multiple-instance learning)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_fold

PASSAGE_BYTES = 1024


#: ASCII marks that count as one class each
MARKS = (b".", b",", b"!?", b"#$%&*@^~", b"|", b"'\"-", b"()<>[]{}", b":;", b"/\\_=+`")


def _byte_classes() -> np.ndarray:
    """Every byte's class: letters by case, digits, blanks, line ends, UTF-8 bytes outside ASCII, groups of marks."""
    classes = np.zeros(256, np.int64)
    classes[ord("a") : ord("z") + 1], classes[ord("A") : ord("Z") + 1], classes[ord("0") : ord("9") + 1] = 1, 2, 3
    classes[0x80:] = 4
    for byte in b" \t\x0b\x0c\r":
        classes[byte] = 5
    classes[ord("\n")] = 6
    for k, group in enumerate(MARKS):
        for byte in group:
            classes[byte] = 7 + k
    return classes


CLASSES = _byte_classes()
N_CLASSES = 7 + len(MARKS)
LAGS = (1, 2, 3)
FEATURES = N_CLASSES * N_CLASSES + len(LAGS)


def passage_features(text: str | None) -> np.ndarray:
    """One row per passage of about PASSAGE_BYTES bytes: square roots of the shares of its byte-class pairs, and the shares
    of words that repeat the word 1, 2 or 3 before. Empty texts have one passage.
    """
    raw = np.frombuffer(b"\n" + (text or "").encode() + b"\n", np.uint8)
    classes = CLASSES[raw]
    pairs = classes[:-1] * N_CLASSES + classes[1:]
    n = -(-len(pairs) // PASSAGE_BYTES)
    # passages of one text are of nearly equal length, so that a short last one does not stand out by noise
    at = np.arange(len(pairs)) * n // len(pairs)
    width = N_CLASSES * N_CLASSES
    counts = np.bincount(at * width + pairs, minlength=n * width).reshape(n, width)
    shares = [np.sqrt(counts / counts.sum(1, keepdims=True))]
    blank = np.flatnonzero((classes == 5) | (classes == 6))
    sizes, sums = np.diff(blank), np.diff(np.cumsum(raw, dtype=np.int64)[blank])
    passage = at[blank[:-1]]
    words = np.maximum(np.bincount(passage, minlength=n), 1)
    for lag in LAGS:
        same = (sizes[lag:] == sizes[:-lag]) & (sums[lag:] == sums[:-lag]) & (sizes[lag:] > 1)
        shares.append((np.bincount(passage[lag:][same], minlength=n) / words)[:, None])
    return np.hstack(shares).astype(np.float32)


class GatedAttention:
    """score = sigmoid(c . z + b), z = sum_k a_k h_k, h_k = tanh(W x_k + w0), a = softmax(v . (tanh(A h_k) * sigmoid(B h_k)))."""

    def __init__(self, features: int = FEATURES, hidden: int = 32, gates: int = 16, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        self.p = {
            "W": r.normal(0, 1.0, (features, hidden)), "w0": np.zeros(hidden), "A": r.normal(0, 0.3, (hidden, gates)), "B": r.normal(0, 0.3, (hidden, gates)),
            "v": r.normal(0, 0.3, gates), "c": r.normal(0, 0.3, hidden), "b": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["w0"])
        t, s = np.tanh(h @ p["A"]), 1 / (1 + np.exp(-(h @ p["B"])))
        e = (t * s) @ p["v"]
        sizes = np.diff(np.append(begins, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begins), sizes))
        a = e / np.repeat(np.add.reduceat(e, begins), sizes)
        z = np.add.reduceat(a[:, None] * h, begins)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "sizes": sizes, "logit": z @ p["c"] + p["b"][0]}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        begins = np.cumsum([0, *[len(b) for b in bags[:-1]]])
        logit = self._forward(np.concatenate(bags).astype(np.float32), begins)["logit"]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def _gradients(self, x: np.ndarray, begins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(x, begins)
        d = weight * (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) / weight.sum()
        row = np.repeat(np.arange(len(begins)), f["sizes"])
        dz = d[:, None] * p["c"]
        da = (dz[row] * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, begins), f["sizes"]))
        dg = de[:, None] * p["v"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz[row] + dt @ p["A"].T + ds @ p["B"].T
        du = dh * (1 - f["h"] ** 2)
        return {"W": x.T @ du, "w0": du.sum(0), "A": f["h"].T @ dt, "B": f["h"].T @ ds, "v": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ d, "b": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 20, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> GatedAttention:
        r = np.random.default_rng(seed)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, epochs * -(-len(bags) // batch)
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                own = [bags[i] for i in part]
                begins = np.cumsum([0, *[len(b) for b in own[:-1]]])
                g = self._gradients(np.concatenate(own), begins, labels[part], np.ones(len(part)))
                step += 1
                now = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
                for k, v in self.p.items():
                    gk = g[k].astype(np.float32) + decay * v
                    first[k] = 0.9 * first[k] + 0.1 * gk
                    second[k] = 0.999 * second[k] + 0.001 * gk * gk
                    self.p[k] = v - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold (label, text): those whose ids hash smallest.

    Chosen among the labels alone, so the sample is small enough to be sent to the documents whatever their number.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (crc_fold(F.col(doc_id)) != 0))
    known = known.groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("__id", F.lit(3)), "__id").limit(rows)
    return docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("__id", "label", "text")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 3000, passages: int = 64, doc_id: str = "doc_id", text: str = "text") -> GatedAttention | float:
    """A model fitted on a bounded sample: ``rows`` documents, and of each at most ``passages`` evenly spaced passages.

    The bounds hold for fitting only; every passage of every document is scored. Without labels of both kinds the
    share of label 1 stands in (one half without any label).
    """

    def encode(batches):
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                x = passage_features(t)
                x = x[np.unique(np.linspace(0, len(x) - 1, min(len(x), passages)).round().astype(int))]
                out.append(x.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("label"), pa.array(out, pa.binary())], ["id", "label", "x"])

    sample = labelled_sample(docs, labels, label, rows, doc_id, text)
    kind = sample.schema["__id"].dataType.simpleString()
    # repeated rows of one id must not lift the bound: as many rows as were asked for, in a fixed order
    coded = sample.mapInArrow(encode, f"id {kind}, label int, x binary").orderBy(F.xxhash64("id", F.lit(3)), "id", "x").limit(rows)
    found = coded.toArrow()
    y = found.column("label").to_numpy().astype(np.float32)
    if not len(y) or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    bags = [np.frombuffer(x.as_py(), np.float16).reshape(-1, FEATURES).astype(np.float32) for x in found.column("x")]
    return GatedAttention().fit(bags, y)


def quality_score(model: GatedAttention | float, text: Column) -> Column:
    """Probability of label 1 of each text; null and empty texts are one empty passage."""
    if not isinstance(model, GatedAttention):
        return F.lit(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out, held, n = [], [], 0
        for t in texts:
            held.append(passage_features(t.as_py()))
            n += len(held[-1])
            if n > 512:
                out.append(model.scores(held))
                held, n = [], 0
        if held:
            out.append(model.scores(held))
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return score(text)


def scored_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 3000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted (1 from ``threshold`` up).

    The text alone is an input of the score. A document's label is the largest of its label rows; null labels and
    labels of null ids are not used, and a null id is never held out. Rows repeated under one id are scored each.
    """
    model = fit_quality(docs, labels, rows=rows, doc_id=doc_id, text=text)
    scored = docs.select(F.col(doc_id).alias("doc_id"), quality_score(model, F.col(text)).alias("score"))
    held = F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
