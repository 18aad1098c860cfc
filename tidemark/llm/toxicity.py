"""Toxicity by class-conditional Kneser-Ney models over the expressions of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytewords import TERM, joined, spans, text_groups
from tidemark.llm.common import crc_fold, release_memory
from tidemark.llm.hashing import WordHasher
from tidemark.llm.quality import labelled_sample

#: an expression is a whole word (0) or its first so many characters, which its inflected and compounded forms share
LENGTHS = (0, 4, 5)
BITS = 19
CELLS = 1 << BITS
CONTEXTS = 16
#: bytes of text taken at a time
GROUP = 1 << 17
#: log ratios (nats) beyond which an expression speaks for the toxic class, and speaks clearly
STRONG, CLEAR = 2.0, 3.0


def expressions(texts: pa.Array, hashed: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells [length, word] of all words, the context class of each (its predecessor, 0 for the first) and its text.

    Words are runs of letters, digits and characters beyond ASCII, without case. A text without words has one empty word.
    """
    lowered = pa.array([(t or "").lower() for t in texts.to_pylist()], pa.string())
    raw, marks = joined(lowered)
    begin, end = spans(TERM[raw])
    of = np.searchsorted(marks, begin)
    bare = np.setdiff1d(np.arange(len(texts)), of)
    order = np.argsort(np.concatenate([of, bare]), kind="stable")
    begin, end, of = (np.concatenate([x, y])[order] for x, y in ((begin, marks[bare]), (end, marks[bare]), (of, bare)))
    lead = (raw & 0xC0) != 0x80
    places, number = np.append(np.flatnonzero(lead), len(raw)), np.cumsum(lead) - 1
    cells, sums = np.empty((len(LENGTHS), len(begin)), np.int64), hashed.sums(raw)
    for i, n in enumerate(LENGTHS):
        stop = np.minimum(end, places[np.minimum(number[begin] + n, len(places) - 1)]) if n else end
        h = hashed.between(sums, begin, stop)
        if not n:
            context = np.concatenate([[0], (h[:-1] >> np.uint64(50)).astype(np.int64) % CONTEXTS])
            context[np.concatenate([[True], of[1:] != of[:-1]])] = 0
        cells[i] = ((h >> np.uint64(8)) & np.uint64(CELLS - 1)).astype(np.int64) + i * CELLS
    return cells, context, of


def hasher() -> WordHasher:
    return WordHasher(0xC2B2AE3D27D4EB4F, 11)


def class_counts(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts [2, cells] of every expression in all labelled documents outside the held-out fold, by class, and in how
    many context classes it occurs in either.

    All labelled texts are counted. The tables have a fixed number of cells whatever the corpus: tasks send at most
    that many sums, Spark adds them up, and at most 1.6 million rows reach the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (crc_fold(F.col(doc_id)) != 0))
    known = known.groupBy(F.col(doc_id).alias("__id")).agg((F.max(label) > 0).cast("int").alias("label"))
    # labels grow with the documents: merged at every size, so that the plan does not turn where a broadcast ends
    both = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("text")).join(known.hint("merge"), F.col("__doc") == F.col("__id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, size = hasher(), len(LENGTHS) * CELLS
        sums, masks = np.zeros((2, size), np.int32), np.zeros(size, np.uint64)
        for batch in batches:
            at = 0
            for texts in text_groups(batch.column("text"), GROUP):
                cells, context, of = expressions(texts, hashed)
                kind = batch.column("label").slice(at, len(texts)).to_numpy()[of]
                at += len(texts)
                for row in cells:
                    np.add.at(sums, (kind, row), 1)
                    np.bitwise_or.at(masks, row, np.uint64(1) << context.astype(np.uint64))
        held = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(held), *map(pa.array, sums[:, held].astype(np.int64)), pa.array(masks[held].view(np.int64))], ["cell", "ordinary", "toxic", "seen"])
        release_memory()

    summed = both.select("label", "text").mapInArrow(count, "cell long, ordinary long, toxic long, seen long").groupBy("cell")
    found = summed.agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.bit_count(F.bit_or("seen")).cast("long").alias("contexts")).toArrow()
    out, cell = np.zeros((3, len(LENGTHS) * CELLS), np.int64), found.column("cell").to_numpy()
    for row, name in zip(out, ("ordinary", "toxic", "contexts")):
        row[cell] = found.column(name).to_numpy()
    return out[:2], out[2]


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once else 0.5


class ClassModels:
    """Both class models of each length of expressions: discounted class counts, the rest by shared backoff counts.

    Interpolated Kneser-Ney: what the discount frees goes to expressions by the number of context classes they occur
    in, counted over both classes, so an expression that neither class knows well hardly speaks for one. The backoff
    itself is discounted towards a uniform share.
    """

    def __init__(self, counts: np.ndarray, contexts: np.ndarray) -> None:
        self.counts = counts.reshape(2, len(LENGTHS), CELLS)
        shared = contexts.reshape(len(LENGTHS), CELLS)
        d = np.array([_discount(c) for c in shared])[:, None]
        total, kinds = shared.sum(1, keepdims=True), (shared > 0).sum(1, keepdims=True)
        self.shared = np.where(total > 0, (np.maximum(shared - d, 0) + d * kinds / CELLS) / np.maximum(total, 1), 1 / CELLS)
        self.total = self.counts.sum(2)
        self.discount = np.array([[_discount(c) for c in k] for k in self.counts])
        self.freed = self.discount * (self.counts > 0).sum(2)

    def shares(self, kind: int, i: int, cells: np.ndarray | slice = slice(None), own: np.ndarray | int = 0, size: int = 0) -> np.ndarray:
        """Probabilities of expressions of length i in a class; ``own`` counts (``size`` in all) are left out."""
        n, low = self.total[kind, i] - size, self.shared[i, cells]
        if n <= 0:
            return low
        return (np.maximum(self.counts[kind, i, cells] - own - self.discount[kind, i], 0) + self.freed[kind, i] * low) / n

    def log_ratios(self) -> np.ndarray:
        """log p(expression | toxic) - log p(expression | ordinary), [length, cell]."""
        return np.stack([np.log(self.shares(1, i)) - np.log(self.shares(0, i)) for i in range(len(LENGTHS))]).astype(np.float32)

    def ratios_without(self, cells: np.ndarray, kind: int) -> np.ndarray:
        """The log ratios of one labelled text's expressions as its own counts were not there."""
        out = np.empty(cells.shape, np.float32)
        for i, row in enumerate(cells):
            at, back, own = np.unique(row - i * CELLS, return_inverse=True, return_counts=True)
            logs = [np.log(self.shares(k, i, at, *((own, len(row)) if k == kind else ()))) for k in (0, 1)]
            out[i] = (logs[1] - logs[0])[back]
        return out


def evidence(ratios: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Per text (words from ``begins`` on) and length: mean log ratio, the strongest and the three strongest expressions,
    the strong ones summed and per word, log length, spread, and the number of clear ones."""
    n = ratios.shape[1]
    sizes, out = np.diff(np.append(begins, n)), []
    for v in ratios.astype(np.float64):
        over = np.add.reduceat(np.maximum(v - STRONG, 0), begins)
        mean = np.add.reduceat(v, begins) / sizes
        spread = np.sqrt(np.maximum(np.add.reduceat(v * v, begins) / sizes - mean * mean, 0))
        three = np.array([np.partition(v[a : a + s], -3)[-3:].mean() if s > 3 else v[a : a + s].mean() for a, s in zip(begins.tolist(), sizes.tolist())])
        clear = np.add.reduceat((v > CLEAR).astype(np.int64), begins)
        out += [mean, np.maximum.reduceat(v, begins), three, np.log1p(over), over / sizes, np.log(sizes), spread, np.log1p(clear)]
    return np.stack(out, axis=1)


class ToxicityModel:
    """Log ratios (6 MB, fixed) and the logistic calibration of the evidence."""

    def __init__(self, ratios: np.ndarray, prior: float = 0.0) -> None:
        self.ratios, self.prior, self.weights = ratios.ravel(), prior, None

    def _design(self, e: np.ndarray) -> np.ndarray:
        x = (e - self.centre) / self.scale
        return np.column_stack([np.ones(len(x)), x, x[:, 5:6] * x[:, :5]])

    def calibrate(self, e: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> ToxicityModel:
        self.centre, self.scale = e.mean(0), np.maximum(e.std(0), 1e-9)
        x = self._design(e)
        w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w
        return self

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None or not len(texts):
            return np.full(len(texts), self.prior)
        hashed, out = hasher(), []
        for part in text_groups(texts, GROUP):
            cells, _, of = expressions(part, hashed)
            e = evidence(self.ratios[cells], np.searchsorted(of, np.arange(len(part))))
            out.append(1 / (1 + np.exp(-np.clip(self._design(e) @ self.weights, -30, 30))))
        return np.concatenate(out)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", calibration_rows: int = 6000, doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Both class models from all labelled documents, calibrated on at most ``calibration_rows`` of them.

    A calibration document is weighed as if its own counts were not in the models, else its rare words would speak
    for its label. Without documents of both classes nothing can be compared: every score is the share of toxic
    labels, 0 without labels.
    """
    models = ClassModels(*class_counts(docs, labels, label, doc_id, text))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = hasher()
        for batch in batches:
            out = []
            for row, kind in enumerate(batch.column("label").to_pylist()):
                cells, _, _ = expressions(batch.column("text").slice(row, 1), hashed)
                out.append(evidence(shared.value.ratios_without(cells, int(kind > 0)), np.zeros(1, np.int64)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("label"), pa.array(out, pa.binary())], ["id", "label", "x"])
        release_memory()

    sample = labelled_sample(docs, labels, label, calibration_rows, doc_id, text)
    kind = sample.schema["__id"].dataType.simpleString()
    facts = sample.mapInArrow(weigh, f"id {kind}, label int, x binary")
    found = facts.orderBy(F.xxhash64("id", F.lit(3)), "id", "x").limit(calibration_rows).toArrow()
    shared.unpersist()
    y = (found.column("label").to_numpy() > 0).astype(float)
    model = ToxicityModel(models.log_ratios())
    if not len(y) or y.min() == y.max():
        model.prior = float(y.sum() / (len(y) + 1))
        return model
    return model.calibrate(np.stack([np.frombuffer(x.as_py()) for x in found.column("x")]), y)


def toxicity_score(docs: DataFrame, model: ToxicityModel, text: Column) -> Column:
    """Probability that each text is toxic; the model is broadcast, a fixed 6 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = shared.value.scores(texts)
        release_memory()
        return pa.array(out, pa.float64())

    return score(text)


def scored_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted (1 from ``threshold`` up).

    Only the text is an input of the score; null texts are empty. A document with several label rows is toxic if
    one says so; null labels and labels of null ids are not used, and a null id is never held out. Rows repeated
    under one id are counted and scored each.
    """
    model = fit_toxicity(docs, labels, doc_id=doc_id, text=text)
    scored = docs.select(F.col(doc_id).alias("doc_id"), toxicity_score(docs, model, F.col(text)).alias("score"))
    held = F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all columns as they are."""
    model = fit_toxicity(docs, labels, doc_id=doc_id, text=text)
    names = docs.columns
    return docs.withColumn("__toxicity", toxicity_score(docs, model, F.col(f"`{text}`"))).where(F.col("__toxicity") < threshold).select(*[F.col(f"`{c}`") for c in names])
