"""Ranked lexical search: documents with the same terms of the items are scored once, as one class."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.bytewords import TERM, as_strings, joined, run_sums, spans, text_groups
from tidemark.llm.common import release_memory, running_totals
from tidemark.session import settle

LAST_ID = 2**63 - 1


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the text each is of."""
    raw, marks = joined(texts)
    inside = TERM[raw]
    begin, end = spans(inside)
    return as_strings(raw, inside, begin, end), np.searchsorted(marks, begin)


def item_terms(items: DataFrame, item_id: str, text: str, block_terms: int) -> DataFrame:
    """Distinct (item_id, term, block): items in ascending order, in blocks of about ``block_terms`` terms; null ids take no part."""
    rows = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).where("item_id is not null")
    kind = rows.schema["item_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, of = terms(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(of)), words.cast(pa.string())], ["item_id", "term"])

    found = settle(rows.mapInArrow(split, f"item_id {kind}, term string").distinct())
    sizes = running_totals(found.groupBy("item_id").agg(F.count("*").alias("n")), [], ["item_id"], "n")
    return settle(found.join(sizes.select("item_id", F.expr(f"before div {block_terms}").alias("block")), "item_id"))


def bags_of(docs: DataFrame, vocabulary: pa.Array, doc_id: str, text: str) -> DataFrame:
    """Per document: doc_id, n (all its terms) and bag, its (term, count) pairs within the vocabulary as 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            at = 0
            for texts in text_groups(batch.column("text")):
                words, of = terms(texts)
                place = pc.index_in(words, value_set=known)
                hit = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                codes, tf = run_sums(of[hit] * max(1, len(known)) + place.fill_null(0).to_numpy()[hit])
                owner, term = np.divmod(codes, max(1, len(known)))
                pairs = np.column_stack([term, tf]).astype("<i4")
                ends = np.concatenate([[0], 8 * np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)
                bags = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(pairs)])
                n = pa.array(np.bincount(of, minlength=len(texts)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), n, bags], ["doc_id", "n", "bag"])
                at += len(texts)
        release_memory()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, bag binary")


def _pairs(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, count and row of every pair of an array of bags."""
    if isinstance(bags, pa.ChunkedArray):
        bags = bags.combine_chunks()
    ends = np.frombuffer(bags.buffers()[1], np.int32)[bags.offset : bags.offset + len(bags) + 1].astype(np.int64)
    data = bags.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view("<i4") if data is not None else np.zeros(0, "<i4")
    sizes = np.diff(ends) // 8
    return flat[0::2].astype(np.int64), flat[1::2].astype(np.int64), np.repeat(np.arange(len(bags)), sizes)


def document_frequencies(bags: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary: one row per task and term is summed, one per term collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            sums += np.bincount(_pairs(batch.column("bag"))[0], minlength=size)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], ["term", "df"])

    found = bags.select("bag").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


class Best:
    """The ``k`` best rows of each item so far, by score descending and first document ascending."""

    def __init__(self, k: int, items: int) -> None:
        self.k, self.floor, self.held = k, np.ones(items, np.int64), np.zeros((6, 0), np.int64)
        self.wait: list[np.ndarray] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, facts: np.ndarray) -> None:
        """``scores`` [class, item] and ``facts`` [first, h1, h2, m] of the classes."""
        at, item = np.nonzero(scores >= self.floor)
        if len(at):
            self.wait.append(np.vstack([item, scores[at, item], facts[:, at]]))
            self.waiting += len(at)
        if self.waiting > max(1 << 18, 2 * self.k * len(self.floor)):
            self.settle()

    def settle(self) -> np.ndarray:
        rows = np.concatenate([self.held, *self.wait], axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        item = rows[0]
        begin = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
        place = np.arange(len(item)) - np.repeat(begin, np.diff(np.append(begin, len(item))))
        full = place == self.k - 1
        self.floor[item[full]] = rows[1, full]
        self.held, self.wait, self.waiting = rows[:, place < self.k], [], 0
        return self.held


def best_classes(classes: DataFrame, weights: np.ndarray, offsets: np.ndarray, postings: np.ndarray, items: int, k: int) -> DataFrame:
    """Per task and item the ``k`` best classes: (item, score, first, h1, h2, m). ``postings`` lists the items of each term."""
    shared = classes.sparkSession.sparkContext.broadcast((weights, offsets, postings))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, begin, posted = shared.value
        spread = np.diff(begin)
        best = Best(k, items)
        for batch in batches:
            term, tf, of = _pairs(batch.column("bag"))
            facts = np.vstack([batch.column(c).to_numpy() for c in ("first", "h1", "h2", "m")])
            part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * facts[3][of]))
            # as many classes at a time as keep the scores and the postings met within a fixed room
            met = np.concatenate([[0], np.cumsum(np.bincount(of, spread[term], len(facts[0])).astype(np.int64))])
            ends, at = np.searchsorted(of, np.arange(len(facts[0]) + 1)), 0
            while at < len(facts[0]):
                to = int(np.searchsorted(met, met[at] + (1 << 21), side="right")) - 1
                to = max(at + 1, min(to, at + max(1, (1 << 22) // items), len(facts[0])))
                t, row = term[ends[at] : ends[to]], of[ends[at] : ends[to]] - at
                size = spread[t]
                total = np.cumsum(size)
                which = np.arange(total[-1] if len(total) else 0) + np.repeat(begin[t] - (total - size), size)
                scores = np.zeros((to - at) * items, np.int64)
                np.add.at(scores, np.repeat(row * items, size) + posted[which], np.repeat(part[ends[at] : ends[to]], size))
                best.add(scores.reshape(to - at, items), facts[:, at:to])
                at = to
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.settle()], ["item", "score", "first", "h1", "h2", "m"])
        release_memory()

    return classes.select("first", "h1", "h2", "m", "bag").mapInArrow(score, "item long, score long, first long, h1 long, h2 long, m long")


def _block(docs: DataFrame, found: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    rows = found.select("item_id", "term").toArrow()
    ids = pc.unique(rows.column("item_id")).sort()
    names = pc.unique(rows.column("term")).sort()
    item = pc.index_in(rows.column("item_id"), value_set=ids).to_numpy()
    term = pc.index_in(rows.column("term"), value_set=names).to_numpy()
    order = np.lexsort((item, term))
    offsets, postings = np.searchsorted(term[order], np.arange(len(names) + 1)), item[order].astype(np.int64)

    bags = settle(bags_of(docs, names.cast(pa.large_string()), doc_id, text))
    n_docs, n_terms = bags.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = document_frequencies(bags, len(names))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    # one shuffle makes the classes: a task sends at most k documents of each, so a class may hold any share of the rows
    key = ("h1", "h2", "m", "bag")
    hashed = bags.where("octet_length(bag) > 0").select(
        "doc_id", "bag", F.expr(f"50 + (50 * n * {n_docs}L) div {n_terms or 1}L").alias("m"), F.xxhash64(F.lit(0), "bag").alias("h1"), F.xxhash64(F.lit(1), "bag").alias("h2")
    )
    ranked = hashed.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last()))).where(F.col("place") <= k)
    members = F.array_sort(F.collect_list(F.struct("place", "doc_id")))
    classes = ranked.groupBy(*key).agg(F.coalesce(F.min("doc_id"), F.lit(LAST_ID)).alias("first"), members.alias("members"))
    classes = settle(classes)

    best = best_classes(classes, weights, offsets, postings, max(1, len(ids)), k)
    top = Window.partitionBy("item").orderBy(F.desc("score"), "first")
    winners = best.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k).drop("place")
    spread = winners.join(classes.select("h1", "h2", "m", "first", "members"), ["h1", "h2", "m", "first"]).select("item", "score", F.explode("members.doc_id").alias("doc_id"))
    last = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    placed = spread.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    numbers = spark.createDataFrame(pa.table({"item": np.arange(len(ids)), "item_id": ids}))
    return placed.join(numbers, "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = 200_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` documents with the highest score above 0 of each item: item_id, rank from 1, doc_id, score.

    A score is made of exact 64-bit steps: w * ((10^9 tf) div (1000 tf + 20 m)) over the item's terms, w the floored
    logarithm of how rare the term is and m the document's length against the mean. It depends on a document only
    through m and its counts of item terms, so documents are first reduced to that bag; equal bags (found by hash,
    compared whole) form a class, which keeps its k smallest ids, is scored once, and is expanded again at the end.
    The k best classes of an item hold its k best documents, as every class before one has a document before it.

    Items go in blocks of about ``block_terms`` terms, which bounds what is broadcast; each block reads the documents
    once. Null and empty texts have no terms and are never found, but a document without terms does not count either.
    Each row is a document of its own, also where ids repeat; a null id stands last among equal scores. Terms of item
    rows that repeat an id are united, items with null id take no part. Other columns are not read.
    """
    found = item_terms(items, item_id, item_text, block_terms)
    blocks = [r.block for r in found.select("block").distinct().orderBy("block").collect()]
    parts = [_block(docs, found.where(F.col("block") == b), k, doc_id, text) for b in blocks or [0]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
