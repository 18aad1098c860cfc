"""SimHash near-duplicates by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, partitions, release_memory, row_keys
from tidemark.session import settle

GENERATOR = 0xC75  # of the perfect binary (23, 12, 7) Golay code
REACH = 3  # bits in which linked fingerprints may differ; the keys below are complete for exactly this number


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles of a text, as a signed 64-bit number."""
    import xxhash

    parts = (text or "").encode().lower().split()  # both are ASCII rules on bytes
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) < words:
        hashes = np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    else:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        ends = np.cumsum(sizes)
        begins, digest = (ends - sizes).tolist(), xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], 42) for a, b in zip(begins, (ends[words - 1 :] - 1).tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(text: Column, words: int = 3) -> Column:
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        prints = pa.array([fingerprint(t.as_py(), words) for t in texts], pa.int64())
        release_memory()
        return prints

    return of(text)


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the 12 message bits; per syndrome the error patterns of weight up to 4, and their number.

    The code is perfect, so every syndrome has one pattern of weight up to 3; those of weight 3 have five more of
    weight 4. A word thus has one codeword nearby, or six.
    """
    remainder = np.zeros(4096, np.int64)
    for message in range(4096):
        r = message << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - 11)
        remainder[message] = r
    near: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            pattern = sum(1 << p for p in places)
            found = near[remainder[pattern >> 11] ^ (pattern & 2047)]
            if weight < 4 or found[0].bit_count() == 3:
                found.append(pattern)
    number = np.array([len(x) for x in near])
    patterns = np.array([x + [0] * (6 - len(x)) for x in near], np.int64)
    return remainder, patterns, number


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 message bits) of the codewords within four bits of each 23-bit word, six columns, and which are real.

    Two words that differ in at most two bits have at least one of these indices in common.
    """
    remainder, patterns, number = golay_tables()
    syndrome = remainder[words >> 11] ^ (words & 2047)
    return (words[:, None] ^ patterns[syndrome]) >> 11, np.arange(6)[None, :] < number[syndrome][:, None]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints; two that differ in up to three bits share at least one.

    The 64 bits are segments of 23, 23 and 18. Three errors leave at most two in each segment, and then all three
    segments share a nearby codeword (36 bits, up to 216 combinations), or all three are in one segment, and then
    the two others are equal.
    """
    x = prints.view(np.uint64)
    a, b, c = (x >> np.uint64(41)).astype(np.int64), ((x >> np.uint64(18)) & np.uint64(0x7FFFFF)).astype(np.int64), (x & np.uint64(0x3FFFF)).astype(np.int64)
    (ia, ma), (ib, mb), (ic, mc) = near_codewords(a), near_codewords(b), near_codewords(c)
    keys = ((ia[:, :, None, None] << 24) | (ib[:, None, :, None] << 12) | ic[:, None, None, :]).reshape(len(x), -1)
    real = (ma[:, :, None, None] & mb[:, None, :, None] & mc[:, None, None, :]).reshape(len(x), -1)
    rows, columns = np.nonzero(real)
    each = np.arange(len(x))
    pairs = [(a << 23) | b, (a << 18) | c, (b << 18) | c]
    return np.concatenate([rows, each, each, each]), np.concatenate([keys[rows, columns], *[p | np.int64((k + 1) << 60) for k, p in enumerate(pairs)]])


def _forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what direct links (up to REACH bits) join among distinct ``values``, one fewer than each part has."""
    found, rest = [], values
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            for at in range(0, len(front), 256):  # bounded memory in buckets of any size
                open_ = np.flatnonzero(~reached)
                near = np.bitwise_count(front[at : at + 256, None] ^ rest[None, open_]) <= REACH
                hit = near.any(0)
                parents = front[at + near[:, hit].argmax(0)]
                found += zip(parents.tolist(), rest[open_[hit]].tolist())
                reached[open_[hit]] = True
            front, rest = rest[reached], rest[~reached]
    return found


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) among the distinct fingerprints of ``prints`` (column fp) that connect exactly what lies within reach.

    Every fingerprint goes to the buckets of its keys. A bucket compares its members and gives a forest of links
    instead of all pairs, so a dense group of m near copies costs m - 1 links a bucket.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 2000):
                part = values[at : at + 2000]
                rows, keys = fuzzy_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.empty(0, np.int64), np.empty(0, np.int64)

        def within(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
            sizes = np.diff(np.append(begins, len(keys)))
            two = begins[sizes == 2]
            x, y = values[two], values[two + 1]
            near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= REACH
            found = list(zip(x[near].tolist(), y[near].tolist()))
            for begin, size in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                found += [(int(np.uint64(p).view(np.int64)), int(np.uint64(q).view(np.int64))) for p, q in _forest(values[begin : begin + size].view(np.uint64))]
            pairs = np.array(sorted({(min(p), max(p)) for p in found}), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([held_keys, batch.column(0).to_numpy()])
            values = np.concatenate([held, batch.column(1).to_numpy()])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield within(keys[:cut], values[:cut])
            held_keys, held = keys[cut:], values[cut:]
        yield within(held_keys, held)
        release_memory()

    # a key set is some 150 rows, so the few fingerprints of a file are dealt out before they are multiplied
    keyed = prints.select("fp").repartition(partitions(prints.sparkSession)).mapInArrow(explode, "key long, fp long")
    placed = keyed.repartition(partitions(prints.sparkSession), "key").sortWithinPartitions("key")
    return placed.mapInArrow(compare, "a long, b long").distinct()


def near_duplicate_groups(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: k1, k2 (its 128-bit key), doc_id, fp, root (a fingerprint) and component_id (the smallest id reachable).

    Texts are lower-cased (A-Z) and cut at ASCII white space; null and wordless texts have the fingerprint 0 and are
    linked like any other. Equal fingerprints are one node, however many documents have one, and only distinct ones
    are compared. Null ids are never the smallest; a group of null ids only has a null component. Rows repeated
    under one id keep a row each.
    """
    k1, k2 = row_keys(F.col(doc_id), F.col(text))
    marked = settle(docs.select(k1.alias("k1"), k2.alias("k2"), F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), words).alias("fp")))
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes))
    least = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    floor = least.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = least.join(floor, "root").select("fp", "root", "component_id")
    return marked.join(of_print, "fp").select("k1", "k2", "doc_id", "fp", "root", "component_id")


def one_of_each_group(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id, all columns as they are.

    Of rows that share that id the one with the smallest row key stays, of wholly equal rows any one.
    """
    groups = settle(near_duplicate_groups(docs, words, doc_id, text))
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "k1", "k2").agg(F.count("*").alias("n"))
    stays = settle(stays.groupBy("root").agg(F.min(F.struct("k1", "k2", "n")).alias("s")).select("s.*"))
    # columns of the documents may have any name, so the keys are made under names of their own
    k1, k2 = row_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    names = docs.columns
    keyed = docs.withColumns({"__key_1": k1, "__key_2": k2})
    kept = keyed.join(stays.select(F.col("k1").alias("__stay_1"), F.col("k2").alias("__stay_2")), (F.col("__key_1") == F.col("__stay_1")) & (F.col("__key_2") == F.col("__stay_2")), "left_semi")
    if not stays.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["__key_1", "__key_2"])
    return kept.select(*[F.col(f"`{c}`") for c in names])
