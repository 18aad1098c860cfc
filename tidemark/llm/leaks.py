"""Benchmark decontamination by latent semantic retrieval with exact subsequence checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, release_memory, row_keys
from tidemark.llm.hashing import WordHasher
from tidemark.session import settle

LETTERS = np.zeros(256, bool)
LETTERS[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
LETTERS[0x80:] = True
FEATURES = 4096  # hashed dimensions of the term space
_HASHER = WordHasher(0x9E3779B97F4A7C15, 5)


def hashed_words(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the words of each text, lower-cased: runs of ASCII letters, digits and characters outside ASCII."""
    out, group, held = [], [], 0
    for text in [*texts, None]:
        group.append((text or "").lower().encode())
        held += len(group[-1])
        if held > 1 << 18 or len(out) + len(group) > len(texts):
            raw = np.frombuffer(b" ".join([b"", *group, b""]), np.uint8)
            inside = LETTERS[raw].astype(np.int8)
            step = np.diff(inside)
            begin, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
            h = _HASHER(raw, begin, end)
            stops = np.cumsum([len(x) + 1 for x in group])
            cuts = np.searchsorted(begin, stops + 0)
            out += np.split(h, cuts[:-1])
            group, held = [], 0
    return out[: len(texts)]


SURE_OVERLAP = 0.8  # an item of which so much is found is leaked, whatever its answer
WHOLE_HEAD = 0.9  # so is one of which so much is found before its answer
LEAST_ANSWER_WORDS = 4  # shorter last sentences say too little to confirm or deny an item


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors over ``a``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = places.get(x, 0) & row
        row = (row + hit) | (row - hit)
        row &= full
    return len(a) - row.bit_count()


@dataclass
class Benchmark:
    """One block of benchmark items: its vocabulary, word ids, and for answers where they begin."""

    names: list[int]
    vocabulary: np.ndarray  # sorted hashes; the id of a word is its place + 1
    items: list[np.ndarray]
    answers: list[int]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32) if len(self.vocabulary) else np.zeros(len(hashes), np.int32)


def answer_start(text: str) -> int:
    """The character where the answer of an item begins: its last sentence or line, if something stands before it."""
    body = text.rstrip(" .!?\n\t\r")
    at = max(body.rfind(". "), body.rfind("\n"), body.rfind("? "), body.rfind("! "))
    return at + 1 if at >= 0 else 0


def load_block(items: list[tuple[int, str]]) -> Benchmark:
    words = hashed_words([t for _, t in items])
    heads = hashed_words([t[: answer_start(t)] for _, t in items])
    vocabulary = np.unique(np.concatenate([*words, np.empty(0, np.uint64)]))
    block = Benchmark([n for n, _ in items], vocabulary, [], [len(h) for h in heads])
    block.items = [block.ids(w) for w in words]
    return block


def windows(n: int, window: int, stride: int) -> np.ndarray:
    """Starts of the passages of a text of ``n`` words; the last passage ends with the text."""
    if n <= window:
        return np.zeros(1, np.int64)
    return np.unique(np.append(np.arange(0, n - window, stride), n - window))


class Latent:
    """TF-IDF weights and the latent space they are projected into."""

    def __init__(self, idf: np.ndarray, unknown: float) -> None:
        self.idf, self.unknown = np.concatenate([[0.0], idf]), unknown
        self.feature = np.concatenate([[0], np.arange(len(idf)) * 0x9E3779B1 % FEATURES]).astype(np.int64)
        self.axes = np.zeros((FEATURES, 0), np.float32)

    def sparse(self, ids: np.ndarray, begin: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, feature, weight) of the passages' benchmark terms: counts times idf, over the length of all terms.

        Words outside the benchmark count as the rarest ones in that length, so passages that hardly concern the
        benchmark weigh little in the fit.
        """
        at = np.minimum(begin[:, None] + np.arange(window)[None, :], len(ids))
        tokens = np.append(ids, 0)[at]
        passage, place = np.nonzero(tokens)
        term = tokens[passage, place]
        key, count = np.unique(passage * np.int64(len(self.idf)) + term, return_counts=True)
        passage, term = key // len(self.idf), key % len(self.idf)
        weight = count * self.idf[term]
        inside = np.bincount(passage, weight**2, minlength=len(begin))
        outside = np.maximum(np.minimum(begin + window, len(ids)) - begin, 0) - np.bincount(key // len(self.idf), count, minlength=len(begin))
        norm = np.sqrt(inside + outside * self.unknown**2)
        return passage, self.feature[term], weight / np.maximum(norm, 1e-12)[passage]

    def sums(self, ids: np.ndarray, step: int) -> np.ndarray:
        """Sums of the words' vectors over every ``step`` words; words outside the benchmark add nothing."""
        at = np.flatnonzero(ids)
        vectors = self.axes[self.feature[ids[at]]]
        vectors *= self.idf[ids[at]].astype(np.float32)[:, None]
        out = np.zeros((-(-len(ids) // step), vectors.shape[1]), np.float32)
        if len(at):
            place = at // step
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            out[place[first]] = np.add.reduceat(vectors, first)
        return out


def passage_vectors(sums: np.ndarray, parts: int, stride: int) -> np.ndarray:
    """Unit vectors of passages of ``parts`` sums that begin at every ``stride``-th sum; the last ones run over the end.

    The length of a passage and its words outside the benchmark do not change its direction.
    """
    count = -(-len(sums) // stride)
    padded = np.concatenate([sums, np.zeros((parts, sums.shape[1]), np.float32)])
    out = padded[: (count - 1) * stride + 1 : stride].copy()
    for k in range(1, parts):
        out += padded[k : k + (count - 1) * stride + 1 : stride]
    return out / np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-12)[:, None]


def scales(window: int, stride: int) -> list[tuple[int, int]]:
    """(words, stride) of the passages, halved down to six words: an item is looked for in passages no longer than itself."""
    out = [(window, stride)]
    while out[-1][0] >= 12 and out[-1][1] > 1:
        out.append((out[-1][0] // 2, out[-1][1] // 2))
    return out


class Queries:
    """The passages of a block's items in the latent space, by the scale that suits the item."""

    def __init__(self, latent: Latent, block: Benchmark, window: int, stride: int) -> None:
        sizes = scales(window, stride)
        suits = [next((k for k, (w, _) in enumerate(sizes) if w <= len(ids)), len(sizes) - 1) for ids in block.items]
        self.lengths = np.array([len(ids) for ids in block.items])
        self.words, self.begins = np.concatenate(block.items), np.cumsum(self.lengths) - self.lengths
        self.terms = len(block.vocabulary) + 1
        self.scales: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for k, (w, s) in enumerate(sizes):
            passages = [(i, b) for i, ids in enumerate(block.items) if suits[i] == k for b in windows(len(ids), w, s)]
            if passages:
                vectors = np.concatenate([passage_vectors(latent.sums(block.items[i][b : b + w], w), 1, 1) for i, b in passages])
                self.scales.append((w, s, vectors, np.array([i for i, _ in passages], np.int64)))

    def candidates(self, latent: Latent, ids: np.ndarray, least_cosine: float, least_overlap: float) -> Iterator[tuple[int, int, int, float]]:
        """(start, words, item, cosine) of the passages of ``ids`` near an item's passage, once for each item and start.

        No subsequence is longer than what occurs at all, so a stretch of the text and its surroundings is compared only
        with the items of whose words they hold ``least_overlap``.
        """
        step = int(np.gcd.reduce([x for w, s, _, _ in self.scales for x in (w, s)]))
        longest, reach, stride = max(w for w, _, _, _ in self.scales), int(self.lengths.max()), max(s for _, s, _, _ in self.scales)
        slab = -(-max(256, reach) // stride) * stride
        present = np.zeros(self.terms, bool)
        for at in range(0, len(ids), slab):
            around = ids[max(0, at - reach) : at + slab + longest + reach]
            present[around] = True
            possible = np.add.reduceat(present[self.words], self.begins, dtype=np.int64) >= least_overlap * self.lengths
            present[around] = False
            if not possible.any():
                continue
            sums = latent.sums(ids[at : at + slab + longest], step)
            inside = -(-min(slab, len(ids) - at) // step)
            for w, s, vectors, owner in self.scales:
                some = np.flatnonzero(possible[owner])
                if not len(some):
                    continue
                cosines = (passage_vectors(sums, w // step, s // step)[: -(-inside * step // s)] @ vectors[some].T).ravel()
                near = np.flatnonzero(cosines >= least_cosine)
                if not len(near):
                    continue
                # by start and item; the owners of a scale ascend, so equal ones are neighbours
                key = near // len(some) * len(self.lengths) + owner[some[near % len(some)]]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                start, item = np.divmod(key[first], len(self.lengths))
                for b, i, c in zip((at + start * s).tolist(), item.tolist(), np.maximum.reduceat(cosines[near], first).tolist()):
                    yield b, w, i, c


def _coded(docs: DataFrame, block: Benchmark) -> DataFrame:
    """Word ids of every whole document over the block's vocabulary, as bytes of 32-bit integers; 0 for other words."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    @F.arrow_udf("binary")
    def code(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 256):
            out += [shared.value.ids(h).tobytes() for h in hashed_words(texts[at : at + 256].to_pylist())]
        coded = pa.array(out, pa.binary())
        del out
        release_memory()
        return coded

    return settle(docs.select("k1", "k2", "doc_id", code("text").alias("ids")))


def _document_frequencies(coded: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """In how many documents every vocabulary term occurs, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms + 1, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                df[np.unique(np.frombuffer(raw.as_py(), np.int32))] += 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df[found])], ["term", "n"])

    summed = coded.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(terms + 1, np.int64)
    df[summed.column("term").to_numpy()] = summed.column("n").to_numpy()
    return df[1:], coded.count()


def _product(coded: DataFrame, latent: Latent, window: int, spread: np.ndarray, block: Benchmark) -> np.ndarray:
    """A'(A ``spread``) for the TF-IDF matrix A of all passages of all documents and items.

    Every task adds up its own passages, and Spark adds the tasks' matrices, in row blocks that each stream through one task.
    """
    spread = spread.astype(np.float32)
    width = spread.shape[1]
    shared = coded.sparkSession.sparkContext.broadcast((latent, spread))
    rows = 64

    def add(total: np.ndarray, lat: Latent, g: np.ndarray, ids: np.ndarray) -> None:
        passage, feature, weight = lat.sparse(ids, np.arange(0, max(len(ids), 1), window), window)
        if not len(passage):
            return
        weight = weight.astype(np.float32)
        first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        image = np.add.reduceat(weight[:, None] * g[feature], first)
        back = weight[:, None] * np.repeat(image, np.diff(np.append(first, len(passage))), axis=0)
        order = np.argsort(feature, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(feature[order]) > 0]))
        total[feature[order][begins]] += np.add.reduceat(back[order], begins)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, g = shared.value
        total = np.zeros((FEATURES, width))
        held, size = [], 0
        for batch in batches:
            for raw in batch.column(0):
                ids = np.frombuffer(raw.as_py(), np.int32)
                # texts end with a gap of a window, so that no passage spans two of them
                held.append(np.concatenate([ids, np.zeros(window + (-len(ids)) % window, np.int32)]))
                size += len(held[-1])
                if size > 1 << 16:
                    add(total, lat, g, np.concatenate(held))
                    held, size = [], 0
        if held:
            add(total, lat, g, np.concatenate(held))
        pieces = total.reshape(-1, rows * width)
        some = np.flatnonzero(pieces.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([pieces[i].tobytes() for i in some], pa.binary())], ["piece", "part"])
        release_memory()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[piece] = sums.get(piece, 0.0) + np.frombuffer(part.as_py(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["piece", "part"])

    # at most FEATURES / rows pieces, whatever the input
    parts = coded.select("ids").mapInArrow(partial, "piece long, part binary").repartition(min(FEATURES // rows, partitions(coded.sparkSession)), "piece")
    y = np.zeros((FEATURES, width))
    for piece, part in zip(*(c.to_pylist() for c in parts.mapInArrow(summed, "piece long, part binary").toArrow().columns)):
        y[piece * rows : (piece + 1) * rows] = np.frombuffer(part).reshape(rows, width)
    for ids in block.items:
        add(y, latent, spread, ids)
    return y


def _axes(coded: DataFrame, latent: Latent, window: int, rank: int, extra: int, block: Benchmark, seed: int = 0) -> np.ndarray:
    """Latent axes [FEATURES, rank], over their singular values so that common words do not outweigh the rest.

    A randomised SVD by subspace iteration: random combinations of the items' passages start it, as what leaks lies in
    their space; one pass over all passages of all documents takes their orthonormal basis through A'A, and the
    Nystrom form of the result gives the eigenvectors. FEATURES x (rank + extra) numbers reach the driver.
    """
    rng, start = np.random.default_rng(seed), np.zeros((FEATURES, rank + extra))
    for ids in block.items:
        passage, feature, weight = latent.sparse(ids, windows(len(ids), window, window), window)
        np.add.at(start, feature, weight[:, None] * rng.normal(size=(int(passage.max(initial=-1)) + 1, rank + extra))[passage])
    # items may span fewer dimensions than asked for; the rest is random
    spread = np.linalg.qr(start + 1e-6 * np.linalg.norm(start) / FEATURES * rng.normal(size=start.shape))[0]
    y = _product(coded, latent, window, spread, block)
    y += 1e-9 * max(np.linalg.norm(y), 1e-12) * spread
    core = spread.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-10
    axes, singular, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    sound = singular[:rank] > 1e-6 * singular[0]
    return (axes[:, :rank][:, sound] / singular[:rank][sound]).astype(np.float32)


def _leaks_of(ids: np.ndarray, latent: Latent, block: Benchmark, queries: Queries, least_cosine: float, least_overlap: float, least_answer: float) -> dict[int, tuple[float, float, float]]:
    """Cosine, overlap and answer overlap of the items that a text of these word ids holds."""
    best: dict[int, tuple[float, float, float]] = {}
    for start, size, i, cosine in queries.candidates(latent, ids, least_cosine, least_overlap):
        words = block.items[i].tolist()
        region = ids[max(0, start - len(words)) : start + size + len(words)].tolist()
        near = set(region)
        if sum(map(near.__contains__, words)) < least_overlap * len(words):
            continue  # the same bound for these surroundings
        overlap = lcs_length(words, region) / len(words)
        if overlap < least_overlap or (i in best and best[i][1] >= overlap):
            continue
        head, answer = words[: block.answers[i]], words[block.answers[i] :] or words
        share = lcs_length(answer, region) / len(answer)
        sure = overlap >= SURE_OVERLAP or len(answer) < LEAST_ANSWER_WORDS or (head and lcs_length(head, region) >= WHOLE_HEAD * len(head))
        if sure or share >= least_answer:
            best[i] = (cosine, overlap, share)
    return best


def _search(coded: DataFrame, latent: Latent, block: Benchmark, window: int, stride: int, least_cosine: float, least_overlap: float, least_answer: float) -> DataFrame:
    """Leaks (k1, k2, doc_id, item_id, cosine, overlap, answer_overlap) of a block, at most one row per row and item."""
    shared = coded.sparkSession.sparkContext.broadcast((latent, block, Queries(latent, block, window, stride)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list[tuple] = []
            for r, raw in enumerate(batch.column("ids")):
                best = _leaks_of(np.frombuffer(raw.as_py(), np.int32), *shared.value, least_cosine, least_overlap, least_answer)
                rows += [r] * len(best)
                found += [(shared.value[1].names[i], *v) for i, v in best.items()]
            cells = list(zip(*found)) or [[], [], [], []]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(n).take(take) for n in ("k1", "k2", "doc_id")] + [pa.array(cells[0], pa.int64()), *(pa.array(c, pa.float64()) for c in cells[1:])],
                ["k1", "k2", "doc_id", "item_id", "cosine", "overlap", "answer_overlap"],
            )
        release_memory()

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.mapInArrow(match, f"k1 long, k2 long, doc_id {kind}, item_id long, cosine double, overlap double, answer_overlap double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 24, stride: int = 8, rank: int = 64, least_cosine: float = 0.5, least_overlap: float = 0.6, least_answer: float = 0.5, block_items: int = 20_000, block_bytes: int = 8 << 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Which documents hold which benchmark items: k1, k2 (the row's key), doc_id, item_id, cosine, overlap, answer_overlap.

    Passages are ``window`` words every ``stride`` words of whole texts, and the same of items; items shorter than that are
    looked for in passages of half or a quarter of it. Term weights are counts times the idf over all documents; the
    latent axes are fitted on all passages. Every passage whose latent cosine to an item's passage is ``least_cosine``
    is a candidate, whatever else stands in it and however many documents there are. An item
    is leaked if the longest common subsequence of its words with the surroundings has ``least_overlap`` of them, so
    paraphrases with changed, added or dropped words are found. Overlaps below SURE_OVERLAP are confirmed by the same of
    the answer, which must have ``least_answer``, unless the part before the answer is there nearly whole. The answer is
    only guessed (the last sentence or line); one of fewer than LEAST_ANSWER_WORDS words is not asked for.

    The benchmark is taken in blocks of bounded size, each broadcast and searched against all documents; a larger
    benchmark costs more blocks, not more memory. Null and empty texts and items hold nothing; an item id that is
    null is reported as null; equal rows are one row. Items of one id are each searched.
    """
    k1, k2 = row_keys(F.col(doc_id), F.col(text))
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null and text <> ''")
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    facts = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    blocks = max(-(-facts["n"] // block_items), -(-(facts["size"] or 0) // block_bytes))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"k1 long, k2 long, doc_id {kind}, item_id long, cosine double, overlap double, answer_overlap double")
    placed = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1))))
    for number in range(blocks):
        part = placed.where(F.col("block") == number).select("item_id", "text").orderBy("item_id", "text").toArrow()
        block = load_block([(n, t) for n, t in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist())])
        keep = [i for i, ids in enumerate(block.items) if len(ids)]
        block = Benchmark([block.names[i] for i in keep], block.vocabulary, [block.items[i] for i in keep], [block.answers[i] for i in keep])
        if not keep:
            continue
        coded = _coded(rows, block)
        df, n = _document_frequencies(coded, len(block.vocabulary))
        latent = Latent(np.log((n + 1) / (df + 1)) + 0.1, float(np.log(n + 1) + 0.1))
        latent.axes = _axes(coded, latent, window, rank, 8, block)
        out = out.unionByName(_search(coded, latent, block, window, stride, least_cosine, least_overlap, least_answer))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per leaked (doc_id, item_id): the largest overlap, with the answer's and the latent cosine."""
    found = find_leaks(docs, benchmark, **options)
    best = F.max(F.struct("overlap", "answer_overlap", "cosine")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.overlap", "b.answer_overlap", "b.cosine")


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, all columns as they are."""
    found = settle(find_leaks(docs, benchmark, doc_id=doc_id, text=text, **options).select(F.col("k1").alias("__leak_1"), F.col("k2").alias("__leak_2")).distinct())
    k1, k2 = row_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    keyed = docs.withColumns({"__key_1": k1, "__key_2": k2})
    kept = keyed.join(found, (F.col("__key_1") == F.col("__leak_1")) & (F.col("__key_2") == F.col("__leak_2")), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
