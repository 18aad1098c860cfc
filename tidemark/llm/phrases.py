"""Phrase collocations through prefix-free parsing: n-grams are counted in distinct chunks, weighted by how often these occur."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.bytewords import as_strings, joined, run_sums, spans, text_groups
from tidemark.llm.common import release_memory
from tidemark.llm.hashing import WordHasher
from tidemark.session import settle

#: bytes of words, and bytes that end a piece: . , ; : ! ? and line ends
WORD, BREAK = np.ones(256, bool), np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
WORD[BREAK] = WORD[[0x20, 0x09]] = False
GAP, END = 0x20, 0x0A


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def hasher() -> WordHasher:
    return WordHasher(0x9E3779B97F4A7C15, 5)


# ---- parsing


def chunks_of(raw: np.ndarray, marks: np.ndarray, hashed: WordHasher, trigger: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with single gaps, where each chunk begins and ends in them, its text and how many words it owns.

    A chunk begins with a text and at every word whose hash is 0 modulo ``trigger``: where, is decided by the word
    alone, so equal passages are cut alike wherever they stand. It owns the words up to the next chunk and ends with
    the ``overlap`` words after them, as far as their piece goes, so that each n-gram has one chunk that owns its
    first word and holds it whole.
    """
    inside = WORD[raw]
    begin, end = spans(inside)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, none, none
    of = np.searchsorted(marks, begin)
    breaks = np.concatenate([[0], np.cumsum(BREAK[raw])])
    last_of_piece = np.append(breaks[begin[1:]] != breaks[end[:-1]], True)
    length = end - begin
    at = np.concatenate([[0], np.cumsum(length + 1)])
    plain = np.empty(at[-1], np.uint8)
    plain[np.arange(int(length.sum())) + np.repeat(np.arange(len(begin)), length)] = raw[inside]
    plain[at[1:] - 1] = np.where(last_of_piece, END, GAP)

    starts = hashed(raw, begin, end) >> np.uint64(8)
    first = np.flatnonzero((starts % np.uint64(trigger) == 0) | np.concatenate([[True], of[1:] != of[:-1]]))
    stop = np.append(first[1:], len(begin))
    ends_of_pieces = np.flatnonzero(last_of_piece)
    piece_end = ends_of_pieces[np.searchsorted(ends_of_pieces, stop - 1)]
    to = np.minimum(stop - 1 + overlap, piece_end)
    return plain, at[first], at[to + 1], of[first], stop - first


def parsed(docs: DataFrame, lang: str, text: str, trigger: int, overlap: int) -> DataFrame:
    """The dictionary: (lang, owned, chunk, m), m how often the parse of all texts has the chunk."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = hasher()
        for batch in batches:
            at = 0
            for texts in text_groups(batch.column("text")):
                plain, begin, end, of, owned = chunks_of(*joined(texts, END), hashed, trigger, overlap)
                size = end - begin
                offsets = np.concatenate([[0], np.cumsum(size)])
                flat = plain[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)]
                # the mark behind the last word is the end of the chunk, whatever followed it
                flat[offsets[1:] - 1] = END
                chunks = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(flat)).cast(pa.string())
                langs = batch.column("lang").slice(at, len(texts)).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([langs, pa.array(owned.astype(np.int32)), chunks], ["lang", "owned", "chunk"])
                at += len(texts)
        release_memory()

    rows = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(parse, "lang string, owned int, chunk string").groupBy("lang", "owned", "chunk").agg(F.count("*").alias("m"))


# ---- counting


class Chunks:
    """Words of a slice of the dictionary as numbers: where n-grams begin that a chunk owns, and their hashes."""

    def __init__(self, lang: pa.Array, chunk: pa.Array, owned: np.ndarray, m: np.ndarray, hashed: WordHasher, longest: int) -> None:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        self.raw = np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        inside = (self.raw != GAP) & (self.raw != END)
        self.begin, self.end = spans(inside)
        self.words = as_strings(self.raw, inside, self.begin, self.end)
        n = len(self.begin)
        of = np.searchsorted(ends[1:] - ends[0] - 1, self.begin)
        first = np.searchsorted(of, np.arange(len(chunk)))
        stops = np.flatnonzero(self.raw[self.end] == END) if n else np.zeros(0, np.int64)
        #: words from here to the end of the piece
        self.left = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n) + 1 if n else np.zeros(0, np.int64)
        self.own = np.arange(n) - first[of] < owned[of]
        self.m = m[of]
        langs = lang.dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy()[of]
        # chained hashes of 1 to ``longest`` words, begun with the language
        names = np.frombuffer("\n".join([*self.langs.to_pylist(), ""]).encode(), np.uint8)
        cuts = np.cumsum([len(x.encode()) + 1 for x in self.langs.to_pylist()]) - 1
        seed = hashed(names, np.concatenate([[0], cuts[:-1] + 1]), cuts) if len(cuts) else np.zeros(0, np.uint64)
        word = hashed(self.raw, self.begin, self.end)
        self.hashes = [_mixed(seed[self.lang] ^ (word << np.uint64(1)))]
        for k in range(1, longest):
            h = self.hashes[-1].copy()
            h[: n - k] = _mixed(h[: n - k] + word[k:]) if n > k else h[: n - k]
            self.hashes.append(h)

    def starts(self, k: int) -> np.ndarray:
        return np.flatnonzero(self.own & (self.left >= k))

    def codes(self, at: np.ndarray, k: int) -> np.ndarray:
        """Equal numbers for equal (language, k words), exactly; ``at`` are the places of the first words."""
        places = self.words.dictionary_encode()
        word, size = places.indices.to_numpy().astype(np.int64), len(places.dictionary)
        code = self.lang[at].astype(np.int64) * size + word[at]
        for j in range(1, k):
            code = np.unique(code, return_inverse=True)[1] * size + word[at + j]
        return code

    def phrase(self, at: int, k: int) -> bytes:
        return self.raw[self.begin[at] : self.end[at + k - 1]].tobytes()


class Seen:
    """A Bloom filter with two bits a key over 64-bit hashes."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    @staticmethod
    def places(h: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return h & mask, (h >> np.uint64(27)) & mask

    def __call__(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for place in self.places(h, self.mask):
            found &= (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def seen_filter(hashes: DataFrame, most_bits: int) -> Seen:
    """The filter of a column ``h``: 16 bits a key, at most ``most_bits``; beyond that it lets more through, never less.

    Tasks set the bits of their own keys in 64-bit words, Spark joins the words, so that no key reaches the driver.
    """
    n = hashes.count()
    bits = 1 << max(12, min(most_bits.bit_length() - 1, (16 * n).bit_length()))
    mask = np.uint64(bits - 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.concatenate(Seen.places(batch.column("h").to_numpy().view(np.uint64), mask))
            order = np.argsort(place)
            place = place[order]
            word = (place >> np.uint64(6)).astype(np.int64)
            if len(word):
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                bit = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(bit.view(np.int64))], ["word", "bit"])

    words = hashes.select("h").mapInArrow(mark, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bit").to_numpy().view(np.uint64)
    return Seen(out)


def _slices(batches: Iterator[pa.RecordBatch], hashed: WordHasher, longest: int, bytes_: int = 1 << 23) -> Iterator[Chunks]:
    for batch in batches:
        at = 0
        for chunk in text_groups(batch.column("chunk"), bytes_):
            rows = batch.slice(at, len(chunk))
            at += len(chunk)
            yield Chunks(rows.column("lang"), rows.column("chunk"), rows.column("owned").to_numpy(), rows.column("m").to_numpy(), hashed, longest)


def hash_counts(chunks: DataFrame, k: int, shorter: Broadcast | None) -> DataFrame:
    """(h, n) of the hashes of all k-grams whose first and last k-1 words the filter of ``shorter`` n-grams knows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, held, room = hasher(), [], 0

        def flush() -> pa.RecordBatch:
            keys, sums = run_sums(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], ["h", "n"])

        for part in _slices(batches, hashed, k):
            at = part.starts(k)
            if shorter is not None:
                known = shorter.value
                at = at[known(part.hashes[k - 2][at])]
                at = at[known(part.hashes[k - 2][at + 1])]
            held.append(run_sums(part.hashes[k - 1][at], part.m[at]))
            room += len(held[-1][0])
            if room > 1 << 22:
                yield flush()
                room = 0
        if held:
            yield flush()
        release_memory()

    return chunks.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def exact_counts(chunks: DataFrame, filters: list[Broadcast]) -> DataFrame:
    """(lang, k, phrase, n) of all n-grams that the filter of their length knows, compared word by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = hasher()
        for part in _slices(batches, hashed, len(filters)):
            for k, known in enumerate(filters, 1):
                at = part.starts(k)
                at = at[known.value(part.hashes[k - 1][at])]
                if not len(at):
                    continue
                _, pick, of = np.unique(part.codes(at, k), return_index=True, return_inverse=True)
                sums = run_sums(of, part.m[at])[1]
                places = at[pick]
                langs = part.langs.take(pa.array(part.lang[places]))
                texts = pa.array([part.phrase(i, k) for i in places.tolist()], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(places), k, np.int32)), texts, pa.array(sums)], ["lang", "k", "phrase", "n"])
        release_memory()

    return chunks.mapInArrow(count, "lang string, k int, phrase string, n long").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(chunks: DataFrame, min_count: int, longest: int, filter_bits: int) -> DataFrame:
    """(lang, k, phrase, n) of all phrases of 1 to ``longest`` words with n >= ``min_count``.

    A frequent phrase has only frequent parts. So lengths are counted one after the other, by hash and only where
    the shorter parts are frequent, and the strings are read last, for hashes that are frequent: the rows that are
    shuffled are hashes of possible phrases, never all n-grams. Hashes only leave out what is surely rare.
    """
    spark = chunks.sparkSession
    filters: list[Broadcast] = []
    for k in range(1, longest + 1):
        often = settle(hash_counts(chunks, k, filters[-1] if filters else None).where(F.col("n") >= min_count).select("h"))
        filters.append(spark.sparkContext.broadcast(seen_filter(often, filter_bits)))
    return settle(exact_counts(chunks, filters).where(F.col("n") >= min_count))


# ---- scores


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score) of all phrases of two words and more, by their lowest-scoring cut."""
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = phrases.where("k > 1").select("lang", F.col("phrase").alias("whole"), "k", F.col("n").alias("a"), cut)
    cuts = cuts.withColumn("front", F.expr("substring_index(whole, ' ', cut)")).withColumn("back", F.expr("substring(whole, char_length(front) + 2)"))
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    met = cuts.join(part("front", "l"), ["lang", "front"]).join(part("back", "r"), ["lang", "back"]).join(totals, "lang")
    # products of two counts pass 64 bits: 38 digits hold them exactly
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"({wide('1000 * a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    best = met.withColumn("score", score).groupBy("lang", "whole").agg(F.min(F.struct("score", "cut", "k", "a", "l", "r", "n")).alias("x"))
    return best.select("lang", F.col("whole").alias("phrase"), "x.k", "x.a", "x.l", "x.r", "x.n", "x.score")


def outgrown(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the count of the most frequent longer phrase around each phrase of two words and more."""
    inner = F.flatten(
        F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, n), " ")))
    )
    parts = phrases.where("k > 2").select("lang", F.col("n").alias("longer"), F.explode(F.array_distinct(inner)).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, trigger: int = 32, filter_bits: int = 1 << 28, lang: str = "lang", text: str = "text") -> DataFrame:
    """Per language the first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Phrases are 2 to ``longest`` words within a piece (text between . , ; : ! ? and line ends), A-Z lower-cased, that
    occur at least ``min_count`` times; the score is floor(1000 a n / (l r)) of the cut that gives the least. A phrase
    inside a longer one that occurs as often is dropped. Order: score and a descending, phrase ascending by bytes.

    Texts are parsed into overlapping chunks that begin at content-chosen words; copies and shared passages thus meet
    in the dictionary of distinct chunks, in which n-grams are counted once, times the chunk's frequency. A language
    may hold most rows: every shuffle is by chunk, hash or phrase, and the ranking keeps ``top`` rows a task before it.
    Broadcast are the filters, at most ``filter_bits`` bits for each length.

    A null lang is ``und``; null and empty texts and pieces without words give nothing. Repeated rows count each.
    Other columns are not read.
    """
    chunks = settle(parsed(docs, lang, text, trigger, longest - 1))
    totals = chunks.groupBy("lang").agg(F.sum(F.col("m") * F.col("owned")).alias("n"))
    phrases = frequent_phrases(chunks, min_count, longest, filter_bits)
    kept = scored(phrases, totals).join(outgrown(phrases), ["lang", "phrase"], "left").where("longer is null or longer < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
