"""Token ids in ORC files: ordered by document, with row indexes and Bloom filters on the document id."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import partitions, release_memory
from tidemark.llm.hashing import WordHasher
from tidemark.session import settle

#: classes of bytes: 1 blank, 2 line end, 3 other white space
BYTES = np.zeros(256, np.uint8)
BYTES[0x20], BYTES[0x0A] = 1, 2
BYTES[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = 3
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordTable:
    """Ids of words by a 128-bit hash, open addressing in arrays; a fixed number of slots, filled to 0.6 at most."""

    def __init__(self, slots: int) -> None:
        self.slots, self.most = slots, int(0.6 * slots)
        self.keys = [np.zeros(slots, np.uint64) for _ in FACTORS]
        self.at, self.size = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.ids, self.n_ids, self.n_words = np.zeros(1 << 16, "<u4"), 0, 0

    def cleared(self) -> WordTable:
        """Empty again, in the memory it has."""
        for keys in self.keys:
            keys.fill(0)
        self.n_ids = self.n_words = 0
        return self

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 for unknown ones."""
        slot = (h1 >> np.uint64(1)).astype(np.int64) & (self.slots - 1)
        out, todo = np.full(len(h1), -1), np.arange(len(h1))
        while len(todo):
            s, k1 = slot[todo], self.keys[0][slot[todo]]
            hit = (k1 == h1[todo]) & (self.keys[1][s] == h2[todo])
            out[todo[hit]] = s[hit]
            todo = todo[~hit & (k1 != 0)]
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)
        return out

    def insert(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Distinct words not yet known; word i has the ``size[i]`` ids from ``first[i]`` on."""
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        slot, todo = (h1 >> np.uint64(1)).astype(np.int64) & (self.slots - 1), np.arange(len(h1))
        while len(todo):
            free = todo[self.keys[0][slot[todo]] == 0]
            # of several words that want one slot, the last stays
            self.keys[0][slot[free]], self.keys[1][slot[free]] = h1[free], h2[free]
            won = free[(self.keys[0][slot[free]] == h1[free]) & (self.keys[1][slot[free]] == h2[free])]
            self.at[slot[won]], self.size[slot[won]] = self.n_ids + first[won], size[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)
        self.n_ids += len(ids)
        self.n_words += len(h1)


class PieceEncoder:
    """Encodes whole texts with a byte-level BPE tokenizer of the tokenizers library, remembering words.

    A byte-level BPE cuts a text at single blanks and line ends before it merges, so a word with the blank or line
    end before it has the same ids in any text. New words are encoded by the library, strung together; known ones
    are looked up by a 128-bit hash, whole batches at a time. Texts with other or repeated white space, whose cut
    depends on more than the word, and texts with a word of more than ``longest`` bytes go to the library whole: the
    hash is sure to tell short words apart only. Memory is two tables of ``slots``: when the young one is full it
    becomes the old one, and words met again come over from there, so frequent words stay whatever the vocabulary.
    """

    def __init__(self, path: str, slots: int = 1 << 20, longest: int = 64) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # bytes of text behind each id: a character of a byte-level token is a byte
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.width[i] = len(name)
        self.hashers = [WordHasher(factor, seed) for seed, factor in enumerate(FACTORS)]
        self.kinds = np.random.default_rng(7).integers(1, 2**63, 3, dtype=np.uint64)
        self.longest = longest
        self.young, self.old = WordTable(slots), WordTable(slots)
        # what reading the vocabulary took goes back to the system
        release_memory()

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, text: bytes, begin: np.ndarray, end: np.ndarray, kind: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Bring the words of a group into the young table and give their slots; -1 where two words share a hash."""
        slot = self.young.find(h1, h2)
        pick = np.flatnonzero(slot < 0)
        pick = pick[np.unique(h1[pick], return_index=True)[1]]
        if self.young.n_words + len(pick) > self.young.most:
            pick = np.unique(h1, return_index=True)[1]
            slots = self.young.slots
            while len(pick) > 0.6 * slots:
                slots *= 2
            self.old, self.young = self.young, self.old.cleared() if slots == self.old.slots else WordTable(slots)
        before = self.old.find(h1[pick], h2[pick])
        met, where = pick[before >= 0], before[before >= 0]
        if len(met):
            size = self.old.size[where].astype(np.int64)
            first = np.cumsum(size) - size
            ids = self.old.ids[np.repeat(self.old.at[where].astype(np.int64) - first, size) + np.arange(int(size.sum()))]
            self.young.insert(h1[met], h2[met], ids, first, size)
        new = pick[before < 0]
        for mark, members in ((b" ", new[kind[new] == 1]), (b"\n", new[kind[new] != 1])):
            for part in np.array_split(members, max(1, len(members) // 1000)):
                if not len(part):
                    continue
                pieces = [mark + text[a:b] for a, b in zip(begin[part].tolist(), end[part].tolist())]
                ids = np.array(self.tokenizer.encode_batch_fast([b"".join(pieces).decode()], add_special_tokens=False)[0].ids, "<u4")
                cuts = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(end[part] - begin[part] + 1)) + 1
                first = np.concatenate([[0], cuts[:-1]])
                # the first word of a text has no line end before it, which is an id of its own
                bare = (kind[part] == 0).astype(np.int64)
                self.young.insert(h1[part], h2[part], ids, first + bare, cuts - first - bare)
        return self.young.find(h1, h2)

    def encode(self, texts: list[str | None], most: int = 1 << 18) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null as empty.

        Taken in groups of about ``most`` characters, which bounds the memory; a longer text is a group of its own.
        """
        out, group, held = [], [], 0
        for t in texts:
            group.append(t)
            held += len(t or "")
            if held >= most:
                out += self._encode_group(group)
                group, held = [], 0
        return out + self._encode_group(group)

    def _encode_group(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        for i, t in enumerate(texts):
            if t:
                if len(t) <= 1 << 22 and (t.isascii() or not WIDE_SPACE.search(t)):
                    plain.append(i)
                else:
                    out[i] = self._ids(t)
        if not plain:
            return out
        parts = [texts[i].encode() for i in plain]
        text = b"\n".join([*parts, b""])
        raw = np.frombuffer(text, np.uint8)
        marks = BYTES[raw]
        ends_of_texts = np.cumsum([len(x) + 1 for x in parts]) - 1
        end = np.flatnonzero((marks == 1) | (marks == 2))
        begin = np.concatenate([[0], end[:-1] + 1])
        of = np.searchsorted(ends_of_texts, end)
        odd = np.zeros(len(parts), bool)
        odd[of[begin == end]] = True
        odd[np.searchsorted(ends_of_texts, np.flatnonzero(marks == 3))] = True
        odd[of[end - begin > self.longest]] = True
        kind = np.where(marks[begin - 1] == 1, 1, 2)
        kind[0] = 0
        kind[1:][of[1:] != of[:-1]] = 0
        keep = ~odd[of]
        begin, end, kind, of = begin[keep], end[keep], kind[keep], of[keep]
        h1, h2 = (hashed(raw, begin, end, self.kinds[kind]) for hashed in self.hashers)
        slot = self.young.find(h1, h2)
        if (slot < 0).any():
            slot = self._learn(text, begin, end, kind, h1, h2)
            odd[of[slot < 0]] = True
            keep = ~odd[of]
            slot, of = slot[keep], of[keep]
        for j in np.flatnonzero(odd).tolist():
            out[plain[j]] = self._ids(texts[plain[j]])
        if not len(of):
            return out
        size = self.young.size[slot].astype(np.int64)
        ends = np.cumsum(size)
        flat = self.young.ids[np.repeat(self.young.at[slot] - (ends - size), size) + np.arange(ends[-1])].tobytes()
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        cuts = np.append((ends - size)[first], ends[-1]).tolist()
        for j, a, b in zip(of[first].tolist(), cuts, cuts[1:]):
            out[plain[j]] = flat[4 * a : 4 * b]
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, shards: int | None = None, doc_id: str = "doc_id", text: str = "text", stripe_bytes: int = 64 << 20) -> None:
    """Tokenize whole texts and write (shard, row, doc_id, ids) as ORC below ``path``.

    Texts are laid out by range of id and head of the text before they are encoded, each range is one shard, and rows
    stand in ascending id (null first, then by text) inside it and from shard to shard. ORC run-length-encodes the
    ids, keeps a row index for every 10,000 rows with minimum and maximum id, and a Bloom filter on doc_id; stripes
    are read in parallel and pruned by both.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the head of a text orders as the text does and keeps what is sampled for the ranges small
    placed = rows.repartitionByRange(shards or partitions(spark), "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    where = tokenizer or public_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at = encoder(where), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = coder.encode(part.column("text").to_pylist())
                lengths = np.array([len(x) // 4 + 1 for x in ids], np.int32)
                flat = np.frombuffer(end.join([*ids, b""]), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
                numbers = pa.array(np.arange(at, at + part.num_rows, dtype=np.int64))
                at += part.num_rows
                del ids, flat
                if begin % 1024 == 0:
                    release_memory()
                yield pa.RecordBatch.from_arrays([part.column("shard"), numbers, part.column("doc_id"), lists], ["shard", "row", "doc_id", "ids"])
        # the worker lives on for other tasks: what the texts of this one held goes back to the system
        release_memory()

    coded = placed.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(encode, f"shard int, row long, doc_id {kind}, ids array<int>")
    writer = coded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "10000")
    writer.option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd").orc(path)


def read_tokens(spark: SparkSession, path: str, doc_type: str = "long") -> DataFrame:
    return spark.read.schema(f"shard int, row long, doc_id {doc_type}, ids array<int>").orc(path)


def token_digest(tokens: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of its ids."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the files are written: what this worker remembered of words goes back to the system
        _ENCODERS.clear()
        release_memory()
        for batch in batches:
            lists = batch.column("ids")
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            ends = lists.offsets.to_numpy()
            view = memoryview(flat).cast("B")
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("row"), batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["shard", "row", "doc_id", "n_tokens", "ids_crc32"])

    facts = settle(tokens.mapInArrow(digest, f"shard int, row long, doc_id {kind}, n_tokens long, ids_crc32 long"))
    totals = facts.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # one row per shard, as many as the layout has ranges
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    begun = facts.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(shifts, "shard")
    return begun.select("doc_id", (F.col("inside") + F.col("shift")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token files of ``docs`` to ``path`` and give the digest of every document as read back.

    Null and empty texts have only the end id. Rows repeated under one id follow each other by text. Other columns
    are not read.
    """
    write_tokens(docs, path, tokenizer, end_id, doc_id=doc_id, text=text)
    return token_digest(read_tokens(docs.sparkSession, path, docs.schema[doc_id].dataType.simpleString()))
