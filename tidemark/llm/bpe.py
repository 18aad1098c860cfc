"""Byte-level BPE through a sentencepiece model written from the ranks of the vocabulary; decoding by inverse mapping."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterable
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import release_memory

#: a byte as a letter that sentencepiece treats like any other: printable, no blank, no mark of its own
LETTERS = [chr(0x100 + b) for b in range(256)]
#: a cut is safe before a single blank between two visible characters, which always begins a new pre-token
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
STAND_IN = "\ue000"
#: what the classes of letters and numbers hold of ASCII
ASCII_CLASSES = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message: a number, a 32-bit float or a length and bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model whose piece i is ``tokens[i]`` with score -i, and an unknown piece at the end.

    sentencepiece merges the neighbours whose joined piece has the highest score, leftmost first: the same rule as
    lowest rank first. Normalisation is the identity: no map, no added, removed or replaced white space.
    """
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, float(score)) + _field(3, kind))
    pieces = [piece("".join([LETTERS[b] for b in t]), -i, 1) for i, t in enumerate(tokens)]
    bpe, absent = 2, (1 << 64) - 1
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, absent) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(pieces) + piece("<unk>", 0, 2) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def newer_characters() -> str:
    """Characters that the pattern module knows as letters or numbers and the tiktoken library does not yet.

    Both follow Unicode, in different versions. Only characters that Python's own tables lack can differ.
    """
    import tiktoken

    kinds = [tiktoken.Encoding("kind", pat_str=p, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}) for p in (r"\p{L}", r"\p{N}")]
    known = [regex.compile(p) for p in (r"\p{L}", r"\p{N}")]
    late = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn")
    return "".join(sorted({c for k, t in zip(known, kinds) for c in k.findall(late) if not t.encode_ordinary(c)}))


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """The same split for ASCII texts in the standard library's faster module; none if the pattern knows other classes."""
    inside, out = False, []
    for part in re.findall(r"\\[pP]\{[^}]*\}|\\.|[\s\S]", pattern):
        if part[:2] in (r"\p", r"\P"):
            if part not in ASCII_CLASSES:
                return None
            part = ASCII_CLASSES[part] if inside else f"[{ASCII_CLASSES[part]}]"
        elif part == "[" and inside:
            return None
        inside = part == "[" or (inside and part != "]")
        out.append(part)
    try:
        return re.compile("".join(out), re.ASCII)
    except re.error:
        return None


class Vocabulary:
    """What encoding needs, sent to the tasks as one broadcast of the size of the vocabulary file."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = read_ranks(path)
        self.tokens, self.ids = zip(*sorted(ranks.items(), key=lambda x: x[1]))
        self.pattern, self.newer = pattern, newer_characters()
        self.model = sentencepiece_model(list(self.tokens))


class Codec:
    """Encodes and decodes in one Python worker; pre-tokens seen lately are kept, in two generations of bounded size."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = 200_000) -> None:
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)
        self.pattern = regex.compile(vocabulary.pattern)
        self.plain = ascii_pattern(vocabulary.pattern) or self.pattern
        self.newer = frozenset(vocabulary.newer)
        # a class within one plane is looked up at once, so the few characters beyond it are only asked for by range
        low = "".join(c for c in vocabulary.newer if ord(c) < 0x10000)
        self.suspect = re.compile(f"[{re.escape(low)}\U00010000-\U0010ffff]")
        self.ids = np.array(vocabulary.ids, "<i4")
        self.tokens = pa.array(vocabulary.tokens, pa.binary())
        self.place = np.full(max(vocabulary.ids) + 1, -1, "<i4")
        self.place[self.ids] = np.arange(len(self.ids))
        self.remembered, self.young, self.old = remembered, {}, {}
        # a pre-token that is a token takes its id at once, also where the merges would not reach it
        found = self.pieces.encode(self._mapped(vocabulary.tokens), out_type=int, num_threads=1)
        self.whole = {t: self.ids[i : i + 1].tobytes() for i, (t, got) in enumerate(zip(vocabulary.tokens, found)) if got != [i]}

    def _mapped(self, tokens: list[bytes]) -> list[bytes]:
        """The tokens in letters: byte b is the character 0x100 + b, two bytes of UTF-8."""
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        pairs = np.empty((len(raw), 2), np.uint8)
        pairs[:, 0], pairs[:, 1] = 0xC4 + (raw >> 6), 0x80 | (raw & 63)
        return _pieces(pairs.tobytes(), 2, map(len, tokens))

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain.findall(text)
        if not self.suspect.search(text):
            return self.pattern.findall(text)
        spans = [m.span() for m in self.pattern.finditer("".join([STAND_IN if c in self.newer else c for c in text]))]
        return [text[a:b] for a, b in spans]

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of each word, by the merges or whole."""
        raw = [w.encode() for w in words]
        found = self.pieces.encode(self._mapped(raw), out_type=int, num_threads=1)
        ids = self.ids[np.fromiter(chain.from_iterable(found), np.int64)].tobytes()
        return [self.whole.get(b, x) for b, x in zip(raw, _pieces(ids, 4, map(len, found)))]

    def _slice(self, text: str, longest: int = 64) -> bytes:
        words = self.pre_tokens(text)
        known = list(map(self.young.get, words))
        new = list({w for w, ids in zip(words, known) if ids is None})
        if not new:
            return b"".join(known)
        met = {w: ids for w in new if (ids := self.old.get(w)) is not None}
        if fresh := [w for w in new if w not in met] if met else new:
            met.update(zip(fresh, self._merged(fresh)))
        if len(self.young) + len(met) > self.remembered:
            self.old, self.young = self.young, {}
        self.young.update((w, ids) for w, ids in met.items() if len(w) <= longest)
        return b"".join([met[w] if ids is None else ids for w, ids in zip(words, known)])

    def encode(self, text: str, step: int = 1 << 19) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers, taken in slices that bound the memory of a very long text."""
        out, at = [], 0
        while len(text) - at > step and (cut := SAFE_CUT.search(text, at + step)):
            out.append(self._slice(text[at : cut.start()]))
            at = cut.start()
        out.append(self._slice(text[at:] if at else text))
        return b"".join(out)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Bytes of lists of ids that lie one after another; null where an id is not of the vocabulary or absent (-1).

        The bytes of all tokens taken from the vocabulary lie one after another too, so only the ends are computed.
        """
        inside = (ids >= 0) & (ids < len(self.place))
        places = self.place[np.where(inside, ids, 0)]
        wrong = ~inside | (places < 0)
        taken = self.tokens.take(pa.array(np.where(wrong, 0, places)))
        at = np.frombuffer(taken.buffers()[1], "<i4")[: len(ids) + 1][ends].astype("<i4")
        strange = np.concatenate([[0], np.cumsum(wrong)])[ends]
        valid = pa.array(strange[1:] == strange[:-1])
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [valid.buffers()[1], pa.py_buffer(at), taken.buffers()[2]])


def _pieces(data: bytes, width: int, lengths: Iterable[int]) -> list[bytes]:
    """``data`` cut into pieces of so many items of ``width`` bytes."""
    ends = [width * n for n in accumulate(lengths)]
    return [data[a:b] for a, b in zip([0, *ends], ends)]


_CODECS: dict[str, Codec] = {}


def _codec(key: str, shared) -> Codec:
    """The codec of this Python worker; one of another vocabulary makes room."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value)
    return _CODECS[key]


def _encoded(codec: Codec, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another and where each text ends; one text at a time is a Python string."""
    ids = [codec.encode(t) if (t := text.as_py()) else b"" for text in texts]
    return np.frombuffer(b"".join(ids), "<i4"), np.cumsum([0, *[len(x) // 4 for x in ids]])


def public_ranks(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Place and split pattern of a public rank file."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


class BytePairCoder:
    """Column expressions that encode texts and decode ids with a rank file; the file is read once, on the driver."""

    def __init__(self, spark: SparkSession, path: str | None = None, pattern: str | None = None) -> None:
        public = public_ranks()
        vocabulary = Vocabulary(path or public[0], pattern or public[1])
        # as large as the vocabulary file, whatever the corpus
        self.shared = spark.sparkContext.broadcast(vocabulary)
        self.key = hashlib.sha256(vocabulary.model + vocabulary.pattern.encode()).hexdigest()

    def encode(self, text: Column) -> Column:
        """array<int>: the ids of each match of the split pattern, without special tokens; null and empty texts have none."""
        key, shared = self.key, self.shared

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            ids, ends = _encoded(_codec(key, shared), texts)
            release_memory()
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))

        return encode(text)

    def round_trip(self, text: Column) -> Column:
        """struct<ids array<int>, decoded binary>: the ids as by ``encode`` and what ``decode`` makes of them, in one pass.

        As two columns in one plan Spark would encode twice, once for the ids and once below the decoding.
        """
        key, shared = self.key, self.shared

        @F.arrow_udf("ids array<int>, decoded binary")
        def both(texts: pa.Array) -> pa.Array:
            codec = _codec(key, shared)
            ids, ends = _encoded(codec, texts)
            back = codec.decode(ids, ends)
            release_memory()
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), back], ["ids", "decoded"])

        return both(text)

    def decode(self, ids: Column) -> Column:
        """binary: the bytes of the ids; null for null and for ids outside the vocabulary."""
        key, shared = self.key, self.shared

        @F.arrow_udf("binary")
        def decode(lists: pa.Array) -> pa.Array:
            flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0)
            ends = np.cumsum([0, *sizes.to_numpy(zero_copy_only=False)])
            got = _codec(key, shared).decode(pc.fill_null(flat.cast(pa.int64()), -1).to_numpy(zero_copy_only=False), ends)
            return pc.if_else(lists.is_valid(), got, pa.scalar(None, pa.binary()))

        return decode(ids)


def encoded(docs: DataFrame, coder: BytePairCoder, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, ids) per row of ``docs``, whole texts; null counts as empty, repeated rows are encoded each.

    A map over the rows: nothing is shuffled, and only the two columns are read.
    """
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), coder.encode(F.col(f"`{text}`")).alias("ids"))


def decoded(tokens: DataFrame, coder: BytePairCoder, ids: str = "ids") -> DataFrame:
    """``tokens`` with the column ``decoded``: the bytes behind the ids. Any bytes of a text come back as they were."""
    return tokens.withColumn("decoded", coder.decode(F.col(f"`{ids}`")))


def round_trips(docs: DataFrame, coder: BytePairCoder, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, ids, decoded) per row of ``docs``, as ``decoded(encoded(docs))`` gives, with each text encoded once."""
    both = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), coder.round_trip(F.col(f"`{text}`")).alias("both"))
    return both.select("doc_id", "both.ids", "both.decoded")


def token_facts(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids joined by commas and SHA-256 of the decoded bytes."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
