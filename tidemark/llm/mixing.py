"""Mixing sources to target weights through fixed-length blocks and pseudorandom permutations of their indices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, partitions, row_keys, running_totals, word_count
from tidemark.session import settle


def target_sizes(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) plus ``target``.

    Sources in code-point order, null last, take the ``weights`` in turn and share ``share`` times all sizes by weight;
    a target stops at ``most`` times its source and the excess is shared again by weight until none is above.
    """
    # ordered totals instead of one window over all sources: their number is the data's own
    one = sizes.select("source", "source_size", F.col("source").isNull().alias("unknown"), F.lit(1).alias("one"))
    placed = running_totals(one, [], ["unknown", "source"], "one", "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = settle(placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")))
    words = rows.agg(F.sum("source_size")).first()[0] or 0
    level = None  # words per unit of weight among the sources below their cap
    while True:
        full = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * F.lit(level)
        capped, open_weight = rows.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight or (now := (share * words - capped) / open_weight) == level:
            break
        level = now
    raw = F.col("weight") * F.lit(level or 0.0)
    target = F.when(F.lit(not open_weight) | (F.col("cap") <= raw), F.col("cap")).otherwise(raw)
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of ``index`` under the pseudorandom permutation of 0 .. ``size`` - 1 that ``key`` names.

    Four Feistel rounds over the smallest even number of bits that holds ``size``; images outside are walked on
    until they fall inside, fewer than four steps on average.
    """
    index, size, key = (np.asarray(a).astype(np.uint64) for a in (index, size, key))
    bits = np.ones(len(size), np.uint64)
    while (small := (np.uint64(1) << (np.uint64(2) * bits)) < size).any():
        bits[small] += np.uint64(1)
    low = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> bits[todo], out[todo] & low[todo]
        for turn in range(1, 5):
            constant = np.uint64(0x9E3779B97F4A7C15 * turn % 2**64)
            left, right = right, left ^ (_mix64(right + key[todo] + constant) & low[todo])
        out[todo] = (left << bits[todo]) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _hash(text: str | None) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\0none" if text is None else f"\1{text}", 11)


def drawn_slots(plan: DataFrame, seed: int = 0, shard_slots: int = 65_536) -> DataFrame:
    """One row per slot of the mix: shard, source, epoch, block.

    ``plan``  source, target, source_size, n_blocks. A source takes whole epochs of all its blocks and, of one more
    epoch, as many blocks as come nearest to its target. Its slots fall on the output shards by a multinomial draw,
    which also says where its run of slots begins in each shard, so shards are filled independently of each other;
    drawn by source with the totals held, the counts of a shard are multinomial given its size, and no source leaves
    its target by chance. Slot numbers become blocks through the source's permutation for that epoch.
    """
    slots = plan.where("n_blocks > 0 and target > 0").withColumn("epochs", F.floor(F.col("target") / F.col("source_size")).cast("long"))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    slots = slots.withColumn("n_slots", F.col("epochs") * F.col("n_blocks") + F.floor(rest * F.col("n_blocks") / F.col("source_size") + 0.5).cast("long"))
    total = slots.agg(F.sum("n_slots")).first()[0] or 0
    n_shards = max(1, -(-total // shard_slots))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, n_blocks, n_slots in zip(frame["source"], frame["n_blocks"], frame["n_slots"]):
                key = _hash(source)
                counts = np.random.Generator(np.random.Philox(key=np.array([key, seed], np.uint64))).multinomial(n_slots, np.full(n_shards, 1.0 / n_shards))
                begin = np.cumsum(counts) - counts
                shard = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "source": pd.Series([source] * len(shard), dtype=object), "n_blocks": n_blocks, "begin": begin[shard], "taken": counts[shard], "key": np.int64(np.uint64(key).view(np.int64))})

    runs = slots.select("source", "n_blocks", "n_slots").mapInPandas(draw, "shard long, source string, n_blocks long, begin long, taken long, key long")
    runs = runs.repartition(partitions(plan.sparkSession), "shard", "source")
    each = runs.withColumn("slot", F.explode(F.sequence("begin", F.col("begin") + F.col("taken") - 1)))

    @F.pandas_udf("long")
    def block_of(slot: pd.Series, n_blocks: pd.Series, key: pd.Series) -> pd.Series:
        epoch = slot.to_numpy() // n_blocks.to_numpy()
        keys = _mix64(key.to_numpy().view(np.uint64) + epoch.astype(np.uint64) + np.uint64(seed))
        return pd.Series(permuted(slot.to_numpy() % n_blocks.to_numpy(), n_blocks.to_numpy(), keys))

    return each.select("shard", "source", F.floor(F.col("slot") / F.col("n_blocks")).cast("long").alias("epoch"), block_of("slot", "n_blocks", "key").alias("block"))


def mixed_spans(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 128, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` as (documents, spans).

    documents: k1, k2 (the row's 128-bit key), n_rows (equal rows), doc_id, source, size, source_size, target.
    spans: k1, k2, copy (of equal rows, from 1), shard, source, epoch, block, lo, hi: one row per use of a part of a
    document; the use covers its words lo .. hi - 1 (from 0).

    Documents of a source follow each other by id in one stream of words that is cut into blocks of ``block_words``
    (the last one may be shorter). Blocks are arithmetic on word positions: only sizes and positions move, never texts.
    A block is used at most once per epoch, so no document exceeds ``most`` times its size when ``most`` is whole.

    Null texts and texts without words have size 0 and are never taken. A null source is a source of its own, last in
    order. Equal rows (id, source and text) are each part of the stream.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    k1, k2 = row_keys(F.col("doc_id"), F.col("source"), F.col("text"))
    sized = rows.select(k1.alias("k1"), k2.alias("k2"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = settle(sized.groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count("*").alias("n_rows")))
    per_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"))
    plan = settle(target_sizes(per_source, weights, share, most).withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long")))
    slots = drawn_slots(plan, seed)

    each = sized.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    placed = running_totals(each.select("k1", "k2", "doc_id", "source", "size", "copy"), ["source"], ["doc_id", "k1", "k2", "copy"], "size", "start")
    first, last = F.floor(F.col("start") / block_words).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long")
    parts = placed.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    hi = F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size"))
    parts = parts.select("k1", "k2", "copy", "source", "block", lo.alias("lo"), hi.alias("hi"), F.xxhash64("source", F.col("source").isNull()).alias("stream"))
    slots = slots.withColumn("stream", F.xxhash64("source", F.col("source").isNull()))
    # both sides grow with the corpus, and Spark can't know how far a run of slots explodes: never broadcast
    spans = parts.join(slots.drop("source").hint("merge"), ["stream", "block"]).select("k1", "k2", "copy", "shard", "source", "epoch", "block", "lo", "hi")
    documents = sized.join(plan.select(F.col("source").alias("__source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return documents, spans


def mixed_counts(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source) and ``taken``, the words the mix takes of it."""
    documents, spans = mixed_spans(docs, **options)
    taken = spans.groupBy("k1", "k2").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    joined = documents.join(taken, ["k1", "k2"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    # equal rows share what their key takes as evenly as whole words allow
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_rows").cast("int") - 1)))
    part = F.floor(F.col("taken") / F.col("n_rows")).cast("long") + F.when(F.col("copy") < F.col("taken") % F.col("n_rows"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", part.alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row per document and epoch that takes any of its words.

    The text of a row is the whole text if the epoch takes all of it, else the taken words joined by blanks in their
    order; ``n_chars``, where there is one, is recounted. Documents that the mix leaves out are gone, documents that
    it takes twice are there twice. Of equal rows of ``docs`` (same id, source and text) each is a document of its own
    here; where they differ in other columns, one of them gives these columns to all.
    """
    documents, spans = mixed_spans(docs, doc_id=doc_id, text=text, source=source, **options)
    used = spans.groupBy("k1", "k2", "copy", "epoch").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("parts"))
    used = used.select(F.col("k1").alias("__use_1"), F.col("k2").alias("__use_2"), F.col("parts").alias("__parts"))
    k1, k2 = row_keys(F.col(f"`{doc_id}`"), F.col(f"`{source}`"), F.col(f"`{text}`"))
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})
    if not documents.where("n_rows > 1").isEmpty():
        keyed = keyed.dropDuplicates(["__k1", "__k2"])
    joined = keyed.join(used, (F.col("__k1") == F.col("__use_1")) & (F.col("__k2") == F.col("__use_2")))
    body = F.col(f"`{text}`")
    whole = F.aggregate("__parts", F.lit(0).cast("long"), lambda n, p: n + p["hi"] - p["lo"]) == word_count(body)
    words = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    picked = F.get(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("__parts", lambda p: F.slice(w, (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), " ")), F.lit(0))
    mixed = F.when(whole, body).otherwise(picked)
    out = joined.withColumn("__text", mixed)
    columns = []
    for f in docs.schema.fields:
        c = F.col("__text") if f.name == text else F.char_length("__text").cast(f.dataType) if f.name == n_chars else F.col(f"`{f.name}`")
        columns.append(c.alias(f.name))
    return out.select(*columns)
