"""Line deduplication across documents (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, ascii_lower, row_keys
from tidemark.session import settle


def drop_common_lines(docs: DataFrame, min_documents: int = 10, min_length: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without the lines that at least ``min_documents`` documents share.

    Returns ``doc_id``, ``n_lines``, ``n_dropped`` and ``kept`` (the other lines in order, joined by newlines).

    Lines are exploded with their position, normalised and hashed to 128 bits. The distinct (line, document) pairs
    are counted per line with partial counts, so a line of every document costs one row per task. The lines over
    the threshold come back as positions per document, and each text is reassembled from the positions left.

    Null and empty texts are one empty line; blank lines are never dropped while ``min_length`` is 1 or more. Rows
    with the same id are one document for the count and keep their own texts; null ids together are one document.
    A text that loses every line becomes empty. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    rows = rows.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))

    lines = rows.select("doc_id", "k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", ascii_lower(F.btrim("line", F.lit(BLANKS)))).where(F.char_length("line") >= min_length)
    lines = settle(lines.select("doc_id", "k1", "k2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")))

    common = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_documents)
    dropped = lines.join(common.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))

    joined = rows.join(dropped, ["k1", "k2"], "left")
    # the split text is bound once as a lambda variable: inlined into the inner lambda it would be split again per line
    parts = F.split("text", "\n", -1)

    def reassembled(all_lines):
        left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone"))
        return F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n")

    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(parts), reassembled), F.lit(0)))
    return joined.select(
        "doc_id", F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept")
    )
