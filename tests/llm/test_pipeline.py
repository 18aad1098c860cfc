"""run() against a brute-force version of every stage, on the smallest tables."""

import re
import zlib

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import WORD, brute_print
from tidemark.llm import mixing, tokens, toxicity
from tidemark.session import settle

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark, monkeypatch):
    seen = []

    def recorded(stage):
        def run(session, docs, folder):
            seen.append((docs, settle(stage(session, docs, folder))))
            return seen[-1][1]

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, recorded(stage)) for name, stage in corpus_pipeline.STAGES])
    final = corpus_pipeline.run(spark, FOLDER)
    assert len(seen) == 5
    for _, out in seen[:-1]:
        assert out.columns == spark.read.parquet(f"{FOLDER}/documents.parquet").columns

    docs, clean = seen[0]
    scores = {r.doc_id: r.score for r in toxicity.scored_toxicity(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, s in scores.items() if s < 0.5)

    docs, single = seen[1]
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    group = {i: i for i in prints}
    for _ in range(3):
        for i, p in prints.items():
            group[i] = min(group[j] for j, q in prints.items() if (p ^ q).bit_count() <= 3)
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(group.values()))

    docs, pure = seen[2]
    plain = lambda t: " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in pure.collect()) == sorted(r.doc_id for r in docs.collect() if not any(x in plain(r.text) for x in items))

    docs, mixed = seen[3]
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(re.findall(WORD, r.text))
    assert taken == {r.doc_id: r.taken for r in mixing.mixed_counts(docs).collect() if r.taken}

    docs, _ = seen[4]
    library = tokens.PieceEncoder(tokens.public_path()).tokenizer
    expected, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.text)):
        ids = np.array(library.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        expected.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in final.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == expected
