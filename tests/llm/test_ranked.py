"""Ranked search against a plain score of every document and item."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_operators import documents, lower
from tidemark.llm import ranked

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def brute(rows, items, k):
    bags = [(i, Counter(re.findall(TERM, lower(t or "")))) for i, t in rows]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(re.findall(TERM, lower(t or "")))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in terms if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, place, x[3], -x[0]) for place, x in enumerate(sorted(scores)[:k], 1)]
    return out


def rows():
    r = np.random.default_rng(3)
    vocabulary = ["The", "of", "naïve", "東京", "x9", "rare", "É", "foo", "bar", "baz"]
    out = [(i, " ".join(vocabulary[int(x)] for x in np.minimum(r.geometric(0.3, int(r.integers(0, 40))) - 1, 9)) + "!") for i in range(80)]
    copies = [(1000 - i, "foo, BAR-bar the (x9) other words " * (1 + i % 2)) for i in range(60)]
    # the same item terms and length as the copies, in other words
    copies += [(500 + i, f"foo bar bar the x9 another w{i}") for i in range(5)]
    return out + copies + [(7, "foo"), (7, "foo"), (None, "rare foo"), (2000, None), (2001, ""), (2002, "..."), (2003, "foo " * 20_000 + "rare")]


ITEMS = [(3, "The foo of rare, foo!"), (1, "東京 naïve"), (2, None), (4, "unknownterm"), (None, "foo"), (5, "bar"), (5, "x9 bar"), (6, "É é")]


@pytest.mark.parametrize("k,block", [(50, 200_000), (3, 200_000), (5, 2)])
def test_ranking_matches_a_plain_score(spark, k, block):
    docs = documents(spark, [(i, t, "s") for i, t in rows()]).repartition(4).withColumnRenamed("k1", "term").withColumnRenamed("size", "bag")
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, term string")
    got = ranked.ranked_search(docs, items, k=k, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, brute(rows(), ITEMS, k)))


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked.ranked_search(documents(spark, []), items).count() == 0
    assert ranked.ranked_search(documents(spark, [(1, "foo", "s")]), items.limit(0)).count() == 0


def test_best_rows_stay_whatever_the_order():
    r = np.random.default_rng(1)
    scores, facts = r.integers(0, 6, (4000, 3)), np.vstack([r.permutation(4000), r.integers(0, 9, (3, 4000))])
    best = ranked.Best(5, 3)
    for at in range(0, 4000, 37):
        best.add(scores[at : at + 37], facts[:, at : at + 37])
        best.settle()
    held = best.settle()
    for item in range(3):
        want = sorted((-int(s), int(f)) for s, f in zip(scores[:, item], facts[0]) if s > 0)[:5]
        assert [(-int(s), int(f)) for s, f in zip(held[1][held[0] == item], held[2][held[0] == item])] == want
