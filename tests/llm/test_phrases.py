"""Phrase collocations against a plain count of every n-gram; the parse against its own words."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import lower
from tidemark.llm import bytewords, phrases

SCHEMA = "doc_id long, text string, lang string, n string, score string, k int"


def brute(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = {}
    often = {p: a for p, a in f.items() if a >= least}
    for (lang, p), a in often.items():
        if len(p) == 1:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:c]] * f[lang, p[c:]]), c) for c in range(1, len(p))]
        inside = any(q[0] == lang and len(q[1]) > len(p) and b >= a and any(q[1][i : i + len(p)] == p for i in range(len(q[1]))) for q, b in often.items())
        if not inside:
            score, cut = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, f[lang, p[:cut]], f[lang, p[cut:]], n[lang], score))
    return [(lang, i, x[2].decode(), *x[3:]) for lang, xs in sorted(out.items()) for i, x in enumerate(sorted(xs)[:top], 1)]


def texts():
    r = np.random.default_rng(2)
    vocabulary = ["the", "of", "New", "york", "CITY", "naïve", "東京", "a-b", "x" * 300, "\x85q", "fin e", "w1", "w2"]
    out = []
    for i in range(60):
        words = [vocabulary[int(x)] for x in np.minimum(r.geometric(0.25, int(r.integers(0, 60))) - 1, len(vocabulary) - 1)]
        glue = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "?!", " \r\n "]
        text = "".join(w + glue[int(r.integers(0, len(glue)))] for w in words)
        out.append((i, text, ["en", "en", "de", None][i % 4]))
    out += [(100, None, "en"), (101, "", None), (102, " .,;\t\n", "fr"), (103, "one", "fr"), (104, "the the the the the the the", "en")]
    copies = "New York city never sleeps, the city of new york city halls. New york city never sleeps"
    return out + [(200 + i, copies, "en") for i in range(40)] + [(200, copies, "en")] + [(300, "same same " * 700, "es"), (None, copies, "de")]


@pytest.mark.parametrize("least,trigger,top", [(5, 3, 2000), (2, 32, 7), (20, 1, 2000)])
def test_phrases_match_a_plain_count(spark, least, trigger, top):
    rows = texts()
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)
    got = phrases.collocations(docs, min_count=least, trigger=trigger, top=top, filter_bits=1 << 16)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows, least, top=top))


def test_a_tiny_filter_changes_nothing(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in phrases.collocations(docs, min_count=5, filter_bits=64).collect()) == sorted(brute(rows, 5))


def test_no_documents(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_products_beyond_64_bits(spark):
    big = 2 * 10**15
    rows = [("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 2)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, n long"), spark.createDataFrame([("en", 9 * 10**18)], "lang string, n long")).first()
    assert got.score == 1000 * (big - 2) * 9 * 10**18 // (big * (big - 1))


@pytest.mark.parametrize("trigger", [1, 2, 5, 1000])
def test_chunks_own_each_word_once_and_depend_on_words_only(trigger):
    part = "Alpha beta gamma, delta  epsilon zeta eta. theta iota kappa lambda mu nu xi "
    plain, begin, end, of, owned = phrases.chunks_of(*bytewords.joined(pa.array([part * 3, None, "zz " + part * 2])), phrases.hasher(), trigger, 4)
    words = re.findall("[a-z]+", lower(part))
    assert owned[of == 0].sum() == 3 * len(words) and owned[of == 2].sum() == 2 * len(words) + 1
    chunks = [plain[a:b].tobytes() for a, b in zip(begin, end)]
    for i in range(len(chunks) - 1):
        if of[i] == of[i + 1]:
            rest = chunks[i].split()[owned[i] :]
            assert chunks[i + 1].split()[: len(rest)] == rest and len(rest) <= 4
    if trigger == 2:
        assert len({(c.strip(), n) for c, n in zip(chunks, owned)}) < len(chunks)
