"""Byte-level BPE against the tiktoken library: random texts, odd characters, long pre-tokens, cuts, round trips."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_operators import documents
from tidemark.llm.bpe import BytePairCoder, Codec, Vocabulary, ascii_pattern, decoded, encoded, public_ranks, read_ranks, round_trips, token_facts

PATH, PATTERN = public_ranks()
ODD = ["a", "B", " ", "  ", "\n", "\t", "'s", "'S", "’s", "é", "中", "㈻㍇9"[:1], "\U000323b0", "\U00011de0", "1", "２", " ", " ", "\x1c", "\x85", "😀", "ß", "!", "--", "́", "<|endoftext|>", "▁", "\x00", "ааа", "the", " of"]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH, PATTERN)


@pytest.fixture(scope="module")
def codec(vocabulary):
    return Codec(vocabulary, remembered=50)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def ids(codec, text, **more):
    return np.frombuffer(codec.encode(text, **more), "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=3)), max_size=30).map("".join), st.sampled_from([2, 9, 1 << 19]))
def test_same_ids_as_the_library(codec, library, text, step):
    got = ids(codec, text, step=step)
    assert got == library.encode_ordinary(text)
    back = codec.decode(np.array(got * 2, "<i4"), np.array([0, len(got), 2 * len(got)]))
    assert back.to_pylist() == [text.encode()] * 2


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000, "你" * 10_000, " " * 3000, "\n" * 3000, "x y" * 5000], ids=lambda t: repr(t[:3]))
def test_long_pre_tokens(vocabulary, library, text):
    assert ids(Codec(vocabulary), text) == library.encode_ordinary(text)


def test_a_token_that_merges_do_not_reach_is_taken_whole(tmp_path):
    import base64

    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyzzy": 259}
    (tmp_path / "r").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items()))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = Codec(Vocabulary(str(tmp_path / "r"), PATTERN))
    for text in ("xyzzy", "xyzzyx", "abc", "bcab", "xyzzy abc"):
        assert ids(codec, text) == library.encode_ordinary(text)
    assert b"xyzzy" in codec.whole


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=127), max_size=40))
def test_ascii_split(codec, text):
    assert codec.plain is not codec.pattern and codec.plain.findall(text) == codec.pattern.findall(text)


def test_other_patterns_are_left_to_the_general_module():
    assert ascii_pattern(r"\p{Lu}+|.") is None and ascii_pattern(r"[\p{L}--[a]]") is None and ascii_pattern(r"\P{L}") is None
    assert ascii_pattern(r"\\p{L}|[\]\p{N}]+").pattern == r"\\p{L}|[\]0-9]+"


def test_memory_is_bounded(vocabulary, library):
    codec = Codec(vocabulary, remembered=100)
    for i in range(50):
        text = " ".join(f"w{i}x{j}" for j in range(60)) + " the of and" + " q" * 70 + "q" * 70
        assert ids(codec, text) == library.encode_ordinary(text)
        assert len(codec.young) <= 170 and len(codec.old) <= 170
        assert all(len(w) <= 64 for w in codec.young)


def test_frame_handles_null_empty_repeated_and_clashing(spark, library):
    rows = [(1, "Hello  world's\n\n end ", "a"), (1, "Hello  world's\n\n end ", "a"), (2, None, "a"), (3, "", "a"), (None, "x" * 5000, None), (4, "naïve 東京 " * 3000, "a")]
    coder = BytePairCoder(spark)
    docs = documents(spark, rows).withColumnRenamed("k1", "ids").withColumnRenamed("size", "decoded")
    got = token_facts(decoded(encoded(docs, coder), coder)).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for r, (_, text, _) in zip(got, rows):
        want = library.encode_ordinary(text or "")
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert token_facts(round_trips(docs, coder)).collect() == got
    for none in (decoded(encoded(documents(spark, []), coder), coder), round_trips(documents(spark, []), coder)):
        assert token_facts(none).count() == 0
    odd = spark.createDataFrame([([300, 5],), (None,), ([], ), ([999_999],), ([None],)], "ids array<int>")
    ranks = {i: t for t, i in read_ranks(PATH).items()}
    assert [None if r.decoded is None else bytes(r.decoded) for r in decoded(odd, coder).collect()] == [ranks[300] + ranks[5], None, b"", None, None]


def test_query_on_whole_documents(spark, library):
    from tidemark.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op11_byte_pair_round_trip"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
