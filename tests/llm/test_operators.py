"""Operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names, brute force."""

import functools
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import hashing, leaks, lines, mixing, quality, simhash, tokens, toxicity, urls, vectors, warc
from tidemark.llm.common import components, running_totals
from tidemark.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars int, k1 string, size string, `count` string"


def documents(spark, rows):
    """Rows (doc_id, text, source) with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z") for i, t, s in rows], DOCS).coalesce(1)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- shared helpers


def test_running_totals_match_a_plain_sum(spark):
    rows = [(k, i, (i * 7) % 5) for k in ("hot", None, "b") for i in range(60 if k == "hot" else 5)]
    df = spark.createDataFrame(rows, "k string, i int, v long").repartition(4)
    got = {(r.k, r.i): r.before for r in running_totals(df, ["k"], ["i"], "v").collect()}
    assert got == {(k, i): sum(v for k2, j, v in rows if k2 == k and j < i) for k, i, v in rows}


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], [(0, i) for i in range(1, 30)] + [(-5, 29)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


def test_word_hashes_tell_words_apart():
    words = [f"w{i}".encode() for i in range(5000)] + [b"ab", b"ba", b"w1"]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = ends - [len(w) for w in words]
    h = hashing.WordHasher(0x9E3779B97F4A7C15, 1)(raw, begins, ends)
    assert len(set(h.tolist())) == len(words) - 1 and h[1] == h[-1]


# ---- line deduplication


def test_lines(spark):
    shared = [(i, f" SHARED Line\t\nown {i}\n\n{'é' if i % 2 else 'É'}", None) for i in range(10)]
    rows = shared + [(20, None, "s"), (21, "", "s"), (22, "shared line", "s"), (22, "shared line", "s"), (23, "a\n" * 3000 + "b", "s"), (None, "shared line\nx", None)]
    got = {(r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in lines.drop_common_lines(documents(spark, rows)).collect()}
    for i in range(10):
        assert (i, f"own {i}\n\n{'é' if i % 2 else 'É'}", 4, 1) in got  # É and é are different keys, five documents each
    assert {(20, "", 1, 0), (21, "", 1, 0), (22, "", 1, 1), (23, "a\n" * 3000 + "b", 3001, 0), (None, "x", 2, 1)} <= got
    assert lines.drop_common_lines(documents(spark, [])).count() == 0


# ---- SimHash


def brute_print(text, n=3):
    w = re.findall(WORD, lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_golay_keys_lose_no_link():
    r = np.random.default_rng(3)
    x = r.integers(-(2**63), 2**63 - 1, 400, dtype=np.int64)
    masks = [0] + [sum(1 << int(p) for p in r.choice(64, k, replace=False)) for k in (1, 2, 3) for _ in range(40)] + [7 << 41, 7 << 18, 7, 3 | 1 << 50]
    of = lambda v: {i: set() for i in range(len(v))}
    a = of(x)
    for i, k in zip(*(c.tolist() for c in simhash.fuzzy_keys(x))):
        a[i].add(k)
    for m in masks:
        b = of(x)
        for i, k in zip(*(c.tolist() for c in simhash.fuzzy_keys(x ^ np.uint64(m).view(np.int64)))):
            b[i].add(k)
        assert all(a[i] & b[i] for i in a)


def test_forest_keeps_parts_together():
    base = [1 << k for k in range(12)] + [0b111 << 40, 2**63]
    found = simhash._forest(np.array(base, np.uint64))
    assert len(found) == 12  # all single bits are within two bits of each other, and the top bit of them too
    assert all((a ^ b).bit_count() <= 3 for a, b in found)


def test_simhash_groups_match_brute_force(spark):
    r = np.random.default_rng(0)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for g in range(8):
        base = list(r.choice(words, 220))
        for c in range(6):
            t = list(base)
            t[int(r.integers(220))] = "changed%d" % c
            rows.append((g * 10 + c, " ".join(t).title(), "s"))
    rows += [(900, None, "s"), (901, "", None), (902, "  \t", "s"), (903, "one", "s"), (904, "one two", "s"), (904, "one two", "s"), (None, "one", "s")]
    got = simhash.near_duplicate_groups(documents(spark, rows)).collect()
    prints = {(i, t): brute_print(t) for i, t, _ in rows}
    assert len(got) == len(rows)
    assert sorted(str(r.fp % 2**64) for r in got) == sorted(str(prints[i, t]) for i, t, _ in rows)
    nodes = sorted(set(prints.values()))
    group = {p: p for p in nodes}
    for _ in nodes:
        for p in nodes:
            group[p] = min(group[q] for q in nodes if (p ^ q).bit_count() <= 3)
    least = {}
    for (i, t), p in prints.items():
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    assert {(r.doc_id, r.component_id) for r in got} == {(i, least.get(group[p])) for (i, t), p in prints.items()}
    kept = simhash.one_of_each_group(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicate_groups(documents(spark, [])).count() == 0


# ---- scores


def labelled(spark, n=240):
    r = np.random.default_rng(1)
    words = ["tion", "anth", "ered", "inger", "the", "of", "heon"]
    docs, labels = [], []
    for i in range(n):
        t = [str(x) for x in r.choice(words, int(r.integers(20, 120)))]
        toxic, bad = i % 4 == 0, i % 5 == 0
        if toxic:
            for k in range(0, len(t), 12):
                t[k] = "zqxvile"
        docs.append((i, " ".join(x + "$$$" if bad else x for x in t), "s"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs += [(n, None, "s"), (n + 1, "", None), (None, "the of", "s"), (0, docs[0][1], "s"), (n + 2, "the of tion " * 5000, "s")]
    labels += [(n, None, None), (None, 1, 1), (1, 1, 0)]
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_scores_separate_held_out_documents(spark, kind):
    docs, labels = labelled(spark)
    scored = (quality.scored_quality if kind == "quality" else toxicity.scored_toxicity)(docs, labels)
    got = scored.collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r[kind] for r in labels.collect() if r[kind] is not None and r.doc_id is not None}
    held = [r for r in got if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]) > 0.95
    one_class = labels.withColumn(kind, F.lit(1))
    scorer = quality.scored_quality if kind == "quality" else toxicity.scored_toxicity
    assert len({r.score for r in scorer(docs, one_class).collect()}) == 1
    assert scorer(documents(spark, []), labels.limit(0)).count() == 0


def test_kneser_ney_sums_to_one_and_counts_everything(spark):
    docs, labels = labelled(spark)
    counts, contexts = toxicity.class_counts(docs, labels)
    chosen = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    brute, met = np.zeros_like(counts), {}
    cell_of = functools.cache(lambda w, i: int(toxicity.expressions(pa.array([w]), toxicity.hasher())[0][i, 0]))
    for r in docs.collect():
        if r.doc_id in chosen:
            words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (r.text or "").lower()) or [""]
            for i, n in enumerate(toxicity.LENGTHS):
                for w in words:
                    cell = cell_of(w[: n or None], i)
                    brute[chosen[r.doc_id], cell] += 1
                    met.setdefault(cell, set())
    assert (counts == brute).all()
    assert set(np.flatnonzero(contexts)) == set(met) and contexts.max() <= toxicity.CONTEXTS
    models = toxicity.ClassModels(counts, contexts)
    for kind in (0, 1):
        for i in range(len(toxicity.LENGTHS)):
            assert np.isclose(models.shares(kind, i).sum(), 1)
    assert np.allclose(models.shared.sum(1), 1)


def test_stems_end_at_characters():
    cells = lambda t: toxicity.expressions(pa.array([t]), toxicity.hasher())[0][:, 0] % toxicity.CELLS
    word, four, five = cells("Réeuxment")
    assert (word, four, five) == (cells("réeuxment")[0], cells("réeu")[0], cells("réeux")[0])
    assert len({int(x) for x in cells("日本語")}) == 1
    assert toxicity.expressions(pa.array(["", None, "a b"]), toxicity.hasher())[2].tolist() == [0, 1, 2, 2]


def test_toxic_documents_are_found_in_every_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.scored_toxicity(docs, labels).where("held_out").join(labels.where("toxic is not null"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    toxic = [r for r in held if r.toxic]
    assert np.mean([r.predicted for r in toxic]) >= 0.9
    assert np.mean([r.toxic for r in held if r.predicted]) >= 0.9
    for lang in {r.lang for r in toxic}:
        assert np.mean([r.predicted for r in toxic if r.lang == lang]) >= 0.8, lang


def test_word_memory_keeps_frequent_words_and_stays_right():
    coder = tokens.PieceEncoder(tokens.public_path(), slots=1 << 10)
    library, r = coder.tokenizer, np.random.default_rng(4)
    right = lambda t: np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    for at in range(0, 6000, 200):
        texts = [" ".join(["the", "of", *(f"w{at + int(x)}" for x in r.integers(0, 300, 20))]) + "\nend" for _ in range(15)]
        assert coder.encode(texts) == [right(t) for t in texts]
        assert coder.young.n_words <= coder.young.most and coder.young.slots == 1 << 10
    seen = coder.young.n_words
    assert coder.encode(["of the"]) == [right("of the")] and coder.young.n_words <= seen + 2
    many = " ".join(f"x{i}" for i in range(3000))
    assert coder.encode([many]) == [right(many)]


def test_long_words_with_equal_hashes_get_their_own_ids():
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    raw = np.frombuffer((word + other).encode(), np.uint8)
    for factor, seed in zip(tokens.FACTORS, (0, 1)):
        h = hashing.WordHasher(factor, seed)(raw, np.array([0, 2048]), np.array([2048, 4096]))
        assert h[0] == h[1]
    coder = tokens.PieceEncoder(tokens.public_path())
    for t in (word, other, "x " + word, "x " + other + " y"):
        assert coder.encode([t]) == [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]


def test_attention_gradients():
    r = np.random.default_rng(0)
    m = quality.GatedAttention(5, 4, 3)
    x, begins, y = r.normal(size=(7, 5)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = 1 / (1 + np.exp(-m._forward(x, begins)["logit"]))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = m._gradients(x, begins, y, np.ones(3))
    for k, v in m.p.items():
        at = tuple(0 for _ in v.shape)
        old = v[at]
        v[at] = old + 1e-6
        up = loss()
        v[at] = old - 1e-6
        down = loss()
        v[at] = old
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-6


# ---- neighbours


def test_neighbours(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(700, 8)).astype(np.float32)
    rows = [(i, base[i].tolist()) for i in range(700)] + [(700 + i, base[0].tolist()) for i in range(40)]
    rows += [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [None] + [1.0] * 7), (1400, [float("inf")] * 8), (1500, [1.0, 2.0]), (5, base[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = vectors.nearest(df, shard_size=300).collect()
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    queries = [i for i in good if i % 100 == 0]
    hits = 0
    for q in queries:
        exact = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        mine = sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)
        assert [x.rank for x in mine] == list(range(1, 11))
        assert all(abs(x.score - np.sqrt(((good[x.vec_id] - good[q]) ** 2).sum())) < 1e-12 for x in mine)
        assert [(x.score, x.vec_id) for x in mine] == sorted((x.score, x.vec_id) for x in mine)
        hits += len({i for _, i in exact} & {x.vec_id for x in mine})
    assert hits >= 0.97 * 10 * len(queries)
    # forty copies of vector 0: the ten smallest ids
    assert [x.vec_id for x in sorted((x for x in got if x.query_id == 0), key=lambda x: x.rank)] == list(range(700, 710))
    assert {x.query_id for x in got} == set(queries)  # 1500 has no candidate of its length
    assert vectors.nearest(df.limit(0)).count() == 0


# ---- mixing


def test_mixing(spark):
    r = np.random.default_rng(5)
    rows = [(i, " ".join("w" for _ in range(int(r.integers(0, 400)))), ["a", "b", "c", None, "Z"][min(4, i % 9)]) for i in range(240)]
    rows += [(500, None, "a"), (501, "x y\tz", "a"), (501, "x y\tz", "a"), (None, "x", None)]
    docs = documents(spark, rows)
    got = mixing.mixed_counts(docs, block_words=16).collect()
    size = lambda t: len(re.findall(WORD, t or ""))
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(i), size(t)) for i, t, _ in rows)
    own = {}
    for i, t, s in rows:
        own[s] = own.get(s, 0) + size(t)
    order = sorted((s for s in own if s is not None)) + ([None] if None in own else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(own.values()), {}, set(order)
    while True:  # fill by weight, cap, share the excess again
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * own[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * own[s] for s in over}
        open_ -= over
    by_id = {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == own[s] and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 24 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_counts(docs.repartition(5), block_words=16).collect()))
    mixed = mixing.mixed_documents(docs, block_words=16)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        words[r.source] = words.get(r.source, 0) + size(r.text)
    assert abs(words["Z"] - taken["Z"]) == 0
    assert mixing.mixed_counts(documents(spark, [])).count() == 0


def test_mixed_documents_keep_equal_rows_apart(spark):
    text = " ".join("w%d" % i for i in range(300))
    docs = documents(spark, [(1, text, "a")] * 3 + [(2, "b " * 700, "b"), (3, text, "a")])
    for options in ({}, {"block_words": 7, "seed": 3}):
        taken = {}
        for x in mixing.mixed_documents(docs, **options).collect():
            words = [int(w[1:]) for w in x.text.split()] if x.source == "a" else []
            assert words == sorted(set(words))  # no piece twice in one row
            taken[x.doc_id] = taken.get(x.doc_id, 0) + len(x.text.split())
        counts = {}
        for x in mixing.mixed_counts(docs, **options).collect():
            counts[x.doc_id] = counts.get(x.doc_id, 0) + x.taken
        assert taken == {i: n for i, n in counts.items() if n}


def test_permutations():
    for n in (1, 2, 3, 5, 64, 1000):
        image = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99))
        assert sorted(image.tolist()) == list(range(n))


# ---- tokens

TEXTS = ["", None, "a  b", " x", "x\n\ny", "it's ok, isn't it? 12,3 a1b2 x_y été 你好。 <|endoftext|> don't!'s $$$a", "tab\there", "a b c", "\n", "a\n b", "'s 'x x's. x'.", "naïve ²x ½ 😀😀, a😀 z", "the end " * 4000, "nul \0 byte"]


def test_encoder_gives_the_library_ids():
    coder = tokens.PieceEncoder(tokens.public_path(), slots=1 << 12)
    plain = lambda t: np.array(coder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    many = TEXTS + [" ".join(f"word{i}x{j}" for i in range(40)) for j in range(120)]
    for _ in range(2):
        assert coder.encode(many) == [plain(t) for t in many]


def test_token_files(spark):
    rows = [(10 - i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "no id", None), (3, "again", "s"), (3, "again", "s")]
    path = shared_folder(spark, "tokens")
    got = tokens.tokenized(documents(spark, rows).repartition(3), path).collect()
    t = tokens.PieceEncoder(tokens.public_path()).tokenizer
    ids = lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
    expected, at = [], 0
    for i, x, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        expected.append((i, at, len(ids(x)), zlib.crc32(ids(x).tobytes())))
        at += len(ids(x))
    assert sorted(map(str, ((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(str, expected))
    pruned = tokens.read_tokens(spark, path).where("doc_id = 5")
    assert pruned.select("ids").first()[0][-1] == 0 and "EqualTo(doc_id,5)" in pruned._jdf.queryExecution().executedPlan().toString()
    assert tokens.tokenized(documents(spark, []), shared_folder(spark, "tokens")).count() == 0


def test_rows_of_one_id_follow_each_other_by_text_across_shards(spark):
    rows = [(1 if i % 4 else i, f"{'same beginning of many letters, ' if i % 3 else ''}{i * 37 % 101} words " * (1 + i % 5), "a") for i in range(200)]
    path = shared_folder(spark, "tokens")
    tokens.write_tokens(documents(spark, rows).repartition(3), path, shards=8)
    files = tokens.read_tokens(spark, path)
    assert files.select("shard").distinct().count() > 3
    got = [r.start for r in sorted(tokens.token_digest(files).collect(), key=lambda r: r.start) if r.doc_id == 1]
    t = tokens.PieceEncoder(tokens.public_path()).tokenizer
    expected, at = [], 0
    for i, text, _ in sorted(rows):
        expected += [at] * (i == 1)
        at += len(t.encode(text, add_special_tokens=False).ids) + 1
    assert got == expected


# ---- WARC


def test_chunks():
    for data in (b"", b"x", b"0\r\n\r\n", bytes(range(256)) * 9):
        assert warc.unchunked(warc.chunked(data, 7)) == data
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_archive(spark):
    long = "é\r\n\r\nWARC/1.1\r\n" * 500
    rows = [(7, "http://a/", long), (3, "http://b/ c\r\nX: y", long), (9, None, long), (1, "u", None), (2, "u", ""), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", "y" * 100), (6, "u", "y" * 100), (6, "u", "z" * 100), (8, "u", "y" * 100), (None, "u", "y" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    path = shared_folder(spark, "warc")
    got = warc.archived_pages(pages, path, segment_bytes=1000, chunk_bytes=300, records_per_file=5).collect()
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    expected = []
    for i, _, t in rows:
        t = t or ""
        raw = t.encode()
        again = i is not None and len(raw) >= 100 and first[t] != i
        expected.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[t] if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    pieces = warc.read_records(spark, path)
    names = [r.id for r in pieces.where("segment is null or segment = 1").collect()]
    assert len(names) == len(set(names)) == len(rows)
    urls = [r.url for r in pieces.where("id like '<urn:page:6:%'").collect()]
    assert sorted(urls) == ["u", "u", "u"]
    referred = {r.refers for r in pieces.where("type = 'revisit'").collect() if not r.refers.startswith("<urn:page:6:")}
    assert referred and referred <= set(names)
    assert pieces.where("segment > 1 and origin is null").count() == 0 and pieces.where("segment > 3").count() > 0
    missing = warc.reassembled(pieces.where("segment is null or segment <> 2"))
    with pytest.raises(Exception, match="segments missing"):
        missing.collect()
    assert warc.archived_pages(pages.limit(0), shared_folder(spark, "warc")).count() == 0


def test_equal_rows_keep_their_urls(spark):
    body = "long page " * 400
    rows = [(1, f"http://h/{i}", body) for i in range(5)] + [(1, "http://h/0", body), (2, "http://i/", body)]
    path = shared_folder(spark, "warc")
    got = warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), path, segment_bytes=700, chunk_bytes=300)
    assert got.count() == len(rows)
    whole = warc.pages_of(warc.reassembled(warc.read_records(spark, path)))
    back = [(r.key, r.url, bytes(r.payload).decode()) for r in whole.where("record_type = 'response'").collect()]
    assert sorted(back) == sorted(rows[:-1])


def test_hot_payloads_meet_apart_from_others(spark):
    rows = [(i, "u", ("hot" if i % 3 else f"pair {i // 6} ") * 60) for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select(F.col("page_id").alias("key"), "url", F.encode("html", "UTF-8").alias("payload"))
    plain = {(r.key, r.refers_to, r.target) for r in warc.with_first_copies(pages, hot_share=1).collect()}
    assert {(r.key, r.refers_to, r.target) for r in warc.with_first_copies(pages, hot_share=3).collect()} == plain
    assert sum(r[1] == 1 for r in plain) == 59 and (0, None, True) in plain and (3, 0, False) in plain


def _foreign(kind, name, block, *more, version="1.0"):
    head = [("warc-type", kind), ("WARC-Record-ID", name), *more, ("Content-Length", str(len(block)))]
    return f"WARC/{version}\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    plain = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    framed = b"HTTP/1.1 200 OK\r\ntransfer-encoding: gzip, Chunked\r\n\r\n" + warc.chunked(bytes(range(256)) * 300, 1000)
    records = [
        _foreign("warcinfo", "<urn:uuid:0>", b"software: other\r\n"),
        _foreign("request", "<urn:uuid:1>", b"GET / HTTP/1.1\r\n\r\n", ("WARC-Target-URI", "http://a/")),
        _foreign("response", "<urn:uuid:2>", plain, ("WARC-Target-URI", "http://a/"), ("WARC-Payload-Digest", "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ")),
        _foreign("response", "<urn:uuid:3>", framed, ("WARC-Target-URI", "http://b/\r\n\tc"), version="1.1"),
        _foreign("resource", "<urn:uuid:4>", b"\r\nraw\xff", ("WARC-Target-URI", "file:x")),
        _foreign("revisit", "<urn:uuid:5>", b"", ("WARC-Target-URI", "http://a/again"), ("WARC-Refers-To", "<urn:uuid:2>")),
    ]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(warc.gzip_member, records)) + b"\0" * 9)
    (tmp_path / "one-member.gz").write_bytes(warc.gzip_member(b"".join(records)))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "empty.warc").write_bytes(b"")
    found = warc.read_records(spark, str(tmp_path))
    assert found.count() == 3 * len(records)
    assert warc.read_records(spark, str(tmp_path), "*.warc.gz").count() == len(records)
    pages = [(r.id, r.url, r.record_type, r.payload and bytes(r.payload), r.key) for r in warc.pages_of(warc.reassembled(found)).collect()]
    expected = [
        ("<urn:uuid:2>", "http://a/", "response", b"hello", None),
        ("<urn:uuid:3>", "http://b/ c", "response", bytes(range(256)) * 300, None),
        ("<urn:uuid:4>", "file:x", "resource", b"\r\nraw\xff", None),
        ("<urn:uuid:5>", "http://a/again", "revisit", None, None),
    ]
    assert sorted(pages, key=str) == sorted(expected * 3, key=str)
    whole = b"".join(map(warc.gzip_member, records))
    for step in (1, 7, 64, 1 << 14):
        assert b"".join(warc.inflated(whole, step)) == b"".join(records)
    for cut in (whole[:-4], b"".join(records)[:-9]):
        with pytest.raises(ValueError, match="cut"):
            list(warc.warc_records(cut))
    with pytest.raises(ValueError, match="not a WARC"):
        list(warc.warc_records(b"<html>\r\n\r\n"))


# ---- decontamination


def test_lcs():
    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = r.integers(0, 5, int(r.integers(0, 30))).tolist(), r.integers(0, 5, int(r.integers(0, 40))).tolist()
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert leaks.lcs_length(a, b) == t[-1][-1]


def test_leaks(spark):
    r = np.random.default_rng(4)
    common, rare = ["the", "of", "and", "to"], ["r%d" % i for i in range(4000)]
    prose = lambda n: " ".join(str(r.choice(common if r.random() < 0.4 else rare)) for _ in range(n))
    items = [(i, prose(18).capitalize() + ". " + prose(14) + ".") for i in range(12)]
    changed = items[1][1].split()
    changed[3], changed[20] = "other", "words"
    rows = [(i, prose(int(r.integers(5, 300))), "s") for i in range(80)]
    rows += [(100, prose(150) + " " + items[0][1].upper() + " " + prose(70), "s"), (101, prose(40) + "\n" + " ".join(changed), "s"), (102, items[2][1], None), (102, items[2][1], None)]
    rows += [(103, items[3][1] + " " + items[4][1], "s"), (104, None, "s"), (105, "", "s"), (106, prose(30000) + " " + items[5][1], "s"), (None, items[6][1], "s"), (107, " ".join(items[7][1].split()[:9]) + " " + prose(60), "s")]
    bench = spark.createDataFrame(items + [(50, None), (51, ""), (52, "..."), (0, items[0][1])], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {(x.doc_id, x.item_id) for x in leaks.leaks(documents(spark, rows), bench, rank=24).collect()}
    assert got == {(100, 0), (101, 1), (102, 2), (103, 3), (103, 4), (106, 5), (None, 6)}
    assert got == {(x.doc_id, x.item_id) for x in leaks.leaks(documents(spark, rows), bench, rank=24, block_items=4).collect()}
    kept = leaks.without_leaks(documents(spark, rows), bench, rank=24)
    assert kept.columns == documents(spark, []).columns
    assert sorted(x.doc_id for x in kept.collect()) == [*range(80), 104, 105, 107]
    assert leaks.leaks(documents(spark, []), bench).count() == 0
    assert leaks.leaks(documents(spark, rows), bench.limit(0)).count() == 0


def test_leaks_in_a_large_corpus(spark, monkeypatch):
    """Short and changed items in long foreign documents are found with the document frequencies of millions of documents."""
    r = np.random.default_rng(8)
    items = [(i, " ".join("w%d" % k for k in r.integers(0, 900, int(r.integers(10, 21)) if i < 12 else 40))) for i in range(24)]
    foreign = lambda n: " ".join("f%d" % k if r.random() < 0.6 else "w%d" % k for k in r.integers(0, 900, n))
    rows, expected = [(1000, foreign(300), "s")], set()
    for i, text in items:
        for share in (0.0, 0.35):
            words = text.split()
            for k in r.choice(len(words), int(share * len(words)), replace=False):
                words[k] = "x%d" % k
            expected.add((len(rows), i))
            rows.append((len(rows), foreign(int(r.integers(150, 400))) + " " + " ".join(words) + " " + foreign(150), "s"))
    counted, n = leaks._document_frequencies, 12_000_000

    def large(coded, terms):
        df, seen = counted(coded, terms)
        return df * n // seen, n

    monkeypatch.setattr(leaks, "_document_frequencies", large)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in leaks.leaks(documents(spark, rows), bench, rank=24).collect()}
    assert got == expected


def test_leaks_without_the_answer(spark):
    """Copies that lack the guessed answer: whole heads, nearly whole items and one-word answers count, weak overlaps do not."""
    prose = lambda k, n: " ".join("w%d" % i for i in range(k, k + n))
    items = [(0, prose(0, 21) + ". " + prose(21, 9)), (1, prose(100, 27) + ". w127"), (2, prose(200, 21) + ". " + prose(221, 9)), (3, prose(300, 21) + ". " + prose(321, 4))]
    foreign = " ".join("f%d" % i for i in range(60))
    changed = lambda words, at: " ".join("x%d" % i if i in at else w for i, w in enumerate(words.split()))
    cut = [
        prose(0, 21),  # the whole head, 70 %
        changed(prose(100, 27), range(2, 27, 4)),  # 71 %, without the one word of the answer
        changed(prose(200, 21), (1, 8, 15)) + " x x x x x x x x x",  # 60 % and no answer
        prose(300, 21).replace("w310", "x"),  # 80 % of the item
    ]
    rows = [(i, f"{foreign} {t} {foreign}", "s") for i, t in enumerate(cut)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in leaks.leaks(documents(spark, rows), bench, rank=24).collect()} == {(0, 0), (1, 1), (3, 3)}


# ---- URL lists


def test_url_lists(spark):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = [
        ("ads", "block", "domain:bad.example", "add", day(2)), ("ads", "block", "domain:bad.example", "remove", day(4)), ("ads", "block", "domain:bad.example", "add", day(20)),
        ("ok", "allow", "prefix:www.bad.example/news", "add", day(1)), ("x", None, "host:h.example", "add", day(3)), ("x", "block", "host:h.example", "remove", day(3)),
        ("y", "block", "host:h.example", "add", day(5)), ("a", "block", "host:h.example", "add", day(5)), (None, "block", "host:h.example", "add", day(1)), ("z", "block", None, "add", day(1)), ("z", "block", "host:q", "add", None),
    ]
    captures = [
        (1, "http://WWW.Bad.example:80/x", day(1)), (2, "http://www.bad.example/x", day(2)), (3, "http://www.bad.example/x", day(3)), (4, "http://www.bad.example/x", day(4)), (5, "http://u@www.bad.example./x?q#f", day(25)),
        (6, "http://www.bad.example/news/today", day(3)), (7, "https://h.example", day(3)), (8, "https://h.example/", day(6)), (9, None, day(6)), (10, "nonsense", day(6)), (11, "https://h.example/", None), (8, "https://h.example/", day(6)), (12, "http://notbad.example/", day(25)),
    ]
    lists = spark.createDataFrame(entries, "list string, effect string, pattern string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    pages = spark.createDataFrame(captures, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).withColumn("bucket", F.lit("clash"))
    got = {r.page_id: (r.verdict, r.list, r.n_active) for r in urls.filter_urls(pages, lists).collect()}
    none = ("none", None, 0)
    assert got == {1: none, 2: ("block", "ads", 1), 3: ("block", "ads", 1), 4: none, 5: ("block", "ads", 1), 6: ("allow", "ok", 2), 7: none, 8: ("block", "a", 2), 9: none, 10: none, 11: none, 12: none}
    assert urls.filter_urls(pages.limit(0), lists).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages, lists.limit(0)).collect()} == {"none"}


def test_hashes_do_not_depend_on_pieces():
    from tidemark.llm.hashing import PIECE, WordHasher

    raw = np.random.default_rng(4).integers(0, 256, 3 * PIECE, dtype=np.uint8)
    begin = np.array([0, 5, 9, PIECE - 3, PIECE + 2, 2 * PIECE - 1, 3 * PIECE - 4])
    end = np.array([5, 9, 9, PIECE + 2, 2 * PIECE + 9, 2 * PIECE + 9, 3 * PIECE])
    add = np.arange(len(begin)).astype(np.uint64)
    hashed = WordHasher(0x9E3779B97F4A7C15, 5)
    assert (hashed(raw, begin, end, add) == hashed.between(hashed.sums(raw), begin, end, add)).all()
    assert not len(hashed(raw, begin[:0], end[:0]))


def test_word_tables_change_places():
    from tidemark.llm.tokens import PieceEncoder, public_path

    small, texts = PieceEncoder(public_path(), slots=64), [" ".join(f"w{(i * 7 + j) % 90}" for j in range(30)) for i in range(60)]
    assert small.encode(texts, most=100) == PieceEncoder(public_path()).encode(texts) == [small._ids(t) for t in texts]
