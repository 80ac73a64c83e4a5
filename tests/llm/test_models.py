"""Token store, near-duplicates, toxicity, quality classifier, language model, pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import near_duplicates as nd
from strandlake.llm import pitman_yor as py
from strandlake.llm import quality_classifier as qc
from strandlake.llm import token_store as ts
from strandlake.llm import toxicity as tox
from strandlake.llm.common import crc_mod, shared_dir
from strandlake.llm.quality_classifier import score_quality
from strandlake.llm.toxicity import score_toxicity

from .conftest import WORDS, rows_of, text_of


def test_encoder_equals_the_library(vocabulary):
    rng = random.Random(3)
    encoder = ts.Encoder(vocabulary)
    signs = ["a", "b", " ", "  ", "\n", "\t", "1", "²", "é", "'s", "’", "!", "\x1c", " ", "　", "日本", "<|endoftext|>", "I'll", "\r\n", "\x85", "😀", "\x00"]
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))
        assert encoder.texts([t])[0] == encoder.whole(t) + encoder.end, repr(t)


def test_crcs_join():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 400, 5000):
        a, b = rng.bytes(33), rng.bytes(n)
        assert ts.crc_joined(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_token_store(spark, docs, none, clashing, corpus, vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    path = shared_dir(spark)
    ts.write_store(docs, vocabulary, path)
    got = sorted((tuple(r) for r in ts.read_store(spark, path).collect()), key=lambda r: r[1])
    ids = {(i, t): np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t, _, _ in corpus}
    order = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in order] and all(r[4] for r in got)
    starts = np.cumsum([0, *(r[2] for r in got)])
    assert [r[1] for r in got] == starts[:-1].tolist()
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((i, len(ids[i, t]) // 4, zlib.crc32(ids[i, t])) for i, t, _, _ in corpus)
    chunks = spark.read.parquet(f"{path}/chunks").where("ids is not null")
    assert chunks.count() == chunks.select("hash").distinct().count()
    # A round trip of the ids themselves.
    back = Counter((r.doc_id, np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) for r in ts.reconstruct(spark, path).collect())
    assert back == Counter((i, ids[i, t]) for i, t, _, _ in corpus)
    other = shared_dir(spark)
    ts.write_store(clashing, vocabulary, other)
    assert rows_of(ts.read_store(spark, other)) == rows_of(ts.read_store(spark, path))
    empty = shared_dir(spark)
    ts.write_store(none, vocabulary, empty)
    assert ts.read_store(spark, empty).count() == 0


def test_damaged_stores_are_not_intact(spark, docs, vocabulary):
    sound = shared_dir(spark)
    ts.write_store(docs, vocabulary, sound)
    of_107 = F.coalesce(F.col("doc_id") == 107, F.lit(False))  # many chunks

    def intact(folder, change):
        path = shared_dir(spark)
        for name in ("chunks", "recipes", "manifest", "root"):
            df = spark.read.parquet(f"{sound}/{name}")
            (change(df) if name == folder else df).write.parquet(f"{path}/{name}")
        return {(r.doc_id, r.start): r.intact for r in ts.read_store(spark, path).collect()}

    whole = intact("", None)
    assert all(whole.values()) and len(whole) == docs.count()
    in_107 = {k for k in whole if k[0] == 107}
    turned = intact("recipes", lambda df: df.withColumn("chunks", F.when(of_107, F.reverse("chunks")).otherwise(F.col("chunks"))))
    assert {k for k, v in turned.items() if not v} == in_107 and len(turned) == len(whole)
    part = spark.read.parquet(f"{sound}/recipes").where(of_107).first().part
    others = {r.doc_id for r in spark.read.parquet(f"{sound}/recipes").where(F.col("part") == part).collect()}
    lost = intact("recipes", lambda df: df.where(~of_107))
    assert len(lost) == len(whole) - 1 and {k[0] for k, v in lost.items() if not v} == others - {107}
    renamed = intact("recipes", lambda df: df.withColumn("doc_id", F.when(of_107, F.lit(99_999)).otherwise(F.col("doc_id"))))
    assert not renamed[99_999, next(iter(in_107))[1]]
    gone = intact("recipes", lambda df: df.where(F.col("part") != part))
    assert not any(gone.values())
    assert not any(intact("manifest", lambda df: df.withColumn("root", F.sha2("root", 256))).values())
    assert not any(intact("root", lambda df: df.withColumn("root", F.sha2("root", 256))).values())
    hashes = spark.read.parquet(f"{sound}/recipes").where(of_107).select(F.explode("chunks")).limit(1)
    first = intact("chunks", lambda df: df.join(F.broadcast(hashes), df["hash"] == F.col("col"), "left_anti"))
    assert len(first) == len(whole) and not any(first[k] for k in in_107)


def test_equal_stretches_give_equal_chunks():
    rng = np.random.default_rng(4)
    shared, a, b = rng.integers(1, 50000, 6000), rng.integers(1, 50000, 700), rng.integers(1, 50000, 333)
    streams = [np.concatenate([a, shared]), np.concatenate([b, shared])]
    starts = np.cumsum([0, *map(len, streams)])
    ids = np.concatenate(streams)
    ends = ts.cut_places(ids, starts)
    parts = [[ids[i:j].tobytes() for i, j in zip([lo, *ends], [*ends, hi], strict=False) if lo <= i < j <= hi] for lo, hi, ends in ((starts[k], starts[k + 1], [e for e in ends if starts[k] < e <= starts[k + 1]]) for k in (0, 1))]
    assert len(set(parts[0]) & set(parts[1])) >= 0.7 * len(parts[0]) and np.diff(ends, prepend=0).max() <= ts.MAX_CHUNK


def units(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    seen, out = Counter(), set()
    for g in grams:
        out.add((g, seen[g]))
        seen[g] += 1
    return out


def brute_classes(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    own = [(i, units(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            if a and b and len(a & b) * 5 >= len(a | b) * 4:
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def edited(rng, text, share):
    w = text.split(" ")
    for _ in range(max(1, int(share * len(w)))):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
    return " ".join(w)


def test_near_duplicates(spark, docs, none, clashing, corpus):
    rng = random.Random(8)
    rows = [(i, t) for i, t, _, _ in corpus]
    for k in range(25):
        base = text_of(rng, rng.randint(60, 160))
        rows.append((1000 + 100 * k, base))
        # Copies of copies, some close and some just beyond the bound.
        for j in range(1, 8):
            base = edited(rng, rows[-1][1] if rng.random() < 0.5 else base, rng.choice([0.005, 0.01, 0.02, 0.05]))
            rows.append((1000 + 100 * k + j, base))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(frame).where("doc_id is not null").collect()}
    want = brute_classes(rows)
    assert len({v for v in want.values()}) < len(want) - 60
    assert got == want
    null = nd.near_duplicates(frame).where("doc_id is null").first()
    assert null.class_id == 9  # it copies document 9
    assert rows_of(nd.near_duplicates(clashing)) == rows_of(nd.near_duplicates(docs))
    assert nd.near_duplicates(none).count() == 0


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Hundreds of copies of one text, few of which are close to each other: several rounds of pivots, and no link lost."""
    monkeypatch.setattr(nd, "PIVOTS", (1, 4, 16))
    rng = random.Random(11)
    base = text_of(rng, 150)
    rows = [(i, edited(rng, base, rng.choice([0.005, 0.02, 0.03, 0.04]))) for i in range(110)]
    for i in range(110, 130):
        rows.append((i, edited(rng, rows[rng.randrange(len(rows))][1], 0.01)))
    want = brute_classes(rows)
    assert 15 < len(set(want.values())) < 100
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()} == want


def test_few_members_outside_the_largest_class_are_pivots_at_once(spark):
    """Else their bucket, with all of its largest class, would be joined in a further round."""
    rows = [(1, node, 7, 10, [0], node % 5 + 1) for node in range(20)]  # one large class
    rows += [(1, 100 + i, 100 + i, 10, [0], 1) for i in range(8)]
    rows += [(2, node, 7, 10, [0], 1) for node in range(20)] + [(2, 100 + i, 100 + i, 10, [0], i + 1) for i in range(30)] + [(3, 200 + i, 7, 10, [0], 1) for i in range(4)]
    met = spark.createDataFrame(rows, "band long, node long, class long, n long, bits array<long>, degree long").repartition(3)
    got = {r.band: [p.node for p in r.pivots] for r in nd.pivots_of(met, 1).collect()}
    assert sorted(got.pop(1)) == list(range(100, 108))
    assert got == {2: list(range(129, 121, -1))}
    first = {r.band: len(r.pivots) for r in nd.pivots_of(met, 0).collect()}
    many = spark.createDataFrame([(1, i, i, 10, [0], 1) for i in range(5000)], met.schema)
    assert first == {1: 1, 2: 1} and [len(nd.pivots_of(many, t).first().pivots) for t in range(4)] == list(nd.PIVOTS)


def test_bitmaps_never_differ_in_more_bits_than_the_units():
    rng = np.random.default_rng(5)
    for n, shared in ((10, 3), (150, 120), (3000, 2900), (9000, 100)):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, n - shared, dtype=np.uint64)])
        x, y = nd.bitmap(a), nd.bitmap(b)
        assert len(x) == len(y) <= nd.MAX_BITMAP
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= 2 * (n - shared)


def test_dart_minima_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    m = nd.dart_minima(np.concatenate([a, b]), np.array([0, 400, 800, 800]), 2000)
    assert np.isfinite(m[:2]).all() and np.isinf(m[2]).all()
    assert abs((m[0] == m[1]).mean() - 300 / 500) < 0.05


def labelled(spark, rng, n=300):
    rows = []
    for i in range(n):
        toxic, good = i % 3 == 0, i % 4 != 1
        words = [rng.choice(WORDS) for _ in range(rng.randint(30, 90))]
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vile", "viler", "vilest", "vileness", "grubby", "grubbier"])
        if not good:
            words = [w + rng.choice(["&&&", "###"]) for w in words]
        rows.append((i, " ".join(words), int(toxic), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, good int").repartition(3)


@pytest.mark.parametrize(("score", "label"), [(score_toxicity, "toxic"), (score_quality, "good")])
def test_classifiers_on_held_out_documents(spark, docs, none, score, label):
    frame = labelled(spark, random.Random(6))
    held = crc_mod(F.col("doc_id"), 4) == 2
    labels = frame.where(~held).select("doc_id", F.col(label).alias("label"))
    got = score(frame.select("doc_id", "text", *[F.lit("x").alias(c) for c in ("score", "label", "x", "term", "n", "aside")]), labels)
    met = got.join(frame.select("doc_id", label), "doc_id").where(held).collect()
    assert np.mean([(r.score >= 0.5) == (r[label] == 1) for r in met]) >= 0.93
    assert rows_of(score(frame, labels)) == rows_of(score(frame.coalesce(1), labels))
    odd = score(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert score(none, labels).count() == 0
    assert len({round(r.score, 9) for r in score(docs, labels.where("label = 1")).collect()}) == 1
    assert {r.score for r in score(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_keeps_pairs_that_stand_once(spark):
    assert tox.SAMPLE >= 4000
    rows = [(1, 1, "a b a c"), (2, 0, "a b b d"), (3, 1, "a b"), (4, 0, "e b d"), (5, 1, None)]
    words, pairs = tox.counted(spark.createDataFrame(rows, "doc_id long, label int, text string").repartition(2))
    got = tox.columns(pairs)
    model = tox.Model(tox.columns(words), got)
    # -a, -e, ab, ba, ac, bb, bd, eb
    assert sorted(zip(got["toxic"].tolist(), got["plain"].tolist(), strict=True)) == sorted([(2, 1), (0, 1), (2, 1), (1, 0), (1, 0), (0, 1), (0, 2), (0, 1)])
    level = model.levels[-1]
    assert len(level.keys) == 8
    for c, name in enumerate(("toxic", "plain")):
        for context in set(got["before"].tolist()):
            mine = got["before"] == context
            keys = tox.found_at(level.keys, tox.pair_keys(got["before"][mine], got["word"][mine]))
            held, back = level.held[c][keys].sum(), level.back[c][tox.found_at(level.contexts, np.array([context], np.uint64))[0]]
            assert held + back == pytest.approx(1, abs=1e-6)
            assert (level.held[c][keys] > 0).tolist() == (got[name][mine] > 0).tolist()


def index_vector(word):
    """Of a word's hash: NONZERO signs at drawn places."""
    h, out = int(qc.mixed(np.array([word], np.uint64))[0]), [0] * qc.DIMENSIONS
    for i in range(qc.NONZERO):
        part = h >> (12 * i)
        out[part % qc.DIMENSIONS] += 1 if part >> 10 & 1 else -1
    return np.array(out)


@pytest.mark.parametrize("most", [0, 300, 1 << 17])
def test_document_vectors_equal_brute_force(spark, most):
    """Terms of the vocabulary by all their occurrences, others by those in the document; none shares a vector."""
    rng = random.Random(2)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}x{rng.choice('abc')}" for _ in range(rng.choice([1, 3, 120]))) for _ in range(120)] + ["", None, "one", "one"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    known = qc.vocabulary_of(frame, most)
    everywhere, counts = {}, Counter()
    each = []
    for t in texts:
        words, *kinds, _ = qc.terms([t])
        vectors = [index_vector(w) for w in words.tolist()]
        near = [sum((vectors[j] for j in range(max(i - qc.SPAN, 0), min(i + qc.SPAN + 1, len(words))) if j != i), np.zeros(qc.DIMENSIONS, int)) for i in range(len(words))]
        each.append((kinds, near))
        for kind in kinds:
            counts.update(kind.tolist())
            for term, x in zip(kind.tolist(), near, strict=True):
                everywhere[term] = everywhere.get(term, 0) + x
    sizes = sorted(set(counts.values()), reverse=True)
    least = min((n for n in sizes if n >= 2 and sum(c >= n for c in counts.values()) <= most), default=None)
    assert sorted(t for t, c in counts.items() if least and c >= least) == known.tolist() and (len(known) > 100) == (most > 0)
    vectors = qc.context_vectors(frame, known)
    assert all(np.array_equal(v, everywhere[t]) for t, v in zip(known.tolist(), vectors, strict=True))
    got = qc.Pooling(known, vectors)(texts)
    for (kinds, near), x in zip(each, got, strict=True):
        want = []
        for kind in kinds:
            own = {}
            for term, v in zip(kind.tolist(), near, strict=True):
                own[term] = own.get(term, 0) + v
            units = [y / max(np.linalg.norm(y), 1e-6) for term in kind.tolist() for y in [everywhere[term] if term in set(known.tolist()) else own[term]]]
            want += list(np.mean(units, axis=0)) if units else [0.0] * qc.DIMENSIONS
        assert x.tolist() == pytest.approx([*want, np.log1p(len(near))], abs=1e-5)


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]


def test_language_model(spark, docs, none, clashing, corpus, monkeypatch):
    monkeypatch.setattr(py, "HEAD", 40)  # so that some words are not frequent
    held = crc_mod(F.col("doc_id"), 7) == 2
    got = py.score_documents(docs, docs.where(~held)).collect()
    counts = Counter(w for i, t, _, _ in corpus if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t, _, _ in corpus for w in [tokens(t)]), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert sum(r.score for r in got) > 1.01 * sum(r.base_score for r in got)  # words without order: no better than counts
    assert rows_of(py.score_documents(clashing, docs.where(~held)).select("doc_id", F.round("score", 6))) == rows_of(py.score_documents(docs, docs.where(~held)).select("doc_id", F.round("score", 6)))
    assert py.score_documents(none, docs).count() == 0
    base = py.score_documents(docs, none)
    assert base.where("n_known > 0 or abs(score) > 1e-6").count() == 0  # one unknown word is all there is


def test_scores_do_not_depend_on_the_partitioning(spark, docs, monkeypatch):
    monkeypatch.setattr(py, "HEAD", 40)
    by = lambda df: {(r.doc_id, r.n_tokens): (r.n_known, round(r.score, 6)) for r in df.collect()}
    want = by(py.score_documents(docs.coalesce(1), docs.coalesce(1)))
    monkeypatch.setattr(py, "GATHER", 500)
    assert by(py.score_documents(docs.repartition(5, F.rand(1)), docs.repartition(7, F.rand(2)))) == want


def test_seating_in_blocks_is_close_to_one_by_one(monkeypatch):
    customers, keys = np.full(3000, 2000.0), np.arange(3000, dtype=np.uint64)
    for new in (0.05, 1.0, 20.0):
        mass, means = np.full(3000, new), []
        for exact in (64, 4000):
            monkeypatch.setattr(py, "EXACT", exact)
            means.append((py.seated(customers, mass, 0.75, keys).mean(), py.seated(customers, mass, 0.75, keys).std()))
        assert means[0][0] == pytest.approx(means[1][0], rel=0.03) and means[0][1] == pytest.approx(means[1][1], rel=0.15)


def test_language_model_is_a_distribution(spark):
    rows = [(i, " ".join(random.Random(i).choices(WORDS[:30], k=40))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    head, top, order = py.frequent_words(frame)
    table = py.written(py.counted(frame, top, order))
    states, sizes = py.gibbs(table)
    words = py.probabilities(table, head, states, sizes).collect()
    back = py.backs(states, sizes)
    unknown = np.array([py.parent_share(np.zeros(1), np.zeros(1), s, 1 / (sizes.words + 1))[0] for s in states[-py.KEPT :]])
    total = (unknown[:, None] * back).mean(0)
    for r in words:
        p = (np.array(r.roots)[:, None] * back).mean(0)
        p[r.us] = r.ps
        total += p
    assert total[: len(top) + 1] == pytest.approx(np.ones(len(top) + 1), abs=1e-6)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(9)
    rows = [(i, text_of(rng, rng.randint(40, 120)), "en", f"s{i % 3}", "own") for i in range(120)]
    rows += [(200 + i, edited(rng, rows[i][1], 0.005), "en", "s0", "own") for i in range(10)]
    item = " ".join(rng.choice(WORDS) + "q" for _ in range(30))
    rows += [(300, rows[50][1] + " " + item, "en", "s1", "own"), (301, None, "en", "s1", "own"), (302, "", None, None, "own"), (303, rows[60][1], "en", "s2", "own"), (303, rows[60][1], "en", "s2", "own")]
    rows += [(400 + i, " ".join(rng.choice(WORDS) + "&&&" for _ in range(50)), "en", "s0", "own") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, contaminated string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i in [*range(100), *range(400, 420)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = shared_dir(spark)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "tokenize":
            assert docs.columns == ["doc_id", "text", "lang", "source", "contaminated"]
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert not ids["quality"] & set(range(400, 430)) and set(range(120)) <= ids["quality"]
    classes = brute_classes([(r.doc_id, r.text) for r in seen["quality"].collect()])
    assert ids["deduplicate"] == {i for i, c in classes.items() if i == c}
    assert seen["deduplicate"].count() == len(ids["deduplicate"])
    assert ids["deduplicate"] - ids["decontaminate"] == ({300} & ids["deduplicate"])
    words = lambda df: df.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert 1.2 < words(seen["mix"]) / words(seen["decontaminate"]) < 1.8
    assert seen["tokenize"].count() == seen["mix"].count() and seen["tokenize"].where("not intact").count() == 0
    assert cp.run(spark, str(tmp_path)).count() == seen["tokenize"].count()


def test_quality_stage_keeps_what_the_classifier_predicts(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp
    from strandlake.llm import queries as q

    def scored(docs, labels, carry=None, name="score", **_):
        return docs.select(*(carry or ["doc_id"]), (F.col("doc_id") / 100).alias(name))

    monkeypatch.setattr(cp, "score_quality", scored)
    monkeypatch.setattr(q, "score_quality", scored)
    spark.range(101).selectExpr("id as doc_id", "'x' as text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = cp.quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).select("doc_id")
    predicted = q.op7_quality_classifier(spark, str(tmp_path)).where("predicted = 1").select("doc_id")
    assert rows_of(kept) == rows_of(predicted) and kept.count() == 31


def test_stages_handle_odd_rows(spark, docs, none, corpus, tmp_path):
    """Null ids and sources, repeated ids with other texts, empty tables, and columns with the stages' own names."""
    import corpus_pipeline as cp

    names = ["_size", "_times", "_copy", "_doc", "_id", "_row", "size", "target", "class_id", "count", "node"]
    odd = docs.unionByName(spark.createDataFrame([(5, "another text of document five", "en", "src1"), (None, "one text", None, None), (None, "one text", None, None)], docs.schema)).select("*", *[F.lit("own").alias(n) for n in names])
    kept = cp.deduplicate(spark, odd, "")
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 1
    assert rows_of(cp.deduplicate(spark, odd.repartition(5, F.rand(3)), "")) == rows_of(kept)
    assert kept.where("doc_id is null").count() == odd.where("doc_id is null").count()
    mixed = cp.mix(spark, odd, "")
    assert mixed.columns == odd.columns and mixed.where("_size <> 'own' or _copy <> 'own'").count() == 0
    n_words = F.size(F.filter(F.split("text", r"[ \t\n\x0b\x0c\r]+"), lambda x: x != ""))
    by = lambda df: {r[0]: r[1] for r in df.where("text is not null").groupBy("source").agg(F.sum(n_words)).collect()}
    given = {r.source: r.target for r in cp.mix_sources(odd).select("source", "target").distinct().collect()}
    longest = max(len((t or "").split()) for _, t, _, _ in corpus)
    for source, words in by(mixed).items():  # whole copies: a source may miss its target by a part of a document at each end of a quota
        assert abs(words - given[source]) <= max(0.1 * given[source], longest)
    for stage in (cp.deduplicate, cp.mix):
        assert stage(spark, none, "").count() == 0 and stage(spark, none, "").columns == none.columns


def test_language_model_equals_brute_force(spark, docs, corpus, monkeypatch):
    """Counts, contexts, totals, sweeps and averages by dictionaries, for one word and context at a time."""
    monkeypatch.setattr(py, "HEAD", 40)
    held = [i is not None and i % 7 == 2 for i, *_ in corpus]
    texts = [(i, py.tokens([t])[0].tolist()) for i, t, _, _ in corpus]
    training = [w for (_, w), h in zip(texts, held, strict=True) if not h]
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    counts = Counter(x for w in training for x in w)
    top = [w for w in sorted(counts, key=lambda w: (-counts[w], signed(w))) if w != int(py.END) and counts[w] > counts.total() // (2 * py.HEAD)][: py.CONTEXTS - 1]
    rank = {w: k + 1 for k, w in enumerate(top)}

    def placed(words):
        u = 0
        for w in words:
            yield w, u
            u = rank.get(w, u)

    c = Counter(x for w in training for x in placed(w))
    size = Counter()
    for (_, u), n in c.items():
        size[u] += n
    base = 1 / (len(counts) + 1)
    seat = lambda n, new, d, key: float(py.seated(np.array([float(n)]), np.array([new]), d, np.array([key], np.uint64))[0])
    key = lambda w, u, i: int(py.mixed(np.array([w], np.uint64) + py.mixed(np.array([u], np.uint64) + np.uint64(1 + 1000 * i)))[0])
    parent = lambda w: int(py.mixed(np.array([w[0]], np.uint64) + np.uint64(77 + w[1]))[0])
    tables, n_of, m_of = Counter(u for _, u in c), Counter(w for w, _ in c), dict.fromkeys(counts, 1)
    customers, of_parent, kept = float(len(c)), float(len(counts)), []
    share = lambda n, m: (max(n - py.D0 * m, 0) + (py.S0 + py.D0 * of_parent) * base) / (py.S0 + customers)
    for i in range(py.SWEEPS):
        t = {(w, u): seat(n, (py.S1 + py.D1 * tables[u]) * share(n_of[w], m_of[w]), py.D1, key(w, u, i)) for (w, u), n in c.items()}
        n_of = Counter()
        for (w, _), x in t.items():
            n_of[w] += x
        m_of = {w: seat(n_of[w], (py.S0 + py.D0 * of_parent) * base, py.D0, parent((w, i))) for w in counts}
        tables = Counter()
        for (_, u), x in t.items():
            tables[u] += x
        customers, of_parent = sum(n_of.values()), sum(m_of.values())
        if i >= py.SWEEPS - py.KEPT:
            roots = {w: share(n_of[w], m_of[w]) for w in counts} | {None: share(0, 0)}
            kept.append((t, roots, {u: (py.S1 + py.D1 * tables[u]) / (py.S1 + size[u]) for u in range(py.CONTEXTS)}))

    def p(w, u):
        return np.mean([max(c[w, u] - py.D1 * t.get((w, u), 0), 0) / (py.S1 + size[u]) + back[u] * roots.get(w, roots[None]) for t, roots, back in kept])

    want = sorted((repr(i), round(sum(math.log10(p(w, u)) for w, u in placed(words)), 4)) for i, words in texts)
    got = py.score_documents(docs, docs.where("doc_id is null or doc_id % 7 <> 2")).collect()
    for (i, x), (j, y) in zip(sorted((repr(r.doc_id), round(r.score, 4)) for r in got), want, strict=True):
        assert i == j and x == pytest.approx(y, rel=1e-5, abs=2e-3)


def test_toxicity_ratios_equal_brute_force(spark):
    rng = random.Random(12)
    texts = [(k, k % 3 == 0, " ".join(rng.choice(["vile", "viler", "vileness", "grub", *WORDS[:25]] if k % 3 == 0 else WORDS[:40]) for _ in range(rng.randint(1, 30)))) for k in range(40)]
    words, pairs = tox.counted(spark.createDataFrame([(i, int(y), t) for i, y, t in texts], "doc_id long, label int, text string").repartition(3))
    model = tox.Model(tox.columns(words), tox.columns(pairs))
    before = Counter((a, b, y) for _, y, t in texts for w in [t.split()] for a, b in zip([None, *w], w))
    kinds = Counter(b for a, b in {(a, b) for a, b, _ in before})
    parts = lambda w: ["", *(w.encode()[:n] for n in tox.PREFIXES), w]

    def level(own_of, context_of, y, lower):
        """p of discounted counts of class y that backs off to lower(own, context)."""
        c, total = Counter(), Counter()
        for (a, b, z), n in before.items():
            if z == y:
                c[own_of(a, b)] += n
                total[context_of(a, b)] += n
        ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        # Keys that only the other class holds count nothing, so they change neither.
        d = max(ones / (ones + 2 * twos), 0.3) if ones else 0.5
        rest = Counter()
        for (context, _), n in c.items():
            rest[context] += min(n, d)
        return lambda a, b: max(c[own_of(a, b)] - d, 0) / max(total[context_of(a, b)], 1) + (rest[context_of(a, b)] / total[context_of(a, b)] if total[context_of(a, b)] else 1) * lower(a, b)

    def ratio(a, b):
        out = []
        for y in (True, False):
            product = 1.0
            for k in range(len(tox.PREFIXES) + 1):
                own, context = (lambda a, b, k=k: (parts(b)[k], parts(b)[k + 1])), (lambda a, b, k=k: parts(b)[k])
                same, under = sum(n for w, n in kinds.items() if own(None, w) == own(a, b)), sum(n for w, n in kinds.items() if context(None, w) == context(a, b))
                product *= level(own, context, y, lambda a, b: same / max(under, 1) + tox.UNSEEN)(a, b)  # noqa: B023
            out.append(level(lambda a, b: (a, b), lambda a, b: a, y, lambda a, b: product)(a, b))  # noqa: B023
        return math.log(out[0]) - math.log(out[1])

    for text in ("the vile grub", "vilest be on grubby", "zzz the"):
        parts_of = tox.word_hashes(*tox.text_bytes([text]), prefixes=tox.PREFIXES)
        w = text.split()
        assert model.ratios(parts_of).tolist() == pytest.approx([ratio(a, b) for a, b in zip([None, *w], w)], abs=1e-4)


def test_memories_are_bounded():
    from strandlake.llm.common import Memory

    seen = []
    memory = Memory(lambda k: seen.append(k) or len(k), 3, longest=4)
    for k in ["a", "bb", "ccc", "a", "dddd", "eeeee", "eeeee", "a", "bb", "f", "g", "h", "i"]:
        assert memory[k] == len(k) and len(memory) <= 3 and len(memory.elder) <= 3
    assert seen == ["a", "bb", "ccc", "dddd", "eeeee", "eeeee", "f", "g", "h", "i"]


def test_every_operator_is_registered():
    from strandlake.llm.queries import queries

    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries()) == list(range(1, 11))


def test_queries_return_their_contracts(spark, tmp_path):
    from strandlake.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    want = {
        2: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        3: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        5: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        10: ["doc_id", "size", "source_size", "target", "taken"],
    }
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, f in queries().items():
        k = int(re.match(r"op(\d+)_", name)[1])
        if k in want:
            df = f(spark, sf)
            assert set(want[k]) <= set(df.columns) and df.count() == n


def test_every_preceding_word_has_a_restaurant(spark, tmp_path, monkeypatch):
    """op8 against dictionaries, on texts with more preceding words than the bounded form has contexts."""
    from strandlake.llm.queries import op8_pitman_yor

    monkeypatch.setattr(py, "HEAD_PAIRS", 40)  # so that some pairs are not frequent
    rng, follows = random.Random(4), {f"a{i}": f"b{i * 7 % 150}" for i in range(150)}
    rows = [(i, " ".join(x for a in rng.choices(list(follows), k=60) for x in (a, follows[a] if rng.random() < 0.9 else rng.choice(WORDS)))) for i in range(40)]
    rows += [(40, None), (41, "never seen a1 b7"), (41, "never seen a1 b7"), (None, rows[0][1]), (9, "a1 b7 of a1 b7")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    texts = [(i, py.tokens([t])[0].tolist()) for i, t in rows]
    placed = lambda words: zip(words, [int(py.START), *words], strict=False)
    c = Counter(x for i, words in texts if not held(i) for x in placed(words))
    counts, size = Counter(), Counter()
    for (w, u), n in c.items():
        counts[w] += n
        size[u] += n
    assert len(size) > py.CONTEXTS and any(held(i) and x not in c for i, words in texts for x in placed(words))
    base = 1 / (len(counts) + 1)
    seat = lambda n, new, d, key: float(py.seated(np.array([float(n)]), np.array([new]), d, np.array([key], np.uint64))[0])
    key = lambda w, u, i: int(py.mixed(np.array([w], np.uint64) + py.mixed(np.array([u], np.uint64) + np.uint64(1 + 1000 * i)))[0])
    parent = lambda w, i: int(py.mixed(np.array([w], np.uint64) + np.uint64(77 + i))[0])
    tables, n_of, m_of = Counter(u for _, u in c), Counter(w for w, _ in c), dict.fromkeys(counts, 1)
    customers, of_parent, kept = float(len(c)), float(len(counts)), []
    share = lambda n, m: (max(n - py.D0 * m, 0) + (py.S0 + py.D0 * of_parent) * base) / (py.S0 + customers)
    for i in range(py.SWEEPS):
        t = {(w, u): seat(n, (py.S1 + py.D1 * tables[u]) * share(n_of[w], m_of[w]), py.D1, key(w, u, i)) for (w, u), n in c.items()}
        n_of, tables = Counter(), Counter()
        for (w, u), x in t.items():
            n_of[w] += x
            tables[u] += x
        m_of = {w: seat(n_of[w], (py.S0 + py.D0 * of_parent) * base, py.D0, parent(w, i)) for w in counts}
        customers, of_parent = sum(n_of.values()), sum(m_of.values())
        if i >= py.SWEEPS - py.KEPT:
            kept.append((t, {w: share(n_of[w], m_of[w]) for w in counts} | {None: share(0, 0)}, {u: (py.S1 + py.D1 * tables[u]) / (py.S1 + size[u]) for u in size}))

    def p(w, u):
        return np.mean([max(c[w, u] - py.D1 * t.get((w, u), 0), 0) / (py.S1 + size[u]) + back.get(u, 1.0) * roots.get(w, roots[None]) for t, roots, back in kept])

    for u in list(size)[:5]:  # a distribution over the words and the unknown one
        assert sum(p(w, u) for w in [*counts, None]) == pytest.approx(1, abs=1e-9)
    n = sum(counts.values())
    want = sorted((repr(i), len(words), sum(counts[w] > 0 for w in words), sum(math.log10((counts[w] + 1) / (n + len(counts) + 1)) for w in words), sum(math.log10(p(w, u)) for w, u in placed(words))) for i, words in texts)
    got = sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in op8_pitman_yor(spark, str(tmp_path)).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    for x, y in zip(got, want, strict=True):
        assert x[3:] == pytest.approx(y[3:], rel=1e-9, abs=1e-9)


def test_quality_holds_little_in_a_reused_worker(vocabulary):
    """What the token store and long texts left in a worker is dropped, and texts are looked at in small pieces."""
    import tracemalloc

    import pyarrow as pa

    from strandlake.llm import common
    from strandlake.llm.decontaminate import powers

    ts.Encoder.at(vocabulary).texts(["some words"])
    powers(np.uint64(3), 1 << 21)
    assert common.KEPT.keys() >= {"token_store", "powers"} and ts.Encoder._of
    rng = random.Random(6)
    texts = [None, "", *(text_of(rng, 400) for _ in range(600))]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    parts = list(qc.pieces(iter([batch])))
    assert not common.KEPT and not ts.Encoder._of and not powers.__defaults__[0]
    assert [i for part, _ in parts for i in part.column("doc_id").to_pylist()] == list(range(len(texts))) and [t for _, x in parts for t in x] == texts
    pooling = qc.Pooling(np.unique(qc.terms(texts)[0]), np.ones((len(np.unique(qc.terms(texts)[0])), qc.DIMENSIONS), np.int64))
    tracemalloc.start()
    got = np.vstack([pooling(x) for _, x in parts])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000 and np.allclose(got, pooling(texts))


def test_a_word_is_encoded_once(vocabulary, monkeypatch):
    """Whatever marks, blanks and lines stand around it."""
    seen, tokenized = Counter(), ts.Encoder.tokenized
    monkeypatch.setattr(ts.Encoder, "tokenized", lambda self, piece: seen.update([piece]) or tokenized(self, piece))
    encoder = ts.Encoder(vocabulary)
    texts = ["so Zyxword, Zyxword. Zyxword! one\nline Zyxword's", "a  run of Zyxword blanks", "Zyxword Zyxword; the Zyxword"]
    assert [encoder.text(t) for t in texts] == [encoder.whole(t) for t in texts]
    assert seen[" Zyxword"] == 1 and max(seen.values()) == 1


def test_a_word_is_kept_once(vocabulary):
    """One entry for a word with and without marks or a line's end, and the library's ids wherever the texts are cut for that."""
    encoder, text = ts.Encoder(vocabulary), "so Zyxword, Zyxword. Zyxword!! Zyxword\nor Zyxword's Zyxword.\nZyxword"
    assert encoder.text(text) == encoder.whole(text)
    assert [k for k in encoder.met if k.startswith("Zyxword")] == ["Zyxword"]
    rng = random.Random(8)
    signs = ["a", "Z", "日本", "é", "e\u0301", "ª", "1", "²", "Ⅷ", ",", ".", "!", "_", "'", "n't", "’", " ", " ", "\n", "\n", "\n\n", "\r\n", "\xa0", "\x1c", ts.CUT]
    for _ in range(5000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        assert encoder.text(t) == encoder.whole(t), repr(t)


def test_the_driver_gives_back_what_it_freed(spark, docs, vocabulary, monkeypatch):
    from strandlake.llm import common

    assert common.relieve_driver(spark) in (True, False)
    monkeypatch.setattr(ts.Encoder, "_of", {})
    ts.write_store(docs, vocabulary, shared_dir(spark))
    assert not ts.Encoder._of and ts.Encoder.width(vocabulary) == ts.Encoder(vocabulary).dtype.itemsize
    turns, calls, pivots_of = [], [], nd.pivots_of
    monkeypatch.setattr(nd, "pivots_of", lambda met, turn: turns.append(turn) or pivots_of(met, turn))
    monkeypatch.setattr(nd, "relieve_driver", lambda session: calls.append(common.relieve_driver(session)))
    nd.near_duplicates(docs).count()
    assert len(calls) == len(turns) - 1 > 0  # the last round finds no pivots


def test_sweeps_keep_one_state_on_disk(spark, docs, tmp_path, monkeypatch):
    from strandlake.llm import common

    made = []
    monkeypatch.setattr(common, "shared_dir", lambda session: made.append(f"file://{tmp_path}/{len(made)}") or made[-1])
    model = py.histories(docs)
    assert len(made) == 4 + 3 * py.SWEEPS
    # The pairs with their probabilities, the contexts and the words.
    assert len(list(tmp_path.iterdir())) == 3
    assert model.pairs.count() and model.contexts.count() and model.words.count()


def test_pairs_move_in_few_bytes(spark, tmp_path, monkeypatch):
    """op8's messages give what the joins give, with several gathers a task and pairs in many texts, and hold less than 16 bytes for each pair and text."""
    from strandlake.llm import common
    from strandlake.llm import restaurants as rs

    monkeypatch.setattr(rs, "GATHER", 20_000)
    monkeypatch.setattr(rs, "HOT", 8)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(WORDS[:12]) if rng.random() < 0.3 else f"w{int(2 ** (rng.random() * 14))}" for _ in range(300))) for i in range(300)] + [(7, None), (None, "only here"), (8, rng.choice(WORDS))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    learnt = F.coalesce(F.col("doc_id"), F.lit(0)) % 7 != 2
    want = py.score_by_histories(docs, docs.where(learnt)).collect()
    monkeypatch.setattr(rs, "shared_dir", lambda session: f"file://{tmp_path}/texts")
    scored = rs.score_marked(docs.select("doc_id", "text", F.lit(True).alias("scored"), learnt.alias("learnt")))
    key = lambda r: (repr(r.doc_id), r.n_tokens, round(r.score, 6))
    for x, y in zip(sorted(scored.collect(), key=key), sorted(want, key=key), strict=True):
        assert x[:4] == y[:4] and x[4:] == pytest.approx(y[4:], rel=1e-9)
    kept = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert 0 < kept < 16 * len({(i, *p) for i, t in rows for w in [(t or "").split()] for p in zip(["", *w], [*w, ""], strict=True)})
    none = docs.limit(0).select("doc_id", "text", F.lit(True).alias("scored"), F.lit(True).alias("learnt"))
    monkeypatch.setattr(rs, "shared_dir", common.shared_dir)
    assert rs.score_marked(none).count() == 0
    untaught = rs.score_marked(docs.select("doc_id", "text", F.lit(True).alias("scored"), F.lit(False).alias("learnt"))).agg(F.sum("n_known"), F.max(F.abs("score"))).first()
    assert tuple(untaught) == (0, pytest.approx(0, abs=1e-9))


def test_more_shuffle_partitions_make_no_more_messages(spark, monkeypatch):
    from strandlake.llm import restaurants as rs

    rows = [(i, f"the word {i % 7} and the word {i % 5} once more") for i in range(300)]
    made, own = [], rs.delivered
    monkeypatch.setattr(rs, "delivered", lambda df, n, work: made.append(n) or own(df, n, work))
    before, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 61):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
            scored = rs.score_marked(docs.select("doc_id", "text", F.lit(True).alias("scored"), F.lit(True).alias("learnt")))
            out.append(sorted((r.doc_id, r.n_tokens, r.n_known, round(r.score, 9)) for r in scored.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1] and len(out[0]) == 300
    assert set(made) == {2 * spark.sparkContext.defaultParallelism}
    assert rs.buckets(100 * rs.BUCKET_BYTES + 1, 4) == 101
