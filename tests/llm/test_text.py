"""Tokens, mixing, quality, toxicity, personal data and the pipeline."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyloom.llm import bpe, line_dedup, minhash, mixing, pii, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """rows: (doc_id, text, source)"""
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


# --- byte-level BPE ---------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.Coder(tokens, public_tokenizers.PATTERN, *bpe.PerfectHash.arrays(tokens))


@pytest.fixture(scope="module")
def encoding(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_perfect_hash_is_minimal(coder):
    assert sorted(coder.hash.slots) == list(range(len(coder.tokens)))
    assert all(coder.hash.index(t) == i for i, t in enumerate(coder.tokens))


def test_encoding_equals_the_library(coder, encoding):
    rnd = random.Random(1)
    alphabet = "abcdefgh ABC  \n\t'sé漢字😀12½²¯_-=.,!İǅ​́"
    texts = ["", "<|endoftext|>", "a" * 3000, " \n \n x", "I'll've 'S"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    for text in texts:
        ids = coder.encode(text)
        assert ids == encoding.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_memory_stays_bounded(coder, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    small = bpe.Coder(coder.tokens, public_tokenizers.PATTERN, np.array(coder.hash.displacements), np.array(coder.hash.slots))
    for i in range(200):
        small.encode(f"word{i} x{i % 7}")
    assert len(small) <= 11 and len(small.older) <= 11


def test_bpe_tables(spark, encoding):
    rows = docs(spark, [(1, None, "s"), (2, "", "s"), (3, "Hello  wörld", "s"), (3, "Hello  wörld", "s")])
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = encoding.encode_ordinary("Hello  wörld")
    got = {r["doc_id"]: r for r in bpe.round_trip(rows, vocabulary).collect()}
    assert got[3]["n_tokens"] == len(ids) and got[3]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[1]["n_tokens"] == 0 and got[1]["ids_sha256"] == got[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    encoded = bpe.encode(rows, vocabulary)
    assert [r["ids"] for r in encoded.where("doc_id = 3").collect()] == [ids, ids]
    assert {bytes(r["raw"]) for r in bpe.decode(encoded, vocabulary).collect()} == {b"", "Hello  wörld".encode()}
    assert bpe.encode_checked(rows.limit(0), vocabulary).count() == 0


# --- mixing -------------------------------------------------------------------------


def test_a_worker_keeps_no_pieces_after_the_pipelines_stage(spark):
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert bpe.encode_checked(docs(spark, [(k, f"some text {k}", "a") for k in range(20)]).repartition(4), vocabulary).count() == 20

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"held": [sum(len(c) + len(c.older) for c in bpe._CODERS.values())] * batch.num_rows})

    assert {r["held"] for r in spark.range(20).repartition(4).mapInArrow(held, "held long").collect()} == {0}


@pytest.mark.parametrize("seed", range(40))
def test_knapsack_against_all_subsets(seed):
    rnd = random.Random(seed)
    lengths = rnd.sample(range(0, 30), 4)
    counts = [rnd.randint(0, 3) for _ in lengths]
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    budget = rnd.randint(0, total + 3)
    for window in (1, 20, mixing.DP_WORDS):
        took = mixing.fit_counts(lengths, counts, budget, window)
        assert all(0 <= t <= c for t, c in zip(took, counts, strict=True))
        got = sum(n * t for n, t in zip(lengths, took, strict=True))
        sums = {sum(n * x for n, x in zip(lengths, xs, strict=True)) for xs in itertools.product(*(range(c + 1) for c in counts))}
        assert abs(got - budget) == min(abs(x - budget) for x in sums)


def test_knapsack_undoes_shares_and_looks_above():
    assert mixing.fit_counts([4, 6], [3, 1], 6) == [0, 1]
    assert mixing.fit_counts([4, 6, 9], [5, 1, 1], 15) == [0, 1, 1]
    assert mixing.fit_counts([10], [1], 9) == [1]
    assert mixing.fit_counts([1000, 1001], [10**6, 1], 123456789) == [123457, 0]


def test_knapsack_on_many_lengths():
    rnd = random.Random(2)
    lengths = sorted(rnd.sample(range(1, 60_000), 900))
    counts = [rnd.randint(1, 40) for _ in lengths]
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    for share in (0.1, 0.5, 0.93):
        took = mixing.fit_counts(lengths, counts, round(share * total))
        assert abs(sum(n * t for n, t in zip(lengths, took, strict=True)) - share * total) <= 1


def water(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    open_, total, target = set(names), sum(sizes.values()), {}
    while open_:
        level = total / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 3 * sizes[s]
            total -= target[s]
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(["w"] * (5 if i % 3 == 0 else rnd.randint(0, 60))), rnd.choice(["a", "a", "a", "b", "Z", "é", None])) for i in range(600)]
    rows += [(900, None, "a"), (901, "", "b"), (902, "lonely", "q"), (903, "", "void")]
    first = {r["doc_id"]: r for r in mixing.mix(docs(spark, rows)).collect()}
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = water(dict(sizes))
    took = collections.Counter()
    source = {i: s for i, _, s in rows}
    for i, r in first.items():
        assert r["source_size"] == sizes[source[i]] and r["target"] == pytest.approx(want[source[i]])
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        took[source[i]] += r["taken"]
    for s in sizes:
        assert abs(took[s] - want[s]) <= 1, s
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs(spark, rows[::-1]).repartition(5)).collect()}
    assert again == {i: r["taken"] for i, r in first.items()}
    rows_out = collections.Counter(r["doc_id"] for r in mixing.mixed(docs(spark, rows)).collect())
    assert rows_out == {i: r["taken"] // r["size"] for i, r in first.items() if r["taken"]}
    assert mixing.mix(docs(spark, [])).count() == 0


# --- quality and toxicity ---------------------------------------------------------------


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_quality_on_held_out_labels(spark):
    path = "/root/testdata/sf0.01"
    rows, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    # Labels of a fifth are kept from training altogether.
    away = F.crc32(F.col("doc_id").cast("string")) % 5 == 2
    model = quality.train(rows, labels.where(~away))
    assert model.exchanged and sum(model.exchanged[0]) > 0
    got = quality.scored(rows, model).join(labels.where(away), "doc_id").select("score", "quality").collect()
    right = sum((r["score"] >= quality.KEEP) == (r["quality"] == 1) for r in got)
    assert len(got) > 50 and right / len(got) >= 0.97
    kept = quality.keep(rows.withColumn("score", F.lit("mine")), labels)
    assert kept.columns == [*rows.columns, "score"] and kept.select("score").distinct().collect() == [("mine",)]
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in quality.scored(rows, quality.train(rows, labels)).where(F.col("score") >= quality.KEEP).collect()}


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = docs(spark, [(1, None, None), (None, "x", "s"), (3, "", "s")]).withColumn("score", F.lit("mine"))
    assert quality.train(rows, labels) is None
    out = quality.scored(rows, None)
    assert out.where("score = 1").count() == 3
    assert quality.keep(rows, labels).count() == 3
    assert len(quality.text_view("")) == quality.TEXT_FEATURES and len(quality.meta_view(None, None, None)) == quality.META_FEATURES
    assert np.isfinite(quality.text_view("A!!" * 1000)).all()


def test_metadata_view_never_reads_the_text(spark):
    """The view's score is the same whatever the text says."""
    path = "/root/testdata/sf0.01"
    rows, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = quality.train(rows, labels)
    swapped = rows.withColumn("text", F.lit("BUY!! NOW!! " * 50))
    key = ["source", "lang", "n_chars"]
    scores = quality.scored(rows.limit(200).unionByName(swapped.limit(200)), model).groupBy(*key).agg(F.countDistinct(F.round("metadata_score", 9)).alias("n"), F.countDistinct("content_score").alias("c")).collect()
    assert {r["n"] for r in scores} == {1} and any(r["c"] > 1 for r in scores)


def test_long_texts_take_part_in_training(spark):
    filler = "plain words all over the place here. " * 3000
    rows = [(i, filler + ("you wretched fool. " if i % 3 == 0 else "good morning. "), "s") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    assert toxicity.training_sample(docs(spark, rows), labels).count() == sum(not held_out(i) for i in range(60))


def test_toxicity_on_held_out_labels(spark):
    path = "/root/testdata/sf0.1"
    rows, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    some = rows.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.toxicity(some, labels).join(labels, "doc_id").select("doc_id", "held_out", "predicted", "score", "toxic").collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    test = [r for r in got if r["held_out"]]
    hit = sum(r["predicted"] for r in test if r["toxic"]) / sum(r["toxic"] for r in test)
    alarm = sum(r["predicted"] for r in test if not r["toxic"]) / sum(1 - r["toxic"] for r in test)
    assert hit >= 0.9 and alarm <= 0.02


def test_sentences_take_the_blame(spark):
    rnd = random.Random(3)
    sentence = lambda: " ".join(f"w{rnd.randrange(200)}" for _ in range(6)) + ". "
    texts = ["".join(sentence() for _ in range(rnd.randint(1, 12))) for _ in range(400)]
    labels = [rnd.random() < 0.3 for _ in texts]
    texts = [t + "you wretched fool. " + sentence() if y else t for t, y in zip(texts, labels, strict=True)]
    model = toxicity.fit(texts, [int(y) for y in labels])
    words = toxicity._Words(model)
    probe = "all is well here. you wretched fool! good day."
    score, start, end, p = toxicity.score_text(probe, model, words)
    assert score > 0.7 and probe[start:end].strip() == "you wretched fool" and p > 0.7
    assert toxicity.score_text("all is well here.", model, words)[0] < 0.3
    assert 0 <= toxicity.score_text("", model, words)[0] < 0.3
    rows = docs(spark, [(1, probe, "s"), (2, None, "s")])
    assert [(r["doc_id"], r["start"]) for r in toxicity.locate(rows, model).collect()] == [(1, start)]
    assert toxicity.score(rows.limit(0), model).count() == 0
    assert toxicity.fit(["a", "b"], [0, 0]).bias < 0


# --- personal data ---------------------------------------------------------------------------


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if pii.valid(k, m.group())] for k, p in pii.BASE.items()}


def test_base_spans_equal_the_patterns():
    anchors, rnd = pii.build(), random.Random(1)
    for _ in range(30_000):
        text = "".join(rnd.choice("a1.@+- ()23456.@b%") for _ in range(rnd.randint(0, 60)))
        found = pii.spans(text, anchors)
        assert {k: found[k] for k in pii.BASE} == brute(text), text
    text = "Zoë a.b@c.de, +1 (017) 555-7713; 4111 1111 1111 1111, 10.0.0.255 é x@y@z.com 1.2.3.999"
    found = pii.spans(text, anchors)
    assert {k: found[k] for k in pii.BASE} == brute(text)
    assert [text[s:e] for s, e in found["card"]] == ["4111 1111 1111 1111"]


def test_extra_spans():
    text = 'token = "24be64439e3e49cf" and iban GB82 WEST 1234 5698 7654 32 then https://bob:pw@host.org/x account number: 12-345-678 plain words. secret sauce recipe'
    found = pii.spans(text, pii.build())
    assert [text[s:e] for s, e in found["account"]] == ["24be64439e3e49cf", "12-345-678"] or len(found["account"]) == 3
    assert [text[s:e] for s, e in found["url"]] == ["https://bob:pw@host.org/x"]
    assert pii.iban("GB82WEST12345698765432") and not pii.iban("GB83WEST12345698765432")


def test_pii_table(spark):
    rows = docs(spark, [(1, None, "s"), (2, "mail a@b.co now", "s"), (2, "mail a@b.co now", "s")])
    got = pii.find_pii(rows).collect()
    assert sorted((r["doc_id"], r["n_email"], r["spans"]) for r in got) == [(1, 0, ""), (2, 1, "email:5:11"), (2, 1, "email:5:11")]
    assert {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"email:5:11").hexdigest()}
    assert {r["text"] for r in pii.redacted(rows).collect()} == {"", "mail <email> now"}


# --- the pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf, coder):
    import corpus_pipeline as cp

    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "line dedup", "near dedup", "mixing", "tokens"] and cp.ORACLE_SQL is None
    start = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [start]
    for _, stage in cp.STAGES:
        tables.append(stage(spark, tables[-1], sf).cache())
    assert all(t.columns == start.columns for t in tables[:-1])
    texts = [{r["doc_id"]: r["text"] for r in t.collect()} for t in tables[:-1]]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(labels[d] == 0 for d in labels if d in texts[0] and d not in texts[1]) or sum(labels[d] for d in labels if d in texts[0] and d not in texts[1]) <= 2

    from test_dedup import brute_components, brute_lines

    left = brute_lines(sorted(texts[1].items()), line_dedup.MIN_WORDS)
    assert texts[2] == {d: t for d, t in left.items() if WORD.search(t) or t == texts[1][d]}
    groups = brute_components(sorted(texts[2].items()), cp.SHINGLE_WORDS, cp.SIMILAR_PERCENT)
    assert set(texts[3]) == {d for d, (_, c) in groups.items() if c == d}
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(tables[3]).collect() if r["taken"]}
    assert collections.Counter(r["doc_id"] for r in tables[4].select("doc_id").collect()) == times
    for r in tables[5].collect():
        assert r["ids"] == coder.encode(texts[4][r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(texts[4][r["doc_id"]].encode()).hexdigest()
    assert cp.run(spark, sf).count() == tables[5].count()
