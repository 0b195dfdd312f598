"""Every operator on tables without rows, with nulls in all columns, with clashing columns and a very long text."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import bpe, exact_dedup, line_dedup, minhash, mixing, pii, quality, substring_dedup, toxicity, webp
from tallyloom.shipping import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside or give back.
CLASHING = "d v e n id key seq pos line words rank node value hash sig head tail size taken times digest n_bytes keep_id group_size kept label score _id _key _size _time _view block component gone whole n_lines n_deleted n_tokens ids media payload quality toxic target weight cap level Text2".split()
LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"w{i % 9973}" for i in range(120_000))
ROWS = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, LONG, "en", "a", None), (4, LONG, None, "a", 1), (5, "one line here now\nmail a@b.co", "en", "b", 1), (5, "one line here now\nmail a@b.co", "en", "b", 1)]


def vocabulary(spark):
    return bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


OPERATORS = {
    "exact": lambda spark, docs, labels: exact_dedup.exact_dedup(docs),
    "bpe": lambda spark, docs, labels: bpe.round_trip(docs, vocabulary(spark)),
    "lines": lambda spark, docs, labels: line_dedup.line_dedup(docs),
    "mix": lambda spark, docs, labels: mixing.mix(docs),
    "quality": lambda spark, docs, labels: quality.keep(docs, labels),
    "toxicity": lambda spark, docs, labels: toxicity.toxicity(docs, labels),
    "pii": lambda spark, docs, labels: pii.find_pii(docs),
    "webp": lambda spark, docs, labels: webp.digests(webp.store(docs)),
    "near": lambda spark, docs, labels: minhash.near_dedup(docs),
}


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    docs = spark.createDataFrame(ROWS, DOCS)
    return docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_come_back(spark, odd, name):
    labels = spark.createDataFrame([(None, None, None), (3, 1, 0), (3, 1, 0), (5, 0, 1), (77, 1, 1)], LABELS).withColumn("text", F.lit("not this"))
    out = OPERATORS[name](spark, odd, labels)
    got = out.select("doc_id").collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3, 4, 5, 5]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables_give_no_rows(spark, odd, name):
    labels = spark.createDataFrame([], LABELS)
    assert OPERATORS[name](spark, odd.limit(0), labels).count() == 0


def test_passages_of_odd_rows(spark, odd):
    found = substring_dedup.passages(odd).collect()
    assert [(r.doc_id, r.source_doc_id, r.start_word, r.end_word) for r in found] == [(4, 3, 0, 120_000)]
    assert substring_dedup.passages(odd.limit(0)).count() == 0


def test_other_entry_points_on_odd_rows(spark, odd):
    """Updates, runs, sentences, redaction, tokens and pixels of odd and of empty tables."""
    ids = lambda df: sorted(r.doc_id or 0 for r in df.select("doc_id").collect())
    words, model = vocabulary(spark), toxicity.Model(-3.0, {"line": 9.0})
    for docs, want in ((odd, [0, 1, 2, 3, 4, 5, 5]), (odd.limit(0), [])):
        assert ids(pii.redacted(docs)) == want
        assert ids(bpe.encode(docs, words)) == ids(bpe.encode_checked(docs, words)) == ids(bpe.decode(bpe.encode(docs, words), words)) == want
        assert ids(webp.read_pixels(webp.store(docs))) == want
        assert ids(toxicity.locate(docs, model)) == want[-2:]
        assert ids(line_dedup.runs(docs)) == []
        index = exact_dedup.build_index(docs)
        assert exact_dedup.update_index(index, deleted=docs).count() == 0
        assert sorted(map(str, exact_dedup.renamed(exact_dedup.update_index(index, inserted=docs, deleted=docs), docs).collect())) == sorted(map(str, index.collect()))


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_odd_rows(spark, odd, stage, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([(None, None, None), (3, 1, 0), (5, 0, 1), (77, 1, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    run = cp.STAGES[stage][1]
    got, none = run(spark, odd, str(tmp_path)), run(spark, odd.limit(0), str(tmp_path))
    assert none.count() == 0
    assert got.columns == odd.columns if stage < 4 else "doc_id" in got.columns
    left = sorted(r.doc_id or 0 for r in got.select("doc_id").collect())
    # Nulls and empty texts stay but in the mix; the copy of the long text goes as lines and as a near-duplicate.
    assert left == {0: [0, 1, 2, 3, 4, 5, 5], 1: [0, 1, 2, 3, 5, 5], 2: [0, 1, 2, 3, 5, 5], 4: [0, 1, 2, 3, 4, 5, 5]}.get(stage, left)


def test_near_stage_tells_texts_with_one_id_apart(spark):
    import corpus_pipeline as cp

    other = " ".join(f"x{i}" for i in range(60))
    rows = [(1, LONG[:900], "en", "s", 1), (2, LONG[:900], "en", "s", 1), (2, other, "en", "s", 1)]
    got = cp.near_stage(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, LONG[:900]), (2, other)]


def test_changing_stages_keep_clashing_columns(spark, odd):
    lines, mixed = line_dedup.line_dedup(odd), mixing.mixed(odd)
    assert mixed.columns == odd.columns
    own = [c for c in CLASHING if c not in ("n_lines", "n_deleted")]
    assert {tuple(r) for r in lines.select(*own).collect()} == {tuple(f"own {c}" for c in own)}
    assert {r[0] for r in mixed.select("size").collect()} <= {"own size"}
