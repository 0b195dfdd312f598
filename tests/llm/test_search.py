"""Ranked search, main text of pages and hard negatives against brute force."""

import html
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import extraction, lexical, negatives, queries
from tallyloom.llm.common import table
from tallyloom.shipping import ship

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k, repeats=False):
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    n, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    merged = defaultdict(Counter)
    for item, text in items:
        merged[item].update(terms(text))
    out = []
    for item, wanted in merged.items():
        found = []
        for doc, c in counts:
            if doc is not None and c:
                m = 50 + 50 * sum(c.values()) * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) * (often if repeats else 1) for t, often in wanted.items() if t in c)
                found += [(-score, doc)] if score > 0 else []
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("repeats", [False, True])
def test_search_against_brute_force(spark, monkeypatch, repeats):
    ship(spark)
    rng = random.Random(5)
    words = ["a", "B", "b", "Éa", "éa", "x1", "the", "THE", "日本", "z-z", "q_q", "\x7fu"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)]
    docs += [(None, "a b the"), (7, None), (8, ""), (9, "the the"), (9, "the the"), (400, "Éa " * 5000), *((500 + i, "a x1 the") for i in range(200))]
    items = [(1, "a b x1 the the the"), (1, "日本"), (2, None), (None, "the z"), (3, "nothing"), (4, "Éa éa Q"), (5, "b " * 40)]
    monkeypatch.setattr(lexical, "PIECE", 1000)
    made = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS term", "3 AS score", "'z' AS Terms")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 AS block", "6 AS term")
    assert rows(lexical.search(made.repartition(7), asked, 20, repeats)) == ranked(docs, items, 20, repeats)
    # Items in several blocks, documents in many small blocks.
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 400)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    assert rows(lexical.search(made, asked, 20, repeats)) == ranked(docs, items, 20, repeats)
    assert lexical.search(made.limit(0), asked).count() == lexical.search(made, asked.limit(0)).count() == 0
    assert lexical.search(made, asked).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_search_arithmetic_past_64_bits():
    n = np.array([3, 10**12], dtype=np.int64)
    assert lexical.lengths(n, 10**9, 10**13).tolist() == [50 + 50 * int(x) * 10**9 // 10**13 for x in n]
    best = lexical.Best(1, 2)
    for score, doc in (([5, 5], [9, 8]), ([5, 4], [1, 2]), ([6], [30])):
        best.offer(0, np.array(score), np.array(doc))
    assert list(zip(best.score[0].tolist(), best.doc[0].tolist())) == [(6, 30), (5, 1)]


def article(source):
    """What the given pages hold between <article> and its end, by patterns."""
    inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    inside = re.sub(r"<[^>]*>", "", re.sub(r"<br>", "\n", re.sub(r"</?(p|h1)>", "\0", inside)))
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in inside.split("\0")) if t)


@pytest.fixture(scope="module")
def field(spark):
    ship(spark)
    return extraction.fitted(table(spark, "/root/testdata/sf0.001", "pages"))


def test_pages_of_the_table(spark, sf):
    want = {(r.page_id, r.url, article(r.html)) for r in table(spark, sf, "pages").collect()}
    got = queries.op12_html_extraction(spark, sf).collect()
    assert {(r.page_id, r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_held_out_layouts(field):
    texts = ["A line of words.", "Second, with a comma, and more words in it than before.", "Short", "And one which goes on for a while, so that its length is that of a paragraph; it ends here."]
    tally = Counter()
    for page in extraction.labelled_pages(texts, 300, seed=99):
        blocks = field.reader().blocks(page)
        tally.update(zip((b.main for b in blocks), field.viterbi(blocks)))
    assert tally[True, True] / (tally[True, True] + tally[False, True]) > 0.97
    assert tally[True, True] / (tally[True, True] + tally[True, False]) > 0.97


@pytest.mark.parametrize(
    "source, want",
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Home</a></nav>", ""),
        ("<article><p>One &amp; two.<p>Three\n\t four&nbsp;x.<!-- <p>no -->", "One & two.\nThree four x."),
        ("<article><P CLASS='t'>a <i>b</i>c, and so on.</P><script>var x='</p><p>no';</script><p>And the rest of it.</article><footer>&copy; me", "a bc, and so on.\nAnd the rest of it."),
        ("<main><h1>Title</h1><p>First, a sentence.</p><div class='comments'><p>Nice!</p></div></main>", "Title\nFirst, a sentence."),
        ("<article><p title='a > b'>Kept, as it is.</p><p>Also this, a line.</p></article><p", "Kept, as it is.\nAlso this, a line."),
    ],
)
def test_small_pages(field, source, want):
    assert field.text(field.reader().blocks(source or "")) == want


def test_odd_pages(spark, field):
    long = "<article>" + "<p>Words of a paragraph, as long as it is.</p>" * 30_000 + "</article>"
    made = [(1, "u", None), (None, None, "<article><p>A line, with words.</p></article>"), (2, "u", ""), (2, "u", ""), (3, "u", long), (4, "u", "<a " * 100_000 + '">'), (5, "u", "<div>" * 50_000 + "x")]
    df = spark.createDataFrame(made, "page_id long, url string, html string").selectExpr("*", "'own' AS text", "1 AS n_chars", "2 AS block")
    got = {r.page_id: r for r in extraction.extract(df, field).collect()}
    assert extraction.extract(df, field).count() == 7 and extraction.extract(df.limit(0), field).count() == 0
    assert got[1].text == got[2].text == "" and got[None].text == "A line, with words."
    assert got[3].text.count("\n") == 29_999
    assert extraction.fitted(df.limit(0)).weights


def test_viterbi_is_the_best_sequence(field):
    rng = random.Random(3)
    for _ in range(40):
        blocks = [extraction.Block("x", rng.sample(range(len(field.weights)), 4), False) for _ in range(rng.randint(1, 9))]

        def score(states):
            own = [sum(field.weights[i] for i in b.features) * s for b, s in zip(blocks, states)]
            return field.begin[states[0]] + sum(own) + sum(field.steps[a][b] for a, b in zip(states, states[1:]))

        every = [[n >> i & 1 for i in range(len(blocks))] for n in range(1 << len(blocks))]
        assert math.isclose(score([int(s) for s in field.viterbi(blocks)]), max(map(score, every)))


def mined(vectors, n_pos=5, n_neg=10):
    usable = [(i, label, [math.floor(256.0 * x) for x in v]) for i, label, v in vectors if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    owners = {}
    for i, label, v in usable:
        if i % 100 == 0 and (i not in owners or (label, v) < owners[i]):
            owners[i] = (label, v)
    out = []
    for a, (label, v) in owners.items():
        scored = [(-max(min(sum(x * y for x, y in zip(v, w)), 2**63 - 1), -(2**63) + 1), i, other == label) for i, other, w in usable if i != a and len(w) == len(v)]
        for p, positive, same in sorted(s for s in scored if s[2])[:n_pos]:
            fits = sorted((s, i) for s, i, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p)
            out += [(a, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(fits[:n_neg], 1)]
    return sorted(out, key=str)


def test_negatives_against_brute_force(spark, monkeypatch):
    ship(spark)
    rng = np.random.default_rng(2)
    made = [(int(i), int(rng.integers(0, 3)), (rng.normal(size=8) + 1).tolist()) for i in range(0, 1500, 3)]
    made += [(None, 1, [1.0] * 8), (5, None, [1.0] * 8), (6, 1, None), (7, 1, [1.0, None] * 4), (8, 1, [float("nan")] * 8), (9, 1, [float("inf")] * 8)]
    # Equal rows, other lengths, an empty vector, an anchor twice, a group of copies, values past 2^53.
    made += [made[4], made[5], (1600, 0, [1.0, 2.0]), (1601, 0, [1.0, 1.0]), (1602, 1, [0.5, 0.5]), (1700, 0, []), (1701, 0, []), (1702, 1, []), (900, 2, [0.25] * 8)]
    made += [(2001 + i, 1, [0.5] * 8) for i in range(200)] + [(3000, 0, [1e9] * 8), (3001, 0, [1e9] * 8), (3002, 1, [4e8] * 8), (3003, 1, [-1e30] * 8)]
    df = spark.createDataFrame(made, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS nth", "2 AS rank", "3 AS block")
    want = mined(made)
    assert want and rows(negatives.hard_negatives(df.repartition(5))) == want
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 500)
    monkeypatch.setattr(negatives, "BLOCK_SCORES", 64)
    assert rows(negatives.hard_negatives(df)) == want
    assert negatives.hard_negatives(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-4, 4), st.integers(0, 9)), max_size=60), st.integers(1, 4), st.integers(1, 20))
def test_bests_of_parts_are_the_best(entries, k, part):
    best = negatives.Best(4, k)
    for at in range(0, len(entries), part):
        best.offer(*(np.array(x, dtype=np.int64) for x in zip(*entries[at : at + part])))
    want = [(g, s, i) for group in range(4) for g, s, i in sorted((e for e in entries if e[0] == group), key=lambda e: (-e[1], e[2]))[:k]]
    assert list(zip(best.group.tolist(), best.score.tolist(), best.ident.tolist())) == want


def test_lengths_of_vectors_are_kept_apart():
    lists = pa.array([[1.0, 2.0], [3.0], [], [4.0, 5.0]], pa.list_(pa.float64()))
    got = {m.shape[1]: (ids.tolist(), m.tolist()) for ids, _, m in negatives.matrices(np.arange(4), np.zeros(4), lists, 2.0)}
    assert got == {0: ([2], [[]]), 1: ([1], [[6.0]]), 2: ([0, 3], [[2.0, 4.0], [8.0, 10.0]])}
