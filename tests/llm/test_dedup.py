"""Exact, line, near and substring deduplication against brute force; edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import components, exact_dedup, line_dedup, minhash, queries, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


def random_words(rnd, n, vocabulary=4000):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


# --- exact --------------------------------------------------------------------


def test_cuckoo_index_insert_delete_resize():
    index = exact_dedup.CuckooIndex(buckets=2)
    keys = [(hashlib.sha256(str(i).encode()).digest(), i) for i in range(5000)]
    for i, (k, n) in enumerate(keys):
        index.insert(k, n, i)
        index.insert(k, n, None, 2)
    assert index.live == 5000 and index.mask + 1 >= 1250
    assert all(k in index for k in keys)
    assert all(index.delete(*k) for k in keys[::2]) and not index.delete(*keys[0])
    assert [k in index for k in keys] == [i % 2 == 1 for i in range(5000)]
    assert {(b, n): (best, rows) for b, n, best, rows in index.entries()} == {k: (i, 3) for i, k in enumerate(keys) if i % 2}


def test_filter_hits_are_verified():
    index = exact_dedup.CuckooIndex(buckets=4)
    a = bytes(32)
    b = bytes(31) + b"\x01"  # same place and fingerprint, other content
    index.insert(a, 5, 1)
    assert (b, 5) not in index and (a, 6) not in index
    index.insert(b, 5, 2)
    assert index.live == 2


def test_exact_groups(spark):
    rows = [(1, "a"), (5, "a"), (3, "a"), (2, ""), (4, None), (None, "a"), (None, "z"), (9, "b"), (9, "b")]
    got = sorted(((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 5, 4, False), (5, 5, 4, True), (3, 5, 4, False), (-1, 5, 4, False), (2, 4, 2, False), (4, 4, 2, True), (-1, None, 1, True), (9, 9, 2, True), (9, 9, 2, True)], key=str)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_index_follows_the_corpus(spark):
    index = exact_dedup.build_index(docs(spark, [(1, "a"), (2, "b"), (3, "b")]))
    later = exact_dedup.update_index(index, inserted=docs(spark, [(7, "a"), (8, "c")]), deleted=docs(spark, [(0, "b"), (3, "b")]))
    assert sorted((r["keep_id"], r["group_size"]) for r in later.collect()) == [(2, 1), (7, 2), (8, 1)]
    last = exact_dedup.update_index(later, deleted=docs(spark, [(2, "b"), (7, "a"), (9, "never seen")]))
    assert sorted((r["keep_id"], r["group_size"]) for r in last.collect()) == [(1, 1), (8, 1)]


@pytest.mark.parametrize("seed", range(2))
def test_index_updates_against_rebuilding(spark, seed, monkeypatch):
    """Any order of losses and gains gives what an index of the remaining rows has."""
    monkeypatch.setattr(exact_dedup, "LIVE_ENTRIES", 5)
    rnd = random.Random(seed)
    rows = [(i if rnd.random() < 0.95 else None, rnd.choice("abcdefgh") * rnd.randint(0, 2)) for i in range(120)] + [(7, "zz")] * 3
    gone = rnd.sample(rows, 70)
    new = [(200 + i, rnd.choice("abcz") * 2) for i in range(20)]
    left = list((collections.Counter(rows) - collections.Counter(gone)).elements()) + new
    index = exact_dedup.update_index(exact_dedup.build_index(docs(spark, rows)), inserted=docs(spark, new), deleted=docs(spark, gone))
    found = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.renamed(index, docs(spark, left)).collect()}
    assert found == {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.build_index(docs(spark, left)).collect()}


@pytest.mark.parametrize("steps, ids, stale, rows", [("-10 +3 -9 -8 -7 -6", [], True, 2), ("-10 +3 -5", [9, 8, 7, 6], False, 5), ("-10 +3 -9 -8 -7 -6 +4", [], True, 3), ("-10 +3 -9 -8 -7 -6 +11", [11], False, 3), ("-11 +5 -10", [9, 8, 7, 6], False, 6)])
def test_index_knows_what_may_be_unnamed(steps, ids, stale, rows):
    index = exact_dedup.CuckooIndex()
    for i in range(5, 11):
        index.insert(b"k" * 32, 1, i)
    for step in steps.split():
        index.insert(b"k" * 32, 1, int(step[1:])) if step[0] == "+" else index.remove(b"k" * 32, 1, int(step[1:]))
    assert (index.ids[0], not index.ids[0] and index.floor[0] is not None, index.rows[0]) == (ids, stale, rows)


def test_index_after_random_gains_and_losses():
    """Thousands of mixed sequences, passed through stored entries on the way: the keeper is right or marked stale, the count right."""
    for seed in range(4000):
        rnd, live, index = random.Random(seed), collections.Counter(), exact_dedup.CuckooIndex()
        for _ in range(40):
            doc_id = rnd.choice([None] + list(range(14))) if rnd.random() < 0.98 else 50
            if rnd.random() < 0.55:
                index.insert(b"k" * 32, 1, doc_id)
                live[doc_id] += 1
            elif live[doc_id]:
                index.remove(b"k" * 32, 1, doc_id)
                live[doc_id] -= 1
            if rnd.random() < 0.1:
                fresh = exact_dedup.CuckooIndex()
                for row in index.drain().to_pylist():
                    fresh.insert(*row.values())
                index = fresh
            known, count = [i for i, n in live.items() if n and i is not None], sum(live.values())
            found = list(index._stored())
            assert bool(found) == bool(count)
            if found:
                _, ids, rows, floor = found[0]
                assert rows == count
                assert (ids and ids[0] == max(known)) or not ids and (floor is not None or not known)


# --- lines --------------------------------------------------------------------


def brute_lines(rows, least):
    """Texts left: a line goes if a run through it of `least` words occurs at an earlier place."""
    lines = {d: (t or "").split("\n") for d, t in rows}
    spoken = {d: [(p, x) for p, x in enumerate(ls) if WORD.search(x)] for d, ls in lines.items()}
    places = [(d, s) for d in sorted(spoken) for s in range(len(spoken[d]))]
    gone = collections.defaultdict(set)
    for a, (d, s) in enumerate(places):
        for e, t in places[:a]:
            n = 0
            while s + n < len(spoken[d]) and t + n < len(spoken[e]) and spoken[d][s + n][1] == spoken[e][t + n][1]:
                n += 1
            if sum(len(WORD.findall(spoken[d][s + k][1])) for k in range(n)) >= least:
                gone[d].update(spoken[d][s + k][0] for k in range(n))
    return {d: "\n".join(x for p, x in enumerate(ls) if p not in gone[d]) for d, ls in lines.items()}


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    pool = ["a", "b c", "d e f", "one two three four", "", "  ", "x y z w v", "q"]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(14)]
    rows += [(20, rows[3][1]), (21, rows[4][1])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert got == brute_lines(rows, line_dedup.MIN_WORDS)


@pytest.mark.parametrize("seed", range(3))
def test_maximal_runs_against_brute_force(spark, seed):
    """Each run equals its source, which is earlier, and ends where they differ; together they are what is deleted."""
    rnd = random.Random(seed)
    pool = ["a", "b c", "d e f", "one two three four", "", "x y z w v", "q"]
    long = [rnd.choice(pool) for _ in range(40)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 9)))) for i in range(8)]
    rows += [(20 + i, "\n".join(long[rnd.randint(0, 9) : rnd.randint(20, 40)] + [f"own{i}"])) for i in range(4)]
    spoken = {d: [(p, x) for p, x in enumerate(t.split("\n")) if WORD.search(x)] for d, t in rows}
    covered = collections.defaultdict(set)
    for r in line_dedup.runs(docs(spark, rows)).collect():
        own, other = spoken[r["doc_id"]], spoken[r["source_doc_id"]]
        s, e = (next(k for k, (p, _) in enumerate(own) if p == x) for x in (r["first"], r["last"]))
        t = next(k for k, (p, _) in enumerate(other) if p == r["source_first"])
        size = e - s + 1
        assert (r["source_doc_id"], t) < (r["doc_id"], s)
        assert [x for _, x in own[s : e + 1]] == [x for _, x in other[t : t + size]]
        assert s == 0 or t == 0 or own[s - 1][1] != other[t - 1][1]
        assert e + 1 == len(own) or t + size == len(other) or own[e + 1][1] != other[t + size][1]
        covered[r["doc_id"]].update(p for p, _ in own[s : e + 1])
    want = brute_lines(rows, line_dedup.MIN_WORDS)
    for d, t in rows:
        assert "\n".join(x for p, x in enumerate(t.split("\n")) if p not in covered[d]) == want[d]


def test_runs_of_different_sources_stay_apart(spark):
    rows = [(1, "one two three four\nz"), (2, "five six seven eight\ny"), (3, "one two three four\nfive six seven eight")]
    got = sorted(tuple(r) for r in line_dedup.runs(docs(spark, rows)).collect())
    assert got == [(3, 0, 0, 1, 0), (3, 1, 1, 2, 0)]


def test_prefix_doubling_goes_to_the_end(spark):
    text = "\n".join(f"line {k}" for k in range(40))
    lines = line_dedup._lines(line_dedup._keyed(docs(spark, [(1, text), (2, text + "\nmore")])))
    assert len(line_dedup.suffix_ranks(lines)) == 6  # 32 of 40 lines repeat


def test_lines_edges(spark):
    rows = [(1, None), (2, ""), (3, "same words in here\nx"), (4, "same words in here\nx"), (None, "same words in here"), (6, "tiny"), (7, "tiny"), (8, "same words in here\n\nnew")]
    out = line_dedup.line_dedup(docs(spark, rows).withColumn("n_lines", F.lit(7)).withColumn("seq", F.lit(1)))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_deleted"]) for r in out.collect()}
    assert got == {1: (None, 0, 0), 2: ("", 1, 0), 3: ("same words in here\nx", 2, 0), 4: ("", 2, 2), None: ("", 1, 1), 6: ("tiny", 1, 0), 7: ("tiny", 1, 0), 8: ("\nnew", 3, 1)}
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0
    assert [(r["doc_id"], r["first"], r["last"]) for r in line_dedup.runs(docs(spark, rows[2:3] + rows[7:])).collect()] == [(8, 0, 0)]


def test_line_plan_has_no_python(spark, sf):
    plan = line_dedup.line_dedup(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- near-duplicates -----------------------------------------------------------


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return set(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows, size, percent):
    sets = {d: shingles(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_rows(seed):
    """Unrelated texts, groups of edited copies of short and long ones, a common head, edges."""
    rnd = random.Random(seed)
    head = random_words(rnd, 8)
    rows, n = [], 0
    for length in (3, 12, 30, 60, 150, 420, 700):
        base = random_words(rnd, length)
        for _ in range(14):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, length // 40))):
                text[rnd.randrange(length)] = f"w{rnd.randrange(4000)}"
            rows.append((n := n + 1, " ".join(head * rnd.randint(0, 1) + text)))
    rows += [(n + k, " ".join(head + random_words(rnd, rnd.randint(0, 90)))) for k in range(1, 30)]
    return rows + [(901, ""), (902, None), (903, " \n"), (904, "One"), (905, "one"), (906, "one two"), (907, "ONE TWO"), (908, rows[5][1].upper())]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_components_against_brute_force(spark, size, percent):
    rows = near_rows(size)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_dedup(docs(spark, rows), size, percent).collect()}
    assert got == brute_components(rows, size, percent)


def test_near_blocks_find_the_same(spark, monkeypatch):
    rnd = random.Random(4)
    base = random_words(rnd, 300)
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rnd.randint(0, 12)):
            text[rnd.randrange(300)] = f"w{rnd.randrange(4000)}"
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "LATE_BLOCK", 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_dedup(docs(spark, rows)).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_edges(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "x y z"), (5, "x y z")]
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_dedup(docs(spark, rows)).collect())
    assert got == {(None, None, True): 1, (1, 1, True): 1, (2, 1, False): 1, (2, 2, True): 1, (5, 2, False): 1}
    assert minhash.near_dedup(docs(spark, [])).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 180)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 180)}


# --- substrings ------------------------------------------------------------------


def test_windows_are_the_cartesian_tree():
    import numpy as np

    rng = np.random.default_rng(0)

    def tree(v, low, high, least, out):
        if high - low + 1 >= least:
            c = low + int(v[low : high + 1].argmin())
            out.add((low, c, high))
            tree(v, low, c - 1, least, out)
            tree(v, c + 1, high, least, out)

    for _ in range(400):
        v = rng.permutation(10_000)[: rng.integers(0, 70)].astype(np.uint64)
        least, want = int(rng.integers(1, 12)), set()
        tree(v, 0, len(v) - 1, least, want)
        assert set(substring_dedup.compact_windows(v, least)) == want


def test_planted_passages(spark):
    rnd = random.Random(9)
    passage = random_words(rnd, 70)
    edited = list(passage)
    edited[35] = "changed"
    rows = [(i, " ".join(random_words(rnd, 120))) for i in range(30)]
    for i, inside in ((40, passage), (41, passage), (42, edited)):
        rows.append((i, " ".join(random_words(rnd, 60) + inside + random_words(rnd, 50))))
    rows += [(50, rows[2][1]), (51, None), (52, ""), (None, rows[3][1]), (53, " ".join(passage[:40]))]
    got = {(r["doc_id"], r["source_doc_id"]): r for r in substring_dedup.passages(docs(spark, rows)).collect()}
    assert set(got) == {(41, 40), (42, 40), (50, 2)}
    assert (got[41, 40]["start_word"], got[41, 40]["end_word"]) == (60, 130) and got[41, 40]["similarity"] == 1.0
    assert got[42, 40]["start_word"] <= 60 and got[42, 40]["end_word"] >= 130 and got[42, 40]["similarity"] >= 0.8
    text = dict(rows)[41]
    assert WORD.findall(text[got[41, 40]["start_char"] : got[41, 40]["end_char"]]) == passage
    assert substring_dedup.passages(docs(spark, [])).count() == 0


def brute_passages(a, b, least, percent):
    """The most shingles of a in a passage pair of two shingle lists, over all passage pairs; 0 if there is none."""
    best = 0
    for s in range(len(a)):
        for e in range(max(s + least, s + best + 1), len(a) + 1):
            own = set(a[s:e])
            for t in range(len(b) - least + 1):
                seen, shared = set(), 0
                for u, x in enumerate(b[t:], 1):
                    if x not in seen:
                        seen.add(x)
                        shared += x in own
                    if u >= least and 100 * shared >= percent * (len(own) + len(seen) - shared):
                        best = max(best, e - s)
                        break
    return best


def shingle_ids(words, size=5):
    import numpy as np

    return np.array([hash(tuple(words[k : k + size])) for k in range(len(words) - size + 1)], np.int64)


@pytest.mark.parametrize("seed", range(12))
def test_passages_with_insertions_and_deletions_against_all_pairs(seed):
    rnd = random.Random(seed)
    passage = random_words(rnd, 26)
    edited = list(passage)
    for _ in range(seed % 3):
        at = rnd.randrange(5, len(edited) - 5)
        edited[at : at + rnd.randint(0, 1)] = random_words(rnd, rnd.randint(0, 1))
    a = shingle_ids(random_words(rnd, 5) + passage + random_words(rnd, 6))
    b = shingle_ids(random_words(rnd, 8) + edited + random_words(rnd, 3))
    aligned = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y]
    for percent in (60, 70, 80):
        want = brute_passages(a.tolist(), b.tolist(), 12, percent)
        for seeds in (aligned, aligned[::-1]):
            got = substring_dedup.matches(a, b, seeds, 12, percent)
            # A pair is found or isn't; the longest may reach further past the last matches than what is found.
            slack = want * (100 - percent) // percent + 1
            assert bool(got) == bool(want), (percent, want, got)
            assert all(100 * j >= percent for *_, j in got) and all(e - s + 1 <= want for s, e, *_ in got)
            assert not got or want - slack <= max(e - s + 1 for s, e, *_ in got)


@pytest.mark.parametrize("size", range(43, 53))
def test_ends_that_match_nothing_count_up_to_the_least_length(size):
    """Runs of 45 to 49 equal words between different ones lie in 50-word passages of 0.804 to 0.957."""
    rnd = random.Random(size)
    for before, after in ((20, 30), (0, 30), (30, 0), (3, 2)):
        run = random_words(rnd, size, 10**6)
        a = shingle_ids(random_words(rnd, before, 10**6) + run + random_words(rnd, after, 10**6))
        b = shingle_ids(random_words(rnd, 40, 10**6) + run + random_words(rnd, 25, 10**6))
        got = substring_dedup.matches(a, b, [(before + 3, 43)], 46, 80)
        best = 0.0 if min(len(a), len(b)) < 46 else (size - 4) / (92 - size + 4) if size < 50 else 1.0
        assert bool(got) == (best >= 0.8) and all(j >= 0.8 and e - s >= 45 and u - t >= 45 for s, e, t, u, j in got)
        if got:
            assert got[0][4] == pytest.approx(best)


def any_passage(a, b, least, percent):
    """Is there a passage pair at the similarity, over all pairs of ranges? For texts in which no shingle repeats."""
    import numpy as np

    hits = np.zeros((len(a) + 1, len(b) + 1), int)
    hits[1:, 1:] = np.cumsum(np.cumsum(np.array(a)[:, None] == np.array(b)[None, :], axis=0), axis=1)
    t, u = np.triu_indices(len(b) + 1, least)
    for s in range(len(a) - least + 1):
        for e in range(s + least, len(a) + 1):
            row = hits[e] - hits[s]
            shared = row[u] - row[t]
            if (100 * shared >= percent * (e - s + u - t - shared)).any():
                return True
    return False


def test_recall_over_a_corpus_against_all_pairs(spark):
    """Planted pairs of 45 to 80 words with up to two edits: all equal ones are found, 0.95 of the others."""
    rnd, rows, want = random.Random(11), [], {}
    for k in range(100):
        size, edits = rnd.randint(45, 75), k % 3
        run = random_words(rnd, size, 10**6)
        other = list(run)
        for _ in range(edits):
            at = rnd.randrange(3, len(other) - 3)
            other[at : at + rnd.randint(0, 1)] = random_words(rnd, rnd.randint(0, 1), 10**6)
        a, b = (random_words(rnd, rnd.randint(6, 20), 10**6) + x + random_words(rnd, rnd.randint(6, 20), 10**6) for x in (run, other))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        ids, others = shingle_ids(a).tolist(), shingle_ids(b).tolist()
        if any_passage(ids, others, 46, 80):
            want[2 * k + 1, 2 * k] = run == other and size >= 50
    got = {(r["doc_id"], r["source_doc_id"]) for r in substring_dedup.passages(docs(spark, rows)).collect()}
    assert got <= set(want)
    assert all(pair in got for pair, equal in want.items() if equal)
    near = [pair for pair, equal in want.items() if not equal]
    assert sum(pair in got for pair in near) >= 0.95 * len(near), (len(near), [p for p in near if p not in got])


def test_inserted_and_deleted_words_do_not_hide_passages():
    rnd = random.Random(3)

    def found(before, after):
        a, b = shingle_ids(random_words(rnd, 20) + after + random_words(rnd, 30)), shingle_ids(random_words(rnd, 40) + before + random_words(rnd, 10))
        shared = [(i, int((b == x).argmax())) for i, x in enumerate(a) if x in b]
        return [substring_dedup.matches(a, b, [centre], 46, 80) for centre in (shared[3], shared[len(shared) // 2], shared[-3])]

    for size, cuts in ((60, [30]), (120, [40, 80]), (450, range(45, 450, 45))):
        base = random_words(rnd, size)
        longer = [w for k, w in enumerate(base) for w in ([f"new{k}", w] if k in cuts else [w])]
        shorter = [w for k, w in enumerate(base) if k not in cuts]
        for other in (longer, shorter):
            for out in [*found(base, other), *found(other, base)]:
                assert len(out) == 1 and out[0][4] >= 0.8 and out[0][0] == 20 and out[0][2] == 40, (size, out)


def test_repeated_words_are_laid_out_by_diagonals():
    a = shingle_ids(["x"] * 900)
    (got,) = substring_dedup.matches(a, a[:700], [(0, 0)], 46, 80)
    assert got[4] == 1.0 and got[1] - got[0] + 1 >= 696


def test_one_agreeing_function_is_enough(spark):
    """Passages at 0.8 whose min-hashes agree in one of the four functions only."""
    rnd = random.Random(0)
    rows, n = [], 0
    while len(rows) < 12:
        passage = random_words(rnd, 60, 10**6)
        edited = list(passage)
        edited[rnd.randrange(5, 55)] = "changed"
        edited.insert(0, "before")
        a, b = (" ".join(random_words(rnd, 8, 10**6) + x) for x in (passage, edited))
        minima = []
        for text in (a, b):
            ids = substring_dedup.shingle_hashes(text.split(), 5, substring_dedup.WordHashes()).view("uint64")
            mixed = [substring_dedup._mixed(ids ^ seed) for seed in substring_dedup.SEEDS]
            minima.append({(k, int(m[c])) for k, m in enumerate(mixed) for _, c, _ in substring_dedup.compact_windows(m, 46)})
        if len({k for k, _ in minima[0] & minima[1]}) == 1:
            rows += [(n, a), (n + 1, b)]
            n += 2
    got = {(r["doc_id"], r["source_doc_id"]) for r in substring_dedup.passages(docs(spark, rows)).collect()}
    assert got == {(k + 1, k) for k in range(0, n, 2)}


def test_no_member_of_a_group_goes_uncompared(spark):
    """Earlier documents own the min-hashes of a passage, and a chain of variants."""
    rnd = random.Random(5)
    passage = random_words(rnd, 50, 10**6)
    ids = substring_dedup.shingle_hashes(passage, 5, substring_dedup.WordHashes()).view("uint64")
    low = sorted({int(substring_dedup._mixed(ids ^ seed).argmin()) for seed in substring_dedup.SEEDS})
    spread = lambda: " ".join(w for at in low for w in random_words(rnd, 70, 10**6) + passage[at : at + 5])
    rows = [(k, spread() + " " + " ".join(random_words(rnd, 70, 10**6))) for k in range(5)]
    around = lambda x, n: " ".join(random_words(rnd, n, 10**6) + x + random_words(rnd, n, 10**6))
    rows += [(10, around(passage, 40)), (11, around(passage, 30))]
    # Each variant changes other words, so 22 meets 21 but not 20.
    chain = random_words(rnd, 100, 10**6)
    for k, at in ((20, 0), (21, 1), (22, 2)):
        variant = [f"v{at}" if place in [7 + 13 * i for i in range(2 * at)] else w for place, w in enumerate(chain)]
        rows.append((k, " ".join(variant)))
    got = {(r["doc_id"], r["source_doc_id"]) for r in substring_dedup.passages(docs(spark, rows)).collect()}
    assert (11, 10) in got and (21, 20) in got and any(a == 22 for a, _ in got)
    assert not any(a < 10 or b < 10 for a, b in got)


def test_a_repeated_word_alone_holds_no_windows_together(spark):
    """Runs of one word, too short on one side for a passage, made clusters of which no pair was ever verified."""
    rows = [(k, " ".join([f"a{k}"] * 60 + ["of"] * 20 + [f"b{k}"] * 60)) for k in range(12)] + [(12, " ".join(["start"] + ["of"] * 60 + ["end"]))]
    assert substring_dedup.clusters(docs(spark, rows), 5, 46, 80).count() == 0
    # Two long runs are passages of each other.
    rows.append((13, " ".join(["from"] + ["of"] * 55 + ["to"])))
    assert [(r["doc_id"], r["source_doc_id"]) for r in substring_dedup.passages(docs(spark, rows)).collect()] == [(13, 12)]


def test_runs_of_a_repeated_word_with_other_neighbours_are_no_cluster(spark):
    """A run one word too short and a longer one shared one shingle and 41 matches: every pair of such a cluster was laid out, none verified."""
    rows = [(k, " ".join([f"a{k}"] * 45 + ["of"] * (45 if k % 2 else 47) + [f"b{k}"] * 45)) for k in range(12)]
    assert substring_dedup.clusters(docs(spark, rows), 5, 46, 80).count() == 0
    # Among runs of other words that both have, it is one of the shared shingles.
    rows = [(k, " ".join([f"a{k}"] * 30 + ["at"] * 20 + ["of"] * (20 + k) + ["to"] * 20 + [f"b{k}"] * 30)) for k in (0, 2)]
    assert [(r["doc_id"], r["source_doc_id"]) for r in substring_dedup.passages(docs(spark, rows)).collect()] == [(2, 0)]


@pytest.mark.parametrize("seed", range(20))
def test_kinds_of_shingles_in_each_run_by_counting(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 40, 6)
    flat, bounds = rng.integers(0, 9, sizes.sum()), np.append(0, np.cumsum(sizes))
    m = substring_dedup._Members(*[np.arange(6)] * 3, flat, bounds, 8, 80)
    inside = np.isin(flat, rng.integers(0, 9, 6))
    runs = [(set(flat[s : s + 8].tolist()), set(flat[s : s + 8][inside[s : s + 8]].tolist())) for s in m.starts]
    assert m.alike(inside).tolist() == [100 * len(found) >= 80 * len(kinds) for kinds, found in runs]


def test_words_by_arrays_are_those_of_the_pattern():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abAB \u00e9\u00c9\u6f22\t\n\x0b\x85\xa0\U0001f600") for _ in range(rnd.randrange(40))) for _ in range(500)] + ["", " ", "x" * 50_000, "Long text " * 9_000]
    data, bounds = substring_dedup._flat(pa.array(["left out", *texts])[1:], np.uint8)
    starts, ends, hashes = substring_dedup._words(data, bounds)
    want = [w.encode() for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] == want
    lowered = [w.lower() for w in want]
    assert len(set(lowered)) == len(set(hashes.tolist())) == len(set(zip(lowered, hashes.tolist(), strict=True)))


def test_components_go_on_from_known_ones(spark):
    rnd = random.Random(8)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(500 + k, 501 + k) for k in range(20)]
    want = {}
    for a, b in links:
        if a != b:
            both = want.get(a, {a}) | want.get(b, {b})
            want.update(dict.fromkeys(both, both))
    frame = lambda x: spark.createDataFrame(x, "a long, b long").coalesce(1)
    got = components.components(frame(links[20:]), components.components(frame(links[:20])))
    assert {r["node"]: r["component"] for r in got.collect()} == {k: min(v) for k, v in want.items()}


# --- the registered queries against their SQL ---------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    got, want = queries.queries()[name](spark, sf).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    pd.testing.assert_frame_equal(got[columns].sort_values("doc_id").reset_index(drop=True), want[columns].sort_values("doc_id").reset_index(drop=True), check_dtype=False)


def test_a_slice_of_pairs_is_hashed_at_once(monkeypatch):
    """Verifying hashed each text by itself, which took more than laying out most pairs."""
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [{"doc_id": k, "source_doc_id": 0, "aligned": [{"x": 4 + 20, "y": 20}], "text": f"ä{k} b c d {shared}", "source_text": shared} for k in range(1, 9)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("source_doc_id", pa.int64()), ("aligned", pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))), ("text", pa.string()), ("source_text", pa.string())]))

    class Pairs:
        def select(self, *_):
            return self

        def mapInArrow(self, work, _):
            return [r for out in work(iter([batch])) for r in out.to_pylist()]

    calls, words = [], substring_dedup._words
    monkeypatch.setattr(substring_dedup, "_words", lambda *args: calls.append(1) or words(*args))
    found = substring_dedup._verify(Pairs(), 5, 46, 80)
    assert len(calls) == 1
    assert [(r["doc_id"], r["start_word"], r["end_word"], r["source_start_word"], r["start_char"]) for r in found] == [(k, 4, 64, 0, 9) for k in range(1, 9)]
