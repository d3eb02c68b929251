"""Periodic runs, pattern packing and ranked search against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from siltstone.llm import pattern_packing, periodic_runs, queries, ranked_search

from .conftest import TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- periodic runs ------------------------------------------------------------------------


def runs_by_force(w, least=24, times=3):
    """Every maximal stretch of each period, of equal stretches the smallest."""
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def periodic_words(rnd):
    w = []
    for _ in range(rnd.randint(0, 6)):
        base = [b"%d" % rnd.randrange(rnd.choice([2, 3, 50])) for _ in range(rnd.randint(1, 40))]
        w += (base * rnd.randint(1, 7))[: rnd.randint(1, 200)]
    return w


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (9, 4)])
def test_runs_are_those_of_brute_force(least, times):
    rnd = random.Random(least)
    for _ in range(80):
        docs = [periodic_words(rnd) for _ in range(rnd.randint(1, 5))]
        got = [list(map(tuple, r.tolist())) for r in periodic_runs.runs_of(docs, least, times)]
        assert got == [runs_by_force(w, least, times) for w in docs]


def test_gram_length_is_the_least_overlap():
    for least, times in ((24, 3), (6, 2), (10, 5)):
        assert periodic_runs.gram_length(least, times) == min(max(least, times * q) - q for q in range(1, 500))


def test_runs_of_odd_rows(spark, odd, nothing):
    rows = periodic_runs.find_runs(odd).collect()
    assert len(rows) == odd.count() and periodic_runs.find_runs(nothing).count() == 0
    for r in rows:
        if r.doc_id == 7:
            assert [tuple(x) for x in r.runs] == [(0, 3000, 1)] and (r.collapsed, r.n_words) == ("word", 3000)
        elif r.doc_id in (2, 3, 4):
            assert (r.n_words, r.runs, r.collapsed) == (0, [], "")
        elif r.doc_id in (5, 6, 9):
            assert (r.runs, r.collapsed) == ([], " ".join(WORD.findall(TEXTS[r.doc_id])))
    # one very long text and many of a few words share a slice
    long = spark.createDataFrame([(1, "a b c " * 60_000), (2, "x"), (3, "a b c " * 8), (4, "a b c " * 8 + "a"), (5, "a b c " * 7 + "a b")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.find_runs(long).collect()} == {1: [(0, 180_000, 3)], 2: [], 3: [(0, 24, 3)], 4: [(0, 25, 3)], 5: []}


def test_query_of_runs(spark, sf):
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    assert rows.keys() == docs.keys()
    for i in sorted(docs)[:60]:
        w, h = WORD.findall(docs[i] or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + math.floor((n - a) / (3 + g % 8))
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        if len(w) > 800:
            continue
        runs = runs_by_force(w)
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for j, x in enumerate(w) if j not in gone)))
        r = rows[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want


# --- pattern packing ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pattern_packing.public_words())


def test_words_are_encoded_as_whole_texts(tokenizer):
    enc = pattern_packing.WordEncoder(pattern_packing.public_words())
    marks = [*"aAbZ'éßİΣσςÀ²½ªµ_K’`<|>0123٣ \t\n\r\x0b\x0c\x1c\x85  　漢字한가\U0001f600.,!?", "<|endoftext|>", "<|startoftext|>", "é", "'re", "'LL", "한", "하", " ", " "]
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 60))) for _ in range(4000)] + ["", "<|endoftext|>" * 3, "x" * 5000]
    for t, got in zip(texts, enc.encode([t.encode() for t in texts])):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def fewest(lengths, capacity):
    """The least number of windows, tried exhaustively."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= lengths[k]}):
            at = rooms.index(room)
            go(k + 1, rooms[:at] + [room - lengths[k]] + rooms[at + 1 :])
        go(k + 1, rooms + [capacity - lengths[k]])

    go(0, [])
    return best


def check_plan(histogram, capacity):
    groups, used = pattern_packing.plan(histogram, capacity), collections.Counter()
    for times, holds in groups:
        assert times > 0 and 0 < sum(n * c for n, c in holds.items()) <= capacity
        for n, c in holds.items():
            used[n] += times * c
    assert used == collections.Counter({n: c for n, c in histogram.items() if c})
    return sum(t for t, _ in groups)


def test_plans_use_every_piece_and_few_windows():
    rnd = random.Random(7)
    for _ in range(60):
        capacity = rnd.randint(6, 40)
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 9))]
        n = check_plan(collections.Counter(lengths), capacity)
        assert n <= max(fewest(lengths, capacity) + 1, math.ceil(1.1 * fewest(lengths, capacity)))
    for shape, over in ((1.0, 1.06), (3.0, 1.001)):  # uniform lengths, and mostly short ones
        histogram = {1 + int(4096 * rnd.random() ** shape): rnd.randint(1, 10**6) for _ in range(1500)}
        least = max(sum(n * c for n, c in histogram.items()) / 4096, sum(c for n, c in histogram.items() if n > 2048))
        assert check_plan(histogram, 4096) <= over * least + 1
    # lengths that only fit together as listed: all by patterns, none by best fit alone
    assert check_plan({60: 5000, 25: 5000, 15: 5000}, 100) == 5000
    assert check_plan({7: 1}, 100) == 1 and check_plan({}, 100) == 0


def test_fit_is_a_least_squares_minimum():
    rnd = random.Random(2)
    have = np.zeros(65, np.int64)
    for _ in range(30):
        have[rnd.randint(1, 64)] += rnd.randint(1, 500)
    rows = pattern_packing.patterns(have)
    x, weight = pattern_packing.fitted(rows, have, 5000), np.r_[0, np.arange(1, 65) / 64]
    slope = (weight * (np.bincount(rows.ravel(), np.repeat(x, 3), 65) - have))[rows].sum(1)
    assert (x >= 0).all() and slope.min() > -0.05 * have.max() and abs(slope[x > 1]).max(initial=0) < 0.05 * have.max()


def test_pattern_packing(spark, odd, nothing, tokenizer):
    rows = pattern_packing.pack(odd, capacity=64).collect()
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    want = collections.Counter()
    for r in odd.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            want[(r.doc_id, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert pattern_packing.pack(nothing).count() == 0


# --- ranked search ------------------------------------------------------------------------


def ranked_by_force(docs, asked, top):
    lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    found = [(i, collections.Counter(TERM.findall(lower(t)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_words = len(found), sum(c.total() for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    out = collections.Counter()
    for item, text in asked:
        scores = []
        for k, (i, c) in enumerate(found):
            m = 75 + (25 * c.total() * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in TERM.findall(lower(text)) if c[t])
            scores.append((-score, i is None, i or 0, k))
        for rank, (s, none, i, _) in enumerate(sorted(scores)[:top], 1):
            if s < 0:
                out[(item, rank, None if none else i, -s)] += 1
    return out


def searched(docs, asked, **how):
    return collections.Counter((r.item_id, r.rank, r.doc_id, r.score) for r in ranked_search.search(docs, asked, **how).collect())


@pytest.mark.parametrize("top,sent", [(20, 10**6), (3, 10**6), (1, 40)])
def test_search_is_that_of_brute_force(spark, monkeypatch, top, sent):
    """Also with terms too many to be sent at once."""
    monkeypatch.setattr(ranked_search, "MOST_SENT", sent)
    rnd = random.Random(top)
    vocab = [f"t{int(rnd.paretovariate(0.7))}" for _ in range(400)] + ["É", "naïve", "X1", "x1", "漢字"]
    text = lambda n: rnd.choice([" ", ", ", "_", "\x00"]).join(rnd.choice(vocab) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(250)]
    docs += [(1, docs[1][1]), (None, docs[2][1]), (None, None), (900, None), (901, ""), (902, "?!")] + [(1000 + i, "t1 t1 t2") for i in range(40)]
    asked = [(i, text(rnd.randint(0, 25))) for i in range(12)] + [(50, "t1 T1 t2"), (51, None), (52, "nowhere"), (None, "t3 t3 t5"), (53, docs[3][1])]
    got = searched(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "item_id long, text string"), top=top)
    assert got == ranked_by_force(docs, asked, top)


def test_search_of_odd_rows(spark, odd, nothing):
    asked = odd.withColumnRenamed("rank", "item_id")
    asked = asked.withColumn("item_id", asked["doc_id"])
    rows = searched(odd, asked)
    assert rows == ranked_by_force([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in asked.collect()], 20)
    assert searched(nothing, asked) == searched(odd, asked.limit(0)) == collections.Counter()
