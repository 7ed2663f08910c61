"""Repeated strings against a plain search for every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import queries as Q
from riskloom.llm import repeats
from tests.llm.test_text_jobs import clashing, got


def plain(rows, length=100):
    """rows in order of precedence."""
    first, out = {}, []
    for k, (i, t) in enumerate(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first.setdefault(b[p : p + length], (k, p)) != (k, p):
                gone[p : p + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("doc_id", *repeats.FOUND)


def test_all_documents(spark, sf, sf_rows):
    want = plain(sorted(sf_rows))
    assert got(Q.op7_repeats(spark, sf), *COLUMNS) == want and sum(w[2] > 0 for w in want) > 10


def test_families(spark):
    """Near copies that share parts of every length, periodic texts, and keys with many different copies."""
    rng = random.Random(1)
    letters = "abcd "
    passages = ["".join(rng.choice(letters) for _ in range(n)) for n in (99, 100, 101, 130, 260, 400)]
    rows = []
    for i in range(120):
        t = ""
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            t += p[a if rng.random() < .4 else 0 :] + "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        if rng.random() < .3 and t:
            k = rng.randrange(len(t))
            t = t[:k] + "é" + t[k + 1 :]
        if rng.random() < .1:
            t += "ab" * rng.randrange(200) + "z" * rng.randrange(250)
        rows.append((i, t))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain(rows)
    assert got(repeats.digest(docs), *COLUMNS) == want
    for most, length in ((2, 100), (20_000, 64)):
        r, marks = repeats.repeated(docs, length=length, most_copies=most)
        found = {m.d: m.marks for m in marks.collect()}
        by = {w[0]: w for w in plain(rows, length)}
        for i, t in rows:
            cut = repeats.cut_ranges(t.encode(), [tuple(m) for m in found.get(i, ())], length)
            assert (sum(b - a for a, b in cut), len(cut)) == by[i][2:4]


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    distinct = list(dict.fromkeys((r[0], r[1]) for r in odd_rows))
    ties = {(r.doc_id, r.text): r.h for r in odd_docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(distinct, key=lambda r: (r[0] is not None, r[0] or 0, ties[r]))
    by = dict(zip(order, _in_order(order)))
    assert got(repeats.digest(clashing(odd_docs)), *COLUMNS) == sorted((by[r[:2]] for r in odd_rows), key=str)
    assert repeats.digest(no_docs).collect() == []


def _in_order(order):
    marked = plain([((k, i), t) for k, (i, t) in enumerate(order)])
    by = {w[0][0]: w for w in marked}
    return [(by[k][0][1], *by[k][1:]) for k in range(len(order))]


def test_slices_of_a_long_text(monkeypatch):
    monkeypatch.setattr(repeats.Anchors, "SLICE", 500)
    rng = random.Random(2)
    text = bytes(rng.choice(b"abc") for _ in range(3000))
    key, own, at, first, n = repeats.Anchors(100, 24).of(text)
    assert sorted(i for f, c in zip(first.tolist(), n.tolist()) for i in range(f, f + c)) == list(range(2901))
    assert all(f <= a <= f + 76 for a, f in zip(at.tolist(), first.tolist()))


def test_no_group_of_equal_windows_is_gathered(spark, monkeypatch):
    """A passage that many rows share in different surroundings: a task sees at most ``most_copies`` texts of a group."""
    real, most = repeats._matched, 30

    def watched(length):
        run = real(length)

        def look(batches):
            held = list(batches)
            seen = Counter(k for b in held for k in zip(*(b.column(i).to_pylist() for i in range(b.num_columns) if b.schema.names[i] in ("key", "part"))))
            assert max(seen.values(), default=0) <= most, seen.most_common(1)
            yield from run(iter(held))

        return look

    monkeypatch.setattr(repeats, "_matched", watched)
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = some(230), some(150)
    rows = [(i, some(rng.randrange(90, 140)) + (passage if i % 3 else other) + some(rng.randrange(90, 140))) for i in range(300)]
    rows += [(None, some(50) + passage), (300, passage + passage), (301, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {w[0]: w for w in plain(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))}
    parts, marks = repeats.repeated(docs, most_copies=most)
    found = {m.d: m.marks for m in marks.collect()}
    for i, t in rows:
        cut = repeats.cut_ranges(t.encode(), [tuple(m) for m in found.get(i, ())], 100)
        assert (sum(b - a for a, b in cut), len(cut)) == want[i][2:4]
    assert sum(w[2] > 100 for w in want.values()) > 250


@pytest.mark.parametrize("hashes", [2**64 - 1, 3])
def test_longest_previous_factors(monkeypatch, hashes):
    """Against every earlier start, with texts that repeat, nest and run out of different letters, and with hashes that collide."""
    mix = repeats._mix
    monkeypatch.setattr(repeats, "_mix", lambda h: mix(h) & np.uint64(hashes))
    rng = random.Random(4)
    for n, letters, length in ((1, b"a", 8), (60, b"a", 20), (200, b"ab", 9), (300, b"ab", 100), (400, b"abcdefgh", 16), (250, bytes(range(256)), 12)):
        some = bytes(rng.choice(letters) for _ in range(n))
        text = some + some[n // 3 :] + b"\x00" * length + some
        starts = np.arange(len(text) - length + 1)
        chosen = starts[[rng.random() < .8 for _ in starts]]
        found = repeats.previous_factors(np.frombuffer(text, np.uint8), chosen, length)

        def alike(i, j):
            k = 0
            while k < length and text[i + k] == text[j + k]:
                k += 1
            return k

        strings = Counter(text[i : i + length] for i in chosen.tolist())
        assert hashes == 3 or (found[[strings[text[i : i + length]] == 1 for i in chosen.tolist()]] == 0).all()
        again = np.array([strings[text[i : i + length]] > 1 for i in chosen.tolist()])
        if hashes == 3:
            assert ((found == length) == [text[i : i + length] in {text[j : j + length] for j in chosen[:x].tolist()} for x, i in enumerate(chosen.tolist())]).all()
            continue
        found, chosen = found[again], chosen[again]
        places = chosen.tolist()
        assert found.tolist() == [max((alike(i, j) for j in places[:x]), default=0) for x, i in enumerate(places)]


def test_heavy_keys_are_dealt(spark):
    rows = [(i % 3 if i % 2 else 7, i, i, 0, i << 16 | 256 * (i % 5)) for i in range(400)] + [(99, 1, 1, 0, 5)]
    anchors = spark.createDataFrame(rows, "key long, own long, doc long, tie long, at long")
    keys = spark.createDataFrame([(7, 200, True), (0, 67, True), (1, 67, False), (2, 66, True)], "k long, n long, mixed boolean")
    want = sorted((*r, r[0] != 1) for r in rows if r[0] != 99)
    for least, most in ((1000, 10), (20, 100), (1, 1_000_000)):
        assert sorted(map(tuple, repeats._of_keys(anchors, keys, least, most).collect())) == want
