"""Periodic runs against a direct search."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loamgraph.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def direct(words, least=6, times=4):
    """Every maximal run: all periods, one place after the other."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def kept(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (9, 3)])
def test_runs_of_random_texts(least, times):
    for seed in range(300):
        r = random.Random(seed)
        texts = []
        for _ in range(r.randint(1, 4)):
            words = []
            while r.random() < 0.8 and len(words) < 120:
                words += [r.choice("abc") for _ in range(r.randint(1, 7))] * r.randint(1, 9)
                words = words[: len(words) - r.randint(0, 3)]
            texts.append(words)
        first = np.append(0, np.cumsum([len(x) for x in texts]))
        start, length, period = runs.find_runs(np.array([ord(w) for x in texts for w in x], np.int64), first, least, times)
        expected = [(s + int(first[i]), n, q) for i, x in enumerate(texts) for s, n, q in direct(x, least, times)]
        assert list(zip(start.tolist(), length.tolist(), period.tolist())) == expected


def test_runs_of_fibonacci_words_and_long_periods():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    word = np.array(b[:1500])
    assert list(zip(*(x.tolist() for x in runs.find_runs(word, np.array([0, 1500]), 2, 2)))) == direct(word.tolist(), 2, 2)
    tiled = np.tile(np.arange(5000), 40)
    assert [x.tolist() for x in runs.find_runs(tiled, np.array([0, len(tiled)]))] == [[0], [200_000], [5000]]


def test_operator_on_odd_texts(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "日 本\n日\t本 日  本 日 本 é", "x " * 50_000, "p q r s " * 3 + "p q r"]
    rows = [(i, x, "s", 1, 2, 3) for i, x in enumerate(texts)] + [(None, "b b b b b b b", "s", 1, 2, 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int, length int, period int")
    got = sorted(runs.periodic_runs(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == len(rows)
    for r, (doc, text, *_) in zip(got, rows):
        words = WORD.findall(text or "")
        found = direct(words)
        assert (r.doc_id, [tuple(x) for x in r.runs], r.collapsed) == (doc, found, kept(words, found))
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    assert runs.run_digests(runs.periodic_runs(docs)).where("n_runs = 0 AND start IS NULL AND length IS NULL AND period IS NULL AND exponent_milli IS NULL").count() == 6
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, times=1)


def test_query_equals_direct_search(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    some = 0
    for doc, text in docs:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        if n > 4000:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = direct(words)
        some += len(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        expected = (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept(words, found).encode()).hexdigest())
        r = got[doc]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected
    assert some > 5
