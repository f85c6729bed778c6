"""SimHash groups against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from loamgraph.llm import queries, simhash
from loamgraph.operators.components import _unite

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(x):
    """The first place of each one's component, from all pairs."""
    return _unite(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3))


def groups(rows):
    """Expected rows of (id, text)."""
    x = np.array([fingerprint(t) for _, t in rows], np.uint64)
    root, least = roots(x), {}
    for (i, _), g in zip(rows, root.tolist()):
        least[g] = min((v for v in (least.get(g), i) if v is not None), default=None)
    return sorted(((i, f"{int(f):016x}", least[g]) for (i, _), f, g in zip(rows, x, root.tolist())), key=str)


def clusters(kind):
    r = random.Random(7)
    if kind == "clusters":
        out = []
        for _ in range(6):
            base = r.getrandbits(64)
            for _ in range(150):
                x = base
                for _ in range(r.randint(0, 9)):
                    x ^= 1 << r.randrange(64)
                out.append(x)
    elif kind == "one half":
        out = [(r.getrandbits(32) & 0x000F00FF) << 32 | 0x1234567 for _ in range(1200)] + [(r.getrandbits(32) & 0x0FFF0000) | 7 << 40 for _ in range(1200)]
    else:
        out = [0, (1 << 64) - 1, 1 << 63, 7, 15, 1 << 31 | 1 << 32 | 1 << 63] + [r.getrandbits(64) for _ in range(300)]
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("limit", [4096, 30])
@pytest.mark.parametrize("kind", ["clusters", "one half", "far apart"])
def test_links_join_what_all_pairs_join(spark, monkeypatch, kind, limit):
    monkeypatch.setattr(simhash, "LIMIT", limit)
    x = clusters(kind)
    number = {v: i for i, v in enumerate(x.view(np.int64).tolist())}
    rows = simhash.linked(spark.createDataFrame([(v,) for v in number], "fp long")).collect()
    i, j = (np.array([number[r[k]] for r in rows], np.int64) for k in (0, 1))
    every = np.arange(len(x))
    assert np.array_equal(_unite(np.append(every, i), np.append(every, j)), roots(x))


def test_flips_equal_blocks():
    r = random.Random(3)
    for group in (5 << 53 | 19 << 16, 40 << 53 | 3 << 16, 63 << 53 | 16 << 16):
        free = simhash.free_bits(group)
        assert len(set(free)) == 18
        for n in (40, 3000):
            x = np.unique(np.array([sum((v >> t & 1) << bit for t, bit in enumerate(free)) for v in r.sample(range(1 << 18), n)], np.uint64))
            assert np.array_equal(simhash._by_flips(x, free), simhash._blockwise(x))
            assert np.array_equal(simhash._blockwise(x), roots(x))


def test_finer_variants_keep_to_their_free_bits(spark):
    x = clusters("one half")[:200].view(np.int64).tolist()
    rows = simhash.finer(simhash.variants(spark.createDataFrame([(v,) for v in x], "fp long"))).collect()
    seen = {}
    for fp, group in rows:
        mask = (1 << 64) - 1 - sum(1 << b for b in simhash.free_bits(group))
        assert seen.setdefault(group, fp & mask) == fp & mask


def test_groups_of_odd_texts(spark):
    r = random.Random(1)
    long = " ".join(f"w{r.randint(0, 5000)}" for _ in range(9000))
    texts = [None, "", " \n", "One", "one", "one  TWO", "One two", "x" * 100_000, long, long + " end", long.upper(), "日本 é 🙂 Ä", "a b c a b c a b c"]
    rows = [(i, x) for i, x in enumerate(texts)] + [(None, "one"), (None, "lonely"), (3, "One"), (20, "same id"), (20, "other text")]
    docs = spark.createDataFrame([(*x, 1, "c", 2) for x in rows], "doc_id long, text string, fp int, component string, key int")
    got = sorted((tuple(x) for x in simhash.simhash_groups(docs).collect()), key=str)
    assert got == groups(rows)
    assert {c for i, _, c in got if i in (0, 1, 2)} == {0} and {c for i, _, c in got if i in (8, 9, 10)} == {8}
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_query_equals_all_pairs(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(x) for x in queries.op11_simhash_groups(spark, SF).collect()), key=str) == groups(rows)
