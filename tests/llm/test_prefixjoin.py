"""The grouped prefix join against all pairs of sets, and on odd tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pseudoveil.llm import prefixjoin
from pseudoveil.llm.prefixjoin import jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "doc_id long, text string, n long, s1 string, node long, comp string, salt int, token string, prefix string"


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def plain(rows, k=3, percent=90):
    """(doc_id, size, smallest reachable doc_id) of every row, by all pairs."""
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                u, v = sorted((root(i), root(j)))
                top[v] = u
    return sorted(((i, len(shingles(t, k)), root(i) if i is not None else None) for i, t in rows), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def varied(rng, words, n, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(n)}"
    return " ".join(out)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for size in (5, 12, 40, 41, 60, 200):
        for _ in range(4):
            base = [rng.choice(vocab) for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3, 5):
                rows.append((i := i + 1, varied(rng, base, 5, edits)))
            rows.append((i := i + 1, " ".join(base[:-1])))                    # the same prefixes with another size
            rows.append((i := i + 1, " ".join(base + base[:3])))
    rows += [(i := i + 1, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 6)))) for _ in range(60)]
    return rows


@pytest.mark.parametrize("percent,k", [(90, 3), (80, 2), (60, 1)])
def test_components_match_all_pairs(spark, percent, k):
    rows = corpus(percent)
    assert result(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, percent)) == plain(rows, k, percent)


def test_a_crowd_of_near_copies_and_chains(spark):
    """Many near copies of one text, linked by a chain of small steps, beside unlinked texts that share a passage."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows, now = [], list(base)
    for i in range(60):                                                       # a chain: its ends differ in everything
        now = now[:]
        now[(3 * i) % 80] = f"c{i}"
        rows.append((i, " ".join(now)))
    rows += [(100 + i, varied(rng, base, 1000, 1)) for i in range(120)]
    rows += [(300 + i, " ".join(base[:70] + [f"u{i}x{j}" for j in range(12)])) for i in range(60)]
    assert result(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))) == plain(rows)


def test_groups_with_members_that_do_not_link(spark, monkeypatch):
    """One cell for all tokens: equal prefixes with different rests, and no help from frequencies."""
    monkeypatch.setattr(prefixjoin, "STARS", 0)                               # everything by expansion
    rng = random.Random(9)
    rows = [(i, " ".join(sorted({f"w{rng.randrange(14)}" for _ in range(11)}))) for i in range(150)]
    assert result(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80)) == plain(rows, 1, 80)


def test_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (5, "ONE  two"), (6, "two one"), (None, "one two"), (None, None),
            (7, "a b c d " * 5000), (8, "d a b c " * 5000), (9, "É b c"), (10, "é b c")]
    out = result(jaccard_components(spark.createDataFrame([(*r, 1, "s", 2, "c", 3, "t", "p") for r in rows], CLASHING)))
    want = {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, None: None, 7: 7, 8: 7, 9: 9, 10: 10}
    assert len(out) == len(rows) and all(want[i] == c for i, _, c in out)
    assert {(i, n) for i, n, _ in out} >= {(1, 0), (2, 0), (3, 0), (4, 1), (7, 4), (8, 4), (9, 1), (None, 0), (None, 1)}
    assert result(jaccard_components(spark.createDataFrame([], CLASHING))) == []
    twice = [(1, "a b c d e"), (1, "p q r s t"), (2, "p q r s t")]            # rows of one id, each by its own text
    assert result(jaccard_components(spark.createDataFrame(twice, "doc_id long, text string"))) == [(1, 3, 1), (1, 3, 1), (2, 3, 1)]


def test_sets_are_distinct_shingles():
    texts = ["a b c a b c a b c", None, "x", "A b C"]
    doc, h, n = prefixjoin.shingle_sets(pa.array(texts), 3)
    assert n.tolist() == [3, 0, 1, 1]
    assert set(h[doc == 0].tolist()) == {xxhash.xxh64_intdigest(s, seed=42) for s in (b"a b c", b"b c a", b"c a b")}
    assert h[doc == 3].tolist() == [xxhash.xxh64_intdigest(b"a b c", seed=42)]
    one, two = prefixjoin.names(np.r_[h, h[::-1]], np.array([len(h), len(h)]))
    assert one[0] == one[1] and two[0] == two[1]                               # whatever the order


@pytest.mark.parametrize("percent", [90, 75])
def test_linked_sets_share_a_part(percent):
    """Pairs at the very threshold, of all sizes, bands and size differences."""
    rng = np.random.default_rng(percent)
    for n in [*range(1, 60), 100, 151, 339, 1000]:
        for small in {n, n - 1, -(-n * percent // 100)} - {0}:
            common = next(c for c in range(small + 1) if 100 * c >= percent * (n + small - c)) if 100 * small >= percent * n else None
            if common is None:
                continue
            pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 10, dtype=np.uint64))
            rng.shuffle(pool)
            a, b = np.sort(pool[:n]), np.sort(np.r_[pool[:common], pool[n:n + small - common]])
            keys, k = prefixjoin.part_keys(np.r_[a, b], np.array([len(a), len(b)]), percent)
            assert k.sum() == len(keys) and set(keys[:k[0]]) & set(keys[k[0]:])
