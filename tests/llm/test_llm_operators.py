"""Operators of ``pseudoveil.llm`` against plain Python versions and on edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pseudoveil.llm import (decontaminate, langid, linededup, ngram, packing, pagetext, repetition, secrets, simhash, storage,
                            substrings, words)

SCHEMA = "doc_id long, text string, source string, lang string, body string, row long, n_words long, block string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "Short item"), (3, ""), (4, None), (5, "short ITEM")]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def clash(spark, rows):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "s", "en", "x", 7, 7, "b") for i, t in rows], SCHEMA)


def operators(spark):
    bench = frame(spark, BENCH, "item_id long, text string")
    return {
        "secrets": lambda d: secrets.scan_secrets(d),
        "simhash": lambda d: simhash.near_duplicates(d),
        "ngram": lambda d: ngram.score(d, F.when(F.col("doc_id") % 3 == 0, 0).when(F.col("doc_id") % 3 == 1, 2).otherwise(1)),
        "substrings": lambda d: substrings.dedupe_substrings(d, 50),
        "langid": lambda d: langid.identify(d, langid.train(d)),
        "quality": lambda d: repetition.quality(d),
        "lines": lambda d: linededup.dedupe_lines(d),
        "benchmark": lambda d: decontaminate.contamination(d, bench),
        "pack": lambda d: packing.pack(d, **packing.vocabulary()).where("start = 0"),
    }


NAMES = ["secrets", "simhash", "ngram", "substrings", "langid", "quality", "lines", "benchmark", "pack"]
LONG = "the quick brown fox jumps over the lazy dog " * 6000 + "é" * 5000 + "word\n" * 3000


@pytest.mark.parametrize("name", NAMES)
def test_edge_cases(spark, name):
    op = operators(spark)[name]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "one two three four"), (5, "one two three four"), (None, "one two three four"),
            (6, " token = abcdef123"), (7, "İ ǅ 😀 \x00 x"), (8, "1234 ++")]
    out = op(clash(spark, rows)).select("doc_id").collect()
    assert sorted(str(r[0]) for r in out) == sorted(str(i) for i, _ in rows)
    assert op(clash(spark, [])).count() == 0


def test_repeated_rows_and_nulls_have_the_stated_results(spark):
    rows = [(1, None), (2, ""), (5, "same words in both rows"), (5, "same words in both rows")]
    d = clash(spark, rows)
    fp = simhash.near_duplicates(d).collect()
    assert {(r.doc_id, r.component_id) for r in fp} == {(1, 1), (2, 1), (5, 5)} and len(fp) == 4
    q = {r.doc_id: r for r in repetition.quality(d).collect()}
    assert q[1].n_words == 0 and q[1].base_failed and not q[1].kept
    lang = {r.doc_id: r for r in langid.identify(d, langid.train(d)).collect()}
    assert lang[1].lang_pred == lang[2].lang_pred == "und" and lang[1].score == 0
    lines = {r.doc_id: r for r in linededup.dedupe_lines(d).collect()}
    assert lines[1].text is None and lines[1].lines_total == 0 and lines[2].lines_total == 1
    packed = {r.doc_id: r for r in packing.pack(d, **packing.vocabulary()).where("doc_id < 5").collect()}
    assert packed[1].doc_tokens == packed[2].doc_tokens == 1


def test_xxh64_and_words():
    rng = random.Random(1)
    texts = ["", None, "Aé b\tC"] + ["".join(rng.choice("aB é\n😀") for _ in range(rng.randrange(300))) for _ in range(50)]
    w = words.words(pa.array(texts))
    flat = [x for t in texts for x in (t or "").encode().lower().split()]
    assert [bytes(w.buf[a:b]) for a, b in zip(w.start, w.end, strict=True)] == flat
    spans = [bytes(range(1, n % 250 + 1)) for n in range(200)]
    buf = np.frombuffer(b"".join(spans) + bytes(8), np.uint8)
    end = np.cumsum([len(s) for s in spans])
    got = words.xxh64(buf, end - np.array([len(s) for s in spans]), end, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(s, seed=42) for s in spans]


# --- 1 secrets

def test_secrets_base_spans_and_ownership(spark):
    live, copied = "Zx9" + "qWe7rTy" * 4, "Ab1" + "cDe5fGh" * 4
    rows = [(i, f"é key {copied} and password = hunter{i}xx AKIA{'Q' * 16} {'0a' * 12}", f"owner{i}") for i in range(5)]
    rows += [(9, f"token:abc {live} api_key='secretvalue'", "owner9"), (10, None, None), (11, "secret:token:abcdef", "o")]
    out = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, rows, "doc_id long, text string, source string")).collect()}
    pats = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
             lambda m: len(m[2]) >= 6), (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
            (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    for i, text, _ in rows:
        want = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(pats) for m in p.finditer(text or "") if ok(m))
        assert [(s.start, s.kind, s.end) for s in out[i].base] == want
    assert [s.kind for s in out[9].spans] == [3, 0]                  # the owner-specific token is added
    assert all(s.kind != 3 for i in range(5) for s in out[i].spans)  # the widely copied one is not
    assert out[0].n_copied == 2 and out[9].n_copied == 0
    assert out[11].n_live == 0                                       # a failing match uses up its text


def test_secrets_are_judged_by_repositories_too(spark):
    """One value in many documents of one owner is a copied example; in a few, a credential."""
    many, few = "Zx9" + "qWe7rTy" * 4, "Ab1" + "cDe5fGh" * 4
    rows = [(i, f"see {many} here", "big") for i in range(11)] + [(100 + i, f"see {few} here", "big") for i in range(10)]
    rows += [(200, f"password = {many}", "big"), (200, f"password = {many}", "big")]
    out = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i].spans == [] for i in range(11)) and all(len(out[100 + i].spans) == 1 for i in range(10))
    assert (out[100].spans[0].n_owners, out[100].spans[0].n_repos, out[100].n_live) == (1, 10, 1)
    assert (out[200].spans[0].n_repos, out[200].n_live, out[200].n_copied) == (12, 0, 1)


def test_secrets_plan_has_no_python(spark):
    d = frame(spark, [(1, "password = abcdef", "s")], "doc_id long, text string, source string")
    plan = secrets.scan(d, "doc_id", "text", "doc_id", "source")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 2 SimHash

def plain_simhash(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps, max_bits):
    ids, group = sorted(fps), {}
    for i in ids:
        if i not in group:
            todo, group[i] = [i], i
            while todo:
                x = todo.pop()
                for j in ids:
                    if j not in group and (fps[x] ^ fps[j]).bit_count() <= max_bits:
                        group[j] = i
                        todo.append(j)
    return group


def test_simhash_fingerprints(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["Aa", "bé", "c" * 40, "dd"]) for _ in range(rng.randrange(9)))) for i in range(60)]
    out = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.simhash(frame(spark, rows)).collect()}
    assert out == {i: plain_simhash(t) for i, t in rows}


@pytest.mark.parametrize("pair_limit", [1, 4, 1000])
def test_simhash_links_every_close_pair(spark, pair_limit):
    rng = random.Random(3)
    fps, n = {}, 0
    for _ in range(12):                       # clusters around random centres
        centre = rng.getrandbits(64)
        for _ in range(12):
            x = centre
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            fps[n], n = x, n + 1
    distinct = {}
    for i, x in fps.items():
        distinct.setdefault(x, i)
    d = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for x, i in distinct.items()], "fp long, node long")
    found = {r.node: r.component for r in storage.components(simhash.links(d, 2, 16, pair_limit)).collect()}
    want = plain_groups(fps, 2)
    assert all(found.get(distinct[x], distinct[x]) == want[distinct[x]] for x in distinct)


def test_pigeonring_budgets():
    assert simhash.chain_budgets(16, 2) == [0] * 7 + [1] * 8 + [2]


# --- 3 n-grams

def test_ngram_counts_and_mixture(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(vocab[min(int(rng.expovariate(.2)), 29)] for _ in range(rng.randrange(40)))) for i in range(200)]
    part = {i: 0 if i % 7 == 0 else 2 if i % 7 == 1 else 1 for i, _ in rows}
    col = F.when(F.col("doc_id") % 7 == 0, 0).when(F.col("doc_id") % 7 == 1, 2).otherwise(1)
    out = {r.doc_id: r for r in ngram.score(frame(spark, rows), col, block_bytes=2000, range_entries=100).collect()}
    tok = lambda t: t.split() + ["$end"]
    def tables(parts):
        uni, bi = collections.Counter(), collections.Counter()
        for i, t in rows:
            if part[i] in parts:
                uni.update(tok(t))
                uni["^"] += 1
                bi.update(zip(["^"] + tok(t), tok(t), strict=False))
        return uni, bi, sum(v for k, v in uni.items() if k != "^")
    uni, bi, total = tables({1, 2})
    known = len(uni) - 1
    kept_uni, kept_bi, kept = tables({1})
    w = np.full((64, 3), 1 / 3)
    w[0] = .5, .5, 0
    bucket = lambda c: 1 + int(math.log2(c)) if c else 0
    held = [(bucket(kept_uni[u]), kept_bi[u, v] / kept_uni[u] if kept_uni[u] else 0, kept_uni[v] / kept)
            for i, t in rows if part[i] == 2 for u, v in zip(["^"] + tok(t), tok(t), strict=False)]
    for _ in range(12):
        e = np.where(w > 0, .5, 0)
        for b, p2, p1 in held:
            x = w[b] * (1 / (known + 1), p1, p2)
            e[b] += x / x.sum()
        new = e / e.sum(1, keepdims=True)
        moved, w = abs(new - w).max(), new
        if moved < 1e-3:
            break
    for i, t in rows:
        base = sum(math.log10((uni[v] + 1) / (total + known + 1)) for v in tok(t))
        score = sum(math.log10(w[bucket(uni[u])] @ (1 / (known + 1), uni[v] / total, bi[u, v] / uni[u] if uni[u] else 0))
                    for u, v in zip(["^"] + tok(t), tok(t), strict=False))
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tok(t)), sum(uni[v] > 0 for v in tok(t)), total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=1e-4)


def test_ngram_without_training(spark):
    out = ngram.score(frame(spark, [(1, "a b"), (2, None)]), F.lit(0)).collect()
    assert all(r.train_tokens == 0 and r.score == 0 for r in out)


# --- 4 substrings

def plain_substrings(rows, least):
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            low[b[p:p + least]] = min(i, low.get(b[p:p + least], i))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if low[b[p:p + least]] < i:
                gone[p:p + least] = b"\1" * least
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", gone)), bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_equal_plain_version(spark, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ab é\n") for _ in range(2000))
    rows = []
    for i in range(80):
        t = ""
        for _ in range(rng.randint(0, 6)):
            a = rng.randrange(1900)
            t += base[a:a + rng.randint(1, 200)] + ("x" * rng.randint(1, 160) if rng.random() < .3 else "")
        rows.append((1000 - i if seed % 2 else 3 * i, t))
    rows += [(5000, None), (5001, "")]
    out = substrings.dedupe_substrings(frame(spark, rows), 50, block_bytes=3000, range_bytes=4000).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out} == plain_substrings(rows, 50)


def test_maximal_repeats_have_all_occurrences():
    parts = [b"XX" + b"a1b2c3d4" * 8 + b"k", b"YY" + b"a1b2c3d4" * 8 + b"m", b"ZZ" + b"a1b2c3d4" * 7 + b"n"]
    text = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    size = np.array([len(p) for p in parts])
    iv = substrings.Intervals(text, np.cumsum(size) - size, size - 49, np.zeros(3, bool), 50)
    found = {bytes(text[iv.pos[iv.sa[a]]:][:n]): sorted(iv.pos[iv.sa[a:b]].tolist()) for n, a, b in zip(*iv.maximal_repeats(), strict=True)}
    for s, at in found.items():
        assert at == [o + p for o, x in zip(np.cumsum(size) - size, parts, strict=True) for p in range(len(x)) if x[p:p + len(s)] == s]
    assert b"a1b2c3d4" * 8 in found and b"a1b2c3d4" * 7 in found


# --- 5 language

def test_langid_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    out = langid.identify(docs.where(langid.held_out()), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_ppm_code_lengths(spark):
    rows = [("abracadabra", "x"), ("banana bandana", "y"), ("abrabra", "x")]
    model = langid.train(frame(spark, rows, "text string, lang string"))
    text = "abra bananas"
    got, _ = model.code_lengths(pa.array([text]))
    def context(t, i, n):
        """The n bytes before place i: the last one, five bits of the one before, three bits of the one before that."""
        return tuple(ord(t[i - k]) & (255, 31, 7)[k - 1] for k in range(1, n + 1))

    for k, lang in enumerate(model.langs):
        counts = collections.defaultdict(collections.Counter)
        for t, l in rows:
            if l == lang:
                padded = "   " + t
                for i in range(3, len(padded)):
                    for n in range(4):
                        counts[context(padded, i, n)][padded[i]] += 1
        bits, padded = 0.0, "   " + text
        for i in range(3, len(padded)):
            for n in (3, 2, 1, 0):
                c = counts.get(context(padded, i, n))
                if not c:
                    continue
                total, kinds = sum(c.values()), len(c)
                if padded[i] in c:
                    bits -= math.log2(c[padded[i]] / (total + kinds))
                    break
                bits -= math.log2(kinds / (total + kinds))
            else:
                bits += 8
        assert got[0][k] == pytest.approx(bits, rel=1e-5)


def test_contexts_are_bounded_and_all_count(spark):
    rng = random.Random(5)
    junk = ["".join(chr(rng.randrange(33, 1200)) for _ in range(4000)) for _ in range(60)]      # a hot language full of junk
    rows = [(t, "hot") for t in junk] + [("xyz xyz", "rare"), ("zyx", "rare")]
    model = langid.train(frame(spark, rows, "text string, lang string"))
    ctx = np.unique(np.concatenate([langid.contexts(pa.array([t]))[0] for t, _ in rows]))
    assert model.third.tolist() == ctx.tolist() and 5000 < len(ctx) <= 1 << 16
    out = langid.identify(frame(spark, [(1, "xyz zyx xyz"), (2, junk[0])]), model).collect()
    assert {r.doc_id: r.lang_pred for r in out} == {1: "rare", 2: "hot"}


# --- 6 repetition

def test_repetition_figures(spark):
    rng = random.Random(6)
    rows = []
    for i in range(80):
        lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 8))]
        rows.append((i, "\n".join(lines + rng.sample(lines, len(lines) // 3)) + rng.choice(["", " #é|"])))
    out = {r.doc_id: r for r in repetition.quality(frame(spark, rows)).collect()}
    for i, t in rows:
        w, r = WORD.findall(t), out[i]
        def inside(k):
            c = collections.Counter(tuple(w[j:j + k]) for j in range(len(w) - k + 1))
            hit = [False] * len(w)
            for j in range(len(w) - k + 1):
                if c[tuple(w[j:j + k])] > 1:
                    hit[j:j + k] = [True] * k
            return hit
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        chars = sum(map(len, w))
        longest = max((n for n in range(8, len(w)) if any(inside(n))), default=0)
        at = max((sum(map(len, w[j:j + longest])) for j in range(len(w) - longest + 1)
                  if collections.Counter(tuple(w[q:q + longest]) for q in range(len(w) - longest + 1))[tuple(w[j:j + longest])] > 1), default=0) if longest else 0
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), chars, dup, sum(inside(5)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        assert r.covered == pytest.approx(sum(len(x) for x, y in zip(w, inside(8), strict=True) if y) / max(chars, 1))
        assert r.longest >= at / max(chars, 1) - 1e-9


def plain_repeats(w, least):
    """(start places, length) of every maximal repeat of a word list."""
    places = collections.defaultdict(list)
    for n in range(least, len(w)):
        for j in range(len(w) - n + 1):
            places[tuple(w[j:j + n])].append(j)
    for t, at in places.items():
        before, after = [w[j - 1] if j else None for j in at], [w[j + len(t)] if j + len(t) < len(w) else None for j in at]
        if len(at) > 1 and (len(set(before)) > 1) and (len(set(after)) > 1):
            yield at, len(t)


def test_maximal_repeats_equal_plain_version_beside_longer_ones():
    rng = random.Random(66)
    phrase = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    head, tail = phrase(8), phrase(4)                       # places A < C < B: A and B agree for 12 words, C for 8
    texts = [head + tail + ["a"] + phrase(3) + head + ["c"] + phrase(3) + head + tail + ["b"] + phrase(2)]
    for n in (16, 32):
        again = phrase(n)
        texts.append(again + phrase(2) + again + phrase(2))
    for _ in range(60):                                     # occurrences of one phrase, cut to several lengths
        long, w = phrase(40), phrase(3)
        for _ in range(rng.randint(2, 6)):
            a = rng.randrange(20)
            w += long[a:a + rng.randint(5, 40)] + phrase(rng.randint(0, 3))
        texts.append(w)
    texts += [[rng.choice("ab") for _ in range(60)] for _ in range(20)]
    m = repetition.measure(pa.array([" ".join(w) for w in texts]), 5, 8)
    for i, w in enumerate(texts):
        found = list(plain_repeats(w, 8))
        size = sum(map(len, w))
        cover = {j + k for at, n in found for j in at for k in range(n)}
        assert m["n_repeats"][i] == len(found)
        assert m["longest"][i] * size == pytest.approx(max((sum(map(len, w[at[0]:at[0] + n])) for at, n in found), default=0))
        assert m["covered"][i] * size == pytest.approx(sum(len(w[k]) for k in cover))


def test_innermost_intervals_and_one_repeated_word():
    import time
    rng = random.Random(13)
    for _ in range(200):
        found, n = [], 30
        def nest(a, b, depth):
            while a + 1 < b:
                x = rng.randint(a, b - 1)
                y = rng.randint(x + 1, b)
                if y - x < b - a or depth == 0:
                    found.append((depth + rng.randint(1, 3), x, y))
                    nest(x, y, found[-1][0])
                a = y
        nest(0, n, 0)
        want = [max([d for d, x, y in found if x <= i < y], default=0) for i in range(n)]
        rng.shuffle(found)
        assert repetition.innermost(found, n).tolist() == want
    t0 = time.time()
    m = repetition.measure(pa.array(["word " * 120_000]), 5, 8)
    assert m["covered"][0] == 1 and time.time() - t0 < 8


# --- 7 lines

def plain_lines(rows, min_chars):
    lines = {i: t.split("\n") for i, t in rows}
    places, gone = collections.defaultdict(list), collections.defaultdict(set)
    for i in sorted(lines):
        for p, x in enumerate(lines[i]):
            best = 0
            for j, q in places[x]:
                n = 0
                while p + n < len(lines[i]) and q + n < len(lines[j]) and lines[i][p + n] == lines[j][q + n]:
                    n += 1
                best = max(best, n)
            if best and sum(len(y.strip(" ")) for y in lines[i][p:p + best]) >= min_chars:
                gone[i] |= set(range(p, p + best))
            places[x].append((i, p))
    return {i: "\n".join(x for p, x in enumerate(v) if p not in gone[i]) for i, v in lines.items()}


def test_line_runs_equal_plain_version(spark):
    rng = random.Random(7)
    rows = [(i, "\n".join(rng.choice(["a", "bb", "", "ccc", "dddddddd"]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    out = {r.doc_id: r.text for r in linededup.dedupe_lines(frame(spark, rows), min_chars=8).collect()}
    assert out == plain_lines(rows, 8)


# --- 8 benchmark

def plain_hits(text, items, window=10):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pat.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        x = split(t)
        for j in range(max(1, len(x) - window + 1) if x else 0):
            k = x[j:j + window]
            for p in range(len(w) - len(k) + 1):
                if w[p:p + len(k)] == k:
                    hit |= set(range(p, p + len(k)))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [10_000, 3])
def test_benchmark_hits(spark, block_words):
    rng = random.Random(8)
    vocab = ["the", "of", "x1", "Straße", "a", "b"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([3, 12, 15, 1, 10, 2, 30])] + [(90, None), (91, "?!")]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(30)) + ". " + (rng.choice(items)[1] or "")) for i in range(40)] + [(99, None)]
    out = decontaminate.contamination(frame(spark, rows), frame(spark, items, "item_id long, text string"), block_words=block_words)
    got = out.select("doc_id", "n_words", decontaminate.hit_words(F.col("spans")).alias("n"), "items").collect()
    assert {r.doc_id: (r.n_words, r.n, sorted(set(r["items"]))) for r in got} == {i: plain_hits(t, items) for i, t in rows}


def test_benchmark_proximity_and_empty(spark):
    rows = [(1, "one two extra three four five"), (2, "one two three four five")]
    items = frame(spark, [(1, "one two three four five")], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.contamination(frame(spark, rows), items, slop=1).collect()}
    assert out[1].near == [1] and out[1]["items"] == [] and out[2]["items"] == [1] and out[2].near == []
    none = decontaminate.contamination(frame(spark, rows), items.where("false")).collect()
    assert all(r.spans == [] for r in none) and len(none) == 2


# --- 9 pages

def test_page_markup():
    page = """<html><head><title>T</title></head><body class="with-sidebar"><header><h1>Site</h1></header><div class=menu>Home</div>
    <div class="cookie-notice">We use cookies</div><article><header><h1>Title &amp; more</h1></header><p>Body <b>bo</b>ld<p>Second&nbsp;para<br>line
    <div class="ad">Buy</div><ul><li>one<li>two</ul><form>Sign up</form><section id="comments"><p>nice</section></article>
    <aside>side</aside><footer>(c)</footer><script>var a = "</p>"</script></body></html>"""
    own = pagetext.Lines(page)
    assert pagetext.main_text(own, [False] * len(own.text)) == "Title & more Body bold Second para line one two"


@pytest.mark.parametrize("odd, inside", [
    ('<svg class="icon"/>', ""), ("<math />", ""), ("<svg><path d='M0'/>", ""), ("<svg><svg/><g><svg>a</svg>b</g></svg>", ""),
    ("<datalist><option>a<option>b</datalist>", ""), ("<select><option>a<option>b</select>", "a b"), ("<option>a", "a"),
    ("<object data=x>", ""), ("<object><p>other</p></object>", "other"), ("<canvas>", ""), ("<canvas>bars</canvas>", "bars"),
    ("<template>", ""), ("<template>a<template>b</template>c</template>", ""), ("<noscript>", ""), ("<iframe src=x>", ""),
    ("<iframe src=x>no frames</iframe>", ""), ("<title>", ""), ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "x=1"),
    ("<script>var a='<svg>'</script>", ""), ("<style>p{}</style>", ""), ("<textarea><p>a</textarea>", ""), ("<!-- </svg><svg> -->", "")])
def test_page_text_behind_unusual_elements_stays(odd, inside):
    page = f"<body><nav>Home</nav><article><h1>Title</h1><p>One.</p>{odd}<p>Two.</p><svg><text>t</text></svg><p>Three.</p></article></body>"
    own = pagetext.Lines(page)
    assert pagetext.main_text(own, [False] * len(own.text)) == " ".join(f"Title One. {inside} Two. Three.".split())


def test_page_ends_after_an_open_script():
    assert pagetext.Lines("<p>One.<script>var a = 1;<p>Two.").text == ["One."]
    assert pagetext.Lines("<p>a <math><mi>x</mi></math> b <object>c</object> d</p><p>e").text == ["a x b c d", "e"]


def test_unended_elements_take_linear_time():
    own = pagetext.Lines("<article>" + "<svg><template><p>a</p>" * 20_000)
    assert len(own.text) == 20_000


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = pagetext.shared_lines(a, b)
        rest = iter(b)
        assert sum(got) == best[-1][-1] and all(x in rest for x, k in zip(a, got, strict=True) if k)


def test_long_pages_are_aligned_in_linear_memory(monkeypatch):
    rng = random.Random(19)
    pairs = [([rng.randrange(9) for _ in range(rng.randrange(60))], [rng.randrange(9) for _ in range(rng.randrange(60))]) for _ in range(150)]
    whole = [sum(pagetext.shared_lines(a, b)) for a, b in pairs]
    monkeypatch.setattr(pagetext, "WALK", 20)
    for (a, b), n in zip(pairs, whole, strict=True):
        got = pagetext.shared_lines(a, b)
        rest = iter(b)
        assert sum(got) == n and all(x in rest for x, k in zip(a, got, strict=True) if k)


def test_planted_site_lines_inside_articles_go(spark):
    """Menus and share bars without class names, inside and outside the article: recall and precision of the deletion."""
    rng = random.Random(23)
    words = [f"word{i}" for i in range(400)]
    said = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(6, 15))) + rng.choice([".", "?", "!"])
    common = said()                                                                    # a sentence that many articles share
    rows, want = [], {}
    for i in range(60):
        body = [f"Title of {words[i]}"] + [said() for _ in range(8)] + ([common] if i % 2 else []) + [said()]
        inner = [f"<p>{t}</p>" for t in body]
        inner[3:3] = ["<div>Share this story</div>", "<div><a href=/x>Read more</a></div>"]
        page = "<body><div>Home</div><div>News</div><article>" + "".join(inner) + "<p>Tags and topics</p></article><div>All rights reserved</div></body>"
        rows.append((i, f"https://h.example/{i % 3}/{i:03d}", page))
        want[i] = " ".join(body)
    out = {r.page_id: r.text for r in pagetext.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert out == want


def test_pages_lose_lines_shared_with_the_nearest_url(spark):
    page = "<body><div>Site line</div><p>Own text {0}.</p><p>More {0}.</p><div>Bottom line</div></body>"
    rows = [(i, f"https://h.example/a/{i}", page.format(i)) for i in range(1, 4)]
    rows += [(7, None, page.format(7)), (8, "https://alone.example/x", page.format(8)), (9, "https://h.example/a/9", None), (10, "", "")]
    rows += [(20, "https://m.example/1", page.format("same")), (21, "https://m.example/2", page.format("same"))]
    out = {r.page_id: r for r in pagetext.extract(frame(spark, rows + rows[:1], "page_id long, url string, html string")).collect()}
    assert out[1].text == "Own text 1. More 1." and out[2].text == "Own text 2. More 2."
    assert out[8].text == "Site line Own text 8. More 8. Bottom line" and out[9].text == "" and out[10].n_chars == 0
    assert out[20].text == out[21].text == "Site line Own text same. More same. Bottom line"
    assert pagetext.extract(frame(spark, [], "page_id long, url string, html string, part string, host string")).count() == 0


def test_neighbours_do_not_depend_on_partitions(spark):
    rng = random.Random(10)
    keys = [(i, 1, 1, "h" if i % 3 else "g", f"/{rng.randrange(99)}/{i}") for i in range(200)]
    d = spark.createDataFrame(keys, "page_id long, url_hash long, html_hash long, host string, path string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append({r.page_id: r.n_page_id for r in pagetext.neighbours(d).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) == 200


def test_neighbours_are_the_nearest_different_pages(spark):
    rng = random.Random(11)
    rows = sorted(("h" if i % 3 else "g", f"/{i:03d}") for i in range(150))
    seqs = [n for _ in range(60) for n in [rng.randrange(4)] * rng.choice([1, 2, 40])][:150]
    keys = [(i, 1, 1, h, p, q) for i, ((h, p), q) in enumerate(zip(rows, seqs, strict=True))]
    want = {}
    for i, _, _, h, p, q in keys:
        sides = [next((j for j in span if keys[j][3] != h or keys[j][5] != q), None) for span in (range(i - 1, -1, -1), range(i + 1, len(keys)))]
        sides = [j for j in sides if j is not None and keys[j][3] == h]
        if sides:
            want[i] = min(sides, key=lambda j: sum(a != b for a, b in zip(p, keys[j][4], strict=True)))
    d = spark.createDataFrame(keys, "page_id long, url_hash long, html_hash long, host string, path string, seq long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found = {r.page_id: r.n_page_id for r in pagetext.neighbours(d).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert found.keys() == want.keys()
        dist = lambda i, j: sum(a != b for a, b in zip(keys[i][4], keys[j][4], strict=True))
        assert all(keys[j][3] == keys[i][3] and keys[j][5] != keys[i][5] and dist(i, j) <= dist(i, want[i]) for i, j in found.items())


def test_copies_in_a_row_lose_the_lines_of_the_site(spark):
    page = "<body><div>Site line</div><p>Own text {0}.</p><div class=ad>Ad {1}</div><div>Bottom line</div></body>"
    rows = [(i, f"https://h.example/a/{i}", page.format("same", i)) for i in range(1, 6)] + [(7, "https://h.example/b", page.format("other", 7))]
    out = {r.page_id: r.text for r in pagetext.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert out == {i: "Own text same." for i in range(1, 6)} | {7: "Own text other."}


def test_text_around_an_article():
    own = pagetext.Lines("<main><h1>Title</h1><p>Share</p><article><p>Body one</p></article></main><p>Open</p>")
    assert pagetext.main_text(own, [False, True, False, False]) == "Title Body one"
    own = pagetext.Lines("<div>Site</div><p>The long text of the page itself.</p><article>Teaser</article>")
    assert pagetext.main_text(own, [True, False, False]) == "The long text of the page itself. Teaser"
    assert pagetext.main_text(own, [False] * 3) == "Teaser"
    own = pagetext.Lines("<article><h1>Headline</h1><p>Body</p></article>")
    assert pagetext.main_text(own, [True, False]) == "Headline Body"


# --- 10 packing

def plain_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tok.encode_special_tokens = True
    return {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}


def check_packed(rows, ids):
    """Every id in one piece, sequences gapless and of a length that needs no padding."""
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(ids[i][at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].sequence_length <= 2048 and at & (at - 1) == 0
    return by_doc, by_seq


def test_packing_is_gapless_and_ids_are_the_tokenizers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(90000, None), (90001, ""), (90002, "<|endoftext|> İ😀  \r\n\t 's 'LL ￿ a" * 50), (90003, "aé" * 30000),
           (90004, "a " + " " * 60_000 + "\n b" + "\t" * 9000), (90005, " " * 4990 + "x" * 4990 + "\n" * 4990 + "'s")]
    docs = docs.union(frame(spark, odd))
    by_doc, by_seq = check_packed(packing.pack(docs, **packing.vocabulary()).collect(), plain_ids({r.doc_id: r.text for r in docs.collect()}))
    pieces = sum(map(len, by_doc.values()))
    assert pieces < 1.6 * len(by_doc) + sum(p[0].doc_tokens // 2048 for p in by_doc.values())


def test_packing_takes_runs_of_millions(spark):
    rows = [(1, " " * 1_000_000), (2, "word" * 250_000), (3, "é" * 300_000 + " " * 300_000 + "x")]
    check_packed(packing.pack(frame(spark, rows), **packing.vocabulary()).collect(), plain_ids(dict(rows)))


def plain_packing(lengths, capacity):
    """Sequences as lists of (document, start, length): the stated rules on lists."""
    done, bins, short = [], {}, []
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            done.append([(doc, at, capacity)])
            at += capacity
        while short and sum(x[2] for x in short[-1]) + n - at >= capacity:
            seq = short.pop()
            lacks = capacity - sum(x[2] for x in seq)
            done.append(seq + [(doc, at, lacks)])
            at += lacks
        if at < n:
            k = next(k for k in range(1, capacity + 1) if capacity / (k + 1) < n - at <= capacity / k)
            bins.setdefault(k, []).append((doc, at, n - at))
            if len(bins[k]) == k:
                seq = bins.pop(k)
                (done if sum(x[2] for x in seq) == capacity else short).append(seq)
    flat = [(d, a + i) for seq in short + [bins[k] for k in sorted(bins)] for d, a, n in seq for i in range(n)]
    while flat:
        size = capacity
        while size > len(flat):
            size //= 2
        taken, flat, seq = flat[:size], flat[size:], []
        for d, i in taken:
            if seq and seq[-1][0] == d and seq[-1][1] + seq[-1][2] == i:
                seq[-1] = (d, seq[-1][1], seq[-1][2] + 1)
            else:
                seq.append((d, i, 1))
        done.append(seq)
    return done


@pytest.mark.parametrize("capacity", [1, 8, 64, 2048])
def test_harmonic_classes_match_plain_packing(capacity):
    rng = random.Random(capacity)
    lengths = [rng.choice([1, 2, 3, rng.randint(1, capacity), rng.randint(1, 3 * capacity)]) for _ in range(400)]
    packer = packing.Packer(capacity, 5)
    for doc, n in enumerate(lengths):
        packer.add(doc, np.arange(n, dtype="<u4"))
    packer.finish()
    got = collections.defaultdict(list)
    for doc, start, n, _, _, seq, _, _ in packer.taken():
        got[seq].append((doc, start, n))
    assert [got[k] for k in sorted(got)] == plain_packing(lengths, capacity) and min(got) == 5


# --- pipeline

def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    extra = [(900000 + i, t, "en", "x", 1) for i, t in enumerate([None, "123 456", items[0][1] + " and more", ""])]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = storage.written(stage(spark, docs, d), name)
        assert out.columns == docs.columns
        got = {r.doc_id: r.text for r in out.collect()}
        if name == "language":
            assert set(rows) - set(got) >= {900000, 900001, 900003} and len(got) >= len(rows) - 6
        elif name == "lines":
            want = plain_lines(sorted(rows.items()), 40)
            assert got == {i: t for i, t in want.items() if t.strip() or t == rows[i]}
        elif name == "near_duplicates":
            groups = plain_groups({i: plain_simhash(t) for i, t in rows.items()}, 2)
            assert set(got) == {i for i in rows if groups[i] == i}
        else:
            assert set(got) == {i for i, t in rows.items() if not plain_hits(t, items)[1]}
            assert 900002 not in got
        docs, rows = out, got
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert len(packed) == len(rows) and all(r.n == r.t for r in packed)


def test_stages_decide_per_row(spark):
    """Missing and repeated ids take no other row along."""
    d = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{d}/benchmark.parquet").where("length(text) > 100").first().text
    base = spark.read.parquet(f"{d}/documents.parquet").where("length(text) > 300").orderBy("doc_id").limit(6).collect()
    t = [r.text for r in base]
    rows = [(7, t[0]), (7, item), (7, "123 456"), (None, t[1]), (None, t[1]), (None, item), (8, t[2]), (8, t[2]), (9, t[2]), (None, t[2]), (8, t[3])]
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    left = lambda name: sorted(((r.doc_id, r.text) for r in stages[name](spark, docs, d).collect()), key=str)
    taught = docs.union(spark.createDataFrame([(100, x, "en", "s", 1) for x in t] + [(101, "una otra lengua que nadie", "es", "s", 1)], schema))
    kept = {(r.doc_id, r.text) for r in stages["language"](spark, taught, d).collect()}
    assert (7, "123 456") not in kept and {(7, t[0]), (7, item), (None, item)} <= kept
    assert left("benchmark") == sorted([r for r in rows if r[1] != item], key=str)
    assert left("near_duplicates") == sorted({(7, t[0]), (7, item), (7, "123 456"), (None, t[1]), (8, t[2]), (8, t[3])}, key=str)


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}
    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    out = {r.node: r.component for r in storage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: root(x) for x in {v for e in edges if e[0] != e[1] for v in e}}


def test_digest_helpers(spark):
    out = secrets.op1_secrets(spark, "/root/testdata/sf0.001").where("n_assign + n_access + n_hex = 0").first()
    assert out.base_sha256 == hashlib.sha256(b"").hexdigest() and out.n_live >= 0
