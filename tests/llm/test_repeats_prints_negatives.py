"""Periodic runs, SimHash components and hard negatives against brute force, on the smallest tables and on rows that are odd."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from graphwright.llm import negatives, queries, repeats, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")


# Periodic runs


def brute_runs(words, least_words=6, least_periods=4):
    """(start, length, period) by comparing each word with the one a period further, for every period."""
    ids = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.empty(0, int)
    best = {}
    for q in range(1, len(ids) // least_periods + 1):
        same, start = ids[q:] == ids[:-q], None
        for i in [*np.flatnonzero(np.diff(same.astype(int), prepend=0, append=0)).tolist()]:
            if start is None:
                start = i
            else:
                if i - start + q >= max(least_words, least_periods * q):
                    best.setdefault((start, i - start + q), q)
                start = None
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


@pytest.mark.parametrize("least", [(6, 4), (4, 2), (8, 3), (2, 2), (5, 5)])
def test_runs_of_random_words(least):
    rng = random.Random(least[0])
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 4)):
            words = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 60))]
            for _ in range(rng.randint(0, 2)):
                at, part = rng.randint(0, len(words)), [rng.randrange(4) for _ in range(rng.randint(1, 6))]
                words[at:at] = (part * 12)[: rng.randint(1, 40)]
            docs.append(words)
        found = repeats.runs_of([np.array(d, np.int64) for d in docs], *least)
        for words, got in zip(docs, found, strict=True):
            assert [(s, e - s, q) for s, e, q in got.tolist()] == brute_runs(words, *least)
            assert sorted((s, e - s, q) for s, e, q in repeats._runs_by_words(np.array(words, np.int64), *least).tolist()) == sorted(brute_runs(words, *least))


def test_stretches_that_only_seem_equal_are_compared_by_words(monkeypatch):
    """With hashes that are all equal every test passes; what is found is still right."""
    monkeypatch.setattr(repeats._Stretches, "equal", lambda self, a, b, n: np.ones(len(a), bool))
    words = [1, 2, 3] * 5 + [9, 8, 7, 6, 5, 4] * 2
    assert [(s, e - s, q) for s, e, q in repeats.runs_of([np.array(words)], 6, 4)[0].tolist()] == brute_runs(words)


def test_runs_of_odd_rows(spark):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (4, "ha " * 7 + "end", 5), (4, "ha " * 7 + "end", 5), (None, "ha ha ha ha ha ha", 5), (5, long, 5), (6, "Ha ha " * 3, 5), (7, "a b " * 6, 5), (8, "é\tè\r\n" * 4, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(repeats.periodic_runs(docs).collect(), key=str)
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        words = WORD.findall(text or "")
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(words), brute_runs(words))
        assert r.collapsed == collapsed(words, brute_runs(words))
    assert repeats.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        repeats.periodic_runs(docs, least_periods=1)


@needs_tables
def test_op11_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found, changed = repeats.op11_runs(spark, SF).collect(), 0
    assert len(found) == len(docs)
    for r in found:
        words, h = WORD.findall(docs[r.doc_id] or ""), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, changed = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)], changed + 1
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert changed > 5


# SimHash


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, differ=2):
    """id -> smallest id reached, for (id, print) by comparing all pairs."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= differ:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(prints):
        least[root(i)] = min(least.get(root(i), key), key)
    return [least[root(i)] for i in range(len(prints))]


@pytest.mark.parametrize("differ", [1, 2])
def test_links_connect_what_differs_in_few_bits(spark, differ, monkeypatch):
    """Chains, stars and full cubes of fingerprints, among others that nothing is linked with; batches that end within lists."""
    monkeypatch.setattr(simhash, "POSTINGS", 50)
    rng, prints = random.Random(5), set()
    for _ in range(12):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.randint(0, 25)):
            y = rng.choice(sorted(prints))
            for _ in range(rng.randint(1, 4)):
                y ^= 1 << rng.randrange(64)
            prints.add(y)
    base = rng.getrandbits(64)
    prints |= {base ^ (b << 8) for b in range(256)} | {0, 3, (1 << 64) - 1, 1 << 63}
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    found = simhash.links(frame, differ).collect()
    neighbours = {x: {x} for x in prints}
    for a, b in found:
        a, b = a % (1 << 64), b % (1 << 64)
        neighbours[a].add(b)
        neighbours[b].add(a)
    want = brute_components([(x, x) for x in prints], differ)
    for x, least in zip(prints, want, strict=True):
        seen, todo = {x}, [x]
        while todo:
            for y in neighbours[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert min(seen) == least
    assert len(found) < 28 * len(prints)


def test_prints_of_odd_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(40_000))
    rows = [(9, None, 1), (3, "", 1), (5, "  \n", 1), (7, "One two", 1), (8, "one TWO", 1), (8, "one TWO", 1), (None, "one two", 1), (1, long, 1), (2, long + " end", 1), (4, "È é", 1), (6, "a b c d", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    prints = [(k if k is not None else 1 << 40, brute_print(t)) for k, t, _ in rows]
    want = sorted((k, p, c) for (k, p), c in zip(prints, brute_components(prints), strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else 1 << 40, r.fp % (1 << 64), r.component_id) for r in got) == want
    alone = spark.createDataFrame([(None, "x y"), (None, "x y")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(alone).collect()] == [None, None]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


@needs_tables
def test_op12_by_brute_force(spark):
    docs = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((k, f"{p:016x}", c) for (k, p), c in zip(docs, brute_components(docs), strict=True))
    assert sorted(map(tuple, simhash.op12_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect())) == want


# Hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives_=5):
    """Rows (vec_id, label, vector of whole numbers)."""
    rows = [(n, i, label, v) for n, (i, label, v) in enumerate(rows) if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: int(sum(x * y for x, y in zip(a[3], b[3])))  # noqa: E731,B905
    out = []
    for a in rows:
        if is_anchor(a[1]):
            ranked = sorted(((-score(a, b), b[1], b[0], b[2]) for b in rows if b[0] != a[0]))
            for s, i, _, _ in [r for r in ranked if r[3] == a[2]][:positives]:
                kept = [r for r in ranked if r[3] != a[2] and 80 * -s <= 100 * -r[0] <= 100 * -s][:negatives_]
                out += [(a[1], i, rank, r[1], -s, -r[0]) for rank, r in enumerate(kept, 1)]
    return sorted(out)


def _few(monkeypatch):
    """So small blocks that a small table has many of them, and trees of some depth."""
    for name, value in (("BLOCK", 40), ("LEAST_BLOCK", 25), ("REQUESTS", 7), ("LEAF", 4)):
        monkeypatch.setattr(negatives, name, value)


@pytest.mark.parametrize("spread", [2, 30])
def test_negatives_of_random_rows(spark, monkeypatch, spread):
    _few(monkeypatch)
    rng = random.Random(spread)
    centres = [[rng.randint(-spread, spread) for _ in range(6)] for _ in range(5)]
    rows = [(i, rng.randrange(3), [float(x + rng.randint(-3, 3)) for x in rng.choice(centres)]) for i in range(400)]
    rows += [(400 + i, 1, [float(x) for x in centres[0]]) for i in range(60)] + [(10, 0, rows[10][2]), (20, 2, rows[10][2])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>").repartition(3)
    got = sorted(tuple(int(x) for x in r) for r in negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0).collect())
    assert got == brute_negatives(rows, lambda i: i % 10 == 0) and got


def test_negatives_of_odd_rows(spark):
    rows = [
        (0, 1, [2.0, 1.0]), (1, 1, [2.0, 1.0]), (2, 1, [-2.0, 0.0]), (3, 2, [2.0, 1.0]), (4, 2, [2.0, 0.0]), (4, 2, [2.0, 0.0]), (5, None, [2.0, 1.0]),
        (6, 2, None), (7, 2, [None, 1.0]), (8, 2, [float("nan"), 1.0]), (9, 2, [float("inf"), 1.0]), (None, 2, [2.0, 1.0]), (10, 3, []), (20, 2, [0.0, 0.0]), (11, 2, [2.0]), (30, 7, [1.0, 1.0]),
    ]
    frame = spark.createDataFrame([(*r, 4) for r in rows], "vec_id long, label int, vector array<double>, row int")
    anchor = F.col("vec_id") % 10 == 0
    got = sorted(tuple(int(x) for x in r) for r in negatives.hard_negatives(frame, anchor).collect())
    assert got == brute_negatives(rows, lambda i: i % 10 == 0) and got
    assert negatives.hard_negatives(frame.limit(0), anchor).collect() == []
    assert negatives.hard_negatives(frame, F.lit(None).cast("boolean")).collect() == []


def test_requests_walk_a_block_together(monkeypatch):
    """300 requests of a block are one walk of its tree, with the rows of brute force."""
    rng, calls, walk = np.random.default_rng(4), [], negatives.Block.nearest
    monkeypatch.setattr(negatives, "LEAF", 16)
    monkeypatch.setattr(negatives.Block, "nearest", lambda *given: calls.append(1) or walk(*given))
    x = np.floor(rng.normal(size=(500, 6)) * 3)
    x[400:] = x[0]
    rows = pd.DataFrame({"row": np.arange(500), "vec_id": np.arange(500) // 2, "label": np.arange(500) % 3, "vector": list(x)})
    asked = rows[:300].assign(request=np.arange(300) + 1000, anchor=np.arange(300), low=rng.integers(-20, 10, 300).astype(float), high=rng.integers(10, 40, 300).astype(float))
    for same in (True, False):
        got = negatives._search(same, 5, 6, float((x * x).sum(1).max()))(rows, asked)
        want = set()
        for r in asked.itertuples():
            s = x @ r.vector
            ok = [i for i in range(500) if i != r.anchor and (i % 3 == r.label) == same and r.low <= s[i] <= r.high]
            want |= {(r.request, i, i // 2, s[i]) for i in sorted(ok, key=lambda i: (-s[i], i // 2, i))[:5]}
        assert len(got) == len(want) and set(got.itertuples(index=False, name=None)) == want
    assert len(calls) == 2


@needs_tables
def test_op13_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    frame = queries.QUERIES["op13_negatives"](spark, SF)
    answer = con.execute(queries.oracle_sql()["op13_negatives"])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(*names).collect())) == sorted(answer.fetchall())
