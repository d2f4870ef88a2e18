"""Brute-force checks and odd inputs for exact dedup, ranked search and periodic runs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.llm import exact, lexical, periodic, queries
from tests.llm.test_operators import SF, docs, none, odd, oracle, rows_of  # noqa: F401  (fixtures)


def test_exact_matches_sql(spark):
    want = oracle(queries.OP11_SQL, "documents")
    got = queries.op11_exact_dedup(spark, SF)
    assert rows_of(got) == Counter(tuple(r[c] for c in got.columns) for r in want.to_dict("records"))


def _brute_duplicates(rows):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((d is None, d or 0, i))
    out = Counter()
    for t, found in groups.items():
        keep = min(x[1] if not x[0] else math.inf for x in found)
        for none, d, i in found:
            out[(None if none else d, None if keep == math.inf else keep, len(found), hashlib.sha256(t.encode()).hexdigest())] += 1
    return out, len(groups)


def test_exact_odd(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want, groups = _brute_duplicates(rows)
    got = exact.duplicates(odd).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)
    assert exact.duplicates(none).count() == 0


def test_exact_tells_chunks_of_one_hash_apart(spark):
    """With hashes of four bits most chunks share one, and texts are still told apart; copies may hold a third of the rows."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 3, 300, 4000]))) for _ in range(60)]
    texts += [t.replace("w1 ", "w2 ", 1) for t in texts[:20]] + [t[:-1] for t in texts[:20]] + [t + "\n" for t in texts[20:30]] + [texts[3]] * 70
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want, groups = _brute_duplicates(rows)
    for bits in (4, 64):
        got = exact.duplicates(table, hash_bits=bits).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == groups
    assert exact._told_apart(exact.stash(exact.recipes(table, 4))).count() > 50
    assert exact._told_apart(exact.stash(exact.recipes(table))).count() == 0


def test_chunks_join_to_the_text_and_move_with_it():
    rng = random.Random(1)
    data = " ".join(str(rng.random()) for _ in range(20_000)).encode()
    chunks = exact.cut(data)
    assert b"".join(chunks) == data and max(map(len, chunks)) <= exact.MOST and min(map(len, chunks[:-1])) >= exact.LEAST
    moved = exact.cut(b"some words before " + data)
    assert len(set(chunks) & set(moved)) > 0.95 * len(chunks)
    assert exact.cut(b"") == [] and b"".join(exact.cut(b"a" * 100_000)) == b"a" * 100_000
    assert exact.normalised(" a \t\n b\x1c c\r") == " a b\x1c c ".encode() and exact.normalised(" \n") == b" " and exact.normalised(None) == b""


def test_rank_matches_sql(spark):
    want = oracle(queries.OP12_SQL, "documents", "benchmark")
    got = queries.op12_lexical_search(spark, SF)
    assert rows_of(got) == Counter(tuple(int(r[c]) for c in got.columns) for r in want.to_dict("records"))


def _brute_rank(rows, items, most):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    bags = [(d, Counter(terms(t))) for d, t in rows]
    bags = [(d, c, sum(c.values())) for d, c in bags if c]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for i, (d, c, n) in enumerate(bags):
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, math.inf if d is None else d, d))
        out += [(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2])[:most])]
    return Counter(out)


def test_rank_brute(spark, docs):  # noqa: F811
    """Small buckets, so that bounds prune; items in several blocks; repeated rows, null ids and texts; ties."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += rows[:9] + [(None, rows[5][1]), (None, rows[5][1]), (7000, None), (7001, ""), (7002, " .,; ")] + [(8000 + i, "the ONLY words été 0") for i in range(25)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:15]
    items += [items[0], (900, "the only only Été été"), (901, None), (902, "."), (None, "words"), (903, "absentterm")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("n", F.lit(2)).withColumn("norm", F.lit("x"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(0))
    want = _brute_rank(rows, items, 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for how in ({"bucket": 7, "warm": 20}, {"bucket": 16, "warm": 1, "item_bytes": 1500}):
            got = lexical.rank(table, asked, **how).collect()
            assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rank_bounds_pass_documents_over(spark):
    """Once ten documents hold an item, short vectors and documents without its heavy terms are not scored."""
    rng = random.Random(2)
    common = [f"c{i}" for i in range(30)]
    rare = [f"r{i}" for i in range(20)]
    texts = [" ".join(rare + rng.choices(common, k=10)) for _ in range(12)] + [" ".join(rng.choices(common, k=20)) for _ in range(300)]
    known = {w.encode(): k for k, w in enumerate(common + rare)}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    vectors = lexical.stash(lexical._vectors(table, known))
    weights = np.array([700] * 30 + [3000] * 20, np.int64)
    batch = lexical._impacts(vectors, weights, 312, 6500).orderBy(F.desc("norm")).toArrow().combine_chunks().to_batches()[0]
    best = lexical._Best(Counter({k: 1 for k in range(20, 50)}), weights, 10, 0)
    dense = np.zeros(50, np.int64)
    seen = []
    for at in range(0, batch.num_rows, 24):
        bucket = lexical._Bucket(batch.slice(at, 24))
        before = len(best.hits)
        seen.append(bucket.search(best, dense, weights))
        assert not dense.any() and len(best.hits) >= before
    assert seen[0] and not any(seen[-3:]) and {h[3] for h in best.hits} <= set(range(12))


def test_rank_empty(spark, none):  # noqa: F811
    asked = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert lexical.rank(none, asked).count() == 0
    assert lexical.rank(none, asked.limit(0)).count() == 0
    assert lexical.rank(spark.createDataFrame([(1, "."), (2, None)], "doc_id long, text string"), asked).count() == 0


def _longest_lyndon(s, i):
    best = 1
    for n in range(1, len(s) - i + 1):
        w = s[i : i + n]
        if all(w < w[k:] for k in range(1, n)):
            best = n
    return best


def _brute_runs(s, power, least):
    """By definition: for every period, the stretches in which words that far apart are the same."""
    n, out = len(s), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, power * q):
                w = s[i : i + size]
                if not any(w[r:] == w[:-r] for r in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays_and_runs_brute():
    rng = random.Random(5)
    for _ in range(700):
        n, k = rng.randint(0, 40), rng.choice([1, 2, 3, 9])
        s = [rng.randint(1, k) for _ in range(n)]
        for _ in range(rng.randint(0, 2)):
            if n > 4:
                p, a, e = rng.randint(1, 6), rng.randint(0, n - 1), rng.randint(0, n)
                for i in range(a + p, e):
                    s[i] = s[i - p]
        for ordered in (s, [-x for x in s]):
            assert periodic.lyndon_array(ordered) == [_longest_lyndon(ordered, i) for i in range(n)]
        for power, least in ((4, 6), (2, 2), (3, 5), (5, 9)):
            assert periodic.runs_of(np.array(s, np.int64), power, least) == _brute_runs(s, power, least)


def test_runs_query_brute(spark, docs):  # noqa: F811
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    planted = 0
    for d, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        number = {w: k for k, w in enumerate(words)}
        runs = _brute_runs([number[w] for w in words], 4, 6) if n < 400 else periodic.runs_of(np.array([number[w] for w in words], np.int64))
        planted += bool(runs)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        want = (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4))
        want += (hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())
        assert tuple(got[d])[1:] == want, d
    assert planted > 5


def test_runs_odd(spark, odd, none):  # noqa: F811
    got = periodic.find_runs(odd).collect()
    assert len(got) == odd.count() and periodic.find_runs(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[0].runs == by[1].runs == by[2].runs == [] and by[0].collapsed == by[1].collapsed == by[2].collapsed == ""
    assert [tuple(x) for x in by[5].runs] == [(0, 60_000, 1)] and by[5].collapsed == "word" and by[5].n_words == 60_000
    assert None in by and by[None].collapsed == "no id at all"
    same = odd.select("doc_id", "text", periodic.with_planted_run(F.col("doc_id"), F.col("text")).alias("new")).collect()
    assert all(r.new == r.text for r in same if r.doc_id is None or r.text is None or not r.text.split() or zlib.crc32(str(r.doc_id).encode()) % 10)


@pytest.mark.parametrize("words,runs", [("a b a b a b", []), ("a b a b a b a b", [(0, 8, 2)]), ("x x x x x", []), ("y x x x x x x", [(1, 6, 1)]), ("x " * 6 + "z " + "x " * 7, [(0, 6, 1), (7, 7, 1)])])
def test_runs_by_hand(spark, words, runs):
    got = periodic.find_runs(spark.createDataFrame([(1, words)], "doc_id long, text string")).first()
    assert [tuple(x) for x in got.runs] == runs
