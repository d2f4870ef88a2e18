"""The pipeline's stages against brute force on the small tables, and on odd input."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from cohortia.llm import packing, quality, queries, simhash
from cohortia.llm.common import remainder
from tests.llm.test_operators import DOC, ODD, oracle

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "packing"]


def test_quality_stage(spark, docs):
    out = P.quality_stage(spark, docs, SF)
    assert out.columns == COLUMNS
    trees = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), remainder("doc_id", 5) != 0)
    scores = {r.doc_id: r.score for r in quality.score(docs, trees).collect()}
    assert rows(out) == rows(docs.filter(F.col("doc_id").isin([d for d, s in scores.items() if s >= P.LEAST_QUALITY])))


def test_line_stage(spark, docs):
    out = P.line_stage(spark, docs, SF)
    assert out.columns == COLUMNS
    want = oracle(queries.OP2_SQL, "documents").set_index("doc_id")
    got = {r.doc_id: r for r in out.withColumn("md5", F.md5("text")).collect()}
    assert all(got[d].md5 == w.text_md5 and got[d].n_chars == w.n_chars for d, w in want.iterrows()) and len(got) == len(want)


def _shingles(text):
    words = simhash.shingle_hashes(text, 5, 42)
    return set(words.tolist())


def test_near_duplicate_stage(spark, docs):
    had = sorted((r.doc_id, r.text) for r in docs.collect())
    prints, sets = [simhash.wide_fingerprint(t) for _, t in had], [_shingles(t) for _, t in had]
    band = [math.floor(math.log(max(n, 1)) / -math.log(0.8)) for _, n in prints]
    root = list(range(len(had)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(had)):
        for j in range(i):
            bits = sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) + 2**64).bit_count() for x, y in zip(prints[i][0], prints[j][0]))
            a, b = sets[i], sets[j]
            if abs(band[i] - band[j]) <= 1 and bits <= simhash.bit_radius(0.8) and len(a & b) >= 0.8 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = P.near_duplicate_stage(spark, docs, SF)
    stays = [d for k, (d, _) in enumerate(had) if find(k) == k]
    assert out.columns == COLUMNS and rows(out) == rows(docs.filter(F.col("doc_id").isin(stays)))


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([60, 200, 900]))) for _ in range(60)]

    def changed(text, every):  # replaces one word in so many
        words = text.split()
        for i in range(every // 2, len(words), every):
            words[i] = "changed"
        return " ".join(words)

    near = [changed(t, 60) for t in texts[:20]]  # five-word similarity of about 0.85
    less = [changed(t, 8) for t in texts[20:40]]  # about 0.3
    copies = [t.upper() for t in texts[40:50]]
    table = spark.createDataFrame(list(enumerate(texts + near + less + copies)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(table, tile=16).collect()}
    assert all(len(_shingles(a) & _shingles(b)) / len(_shingles(a) | _shingles(b)) >= 0.8 for a, b in zip(texts, near))
    assert set(range(60)) <= kept and set(range(80, 100)) <= kept
    assert not kept & set(range(100, 110)) and len(kept & set(range(60, 80))) <= 1


def _classes(texts, similarity=0.8):
    """The first place of the class of each text, by the five-word Jaccard similarity of all pairs."""
    sets, root = [_shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= similarity * len(x | y):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_match_brute_force_jaccard(spark, docs):
    had = sorted((r.doc_id, r.text) for r in docs.collect())
    first = _classes([t for _, t in had])
    kept = {r.doc_id for r in P.near_duplicate_stage(spark, docs, SF).collect()}
    assert kept == {d for k, (d, _) in enumerate(had) if first[k] == k}


def test_near_duplicates_of_short_nested_and_of_less_similar_texts(spark):
    rng = random.Random(8)
    texts = []
    for g in range(60):  # 4 of 5 shingles: similarity 0.8
        words = [f"a{g}x{i}" for i in range(9)]
        texts += [" ".join(words), " ".join(words[:8])]
    for g in range(40):  # a group of one base, changed more and more: similarities on both sides of 0.8
        words = [f"b{g % 4}x{i}" for i in range(200)]
        for i in rng.sample(range(200), g % 10):
            words[i] = f"c{g}x{i}"
        texts.append(" ".join(words))
    first = _classes(texts)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile in (8, 16_384):
        kept = {r.doc_id for r in simhash.keep_one(table, tile=tile).collect()}
        assert kept == {k for k, f in enumerate(first) if f == k}


def test_mixing_stage(spark, docs):
    out = P.mixing_stage(spark, docs, SF).collect()
    words, per, had = defaultdict(int), defaultdict(int), {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        assert had[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
        per[r.source] += len(r.text.split())
    op3 = queries.op3_mix_sources(spark, SF).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert op3.groupby("source").taken.sum().to_dict() == dict(per)
    size = dict(zip(op3.doc_id, op3["size"]))
    assert all(n <= 3 * size[d] for d, n in words.items())


def test_packing_stage(spark, docs):
    """Every piece of every document, as the tokenizer and plain Python cut them, in as few sequences as one best-fit run needs."""
    from tokenizers import Tokenizer

    out = P.packing_stage(spark, docs, SF).toPandas()
    whole, want = Tokenizer.from_file(queries.tokenizer_path()), Counter()
    for r in docs.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or min(len(ids), 2048), len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(zip(out.doc_id, out.piece, out.start, out.length, out.ids_crc32)) == want
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert list(seq.offset) == [0, *seq.length.cumsum()[:-1]] and seq.length.sum() <= 2048
    lengths = out.length.to_numpy()
    assert packing.lower_bound(lengths, 2048) <= out.sequence_id.nunique() <= packing.best_fit(lengths, 2048)[0].max() + 1


def test_run_packs_all(spark):
    out = P.run(spark, SF).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    assert not out.duplicated(["row", "piece"]).any()
    again = P.run(spark, SF).toPandas()
    assert Counter(zip(out.doc_id, out.piece, out.ids_crc32)) == Counter(zip(again.doc_id, again.piece, again.ids_crc32))


def test_odd_input_goes_through_every_stage(spark):
    clash = [F.lit(1).alias(c) for c in ("n_lines", "removed_lines", "lines", "doc", "id", "none", "row", "hash", "size", "copies", "starts", "score", "fp")]
    odd = spark.createDataFrame(ODD, DOC).select("*", *clash)
    for frame in (odd, odd.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, frame, SF)
            got = out.collect()
            assert name == "packing" or out.columns == odd.columns
            assert bool(got) == bool(frame.head(1))
    kept = P.near_duplicate_stage(spark, odd, SF).select("doc_id", "text").collect()
    assert Counter(r.doc_id for r in kept) == Counter([0, 3, None, 5, 6, 7])
    assert {(r.n_lines, r.removed_lines) for r in P.line_stage(spark, odd, SF).collect()} == {(1, 1)}
