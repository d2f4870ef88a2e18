"""SimHash near-duplicates: fingerprints of word shingles, exact tiled comparison, connected classes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.llm.common import stash

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Longs of a wide fingerprint, and the constants of the finalizer that makes them from one hash.
WIDE = 4
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of the whole sequence if there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :])], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash, as a signed integer, of a text's word shingles, repeats included.

    A-Z are lower-cased and words parted at ASCII blanks; a text with fewer words is one shingle; a
    null, empty or blank text has fingerprint 0. A bit is set if over half of the hashes have it.
    """
    hashes = shingle_hashes(text, shingle, seed)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def wide_fingerprint(text: str | None, shingle: int = 5, seed: int = 42) -> tuple[list[int], int]:
    """(WIDE signed longs, number of distinct shingles): the SimHash of a text's set of word shingles.

    Each distinct shingle counts once, so the share of bits in which two texts differ tells the overlap
    of their sets. A null, empty or blank text has zeros and no shingles.
    """
    h = np.unique(shingle_hashes(text, shingle, seed))
    return wide_of(h), len(h)


def wide_of(h: np.ndarray) -> list[int]:
    """WIDE signed longs: the SimHash of a set of shingle hashes."""
    ones = np.zeros(64 * WIDE, dtype=np.int64)
    for at in range(0, len(h), 255 * 64):
        x = h[at : at + 255 * 64, None] + np.arange(1, WIDE + 1, dtype=np.uint64) * _STEP
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for row in range(0, len(bits), 255):  # sums that fit a byte
            ones += bits[row : row + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<i8").tolist()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp) for every row; text_hash tells rows of one id apart, or rows of none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x, shingle, seed) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of each row of x from each of y; fingerprints of several longs have a row of them."""
    if x.ndim == 1:
        return np.bitwise_count(x[:, None] ^ y[None, :])
    out = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]).astype(np.uint16)
    for k in range(1, x.shape[1]):
        out += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
    return out


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, names: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between fingerprints of two tiles (or within one) that connect all that lie within `radius`.

    `names` holds what links call the fingerprints of `a`, then `b`, if not by themselves.

    All pairs are compared. Few links are returned as they are; beyond four for each fingerprint only
    a spanning forest is, so a dense tile gives no more rows than it has fingerprints.
    """
    other = a if b is None else b
    nodes = names if names is not None else a if b is None else np.concatenate([a, b])
    shift = 0 if b is None else len(a)
    most, found, rows = 4 * len(nodes), [], []
    step = max(1, (2_000_000 if a.ndim == 1 else 200_000) // max(1, len(other)))
    count = 0
    for at in range(0, len(a), step):
        near = _distance(a[at : at + step], other) <= radius
        i, j = np.nonzero(near)
        i += at
        if b is None:
            keep = i < j
            i, j = i[keep], j[keep]
        if len(i):
            count += len(i)
            if count <= most:
                found.append((i, j + shift))
            rows.append(np.unique(i))
    if count <= most:
        return [(int(nodes[x]), int(nodes[y])) for i, j in found for x, y in zip(i, j)]
    root, links = np.arange(len(nodes)), []
    for i in np.concatenate(rows):
        near = np.flatnonzero(_distance(a[i : i + 1], other)[0] <= radius) + shift
        for r in np.unique(root[near]):
            mine = root[i]
            if r != mine:
                links.append((int(nodes[r]), int(nodes[mine])))
                root[root == r] = mine
    return links


def near_links(fps: DataFrame, radius: int = 2, words: int = 4, tile: int = 8192) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints `fp` that differ in at most `radius` bits.

    Fingerprints are tiled by the population counts of their `words` equal parts. Two that differ in r
    bits have counts that differ by r in sum at most, so tile pairs beyond the radius are skipped and all
    others compared exactly. A crowded tile is split into parts of about `tile` and all part pairs are
    compared. The table of tile sizes that is broadcast has (64/words + 1)^words rows at most: 83,521 for
    4 words. Work is quadratic in a tile, which holds a fraction of a percent of ordinary fingerprints.
    """
    assert words in (1, 2, 4)
    width, base = 64 // words, 64 // words + 1
    count = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))).cast("int") for i in range(words)]
    nodes = stash(fps.select("fp", F.array(*count).alias("p")), "simhash-nodes")
    cell = lambda p: sum((p[i] * base**i for i in range(1, words)), p[0] * 1)
    sized = nodes.groupBy(cell(F.col("p")).alias("cell")).agg(F.ceil(F.count("*") / tile).alias("parts"))
    sized = F.broadcast(stash(sized, "simhash-tiles"))
    moves = [d for d in product(range(-radius, radius + 1), repeat=words) if sum(map(abs, d)) <= radius]
    # A pair of tiles is met from both ends; its key is ordered, the tile of the first being "a".
    # A row meets 40 tiles, so the few files of the small table are dealt out first.
    spread = nodes.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    at = spread.select("fp", "p", cell(F.col("p")).alias("cell")).join(sized, "cell")
    at = at.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    step = F.explode(F.array(*[F.array(*[F.lit(x) for x in d]) for d in moves])).alias("d")
    there = at.select("fp", "cell", "part", "p", step).select("fp", "cell", "part", F.zip_with("p", "d", lambda x, y: x + y).alias("q"))
    there = there.filter(" AND ".join(f"q[{i}] BETWEEN 0 AND {width}" for i in range(words)))
    met = there.select("fp", "cell", "part", cell(F.col("q")).alias("cell_2")).join(sized.select(F.col("cell").alias("cell_2"), F.col("parts").alias("parts_2")), "cell_2")
    met = met.select("fp", "cell", "part", "cell_2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_2") - 1)).alias("part_2"))
    mine, its = (F.col("cell") * F.lit(1 << 32) + F.col("part")), (F.col("cell_2") * F.lit(1 << 32) + F.col("part_2"))
    dealt = met.select(F.least(mine, its).alias("a"), F.greatest(mine, its).alias("b"), (mine <= its).alias("first"), "fp")

    return compare(dealt, radius)


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns that hold whole tile pairs of sorted rows, whose first two columns are the tiles, and where they part."""
    rest = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(rest, cols)]
        cuts = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        if len(cuts):
            yield [c[: cuts[-1]] for c in cols], cuts[:-1]
            cols = [c[cuts[-1] :] for c in cols]
        rest = cols
    if rest is not None and len(rest[0]):
        yield rest, np.empty(0, np.int64)


def compare(dealt: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) from the rows of tile pairs: a, b (the tiles), first (whether of tile a), name, then the
    longs of a fingerprint; without any, the name is the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, cuts in _tile_pairs(batches):
            yield links(cols, cuts)

    def links(cols: list[np.ndarray], cuts) -> pa.RecordBatch:
        a, b, first, name, *longs = cols
        name = name.view(np.uint64)
        fp = np.stack(longs, axis=1).view(np.uint64) if longs else name
        out: list[tuple[int, int]] = []
        for i, j in zip([0, *cuts], [*cuts, len(name)]):
            if a[i] == b[i]:
                if j - i > 1:
                    out += forest(fp[i:j], None, radius, name[i:j])
            else:
                side = first[i:j].astype(bool)
                if side.any() and not side.all():
                    order = np.flatnonzero(side), np.flatnonzero(~side)
                    out += forest(fp[i:j][order[0]], fp[i:j][order[1]], radius, name[i:j][np.concatenate(order)])
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

    return dealt.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by alternating stars.

    In each round every node hands its larger neighbours to the smallest it knows, then its smaller ones;
    rounds double the reach, each is two joins whose tables are written to the shared folder.
    """
    ordered = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges, last = stash(ordered(links), "links"), None
    while True:
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()
        if seen == last or not seen[0]:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        last = seen
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(low, "x").select(F.col("y").alias("a"), F.col("m").alias("b"))
        large = ordered(large)
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("a"), F.col("m").alias("b")).union(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
        edges = stash(ordered(small), "links")


def classes(marked: DataFrame, radius: int, words: int, tile: int) -> DataFrame:
    """(fp, root): the class of each fingerprint of a table with doc_id and fp."""
    nodes = marked.select("fp").distinct()
    roots = components(near_links(nodes, radius, words, tile))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, words: int = 4, tile: int = 8192) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id that links reach.

    Rows whose fingerprints are equal are one node, so copies are never paired. Null, empty and blank
    texts have fingerprint 0 and link like any other; a null id gets its class and is never its name
    (null if a class has no id); repeated rows are kept; an empty table gives an empty result; columns
    other than `doc_id` and `text` are ignored.
    """
    marked = stash(fingerprints(docs, doc_id, text, shingle), "simhash-fps")
    rooted = classes(marked, radius, words, tile).join(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    rooted = stash(rooted, "simhash-classes")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _differs(shared: int, one: int, other: int) -> float:
    """Probability that a bit differs between two sets with so many shared hashes and so many of their own."""
    size = lambda n: np.array([math.comb(n, k) / 2**n for k in range(n + 1)])
    c, x, y = np.arange(shared + 1)[:, None], np.arange(one + 1)[None, :], np.arange(other + 1)[None, :]
    p = (size(one) * (2 * (c + x) > shared + one)).sum(1)
    q = (size(other) * (2 * (c + y) > shared + other)).sum(1)
    return float((size(shared) * (p * (1 - q) + q * (1 - p))).sum())


def bit_radius(similarity: float) -> int:
    """Bits in which wide fingerprints of texts of that Jaccard similarity differ, and three deviations more.

    Large sets of like size with similarity s have cosine 2s / (1 + s); each bit differs with probability
    angle / pi. Sets of few hashes can differ in more, as 4 of 5 do in 48 bits: the worst of those counts.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for shared in range(1, 41):
        own = math.floor(shared / similarity - shared + 1e-9)
        p = max([p, *(_differs(shared, one, most - one) for most in range(1, own + 1) for one in range(most // 2 + 1))])
    return math.floor(64 * WIDE * p + 3 * math.sqrt(64 * WIDE * p * (1 - p)))


def _met_tiles(nodes: DataFrame, radius: int, similarity: float, tile: int, volume: int) -> DataFrame:
    """Rows of tile pairs (a, b, first, node, longs) of (node, size, f0, f1, ...), for `similar_links`."""
    width = 4 * WIDE
    longs = [f"f{k}" for k in range(WIDE)]
    count = sum((F.bit_count(c) for c in longs[1:]), F.bit_count(longs[0]))
    band = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.lit(-math.log(similarity)))
    cell = lambda b, o: b * 32 + o
    nodes = nodes.select("node", "size", *longs, band.alias("band"), F.floor(count / width).alias("ones"))
    parts = F.ceil(F.greatest(F.count("*") / tile, F.sum("size") / volume)).alias("parts")
    sized = F.broadcast(stash(nodes.groupBy(cell(F.col("band"), F.col("ones")).alias("cell")).agg(parts), "simhash-tiles"))
    at = nodes.withColumn("cell", cell(F.col("band"), F.col("ones"))).join(sized, "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    reach = (radius - 1) // width + 1
    moves = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(o).alias("o")) for b in (-1, 0, 1) for o in range(-reach, reach + 1)])
    there = at.withColumn("d", F.explode(moves)).withColumn("o2", F.col("ones") + F.col("d.o")).filter(f"o2 BETWEEN 0 AND {64 * WIDE // width}")
    there = there.withColumn("cell_2", cell(F.col("band") + F.col("d.b"), F.col("o2")))
    met = there.join(sized.select(F.col("cell").alias("cell_2"), F.col("parts").alias("parts_2")), "cell_2")
    met = met.withColumn("part_2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_2") - 1)))
    mine, its = F.col("cell") * F.lit(1 << 32) + F.col("part"), F.col("cell_2") * F.lit(1 << 32) + F.col("part_2")
    return met.select(F.least(mine, its).alias("a"), F.greatest(mine, its).alias("b"), (mine <= its).alias("first"), "node", "size", *longs)


def _sides(cols: list[np.ndarray], cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows of the first tile, of the second, whether they are one tile) of each tile pair with two rows to compare."""
    a, b, first = cols[:3]
    for i, j in zip([0, *cuts], [*cuts, len(a)]):
        rows, side = np.arange(i, j), first[i:j].astype(bool)
        if a[i] == b[i]:
            if j - i > 1:
                yield rows, rows, True
        elif side.any() and not side.all():
            yield rows[side], rows[~side], False


def _near(x: np.ndarray, y: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], radius: int, similarity: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distances, whether near) of a few rows of x at a time from all of y."""
    step = max(1, 200_000 // max(1, len(y)))
    for at in range(0, len(x), step):
        far, n = _distance(x[at : at + step], y), sizes[0][at : at + step, None]
        yield at, far, (far <= radius) & (np.minimum(n, sizes[1]) >= np.maximum(n, sizes[1]) * similarity - 1e-9)


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted arrays of distinct hashes have that Jaccard similarity or more."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small):
        return not len(large)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def candidates(dealt: DataFrame, radius: int, similarity: float) -> DataFrame:
    """The rows (a, b, first, node) of tile pairs that lie within the radius of another row there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, cuts in _tile_pairs(batches):
            size, fp = cols[4], np.stack(cols[5:], axis=1).view(np.uint64)
            some = np.zeros(len(size), bool)
            for x, y, one in _sides(cols, cuts):
                for at, _, near in _near(fp[x], fp[y], (size[x], size[y]), radius, similarity):
                    if one:
                        near[np.arange(len(near)), at + np.arange(len(near))] = False
                    some[x[at : at + len(near)][near.any(1)]] = True
                    some[y[near.any(0)]] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in cols[:4]], names=["a", "b", "first", "node"])

    return dealt.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long, first boolean, node long")


def verified(dealt: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect, in each tile pair, all rows whose sets are that similar.

    Rows are a, b, first, node, size, set (sorted hashes as bytes), then the longs of a fingerprint. Pairs within
    the radius are compared by their sets unless links found before connect them already, so a tile pair
    gives fewer links than it has rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, cuts in _tile_pairs(batches):
            node, size, sets, fp = cols[3], cols[4], cols[5], np.stack(cols[6:], axis=1).view(np.uint64)
            root, out = np.arange(len(node)), []
            for x, y, one in _sides(cols, cuts):
                lot = x if one else np.concatenate([x, y])
                for at, far, near in _near(fp[x], fp[y], (size[x], size[y]), radius, similarity):
                    for k in np.flatnonzero(near.any(1)):
                        i = x[at + k]
                        js = np.flatnonzero(near[k])
                        js = js[(root[y[js]] != root[i]) & ((y[js] > i) | (not one))]
                        mine = np.frombuffer(sets[i], "<u8")
                        for j in y[js[np.argsort(far[k, js], kind="stable")]]:
                            if root[i] != root[j] and similar(mine, np.frombuffer(sets[j], "<u8"), similarity):
                                out.append((node[i], node[j]))
                                known = root[lot]
                                root[lot[known == root[j]]] = root[i]
            pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

    return dealt.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long")


def similar_links(prints: DataFrame, sets_of, similarity: float = 0.8, tile: int = 16_384, volume: int = 1 << 22) -> DataFrame:
    """Links (a, b) that connect the `node`s of (node, size, f0, f1, ...) whose sets have that Jaccard similarity.

    `size` is the number of distinct shingles; `sets_of` gives (node, set) for a table of some nodes. Pairs
    within `bit_radius(similarity)` are candidates, and each is compared by its sets. Tiles are bands of
    size, of the ratio 1 / similarity, by sixteenths of the population count, in parts of about `tile`
    nodes and `volume` shingles at most. Sets of more different sizes cannot be that similar, and counts
    further apart than the radius cannot be within it: such tile pairs are skipped, all others compared.
    Sets are dealt only to the tile pairs where their node has a candidate. The table of tile sizes that is
    broadcast has 17 rows for each band, and 150 bands reach a text of 10^14 words.
    """
    radius, longs = bit_radius(similarity), [f"f{k}" for k in range(WIDE)]
    nodes = stash(prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node"), "simhash-wide")
    found = stash(candidates(_met_tiles(nodes, radius, similarity, tile, volume), radius, similarity), "simhash-candidates")
    some = stash(sets_of(found.select("node").distinct()).join(nodes, "node").select("node", "size", "set", *longs), "simhash-sets")
    return verified(found.join(some, "node").select("a", "b", "first", "node", "size", "set", *longs), radius, similarity)


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, tile: int = 16_384, seed: int = 42) -> DataFrame:
    """The row of `docs` (doc_id, text, ...) with the smallest id of each class, null ids last, then by text.

    Texts are linked if the Jaccard similarity of their sets of word shingles is `similarity` or more; classes
    are what links reach. Links are exact; candidates come from wide SimHash, which misses about one pair
    in a thousand of the hardest (see `bit_radius`). Null, empty and blank texts are one class. Rows equal
    in id and text are one; all columns are kept, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(1).to_pylist():
                h = np.unique(shingle_hashes(x, shingle, seed))
                found.append((np.uint64(xxhash.xxh64_intdigest(h.tobytes())).astype(np.int64), len(h), *wide_of(h)))
            cols = [pa.array([f[k] for f in found], pa.int64()) for k in range(WIDE + 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], names=["doc_id", "text_hash", "node", "size", *names])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x, shingle, seed)).astype("<u8").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    names = [f"f{k}" for k in range(WIDE)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    # A node is a set of shingles, so copies are never compared.
    marked = stash(rows.mapInArrow(run, "doc_id long, text_hash long, node long, size long, " + ", ".join(f"{n} long" for n in names)), "simhash-fps")
    # `id` and `none` tell null ids apart, so that one shuffle by plain equality does for both steps below.
    key = lambda h: [F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("none"), h.alias("hash")]
    # The first of each set, then of each class: a large class is one row for each set.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("s")
    each = stash(marked.groupBy("node").agg(first), "simhash-first")

    def sets_of(some: DataFrame) -> DataFrame:
        own = each.join(some, "node").select("node", "s.doc_id", "s.text_hash").select("node", *key(F.col("text_hash")))
        texts = docs.select("text", *key(F.xxhash64("text"))).join(own, ["id", "none", "hash"])
        return texts.dropDuplicates(["id", "none", "hash"]).select("node", "text").mapInArrow(hashed, "node long, set binary")

    roots = components(similar_links(marked.select("node", "size", *names).distinct(), sets_of, similarity, tile))
    stays = each.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("s").alias("s"))
    stays = stays.select("s.doc_id", "s.text_hash").select(*key(F.col("text_hash")))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *key(F.xxhash64("text"))).join(stays, ["id", "none", "hash"], "left_semi")
    return rows.dropDuplicates(["id", "none", "hash"]).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
