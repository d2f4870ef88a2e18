"""Array and sequence operators, pair alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortia.functions import arrays as A
from cohortia.operators import align, descriptors
from cohortia.plans.joins import EMB, emb
from cohortia.plans.registry import query, table


def sequences(spark, d):
    """Each user's events as frames of 12 classes in order of time."""
    e = table(spark, d, "events")
    pc = lambda t: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.when(F.pmod(F.floor(t), F.lit(12)) == k, F.lit(1.0)).otherwise(F.lit(0.0)))
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.struct("event_id", F.col("value").alias("t")).alias("f"))
    s = rows.groupBy("key").agg(F.array_sort(F.collect_list("f")).alias("f"))
    # Classes are made of values after these are shuffled.
    return s.select("key", F.transform("f", lambda x: pc(x["t"])).alias("frames"), F.array_sort(F.transform("f", lambda x: x["t"])).alias("times"))


PROFILE = "SELECT user_id AS key, k, avg((floor(value)::BIGINT % 12 = k)::INTEGER) AS x FROM events, range(12) t(k) GROUP BY 1, 2"


def profiles(spark, d):
    frames = sequences(spark, d).select("key", F.posexplode("frames").alias("n", "pc")).select("key", F.posexplode("pc").alias("k", "x"))
    p = frames.groupBy("key", "k").agg(F.avg("x").alias("x")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("p"))
    return p.select(F.col("key").cast("bigint").alias("key"), F.col("p.x").alias("p"))


@query("Q1_transpositions", f"WITH p AS ({PROFILE}), d AS (SELECT a.key, s, round(sum(a.x * b.x), 9) AS dot FROM p a JOIN p b ON b.key = a.key + 1, range(12) t(s) WHERE a.k = (b.k + s) % 12 GROUP BY 1, 2) SELECT key, arg_min(s, (-dot, s))::INTEGER AS oti FROM d GROUP BY 1")
def q1(spark, d):
    p = profiles(spark, d)
    both = p.join(p.select((F.col("key") - 1).alias("key"), F.col("p").alias("q")), "key")
    dots = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.round(A.dot(F.col("p"), A.roll(F.col("q"), k)), 9))
    return both.select("key", (F.array_position(dots, F.array_max(dots)) - 1).cast("int").alias("oti"))


def aligned(spark, d):
    s = sequences(spark, d)
    pairs = s.select(F.col("key").alias("key_a"), (F.col("key").cast("bigint") + 1).cast("string").alias("key_b"))
    return align.align(pairs, s)


@query("Q2_Q3_alignment")
def q3(spark, d):
    return aligned(spark, d).select("key_a", "key_b", F.round("score", 6).alias("score"), "oti", F.size("path").alias("n_points"), "error")


PATHS = "SELECT doc_id, doc_id % 50 + 30.0 AS dur_a, doc_id % 40 + 25.0 AS dur_b, (doc_id % 30)::DOUBLE AS n FROM documents WHERE doc_id % 30 > 0"


@query(
    "Q4_valid_anchors",
    f"WITH p AS ({PATHS}), l AS (SELECT *, list_filter(list_transform(range(n::INTEGER), lambda i: i * 2.0), lambda t: t >= 10 AND t <= dur_a - 10 AND t + 1 >= 10 AND t + 1 <= dur_b - 10) AS ok FROM p) "
    "SELECT doc_id, CASE WHEN len(ok) > 0 THEN len(ok) ELSE 1 END::INTEGER AS anchors, CASE WHEN len(ok) > 0 THEN ok[1] ELSE (n::INTEGER // 2) * 2.0 END::DOUBLE AS first FROM l",
)
def q4(spark, d):
    p = paths(spark, d).select("doc_id", align.valid_anchors(F.col("path"), 20.0, F.col("dur_a"), F.col("dur_b")).alias("a"))
    return p.select("doc_id", F.size("a").alias("anchors"), F.col("a")[0]["t_a"].alias("first"))


def paths(spark, d):
    docs = table(spark, d, "documents").filter("doc_id % 30 > 0")
    point = lambda i: F.struct((i * 2.0).alias("t_a"), (i * 2.0 + 1).alias("t_b"))
    return docs.select("doc_id", (F.col("doc_id") % 50 + 30.0).cast("double").alias("dur_a"), (F.col("doc_id") % 40 + 25.0).cast("double").alias("dur_b"), F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 30 - 1).cast("int")), point).alias("path"))


@query("Q5_centre_starts", "SELECT doc_id, unnest(range(4))::INTEGER AS slot, unnest(list_transform(range(4), lambda i: round_even((n_chars - 200) * (i + 0.5) / 4, 3)))::DOUBLE AS start FROM documents WHERE n_chars >= 200")
def q5(spark, d):
    starts = table(spark, d, "documents").select("doc_id", A.centre_starts(F.col("n_chars").cast("double"), F.lit(200.0), 4).alias("s")).filter("s IS NOT NULL")
    return starts.select("doc_id", F.posexplode("s").alias("slot", "start"))


@query(
    "Q6_window_pairs",
    f"WITH p AS ({PATHS}), l AS (SELECT *, list_filter(list_transform(range(n::INTEGER), lambda i: i * 2.0), lambda t: t >= 10 AND t <= dur_a - 10 AND t + 1 >= 10 AND t + 1 <= dur_b - 10) AS ok FROM p), "
    "a AS (SELECT *, CASE WHEN len(ok) > 0 THEN ok ELSE [(n::INTEGER // 2) * 2.0] END AS c FROM l), e AS (SELECT *, CASE WHEN len(c) <= 3 THEN c ELSE list_distinct(list_transform(range(3), lambda i: c[round_even((len(c) - 1) * i / 2, 0)::INTEGER + 1])) END AS k FROM a), x AS (SELECT doc_id, dur_a, dur_b, unnest(k)::DOUBLE AS t FROM e), "
    "s AS (SELECT doc_id, t, round_even(least(greatest(t - 10, 0), greatest(dur_a - 20, 0)), 3)::DOUBLE AS start_a, round_even(least(greatest(t + 1 - 10, 0), greatest(dur_b - 20, 0)), 3)::DOUBLE AS start_b FROM x) "
    "SELECT doc_id || '_1' AS key_a, t AS anchor_a, start_a, start_b, doc_id || '_1_' || lpad(round_even(start_a * 1000, 0)::BIGINT::VARCHAR, 8, '0') AS window_a FROM s",
)
def q6(spark, d):
    p = paths(spark, d).withColumn("key_a", F.concat("doc_id", F.lit("_1"))).withColumn("key_b", F.concat("doc_id", F.lit("_2")))
    return align.window_pairs(p, 20.0, 3).select("key_a", "anchor_a", "start_a", "start_b", "window_a")


@query("Q7_random_windows", "SELECT doc_id, round(('0x' || substring(md5('q7:' || doc_id), 1, 13))::BIGINT::DOUBLE / power(2, 52) * greatest(n_chars - 200, 0), 6) AS start FROM documents")
def q7(spark, d):
    from cohortia.functions.hashing import uniform

    return table(spark, d, "documents").select("doc_id", F.round(uniform("q7", F.col("doc_id")) * F.greatest(F.col("n_chars") - 200, F.lit(0)), 6).alias("start"))


@query("Q7_jittered_centres", "SELECT doc_id, k::INTEGER AS candidate, round(n_chars + CASE k WHEN 0 THEN 0 ELSE (2 * (('0x' || substring(md5('q7j:' || doc_id || ':' || k), 1, 13))::BIGINT::DOUBLE / power(2, 52)) - 1) * 1.5 END, 6) AS centre FROM documents, range(5) t(k)")
def q7_jittered(spark, d):
    centres = A.jittered(F.col("n_chars").cast("double"), 5, 1.5, F.lit("q7j"), F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(centres).alias("candidate", "centre")).withColumn("centre", F.round("centre", 6))


#: The 90 moments of frames in CTE `f` (key, pc), a pitch class each, by place: 12 means, then products i <= j.
MOMENTS = (
    "SELECT {key}, i AS pos, avg((pc = i)::INTEGER) AS value FROM f, range(12) t(i) GROUP BY {key}, i UNION ALL "
    "SELECT {key}, 12 + i * 12 - i * (i - 1) // 2 + j - i AS pos, avg((pc = i AND pc = j)::INTEGER) AS value FROM f, range(12) t(i), range(12) s(j) WHERE i <= j GROUP BY {key}, i, j"
)
FRAMES = "SELECT user_id::VARCHAR AS key, floor(value)::BIGINT % 12 AS pc FROM events"


@query("Q8_pitch_class_moments", f"WITH f AS ({FRAMES}) SELECT key, pos::INTEGER AS pos, round(value, 6) AS value FROM ({MOMENTS.format(key='key')})")
def q8(spark, d):
    f = sequences(spark, d).select("key", F.explode("frames").alias("pc"))
    return descriptors.pitch_class_moments(f, "key", "pc").select("key", F.posexplode("moments").alias("pos", "value")).withColumn("value", F.round("value", 6))


def shape_rows() -> str:
    return " UNION ALL ".join(f"SELECT {m} AS minor, {k} AS k, {x} AS w" for m, s in enumerate((descriptors.MAJOR, descriptors.MINOR)) for k, x in enumerate(s))


KEYS = f"p AS ({PROFILE}), s AS ({shape_rows()}), c AS (SELECT key, minor, t, round(corr(p.x, w), 9) AS fit FROM p, range(12) r(t), s WHERE p.k = (s.k + t) % 12 GROUP BY 1, 2, 3), k AS (SELECT key, arg_min(t, (-fit, minor, t))::INTEGER AS tonic, arg_min(minor, (-fit, minor, t)) = 1 AS minor FROM c GROUP BY 1)"


@query("Q9_keys", f"WITH {KEYS} SELECT key, tonic, minor FROM k")
def q9(spark, d):
    p = profiles(spark, d).select("key", descriptors.key_of(F.col("p")).alias("k"))
    return p.select("key", "k.tonic", "k.minor")


def keyed_tracks(spark, d):
    """Each track's sequence with its key."""
    s = sequences(spark, d)
    keys = profiles(spark, d).select(F.col("key").cast("string").alias("key"), descriptors.key_of(F.col("p")).alias("k")).select("key", "k.tonic", "k.minor")
    return s.join(keys, "key")


@query(
    "Q10_rolled_to_tonic",
    f"WITH {KEYS}, f AS (SELECT user_id AS key, (floor(value)::BIGINT % 12 - tonic + 12) % 12 AS pc FROM events JOIN k ON k.key = user_id) "
    f"SELECT key, pos::INTEGER AS pos, round(value, 6) AS value FROM ({MOMENTS.format(key='key')}) UNION ALL SELECT key, 90, minor::INTEGER::DOUBLE FROM k",
)
def q10(spark, d):
    """All 91 numbers: moments with the tonic first, and the mode."""
    f = keyed_tracks(spark, d).select("key", "tonic", F.explode("frames").alias("pc")).select("key", descriptors.to_tonic(F.col("pc"), F.col("tonic")).alias("pc"))
    m = descriptors.pitch_class_moments(f, "key", "pc").join(keyed_tracks(spark, d).select("key", "minor"), "key")
    values = F.concat("moments", F.array(F.col("minor").cast("int").cast("double")))
    return m.select(F.col("key").cast("bigint").alias("key"), F.posexplode(values).alias("pos", "value")).withColumn("value", F.round("value", 6))


def windows_of_tracks(spark, d):
    tracks = keyed_tracks(spark, d).withColumn("starts", descriptors.hop_starts(F.col("times"), 30.0, 15.0))
    return descriptors.described_windows(tracks, 30.0).filter("error IS NULL")


#: Windows of tracks and the frames inside them, as CTEs w and i; frames keep the order of events, their times are sorted.
WINDOWS = (
    "e AS (SELECT user_id AS key, floor(value)::BIGINT % 12 AS pc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), "
    "v AS (SELECT user_id AS key, value AS t, row_number() OVER (PARTITION BY user_id ORDER BY value) AS n FROM events), "
    "m AS (SELECT key, max(t) AS last FROM v GROUP BY 1), w AS (SELECT key, s.k * 15.0::DOUBLE AS start FROM m, range(0, 200) s(k) WHERE s.k * 15.0 < greatest(15.0, last - 15.0)), "
    "i AS (SELECT w.key, w.start, e.pc FROM w JOIN v ON v.key = w.key AND v.t >= w.start AND v.t < w.start + 30 JOIN e ON e.key = v.key AND e.n = v.n)"
)


@query("Q11_Q12_window_descriptors", f"WITH {KEYS}, {WINDOWS} SELECT w.key::VARCHAR AS key, w.start, count(pc) >= 4 AS ok, count(pc) AS n, any_value(k.tonic) AS tonic, any_value(k.minor) AS minor, (count(pc) >= 4)::INTEGER * 108 AS spectrum FROM w JOIN k ON k.key = w.key LEFT JOIN i ON i.key = w.key AND i.start = w.start GROUP BY w.key, w.start")
def q12(spark, d):
    """Which windows each track has, its key, and how many numbers the window's spectrum has; `Q11_patch_spectra` has them."""
    return windows_of_tracks(spark, d).select("key", "start", "ok", "n", "tonic", "minor", F.greatest(F.size("spectrum"), F.lit(0)).alias("spectrum"))


@query(
    "Q12_window_values",
    f"WITH {KEYS}, {WINDOWS}, o AS (SELECT i.key, start, pc, tonic, minor FROM i JOIN k ON k.key = i.key QUALIFY count(*) OVER (PARTITION BY i.key, start) >= 4), "
    f"f AS (SELECT key, start, 'absolute' AS kind, pc FROM o UNION ALL SELECT key, start, 'relative', (pc - tonic + 12) % 12 FROM o) "
    f"SELECT key::VARCHAR AS key, start, kind, pos::INTEGER AS pos, round(value, 6) AS value FROM ({MOMENTS.format(key='key, start, kind')}) UNION ALL SELECT DISTINCT key::VARCHAR, start, 'relative', 90, minor::INTEGER::DOUBLE FROM o",
)
def q12_values(spark, d):
    """The 90 and 91 numbers of every window that is ok."""
    w = windows_of_tracks(spark, d).filter("ok")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("values")) for k in ("absolute", "relative")]))
    long = w.select("key", "start", kinds.alias("k")).select("key", "start", "k.kind", F.posexplode("k.values").alias("pos", "value"))
    return long.withColumn("value", F.round("value", 6))


@query("Q11_patch_spectra")
def q11(spark, d):
    """The 108 numbers of every window that is ok; medians of Fourier magnitudes, held to numpy in the tests."""
    w = windows_of_tracks(spark, d).filter("ok")
    return w.select("key", "start", F.posexplode("spectrum").alias("pos", "value"))


@query("Q13_pooled_frames", f"SELECT id, (i)::INTEGER AS pos, round(list_avg(v[i * 5 + 1 : i * 5 + 5]), 6) AS x FROM ({EMB}), range(12) t(i)")
def q13(spark, d):
    return emb(spark, d).select("id", F.posexplode(A.pooled(F.col("v"), 5)).alias("pos", "x")).select("id", "pos", F.round("x", 6).alias("x"))


@query("Q14_time_means", f"SELECT grp, pos::INTEGER AS pos, round(avg(x), 6) AS x FROM (SELECT grp, unnest(range(64)) AS pos, unnest(v) AS x FROM ({EMB})) GROUP BY 1, 2")
def q14(spark, d):
    from cohortia.operators import moments

    return moments.per_dimension(emb(spark, d), "v", "grp").select("grp", "pos", F.round("mean", 6).alias("x"))


@query("Q15_band_energies", f"SELECT id, b::INTEGER AS band, round(list_sum(list_transform(v[b * 16 + 1 : b * 16 + 16], lambda x: x * x)), 6) AS e FROM ({EMB}), range(4) t(b)")
def q15(spark, d):
    return emb(spark, d).select("id", F.posexplode(A.band_energy(F.col("v"), 4)).alias("band", "e")).select("id", "band", F.round("e", 6).alias("e"))


@query("Q16_log_ratios", f"WITH b AS (SELECT id, list_transform(range(4), lambda b: ln(list_sum(list_transform(v[b * 16 + 1 : b * 16 + 16], lambda x: x * x)))) AS l FROM ({EMB})) SELECT id, unnest(range(4))::INTEGER AS band, unnest(list_transform(l, lambda x: round(x - list_avg(l), 6))) AS r FROM b")
def q16(spark, d):
    return emb(spark, d).select("id", F.posexplode(A.log_ratios(A.band_energy(F.col("v"), 4))).alias("band", "r")).select("id", "band", F.round("r", 6).alias("r"))


@query("X1_X2_score_registry", "SELECT event_type, user_id, round(min(value + 2 * (user_id % 5)), 6) AS min, round(avg(value + 2 * (user_id % 5)), 6) AS mean FROM events GROUP BY 1, 2")
def x1(spark, d):
    from cohortia.operators import scoring

    e = table(spark, d, "events").withColumn("style", F.col("value")).withColumn("content", (F.col("user_id") % 5).cast("double"))
    u = scoring.unit_scores(e, ["event_type", "user_id"], scoring.views(alpha=2.0)["score"], ("min", "mean"))
    return u.select("event_type", "user_id", F.round("min", 6).alias("min"), F.round("mean", 6).alias("mean"))


@query("X3_kernels_report_errors", "SELECT count(*) AS short FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) < 65) a")
def x3(spark, d):
    s = sequences(spark, d)
    pairs = s.select(F.col("key").alias("key_a"), F.col("key").alias("key_b"))
    return align.align(pairs, s, least=65).filter("error LIKE 'under%'").agg(F.count("*").alias("short"))


@query("X4_window_table_function", "SELECT doc_id, s AS slot, s * 500.0::DOUBLE AS start FROM documents, range(0, 1000) t(s) WHERE s * 500 + 1000 <= n_chars")
def x4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n"))
    return descriptors.window_table(docs, "n", 1000.0, 500.0).select("doc_id", "slot", "start")
