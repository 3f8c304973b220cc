"""Queries on energy frames, regions and silence."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet import fixtures
from cuesheet.catalog import sql
from cuesheet.catalog.registry import query
from cuesheet.operators import frames as fr
from cuesheet.plans.session import shared_folder, stage
from cuesheet.sources import jobs as js


def micro(name):
    return F.rint(F.col(name) * 1e6).cast("long").alias(f"{name}_micro")


def duck_micro(name):
    return f"CAST(round_even({name} * 1e6, 0) AS BIGINT) AS {name}_micro"


@query(
    "q_rms",
    f"""WITH {sql.SAMPLES},
r AS (SELECT track_id, idx // 50 AS frame_no, sqrt(sum(v * v) / 50) AS rms FROM samples GROUP BY ALL)
SELECT track_id, frame_no, {duck_micro('rms')} FROM r""",
)
def q_rms(spark, sf_dir):
    return fr.frame_rms(fixtures.samples(spark, sf_dir), fixtures.SAMPLE_RATE).select(
        "track_id", "frame_no", micro("rms")
    )


@query(
    "q_energy",
    f"""WITH {sql.LEVELS}
SELECT track_id, n_frames, {duck_micro('noise_floor')}, {duck_micro('peak')} FROM stats""",
)
def q_energy(spark, sf_dir):
    return fr.energy_stats(fixtures.frames(spark, sf_dir)).select(
        "track_id", "n_frames", micro("noise_floor"), micro("peak")
    )


@query(
    "q_local_ref",
    f"""WITH {sql.LEVELS}
SELECT track_id, frame_no, {duck_micro('local_ref')} FROM levels""",
)
def q_local_ref(spark, sf_dir):
    return fr.local_reference(fixtures.frames(spark, sf_dir), 240).select(
        "track_id", "frame_no", micro("local_ref")
    )


def _levelled(spark, sf_dir):
    frames = stage(fixtures.frames(spark, sf_dir), "frames")
    return frames, fr.thresholds(fr.local_reference(frames), fr.energy_stats(frames))


@query(
    "q_hysteresis",
    f"""WITH {sql.ACTIVE} SELECT track_id, frame_no, active FROM activity""",
)
def q_hysteresis(spark, sf_dir):
    _, levelled = _levelled(spark, sf_dir)
    return fr.hysteresis_active(stage(levelled, "levels"), 240).select("track_id", "frame_no", "active")


@query("q_runs", f"""WITH {sql.RUNS} SELECT * FROM runs""")
def q_runs(spark, sf_dir):
    _, levelled = _levelled(spark, sf_dir)
    return fr.activity_runs(stage(fr.activity_pieces(levelled, 240), "pieces"))


@query(
    "q_regions",
    f"""WITH RECURSIVE {sql.REGIONS}
SELECT track_id, CAST(s AS BIGINT) AS start_sample, CAST(e AS BIGINT) AS end_sample
FROM pieces_of_region WHERE e - s >= 3200""",
)
def q_regions(spark, sf_dir):
    frames = stage(fixtures.frames(spark, sf_dir), "frames")
    regions = fr.vocal_regions(frames, fixtures.frame_sizes(frames))
    return regions.select(
        "track_id", F.col("start").alias("start_sample"), F.col("end").alias("end_sample")
    )


@query(
    "q_silent_gap",
    f"""WITH {sql.SAMPLES},
gaps AS (
  SELECT track_id, n_samples, g AS gap_no, 0.1e0 + g * 0.1e0 + (track_id % 5) * 0.05e0 AS gs,
         0.3e0 + g * 0.2e0 + (track_id % 4) * 0.1e0 AS ge
  FROM sizes, (SELECT UNNEST(range(0, 3)) AS g)),
b AS (
  SELECT *, CAST(trunc((gs + least(0.045e0, (ge - gs) * 0.18e0)) * 1000) AS BIGINT) AS lo,
         least(n_samples, CAST(trunc((ge - least(0.045e0, (ge - gs) * 0.18e0)) * 1000) AS BIGINT)) AS hi,
         50 AS rlo, least(n_samples, 980) AS rhi
  FROM gaps),
el AS (SELECT * FROM b WHERE ge - gs >= 0.18e0 AND n_samples >= 320 AND hi - lo >= 90 AND rhi - rlo >= 50),
word AS (
  SELECT track_id, gap_no, quantile_cont(rms, 0.82) AS voiced FROM (
    SELECT el.track_id, gap_no, (idx - rlo) // 25 AS f, sqrt(sum(v * v) / 25) AS rms
    FROM el JOIN samples s ON s.track_id = el.track_id AND idx >= rlo AND idx < rhi GROUP BY ALL)
  GROUP BY ALL),
inner_frames AS (
  SELECT el.track_id, gap_no, (idx - lo) // 25 AS f, sqrt(sum(v * v) / 25) AS rms
  FROM el JOIN samples s ON s.track_id = el.track_id AND idx >= lo AND idx < hi GROUP BY ALL),
q AS (
  SELECT i.*, voiced, rms <= greatest(8e-4, voiced * 0.22e0) AS quiet
  FROM inner_frames i JOIN word USING (track_id, gap_no)),
isl AS (
  SELECT *, f - row_number() OVER (PARTITION BY track_id, gap_no, quiet ORDER BY f) AS g FROM q),
runs AS (SELECT track_id, gap_no, count(*) AS n FROM isl WHERE quiet GROUP BY track_id, gap_no, g),
verdict AS (
  SELECT track_id, gap_no, max(voiced) AS voiced, avg(CASE WHEN quiet THEN 1e0 ELSE 0e0 END) AS share,
         coalesce((SELECT max(n) FROM runs r WHERE r.track_id = q.track_id AND r.gap_no = q.gap_no), 0) AS longest
  FROM q GROUP BY track_id, gap_no)
SELECT gaps.track_id, CAST(gaps.gap_no AS BIGINT) AS gap_no,
       coalesce(voiced >= 1e-3 AND longest * 25 / 1000e0 >= 0.1e0 AND share >= 0.45e0, FALSE) AS silent,
       {duck_micro('voiced')}
FROM gaps LEFT JOIN verdict USING (track_id, gap_no)""",
)
def q_silent_gap(spark, sf_dir):
    samples = fixtures.samples(spark, sf_dir)
    sizes = fixtures.sample_sizes(samples)
    found = fr.silent_gaps(fixtures.gaps(sizes), samples, sizes, fixtures.SAMPLE_RATE)
    return found.select("track_id", "gap_no", "silent", micro("voiced"))


@query(
    "q_inaudible",
    f"""WITH {sql.SAMPLES},
segments AS (
  SELECT track_id, g AS segment, g * 100 AS lo, least(n_samples, g * 100 + 250 + (track_id % 3) * 60) AS hi
  FROM sizes, (SELECT UNNEST(range(0, 8)) AS g)),
e AS (
  SELECT s.track_id, segment, count(*) AS n, sqrt(avg(v * v)) AS rms
  FROM segments s JOIN samples x ON x.track_id = s.track_id AND idx >= lo AND idx < hi GROUP BY ALL)
SELECT track_id, CAST(segment AS BIGINT) AS segment FROM e WHERE n >= 320 AND rms >= 1e-4""",
)
def q_inaudible(spark, sf_dir):
    samples = fixtures.samples(spark, sf_dir)
    segments = fixtures.sample_sizes(samples).select(
        "track_id", "n_samples", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("segment")
    ).select(
        "track_id", F.col("segment").cast("long").alias("segment"),
        (F.col("segment") * 100).cast("long").alias("start_sample"),
        F.least("n_samples", F.col("segment") * 100 + 250 + (F.col("track_id") % 3) * 60).alias("end_sample"),
    )
    return fr.drop_inaudible(segments, samples).select("track_id", "segment")


@query(
    "q_series",
    f"""WITH {sql.FRAMES},
v AS (SELECT vec_id, UNNEST(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)
SELECT 'samples' AS series, CAST(vec_id // 16 AS BIGINT) AS id, CAST(vec_id % 16 * 64 + p AS BIGINT) AS place,
  CAST(round_even(CAST(CAST(CASE WHEN vec_id // 16 % 2 = 0 AND vec_id % 16 * 64 + p BETWEEN 300 AND 700
    THEN x::DOUBLE * 0.01e0 ELSE x::DOUBLE END AS FLOAT) AS DOUBLE) * 1e6, 0) AS BIGINT) AS value_micro FROM v
UNION ALL
SELECT 'emissions', CAST(vec_id AS BIGINT), CAST(p AS BIGINT), CAST(round_even(-abs(x::DOUBLE) * 10 * 1e6, 0) AS BIGINT) FROM v
UNION ALL
SELECT 'frames', CAST(track_id AS BIGINT), CAST(frame_no AS BIGINT), CAST(round_even(rms * 1e6, 0) AS BIGINT) FROM frames""",
)
def q_series(spark, sf_dir):
    """Number series are written as tables and read with their readers."""
    folder = shared_folder(spark, "series")
    fixtures.samples(spark, sf_dir).withColumn("v", F.col("v").cast("float")).write.parquet(f"{folder}/samples")
    fixtures.frames(spark, sf_dir).write.parquet(f"{folder}/frames")
    fixtures.emissions(spark, sf_dir).write.parquet(f"{folder}/emissions")
    shape = lambda df, name, key, place, value: df.select(
        F.lit(name).alias("series"), F.col(key).alias("id"), place.cast("long").alias("place"),
        F.rint(F.col(value).cast("double") * 1e6).cast("long").alias("value_micro"))
    return shape(js.read_samples(spark, f"{folder}/samples"), "samples", "track_id", F.col("idx"), "v").unionByName(
        shape(js.read_emissions(spark, f"{folder}/emissions"), "emissions", "segment_id", F.col("frame") * 8 + F.col("token_id"), "logp")
    ).unionByName(shape(js.read_frames(spark, f"{folder}/frames"), "frames", "track_id", F.col("frame_no"), "rms"))
