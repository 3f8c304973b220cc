"""Energy frames to vocal regions, and silence inside words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cuesheet.constants import FRAME_SECONDS, SAMPLE_RATE
from cuesheet.operators.intervals import merge_intervals
from cuesheet.plans.folds import entry_states
from cuesheet.plans.percentiles import exact_percentiles
from cuesheet.plans.scan import BLOCK, Running, cut_groups, running, with_block
from cuesheet.plans.segments import greedy_segments
from cuesheet.plans.session import stage

CONTEXT_FRAMES = 60
FRAMES_PER_BLOCK = 4096
MAX_GAP_FRAMES = 18  # int(0.95 / 0.05) with binary fractions
MIN_RUN_FRAMES = 2
MAX_REGION_SECONDS = 28.5
MIN_CUT_SECONDS = 16.0
MAX_MERGE_GAP_SECONDS = 6.0
PADDING_SECONDS = 0.28
MIN_TAIL_SECONDS = 0.2


def hop_of(sample_rate: int) -> int:
    return max(1, int(FRAME_SECONDS * sample_rate))


def samples_from_arrays(df: DataFrame, array: str = "samples") -> DataFrame:
    """``array<float>`` column to rows (track_id, idx, v)."""
    return df.select("track_id", F.posexplode(array).alias("idx", "v")).select(
        "track_id", F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("v")
    )


def frame_rms(samples: DataFrame, sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """RMS per 50 ms. The last frame is zero-padded, so every sum is divided by the hop."""
    hop = hop_of(sample_rate)
    return samples.groupBy(
        "track_id", F.floor(F.col("idx") / hop).cast("long").alias("frame_no")
    ).agg(F.sqrt(F.sum(F.col("v") * F.col("v")) / hop).alias("rms"))


def energy_stats(frames: DataFrame) -> DataFrame:
    """Noise floor (18th percentile), peak and frame count of each track."""
    sizes = frames.groupBy("track_id").agg(
        F.max("rms").alias("peak"), F.count(F.lit(1)).alias("n_frames")
    )
    floors = exact_percentiles(frames, ["track_id"], "rms", {"noise_floor": 0.18})
    return floors.join(sizes, "track_id")


def local_reference(frames: DataFrame, frames_per_block: int = FRAMES_PER_BLOCK) -> DataFrame:
    """Smaller of the 85th percentiles of the 61 frames up to and from each frame.

    The 61 frames up to frame i are those from frame i - 60, so one percentile per frame is
    enough. Blocks borrow the 60 frames beyond each border, so one shuffle is enough, too.
    Before the first frame and after the last one the edge value is repeated. The 85th
    percentile of 61 values is the 52nd smallest, without interpolation.
    """
    number = F.col("frame_no")
    own = F.floor(number / frames_per_block)
    offset = number % frames_per_block
    place = lambda block, frame: F.struct(block.alias("block"), frame.cast("long").alias("frame"))
    copies = F.array_compact(
        F.array(
            place(own, number),
            F.when(offset >= frames_per_block - CONTEXT_FRAMES, place(own + 1, number)),
            F.when((offset < CONTEXT_FRAMES) & (own > 0), place(own - 1, number)),
        )
    )
    before_first = F.transform(
        F.sequence(F.lit(-CONTEXT_FRAMES), F.lit(-1)), lambda f: place(own, f)
    )
    placed = frames.withColumn("_own", own).withColumn(
        "_at", F.explode(F.when(number == 0, F.concat(copies, before_first)).otherwise(copies))
    )
    window = W.partitionBy("track_id", "_at.block").orderBy("_at.frame")
    values = F.collect_list("rms").over(window.rowsBetween(0, CONTEXT_FRAMES))
    middle = F.lit(51)
    missing = F.array_repeat(
        F.element_at("_values", -1), F.lit(CONTEXT_FRAMES + 1) - F.size("_values")
    )
    ranked = placed.withColumn("_values", values).withColumn(
        "_p",
        F.when(F.size("_values") == CONTEXT_FRAMES + 1, F.get(F.sort_array("_values"), middle))
        .otherwise(F.get(F.sort_array(F.concat("_values", missing)), middle)),
    )
    reached = ranked.withColumn("_before", F.lag("_p", CONTEXT_FRAMES).over(window))
    return reached.filter(
        (F.col("_own") == F.col("_at.block")) & (F.col("_at.frame") == number)
    ).select(*frames.columns, F.least("_before", "_p").alias("local_ref"))


def thresholds(referenced: DataFrame, stats: DataFrame) -> DataFrame:
    """On and off levels of each frame from its local reference and the track's floor."""
    lift = F.greatest(F.lit(0.0), F.col("local_ref") - F.col("noise_floor"))
    return referenced.join(stats.select("track_id", "noise_floor"), "track_id").select(
        *referenced.columns,
        F.greatest(F.lit(0.00025), F.col("noise_floor") + lift * 0.20).alias("on_level"),
        F.greatest(F.lit(0.00018), F.col("noise_floor") + lift * 0.075).alias("off_level"),
    )


def _decision() -> Column:
    """True or false where the level decides whatever the state, null where it holds."""
    return F.when(F.col("rms") >= F.col("on_level"), True).when(
        F.col("rms") < F.col("off_level"), False
    )


def hysteresis_active(levelled: DataFrame, frames_per_block: int = FRAMES_PER_BLOCK) -> DataFrame:
    """Activity per frame: the last deciding level, inactive before the first."""
    blocked = with_block(levelled, F.col("frame_no"), frames_per_block)
    scanned = running(
        blocked, ["track_id"], ["frame_no"], [Running("_state", "last", _decision())]
    )
    return scanned.select(*levelled.columns, F.coalesce("_state", F.lit(False)).alias("active"))


def activity_pieces(levelled: DataFrame, frames_per_block: int = FRAMES_PER_BLOCK) -> DataFrame:
    """Maximal runs of equal state inside each block; null state = as before the block."""
    window = W.partitionBy("track_id", BLOCK).orderBy("frame_no")
    upto = window.rowsBetween(W.unboundedPreceding, 0)
    stated = (
        with_block(levelled, F.col("frame_no"), frames_per_block)
        .select("track_id", "frame_no", BLOCK, _decision().alias("_d"))
        .withColumn("state", F.last("_d", ignorenulls=True).over(upto))
        .withColumn("_new", ~F.col("state").eqNullSafe(F.lag("state", 1).over(window)))
        .withColumn("_run", F.count_if("_new").over(upto))
    )
    return stated.groupBy("track_id", BLOCK, "_run").agg(
        F.first("state").alias("state"),
        F.min("frame_no").alias("first_frame"),
        F.max("frame_no").alias("last_frame"),
    ).drop(BLOCK, "_run")


def activity_runs(pieces: DataFrame, max_gap: int = MAX_GAP_FRAMES, min_run: int = MIN_RUN_FRAMES):
    """Active runs after filling short inner gaps and dropping short runs.

    Only active pieces are needed: two of them belong together when the frames between them
    are at most ``max_gap``, which also rejoins runs that a block border cut.
    """
    blocked = with_block(pieces, F.col("first_frame"), FRAMES_PER_BLOCK * 64)
    resolved = running(
        blocked, ["track_id"], ["first_frame"], [Running("_state", "last", F.col("state"))]
    )
    active = resolved.filter(F.coalesce("_state", F.lit(False))).select(
        "track_id", "first_frame", "last_frame", BLOCK
    )
    grouped = cut_groups(
        active, ["track_id"], ["first_frame"], ["first_frame", "last_frame"],
        lambda before, row: row["first_frame"] - before["last_frame"] - 1 > max_gap, "run",
    )
    return (
        grouped.groupBy("track_id", "run")
        .agg(F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"))
        .filter(F.col("last_frame") - F.col("first_frame") + 1 >= min_run)
        .drop("run")
    )


def padded_runs(runs: DataFrame, sizes: DataFrame, sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """Runs in samples, widened on both sides and kept inside the track."""
    hop, padding = hop_of(sample_rate), int(PADDING_SECONDS * sample_rate)
    return runs.join(sizes.select("track_id", "n_samples"), "track_id").select(
        "track_id",
        F.greatest(F.lit(0), F.col("first_frame") * hop - padding).cast("long").alias("start"),
        F.least("n_samples", (F.col("last_frame") + 1) * hop + padding).cast("long").alias("end"),
    )


def merge_regions(runs: DataFrame, sample_rate: int = SAMPLE_RATE, chunk: int | None = None):
    """Join neighbouring runs while the region stays short enough and the pause small.

    Runs start at least 20 frames apart, so a region of 28.5 s holds at most 30 of them.
    """
    longest_region = int(MAX_REGION_SECONDS * sample_rate)
    widest_gap = int(MAX_MERGE_GAP_SECONDS * sample_rate)
    period = (MAX_GAP_FRAMES + 1 + MIN_RUN_FRAMES - 1) * FRAME_SECONDS
    longest = int(MAX_REGION_SECONDS / period) + 4
    blocked = with_block(runs, F.col("start"), sample_rate * 3600)
    segments = greedy_segments(
        blocked, ["track_id"], ["start", "end"],
        lambda before, row: row["start"] - before["end"] > widest_gap,
        lambda count, first, last, row: (row["end"] - first["start"] > longest_region)
        | (row["start"] - last["end"] > widest_gap)
        | (count >= longest),
        longest, chunk,
    )
    return segments.select(
        "track_id",
        F.element_at("rows", 1)["start"].alias("start"),
        F.element_at("rows", -1)["end"].alias("end"),
    )


def split_regions(
    regions: DataFrame, frames: DataFrame, sample_rate: int = SAMPLE_RATE, chunk_frames: int = 12_000
):
    """Cut regions above 28.5 s at their quietest frame between 16 s and 28.5 s.

    Short regions pass through. A long region is read in chunks of ``chunk_frames`` frames (28.5 s or more), each with the
    frames of one search window after it. What a chunk hands on is its first cut beyond its end; chunks start from a
    guess and fold again where the cut before them turns out different. Cuts fall on the quietest frames, so
    two series of cuts soon meet, and one more round usually settles all chunks.
    """
    hop = hop_of(sample_rate)
    longest = int(MAX_REGION_SECONDS * sample_rate)
    earliest = int(MIN_CUT_SECONDS * sample_rate)
    tail = int(MIN_TAIL_SECONDS * sample_rate)
    ahead = longest // hop + 2
    if chunk_frames < ahead:
        raise ValueError(f"chunk_frames must be at least {ahead}")
    is_long = F.col("end") - F.col("start") > longest
    short = regions.filter(~is_long)
    long = regions.filter(is_long).withColumn("_base", F.floor(F.col("start") / hop))

    spread = long.withColumn(
        BLOCK,
        F.explode(F.sequence(
            F.floor(F.col("_base") / FRAMES_PER_BLOCK), F.floor(F.col("end") / hop / FRAMES_PER_BLOCK))),
    )
    bucketed = frames.select("track_id", "frame_no", "rms").withColumn(BLOCK, F.floor(F.col("frame_no") / FRAMES_PER_BLOCK))
    within = F.col("frame_no") - F.col("_base")
    number = F.floor(within / chunk_frames)
    # the first frames of a chunk also end the search windows of the chunk before it
    numbers = F.when((number > 0) & (within % chunk_frames < ahead), F.array(number - 1, number)).otherwise(F.array(number))
    region = ["track_id", "start", "end"]
    chunks = (
        spread.join(bucketed, ["track_id", BLOCK])
        .filter((within >= 0) & (F.col("frame_no") * hop < F.col("end")))
        .select(*region, "_base", F.explode(numbers).alias("chunk"), "frame_no", "rms")
        .groupBy(*region, "_base", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("frame_no", "rms"))).alias("levels"))
        .select(
            *region, "chunk", F.get("levels", F.lit(0))["frame_no"].alias("first_frame"),
            ((F.col("_base") + (F.col("chunk") + 1) * chunk_frames) * hop).alias("until"),
            F.transform("levels", lambda l: l["rms"]).alias("rows"),
        )
    )
    chunks = stage(chunks, "chunks")

    def cut_after(start: Column) -> Column:
        low = F.floor((start + earliest) / hop)
        high = F.greatest(low + 1, F.floor((start + longest) / hop))
        window = F.slice(
            F.col("rows"), (low - F.col("first_frame") + 1).cast("int"), (high - low).cast("int")
        )
        quiet = low + F.array_position(window, F.array_min(window)) - 1
        return F.least(F.col("end") - tail, F.greatest(start + earliest, quiet * hop))

    def step(cuts: Column, _: Column) -> Column:
        start = F.element_at(cuts, -1)
        return F.when(
            (F.col("end") - start > longest) & (start < F.col("until")),
            F.array_append(cuts, cut_after(start).cast("long")),
        ).otherwise(cuts)

    def cuts_from(entry: Column) -> Column:
        """The cut that a chunk starts from and those it makes; the first chunk starts with its region."""
        begin = F.when(F.col("chunk") == 0, F.col("start")).otherwise(F.col("first_frame") * hop)
        rounds = F.sequence(F.lit(1), F.lit(chunk_frames * hop // earliest + 2))
        return F.aggregate(rounds, F.array(F.coalesce(entry, begin).cast("long")), step)

    nowhere = F.lit(None).cast("long")
    entries = entry_states(
        chunks, region, nowhere, lambda rows, entry: F.element_at(cuts_from(entry), -1), lambda left, first: left)
    pieces = (
        chunks.join(entries, [*region, "chunk"])
        .select(*region, "chunk", "until", cuts_from(F.col("entry")).alias("cuts"))
        .select("*", F.posexplode("cuts").alias("at", "cut"))
        # a cut belongs to the chunk that it lies in
        .filter((F.col("cut") < F.col("until")) & (
            (F.col("chunk") == 0) | (F.col("cut") >= F.col("until") - chunk_frames * hop)))
        .select(
            "track_id", F.col("cut").alias("start"),
            F.coalesce(F.get("cuts", F.col("at") + 1), F.col("end")).alias("end"))
    )
    return short.unionByName(pieces).filter(F.col("end") - F.col("start") >= tail)


def vocal_regions(
    frames: DataFrame, sizes: DataFrame, sample_rate: int = SAMPLE_RATE
) -> DataFrame:
    """Frames to transcription regions in samples.

    ``sizes`` gives n_samples per track. Frames are read for statistics and for thresholds;
    everything after the activity pieces runs on tables of runs, stored once.
    """
    stats = energy_stats(frames)
    audible = stats.join(sizes, "track_id").filter(
        (F.col("peak") >= 0.0005)
        & (F.col("n_samples") >= max(3, int(0.15 * sample_rate)))
    )
    kept = stage(audible.select("track_id", "noise_floor", "n_samples"), "stats")
    levelled = thresholds(local_reference(frames), kept)
    runs = stage(activity_runs(stage(activity_pieces(levelled), "pieces")), "runs")
    merged = merge_intervals(
        padded_runs(runs, kept, sample_rate), "end", sample_rate * 3600
    ).drop("members")
    return split_regions(merge_regions(stage(merged, "merged"), sample_rate), frames, sample_rate)


def drop_inaudible(segments: DataFrame, samples: DataFrame) -> DataFrame:
    """Segments of at least 320 samples whose RMS reaches 1e-4.

    Segments are (track_id, segment, start_sample, end_sample); samples are pre-aggregated.
    """
    width = SAMPLE_RATE
    spread = segments.withColumn(
        BLOCK,
        F.explode(
            F.sequence(F.floor(F.col("start_sample") / width), F.floor(F.col("end_sample") / width))
        ),
    )
    energy = (
        spread.join(samples.withColumn(BLOCK, F.floor(F.col("idx") / width)), ["track_id", BLOCK])
        .filter((F.col("idx") >= F.col("start_sample")) & (F.col("idx") < F.col("end_sample")))
        .groupBy("track_id", "segment")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("v") * F.col("v")).alias("power"))
    )
    loud = energy.filter((F.col("n") >= 320) & (F.sqrt("power") >= 1e-4))
    return segments.join(loud.select("track_id", "segment"), ["track_id", "segment"], "left_semi")


def silent_gaps(gaps: DataFrame, samples: DataFrame, sizes: DataFrame, sample_rate: int = SAMPLE_RATE):
    """Verdict per gap: a long enough quiet run, measured against the level of its word.

    ``gaps`` holds (track_id, gap_no, gap_start, gap_end, word_start, word_end). Samples are
    joined by second, and summed per 25 ms frame of the gap and of the word.
    """
    frame = max(1, int(0.025 * sample_rate))
    at = lambda seconds: (seconds * sample_rate).cast("long")
    length = F.col("gap_end") - F.col("gap_start")
    trim = F.least(F.lit(0.045), length * 0.18)
    ranged = (
        gaps.join(sizes.select("track_id", "n_samples"), "track_id")
        .withColumn("_in_lo", F.greatest(F.lit(0), at(F.col("gap_start") + trim)))
        .withColumn("_in_hi", F.least("n_samples", at(F.col("gap_end") - trim)))
        .withColumn("_ref_lo", F.greatest(F.lit(0), at(F.col("word_start"))))
        .withColumn("_ref_hi", F.least("n_samples", at(F.col("word_end"))))
        .withColumn(
            "_eligible",
            (length >= 0.18)
            & (F.col("n_samples") >= 320)
            & (F.col("_in_hi") - F.col("_in_lo") >= int(0.09 * sample_rate))
            & (F.col("_ref_hi") - F.col("_ref_lo") >= int(0.05 * sample_rate)),
        )
    )
    parts = ranged.filter("_eligible").select(
        "track_id", "gap_no",
        F.explode(
            F.array(
                F.struct(F.lit("gap").alias("part"), F.col("_in_lo").alias("lo"), F.col("_in_hi").alias("hi")),
                F.struct(F.lit("word").alias("part"), F.col("_ref_lo").alias("lo"), F.col("_ref_hi").alias("hi")),
            )
        ).alias("p"),
    ).select("track_id", "gap_no", "p.*")
    spread = parts.withColumn(
        BLOCK, F.explode(F.sequence(F.floor(F.col("lo") / sample_rate), F.floor(F.col("hi") / sample_rate)))
    )
    levels = (
        spread.join(
            samples.withColumn(BLOCK, F.floor(F.col("idx") / sample_rate)), ["track_id", BLOCK]
        )
        .filter((F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi")))
        .groupBy(
            "track_id", "gap_no", "part", F.floor((F.col("idx") - F.col("lo")) / frame).alias("f")
        )
        .agg(F.sqrt(F.sum(F.col("v") * F.col("v")) / frame).alias("rms"))
    )
    voiced = levels.filter(F.col("part") == "word").groupBy("track_id", "gap_no").agg(
        F.percentile("rms", F.lit(0.82)).alias("voiced")
    )
    by_gap = W.partitionBy("track_id", "gap_no")
    quiet = (
        levels.filter(F.col("part") == "gap")
        .join(voiced, ["track_id", "gap_no"])
        .withColumn("quiet", F.col("rms") <= F.greatest(F.lit(0.0008), F.col("voiced") * 0.22))
        .withColumn(
            "_island",
            F.row_number().over(by_gap.orderBy("f"))
            - F.row_number().over(W.partitionBy("track_id", "gap_no", "quiet").orderBy("f")),
        )
        .groupBy("track_id", "gap_no", "quiet", "_island")
        .agg(F.count(F.lit(1)).alias("n"), F.first("voiced").alias("voiced"))
        .groupBy("track_id", "gap_no")
        .agg(
            F.max(F.when(F.col("quiet"), F.col("n"))).alias("longest"),
            (F.sum(F.when(F.col("quiet"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"),
            F.first("voiced").alias("voiced"),
        )
    )
    verdict = (
        (F.col("voiced") >= 0.001)
        & (F.coalesce("longest", F.lit(0)) * frame / sample_rate >= 0.10)
        & (F.col("share") >= 0.45)
    )
    return gaps.join(
        quiet.select("track_id", "gap_no", verdict.alias("silent"), "voiced"),
        ["track_id", "gap_no"], "left",
    ).withColumn("silent", F.coalesce("silent", F.lit(False)))
