"""Timing documents: read JSON of several shapes, write exports, lyric files and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuesheet.functions.numeric import round_exact
from cuesheet.functions.text import lrc_stamp, normalize_for_evaluation, safe_title, strip_space
from cuesheet.sources.files import write_texts

MALFORMED = {
    "json": "not a JSON document",
    "root": "needs a word array, or 'words' or 'lines'",
    "line": "every line must be an object with a word array",
    "item": "word arrays may contain only strings or objects",
    "time": "invalid or unpaired timestamp",
}


def _is(kind: str, variant: str) -> str:
    return f"coalesce(startswith(schema_of_variant({variant}), '{kind}'), false)"


def read_timing_items(docs: DataFrame) -> DataFrame:
    """Documents (columns kept, text in ``value``) to one row per word item or per problem."""
    keep = [c for c in docs.columns if c != "value"]
    parsed = docs.select(*keep, F.try_parse_json("value").alias("doc")).selectExpr(
        *keep,
        "doc",
        "try_variant_get(doc, '$.words', 'variant') AS words",
        "try_variant_get(doc, '$.lines', 'variant') AS lines",
    ).selectExpr(
        *keep,
        f"CASE WHEN doc IS NULL THEN 'json' WHEN {_is('ARRAY', 'doc')} THEN 'array' "
        f"WHEN {_is('ARRAY', 'words')} THEN 'words' WHEN {_is('ARRAY', 'lines')} THEN 'lines' "
        "ELSE 'root' END AS shape",
        f"CASE WHEN {_is('ARRAY', 'doc')} THEN doc WHEN {_is('ARRAY', 'words')} THEN words "
        "ELSE lines END AS items",
    )
    view, nested_view = (f"{name}_{uuid.uuid4().hex}" for name in ("documents", "lines"))
    parsed.createOrReplaceTempView(view)
    spark, columns = docs.sparkSession, ", ".join(keep)
    flat = spark.sql(
        f"SELECT {columns}, 0 AS line_pos, i.pos AS item_pos, 'lead' AS inherited, i.value AS item "
        f"FROM {view}, LATERAL variant_explode(items) i WHERE shape IN ('array', 'words')"
    )
    lines = spark.sql(
        f"SELECT {columns}, l.pos AS line_pos, l.value AS line, "
        f"{_is('OBJECT', 'l.value')} AND "
        f"{_is('ARRAY', 'try_variant_get(l.value, \"$.words\", \"variant\")')} AS good "
        f"FROM {view}, LATERAL variant_explode(items) l WHERE shape = 'lines'"
    )
    lines.createOrReplaceTempView(nested_view)
    nested = spark.sql(
        f"SELECT {columns}, line_pos, i.pos AS item_pos, "
        "coalesce(nullif(try_variant_get(line, '$.kind', 'string'), ''), 'lead') AS inherited, "
        f"i.value AS item FROM {nested_view}, "
        "LATERAL variant_explode(try_variant_get(line, '$.words', 'variant')) i WHERE good"
    )
    broken = (
        spark.table(view).filter("shape IN ('json', 'root')").select(*keep, F.col("shape").alias("problem"))
        .unionByName(
            lines.filter("NOT good").select(*keep, F.lit("line").alias("problem"))
        )
    )
    for name in (view, nested_view):  # the frames above hold their plans
        spark.catalog.dropTempView(name)
    items = flat.unionByName(nested).selectExpr(
        *keep, "line_pos", "item_pos", "inherited", "item",
        f"{_is('STRING', 'item')} AS is_string", f"{_is('OBJECT', 'item')} AS is_object",
    )
    raw = items.selectExpr(
        *keep, "line_pos", "item_pos",
        "CASE WHEN is_string THEN variant_get(item, '$', 'string') "
        "WHEN is_object AND is_variant_null(variant_get(item, '$.text', 'variant')) THEN 'None' "
        "WHEN is_object THEN coalesce(try_variant_get(item, '$.text', 'string'), '') END AS text",
        "nullif(CASE WHEN is_object THEN try_variant_get(item, '$.start', 'string') END, '') AS raw_start",
        "nullif(CASE WHEN is_object THEN try_variant_get(item, '$.end', 'string') END, '') AS raw_end",
        "lower(coalesce(nullif(CASE WHEN is_object THEN try_variant_get(item, '$.kind', 'string') END, ''), "
        "inherited)) AS kind",
        "CASE WHEN NOT (is_string OR is_object) THEN 'item' END AS problem",
    )
    return raw.unionByName(broken, allowMissingColumns=True)


def read_timings(
    spark: SparkSession, paths, include_adlibs: bool = False, ascii_only: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Evaluation tokens of the good documents, and the bad documents with their reason.

    Partition folders (``label=…``, ``track_id=…``) become columns. A document counts as a
    whole: one bad item or time sends all of it to the second frame.
    """
    docs = spark.read.text(paths, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    items = read_timing_items(docs)
    keep = [c for c in docs.columns if c != "value"]
    times = items.withColumn("text", strip_space(F.col("text"))).withColumn(
        "kind", strip_space(F.col("kind"))
    ).withColumn("normalized", normalize_for_evaluation(F.col("text"), ascii_only))
    seconds = lambda raw: F.col(raw).try_cast("double")
    usable = lambda raw: F.col(raw).isNull() | (
        seconds(raw).isNotNull() & ~F.isnan(seconds(raw)) & seconds(raw).between(0.0, 1.7e308)
    )
    good_times = (
        usable("raw_start") & usable("raw_end")
        & (F.col("raw_start").isNull() == F.col("raw_end").isNull())
        & (F.col("raw_start").isNull() | (seconds("raw_end") >= seconds("raw_start")))
    )
    judged = times.withColumn(
        "problem",
        F.coalesce(
            "problem",
            F.when((F.col("normalized") != "") & ~F.coalesce(good_times, F.lit(False)), "time"),
        ),
    )
    reasons = F.create_map(*[F.lit(x) for pair in MALFORMED.items() for x in pair])
    bad = (
        judged.filter(F.col("problem").isNotNull())
        .groupBy("path").agg(F.min("problem").alias("problem"))
        .withColumn("reason", F.element_at(reasons, F.col("problem")))
    )
    tokens = judged.join(bad.select("path"), "path", "left_anti").filter(F.col("normalized") != "")
    if not include_adlibs:
        tokens = tokens.filter(F.col("kind") != "adlib")
    position = (F.shiftleft(F.col("line_pos").cast("long"), 32) + F.col("item_pos")).alias("pos")
    return (
        tokens.select(
            *keep, position, "text", "normalized",
            seconds("raw_start").alias("start"), seconds("raw_end").alias("end"), "kind",
        ),
        bad,
    )


def timing_documents(
    lines: DataFrame, tracks: DataFrame, schema_id: str, exported_at: Column
) -> DataFrame:
    """One versioned document per track: (track_id, file_name, value).

    ``lines`` are numbered lines; ``tracks`` has title, artist, duration and a nullable
    ``processing`` struct, which is written as an explicit null when missing.
    """
    line = F.struct(
        "line_no", F.col("line_id").alias("id"), "start", "end", "words", "kind"
    )
    collected = lines.groupBy("track_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    shaped = F.transform("lines", lambda l: l.dropFields("line_no"))
    document = F.struct(
        F.lit(schema_id).alias("schema"), "title", "artist", "duration",
        F.lit(True).alias("generatedOnDevice"), exported_at.alias("exportedAt"),
        "processing", shaped.alias("lines"),
    )
    return tracks.join(collected, "track_id").select(
        "track_id",
        F.concat(safe_title(F.col("title")), F.lit("-word-timings.json")).alias("file_name"),
        F.to_json(document, {"ignoreNullFields": "false"}).alias("value"),
    )


def write_timing_export(documents: DataFrame, path: str) -> None:
    """One JSON text file per track, in a folder per track."""
    write_texts(documents, path, ["track_id"])


def lrc_lines(lines: DataFrame) -> DataFrame:
    """``[MM:SS.cc]word word`` per numbered line."""
    return lines.select(
        "track_id", "line_no",
        F.concat(
            lrc_stamp(F.col("start")),
            F.array_join(F.transform("words", lambda w: w["text"]), " "),
        ).alias("value"),
    )


def write_lrc(lines: DataFrame, path: str) -> None:
    """One lyric file per track, below ``track_id=...``, in line order. A file is one task's work
    by nature; the tracks spread over the tasks."""
    write_texts(lrc_lines(lines), path, ["track_id"], order=("line_no",))


def _percent(name: str) -> Column:
    return F.coalesce(F.format_string("%.2f%%", round_exact(F.col(name) * 100, 2)), F.lit("n/a"))


def _millis(name: str) -> Column:
    return F.coalesce(F.format_string("%.1f", round_exact(F.col(name), 1)), F.lit("n/a"))


def report_text(metrics: DataFrame) -> DataFrame:
    """Readable block per (track, label); missing values print as n/a."""
    shown = lambda name, form: F.when(F.col(name).isNull(), "n/a").otherwise(form(name))
    percent, millis = (lambda n: shown(n, _percent)), (lambda n: shown(n, _millis))
    counts = F.concat_ws("/", "substitutions", "deletions", "insertions")
    body = F.concat_ws(
        "\n",
        F.col("label"),
        F.concat(F.lit("  WER: "), percent("wer")),
        F.concat(F.lit("  CER: "), percent("cer")),
        F.concat(F.lit("  S/D/I: "), counts),
        F.concat(F.lit("  Timing coverage: "), percent("reference_coverage")),
        F.concat(F.lit("  Onset MAE / P90: "), millis("onset_mae_ms"), F.lit(" / "),
                 millis("onset_p90_ms"), F.lit(" ms")),
        F.concat(F.lit("  Onset bias: "), millis("onset_bias_ms"), F.lit(" ms")),
        F.concat(F.lit("  Offset MAE / P90: "), millis("offset_mae_ms"), F.lit(" / "),
                 millis("offset_p90_ms"), F.lit(" ms")),
    )
    return metrics.select("track_id", "label", body.alias("value"))


def report_json(metrics: DataFrame) -> DataFrame:
    """Metrics with the timing values nested, as JSON."""
    timing = [
        c for c in metrics.columns
        if c.endswith("_ms") or c.startswith("onset_within") or c in ("matched_words", "reference_coverage")
    ]
    outer = [c for c in metrics.columns if c not in timing and c not in ("track_id", "label")]
    payload = F.struct(
        "label", F.struct(*outer, F.struct(*timing).alias("timing")).alias("metrics")
    )
    return metrics.select(
        "track_id", "label", F.to_json(payload, {"ignoreNullFields": "false"}).alias("value")
    )


def write_report(metrics: DataFrame, path: str, form: str = "text") -> None:
    rendered = report_json(metrics) if form == "json" else report_text(metrics)
    write_texts(rendered, path, ["track_id"], order=("value",))
