"""Transcript comparison, timing documents and reports."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cuesheet.functions.edit import edit_path
from cuesheet.operators import evaluation as ev
from cuesheet.sources import timings as tm

TOKENS = "track_id long, label string, pos long, text string, start double, end double, kind string"


def tokens(spark, rows, label=None):
    data = [(1, label, i, t, s, e, "lead") for i, (t, s, e) in enumerate(rows)]
    return ev.validated(ev.evaluation_tokens(spark.createDataFrame(data, TOKENS)))


def metrics(spark, reference, candidate):
    ref = tokens(spark, reference).drop("label")
    return ev.evaluate(ref, tokens(spark, candidate, "c")).first()


def test_timing_errors(spark):
    m = metrics(spark, [("one", 1.0, 1.4), ("two", 2.0, 2.3)], [("one", 1.1, 1.5), ("two", 2.2, 2.4)])
    assert (m.onset_mae_ms, m.onset_bias_ms, m.onset_p90_ms) == (150.0, 150.0, 190.0)
    assert m.reference_coverage == 1.0


def test_error_counts_without_times(spark):
    none = lambda text: [(w, None, None) for w in text.split()]
    m = metrics(spark, none("one two three"), none("one too four five"))
    assert (m.matches, m.substitutions, m.deletions, m.insertions) == (1, 2, 0, 1)
    assert m.wer == 1.0 and m.onset_mae_ms is None and m.onset_within_50ms is None


def test_empty_candidate_counts_deletions(spark):
    ref = tokens(spark, [("one", None, None), ("two", None, None)]).drop("label")
    cand = tokens(spark, [], "c")
    pairs = spark.createDataFrame([(1, "c")], "track_id long, label string")
    assert ev.evaluate(ref, cand, pairs).first().deletions == 2


def test_empty_reference_is_an_error(spark):
    ref = tokens(spark, []).drop("label")
    with pytest.raises(PySparkException, match="no evaluable words"):
        ev.evaluate(ref, tokens(spark, [("one", None, None)], "c")).collect()


def test_unpaired_timestamp_is_an_error(spark):
    with pytest.raises(PySparkException, match="only one timestamp"):
        tokens(spark, [("one", 1.0, None)]).collect()


def full_table_path(ref, cand):
    n, m = len(ref), len(cand)
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 or j == 0:
                cost[i][j] = i + j
            else:
                cost[i][j] = min(cost[i - 1][j - 1] + (ref[i - 1] != cand[j - 1]),
                                 cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    ops, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (ref[i - 1] != cand[j - 1]):
            ops.append(int(ref[i - 1] != cand[j - 1])), (i := i - 1), (j := j - 1)
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            ops.append(2), (i := i - 1)
        else:
            ops.append(3), (j := j - 1)
    return ops[::-1]


def test_edit_path_equals_full_table():
    random.seed(2)
    for _ in range(200):
        ref = [random.choice("abcd") for _ in range(random.randint(0, 30))]
        cand = [random.choice("abcd") for _ in range(random.randint(0, 30))]
        assert list(edit_path(ref, cand)[0]) == full_table_path(ref, cand)


def test_labels(spark):
    df = spark.createDataFrame([("fast=/x/a.json",), ("/x/best.run.json",)], "s string")
    assert [r[0] for r in df.select(ev.candidate_label(F.col("s"))).collect()] == ["fast", "best.run"]
    with pytest.raises(PySparkException, match="cannot be empty"):
        spark.createDataFrame([(" =a.json",)], "s string").select(ev.candidate_label(F.col("s"))).collect()


DOCUMENTS = {
    "lines": {"lines": [{"words": [{"text": "Main", "start": 1, "end": "1.5"}]},
                        {"kind": "adlib", "words": ["yeah"]}]},
    "both": {"words": ["only", {"text": "these", "kind": "ADLIB"}], "lines": [{"words": ["not"]}]},
    "array": ["plain", {"text": "x", "start": 0.0, "end": 0.2}, "—"],
    "half": {"words": [{"text": "bad", "start": 1.0}]},
    "backwards": [{"text": "bad", "start": 2.0, "end": 1.0}],
    "number": [5], "root": {"title": 1}, "line": {"lines": [{"kind": "lead"}]},
}


def test_timing_documents_of_all_shapes(spark, tmp_path):
    for name, document in DOCUMENTS.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(document))
    (tmp_path / "broken.json").write_text("{")
    stem = lambda path: path.rsplit("/", 1)[-1][:-5]
    for adlibs in (False, True):
        good, bad = tm.read_timings(spark, str(tmp_path), include_adlibs=adlibs)
        texts = {}
        for r in good.orderBy("path", "pos").collect():
            texts.setdefault(stem(r.path), []).append(r.text)
        extra = {"lines": ["Main", "yeah"], "both": ["only", "these"]} if adlibs else {"lines": ["Main"], "both": ["only"]}
        assert texts == {**extra, "array": ["plain", "x"]}
        assert {stem(r.path): r.problem for r in bad.collect()} == {
            "half": "time", "backwards": "time", "number": "item", "root": "root", "line": "line", "broken": "json",
        }


def test_report(spark):
    ref = tokens(spark, [("one", 1.0, 1.4), ("two", None, None)]).drop("label")
    found = ev.evaluate(ref, tokens(spark, [("one", None, None)], "c"))
    text = tm.report_text(found).first().value
    assert "  WER: 50.00%" in text and "  S/D/I: 0/1/0" in text and "  Onset MAE / P90: n/a / n/a ms" in text
    payload = json.loads(tm.report_json(found).first().value)
    assert payload["metrics"]["timing"]["onset_mae_ms"] is None and payload["metrics"]["wer"] == 0.5


def test_report_rounds_the_binary_value(spark):
    """20.45 lies below its tie as a double, 54.25 and 3.125 are true ties and go to the even digit."""
    found = ev.evaluate(tokens(spark, [("one", 1.0, 1.4)]).drop("label"), tokens(spark, [("one", 1.0, 1.4)], "c"))
    text = tm.report_text(found.withColumns({
        "wer": F.lit(0.03125), "onset_bias_ms": F.lit(20.45), "onset_mae_ms": F.lit(54.25)})).first().value
    assert "  WER: 3.12%" in text and "  Onset bias: 20.4 ms" in text and "  Onset MAE / P90: 54.2 / " in text
