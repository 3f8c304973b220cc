import glob
import os

import pytest

from cuesheet.catalog.jobs import q_restore
from cuesheet.plans.session import shared_folder
from cuesheet.sources import files, jobs as js
from cuesheet.sources.files import mounted, write_texts

ROWS = [("a/b=1", 2, "zwei"), ("a/b=1", 1, "eins\nund"), ("", 1, "leer"), (None, 1, "nichts"), ("ä {x}", 1, None), ("ä {x}", 2, "ß")]


def test_files_lie_and_read_like_those_of_sparks_writer(spark):
    rows = spark.createDataFrame(ROWS, "k string, n int, value string")
    ours, theirs = shared_folder(spark, "ours"), shared_folder(spark, "theirs")
    write_texts(rows, ours, ["k"], order=("n",))
    rows.repartition("k").sortWithinPartitions("k", "n").select("k", "value").write.partitionBy("k").text(theirs)
    read = lambda folder: {(r.k, r.value) for r in spark.read.text(folder, wholetext=True).collect()}
    assert read(ours) == read(theirs)
    assert sorted(os.listdir(ours)) == sorted(f for f in os.listdir(theirs) if not f.startswith("."))
    # a checksum file means Hadoop's local file system, which starts two processes for each file
    assert not glob.glob(f"{ours}/**/.*", recursive=True)
    with pytest.raises(Exception, match="exists"):
        write_texts(rows, ours, ["k"])


def test_named_files_share_folders(spark):
    rows = spark.range(20).selectExpr("id % 3 AS shelf", "id AS page", "repeat('ü', cast(id AS int)) AS value")
    folder = shared_folder(spark, "named")
    write_texts(rows, folder, ["shelf"], "page")
    found = {os.path.relpath(f, folder): os.path.getsize(f) for f in glob.glob(f"{folder}/*/*")}
    assert found == {f"shelf={i % 3}/page={i}.txt": 2 * i + 1 for i in range(20)}


def test_only_mounted_paths_are_written_by_tasks(spark):
    assert mounted(spark, "file:///a/b") == mounted(spark, "file:/a/b") == mounted(spark, "/a/b") == "/a/b"
    assert [mounted(spark, p) for p in ("hdfs://h/a", "s3a://b/a", "viewfs://store/a", "file://host/a")] == [None] * 4


@pytest.mark.parametrize("by_tasks", [True, False])
def test_documents_of_many_jobs_share_folders(spark, monkeypatch, by_tasks):
    """Written by tasks or by Spark's writer; cut off metadata and empty files count as they do in a folder for each job."""
    if not by_tasks:
        monkeypatch.setattr(files, "mounted", lambda spark, path: None)
    about = ["{}", '{"schema": 2, "filename": "t', '{"quality": "fast"}']
    rows = spark.createDataFrame(
        [(document, n % 2, f"{n:032x}", value) for n in range(3) for document, value in (("result", f'{{"ok": true, "error": "{n}"}}'), ("job", about[n]))],
        "document string, shelf int, job_id string, value string")
    folder = shared_folder(spark, "shelves")
    write_texts(rows, folder, ["document", "shelf"], "job_id")
    results = js.read_documents(spark, f"{folder}/document=result", js.RESULT_SCHEMA, recursive=True).collect()
    assert sorted((r.job_id, r.error) for r in results) == [(f"{n:032x}", str(n)) for n in range(3)]
    metadata = js.read_metadata(spark, f"{folder}/document=job", recursive=True).collect()
    assert sorted((r.job_id, r.quality, r.broken) for r in metadata) == [
        (f"{0:032x}", None, False), (f"{1:032x}", None, True), (f"{2:032x}", "fast", False)]


def test_restored_jobs_list_few_folders(spark, tmp_path):
    """A folder for each job was listed by a path of its own."""
    turns = spark.range(300).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "concat('one two ', id) AS text")
    turns.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    before = set(glob.glob(f"{shared_folder(spark, 'restore').rpartition('/')[0]}/restore-*"))
    restored = q_restore(spark, str(tmp_path))
    (folder,) = set(glob.glob(f"{shared_folder(spark, 'restore').rpartition('/')[0]}/restore-*")) - before
    assert len(glob.glob(f"{folder}/document=result/**/*.txt", recursive=True)) == 300
    assert len(glob.glob(f"{folder}/document=result/*")) <= 256
    assert restored.count() == sum(n % 10 != 9 and n % 8 != 5 and n % 7 != 3 for n in range(300))
