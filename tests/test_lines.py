"""Line-aligned file sets and JSON arrays read in splits."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from textsql.operators import evaluate as ev
from textsql.sources import lines as L
from textsql.sources.catalog import EXAMPLE_SCHEMA, read_examples, read_raw_catalog

from tests.named import TRAM_CATALOG


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def _nasty(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "\n", "é", "😀", "a", " ", ":"]) for _ in range(rng.randrange(40)))


@pytest.mark.parametrize("indent, ascii_only", [(None, True), (2, False)])
def test_array_elements_keep_their_positions(spark, tmp_path, small_splits, indent, ascii_only):
    rng = random.Random(5)
    rows = [{"db_id": f"d{i % 7}", "extra": {"a": [{"b": _nasty(rng)}, []], "c": {}}, "question": _nasty(rng), "query": _nasty(rng)} for i in range(150)]
    path = tmp_path / "x.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=ascii_only))
    assert L._split_lines(spark, str(path), "}").select("_block").distinct().count() > 8
    got = sorted(read_examples(spark, str(path)).collect())
    assert [tuple(r) for r in got] == [(i, r["db_id"], r["question"], r["query"]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("text, n", [("[]", 0), (" [ \n] \n", 0), ("[{}]", 1), ('[{"db_id": "}"}]\n', 1), ("", 0), ("[{},{}]", 2)])
def test_small_arrays(spark, tmp_path, text, n):
    (tmp_path / "x.json").write_text(text)
    assert [r.position for r in L.array_elements(spark, str(tmp_path / "x.json")).orderBy("position").collect()] == list(range(n))


@pytest.mark.parametrize("text", ['[1, {"db_id": "a"}]', '[{"db_id": "a"}, null]', '[{"db_id": "a"}, {"db_id": "b"'])
def test_other_elements_are_refused(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="not an array of objects"):
        L.read_array(spark, str(tmp_path / "x.json"), EXAMPLE_SCHEMA, "question_id").collect()


def test_catalog_as_one_array(spark, tmp_path):
    (tmp_path / "tables.json").write_text(json.dumps([TRAM_CATALOG, {**TRAM_CATALOG, "db_id": "other"}], indent=1))
    (tmp_path / "lines.json").write_text(json.dumps(TRAM_CATALOG) + "\n" + json.dumps({**TRAM_CATALOG, "db_id": "other"}))
    a = read_raw_catalog(spark, str(tmp_path / "tables.json"), multiline=True)
    b = read_raw_catalog(spark, str(tmp_path / "lines.json"))
    assert sorted(a.collect()) == sorted(b.collect()) and a.columns == b.columns


def test_evaluator_files_stay_paired(spark, tmp_path, small_splits):
    rows = [(i, f"d{i}", f" select {i}\n from t " if i % 5 else None, f"SELECT {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "question_id long, db_id string, predicted_sql string, query string").repartition(7)
    path = str(tmp_path / "files")
    assert ev.write_evaluator_files(df, path, rows_per_file=60) == 1
    parts = sorted((tmp_path / "files").glob("attempt-*/pred/part=*"), key=lambda p: int(p.name[5:]))
    assert len(parts) == 5 and all(len(list(p.glob("part-*"))) == 1 for p in parts)
    written = "".join(next(p.glob("part-*")).read_text() for p in parts).splitlines()
    assert written == [f"select {i}  from t" if i % 5 else "SELECT 1" for i in range(300)]
    got = [tuple(r) for r in ev.read_evaluator_files(spark, path).orderBy("line_no").collect()]
    assert got == [(i + 1, written[i], f"SELECT {i}", f"d{i}") for i in range(300)]


def test_a_retry_replaces_and_a_dead_attempt_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "files")
    df = spark.createDataFrame([(2, "b"), (1, "a"), (1, "A"), (3, None)], "k long, v string")
    assert L.write_aligned(df, ["k"], {"v": F.col("v")}, path) == 1
    assert L.write_aligned(df, ["k"], {"v": F.col("v")}, path, rows_per_file=3) == 2
    with pytest.raises(Exception, match="line feed"):
        L.write_aligned(df.withColumn("v", F.lit("x\ny")), ["k"], {"v": F.col("v")}, path)
    assert [tuple(r) for r in L.read_aligned(spark, path, ["v"]).orderBy("line_no").collect()] == [(1, "A"), (2, "a"), (3, "b"), (4, "")]
    newest = spark.read.json(f"{path}/manifest").orderBy(F.desc("commit")).first().folder
    cut = next((tmp_path / "files" / newest / "v" / "part=0").glob("part-*"))
    cut.write_text("A\n")
    (cut.parent / f".{cut.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="other lines than its manifest"):
        L.read_aligned(spark, path, ["v"]).collect()
    assert L.write_aligned(df.limit(0), ["k"], {"v": F.col("v")}, path) == 3
    assert L.read_aligned(spark, path, ["v"]).count() == 0


def test_missing_set(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        L.read_aligned(spark, str(tmp_path / "none"), ["v"])
