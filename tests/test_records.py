"""Records cut out of split files: JSON arrays, JSON lines with faults, quoted CSV."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from dialectic.sources import records as R
from dialectic.sources.readers import load_preferences, load_preferences_checked, read_csv
from dialectic.sources.sinks import append_log, write_csv


@pytest.fixture()
def small_splits(spark):
    """Splits of a few hundred bytes, so that records cross them."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("400", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def _prefs(n, seed=1):
    rnd = random.Random(seed)
    text = lambda: "".join(rnd.choice(['a', '"', "\\", "{", "}", "[", "]", ",", "\n", "é", "日", ":"])
                           for _ in range(rnd.randint(0, 60)))
    return [{"prompt": f"p{i}{text()}", "chosen": text(), "rejected": None if i % 4 == 0 else text()} for i in range(n)]


def _rows(df):
    return [(r.prompt, r.chosen, r.rejected) for r in df.orderBy("row_id").collect()]


@pytest.mark.parametrize("style", ["compact", "indented", "escaped", "values", "empty"])
def test_array_in_one_file_is_read_by_many_tasks(spark, tmp_dir, small_splits, style):
    recs = [] if style == "empty" else _prefs(60)
    text = {"compact": json.dumps(recs, ensure_ascii=False, separators=(",", ":")), "indented": json.dumps(recs, indent=2),
            "escaped": "\ufeff \n" + json.dumps(recs) + "\n", "empty": "[ ]",
            "values": "\n\n".join(json.dumps(r, indent=1) for r in recs)}[style]
    with open(f"{tmp_dir}/a.json", "w", encoding="utf-8") as f:
        f.write(text)
    df = load_preferences(spark, tmp_dir, multiline=True)
    assert [r.row_id for r in df.orderBy("row_id").collect()] == list(range(len(recs)))
    assert _rows(df) == [(r["prompt"], r["chosen"], r["rejected"]) for r in recs]
    if recs:
        assert spark.read.option("lineSep", "}").text(tmp_dir).rdd.getNumPartitions() > 5


def test_places_and_raw_bytes(spark, tmp_dir, small_splits):
    with open(f"{tmp_dir}/a.json", "w", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(r, ensure_ascii=False) for r in _prefs(30)) + "\n\n")
    data = open(f"{tmp_dir}/a.json", "rb").read()
    got = R.read_records(spark, tmp_dir, R.LINES).orderBy("row").collect()
    assert [bytes(r.raw) for r in got] == data.splitlines()
    assert all(data[r.place:r.place + len(r.raw)] == bytes(r.raw) for r in got)
    assert [r.whole for r in got] == [True] * 30 + [False]  # the blank last line is no record


def test_bad_records_are_captured(spark, tmp_dir, small_splits):
    good = _prefs(12)
    lines = [json.dumps(r).encode() for r in good]
    lines[2] = lines[2][:-1]
    lines[5] = lines[5] + b" tail"
    lines[6] = b'{"prompt": null, "chosen": "c"}'
    lines[8] = lines[8].replace(b'"p8', b'"\xff')
    lines[9] = b"null"
    lines.insert(4, b"")
    with open(f"{tmp_dir}/x.json", "wb") as f:
        f.write(b"\n".join(lines))
    ok, bad = load_preferences_checked(spark, tmp_dir)
    data = open(f"{tmp_dir}/x.json", "rb").read()
    got = {r.record: r for r in bad.collect()}
    assert {k: r.reason for k, r in got.items()} == {
        2: "malformed_json", 5: "malformed_json", 6: "null_prompt", 8: "invalid_utf8", 9: "malformed_json"}
    assert data[got[9].place:].startswith(b"null") and bytes(got[9].raw) == b"null"
    left = [i for i in range(12) if i not in got]
    assert [r.record for r in ok.orderBy("row_id").collect()] == left
    assert _rows(ok) == [(good[i]["prompt"], good[i]["chosen"], good[i]["rejected"]) for i in left]
    assert [r.row_id for r in ok.orderBy("row_id").collect()] == list(range(len(left)))
    with pytest.raises(Exception, match="at byte"):
        load_preferences(spark, tmp_dir).collect()
    with pytest.raises(Exception, match="at byte"):
        load_preferences(spark, tmp_dir).select("chosen").collect()


def test_array_that_breaks_off(spark, tmp_dir):
    recs = _prefs(5)
    with open(f"{tmp_dir}/a.json", "w", encoding="utf-8") as f:
        f.write(json.dumps(recs)[:-20])
    ok, bad = load_preferences_checked(spark, tmp_dir, multiline=True)
    assert _rows(ok) == [(r["prompt"], r["chosen"], r["rejected"]) for r in recs[:4]]
    assert [(r.record, r.reason) for r in bad.collect()] == [(4, "malformed_json")]


def test_quoted_csv_is_read_by_many_tasks(spark, tmp_dir, small_splits):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice('ab",\n\r\\é ') for _ in range(rnd.randint(1, 40))) + ".", i / 4 if i % 3 else None)
            for i in range(80)]
    df = spark.createDataFrame(rows, "id long, t string, v double")
    write_csv(df.coalesce(1), f"{tmp_dir}/c")
    back = read_csv(spark, f"{tmp_dir}/c", df.schema)
    assert sorted(map(tuple, back.collect())) == rows
    assert spark.read.text(f"{tmp_dir}/c").rdd.getNumPartitions() > 5
    with open(f"{tmp_dir}/hand.csv", "w", newline="") as f:
        w = csv.writer(f)  # \r\n line ends
        w.writerow(["id", "t", "v"])
        w.writerows([(1, "x\ny", 1.5), (2, 'q"q', 2.5)])
    assert sorted(map(tuple, read_csv(spark, f"{tmp_dir}/hand.csv", df.schema).collect())) == [(1, "x\ny", 1.5), (2, 'q"q', 2.5)]
    with open(f"{tmp_dir}/open.csv", "w") as f:
        f.write('id,t,v\n1,"x,2\n3,y,4\n')
    with pytest.raises(Exception, match="open quote"):
        read_csv(spark, f"{tmp_dir}/open.csv", df.schema).collect()


def test_partition_folders_of_a_csv_log(spark, tmp_dir):
    rows = [("007", "a b/c+d%e", 1, "x\n"), (None, "t", 2, "y")]
    df = spark.createDataFrame(rows, "run_id string, type string, step long, prompt string")
    append_log(df, f"{tmp_dir}/log", fmt="csv")
    assert sorted(map(tuple, read_csv(spark, f"{tmp_dir}/log", df.schema).collect()), key=str) == sorted(rows, key=str)


def test_rows_of_several_files_follow_their_paths(spark, tmp_dir, small_splits):
    recs = _prefs(40, seed=9)
    for k in range(4):
        with open(f"{tmp_dir}/part-{k}.json", "w") as f:
            f.write("\n".join(json.dumps(r) for r in recs[10 * k:10 * k + 10]))
    assert _rows(load_preferences(spark, tmp_dir)) == [(r["prompt"], r["chosen"], r["rejected"]) for r in recs]
    assert load_preferences(spark, tmp_dir).agg(F.countDistinct("row_id")).first()[0] == 40
