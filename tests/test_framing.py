"""Framing: split invariance, borders, and comparison with a plain line-by-line reading."""

from __future__ import annotations

import random
import re
from datetime import datetime

import pytest

from logloom.sources.events import EventColumns, log_events
from logloom.sources.framing import event_fragments, frame_events
from logloom.sources.lines import LINES_SCHEMA, read_lines

START = re.compile(r"[0-9]{2}:[0-9]{2}\.[0-9]+-[0-9]+,")


def plain_reading(lines, name):
    """(raw events of one type) of one file, the obvious way."""
    events, now = [], None
    for line in lines:
        clean = line.strip().replace('""', "<DQ>").replace("''", "<OQ>")
        if START.match(line):
            now = None
            minute, second = int(line[:2]), int(line[3:5])
            if f",{name}," == line[line.index(","):][: len(name) + 2] and minute < 60 and second < 60:
                now = [clean]
                events.append(now)
        elif now is not None:
            now.append(clean)
    return ["<_NL_>".join(e) for e in events]


def random_log(seed, size):
    rnd, lines = random.Random(seed), []
    for i in range(size):
        kind = rnd.random()
        if kind < 0.45:
            name = rnd.choice(["CALL", "CALL", "SCALL", "CALLX", "EXCP"])
            minute = rnd.choice([0, 5, 59, 61])
            lines.append(f"{minute:02d}:{i % 60:02d}.{i}-{i * 7},{name},1,Id={i},Context='a {i}")
        elif kind < 0.5:
            lines.append("")
        else:
            lines.append(rnd.choice(["  more ''x'' ", '\tquoted ""y""', "12:3 no start", f"tail {i}'", "x" * rnd.randint(0, 300)]))
    return lines


@pytest.fixture
def log_tree(tmp_path):
    """Three files of random text, one of them empty of starts at first."""
    expected = []
    for n, (name, end) in enumerate([("24010100.log", "\n"), ("24010101.log", "\r\n"), ("24010102.log", "\r")]):
        folder = tmp_path / "full" / f"rphost_{n}"
        folder.mkdir(parents=True)
        lines = ["before any start"] * 3 + random_log(n, 900)
        (folder / name).write_bytes((end.join(lines) + end).encode())
        expected += plain_reading(lines, "CALL")
    return tmp_path, sorted(expected)


@pytest.mark.parametrize("split", ["400b", "9000b", "128m"])
@pytest.mark.parametrize("batch", ["7", "10000"])
def test_splits_and_batches_do_not_matter(spark, conf, log_tree, split, batch):
    folder, expected = log_tree
    conf("spark.sql.files.maxPartitionBytes", split)
    conf("spark.sql.files.openCostInBytes", "0")
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    lines = read_lines(spark, [str(folder)], ["full"])
    framed = frame_events(lines, "CALL", in_file_order=True)
    assert sorted(r.raw for r in framed.collect()) == expected


def test_lines_in_any_order(spark, log_tree):
    """A table of lines is brought into order first."""
    folder, expected = log_tree
    table = read_lines(spark, [str(folder)], ["full"]).repartition(5, "value")
    assert sorted(r.raw for r in frame_events(table, "CALL").collect()) == expected


def test_staged_equals_lazy(spark, conf, log_tree, tmp_path):
    folder, expected = log_tree
    conf("spark.sql.files.maxPartitionBytes", "4000b")
    conf("spark.sql.files.openCostInBytes", "0")
    lines = read_lines(spark, [str(folder)], ["full"])
    columns = EventColumns(keys=["Id", "Context", "timestamp", "filename"])
    lazy = log_events(lines, columns, "CALL", in_file_order=True)
    staged = log_events(lines, columns, "CALL", in_file_order=True, stage=str(tmp_path / "stage"))
    assert lazy.count() == len(expected)
    assert sorted(map(str, lazy.collect())) == sorted(map(str, staged.collect()))


def test_one_event_over_many_splits(spark, conf, tmp_path):
    """An event far longer than a split: splits without any start pass their lines on."""
    folder = tmp_path / "full" / "p"
    folder.mkdir(parents=True)
    body = [f"line {i}" for i in range(400)]
    lines = ["00:01.1-5,CALL,1,Id=1,Text='", *body, "'", "00:02.1-5,EXCP,1", *body, "00:03.1-5,CALL,1,Id=2"]
    (folder / "24010100.log").write_text("\n".join(lines) + "\n")
    conf("spark.sql.files.maxPartitionBytes", "100b")
    conf("spark.sql.files.openCostInBytes", "0")
    framed = frame_events(read_lines(spark, [str(tmp_path)], ["full"]), "CALL", in_file_order=True).collect()
    assert sorted(r.raw for r in framed) == sorted(plain_reading(lines, "CALL"))
    assert max(r.raw.count("<_NL_>") for r in framed) == 401


def test_no_continuation_across_files(spark):
    rows = [
        ("/x/p/24010100.log", 0, 0, False, "00:01.1-5,CALL,1,Id=1"),
        ("/x/p/24010101.log", 0, 1, False, "belongs to nothing"),
        ("/x/p/24010101.log", 0, 2, False, "00:02.1-5,CALL,1,Id=2"),
        ("/x/p/24010101.log", 40, 3, False, "belongs to 2"),
    ]
    framed = frame_events(spark.createDataFrame(rows, LINES_SCHEMA), "CALL")
    assert {(r.file_path[-12:], r.raw) for r in framed.collect()} == {
        ("24010100.log", "00:01.1-5,CALL,1,Id=1"), ("24010101.log", "00:02.1-5,CALL,1,Id=2<_NL_>belongs to 2"),
    }


def test_period_and_invalid_times(spark):
    path = "/x/p/24010112.log"
    lines = [
        "29:59.9-1,CALL,1,Id=early", "more", "30:00.0-1,CALL,1,Id=first", "61:00.1-1,CALL,1,Id=bad", "more of bad",
        "45:00.1-1,CALL,1,Id=last", "45:01.0-1,CALL,1,Id=late",
    ]
    rows = [(path, 0, i, False, v) for i, v in enumerate(lines)]
    framed = frame_events(
        spark.createDataFrame(rows, LINES_SCHEMA), "CALL", datetime(2024, 1, 1, 12, 30), datetime(2024, 1, 1, 12, 45)
    )
    assert sorted(r.raw for r in framed.collect()) == ["30:00.0-1,CALL,1,Id=first", "45:00.1-1,CALL,1,Id=last"]


def test_text_is_not_shuffled(spark, log_tree):
    """From the scan to the fragments there is no exchange."""
    folder, _ = log_tree
    plan = event_fragments(read_lines(spark, [str(folder)], ["full"]), "CALL", in_file_order=True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "Exchange" not in text


def test_owners_are_found_without_text(spark, log_tree, tmp_path, conf):
    folder, _ = log_tree
    conf("spark.sql.files.maxPartitionBytes", "4000b")
    conf("spark.sql.files.openCostInBytes", "0")
    columns = EventColumns(keys=["Id", "Context"])
    stage = str(tmp_path / "stage")
    events = log_events(read_lines(spark, [str(folder)], ["full"]), columns, "CALL", in_file_order=True, stage=stage)
    plan = events.select("Id")._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window ["):]
    below = window[: window.index("FileScan") + 600]
    assert "lines" not in below[below.index("ReadSchema"):].split("\n")[0]
    branch = spark.read.parquet(stage).where("NOT __crosses").select("Id")
    assert "__rim" not in branch._jdf.queryExecution().executedPlan().toString()


def test_file_without_any_start(spark, conf, tmp_path):
    """Many splits that nobody owns: nothing comes out, whatever they hold."""
    folder = tmp_path / "full" / "p"
    folder.mkdir(parents=True)
    (folder / "24010100.log").write_text("just text\n" * 5000)
    conf("spark.sql.files.maxPartitionBytes", "4000b")
    assert frame_events(read_lines(spark, [str(tmp_path)], ["full"]), "CALL", in_file_order=True).count() == 0
