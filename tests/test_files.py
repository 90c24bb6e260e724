"""Files: discovery, pruning, odd directory names, decoding."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.sources.files import file_inventory, list_log_files, select_log_files
from logloom.sources.lines import decode_lines, read_lines

LINE = "00:01.123456-5,CALL,1,Usr=A\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    files = {
        "Dev 0+7 = тест %20/full/rphost_1/24010112.log": LINE * 3,
        "Dev 0+7 = тест %20/full/calls/full/rphost_2/24010113.log": LINE * 2,  # two nested matches
        "Dev 0+7 = тест %20/other/rphost_3/24010112.log": LINE,
        "Dev 0+7 = тест %20/Full/rphost_4/24010114.log": LINE,
        "Dev 0+7 = тест %20/full/rphost_1/24010115.log": "tiny",
        "Dev 0+7 = тест %20/full/rphost_1/notes.log": LINE,
        "Dev 0+7 = тест %20/full/rphost_1/24010112.txt": LINE,
        "Dev 0+7 = тест %20/full_2/rphost_1/24010112.log": LINE,
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, newline="")
    return str(root)


def short(rows):
    return sorted("/".join(r.path.split("/")[-4:]) for r in rows)


def test_discovery_by_exact_directory_name(spark, tree):
    found = short(list_log_files(spark, [tree], ["full"], prune=False).collect())
    assert found == sorted([
        "Dev 0+7 = тест %20/full/rphost_1/24010112.log", "Dev 0+7 = тест %20/full/rphost_1/24010115.log",
        "Dev 0+7 = тест %20/full/rphost_1/notes.log", "calls/full/rphost_2/24010113.log",
    ])


def test_base_directory_of_a_listed_name(spark, tree):
    base = f"{tree}/Dev 0+7 = тест %20/other"
    assert list_log_files(spark, [base], ["other"]).count() == 1
    assert list_log_files(spark, [base], ["Dev 0+7 = тест %20"]).count() == 0


def test_overlapping_bases_count_once(spark, tree):
    bases = [tree, f"{tree}/Dev 0+7 = тест %20/full", f" {tree}/ "]
    assert list_log_files(spark, bases, ["full"]).count() == 2
    assert read_lines(spark, bases, ["full"]).count() == 5 + 1  # the badly named file is read, its events have no time


def test_prune_by_hour_and_size(spark, tree):
    start, end = datetime(2024, 1, 1, 12, 30), datetime(2024, 1, 1, 12, 59, 59)
    assert short(list_log_files(spark, [tree], ["full"], start, end).collect()) == [
        "Dev 0+7 = тест %20/full/rphost_1/24010112.log"
    ]
    inventory = file_inventory(list_log_files(spark, [tree], ["full"])).first()
    assert inventory.files == 2 and abs(inventory.total_mb - 5 * len(LINE) / 1048576) < 1e-12


def test_scan_opens_only_chosen_files(spark, tree):
    start, end = datetime(2024, 1, 1, 12, 30), datetime(2024, 1, 1, 13, 59)
    lines = read_lines(spark, [tree], ["full", "Dev 0+7 = тест %20"], start, end)
    assert sorted(r.file_path.rsplit("/", 2)[-2] for r in lines.select("file_path").distinct().collect()) == [
        "rphost_1", "rphost_1", "rphost_2", "rphost_3",
    ]
    one_directory = read_lines(spark, [tree], ["full"], start, end)
    one_directory.collect()
    plan = one_directory._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    assert plan.metrics().apply("numFiles").value() == 2


def test_names_and_missing_directories(spark, tree):
    from logloom.sources.events import EventColumns, log_events

    lines = read_lines(spark, [tree, "/no/such/place"], ["other"])
    row = log_events(lines, EventColumns(keys=["Usr"]), "CALL", in_file_order=True).first()
    assert (row.filename, row.processname) == ("24010112.log", "rphost_3")
    assert read_lines(spark, ["/no/such/place"], ["x"]).count() == 0
    assert list_log_files(spark, ["/no/such/place"], ["x"]).count() == 0


def test_no_subdirectories_select_nothing(spark, tree):
    assert read_lines(spark, [tree], []).count() == 0
    assert list_log_files(spark, [tree], []).count() == 0


def test_select_on_any_listing(spark):
    files = spark.createDataFrame(
        [("s3a://b/full/p/24013212.log", 99), ("s3a://b/full/p/24010112.log", 20), ("s3a://b/full/p/24010112a.log", 21)],
        "path string, length bigint",
    )
    assert [r.path[-13:] for r in select_log_files(files, ["/full"], ["full"]).collect()] == ["24010112a.log"]


def test_line_ends_and_bom(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "24010112.log").write_bytes(b"\xef\xbb\xbfone\r\ntwo\rthree\nfour, more text")
    assert [r.value for r in read_lines(spark, [str(tmp_path)]).orderBy("pos").collect()] == [
        "one", "two", "three", "four, more text",
    ]


def test_decoding(spark):
    rows = [
        ("Привет, ёж №1".encode(), "auto", "Привет, ёж №1"),
        ("Привет, ёж №1 «x»".encode("cp1251"), "auto", "Привет, ёж №1 «x»"),
        ("Привет, ёж №1".encode("cp1251"), "cp1251", "Привет, ёж №1"),
        ("Привет".encode() + b"\xff" + "мир".encode(), "auto", "Привет\ufffdмир"),
        (b"plain", "auto", "plain"),
        (b"a\xffb", "utf-8", "a\ufffdb"),
    ]
    for raw, encoding, expected in rows:
        df = spark.createDataFrame([(bytearray(raw),)], "b binary").select(F.col("b").cast("string").alias("value"))
        assert decode_lines(df, encoding).first().value == expected
    with pytest.raises(ValueError):
        decode_lines(spark.range(1).select(F.lit("x").alias("value")), "koi8")


def test_brackets_in_directory_names(spark, tmp_path):
    folder = tmp_path / "srv [1] {a}*" / "full" / "p"
    folder.mkdir(parents=True)
    (folder / "24010112.log").write_text(LINE)
    base = [str(tmp_path / "srv [1] {a}*")]
    assert read_lines(spark, base, ["full"]).count() == 1 and list_log_files(spark, base, ["full"]).count() == 1
