"""One encoding for each file."""

from __future__ import annotations

import pytest

from logloom.sources.encodings import encoding_evidence, file_votes
from logloom.sources.events import EventColumns, log_events
from logloom.sources.lines import decode_lines, read_lines
from logloom.sources.shared import Wanted, events_of_all

# The second user's name in windows-1251 is valid UTF-8 too.
NAMES = ["Пользователь", "Рё", "plain", "№ 5 «a»"]


@pytest.fixture
def tree(tmp_path):
    folder = tmp_path / "rphost_1"
    folder.mkdir()
    text = "\n".join(f"00:0{i}.1-5,CALL,1,Usr={n}" for i, n in enumerate(NAMES))
    (folder / "24010110.log").write_bytes(text.encode("cp1251"))
    (folder / "24010111.log").write_bytes(text.encode("utf-8"))
    (folder / "24010112.log").write_bytes(text.encode("utf-8-sig").replace("№".encode(), b"\xe2\x84"))
    (folder / "24010113.log").write_bytes("00:01.1-5,CALL,1,Usr=ascii only".encode())
    (folder / "24010114.log").write_bytes(f"00:01.1-5,CALL,1,Usr={NAMES[1]}".encode("cp1251"))
    return str(tmp_path)


EXPECTED = {
    "24010110.log": NAMES, "24010111.log": NAMES, "24010112.log": [*NAMES[:3], "� 5 «a»"], "24010113.log": ["ascii only"],
    # nothing in this file tells that it is no UTF-8
    "24010114.log": ["и"],
}


def names_of(events):
    made = {}
    for r in events.orderBy("filename", "timestamp").collect():
        made.setdefault(r["filename"], []).append(r["Usr"])
    return made


@pytest.mark.parametrize("staged", [False, True])
def test_events_by_file(spark, tree, tmp_path, staged):
    columns = EventColumns(["Usr", "timestamp", "filename"])
    lines = read_lines(spark, [tree], ["rphost_1"])
    stage = str(tmp_path / "stage") if staged else None
    assert names_of(log_events(lines, columns, "CALL", in_file_order=True, encoding="file", stage=stage)) == EXPECTED
    by_line = names_of(log_events(lines, columns, "CALL", in_file_order=True))
    assert by_line["24010110.log"][1] == "и" and by_line["24010111.log"] == NAMES


def test_borders_and_joint_reports(spark, tree, tmp_path):
    lines = read_lines(spark, [tree], ["rphost_1"]).selectExpr("file_path", "pos AS block", "pos", "false AS sole", "value")
    columns = EventColumns(["Usr", "timestamp", "filename"])
    assert names_of(log_events(lines, columns, "CALL", encoding="file")) == EXPECTED
    (made,) = events_of_all(lines, [Wanted(columns, "CALL")], str(tmp_path / "stage"), encoding="file")
    assert names_of(made) == EXPECTED


def test_evidence_adds_up(spark, tree):
    lines = read_lines(spark, [tree], ["rphost_1"])
    found = {r["file_path"][-12:]: (r["wide"], r["broken"]) for r in encoding_evidence(lines).collect()}
    assert set(found) == set(EXPECTED) - {"24010113.log"} and found["24010111.log"][1] == 0 < found["24010112.log"][1] < found["24010110.log"][1]
    halves = encoding_evidence(lines.where("pos % 2 = 0")).unionByName(encoding_evidence(lines.where("pos % 2 = 1"))).groupBy("file_path").sum("wide", "broken")
    assert {r[0][-12:]: (r[1], r[2]) for r in halves.collect()} == found
    assert {r["file_path"][-12:]: r["cp1251"] for r in file_votes(lines).collect()} == {name: name == "24010110.log" for name in found}


def test_lines_by_file(spark, tree):
    lines = read_lines(spark, [tree], ["rphost_1"], encoding="file")
    got = {r["value"].split("Usr=")[1] for r in lines.where("file_path LIKE '%24010110.log'").collect()}
    assert got == set(NAMES) and lines.columns == read_lines(spark, [tree], ["rphost_1"]).columns
    assert decode_lines(lines.limit(0), "file").count() == 0
