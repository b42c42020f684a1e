"""The command line on a temporary folder."""

import json
import os

import pytest

import media
from fotostrata import __main__ as cli
from fotostrata.sources.hashing import hash_files
from fotostrata.sources.listing import list_files


@pytest.fixture()
def folder(tmp_path, spark, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda **_: spark)
    monkeypatch.setattr(cli, "purge", lambda _: None)
    root = tmp_path / "in"
    root.mkdir()
    for name in ("a.jpg", "b.jpg"):
        (root / name).write_bytes(media.jpeg(media.tiff()))
    (root / "c.nef").write_bytes(media.tiff())
    return tmp_path


def test_commands(folder, spark, capsys):
    root, out = str(folder / "in"), str(folder / "out")
    assert cli.main(["scan", root]) == 0
    report = str(folder / "dupes.json")
    assert cli.main(["dedupe", root, "--report", report]) == 0
    with open(report) as file:
        found = json.load(file)
    assert found["summary"] == {"n_groups": 1, "n_duplicates": 1, "n_files": 2} and found["groups"][0]["original"].endswith("a.jpg")
    assert cli.main(["dedupe", root, "--report", str(folder / "members.csv")]) == 0
    roles = [line.rsplit(",", 1)[1].strip() for name in os.listdir(folder / "members.csv") if name.endswith(".csv") for line in open(folder / "members.csv" / name).readlines()[1:]]
    assert sorted(roles) == ["duplicate", "original"]
    assert cli.main(["--log-level", "ERROR", "audit-metadata", root]) == 0
    journal = str(folder / "ops.jsonl")
    arguments = ["import", root, "--output", out, "--journal", journal, "--report", str(folder / "run.json"), "--review-report", str(folder / "review.json")]
    assert cli.main(arguments) == 0
    assert sorted(p.name for p in (folder / "out").rglob("*.*")) == ["2024-05-06_07-08-09.jpg", "2024-05-06_07-08-09.nef", "2024-05-06_07-08-09_01.jpg"]
    with open(folder / "run.json") as file:
        run = json.load(file)
    assert run["summary"]["processed_files"] == 3 and run["summary"]["mode"] == "execute" and len(run["operations"]) == 3
    capsys.readouterr()
    assert cli.main([*arguments, "--resume", "--dry-run"]) == 0 and "already done: 3" in capsys.readouterr().out


def test_bad_options(folder):
    assert cli.main(["organize", str(folder / "in"), "--derivative-path", "/abs"]) == 2
    assert cli.main(["organize", str(folder / "in"), "--conflict-policy", "odd"]) == 2
    assert cli.main(["scan", str(folder / "none")]) == 2


def test_hashes(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r.hash for r in hash_files(list_files(spark, str(folder / "in"))).collect()}
    assert got["a.jpg"] == got["b.jpg"] != got["c.nef"]
    with pytest.raises(ValueError):
        hash_files(spark.range(1), chunk=0)
