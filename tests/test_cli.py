"""Command lines on a generated day: statuses, flags, reports and the CSV."""

import pytest

from lobspark.cli import main, parse_count, parsed
from lobspark.sources import synthetic


@pytest.fixture(scope="module")
def day(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cli") / "day")
    assert main(["gen", path, "--messages", "3000", "--symbols", "4", "--seed", "7"], spark) == 0
    return path


def test_counts():
    assert parse_count("--n", "12") == 12
    for bad in (None, "", "1x", "-1", "1.5", " 1"):
        with pytest.raises(ValueError):
            parse_count("--n", bad)
    assert parsed("verify", ["f", "--show", "3", "--max-orders", "5"]) == ("f", {"--show": 3, "--max-orders": 5})
    for command, args in (("verify", ["f", "--what"]), ("bench", ["f", "--book", "slow"]), ("pipeline", ["f", "--out"]), ("verify", ["f", "--show"])):
        with pytest.raises(ValueError):
            parsed(command, args)


def test_statuses(spark, capsys, tmp_path):
    assert main([], spark) == 2 and main(["verify"], spark) == 2 and main(["gen", "--help"], spark) == 0
    assert main(["gen", str(tmp_path / "x"), "--symbols", "0"], spark) == 1
    assert main(["pipeline", str(tmp_path / "none")], spark) == 1
    assert "error: " in capsys.readouterr().err


def test_verify(spark, day, capsys, tmp_path):
    assert main(["verify", day, "--show", "2"], spark) == 0
    out = capsys.readouterr().out
    assert "result       PASS" in out and " 0 mismatches" in out and "anomalies    0 (unknown order 0" in out and "4 symbols" in out
    odd = tmp_path / "2024-01-02.feed"
    frame = lambda load: len(load).to_bytes(2, "big") + load
    odd.write_bytes(frame(synthetic.pack("D", ref=5, locate=1)) + frame(b"A\0\1\0\0") + b"\0\x20a")
    assert main(["verify", str(odd)], spark) == 1
    out = capsys.readouterr().out
    assert "result       FAIL" in out and "unknown order 1" in out and "3 trailing bytes" in out and "1 messages are shorter" in out


def test_bench(spark, day, capsys):
    for mode in ("fast", "reference", "decode"):
        assert main(["bench", day, "--book", mode, *["--no-latency"] * (mode == "reference")], spark) == 0
        out = capsys.readouterr().out
        assert "throughput" in out and ("gap ns" in out) == (mode != "reference") and ("checksum" in out) == (mode == "decode")
    assert "gap ns       all" in out


def test_pipeline(spark, day, capsys, tmp_path):
    path = str(tmp_path / "ofi")
    assert main(["pipeline", day, "--out", path, "--feed-cpu", "1"], spark) == 0
    assert "symbol-minutes" in capsys.readouterr().out
    rows = spark.read.option("header", True).csv(path)
    assert rows.columns[:6] == ["symbol", "minute", "ofi", "events", "mid_open", "mid_close"] and rows.count() > 10
    assert all(len(r["mid_open"].partition(".")[2]) == 4 and r["minute"][2] == ":" for r in rows.collect())
