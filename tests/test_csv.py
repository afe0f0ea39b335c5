"""Comma-separated text: records by their quotes, and files of many parts."""

import random

import pytest

from lumenfold.sources import text


def by_character(data: str) -> list[list[str]]:
    """Records by the rules, one state and one character at a time."""
    out, row, cell, inside, skip = [], [], "", False, False
    for c, after in zip(data, [*data[1:], ""]):
        if skip:
            skip = False
            continue
        pair = {"\"\"": "quote", "\r\n": "end"}.get(c + after)
        if inside and pair == "quote":
            cell, skip = cell + c, True
        elif c == '"':
            inside = not inside
        elif inside or c not in ",\r\n":
            cell += c
        elif c == ",":
            row, cell = [*row, cell], ""
        else:
            skip = pair == "end"
            out, row, cell = [*out, [*row, cell]], [], ""
    return [r for r in [*out, [*row, cell]] if any(r)]


def made(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(['"', '""', ",", "\n", "\r\n", "\r", "a", "b c", "é", "", "\ue000", '"x\ny"', ',"q""r"']) for _ in range(n))


@pytest.mark.parametrize("seed", range(300))
def test_records(seed):
    data = made(seed, seed % 40)
    assert text.records(data) == by_character(data)


def test_records_of_known_texts():
    assert text.records('a,"b, ""c""",d"e"f\r\n,,\n"x\ny",z') == [["a", 'b, "c"', "def"], ["x\ny", "z"]]
    assert text.records("") == [] and text.records('"') == [] and text.records('""""') == [['"']] and text.records('"a""') == [['a"']]


@pytest.mark.parametrize("seed,split,lines", [(1, "200b", 3), (2, "1k", 1 << 14), (3, "64m", 7), (4, "300b", 2)])
def test_files_of_many_parts(spark, tmp_path, monkeypatch, seed, split, lines):
    rng = random.Random(seed)
    texts = []
    for k in range(3):
        body = "".join(rng.choice(['1,"two\nlines, ""x""",3\n', "4,5\r\n", 'a"b,\nc"d,6,7\n', "\n", "8,,9,10\r", '"' + "long\r\n" * rng.randrange(60) + '",11\n']) for _ in range(150))
        texts.append("id,na\"me\",rest\n" + body + ("last" if k else '"open, to the end'))
        (tmp_path / f"t{k}.csv").write_text(texts[-1], newline="")
    monkeypatch.setattr(text, "LINES", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = sorted((r.file.rpartition("/")[2], r.place, r.cells) for r in text.csv_records(spark, str(tmp_path)).collect())
        rows = sorted(tuple(r) for r in text.read_csv(spark, str(tmp_path), ["name", "id", "none"]).collect())
        tasks = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > 5 or split == "64m"
    want = [(f"t{k}.csv", r) for k, t in enumerate(texts) for r in by_character(t)]
    assert [(f, c) for f, _, c in found] == want
    cell = lambda r, i: r[i] if i < len(r) else ""
    assert rows == sorted((cell(r, 1), cell(r, 0), "") for t in texts for r in by_character(t)[1:])


def test_no_lines(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    assert text.read_csv(spark, str(tmp_path / "none.csv"), ["a"]).collect() == []
