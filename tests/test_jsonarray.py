"""JSON arrays cut at byte ranges, against json.load."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest

from quillmill.sources import jsonarray, jsonio

HARD = ['a"b', "\\", '\\"', "],[", "{,}", "é日本😀", "\ud83d", "\n\t\r ", "", "," * 30, "\\" * 7, '"', "x" * 300, "[[[", "}}}"]


def made(seed, n=60):
    rng = random.Random(seed)

    def value(depth):
        kind = rng.randrange(9 if depth < 4 else 6)
        if kind < 3:
            return rng.choice(HARD) + rng.choice(HARD)
        if kind < 6:
            return rng.choice([0, -1.5, 1e300, True, None, 10**18])
        if kind < 7:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice(HARD) + str(k): value(depth + 1) for k in range(rng.randrange(4))}

    return [value(0) for _ in range(n)]


def said(data, k):
    return json.dumps(data, ensure_ascii=k % 2 == 0, indent=(None, 2, 1)[k % 3], separators=((",", ":"), None)[k % 2]).replace("\ud83d", "\\ud83d")


def read(spark, path, split=None, member=None):
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        return {(r["file"].rsplit("/", 1)[1], r["pos"]): json.loads(r["text"], strict=False) for r in jsonarray.elements(spark, str(path), member).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(("split", "block"), [(7, 1), (64, 50), (4096, 900)])
def test_elements_whatever_the_split(spark, tmp_path, monkeypatch, split, block):
    monkeypatch.setattr(jsonarray, "BLOCK", block)
    cases = [made(k, 4 if split == 7 else 80) for k in range(3)] + [[], [[]], [1], ["one, two"], [{}], [[], {}, ""]]
    for k, data in enumerate(cases):
        (tmp_path / f"{k}.json").write_text(("", " \n")[k % 2] + said(data, k) + ("", "\n ")[k % 2], encoding="utf-8", newline="")
    (tmp_path / "blank.json").write_text("[ \n ]")
    got = read(spark, tmp_path, split)
    assert got == {(f"{k}.json", pos): x for k, data in enumerate(cases) for pos, x in enumerate(data)}


@pytest.mark.parametrize("split", [7, 4096])
def test_member_of_an_object(spark, tmp_path, split):
    data = made(9, 5)
    reports = [
        {"mode": "base", "summary": {"total": 3, "x": [1, 2, [3]]}, "details": data},
        {"details": data, "wrong": [1, 2]},
        {"other": [1], 'de"tails': [2], "nested": {"details": [1]}},
        {"details": []},
        {"details": {"a": [1], "b": 2}},
        data,
    ]
    texts = [said(x, k) for k, x in enumerate(reports)] + ['{"details": [1, 2], "d\\u0065tails": [3]}']
    wanted = [data, data, [], [], [], data, [3]]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.json").write_text(text, encoding="utf-8")
    assert read(spark, tmp_path, split, "details") == {(f"{k}.json", pos): x for k, own in enumerate(wanted) for pos, x in enumerate(own)}


@pytest.mark.parametrize(("text", "told"), [("{}", "must be a list"), ('{"a": [1]}', "must be a list"), ("3", "must be a list"), ("[1, 2", "too early"), ('[1, "2]', "too early"), ("[1] [2]", "text after"), ("[1], 2", "text after"), ("[1, {]", "too early"), ("[1,]", "MALFORMED"), ("[,1]", "MALFORMED"), ("[x]", "MALFORMED")])
def test_other_files_raise(spark, tmp_path, text, told):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception, match=told):
        jsonio.read_json_array(spark, str(path)).collect()


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "large.json"
    path.write_text(json.dumps([{"conversations": [{"from": "a", "value": f"word, {k} " * 20}]} for k in range(5000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        found = jsonarray.elements(spark, str(path))
        assert found.select("text").rdd.getNumPartitions() >= path.stat().st_size // 110_000
        rows = jsonio.conversations(spark, str(path)).selectExpr("count(*)", "count(distinct pos)", "max(pos)", "max(size(conversations))").first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(rows) == (5000, 5000, 4999, 1)


def plain(raw, state):
    """Marks outside strings and the state at the end, byte by byte."""
    out, inside, escaped = [], state != 0, state == 2
    for i, c in enumerate(raw):
        if inside:
            escaped, inside = (c == "\\" and not escaped), (escaped or c != '"')
        elif c == '"':
            inside = True
        elif c in "[{]},":
            out.append((i, {",": 2}.get(c, 1 if c in "[{" else -1)))
    return out, (2 if escaped else 1) if inside else 0


def test_marks_from_every_state():
    rng = random.Random(4)
    for _ in range(3000):
        raw = "".join(rng.choice('"\\[{]},a') for _ in range(rng.randint(0, 14)))
        for state in (0, 1, 2):
            marks, end = plain(raw, state)
            if not backslashes_inside(raw, state):
                continue  # a backslash outside a string is not JSON
            places, kinds, got = jsonarray.structure(np.frombuffer(raw.encode(), dtype=np.uint8), state)
            assert (list(zip(places.tolist(), kinds.tolist(), strict=True)), got) == (marks, end), (raw, state)


def backslashes_inside(raw, state):
    inside, escaped = state != 0, state == 2
    for c in raw:
        if inside:
            escaped, inside = (c == "\\" and not escaped), (escaped or c != '"')
        elif c == "\\":
            return False
        elif c == '"':
            inside = True
    return True
