"""Files read by many small splits against Python's own readers."""

from __future__ import annotations

import csv
import json
import random

import pytest
from lexigrove.sources import corpus, split

csv.field_size_limit(1 << 30)


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "61b", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def field(rng: random.Random) -> str:
    return rng.choice(["", "plain", "über, alles", 'say ""hi""'.replace('""', '"'), "two\nlines", "\n\n", "crlf\r\nin", '5" pipe', "  edge ", "x" * 200, 'a,"\n",b', "日本\n" * 9])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(2))
def test_csv_equals_the_csv_module(spark, small_splits, tmp_path, seed, end):
    rng, path = random.Random(seed), tmp_path / "c.csv"
    with path.open("w", newline="", encoding="utf-8-sig") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["id", "text", "more\nlines"])
        for i in range(40):
            w.writerow([f"r{i}", field(rng), field(rng)])
            if rng.random() < 0.1:
                f.write(end)
        f.write(f'raw,5" pipe and 6" pipe,z{end}')
        f.write(f'quoted,"ab"cd"ef,z{end}')
        f.write('last,"no line end",z')
    with path.open(newline="", encoding="utf-8-sig") as f:
        want = [(i, r["id"], r["text"].strip()) for i, r in enumerate(csv.DictReader(f)) if r["text"] and r["text"].strip()]
    got = corpus.read_csv(spark, f"file://{path}", "text", "id")
    assert got.rdd.getNumPartitions() > 5
    rows = sorted((r.ord, r.doc_id, r.text) for r in got.collect())
    assert [r[:2] for r in rows] == [w[:2] for w in want]
    assert [r for r in rows if r[1] != "quoted"] == [w for w in want if w[1] != "quoted"]
    assert [r[0] for r in sorted(corpus.read_csv(spark, f"file://{path}", "text").select("doc_id").collect(), key=lambda r: int(r[0]))] == [str(w[0]) for w in want]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("seed", range(2))
def test_json_equals_the_json_module(spark, small_splits, tmp_path, seed, indent):
    rng, path = random.Random(seed), tmp_path / "c.json"
    odd = ['a, "b", [c', "back\\slash", "tail\\", "]}", "{[", "", "  ", "line\nend", "日本," * 30, "x" * 150]
    items = [rng.choice([{"id": f"i{k}", "text": rng.choice(odd), "more": [1, {"a": [rng.choice(odd), ","]}]}, {"text": rng.choice(odd)}, rng.choice(odd), {"none": 1}]) for k in range(40)]
    path.write_text("﻿" * (seed == 1) + json.dumps(items, indent=indent, ensure_ascii=seed == 2), encoding="utf-8")
    want = []
    for i, x in enumerate(items):
        if isinstance(x, dict):
            if "text" in x and x["text"].strip():
                want.append((i, x.get("id", str(i)), x["text"].strip()))
        else:
            want.append((i, str(i), x.strip()))
    got = corpus.read_json(spark, f"file://{path}", "text", "id")
    assert got.rdd.getNumPartitions() > 5
    assert sorted((r.ord, r.doc_id, r.text) for r in got.collect()) == want


def test_small_and_empty_files(spark, tmp_path):
    for name, body, want in (("a.json", "[]", []), ("b.json", " [ ] ", []), ("c.json", '["x"]', ["x"]), ("d.json", '\n[ {"text": "y"} ]\n', ["y"])):
        (tmp_path / name).write_text(body)
        assert [r.text for r in corpus.read_json(spark, f"file://{tmp_path / name}", "text").collect()] == want
    for name, body, want in (("a.csv", "text\n", []), ("b.csv", "text", []), ("c.csv", "text,id\n\n\nx,1\n", ["x"]), ("d.csv", '"te\nxt"\n"a\n\n\nb"\n', ["a\n\n\nb"])):
        (tmp_path / name).write_text(body)
        assert [r.text for r in corpus.read_csv(spark, f"file://{tmp_path / name}", "te\nxt" if name == "d.csv" else "text").collect()] == want
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="no column"):
        corpus.read_csv(spark, f"file://{tmp_path / 'e.csv'}", "text")


def test_pieces():
    assert split.csv_piece('a,"b', False) == (True, 0) and split.csv_piece('b",c', True) == (False, 0)
    assert split.csv_piece('a "quoted" word', False) == (False, 0) and split.csv_piece('b"",c', True) == (True, 0)
    assert split.csv_piece('x"y","', False) == (True, 0) and split.csv_piece('","', True) == (True, 0)
    assert split.json_piece('{"a": "b', False) == (True, 1) and split.json_piece('b\\"c"}]', True) == (False, -2)


def test_a_large_field_is_read(spark, tmp_path):
    (tmp_path / "big.csv").write_text('text\n"' + ('line "" of it\n' * 200_000) + '"\nnext\n')
    got = sorted(len(r.text) for r in corpus.read_csv(spark, f"file://{tmp_path / 'big.csv'}", "text").collect())
    assert got == [4, 200_000 * 13 - 1]
