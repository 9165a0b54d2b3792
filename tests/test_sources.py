"""Byte ranges, JSON arrays, line numbers and result bundles."""

import json
import random

import pytest

from lodestone.schemas import BUNDLES
from lodestone.sources import jsonl, ranges
from lodestone.streaming import checkpoint


def odd_records(n):
    draw = random.Random(3)
    return [
        {"a": i, "b": "".join(draw.choice('ab"\\{}[],é\n\u2028') for _ in range(draw.randrange(60))), "c": [1, {"x": "]"}]}
        for i in range(n)
    ]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [1, 2, 7, 50, 1_000, 1 << 20])
def test_array_by_ranges(tmp_path, indent, size):
    rows = odd_records(60)
    path = tmp_path / "x.json"
    path.write_text("\ufeff" * (size > 3) + json.dumps(rows, ensure_ascii=bool(indent), indent=indent), encoding="utf-8")
    stream = ranges.open_file(f"file:{path}")
    state, depth, found = ranges.OUTSIDE, 0, []
    for start in range(0, stream.size(), size):
        end = min(start + size, stream.size())
        found += ranges.records(stream, start, end, state, depth, 8)
        state, deeper = ranges.effect(stream.read_at(end - start, start), state)
        depth += deeper
    assert (state, depth) == (ranges.OUTSIDE, 0)
    assert [json.loads(value) for value in found] == rows


def test_array_scan(spark, tmp_path):
    rows = odd_records(300)
    (tmp_path / "x.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "y.json").write_text(" [ ]\n", encoding="utf-8")
    found = ranges.scan_json_arrays(spark, str(tmp_path), "a int, b string", 4_000)
    assert found.rdd.getNumPartitions() > 4
    assert sorted((r.a, r.b) for r in found.collect()) == [(r["a"], r["b"]) for r in rows]
    for wrong in ('{"a": 1}', "[1, 2]", '[{"a": 1}', '[{"a": 1}, {"a": "x', ""):
        (tmp_path / "y.json").write_text(wrong, encoding="utf-8")
        with pytest.raises(Exception, match="JSON array|array of objects|Exception"):
            ranges.scan_json_arrays(spark, str(tmp_path), "a int, b string").collect()


def test_content_digest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"x" * 1_000)
    (tmp_path / "in/b.txt").write_bytes(b"")
    (tmp_path / "in/_SUCCESS").write_bytes(b"")
    first = ranges.content_digest(spark, str(tmp_path / "in"), 300)
    assert ranges.content_digest(spark, str(tmp_path / "in"), 300) == first
    (tmp_path / "in/a.txt").write_bytes(b"x" * 999 + b"y")
    second = ranges.content_digest(spark, str(tmp_path / "in"), 300)
    (tmp_path / "in/b.txt").rename(tmp_path / "in/c.txt")
    assert len({first, second, ranges.content_digest(spark, str(tmp_path / "in"), 300)}) == 3
    with pytest.raises(Exception, match="missing"):
        ranges.content_digest(spark, str(tmp_path / "missing"))


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "1000")
    yield
    spark.conf.set(name, before)


def test_lines_of_files_of_several_splits(spark, tmp_path, small_splits):
    for name in ("a", "b"):
        (tmp_path / name).write_text("\n".join(map(str, range(1, 3_001))) + "\n")
    lines = jsonl.numbered_lines(spark, str(tmp_path))
    assert lines.count() == 6_000 and lines.filter("cast(value as bigint) <> line").count() == 0


def test_last_line_of_a_key_counts(spark, tmp_path, small_splits):
    rows = [
        {"query_id": f"q{i % 5}", "evidence_ids": ["a", "b"][:: -1 if i % 2 else 1], "candidate_id": "c", "delta_f1": float(i)}
        for i in range(400)
    ]
    (tmp_path / "gains.jsonl").write_text("\n".join(map(json.dumps, rows)))
    found = {(r.query_id, tuple(r.evidence_ids)): r.delta_f1 for r in jsonl.read_counterfactuals(spark, str(tmp_path)).collect()}
    assert found == {(r["query_id"], tuple(r["evidence_ids"])): r["delta_f1"] for r in rows}


def bundle(name, policies, traces=None):
    return json.dumps({
        "query_id": name, "rows": [{"policy": p} for p in policies], "traces": [{"policy": p} for p in traces or policies]})


def test_bundles(spark, tmp_path):
    lines = [
        bundle("q1", "ab"), "", bundle("q2", "a"), bundle("", "ab"), '{"rows": []}', bundle("q3", "ba"), bundle("q3", "a"),
        bundle("q4", "ab", "aa"), bundle("q5", "abb"), bundle("q6", "ab")[:20],
    ]

    def done(lines):
        (tmp_path / "bundles").write_text("\n".join(lines))
        found = checkpoint.parse_bundles(jsonl.numbered_lines(spark, str(tmp_path / "bundles")), BUNDLES)
        return sorted(r.query_id for r in checkpoint.complete_bundles(found, ["a", "b"]).collect())

    assert done(lines) == ["q1", "q3"]
    assert done([*lines[:-1], ""]) == ["q1", "q3"]
    for garbage in ("garbage", bundle("q7", "ab")[:20], "[1]"):
        with pytest.raises(ValueError, match="line 2"):
            done([lines[0], garbage, *lines[1:]])
