"""JSON files over many lines, in splits of any size, against the standard parser."""

import json
import random

import pytest

from granary.sources import files, json_items


def _value(r, depth=0):
    kind = r.random()
    if kind < 0.5 or depth > 2:
        return r.choice(['a "quoted" [word', "brackets }{][ and, commas", "line\nbreak \\ \\\\", "é日本", "", 3, None, True, 1.5])
    if kind < 0.75:
        return [_value(r, depth + 1) for _ in range(r.randrange(3))]
    return {r.choice("abc,]"): _value(r, depth + 1) for _ in range(r.randrange(3))}


@pytest.mark.parametrize("split_bytes", [None, 64, 400])
def test_arrays_over_many_lines_in_splits(spark, tmp_path, split_bytes):
    r = random.Random(1)
    docs = {}
    for i in range(4):
        docs[f"f{i}.json"] = [{"source_id": f"{i}-{n}", "content": _value(r)} for n in range((2, 1, 7, 60)[i])]
        (tmp_path / f"f{i}.json").write_text(json.dumps(docs[f"f{i}.json"], indent=r.choice([1, 4]), ensure_ascii=False))
    (tmp_path / "one.json").write_text(json.dumps({"source_id": "x", "content": "alone"}, indent=2))
    if split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = json_items.json_items(spark, str(tmp_path))
        found = {}
        for x in sorted(got.collect(), key=lambda x: (x.file, x.split, x.n)):
            assert not x.is_line
            found.setdefault(x.file.rsplit("/", 1)[1], []).append(json.loads(x["item"]))
        assert found == {**docs, "one.json": [{"source_id": "x", "content": "alone"}]}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_split_line():
    assert json_items.split_line('[1, {"a": [2, 3]}, "x,]"', 0, 1) == (["1", ' {"a": [2, 3]}', ' "x,]"'], 1)
    assert json_items.split_line('"a": 1}, {', 2, 1) == (['"a": 1}', " {"], 2)
    assert json_items.split_line("3] ", 1, 1) == (["3"], 0)
    assert json_items.split_line("{", 0, 0) == (["{"], 1)


def _read(spark, path, text, **more):
    path.write_text(text)
    return files.read_knowledge(spark, str(path), **more).collect()


def test_documents_lines_and_broken_elements(spark, tmp_path):
    one = '{\n "source_id": "a",\n "content": "x"\n}\n'
    assert [r.source_id for r in _read(spark, tmp_path / "one.json", one)] == ["a"]
    broken = '[\n {"source_id": "a", "content": "x"},\n {"source_id": oops},\n 7, null,\n {"source_id": "no content"},\n {"source_id": "b",\n  "content": "y"}\n]'
    assert sorted(r.source_id for r in _read(spark, tmp_path / "broken.json", broken)) == ["a", "b"]
    lines = '{"source_id": "a", "content": "x"}\nno json\n\n[{"source_id": "b", "content": "y"}, {"source_id": "c", "content": "z"}]\n'
    assert sorted(r.source_id for r in _read(spark, tmp_path / "l.jsonl", lines)) == ["a", "b", "c"]
    kept = _read(spark, tmp_path / "k.jsonl", lines, on_bad="text")
    assert sorted(r.content for r in kept) == ["no json", "x", "y", "z"]
    cut = '{"source_id": "a", "content": "x"}\n{"source_id": "cut", \n{"source_id": "b", "content": "y"}'
    assert sorted(r.source_id for r in _read(spark, tmp_path / "c.jsonl", cut)) == ["a", "b"]
    assert _read(spark, tmp_path / "empty.json", "") == _read(spark, tmp_path / "blank.json", "\n \n") == _read(spark, tmp_path / "none.json", "[\n]") == []


def test_questions_results_and_listing_over_many_lines(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": f"q{i}", "question_text": None if i == 2 else f"t{i}"} for i in range(5)], indent=2))
    assert sorted(r.id for r in files.read_questions(spark, str(tmp_path / "q.json")).collect()) == ["q0", "q1", "q3", "q4"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "m 1+2_results.json").write_text(json.dumps([{"doc_id": 1}, {"doc_id": 2}], indent=1))
    (tmp_path / "r" / "n_eval.json").write_text('[{"doc_id": 3}]')
    assert {(r.doc_id, r.group) for r in files.read_result_dir(spark, str(tmp_path / "r"), "doc_id long").collect()} == {(1, "m 1+2"), (2, "m 1+2"), (3, "n")}
    (tmp_path / "h.json").write_text(json.dumps([{"question": f"w{i}"} if i % 2 else {"_id": f"x{i}", "question": f"w{i}", "level": "hard"} for i in range(6)], indent=3))
    got = {r.question: (r.question_id, r.difficulty) for r in files.read_hotpot(spark, str(tmp_path / "h.json")).collect()}
    assert got == {f"w{i}": (f"q_{i}", "medium") if i % 2 else (f"x{i}", "hard") for i in range(6)}
    (tmp_path / "refs.txt").write_text('"a \\"b\\" c"\n{"reference": "r"}\nraw "x"\n')
    assert [r.reference for r in files.read_references(spark, str(tmp_path / "refs.txt")).orderBy("pos").collect()] == ['a "b" c', "r", 'raw "x"']
