"""Records over many splits against the one-task readers."""

import json
import random

import pytest

from riskloom.operators import ranking
from riskloom.sources import readers as R
from riskloom.sources import records


@pytest.fixture(params=[1, 7, 64])
def ranges(request, spark):
    """Cuts the next files of some kB into about that many splits."""
    def cut(size):
        for key, value in (("maxPartitionBytes", max(1, -(-size // request.param))), ("openCostInBytes", 1), ("minPartitionNum", request.param)):
            spark.conf.set(f"spark.sql.files.{key}", str(value))

    yield cut
    for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{key}")


def odd_csv(rng, n):
    bits = ["plain", 'say "hi"', "two\nlines", "\n\nblank inside\n", ",", "é 日本", "", " padded ", "crlf\r\ninside", '"', '""', "x" * 300]
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    lines = [",".join(quoted(c) for c in ("question", "answer"))]
    for _ in range(n):
        cells = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 3))) for _ in range(2)]
        lines.append(",".join(quoted(c) if rng.random() < 0.7 or set(c) & set('",\n\r') or c != c.strip() else c for c in cells))
        if rng.random() < 0.1:
            lines.append("")
    return "\n".join(lines) + ("\n" if rng.random() < 0.5 else "")


def test_csv_as_the_one_task_reader(spark, tmp_path, ranges):
    rng = random.Random(8)
    size = 0
    for name, n in (("a.csv", 150), ("b.csv", 40), ("empty.csv", 0)):
        text = odd_csv(rng, n)
        (tmp_path / name).write_bytes(text.encode())
        size += len(text.encode())
    want = [tuple(r) for r in spark.read.schema(R.RAW_SCHEMAS["math"]).options(**R.CSV_OPTIONS).csv(str(tmp_path)).collect()]
    ranges(size)
    got = records.csv_records(spark, str(tmp_path), R.RAW_SCHEMAS["math"])
    rows = [tuple(r) for r in got.select("question", "answer").collect()]
    key = lambda r: (r[0] or "", r[1] or "", r[0] is None, r[1] is None)
    assert sorted(rows, key=key) == sorted(want, key=key) and len(rows) >= 150
    assert got.groupBy("file", "record").count().filter("count > 1").isEmpty()


def test_csv_ids_do_not_depend_on_splits(spark, tmp_path, ranges):
    path = tmp_path / "answers.csv"
    text = "question,answer,documents\n" + "".join(f'q{i},"a\n{i}",{"d" if i % 3 else "  "}\n' for i in range(200))
    path.write_text(text)
    ranges(len(text))
    got = {r.prompt_id: r.prompt for r in R.load_domain(spark, "is_agents", str(path)).collect()}
    assert got == {f"is_agents_{i}": f"q{i}" for i in range(200) if i % 3}


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_as_the_one_task_reader(spark, tmp_path, ranges, monkeypatch, indent):
    """Braces, quotes and backslashes in strings, nested objects, one line or many; groups of over 20 pieces are cut."""
    monkeypatch.setattr(ranking, "ROWS", 20)
    rng = random.Random(9)
    odd = ['plain', '}', '{', '"', '\\', '\\"}', '[{"a": "}"}]', "line\nbreak", "é日", "\\\\", "}, {", ""]
    docs = [{"doc": "".join(rng.choice(odd) for _ in range(rng.randint(0, 4))),
             "paragraphs": [{"order": k, "text": rng.choice(odd)} for k in range(rng.randint(0, 3))],
             "questions": [{"question": rng.choice(odd) + "}", "answer": rng.choice(odd)} for _ in range(rng.randint(0, 2))]} for _ in range(60)]
    size = 0
    for name, part in (("train.json", docs[:45]), ("dev.json", docs[45:]), ("none.json", [])):
        text = json.dumps(part, indent=indent, ensure_ascii=False)
        (tmp_path / name).write_text(text)
        size += len(text.encode())
    want = sorted(map(str, R.scan_nested(spark, str(tmp_path), multi_line=True).select("doc", "paragraphs", "questions", "file_name").collect()))
    ranges(size)
    got = records.json_array_records(spark, str(tmp_path), R.NESTED_SCHEMA)
    assert sorted(map(str, got.select("doc", "paragraphs", "questions", "file_name").collect())) == want and len(want) == 60
    places = {(r.file_name, r.record): r.doc for r in got.collect()}
    assert [places["train.json", i] for i in range(45)] == [d["doc"] for d in docs[:45]]
