import json
import random

import pytest

from trailpack.schemas import clicks_schema
from trailpack.sources.arrays import array_elements, chunks
from trailpack.sources.readers import read_clicks


@pytest.fixture(params=[None, 64])
def splits(spark, request):
    """Whole files, and splits that fall into the middle of records, strings and escapes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    if request.param:
        for n in names:
            spark.conf.set(n, str(request.param))
    yield request.param
    for n, value in before.items():
        spark.conf.set(n, value)


def read(spark, path):
    return [r.value for r in array_elements(spark, str(path)).collect()]


def parsed(values):
    return sorted(map(str, map(json.loads, values)))


HARD = ["}", "{", "]", "[", '"', "\\", '\\"', "},{", '"}', "a,b", "é\n", "\\\\", '\\\\"}', "", "🙂}", '{"x": [1, {"y": "}"}]}']


@pytest.mark.parametrize("indent", [None, 2])
def test_elements_are_cut_wherever_splits_fall(spark, tmp_path, splits, indent):
    rng = random.Random(1)
    rows = [
        {"k": i, rng.choice(HARD): rng.choice(HARD), "n": [{"a": rng.choice(HARD)}, {}, {"b": [[{}], {"c": rng.choice(HARD)}]}][: rng.randrange(4)]}
        for i in range(60)
    ]
    more = [{"other": i, "t": HARD[i % len(HARD)]} for i in range(20)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent))
    (tmp_path / "b.json").write_text("\n " + json.dumps(more, indent=indent, ensure_ascii=False) + " \n", encoding="utf-8")
    assert parsed(read(spark, tmp_path)) == parsed(map(json.dumps, rows + more))
    if splits:
        assert chunks(spark, str(tmp_path)).rdd.getNumPartitions() > 5


@pytest.mark.parametrize(
    "text, values",
    [
        ("", []),
        ("  \n", []),
        ("[]", []),
        (" [ ] \n", []),
        ("[{}]", ["{}"]),
        ('{"a": {"b": 1}}', ['{"a": {"b": 1}}']),
        ('[{"a": 1}', ['{"a": 1}']),
        ('[{"a": 1}, {"b": "x', ['{"a": 1}', '{"b": "x']),
        ('[{"a": 1', ['{"a": 1']),
        # Elements that are no objects spoil the one after them, or stand at the end as they are.
        ('[1, "}", {"a": 1}, {"b": 2}, null]', ['1, "}", {"a": 1}', '{"b": 2}', "null]"]),
    ],
)
def test_small_and_broken_files(spark, tmp_path, splits, text, values):
    (tmp_path / "a.json").write_text(text)
    found = read(spark, tmp_path)
    assert sorted(found) == sorted(values)


@pytest.mark.parametrize("text", ["[{}] [{}]", '{"a": 1}\n{"a": 2}', '[{"a": 1}]\n[{"a": "]["}]', "[][]"])
def test_several_values_raise(spark, tmp_path, splits, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError, match="several JSON values"):
        array_elements(spark, str(tmp_path))


def test_brackets_in_text_are_not_several_values(spark, tmp_path, splits):
    rows = [{"a": "x} {y"}, {"a": "] ["}, {"a": '\\"} {'}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    assert parsed(read(spark, tmp_path)) == parsed(map(json.dumps, rows))


def test_an_array_in_small_splits_is_read_like_lines(spark, tmp_path, splits):
    rows = [{"dt": "d", "customer_id": i if i % 7 else "x", "item_id": i, "click_time": "2025-08-14 10:00:00"} for i in range(50)]
    (tmp_path / "array").mkdir()
    (tmp_path / "array" / "a.json").write_text(json.dumps(rows))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    found = {layout: read_clicks(spark, str(tmp_path / layout), layout=layout) for layout in ("array", "lines")}
    for side in (0, 1):
        assert sorted(map(str, found["array"][side].collect())) == sorted(map(str, found["lines"][side].collect()))
    assert found["array"][0].schema == clicks_schema and found["array"][1].count() == 8
