import json
from datetime import date

import pytest

from trailpack.schemas import clicks_schema, training_output_schema
from trailpack.sinks.writers import quarantine_path, read_run, write_parquet, write_quarantine
from trailpack.sources.readers import (
    read_atc,
    read_clicks,
    read_feed,
    read_impressions,
    read_orders,
)

CLICK = {"dt": "2025-08-14", "customer_id": 1, "item_id": 5, "click_time": "2025-08-14 10:00:00"}


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_each_feed_from_json_arrays(spark, tmp_path):
    rows = {
        read_impressions: {"dt": "2025-08-14", "ranking_id": "r", "customer_id": 1, "impressions": [{"item_id": 3, "is_order": True}]},
        read_clicks: CLICK,
        read_atc: {"dt": "d", "customer_id": 1, "config_id": 5, "simple_id": "s", "occurred_at": "2025-08-14 10:00:00"},
        read_orders: {"order_date": "2025-08-14", "customer_id": 1, "config_id": 5},
    }
    for n, (read, row) in enumerate(rows.items()):
        good, bad = read(spark, put(tmp_path / f"{n}.json", json.dumps([row, row])), layout="array")
        found = good.collect()
        assert len(found) == 2 and bad.count() == 0
        assert found[0].asDict(recursive=True) == row


def test_extra_and_missing_fields(spark, tmp_path):
    path = put(tmp_path / "a.json", json.dumps([{**CLICK, "more": {"x": 1}}, {"customer_id": 2}]))
    good, bad = read_clicks(spark, path)
    assert good.schema == clicks_schema
    assert sorted(map(tuple, good.collect()), key=str) == sorted(
        [("2025-08-14", 1, 5, "2025-08-14 10:00:00"), (None, 2, None, None)], key=str
    )
    assert bad.count() == 0


def test_wrong_type_rejects_its_own_row_only(spark, tmp_path):
    rows = [CLICK, {**CLICK, "customer_id": "abc"}, {**CLICK, "item_id": 99999999999}, {**CLICK, "item_id": 1.5}]
    for layout, text in (("array", json.dumps(rows)), ("lines", "\n".join(map(json.dumps, rows)))):
        good, bad = read_clicks(spark, put(tmp_path / layout / "a.json", text), layout=layout)
        assert [r.customer_id for r in good.collect()] == [1]
        found = sorted((r.customer_id, r.item_id, r._bad_fields) for r in bad.collect())
        assert found == [
            ("1", "1.5", ["item_id"]),
            ("1", "99999999999", ["item_id"]),
            ("abc", "5", ["customer_id"]),
        ]


@pytest.mark.parametrize(
    "shown, ok",
    [
        ([{"item_id": 1, "is_order": True}], True),
        ([{"item_id": 1}], True),
        ([{"item_id": None, "is_order": None}, None], True),
        ([], True),
        (None, True),
        ([{"item_id": "x", "is_order": True}], False),
        ([{"item_id": 1, "is_order": True}, {"item_id": 2, "is_order": 1}], False),
        ("oops", False),
    ],
)
def test_nested_items(spark, tmp_path, shown, ok):
    row = {"dt": "2025-08-14", "ranking_id": "r", "customer_id": 1, "impressions": shown}
    path = put(tmp_path / "a.json", json.dumps([row]))
    good, bad = read_impressions(spark, path)
    assert (good.count(), bad.count()) == ((1, 0) if ok else (0, 1))
    if ok and shown and shown[0].get("item_id") == 1 and "is_order" in shown[0]:
        assert good.first().asDict(recursive=True)["impressions"] == shown


def test_broken_line_and_broken_document(spark, tmp_path):
    lines = put(tmp_path / "l" / "a.json", json.dumps(CLICK) + "\n{oops\n" + json.dumps(CLICK))
    good, bad = read_clicks(spark, lines, layout="lines")
    assert good.count() == 2
    assert [r._corrupt_record for r in bad.collect()] == ["{oops"]
    put(tmp_path / "d" / "a.json", json.dumps([CLICK]))
    put(tmp_path / "d" / "b.json", '[{"customer_id": 1')
    good, bad = read_clicks(spark, str(tmp_path / "d"))
    assert good.count() == 1 and bad.count() == 1


def test_all_lines_are_read(spark, tmp_path):
    path = put(tmp_path / "a.json", "\n".join(json.dumps({**CLICK, "item_id": i}) for i in range(5)))
    assert read_clicks(spark, path, layout="lines")[0].count() == 5


def test_no_split(spark, tmp_path):
    path = put(tmp_path / "a.json", json.dumps([{**CLICK, "customer_id": "abc"}]))
    good, bad = read_feed(spark, path, clicks_schema, corrupt_col=None)
    assert bad is None and good.first().customer_id is None


def test_folders_globs_and_lists(spark, tmp_path):
    a = put(tmp_path / "x" / "a.json", json.dumps([CLICK]))
    b = put(tmp_path / "x" / "b.json", json.dumps([CLICK]))
    for path in (str(tmp_path / "x"), str(tmp_path / "x" / "*.json"), str(tmp_path / "*"), [a, b]):
        assert read_clicks(spark, path)[0].count() == 2


def test_parquet_layout_and_unknown_layout(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([tuple(CLICK.values())], clicks_schema).write.parquet(path)
    good, bad = read_clicks(spark, path, layout="parquet")
    assert bad.count() == 0 and good.collect()[0].asDict() == CLICK
    with pytest.raises(ValueError, match="layout"):
        read_clicks(spark, path, layout="csv")


def run(spark, rows):
    full = [(r, c, [(1, True)], [1], [1], d) for r, c, d in rows]
    return spark.createDataFrame(full, training_output_schema)


def test_partitions_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "out")
    first = run(spark, [("a", 1, date(2025, 8, 14)), ("b", 2, date(2025, 8, 15))])
    write_parquet(first, path, partition_by=["as_of_date"], rebalance=True)
    assert sorted(p.name for p in (tmp_path / "out").glob("as_of_date=*")) == [
        "as_of_date=2025-08-14",
        "as_of_date=2025-08-15",
    ]
    assert sorted(map(str, read_run(spark, path).collect())) == sorted(map(str, first.collect()))
    write_parquet(first, path, mode="append", partition_by=["as_of_date"])
    assert read_run(spark, path).count() == 4
    write_parquet(first.limit(1), path)
    assert read_run(spark, path).count() == 1


def test_empty_partitioned_run_reads_as_empty(spark, tmp_path):
    path = str(tmp_path / "out")
    write_parquet(run(spark, []), path, partition_by=["as_of_date"])
    back = read_run(spark, path)
    assert back.count() == 0 and back.columns == training_output_schema.names


def test_day_filter_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "out")
    write_parquet(run(spark, [("a", 1, date(2025, 8, 14))]), path, partition_by=["as_of_date"])
    day = read_run(spark, path).where("as_of_date = DATE'2025-08-14'")
    assert "PartitionFilters: [isnotnull(as_of_date" in day._jdf.queryExecution().toString()


def test_quarantine_survives_the_run(spark, tmp_path):
    out = str(tmp_path / "out")
    bad = spark.createDataFrame([("x",)], "raw string")
    write_quarantine(bad, out, "clicks", "r1")
    write_quarantine(None, out, "orders", "r1")
    write_parquet(run(spark, []), out)
    assert spark.read.json(quarantine_path(out, "clicks", "r1")).first().raw == "x"
    assert not (tmp_path / "out_quarantine" / "r1" / "orders").exists()
