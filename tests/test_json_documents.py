"""Documents cut into many splits against a JSON parser."""

from __future__ import annotations

import json
import random

import pytest

from temblor.sources import json_documents, readers


def record(r, i):
    text = "".join(r.choice(['"', "\\", "{", "}", "[", "]", "é", "\n", ",", ":", "a", "\\u007d", " "]) for _ in range(r.randrange(0, 30)))
    return {"id": i, "note": text, "more": {"list": [1, {"deep": [text]}], "empty": {}}, "none": None}


def documents():
    r = random.Random(4)
    rows = [record(r, i) for i in range(400)]
    mixed = [x for i, row in enumerate(rows) for x in ([row, i, "s", None, [row]] if i % 9 == 0 else [row])]
    return {
        "array": (rows, rows),
        "mixed": (mixed, rows),
        "first": ({"name": "x}{", "meta": {"a": [1, {"b": 2}]}, "first": rows, "second": rows[:3]}, rows),
        "scalars": ({"bbox": [1, 2, 3], "rows": rows[:5]}, []),
        "features": ({"type": "FeatureCollection", "bbox": [1, 2], "features": rows, "after": [{"x": 1}]}, rows),
        "object": ({"a": 1, "b": {"c": [rows[0]]}}, []),
        "empty": ([], []),
    }


@pytest.mark.parametrize("name", list(documents()))
@pytest.mark.parametrize("size", [97, 4096, 1 << 20])
def test_objects_of_any_splits(spark, tmp_path, name, size):
    data, want = documents()[name]
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps(data, indent=1 if size == 4096 else None, ensure_ascii=name == "first"), encoding="utf-8")
    if size == 97 and name in ("mixed", "features"):
        path.write_text(json.dumps(data), encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, str(max(size, 2000) if size == 97 else size))
        values, features = json_documents.objects(spark, str(path))
        got = [json.loads(r.value) for r in values.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert features == (name == "features")


def test_geojson_places(spark, tmp_path):
    f = lambda i, kind, at, **p: {"type": "Feature", "geometry": {"type": kind, "coordinates": at}, "properties": {"publicid": f"e{i}", **p}}
    data = {"type": "FeatureCollection", "features": [f(1, "Point", [170.5, -41.25, 12.0], depth=3), f(2, "Point", [171.0, -42.0], depth=7), f(3, "Line", [1.0, 2.0], depth=9)]}
    (tmp_path / "two").mkdir()
    for n in "ab":
        (tmp_path / "two" / f"{n}.geojson").write_text(json.dumps(data))
    rows = readers.read(spark, str(tmp_path / "two"), "json").collect()
    assert len(rows) == 6 and len({r.row_idx for r in rows}) == 6
    got = {r.publicid: (r.longitude, r.latitude, r.depth) for r in rows}
    assert got == {"e1": ("170.5", "-41.25", "12.0"), "e2": ("171.0", "-42.0", "7"), "e3": (None, None, "9")}
