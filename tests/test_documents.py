import json

import pytest
from pyspark.sql import functions as F

from tests.test_issue import panel
from veritide.operators import documents, issue, schema_check


def found(spark, schema, *texts):
    df = spark.createDataFrame([(t if t is None or isinstance(t, str) else json.dumps(t),) for t in texts], "document string")
    return {r.problem: r.n for r in schema_check.contract_violations(df, schema).collect()}


def test_every_rule_is_broken_once(spark):
    schema = {
        "$defs": {"cell": documents.fields({"v": {"type": "integer", "minimum": 1, "maximum": 5}}, {"w": {"type": ["number", "null"], "exclusiveMinimum": 0}})},
        "type": "object", "required": ["name", "kind", "cells"], "additionalProperties": False,
        "properties": {"name": {"type": "string", "pattern": "^[a-z]+$"}, "kind": {"enum": ["x", 2, None]}, "cells": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"$ref": "#/$defs/cell"}}, "when": {"anyOf": [{"type": "null"}, {"type": "string", "pattern": "^d"}]}, "none": {"type": "array", "items": False}, "one": {"const": "c"}},
    }
    good = {"name": "abc", "kind": "x", "cells": [{"v": 1}, {"v": 5, "w": 0.5}, {"v": 2, "w": None}]}
    assert found(spark, schema, good, {**good, "kind": 2}, {**good, "kind": None}, {**good, "when": None, "none": [], "one": "c"}) == {}
    bad = [
        ({**good, "name": "Abc"}, "$.name: does not match ^[a-z]+$"),
        ({**good, "name": 3}, "$.name: not string"),
        ({**good, "kind": "y"}, "$.kind: not one of x, 2, null"),
        ({k: v for k, v in good.items() if k != "name"}, "$.name: missing"),
        ({**good, "more": 1}, "$.more: not allowed"),
        ({**good, "cells": []}, "$.cells: beyond minItems 1"),
        ({**good, "cells": [{"v": 1}] * 4}, "$.cells: beyond maxItems 3"),
        ({**good, "cells": [{"v": 0}]}, "$.cells[].v: beyond minimum 1"),
        ({**good, "cells": [{"v": 6}]}, "$.cells[].v: beyond maximum 5"),
        ({**good, "cells": [{"v": 1.5}]}, "$.cells[].v: not integer"),
        ({**good, "cells": [{"v": 1, "w": 0}]}, "$.cells[].w: beyond exclusiveMinimum 0"),
        ({**good, "cells": [{"v": 1, "w": "a"}]}, "$.cells[].w: not number or null"),
        ({**good, "cells": [{"w": 1}]}, "$.cells[].v: missing"),
        ({**good, "cells": [{"v": 1, "z": 1}]}, "$.cells[].z: not allowed"),
        ({**good, "cells": {"v": 1}}, "$.cells: not array"),
        ({**good, "when": "x"}, "$.when: none of the allowed forms"),
        ({**good, "none": [1]}, "$.none: items are not allowed"),
        ({**good, "one": "d"}, "$.one: not one of c"),
        ([1], "$: not object"),
        ("no json", "$: not a document"),
        (None, "$: not a document"),
    ]
    got = found(spark, schema, *[d for d, _ in bad])
    want = {}
    for _, p in bad:
        want[p] = want.get(p, 0) + 1
    assert got == want
    assert found(spark, schema, {**good, "name": None, "kind": "q"}) == {"$.name: not string": 1, "$.kind: not one of x, 2, null": 1}
    with pytest.raises(ValueError, match="unknown keyword"):
        schema_check.problems(F.lit(None), {"oneOf": []})
    with pytest.raises(ValueError, match="no definition"):
        schema_check.problems(F.lit(None), {"$ref": "#/$defs/none"})


def test_all_six_documents_keep_their_contracts(spark, tmp_path):
    pairs, path, out = panel(spark, 120).cache(), str(tmp_path / "log"), str(tmp_path / "out")
    for d in ("2023-03-01", "2023-03-02", "2023-04-30"):
        issue.issue(spark, path, pairs, d, f"{d} 14:00:00")
    stations = spark.createDataFrame([("KAAA", "A, NV", 40.0, -100.0, "west"), ("KBBB", "B, NV", 41.0, -101.5, "west"), ("KCCC", "C, NV", 42.0, -102.0, "north")], "station string, label string, lat double, lon double, climate_region string")
    bad = documents.publish(spark, out, pairs.withColumn("source", F.lit("raw_nbm")), pairs, path, stations, "2023-05-01T00:00:00Z", n_boot=50, min_blocks=3)
    assert bad.collect() == []
    read = lambda name: [json.loads(r.value) for r in spark.read.text(f"{out}/{name}").collect()]
    (manifest,), (index,), (card,), (none,) = read("manifest"), read("city_index"), read("scorecard"), read("completeness")
    assert manifest["station_count"] == 3 and len(manifest["files"]) == 10 and manifest["files"][4] == "cities/KAAA.json" and manifest["data_through"] == "2023-05-01"
    assert [c["icao"] for c in index["cities"]] == ["KAAA", "KBBB", "KCCC"] and index["cities"][2]["summary"] == {"significant": False, "text": "Not enough data yet."}
    assert card["window"] == {"basis": "target_date", "days": 30, "end": "2023-05-01", "start": "2023-04-02"} and {s["source"] for s in card["national"]} == {"raw_nbm", "baseline"}
    assert card["log"]["partitions"] == 3 and card["log"]["rows"] == 12 and card["log"]["last_run_date"] == "2023-04-30" and card["intervals"]["n_boot"] == 50
    assert none == {"schema_version": "1.0.0", "stations": []}
    cities = {c["icao"]: c for c in read("cities")}
    assert len(cities["KAAA"]["stats"]) > 1 and cities["KCCC"]["stats"] == [] and cities["KCCC"]["typical_miss"] == {"max": None, "min": None}
    assert {c["icao"]: len(c["stats"]) for c in read("scorecard_cities")} == {"KAAA": 4, "KBBB": 4, "KCCC": 0}
    assert list(cities["KAAA"]) == sorted(cities["KAAA"])
    stat = dict(card["national"][0])
    del stat["skill"]
    card["national"][0] = {**stat, "source": "oracle", "extra": 1}
    assert found(spark, documents.CONTRACTS["scorecard"], card) == {"$.national[].skill: missing": 1, "$.national[].source: not one of raw_nbm, baseline, challenger": 1, "$.national[].extra: not allowed": 1}
    with pytest.raises(ValueError, match="lacks its label"):
        documents.publish(spark, out, pairs, pairs, path, stations.withColumn("lat", F.lit(None).cast("double")), "2023-05-01T00:00:00Z")
    pairs.unpersist()
