"""Nested configuration documents against updates of Python dictionaries."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratalens.operators import config

BASE = {
    "parameters": {
        "Base_Infectivity": 0.0005942186798021557, "Enable": 1, "Name": "a \"quoted\" {text}", "Years": [1990, {"x": []}], "Empty": {}, "None": None,
        "Campaign": {"Start": 4.50, "Events": {"é.dot": True, "b": [[1, 2], []]}},
    },
    "version": "1",
}
LEAF = "set_id int, layer int, path array<string>, value string"


def documents(spark, base, overrides, ids):
    rows = spark.createDataFrame([(json.dumps(base),)], "config string")
    sets = spark.createDataFrame([(i,) for i in ids], "set_id int")
    changed = spark.createDataFrame([(s, layer, path, None if v is ... else json.dumps(v)) for s, layer, path, v in overrides], LEAF)
    leaves = config.override_paths(config.config_leaves(rows), changed, sets, "set_id")
    return {r.set_id: json.loads(r.config) for r in config.build_documents(leaves, ["set_id"]).collect()}


def updated(base, overrides):
    found = json.loads(json.dumps(base))
    for _, _, path, value in sorted(overrides, key=lambda o: o[1]):
        here = found
        for key in path[:-1]:
            here = here.setdefault(key, {})
        here[path[-1]] = None if value is ... else value
    return found


def test_leaves_of_a_nested_document(spark):
    rows = spark.createDataFrame([(1, json.dumps(BASE), "x"), (2, None, "y"), (3, "{}", "z"), (4, "[1]", "z")], "id int, config string, path string")
    found = {(r.id, ".".join(r.path)): json.loads(r.value) for r in config.config_leaves(rows, keys=["id"]).collect()}
    assert found[1, "parameters.Campaign.Events.é.dot"] is True and found[1, "parameters.None"] is None
    assert found[1, "parameters.Years"] == [1990, {"x": []}] and found[1, "parameters.Empty"] == {}
    assert found[3, ""] == {} and found[4, ""] == [1] and not any(i == 2 for i, _ in found) and len(found) == 12


def test_documents_of_sets_are_updates_of_the_base(spark):
    p = "parameters"
    overrides = [
        (1, 0, [p, "Enable"], 0), (1, 1, [p, "Enable"], "on"), (1, 0, [p, "New", "Deep"], {"a": {"b": [1]}}),
        (2, 0, [p, "Campaign"], {"Start": 7, "Other": {"q": 1}}), (2, 1, [p, "Campaign", "Other", "q"], 2), (2, 1, [p, "Campaign", "End"], 9),
        (3, 0, [p, "Campaign", "Start"], 1), (3, 1, [p, "Campaign"], {}), (3, 0, [p, "None"], ...), (3, 0, ["version"], ...), (4, 0, [p, "Empty", "now"], {"full": []}),
        (9, 0, ["version"], 5),
    ]
    found = documents(spark, BASE, overrides, [1, 2, 3, 4, 4])
    assert found == {i: updated(BASE, [o for o in overrides if o[0] == i]) for i in (1, 2, 3, 4)}


def test_many_random_updates(spark):
    dice = random.Random(3)
    paths = [["a"], ["a", "x"], ["a", "x", "deep"], ["a", "y"], ["b"], ["b", "x"], ["c"]]
    base = {"a": {"x": {"deep": 1, "other": 2}, "y": 3}, "b": {"x": 4}, "c": 5}
    overrides = []
    for i in range(60):
        for layer in range(3):
            path = dice.choice(paths)
            inner = {"x": {"deep": i, "more": layer}, "y": layer} if len(path) == 1 and path != ["c"] else dice.choice([i, "t", None, [i]])
            overrides.append((i, layer, path, {"deep": i} if path == ["a", "x"] else inner))
    assert documents(spark, base, overrides, range(60)) == {i: updated(base, [o for o in overrides if o[0] == i]) for i in range(60)}


@pytest.mark.parametrize("overrides", [
    [(1, 0, ["version"], 1), (1, 0, ["version"], 2)], [(1, 0, ["parameters"], {"a": 1}), (1, 0, ["parameters", "a"], 2)],
    [(1, 0, ["version", "below"], 2)],
])
def test_overrides_that_cannot_both_hold_fail(spark, overrides):
    with pytest.raises(PySparkException, match="two overrides|two values"):
        documents(spark, BASE, overrides, [1])


def test_no_sets_and_no_documents(spark):
    assert documents(spark, BASE, [], []) == {}
    none = spark.createDataFrame([], "config string")
    assert config.config_leaves(none).count() == 0
    assert config.build_documents(config.config_leaves(none).withColumn("i", F.lit(1)), ["i"]).count() == 0
