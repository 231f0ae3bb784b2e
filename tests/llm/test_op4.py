import random

import pytest

from colloquy.llm import op4_tools as op
from colloquy.llm.common import Staging
from tests.oracle import same

CALLS = "conv_id long, call_id string, seq long, name string, arguments string, needs array<string>, status_ string"
RESULTS = "conv_id long, call_id string, seq long, content string"


def test_schema_rules():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 3}, "b": {"type": ["string", "null"], "minLength": 2, "pattern": "^x"}, "c": {"type": "array", "items": {"enum": [1, "q"]}, "maxItems": 2}}}
    assert op.problems({"a": 2, "b": "xy", "c": [1, "q"]}, schema) == []
    assert op.problems({"a": 2.0, "b": None}, schema) == []
    assert op.problems({"a": True}, schema) == [".a: type"]
    assert op.problems({"b": "y", "z": 1, "c": [1, 2, "q"]}, schema) == [".a: required", ".z: unknown", ".b: length", ".b: pattern", ".c: items", ".c[1]: enum"]
    assert op.problems({"a": 4}, schema) == [".a: range"] and op.problems([], schema) == [".: type"]


def test_canonical_json():
    assert op.canonical({"b": [1, 2.5, None], "a": {"é": "x\n\""}}) == '{"a":{"é":"x\\n\\""},"b":[1,2.5,null]}'


@pytest.mark.parametrize("whole", [50_000, 0])
def test_links_and_levels(spark, monkeypatch, whole):
    monkeypatch.setattr(op, "WHOLE", whole)
    calls = spark.createDataFrame(
        [
            (1, "a", 1, "f", "{}", [], None),
            (1, "b", 2, "f", "{}", ["a", "zzz", "b"], None),
            (1, "c", 3, "f", "{}", ["a", "b", "b"], None),
            (1, "a", 9, "f", "{}", ["c"], None),
            (1, "x", 4, "f", "{}", ["y"], None),
            (1, "y", 5, "f", "{}", ["x"], None),
            (2, "b", 1, "f", "{}", ["a"], None),
            (2, None, 2, "f", "{}", ["b"], None),
            (None, "a", 3, "f", "{}", None, None),
            (3, "d", 1, "f", "{}", ["e"], None),
            (3, "e", 2, "f", "{}", None, None),
        ],
        CALLS,
    )
    results = spark.createDataFrame([(1, "a", 2, "r"), (1, "a", 3, "again"), (1, "c", 5, None), (2, "a", 1, "no call"), (2, None, 2, ""), (3, "e", 4, "z")], RESULTS)
    linked, answers = op.link(calls, results)
    assert sorted(((r.conv_id, r.call_id, r.seq, r.status) for r in linked.collect()), key=repr) == sorted(
        [(1, "a", 1, "linked"), (1, "b", 2, "open"), (1, "c", 3, "linked"), (1, "a", 9, "duplicate"), (1, "x", 4, "open"), (1, "y", 5, "open"), (2, "b", 1, "open"), (2, None, 2, "unnamed"), (None, "a", 3, "unnamed"), (3, "d", 1, "open"), (3, "e", 2, "linked")], key=repr
    )
    assert sorted(((r.conv_id, r.call_id, r.seq, r.status) for r in answers.collect()), key=repr) == sorted([(1, "a", 2, "linked"), (1, "a", 3, "duplicate"), (1, "c", 5, "linked"), (2, "a", 1, "orphan"), (2, None, 2, "unnamed"), (3, "e", 4, "linked")], key=repr)
    staging = Staging(spark, "test-tools")
    got = {(r.conv_id, r.call_id): r.level for r in op.levels(linked, staging).collect()}
    staging.drop()
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (2, "b"): 0, (3, "e"): 0, (3, "d"): 1}


def longest(needs):
    """Levels by trying until nothing changes; needs: {call: its needs}."""
    found = {}
    while new := {c: max((found[n] + 1 for n in own), default=0) for c, own in needs.items() if c not in found and all(n in found for n in own)}:
        found |= new
    return found


def test_contraction_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "WHOLE", 0)
    rng, needs = random.Random(4), {}
    for conv in range(25):
        n = rng.randrange(1, 40)
        for i in range(n):
            # chains, branches, and now and then a later call, which may close a cycle
            own = [i - 1] if rng.random() < 0.7 else [rng.randrange(n) if rng.random() < 0.1 else rng.randrange(i) for _ in range(rng.randrange(4)) if i]
            needs[conv, i] = sorted({(conv, j) for j in own if 0 <= j != i})
    calls = spark.createDataFrame([(c, f"c{i}", [f"c{j}" for _, j in own], "open") for (c, i), own in needs.items()], "conv_id long, call_id string, needs array<string>, status string")
    staging = Staging(spark, "test-tools")
    got = {(r.conv_id, int(r.call_id[1:])): r.level for r in op.levels(calls, staging).collect()}
    staging.drop()
    want = longest(needs)
    assert got == want and 0 < len(want) < len(needs)


@pytest.mark.parametrize("whole", [500_000, 50_000])
def test_one_conversation_of_120_000_turns(spark, monkeypatch, whole):
    monkeypatch.setattr(op, "WHOLE", whole)
    calls = spark.range(120_000).selectExpr("1L AS conv_id", "concat('c', id) AS call_id", "array(concat('c', id - 1)) AS needs", "'open' AS status")
    staging = Staging(spark, "test-tools")
    got = op.levels(calls, staging)
    assert got.where("call_id = concat('c', level)").count() == got.count() == 120_000
    staging.drop()


def test_what_json_cannot_hold(spark):
    rows = [(1, "f", "[" * 100_000), (2, "f", '{"a":' * 200_000 + "1" + "}" * 200_000), (3, "f", '{"a": NaN}'), (4, "f", '{"a": 1e999}'), (5, "f", '{"a": "\\ud800"}'), (6, "f", '{"\\udc00": 1}'), (7, "f", '{"a": -Infinity}'), (8, "f", "")]
    got = op.checked(spark.createDataFrame(rows, "id long, name string, arguments string"), {"f": {}}).collect()
    assert [(r.valid, r.faults, r.arguments_json) for r in got] == [(False, ".: not an object", None)] * 8
    for value in (float("nan"), float("inf")):
        with pytest.raises(ValueError, match="JSON"):
            op.canonical({"a": value})


def test_arguments(spark):
    rows = [(1, "f", '{"b": 1, "a": "é"}'), (2, "f", "{"), (3, "f", None), (4, "g", "{}"), (5, "f", "[1]"), (6, "f", '{"a": 5}')]
    got = op.checked(spark.createDataFrame(rows, "id long, name string, arguments string"), {"f": {"properties": {"a": {"type": "string"}}}}).collect()
    assert [(r.valid, r.faults, r.arguments_json) for r in got] == [
        (True, "", '{"a":"é","b":1}'), (False, ".: not an object", None), (False, ".: not an object", None), (False, ".: no such tool", "{}"), (False, ".: not an object", None), (False, ".a: type", '{"a":5}'),
    ]


def test_turns(spark):
    staging = Staging(spark, "test-tools")
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a\"1"), (1, 3, "user", " \n"), (1, 5, "user", None), (1, 6, "assistant", "x" * 100_000), (1, 8, "assistant", "orphan"), (2, 0, None, "n"), (None, 1, "user", "u"), (3, 1, "user", "twice"), (3, 1, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as call_id", "2 as status")
    got = {(r.conv_id, r.turn, r.role): (r.status, r.level, r.valid) for r in op.messages(df, staging).collect()}
    assert op.messages(df, staging).count() == len(rows) and op.messages(df.limit(0), staging).count() == 0
    staging.drop()
    assert got == {
        (1, 0, "system"): ("message", None, None), (1, 1, "user"): ("linked", 0, True), (1, 2, "assistant"): ("linked", None, None), (1, 3, "user"): ("open", 1, False), (1, 5, "user"): ("linked", 2, False),
        (1, 6, "assistant"): ("linked", None, None), (1, 8, "assistant"): ("orphan", None, None), (2, 0, None): ("message", None, None), (None, 1, "user"): ("unnamed", None, True), (3, 1, "user"): ("open", 0, True),
    }


def test_query_equals_sql(spark):
    assert len(same(spark, "op4_tool_links")[1]) == 536
