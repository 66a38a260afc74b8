"""Plans on a stored library: the fold held against a plain replay, replays, half-written runs, conflicts and rollback."""

import random

import pytest

from lectern.plans import journal

ITEMS = journal.ITEM


def by_hand(items, operations):
    state, outcomes = {k: dict(v) for k, v in items.items()}, {}
    before = {k: v["version"] for k, v in items.items()}
    for seq, key, kind, field, value, expected in sorted(operations):
        item = state.get(key)
        if expected is not None and expected != before.get(key):
            outcome = "conflict"
        elif kind == "create":
            outcome = "exists" if item else "applied"
            if not item:
                state[key] = {"version": 1, "deleted": False, "fields": {"itemType": value or "document"}, "tags": [], "collections": []}
        elif not item:
            outcome = "missing"
        elif kind == "delete":
            outcome = "applied" if item["deleted"] else "not-in-trash"
            if item["deleted"]:
                del state[key]
        else:
            old = (dict(item["fields"]), list(item["tags"]), list(item["collections"]), item["deleted"])
            outcome = "applied"
            if kind == "set" and field in journal.READ_ONLY:
                outcome = "read-only"
            elif kind == "set":
                item["fields"].pop(field, None)
                if value is not None:
                    item["fields"][field] = value
            elif kind == "trash" or kind == "restore":
                item["deleted"] = kind == "trash"
            else:
                column = "tags" if kind.endswith("tag") else "collections"
                if kind.startswith("remove"):
                    item[column] = [x for x in item[column] if x != value]
                elif value not in item[column]:
                    item[column] = item[column] + [value]
            if outcome == "applied" and old == (item["fields"], item["tags"], item["collections"], item["deleted"]):
                outcome = "unchanged"
            item["version"] += outcome == "applied"
        outcomes[seq] = outcome
    return state, outcomes


def stored(spark, folder):
    return {r["key"]: {"version": r["version"], "deleted": r["deleted"], "fields": r["fields"], "tags": r["tags"], "collections": r["collections"]} for r in journal.current(spark, folder).collect()}


def library(spark, folder, items):
    journal.create(spark, folder, spark.createDataFrame([(k, v["version"], v["deleted"], v["fields"], v["tags"], v["collections"]) for k, v in items.items()], ITEMS))


def some_items(n=30):
    return {f"k{k}": {"version": 3 + k % 4, "deleted": k % 5 == 0, "fields": {"title": f"t{k}"}, "tags": ["a"], "collections": []} for k in range(n)}


def some_operations(n, seed):
    r = random.Random(seed)
    kinds = ["create", "set", "set", "add-tag", "remove-tag", "add-collection", "remove-collection", "trash", "restore", "delete"]
    out = []
    for seq in range(n):
        key = "k0" if r.random() < 0.4 else f"k{r.randint(0, 36)}"  # one item has many operations
        out.append((seq, key, r.choice(kinds), r.choice(["title", "note", "version"]), r.choice(["a", "b", None, "title"]), r.choice([None, None, 3, 4])))
    return out


def test_fold_equals_a_replay_and_is_done_once(spark, tmp_path):
    folder, items = str(tmp_path / "library"), some_items()
    library(spark, folder, items)
    operations = some_operations(2500, 1)
    state, outcomes = by_hand(items, operations)
    plan = spark.createDataFrame(operations, journal.OPERATION).repartition(7)
    counts = journal.apply_plan(spark, folder, "p", plan)
    assert stored(spark, folder) == state
    log = journal.audit(spark, folder).collect()
    assert {r["seq"]: r["outcome"] for r in log} == outcomes and {r["plan_id"] for r in log} == {"p"}
    assert counts == {o: list(outcomes.values()).count(o) for o in {*outcomes.values()}}
    assert journal.apply_plan(spark, folder, "p", plan) == counts and len(journal.audit(spark, folder).collect()) == len(log) and journal.runs(spark, folder) == [1, 2]
    with pytest.raises(ValueError):
        library(spark, folder, items)


def test_rollback_restores_what_nobody_changed_since(spark, tmp_path):
    folder, items = str(tmp_path / "library"), some_items(8)
    library(spark, folder, items)
    op = lambda *rows: spark.createDataFrame([(*r, None) for r in rows], journal.OPERATION)
    journal.apply_plan(spark, folder, "p1", op((1, "k1", "set", "title", "x"), (2, "k2", "set", "title", "y"), (3, "k0", "delete", None, None), (4, "n1", "create", None, "book"), (5, "n2", "create", None, None), (6, "k3", "add-tag", None, "a"), (7, None, "set", "title", "q")))
    journal.apply_plan(spark, folder, "p2", op((1, "k2", "set", "note", "later"), (2, "n2", "trash", None, None), (3, "n2", "delete", None, None)))
    actions = {r["key"]: r["action"] for r in journal.rollback_plan(spark, folder, "p1").collect()}
    assert actions == {"k1": "restore", "k2": "conflict", "k0": "restore", "n1": "remove", "n2": "none"}
    assert journal.roll_back(spark, folder, "p1") == {"restore": 2, "conflict": 1, "remove": 1, "none": 1}
    now = stored(spark, folder)
    assert now["k1"] == items["k1"] | {"version": 6} and now["k0"]["fields"] == {"title": "t0"} and now["k0"]["version"] == 4 and "n1" not in now and now["k2"]["fields"] == {"title": "y", "note": "later"}
    assert journal.roll_back(spark, folder, "p1") == {"restore": 2, "conflict": 1, "remove": 1, "none": 1} and stored(spark, folder) == now
    with pytest.raises(ValueError):
        journal.roll_back(spark, folder, "p9")


def test_a_run_without_its_row_is_not_there(spark, tmp_path):
    folder, items = str(tmp_path / "library"), some_items(5)
    library(spark, folder, items)
    broken = spark.createDataFrame([("k1", 99, False, {"title": "broken"}, [], [], False)], ITEMS + ", gone boolean")
    broken.write.parquet(f"{folder}/state/run=2")
    assert stored(spark, folder) == items and journal.audit(spark, folder).count() == 0
    journal.apply_plan(spark, folder, "p", spark.createDataFrame([(1, "k2", "set", "title", "new", 5)], journal.OPERATION))
    assert stored(spark, folder) == items | {"k2": items["k2"] | {"version": 6, "fields": {"title": "new"}}}
    empty = journal.apply_plan(spark, folder, "none", spark.createDataFrame([], journal.OPERATION))
    assert empty == {} and len(stored(spark, folder)) == 5


def test_read_back_tells_missing_from_different(spark):
    schema = ITEMS + ", gone boolean"
    rows = [(k, 1, False, {"a": "1", "b": "2"}, ["t"], [], False) for k in "abc"]
    wanted = spark.createDataFrame(rows, schema)
    found = spark.createDataFrame([("a", 1, False, {"b": "2", "a": "1"}, ["t"], [], False), ("b", 1, False, {"a": "1", "b": "3"}, ["t"], [], False)], schema)
    assert journal.read_back(wanted, wanted) == (0, 0) and journal.read_back(found, wanted) == (1, 1)
