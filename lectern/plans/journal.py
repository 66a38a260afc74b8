"""Plans applied to a stored library: an ordered fold of each item's operations, with snapshot, audit log, read-back check and rollback.

A library is a folder of tables written in runs. A run holds the new state of the items that a plan touched (``state``), what
they were before (``snapshot``) and the outcome of every operation (``audit``, JSON lines). Its row in ``meta`` is written last and makes
it valid: a run that failed half-way is overwritten by the next one, and a plan whose id is in ``meta`` is not applied again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.changes import READ_ONLY
from lectern.storage import materialize

ITEM = "key string, version long, deleted boolean, fields map<string,string>, tags array<string>, collections array<string>"
OPERATION = "seq long, key string, kind string, field string, value string, expected_version long"
_FOLDED = f"what string, seq long, kind string, field string, outcome string, gone boolean, {ITEM}"
_LISTS = {"add-tag": "tags", "remove-tag": "tags", "add-collection": "collections", "remove-collection": "collections"}


def _step(item: dict | None, op: dict) -> tuple[dict | None, str]:
    """The item after one operation, and the outcome; the item comes back as it was unless the outcome is applied."""
    kind, field, value = op["kind"], op["field"], op["value"]
    if kind == "create":
        if item is not None:
            return item, "exists"
        return {"version": 1, "deleted": False, "fields": {"itemType": value or "document"}, "tags": [], "collections": []}, "applied"
    if item is None:
        return None, "missing"
    new = dict(item)
    if kind == "set":
        if field is None or field in READ_ONLY:
            return item, "read-only"
        new["fields"] = {k: v for k, v in item["fields"].items() if k != field} | ({} if value is None else {field: value})
    elif kind in _LISTS:
        column = _LISTS[kind]
        others = [x for x in item[column] if x != value]
        if kind.startswith("remove"):
            new[column] = others
        elif value not in item[column]:
            new[column] = [*others, value]
    elif kind in ("trash", "restore"):
        new["deleted"] = kind == "trash"
    elif kind == "delete":
        return (None, "applied") if item["deleted"] else (item, "not-in-trash")
    else:
        return item, "unknown"
    if new == item:
        return item, "unchanged"
    new["version"] = item["version"] + 1
    return new, "applied"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key and seq, an item before its operations; outcomes, and the final state of each touched item.

    Only one item is held at a time, however many operations it has.
    """
    key, item, first, touched, out = None, None, None, False, []
    schema = pa.schema([
        ("what", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("field", pa.string()), ("outcome", pa.string()), ("gone", pa.bool_()), ("key", pa.string()), ("version", pa.int64()),
        ("deleted", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())), ("tags", pa.list_(pa.string())), ("collections", pa.list_(pa.string())),
    ])

    def row(what: str, state: dict | None, **more) -> dict:
        return {"what": what, "key": key, **(state or {"version": None}), **more}

    def finished() -> list[dict]:
        return [row("state", item, gone=item is None)] if touched else []

    for b in batches:
        for r in b.to_pylist():
            if r["key"] != key:
                out += finished()
                key, item, first, touched = r["key"], None, None, False
            if r["kind"] is None:
                item = {c: r[c] for c in ("version", "deleted")} | {"fields": dict(r["fields"] or {}), "tags": r["tags"] or [], "collections": r["collections"] or []}
                first = item["version"]
                continue
            if r["expected_version"] is not None and r["expected_version"] != first:
                outcome = "conflict"
            else:
                item, outcome = _step(item, r)
            touched |= outcome == "applied"
            out.append(row("outcome", {"version": item["version"] if item else None}, seq=r["seq"], kind=r["kind"], field=r["field"], outcome=outcome))
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    out += finished()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def fold(items: DataFrame, operations: DataFrame) -> DataFrame:
    """Outcomes of the operations (what = outcome) and new states of the items that changed (what = state; gone where deleted).

    items as ITEM, operations as OPERATION. Operations of an item are done in order of seq, each on what the one before left; a
    change raises the version by one. expected_version is the version on which the plan was made: where the item had another
    one before the plan, the operation is a conflict and does nothing; null expects nothing. Outcomes: applied, unchanged, conflict, missing,
    exists, read-only, not-in-trash, unknown. Operations without a key or kind are left out.
    """
    ops = operations.where("key is not null and kind is not null")
    asked = ops.select("key").distinct()
    nothing = lambda c, kind: F.lit(None).cast(kind).alias(c)
    state = items.join(asked, "key", "left_semi").select("key", nothing("seq", "long"), nothing("kind", "string"), nothing("field", "string"), nothing("value", "string"), nothing("expected_version", "long"), "version", "deleted", "fields", "tags", "collections")
    steps = ops.select("key", "seq", "kind", "field", "value", "expected_version", nothing("version", "long"), nothing("deleted", "boolean"), nothing("fields", "map<string,string>"), nothing("tags", "array<string>"), nothing("collections", "array<string>"))
    rows = state.unionByName(steps).repartition("key").sortWithinPartitions("key", F.col("kind").isNotNull(), "seq", "kind", "field", "value")
    return rows.mapInArrow(_fold, _FOLDED)


def _meta(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder}/meta")
    except AnalysisException:
        return None


def _read(spark: SparkSession, folder: str, name: str, runs: list[int]) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/{name}").parquet(*[f"{folder}/{name}/run={r}" for r in runs])


def runs(spark: SparkSession, folder: str) -> list[int]:
    meta = _meta(spark, folder)
    return [] if meta is None else sorted(r["run"] for r in meta.select("run").collect())


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The items of the library: the newest valid state of each key that was not deleted."""
    rows = _read(spark, folder, "state", runs(spark, folder))
    newest = rows.groupBy("key").agg(F.max_by(F.struct("gone", "version", "deleted", "fields", "tags", "collections"), "run").alias("r")).select("key", "r.*")
    return newest.where("not gone").drop("gone")


def audit(spark: SparkSession, folder: str) -> DataFrame:
    """(run, plan_id, seq, key, kind, field, outcome, version) of every operation of the valid runs."""
    meta = _meta(spark, folder)
    valid = [r["run"] for r in meta.where("kind <> 'base'").select("run").collect()] if meta is not None else []
    schema = "seq long, key string, kind string, field string, outcome string, version long"
    if not valid:
        return spark.createDataFrame([], f"run int, plan_id string, {schema}")
    rows = spark.read.schema(schema).option("basePath", f"{folder}/audit").json([f"{folder}/audit/run={r}" for r in valid])
    return rows.join(F.broadcast(meta.select("run", "plan_id")), "run").select("run", "plan_id", "seq", "key", "kind", "field", "outcome", "version")


def create(spark: SparkSession, folder: str, items: DataFrame) -> None:
    """Begin a library with items as ITEM; raises ValueError where there is one."""
    if runs(spark, folder):
        raise ValueError(f"{folder} holds a library")
    items.withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{folder}/state/run=1")
    _commit(spark, folder, 1, "base", "base", {})


def _commit(spark: SparkSession, folder: str, run: int, plan_id: str, kind: str, counts: dict[str, int]) -> None:
    row = [(run, plan_id, kind, counts)]
    spark.createDataFrame(row, "run int, plan_id string, kind string, counts map<string,long>").coalesce(1).write.mode("append").parquet(f"{folder}/meta")


def _write(spark: SparkSession, folder: str, plan_id: str, kind: str, before: DataFrame, states: DataFrame, outcomes: DataFrame) -> dict[str, int]:
    """Write a run: snapshot first, then state and audit, then the check of what can be read back, then the row that makes it valid."""
    run = max(runs(spark, folder)) + 1
    before.write.mode("overwrite").parquet(f"{folder}/snapshot/run={run}")
    states.write.mode("overwrite").parquet(f"{folder}/state/run={run}")
    outcomes.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/audit/run={run}")
    missing, different = read_back(_read(spark, folder, "state", [run]), states)
    if missing or different:
        raise RuntimeError(f"run {run} cannot be read back: {missing} items missing, {different} different")
    counts = {r["outcome"]: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    _commit(spark, folder, run, plan_id, kind, counts)
    return counts


def read_back(found: DataFrame, wanted: DataFrame) -> tuple[int, int]:
    """(missing, different) among the wanted states of (key, version, deleted, gone, fields, ...)."""
    shape = lambda df: df.select("key", F.xxhash64("version", "deleted", "gone", F.array_sort(F.map_entries("fields")), "tags", "collections").alias("shape"))
    both = shape(wanted).join(shape(found).withColumnRenamed("shape", "read").withColumn("there", F.lit(True)), "key", "left")
    row = both.agg(F.count_if(F.col("there").isNull()), F.count_if(F.col("there") & ~F.col("shape").eqNullSafe(F.col("read")))).first()
    return row[0], row[1]


def apply_plan(spark: SparkSession, folder: str, plan_id: str, operations: DataFrame) -> dict[str, int]:
    """Apply a plan (OPERATION) once; the number of its operations by outcome. A plan that was applied already changes nothing and gives its counts again."""
    done = _meta(spark, folder).where(F.col("plan_id") == plan_id).select("counts").first()
    if done is not None:
        return dict(done["counts"])
    items = current(spark, folder)
    folded = materialize(fold(items, operations), "folded")
    states = folded.where("what = 'state'").select("key", "version", "deleted", "fields", "tags", "collections", "gone")
    outcomes = folded.where("what = 'outcome'").select("seq", "key", "kind", "field", "outcome", "version")
    before = items.join(states.select("key"), "key", "left_semi")
    return _write(spark, folder, plan_id, "plan", before, states, outcomes)


def rollback_plan(spark: SparkSession, folder: str, plan_id: str) -> DataFrame:
    """(key, action): what taking a plan back does to each item it changed: restore, remove (it was created), none (gone already) or conflict (changed since)."""
    run = _meta(spark, folder).where((F.col("plan_id") == plan_id) & (F.col("kind") == "plan")).select("run").first()
    if run is None:
        raise ValueError(f"no plan {plan_id} was applied")
    after = _read(spark, folder, "state", [run[0]]).select("key", F.col("version").alias("after"), "gone")
    old = _read(spark, folder, "snapshot", [run[0]]).select("key", F.lit(True).alias("was"))
    now = current(spark, folder).select("key", F.col("version").alias("now"))
    rows = after.join(old, "key", "left").join(now, "key", "left")
    action = (
        F.when(F.col("was").isNull(), F.when(F.col("now").isNull(), "none").when(F.col("now") == F.col("after"), "remove").otherwise("conflict"))
        .when(F.col("now").eqNullSafe(F.when(~F.col("gone"), F.col("after"))), "restore").otherwise("conflict")
    )
    return rows.select("key", action.alias("action"))


def roll_back(spark: SparkSession, folder: str, plan_id: str) -> dict[str, int]:
    """Take a plan back from its snapshot; items by outcome. Restored items get a version above all they had; items changed since are left alone (conflict)."""
    name = f"rollback of {plan_id}"
    done = _meta(spark, folder).where(F.col("plan_id") == name).select("counts").first()
    if done is not None:
        return dict(done["counts"])
    actions = materialize(rollback_plan(spark, folder, plan_id), "rollback")
    run = _meta(spark, folder).where((F.col("plan_id") == plan_id) & (F.col("kind") == "plan")).first()["run"]
    items, old = current(spark, folder), _read(spark, folder, "snapshot", [run]).drop("run")
    high = items.select("key", F.col("version").alias("high"))
    restored = old.join(actions.where("action = 'restore'").select("key"), "key", "left_semi").join(high, "key", "left")
    restored = restored.withColumn("version", F.greatest("version", F.coalesce("high", "version")) + 1).drop("high").withColumn("gone", F.lit(False))
    removed = items.join(actions.where("action = 'remove'").select("key"), "key", "left_semi").withColumn("gone", F.lit(True))
    states = materialize(restored.unionByName(removed), "restored").select("key", "version", "deleted", "fields", "tags", "collections", "gone")
    outcomes = actions.join(states.select("key", "version"), "key", "left").select(F.lit(None).cast("long").alias("seq"), "key", F.lit("rollback").alias("kind"), F.lit(None).cast("string").alias("field"), F.col("action").alias("outcome"), "version")
    before = items.join(states.select("key"), "key", "left_semi")
    return _write(spark, folder, name, "rollback", before, states, outcomes)
