"""Schema drift between JSON result files.

Rows are loaded as path-value maps with raw types (:func:`flatten_records`);
path-type statistics of those maps are aggregated per file (:func:`path_types`),
the changes between successive files come from the statistics
(:func:`schema_changes`), and the values of the maps are projected into typed
columns with the failed casts reported (:func:`consistent_table`).  Paths go
down into objects (``a.b``) and arrays (``a[]``); a file's fields are the paths
of depth 1.

Defined results for odd input: a null, blank or unparsable body has no records
and no fields; it is left out of the sequence of its runner.  A record that is
no object is skipped.  Redelivered files count once.  Ties of ``written_at``
are ordered by ``file_id``.  An exponent without a point counts as decimal.
Where one file mixes other kinds, the widest in the order boolean < integer <
decimal < string < array < object is its type.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.session import cut

WIDTH = {"boolean": 0, "integer": 1, "decimal": 2, "string": 3, "array": 4, "object": 5}


class _Dec(str):
    """A number written with a fraction or exponent, kept as its text."""


class _Int(str):
    """A number written without a fraction, kept as its text."""


_DECODER = json.JSONDecoder(parse_float=_Dec, parse_int=_Int, parse_constant=_Dec, strict=False)


def raw_type(v: object) -> str | None:
    if v is None:
        return None
    if v is True or v is False:
        return "boolean"
    if isinstance(v, _Int):
        return "integer"
    if isinstance(v, _Dec):
        return "decimal"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else "object"


def _text(v: object) -> str | None:
    if v is None:
        return None
    if v is True or v is False:
        return "true" if v else "false"
    if isinstance(v, str):
        return str(v)
    return json.dumps(_plain(v), ensure_ascii=False)


def _plain(v: object) -> object:
    if isinstance(v, _Int):
        return int(v)
    if isinstance(v, _Dec):
        return float(v)
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return v


def _is_record(v: object) -> bool:
    return isinstance(v, dict)


def records(body: str | None) -> list[tuple[str | None, dict]]:
    """(key, record) of each record of a body: a map keyed by id, a list, or either below one wrapper key."""
    if body is None:
        return []
    try:
        doc = _DECODER.decode(body.lstrip("﻿").strip())
    except (ValueError, RecursionError):
        out = []
        for line in body.lstrip("﻿").splitlines():  # one record a line
            try:
                v = _DECODER.decode(line.strip()) if line.strip() else None
            except (ValueError, RecursionError):
                return []
            if _is_record(v):
                out.append((None, v))
        return out
    return _records_of(doc)


def _records_of(doc: object) -> list[tuple[str | None, dict]]:
    if isinstance(doc, list):
        return [(None, r) for r in doc if _is_record(r)]
    if not isinstance(doc, dict):
        return []
    vals = list(doc.values())
    if vals and all(_is_record(r) or r is None for r in vals):
        inner = [r for r in vals if r]
        if len(vals) == 1 and inner and all(_is_record(x) for x in inner[0].values()):
            return _records_of(inner[0])
        return [(k, r) for k, r in doc.items() if _is_record(r)]
    for k in ("results", "problems", "records", "runs", "data"):
        if isinstance(doc.get(k), (dict, list)):
            return _records_of(doc[k])
    if "id" in doc:
        return [(None, doc)]
    nested = [v for v in vals if isinstance(v, (dict, list)) and _records_of(v)]
    return _records_of(nested[0]) if nested else []


def paths_of(record: dict) -> Iterator[tuple[str, int, str | None, str | None]]:
    """(path, depth, raw type, value) of a record in order, nested ones behind the one that holds them; an object's or array's value is its text."""
    todo = [(k, 1, v) for k, v in reversed(record.items())]
    while todo:
        path, depth, v = todo.pop()
        yield path, depth, raw_type(v), _text(v)
        if isinstance(v, dict):
            todo += [(f"{path}.{k}", depth + 1, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(f"{path}[]", depth + 1, x) for x in reversed(v)]


def flatten_records(files: DataFrame, *keep: str) -> DataFrame:
    """One row per record: columns of its file, its key and its path-value map, an ordered array of (path, depth, kind, value)."""
    kept = files.select("file_id", *keep, "body")
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    names = [*kept.columns[:-1], "record_no", "record_key", "fields"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *held, body in b.itertuples(index=False, name=None):
                for n, (key, rec) in enumerate(records(body)):
                    rows.append((*held, n, key, [{"path": p, "depth": d, "kind": t, "value": v} for p, d, t, v in paths_of(rec)]))
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return kept.mapInPandas(run, f"{head}, record_no int, record_key string, fields array<struct<path:string,depth:int,kind:string,value:string>>")


def path_types(files: DataFrame) -> DataFrame:
    """Per file the ordered fields of its first record with the widest type over all its records.

    A file's path-value maps lie in one partition, so the statistics are combined
    there to a row per file and field before anything is shuffled; redelivered
    files change neither a least place nor a widest type.
    """
    stamped = files.withColumn("written_at", F.col("written_at").cast("timestamp_ntz"))
    f = flatten_records(stamped, "runner", "written_at").select("file_id", "runner", "written_at", "record_no", F.posexplode("fields").alias("pos", "f")).filter("f.depth = 1")
    width = F.create_map(*[F.lit(x) for kv in WIDTH.items() for x in kv])
    stats = f.groupBy("file_id", "runner", "written_at", F.col("f.path").alias("name")).agg(
        F.min(F.when(F.col("record_no") == 0, F.col("pos"))).alias("pos"), F.max(F.try_element_at(width, F.col("f.kind"))).alias("w")
    )
    kinds = F.array(*[F.lit(k) for k in WIDTH])
    field = F.struct("pos", "name", F.get(kinds, F.col("w")).alias("kind"))
    each = stats.filter("pos is not null").groupBy("file_id", "runner", "written_at").agg(F.array_sort(F.collect_list(field)).alias("fields"))
    return each.withColumn("fields", F.transform("fields", lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"))))


def compare(prev: list[str], cur: list[str]) -> tuple[dict[str, str], list[str], list[str]]:
    """(renamed: new name -> old name, added, removed) between two ordered field lists."""
    both = set(prev) & set(cur)

    def places(names: list[str]) -> dict[str | None, list[str]]:
        at, out = None, {}
        for n in names:
            if n in both:
                at = n
            else:
                out.setdefault(at, []).append(n)
        return out

    gone, come = places(prev), places(cur)
    renamed, added, removed = {}, [], []
    for at, names in come.items():
        old = gone.get(at, [])
        renamed.update(zip(names, old, strict=False))
        added += names[len(old) :]
    for at, names in gone.items():
        removed += names[len(come.get(at, [])) :]
    return renamed, added, removed


# The state of a runner after a file: ordered [name, type or None, origin name, open], where `open` tells
# that the field was already there at the start of the segment, so an unknown type comes from before it.
State = list[tuple[str, str | None, str | None, str | None]]


def step(state: State | None, fields: list[tuple[str, str | None]]) -> tuple[State, list[tuple[str, str]]]:
    """The state after one more file of the runner, and that file's changes."""
    names = [n for n, _ in fields]
    if state is None:
        return [(n, t, n, None) for n, t in fields], []
    before = {n: (t, o, src) for n, t, o, src in state}
    renamed, added, removed = compare([s[0] for s in state], names)
    out, changes = [], [(n, "added") for n in added] + [(n, "removed") for n in removed] + [(n, "renamed") for n in renamed]
    for n, t in fields:
        old = n if n in before else renamed.get(n)
        if old is None:
            out.append((n, t, n, None))
            continue
        last, origin, src = before[old]
        if t is not None and last is not None and t != last:
            changes.append((n, "type_changed"))
        out.append((n, t if t is not None else last, origin, src))
    return out, changes


def _segments(schemas: DataFrame) -> DataFrame:
    """Range-partition by (runner, written_at): a runner with very many files spans several partitions."""
    n = max(2, schemas.sparkSession.sparkContext.defaultParallelism)
    ranged = schemas.repartitionByRange(n, "runner", "written_at", "file_id").sortWithinPartitions("runner", "written_at", "file_id")
    return cut(ranged.withColumn("part", F.spark_partition_id()))


def _rows(b: pd.DataFrame) -> Iterator[tuple]:
    for fid, runner, part, fs in zip(b["file_id"], b["runner"], b["part"], b["fields"], strict=True):
        yield fid, None if pd.isna(runner) else runner, int(part), [(f["name"], f["kind"]) for f in fs]


def _carried(seg: DataFrame) -> dict[int, dict]:
    """State that enters each partition.  One small summary per partition reaches the driver, however many files there are.

    A segment alone knows a runner's state but for two things that come from
    before it: types of fields that were null so far, and origin names.  The
    summary marks those by the name the field had at the segment's first file.
    """
    schema = "part int, runner string, first array<struct<name:string,kind:string>>, known array<array<string>>, whole boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, first, state, part, many = None, None, None, None, False
        for b in batches:
            for _, runner, p, fields in _rows(b):
                if part is None or runner != cur:
                    many = part is not None
                    # `src` names the field of the first file whose earlier life is unknown
                    cur, first, state, part = runner, fields, [(n, t, n, n) for n, t in fields], p
                else:
                    state, _ = step(state, fields)
        if part is not None:
            yield pd.DataFrame(
                [(part, cur, [{"name": n, "kind": t} for n, t in first], [list(s) for s in state], many)],
                columns=["part", "runner", "first", "known", "whole"],
            )

    incoming: dict[int, dict] = {}
    carry: dict | None = None
    for r in sorted(seg.select("file_id", "runner", "part", "fields").mapInPandas(run, schema).collect(), key=lambda r: r["part"]):
        if carry is not None:
            incoming[r["part"]] = carry
        state: State = [tuple(s) for s in r["known"]]
        if carry is not None and carry["runner"] == r["runner"] and not r["whole"]:
            entered, _ = step(carry["state"], [(f["name"], f["kind"]) for f in r["first"]])
            at = {n: (t, o) for n, t, o, _ in entered}
            state = [(n, t if t is not None or src is None else at[src][0], o if src is None else at[src][1], None) for n, t, o, src in state]
        carry = {"runner": r["runner"], "state": [(n, t, o, None) for n, t, o, _ in state]}
    return incoming


def _walk(seg: DataFrame, schema: str, emit) -> DataFrame:
    incoming = _carried(seg)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, state, started = None, None, False
        for b in batches:
            rows = []
            for fid, runner, part, fields in _rows(b):
                if not started:
                    started, enter = True, incoming.get(part)
                    cur, state = (runner, enter["state"]) if enter and enter["runner"] == runner else (runner, None)
                elif runner != cur:
                    cur, state = runner, None
                state, changes = step(state, fields)
                rows += emit(fid, state, changes)
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return seg.select("file_id", "runner", "part", "fields").mapInPandas(run, schema)


def schema_changes(files: DataFrame) -> DataFrame:
    """(file_id, field_name, change_kind) against the file before of the same runner."""
    seg = _segments(path_types(files))
    return _walk(seg, "file_id long, field_name string, change_kind string", lambda fid, _, ch: [(fid, n, k) for n, k in ch])


def origins(files: DataFrame) -> DataFrame:
    """(file_id, field_name, origin_name): the name a field had when it first came, renames followed."""
    seg = _segments(path_types(files))
    return _walk(seg, "file_id long, field_name string, origin_name string", lambda fid, st, _: [(fid, n, o) for n, _, o, _ in st])


# Fixed: the columns of a run result and their types.
TARGETS = {
    "id": "string",
    "categories": "array<string>",
    "passed": "boolean",
    "total_iters": "int",
    "elapsed_s": "double",
    "ref_in_tok": "bigint",
    "ref_out_tok": "bigint",
    "gen_in_tok": "bigint",
    "gen_out_tok": "bigint",
    "rtl_path": "array<string>",
}


def typed_value(kind: Column, value: Column, target: str) -> Column:
    """``value`` as ``target``; null where it can't be cast."""
    if target == "string":
        return value
    if target == "boolean":
        low = F.lower(F.trim(value))
        return F.when(low.isin("true", "1", "yes", "pass", "passed"), F.lit(True)).when(low.isin("false", "0", "no", "fail", "failed"), F.lit(False))
    if target in ("int", "bigint"):
        n = F.regexp_replace(F.trim(value), r"(?<=\d)[,_ ](?=\d{3})", "")
        whole = n.try_cast("decimal(38,6)")
        return F.when(whole == F.floor(whole), whole.try_cast(target))
    if target == "double":
        return F.regexp_replace(F.trim(value), r"(?i)\s*(s|sec|seconds)$", "").try_cast("double")
    one = F.array(value)
    many = F.from_json(value, "array<string>")
    path = F.from_json(value, "struct<dir:string,file:string>")
    joined = F.when(path["file"].isNotNull(), F.array(F.concat_ws("/", path["dir"], path["file"])))
    return F.when(kind == "array", many).when(kind == "object", joined).otherwise(one)


def consistent_table(files: DataFrame) -> DataFrame:
    """Every record of every file in one table of typed columns.

    Fields follow their renames inside a runner; ``extra`` holds the fields
    outside the target columns and ``failed_casts`` names the values that could
    not be cast (they stay in ``extra``).
    """
    recs = flatten_records(files).dropDuplicates(["file_id", "record_no"])
    top = F.filter("fields", lambda f: f["depth"] == 1)
    fields = recs.select("file_id", "record_no", "record_key", F.explode_outer(top).alias("f"))
    named = fields.join(
        origins(files).withColumnRenamed("file_id", "ofile"),
        (F.col("file_id") == F.col("ofile")) & (F.col("f.path") == F.col("field_name")),
        "left",
    ).select("file_id", "record_no", "record_key", F.coalesce("origin_name", F.col("f.path")).alias("name"), F.col("f.kind").alias("kind"), F.col("f.value").alias("value"))
    cols, bad = [], []
    for name, target in TARGETS.items():
        v = typed_value(F.col("kind"), F.col("value"), target)
        cols.append(F.max(F.when(F.col("name") == name, v)).alias(name))
        bad.append(F.when((F.col("name") == name) & F.col("value").isNotNull() & v.isNull(), F.lit(name)))
    failed = F.coalesce(*bad)
    extra = F.when(~F.col("name").isin(*TARGETS) | failed.isNotNull(), F.struct("name", "value"))
    return (
        named.groupBy("file_id", "record_no", "record_key")
        .agg(*cols, F.sort_array(F.collect_set(failed)).alias("failed_casts"), F.sort_array(F.collect_set(extra)).alias("extra"))
        .withColumn("id", F.coalesce("id", "record_key"))
        .drop("record_key")
    )


def path_statistics(files: DataFrame) -> DataFrame:
    """Values and distinct files of each (path, raw type), nulls and nested paths included."""
    f = flatten_records(files).select("file_id", "record_no", F.posexplode("fields").alias("pos", "f")).select("file_id", "record_no", "pos", "f.path", F.coalesce("f.kind", F.lit("null")).alias("raw_type"))
    per_file = f.distinct().groupBy("path", "raw_type", "file_id").agg(F.count("*").alias("n"))
    return per_file.groupBy("path", "raw_type").agg(F.sum("n").alias("n_values"), F.count("*").alias("n_files"))
