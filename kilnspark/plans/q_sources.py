"""Sources and sinks."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from kilnspark.functions import text as T
from kilnspark.plans.base import query, rows, scan
from kilnspark.session import ensure_checkpoint_dir
from kilnspark.sources import files, sinks
from kilnspark.sources.tables import table
from kilnspark.streaming import logstream


def _at(spark, name):
    """A folder of its own for each call, so that runs side by side don't write over one another."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '[^@WS@]')")
def src_hf(spark, sf):
    return rows(spark, sf, "docs").filter(~T.is_blank(F.col("text"))).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("SELECT item_id, prompt FROM benchmark_problems")
def src_hf_fallback(spark, sf):
    """The first candidate that can be read and has rows."""
    got = files.first_nonempty([lambda: table(spark, sf, "no_such_table"), lambda: scan(spark, sf, "rm").filter("lang = 'no such'"), lambda: rows(spark, sf, "bp").select("item_id", "prompt")])
    return got


@query("SELECT module_id, coalesce(nullif(lang, ''), nullif(regexp_extract(rtl_path, '\\.([A-Za-z]+)$', 1), ''), '') AS language FROM @rm@", each=True)
def src_alias_coalesce(spark, sf):
    ext = F.regexp_extract("rtl_path", r"\.([A-Za-z]+)$", 1)
    return scan(spark, sf, "rm").select("module_id", T.first_filled(F.col("lang"), ext).alias("language"))


@query("SELECT sample_id, task_type, quality_score, source FROM @ts@")
def src_jsonl(spark, sf):
    path = sinks.write_jsonl(rows(spark, sf, "ts", "task_type", "quality_score", "source"), _at(spark, "src_jsonl"))
    return files.jsonl(spark, path, "sample_id long, task_type string, quality_score int, source string")


@query(
    """SELECT file_id, k AS key FROM (SELECT file_id, unnest(json_keys(body)) AS k FROM @rf@ WHERE left(ltrim(body, chr(65279) || ' ' || chr(10)), 1) = '{')""",
    each=True,
)
def src_json_map(spark, sf):
    body = scan(spark, sf, "rf").filter(F.left(T.strip(F.col("body")), F.lit(1)) == "{").select("file_id", "body")
    return files.exploded_map(body, "body").select("file_id", "key")


@query("SELECT runner, file_name, file_id FROM @rf@ QUALIFY row_number() OVER (PARTITION BY runner ORDER BY file_name, file_id) = 1")
def src_glob_merge(spark, sf):
    return files.merge_first(scan(spark, sf, "rf").select("runner", "file_name", "file_id"), "runner", "file_name", "file_id")


@query("SELECT item_id, problem_id FROM benchmark_problems")
def src_search_path(spark, sf):
    found = files.first_existing(spark, [f"{sf}/missing.parquet", f"{sf}/benchmark_problems.parquet", f"{sf}/documents.parquet"])
    return spark.read.parquet(found).select("item_id", "problem_id")


@query(
    r"""SELECT key, path, text FROM (SELECT rtl_path AS path, verilog AS text, regexp_extract(rtl_path, '([^/]*)\.(?:sv|v|SV|V|Sv|sV)$', 1) AS key,
        CASE WHEN lower(rtl_path) LIKE '%.sv' THEN 0 ELSE 1 END AS s FROM @rm@ WHERE regexp_matches(rtl_path, '(?i)\.(sv|v)$') AND regexp_matches(verilog, '[^@WS@]'))
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY s, path) = 1"""
)
def src_file_by_key(spark, sf):
    return files.text_by_key(scan(spark, sf, "rm"), "rtl_path", "verilog", [".sv", ".v"])


@query(
    r"""SELECT problem_id, trim(split_part(l, '=', 1)) AS key, trim(split_part(l, '=', 2)) AS value
        FROM (SELECT problem_id, unnest(string_split(harness_files['src/.env'], chr(10))) AS l FROM benchmark_problems) WHERE contains(l, '=') AND NOT starts_with(trim(l), '#')"""
)
def src_envfile(spark, sf):
    env = T.env_map(F.col("harness_files")["src/.env"])
    return rows(spark, sf, "bp").select("problem_id", F.explode(env).alias("key", "value"))


@query("SELECT result_id, error_msg AS message FROM @rr@ WHERE error_msg IS NOT NULL", each=True)
def src_xml(spark, sf):
    esc = F.col("error_msg")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    xml = F.concat(F.lit('<testsuite><testcase name="t"><failure error_msg="'), esc, F.lit('"/></testcase></testsuite>'))
    return scan(spark, sf, "rr").filter("error_msg is not null").select("result_id", files.xml_failures(xml)[0].alias("message"))


_PAIRS_SQL = r"""
SELECT a.key, CAST(length(a.t) AS BIGINT) AS n_test, CAST(length(b.t) AS BIGINT) AS n_env FROM
 (SELECT problem_id || '/src' AS key, map_values(harness_files)[list_position(map_keys(harness_files), list_filter(map_keys(harness_files), lambda x: x LIKE 'src/test_%.py')[1])] AS t FROM benchmark_problems) a
 JOIN (SELECT problem_id || '/src' AS key, harness_files['src/.env'] AS t FROM benchmark_problems) b USING (key)"""


def _pairs(spark, sf):
    f = rows(spark, sf, "bp").select("problem_id", F.explode("harness_files").alias("path", "text"))
    f = f.withColumn("path", F.concat("problem_id", F.lit("/"), F.regexp_replace("path", r"/test_.*\.py$", "/test.py")))
    from kilnspark.operators.joins import pair_by_suffix

    return pair_by_suffix(f, "path", "text", "/test.py", "/.env").select("key", F.length("left_text").cast("bigint").alias("n_test"), F.length("right_text").cast("bigint").alias("n_env"))


@query(_PAIRS_SQL)
def src_git_pairs(spark, sf):
    return _pairs(spark, sf)


@query(_PAIRS_SQL)
def join_file_pair(spark, sf):
    return _pairs(spark, sf)


@query(r"SELECT r.result_id, p.item_id FROM @rr@ r JOIN (SELECT regexp_replace(problem_id, '_\d{4}$', '') AS k, min(item_id) AS item_id FROM benchmark_problems GROUP BY 1) p ON regexp_replace(r.problem_id, '_\d{4}$', '') = p.k")
def src_dirscan(spark, sf):
    dirs = rows(spark, sf, "bp").groupBy(files.folder_key(F.col("problem_id")).alias("k")).agg(F.min("item_id").alias("item_id"))
    return rows(spark, sf, "rr", "problem_id").withColumn("k", files.folder_key(F.col("problem_id"))).join(dirs, "k").select("result_id", "item_id")


@query("SELECT runner, max(file_name) AS file_name FROM @rf@ GROUP BY 1")
def src_latest(spark, sf):
    return files.latest(scan(spark, sf, "rf"), "runner", "file_name")


@query("SELECT sample_id, to_json(messages) IS NOT NULL AS has_messages, task_type FROM @ts@")
def snk_jsonl(spark, sf):
    path = sinks.write_jsonl(rows(spark, sf, "ts", "messages", "task_type"), _at(spark, "snk_jsonl"))
    back = files.jsonl(spark, path, "sample_id long, messages array<struct<role:string,content:string>>, task_type string")
    return back.select("sample_id", F.col("messages").isNotNull().alias("has_messages"), "task_type")


@query("SELECT action_name, count(*) AS n FROM @il@ GROUP BY 1")
def snk_jsonl_append(spark, sf):
    df, path = rows(spark, sf, "il", "action_name"), _at(spark, "snk_append")
    sinks.write_jsonl(df.filter("row_id % 2 = 0"), path)
    sinks.append_safely(df.filter("row_id % 2 = 1"), path)
    return files.jsonl(spark, path, "row_id long, action_name string").groupBy("action_name").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT problem_id FROM @rr@ WHERE problem_id NOT IN (SELECT problem_id FROM @rr@ WHERE test_result = 0)")
def snk_json_checkpoint(spark, sf):
    """What a restarted run has left, after the passed problems were recorded."""
    r, path = scan(spark, sf, "rr"), _at(spark, "snk_results")
    r.filter("test_result = 0").select("problem_id").distinct().write.mode("overwrite").parquet(path)
    return sinks.remaining(r.select("problem_id").distinct(), path, "problem_id")


@query("SELECT lower(regexp_extract(rtl_path, '[^.]*$')) AS ext, count(*) AS n FROM @rm@ GROUP BY 1")
def snk_cache(spark, sf):
    df = rows(spark, sf, "rm", "rtl_path")
    made = sinks.stage_cache("ext_counts", lambda: df.groupBy(F.lower(F.regexp_extract("rtl_path", r"[^.]*$", 0)).alias("ext")).agg(F.count("*").alias("n")), df, hashlib.sha1(f"{sf}|{df.schema.simpleString()}".encode()).hexdigest()[:16])
    return made


@query()
def snk_text_report(spark, sf):
    agg = rows(spark, sf, "rr", "category", "test_result").groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("test_result") == 0).alias("passed")).orderBy("category")
    text = sinks.summary_text([r.asDict() for r in agg.collect()], "Tests by category")  # a row per category
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.splitlines())], "line_no int, line string")


@query(r"SELECT problem_id AS key, regexp_replace(prompt, '^[@WS@]+|[@WS@]+$', '', 'g') || chr(10) AS text FROM benchmark_problems")
def snk_rtl(spark, sf):
    path = sinks.write_texts(rows(spark, sf, "bp"), "problem_id", "prompt", _at(spark, "snk_rtl"))
    return spark.read.text(path, wholetext=True).select(F.col("problem_id").alias("key"), F.col("value").alias("text"))


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def snk_atomic(spark, sf):
    path = _at(spark, "snk_atomic")
    rows(spark, sf, "docs").filter("lang = 'en'").select("doc_id").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("SELECT region_key, n FROM (SELECT lang AS region_key, count(*) AS n FROM documents GROUP BY 1)")
def snk_object_store(spark, sf):
    """Any file system Spark knows takes the same writer; offline this is a folder."""
    path = _at(spark, "snk_store")
    rows(spark, sf, "docs").groupBy(F.col("lang").alias("region_key")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("""SELECT row_id, 'data: {"type":"status","row":' || row_id || '}' || chr(10) || chr(10) AS frame FROM @il@""", each=True)
def snk_sse(spark, sf):
    frame = sinks.event_frame(F.struct(F.lit("status").alias("type"), F.col("row_id").alias("row")))
    return scan(spark, sf, "il").select("row_id", frame.alias("frame"))


# ------------------------------------------------------------------ streams


@query("SELECT date_trunc('day', received_at) AS day_start, action_name, count(*) AS n, count(*) FILTER (passed) AS n_passed FROM @il@ WHERE received_at IS NOT NULL GROUP BY 1, 2")
def stream_actions(spark, sf):
    """The log as a stream of files: each row once, actions by day of arrival."""
    whole = table(spark, sf, "iteration_log")
    log = logstream.read_table(spark, f"{sf}/iteration_log.parquet", whole.schema).select("row_id", F.col("received_at").cast("timestamp").alias("ts"), "action_name", "passed").filter("ts is not null")
    days = logstream.windowed_actions(log.dropDuplicates(["row_id"]), None, "1 day")
    out = logstream.settle(days, _at(spark, "stream_actions"), _at(spark, "stream_checkpoint"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day_start"), "action_name", "n", "n_passed")
