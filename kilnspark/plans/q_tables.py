"""Joins, aggregates, windows, sampling, set operations and rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnspark.functions import text as T
from kilnspark.operators import filters, iterate, joins, rewards, sampling, windows
from kilnspark.plans.base import query, rows, scan
from kilnspark.session import spread

# ------------------------------------------------------------------ joins


@query("SELECT i.row_id, b.item_id FROM @il@ i JOIN benchmark_problems b USING (problem_id)")
def join_inner_lookup(spark, sf):
    return joins.lookup(rows(spark, sf, "il", "problem_id"), rows(spark, sf, "bp").select("problem_id", "item_id"), "problem_id").select("row_id", "item_id")


_BEST = "(SELECT problem_id, max(difficulty) AS difficulty FROM @rr@ GROUP BY 1)"


@query(f"SELECT b.item_id, c.difficulty FROM benchmark_problems b JOIN {_BEST} c USING (problem_id)")
def join_semi(spark, sf):
    cache = scan(spark, sf, "rr").groupBy("problem_id").agg(F.max("difficulty").alias("difficulty"))  # a repeated row changes no maximum
    cur = rows(spark, sf, "bp").select("problem_id", "item_id", F.lit("unknown").alias("difficulty"))
    return joins.cached_override(cur, cache, "problem_id", ["difficulty"]).select("item_id", "difficulty")


@query("SELECT item_id FROM benchmark_problems WHERE problem_id NOT IN (SELECT problem_id FROM @il@ WHERE action_name = 'saved' AND passed)")
def join_anti(spark, sf):
    done = scan(spark, sf, "il").filter("action_name = 'saved' and passed").select("problem_id").distinct()
    return joins.not_done(rows(spark, sf, "bp").select("problem_id", "item_id"), done, "problem_id").select("item_id")


@query("SELECT b.item_id, coalesce(e.m, '') AS error_msg FROM benchmark_problems b LEFT JOIN (SELECT problem_id, max(error_msg) AS m FROM @rr@ GROUP BY 1) e USING (problem_id)")
def join_left_default(spark, sf):
    e = scan(spark, sf, "rr").groupBy("problem_id").agg(F.max("error_msg").alias("error_msg"))
    return joins.with_default(rows(spark, sf, "bp").select("problem_id", "item_id"), e, "problem_id", "error_msg", F.lit("")).select("item_id", "error_msg")


@query("SELECT module_id, coalesce(nullif(repo, ''), nullif(split_part(rtl_path, '/', 1), ''), '') AS place FROM @rm@", each=True)
def join_coalesce(spark, sf):
    """Per row the first filled value in the order of two sources."""
    return scan(spark, sf, "rm").select("module_id", T.first_filled(F.col("repo"), F.element_at(F.split("rtl_path", "/"), 1)).alias("place"))


_SIM_SQL = r"""
WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM documents WHERE @docs@),
     b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(prompt), '[\p{L}\p{N}_]+')) AS t FROM benchmark_problems),
     dt AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM d), bt AS (SELECT item_id, len(t) AS n, unnest(t) AS w FROM b),
     c AS (SELECT doc_id, item_id, dt.n AS nd, bt.n AS nb, count(*) AS c FROM dt JOIN bt USING (w) GROUP BY ALL),
     m AS (SELECT doc_id, max(c / (nd + nb - c)::DOUBLE) AS s FROM c GROUP BY 1)
SELECT doc_id, round(coalesce(s, 0.0), 6) AS max_similarity FROM documents LEFT JOIN m USING (doc_id) WHERE @docs@
"""


@query(_SIM_SQL.replace("@docs@", "true"))
def join_all_pairs_max(spark, sf):
    return joins.max_similarity(rows(spark, sf, "docs"), rows(spark, sf, "bp"), "doc_id", "text", "item_id", "prompt")


for _limit in (0.1, 0.2, 0.3, 0.8):

    @query("SELECT doc_id FROM (" + _SIM_SQL.replace("@docs@", "true") + f") WHERE max_similarity < {_limit}", name=f"decontaminate_{str(_limit).replace('.', '_')}")
    def decontaminate_at(spark, sf, limit=_limit):
        return joins.decontaminate(rows(spark, sf, "docs"), rows(spark, sf, "bp"), "doc_id", "text", "item_id", "prompt", limit).select("doc_id")


_PIECES = "(SELECT item_id, kt FROM (SELECT item_id, unnest(string_split(replace(prompt, chr(10), ' '), '. ')) AS kt FROM benchmark_problems) WHERE length(kt) > 40 UNION ALL SELECT -doc_id, text FROM documents WHERE lang = 'es' AND length(text) > 200)"


@query(
    f"""WITH k AS {_PIECES},
    e AS (SELECT doc_id, min(item_id) AS item_id FROM documents JOIN k ON text = kt GROUP BY 1),
    c AS (SELECT doc_id, min(item_id) AS item_id FROM documents JOIN k ON contains(text, kt) WHERE doc_id NOT IN (SELECT doc_id FROM e) GROUP BY 1)
    SELECT doc_id, item_id, 'exact' AS how FROM e UNION ALL SELECT doc_id, item_id, 'contained' FROM c"""
)
def join_exact_then_substring(spark, sf):
    """Known texts are the sentences of the held-out prompts, and the Spanish documents under negative ids."""
    k = rows(spark, sf, "bp").select("item_id", F.explode(F.split(F.replace("prompt", F.lit("\n"), F.lit(" ")), r"\. ")).alias("piece")).filter(F.length("piece") > 40)
    d = rows(spark, sf, "docs")
    k = k.unionByName(d.filter("lang = 'es' and length(text) > 200").select((-F.col("doc_id")).alias("item_id"), F.col("text").alias("piece")))
    return joins.exact_then_contained(d, k, "doc_id", "text", "item_id", "piece")


@query("SELECT b.item_id, coalesce(w.c, 'none') AS category FROM benchmark_problems b LEFT JOIN (SELECT problem_id, max(category) AS c FROM @rr@ WHERE test_result = 0 GROUP BY 1) w USING (problem_id)")
def join_overlay(spark, sf):
    w = scan(spark, sf, "rr").filter("test_result = 0").groupBy("problem_id").agg(F.max("category").alias("category"))
    return joins.overlay(rows(spark, sf, "bp").select("problem_id", "item_id", F.lit("none").alias("category")), w, "problem_id", "category").select("item_id", "category")


@query("SELECT item_id, problem_id IN (SELECT problem_id FROM @il@ WHERE action_name = 'saved' AND passed) AS verify_only FROM benchmark_problems")
def join_pre_solved(spark, sf):
    done = scan(spark, sf, "il").filter("action_name = 'saved' and passed").select("problem_id").distinct()
    b = rows(spark, sf, "bp").select("problem_id", "item_id")
    solved = b.join(done, "problem_id", "left_semi").withColumn("verify_only", F.lit(True))
    return solved.unionByName(joins.not_done(b, done, "problem_id").withColumn("verify_only", F.lit(False))).select("item_id", "verify_only")


# ------------------------------------------------------------------ aggregates


@query("SELECT run_name, count(*) AS n, count(*) FILTER (test_result = 0) AS passed, round(100.0 * count(*) FILTER (test_result = 0) / count(*), 6)::DOUBLE AS pct FROM @rr@ GROUP BY 1")
def agg_pass_rate(spark, sf):
    ok = F.count_if(F.col("test_result") == 0)
    return rows(spark, sf, "rr", "run_name", "test_result").groupBy("run_name").agg(F.count("*").alias("n"), ok.alias("passed"), F.round(100.0 * ok / F.count("*"), 6).alias("pct"))


@query("SELECT c AS category, count(*) AS n, count(*) FILTER (passed) AS passed FROM (SELECT r.test_result = 0 AS passed, unnest(b.categories) AS c FROM @rr@ r JOIN benchmark_problems b USING (problem_id)) GROUP BY 1")
def agg_by_category(spark, sf):
    j = rows(spark, sf, "rr", "problem_id", "test_result").join(rows(spark, sf, "bp").select("problem_id", "categories"), "problem_id")
    return j.select(F.explode("categories").alias("category"), (F.col("test_result") == 0).alias("p")).groupBy("category").agg(F.count("*").alias("n"), F.count_if("p").alias("passed"))


@query("SELECT problem_id, CASE WHEN count(*) = 0 THEN 0 ELSE CAST(floor(100 * count(*) FILTER (test_result = 0) / count(*)) AS BIGINT) END AS pct FROM @rr@ GROUP BY 1")
def agg_floor_pct(spark, sf):
    ok = F.count_if(F.col("test_result") == 0)
    return rows(spark, sf, "rr", "problem_id", "test_result").groupBy("problem_id").agg(F.when(F.count("*") > 0, F.floor(100 * ok / F.count("*"))).otherwise(0).cast("bigint").alias("pct"))


@query("SELECT task_type, count(*) AS n FROM @ts@ GROUP BY 1")
def agg_count_by_type(spark, sf):
    return rows(spark, sf, "ts", "task_type").groupBy("task_type").agg(F.count("*").alias("n"))


@query("SELECT task_type, round(coalesce(avg(quality_score), 0), 6) AS mean FROM @ts@ GROUP BY 1")
def agg_avg_nullable(spark, sf):
    return rows(spark, sf, "ts", "task_type", "quality_score").groupBy("task_type").agg(F.round(F.coalesce(F.avg("quality_score"), F.lit(0.0)), 6).alias("mean"))


_TOKS = ["ref_in_tok", "ref_out_tok", "gen_in_tok", "gen_out_tok"]


@query("SELECT problem_id, " + ", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in _TOKS) + " FROM @il@ GROUP BY 1")
def agg_sum_tokens(spark, sf):
    return rows(spark, sf, "il", "problem_id", *_TOKS).groupBy("problem_id").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in _TOKS])


# Sums of fractions are taken as decimals, so that they don't depend on the order of the rows.
_DEC = "decimal(28,9)"


@query(f"SELECT category, floor(CAST(sum(CAST(coalesce(execution_s, 0) AS {_DEC})) AS DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 AS mean_s FROM @rr@ GROUP BY 1")
def agg_avg_elapsed(spark, sf):
    total = F.sum(F.coalesce("execution_s", F.lit(0.0)).cast(_DEC)).cast("double")
    return rows(spark, sf, "rr", "category", "execution_s").groupBy("category").agg((F.floor(total / F.count("*") * 1e6 + 0.5) / 1e6).alias("mean_s"))


_REWARD_SQL = "(SELECT problem_id, cycle_no, row_id, CASE WHEN passed THEN 1.0 WHEN iverilog_pass THEN 0.3 ELSE 0.0 END::DOUBLE AS r FROM @il@)"


def _rewarded(spark, sf):
    r = F.when(F.col("passed"), 1.0).when(F.col("iverilog_pass"), 0.3).otherwise(0.0)
    return rows(spark, sf, "il", "problem_id", "cycle_no", r.alias("r"))


@query(f"SELECT cycle_no, floor(CAST(sum(CAST(r AS {_DEC})) AS DOUBLE) / greatest(count(*), 1) * 1e6 + 0.5) / 1e6 AS mean, round(count(*) FILTER (r >= 1.0) / greatest(count(*), 1)::DOUBLE, 6) AS clean, round(count(*) FILTER (r > 0 AND r < 1) / greatest(count(*), 1)::DOUBLE, 6) AS part FROM {_REWARD_SQL} GROUP BY 1")
def agg_reward_epoch(spark, sf):
    n = F.greatest(F.count("*"), F.lit(1))
    r = F.col("r")
    return _rewarded(spark, sf).groupBy("cycle_no").agg((F.floor(F.sum(r.cast(_DEC)).cast("double") / n * 1e6 + 0.5) / 1e6).alias("mean"), F.round(F.count_if(r >= 1.0) / n, 6).alias("clean"), F.round(F.count_if((r > 0) & (r < 1)) / n, 6).alias("part"))


@query(f"SELECT problem_id, round(avg(r), 9) AS mean, round(stddev_pop(r), 9) AS std FROM {_REWARD_SQL} GROUP BY 1")
def agg_group_stats(spark, sf):
    return _rewarded(spark, sf).groupBy("problem_id").agg(F.round(F.avg("r"), 9).alias("mean"), F.round(F.stddev_pop("r"), 9).alias("std"))


@query("SELECT lang, round(max(max_similarity), 6) AS top FROM documents JOIN (" + _SIM_SQL.replace("@docs@", "true") + ") USING (doc_id) GROUP BY 1")
def agg_max_sim(spark, sf):
    d = rows(spark, sf, "docs")
    s = joins.max_similarity(d, rows(spark, sf, "bp"), "doc_id", "text", "item_id", "prompt", ["lang"])
    return s.groupBy("lang").agg(F.round(F.max("max_similarity"), 6).alias("top"))


@query("SELECT run_name, coalesce(list_sort(list_distinct(list(problem_id) FILTER (test_result = 0))), []) AS passing, coalesce(list_sort(list_distinct(list(problem_id) FILTER (test_result <> 0))), []) AS failing FROM @rr@ GROUP BY 1")
def agg_collect_pass_fail(spark, sf):
    """Lists of problem ids: as long as the benchmark, however many rows."""
    ok = F.col("test_result") == 0
    return scan(spark, sf, "rr").groupBy("run_name").agg(F.sort_array(F.collect_set(F.when(ok, F.col("problem_id")))).alias("passing"), F.sort_array(F.collect_set(F.when(~ok, F.col("problem_id")))).alias("failing"))


_LEVELS = ["easy", "medium", "hard"]


@query(
    """WITH s AS (SELECT category, d FROM (SELECT DISTINCT category FROM @rr@), (VALUES ('easy'), ('medium'), ('hard')) v(d)),
    t AS (SELECT category, difficulty AS d, count(*) AS n, count(*) FILTER (test_result = 0) AS p, count(DISTINCT problem_id) AS np FROM @rr@ GROUP BY 1, 2)
    SELECT s.category, s.d AS difficulty, coalesce(n, 0) AS total, coalesce(p, 0) AS passed, coalesce(n - p, 0) AS failed, coalesce(np, 0) AS problems, round(coalesce(100.0 * p / n, 0), 6)::DOUBLE AS pct FROM s LEFT JOIN t ON s.category = t.category AND s.d = t.d"""
)
def agg_report(spark, sf):
    """Every category has every difficulty, with zeros where nothing was tested."""
    r = rows(spark, sf, "rr", "category", "difficulty", "test_result", "problem_id")
    spine = r.select("category").distinct().withColumn("difficulty", F.explode(F.array(*[F.lit(x) for x in _LEVELS])))
    t = r.groupBy("category", "difficulty").agg(F.count("*").alias("total"), F.count_if(F.col("test_result") == 0).alias("passed"), F.count_distinct("problem_id").alias("problems"))
    j = spine.join(t, ["category", "difficulty"], "left").fillna(0, ["total", "passed", "problems"])
    return j.select("category", "difficulty", "total", "passed", (F.col("total") - F.col("passed")).alias("failed"), "problems", F.round(F.when(F.col("total") > 0, 100.0 * F.col("passed") / F.col("total")).otherwise(0.0), 6).alias("pct"))


_F1, _F2 = "regexp_matches(coalesce(verilog, ''), '[^@WS@]')", "length(verilog) > 50 AND length(verilog) < 3000 AND contains(verilog, 'module')"
_F3 = "NOT (" + " OR ".join([f"contains(verilog, '{w}')" for w in T.SIM_TASKS + T.SIM_HEADERS] + [f"regexp_matches(verilog, '{p}')" for p in T.SIM_PATTERNS]) + ")"


@query(
    f"""SELECT 0 AS stage_no, 'scanned' AS stage, count(*) AS n_rows FROM @rm@ UNION ALL SELECT 1, 'nonblank', count(*) FILTER ({_F1}) FROM @rm@
    UNION ALL SELECT 2, 'size', count(*) FILTER ({_F1} AND {_F2}) FROM @rm@ UNION ALL SELECT 3, 'design', count(*) FILTER ({_F1} AND {_F2} AND {_F3}) FROM @rm@"""
)
def agg_funnel(spark, sf):
    c = F.col("verilog")
    return filters.funnel(spread(scan(spark, sf, "rm").select("module_id", "verilog")), "module_id", {"scanned": F.lit(True), "nonblank": ~T.is_blank(c), "size": filters.in_size(c), "design": filters.is_design(c)})


# ------------------------------------------------------------------ windows

_IT = "coalesce(try_cast(iteration AS INTEGER), 1000000)"


def _log(spark, sf, *cols, where=None):
    return rows(spark, sf, "il", "problem_id", "cycle_no", *cols, F.coalesce(F.col("iteration").try_cast("int"), F.lit(1000000)).alias("it"), where=where)


_KEYS, _ORDER = ["problem_id", "cycle_no"], ["it", "row_id"]


_W = f"PARTITION BY problem_id, cycle_no ORDER BY {_IT}, row_id"


@query(f"SELECT row_id, coalesce(list(action_name) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS history FROM @il@")
def win_history_last_k(spark, sf):
    return windows.with_last_k(_log(spark, sf, "action_name"), _KEYS, _ORDER, "action_name", "history").select("row_id", "history")


_STOP = "[" + ", ".join(f"'{w}'" for w in T.CAUSE_STOPWORDS) + "]"
_CAUSE = r"list_filter(list_distinct(regexp_extract_all(lower({0}), '\b[a-z_][a-z0-9_]{{2,}}\b')), lambda x: NOT list_contains(" + _STOP + ", x))"


@query(
    f"""WITH d AS (SELECT row_id, problem_id, cycle_no, {_IT} AS it, diagnosis, lag(diagnosis) OVER ({_W}) AS prev FROM @il@ WHERE diagnosis IS NOT NULL),
    s AS (SELECT *, {_CAUSE.format('diagnosis')} AS a, {_CAUSE.format("coalesce(prev, '')")} AS b FROM d)
    SELECT problem_id, cycle_no, row_id FROM s WHERE len(list_intersect(a, b)) >= 3 AND len(list_intersect(a, b)) / greatest(len(a), len(b), 1)::DOUBLE > 0.4
    QUALIFY row_number() OVER (PARTITION BY problem_id, cycle_no ORDER BY it, row_id) = 1"""
)
def win_oscillation(spark, sf):
    return windows.first_oscillation(_log(spark, sf, "diagnosis", where="diagnosis is not null"), _KEYS, _ORDER, "diagnosis").select("problem_id", "cycle_no", "row_id")


@query(f"SELECT row_id, round(CASE WHEN stddev_pop(r) OVER w > 1e-6 THEN (r - avg(r) OVER w) / (stddev_pop(r) OVER w + 1e-8) ELSE 0 END, 6) + 0.0 AS advantage FROM {_REWARD_SQL} WINDOW w AS (PARTITION BY problem_id, cycle_no)")
def win_group_norm(spark, sf):
    scaled = windows.group_normalised(_rewarded(spark, sf), _KEYS, "r", "advantage")
    return scaled.select("row_id", (F.round("advantage", 6) + F.lit(0.0)).alias("advantage"))


_LINES = r"CASE WHEN log = '' THEN [] ELSE regexp_split_to_array(regexp_replace(log, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') END"


@query(
    rf"""WITH l AS (SELECT result_id, {_LINES} AS ls FROM @rr@ WHERE log IS NOT NULL),
    h AS (SELECT result_id, ls, list_filter(range(1, len(ls) + 1), lambda i: contains(ls[i], 'AssertionError') OR (contains(lower(ls[i]), 'assert ') AND contains(ls[i], '=='))) AS hits FROM l)
    SELECT result_id, list_transform(list_slice(hits, 1, 4), lambda i: array_to_string(list_slice(ls, greatest(i - 2, 1), i + 2), chr(10))) AS contexts FROM h""",
    each=True,
)
def win_context_lines(spark, sf):
    return scan(spark, sf, "rr").filter("log is not null").select("result_id", T.context_lines(F.col("log")).alias("contexts"))


@query(f"SELECT row_id, last_value(CASE WHEN iverilog_pass THEN row_id END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_row FROM @il@")
def win_best_so_far(spark, sf):
    log = _log(spark, sf, "iverilog_pass").withColumn("own", F.col("row_id"))
    return windows.with_best_so_far(log, _KEYS, _ORDER, "own", "iverilog_pass", "best_row").select("row_id", "best_row")


@query(
    """WITH f AS (SELECT problem_id, min(cycle_no) AS c FROM @il@ WHERE action_name = 'saved' AND passed AND cycle_no IS NOT NULL GROUP BY 1), n AS (SELECT i.cycle_no, count(f.problem_id) AS n_new FROM (SELECT DISTINCT cycle_no FROM @il@ WHERE cycle_no IS NOT NULL) i LEFT JOIN f ON i.cycle_no = f.c GROUP BY 1)
    SELECT cycle_no, n_new, CAST(sum(n_new) OVER (ORDER BY cycle_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_solved FROM n"""
)
def win_first_success(spark, sf):
    il = scan(spark, sf, "il").filter("cycle_no is not null")
    first = windows.first_success(il, "problem_id", "cycle_no", (F.col("action_name") == "saved") & F.col("passed"))
    return windows.cumulative_solved(first, il, "cycle_no")


@query("SELECT problem_id, run_name, result_id FROM @rr@ QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY run_name, result_id) = 1")
def win_first_write(spark, sf):
    return joins.first_by_priority(scan(spark, sf, "rr").select("problem_id", "run_name", "result_id"), ["problem_id"], [F.col("run_name"), F.col("result_id")]).select("problem_id", "run_name", "result_id")


@query(f"SELECT problem_id, cycle_no, string_agg(action_name, '>' ORDER BY {_IT}, row_id) AS path FROM @il@ GROUP BY 1, 2")
def win_ordered_concat(spark, sf):
    return windows.ordered_concat(_log(spark, sf, "action_name"), _KEYS, _ORDER, "action_name", "path", ">")


@query(f"SELECT row_id, coalesce(last_value(CASE WHEN iverilog_pass THEN verilog_chars END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS kept_chars FROM @il@")
def win_stagewise_best(spark, sf):
    best = windows.with_best_so_far(_log(spark, sf, "iverilog_pass", "verilog_chars"), _KEYS, _ORDER, "verilog_chars", "iverilog_pass", "kept")
    return best.select("row_id", F.coalesce("kept", F.lit(0)).alias("kept_chars"))


# ------------------------------------------------------------------ sort, limit, sample


@query("SELECT item_id, problem_id FROM benchmark_problems ORDER BY problem_id")
def srt_key(spark, sf):
    return rows(spark, sf, "bp").select("item_id", "problem_id").orderBy("problem_id")


@query("SELECT sample_id FROM @ts@ ORDER BY sample_id LIMIT 500")
def lim_head(spark, sf):
    return scan(spark, sf, "ts").select("sample_id").distinct().orderBy("sample_id").limit(500)


@query("SELECT row_id, list_slice(failed_tests, 1, 3) AS tests FROM @il@ WHERE failed_tests IS NOT NULL", each=True)
def lim_array(spark, sf):
    return scan(spark, sf, "il").filter("failed_tests is not null").select("row_id", F.slice("failed_tests", 1, 3).alias("tests"))


_O = "md5(concat_ws(':', '42', {0}::VARCHAR))"


@query(f"SELECT doc_id FROM documents ORDER BY {_O.format('doc_id')}, doc_id LIMIT 100")
def smp_n(spark, sf):
    return sampling.sample_n(rows(spark, sf, "docs").select("doc_id"), "doc_id", 100)


@query(f"SELECT sample_id, row_number() OVER (ORDER BY {_O.format('sample_id')}, sample_id) - 1 AS no FROM @ts@")
def smp_shuffle(spark, sf):
    return sampling.shuffled_no(scan(spark, sf, "ts").select("sample_id").distinct(), "sample_id").select("sample_id", "no")


@query(f"SELECT sample_id, no < floor(n * 0.6::DOUBLE) AS in_head, no >= floor(n * 0.4::DOUBLE) AS in_tail FROM (SELECT sample_id, row_number() OVER (ORDER BY {_O.format('sample_id')}, sample_id) - 1 AS no, count(*) OVER () AS n FROM @ts@)")
def smp_overlap_slices(spark, sf):
    s = scan(spark, sf, "ts").select("sample_id").distinct()
    return sampling.overlapping_slices(s, "sample_id", s.count()).select("sample_id", "in_head", "in_tail")


_SHARES = {"spec_to_rtl": 0.65, "debugging": 0.175, "editing": 0.175}


@query(f"SELECT sample_id, task_type FROM @ts@ WHERE task_type IN ('spec_to_rtl', 'debugging', 'editing') QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY {_O.format('sample_id')}, sample_id) <= CASE task_type WHEN 'spec_to_rtl' THEN 260 ELSE 70 END")
def smp_mix(spark, sf):
    """The caps of a mix of 400 samples."""
    return sampling.mixed(rows(spark, sf, "ts", "task_type"), "task_type", "sample_id", 400, _SHARES).select("sample_id", "task_type")


@query(f"SELECT sample_id, CASE WHEN CAST('0x' || left({_O.format('sample_id')}, 6) AS BIGINT) % 100 < 5 THEN 'eval' ELSE 'train' END AS part FROM @ts@", each=True)
def smp_split(spark, sf):
    return scan(spark, sf, "ts").select("sample_id", sampling.split_name(F.col("sample_id")).alias("part"))


# ------------------------------------------------------------------ set operations


@query("SELECT sample_id, task_type, bug_type FROM @ts@ UNION ALL SELECT -item_id, 'seed', NULL FROM benchmark_problems")
def set_union_all(spark, sf):
    seeds = rows(spark, sf, "bp").select((-F.col("item_id")).alias("sample_id"), F.lit("seed").alias("task_type"))
    return seeds.unionByName(rows(spark, sf, "ts", "task_type", "bug_type"), allowMissingColumns=True)


_TOKD = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"


@query(f"SELECT row_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS n_both, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS n_any FROM (SELECT row_id, {_TOKD.format('diagnosis')} AS a, {_TOKD.format('fix_instruction')} AS b FROM @il@ WHERE diagnosis IS NOT NULL AND fix_instruction IS NOT NULL)", name="set_token_intersect_union", each=True)
def set_tokens(spark, sf):
    d = scan(spark, sf, "il").filter("diagnosis is not null and fix_instruction is not null")
    a, b = T.tokens(F.col("diagnosis")), T.tokens(F.col("fix_instruction"))
    return d.select("row_id", F.size(F.array_intersect(a, b)).cast("bigint").alias("n_both"), F.size(F.array_union(a, b)).cast("bigint").alias("n_any"))


@query(f"SELECT row_id, list_sort({_CAUSE.format('diagnosis')}) AS words FROM @il@ WHERE diagnosis IS NOT NULL", each=True)
def set_stopword_except(spark, sf):
    return scan(spark, sf, "il").filter("diagnosis is not null").select("row_id", F.array_sort(T.cause_words(F.col("diagnosis"))).alias("words"))


_P = "(SELECT DISTINCT problem_id FROM @il@ WHERE action_name = 'saved' AND passed AND cycle_no {0})"


@query(
    f"""SELECT problem_id, 'newly_solved' AS change FROM (SELECT * FROM {_P.format('> 5')} EXCEPT SELECT * FROM {_P.format('<= 5')}) UNION ALL
    SELECT problem_id, 'regressed' FROM (SELECT * FROM {_P.format('<= 5')} EXCEPT SELECT * FROM {_P.format('> 5')})""",
    name="set_newly_solved_regressed",
)
def set_changes(spark, sf):
    ok = scan(spark, sf, "il").filter("action_name = 'saved' and passed")
    old, new = ok.filter("cycle_no <= 5").select("problem_id"), ok.filter("cycle_no > 5").select("problem_id")
    return new.distinct().join(old, "problem_id", "left_anti").withColumn("change", F.lit("newly_solved")).unionByName(old.distinct().join(new, "problem_id", "left_anti").withColumn("change", F.lit("regressed")))


@query("SELECT row_id, list_filter(failed_tests, lambda v, i: list_position(failed_tests, v) = i) AS tests FROM @il@ WHERE failed_tests IS NOT NULL", each=True)
def set_dedupe_ordered(spark, sf):
    return scan(spark, sf, "il").filter("failed_tests is not null").select("row_id", F.array_distinct("failed_tests").alias("tests"))


@query("SELECT DISTINCT problem_id FROM @il@ WHERE action_name = 'saved' AND passed UNION SELECT problem_id FROM @rr@ WHERE test_result = 0")
def set_unique_solved(spark, sf):
    a = scan(spark, sf, "il").filter("action_name = 'saved' and passed").select("problem_id")
    return a.union(scan(spark, sf, "rr").filter("test_result = 0").select("problem_id")).distinct()


# ------------------------------------------------------------------ rounds


# Faults stand in for the tools that are absent: a text is the list of its faults, in the order in which they show.
#   s  does not compile            a-e  plain: a repair that names it removes it
#   x  only with a clarified task  k    only with the category of the error
#   r  only a new design or a full rewrite removes it
#   B  its repair gives 'b' and breaks the compilation
# The name of a fault is the start of every word of its diagnosis, so that equal faults are one cause.
FAULTS = ["", "a", "s", "sab", "x", "k", "r", "abcde", "B", "ar"]


def fault_steps() -> iterate.Steps:
    """Compiler, test and model as column expressions over the faults of a text."""
    first = lambda c: F.substring(c, 1, 1)
    named = F.substring("fix", 5, 1)

    def compiles(df):
        return df.withColumns({"ok_compile": ~F.col("new_text").contains("s"), "message": F.when(F.col("new_text").contains("s"), "line s")})

    def test(df):
        return df.withColumns({"ok_test": F.length("text") == 0, "message": F.concat(F.lit("line "), F.when(F.col("text").contains("s"), "s").otherwise(first("text")))})

    def reflect(df):
        f = F.right("message", F.lit(1))
        return df.withColumns({"diagnosis": F.concat(f, F.lit("aa_cause "), f, F.lit("bb_path "), f, F.lit("cc_state")), "fix": F.concat(F.lit("fix "), f)})

    def generate(df):
        name = F.when(F.col("fix").startswith("line"), F.substring("fix", 6, 1)).otherwise(named)
        can = F.when(name == "x", F.startswith("task", F.lit("clear"))).when(name == "k", F.col("category").isNotNull()).otherwise(name != "r")
        repaired = F.when(name == "B", F.replace("text", F.lit("B"), F.lit("bs"))).when(can, F.replace("text", name, F.lit(""))).otherwise(F.col("text"))
        return df.withColumn("new_text", F.when(F.col("mode").isin("reset", "fresh"), F.replace("text", F.lit("r"), F.lit(""))).otherwise(repaired))

    return iterate.Steps(
        compiles, test, reflect, generate,
        clarify=lambda df: df.withColumn("clarified", F.concat(F.lit("clear "), "task")),
        categorise=lambda df: df.withColumn("new_category", F.right("message", F.lit(1))),
        redesign=lambda df: df.withColumn("strategy", F.concat(F.lit("other than "), "message")),
        decide=lambda df: df.withColumn("restart", iterate._same_cause_twice()),
    )


def _rounds(policy):
    def run(spark, sf):
        faults = F.element_at(F.array(*[F.lit(x) for x in FAULTS]), (F.col("item_id") % len(FAULTS) + 1).cast("int"))
        keys = rows(spark, sf, "bp").select("item_id", F.col("prompt").alias("task"), faults.alias("text"))
        state, log = iterate.run_rounds(keys, "item_id", F.col("task"), F.col("text"), fault_steps(), iterate.POLICIES[policy])
        done = log.groupBy("key").agg(F.count("*").alias("n_rounds"))
        return state.join(done, "key", "left").select(
            F.col("key").alias("item_id"), "final_text", "compiled", "passed", "compile_no", "repair_no", "reset_done", "restarts", "category", F.coalesce("n_rounds", F.lit(0)).cast("bigint").alias("n_rounds")
        )

    return run


def rounds_sql(policy):
    """The same loop as a recursive query, a row per key and round."""
    p = iterate.POLICIES[policy]
    yes = lambda v: "true" if v else "false"
    texts = "[" + ", ".join(f"'{x}'" for x in FAULTS) + "]"
    removable = f"(f NOT IN ('x', 'k', 'r') OR (f = 'x' AND {yes(p.clarify)}) OR (f = 'k' AND c IS NOT NULL))"
    fresh = f"(phase = 'repair' AND rn IN ({', '.join(map(str, p.fresh_after)) or '-1'}))"
    # t: the text at the test; w: whether it passed; f: the fault that the round is about; again: a new design
    return f"""
WITH RECURSIVE st AS (
  SELECT item_id, v AS txt, v AS best, NOT contains(v, 's') AS comp, false AS passed, CASE WHEN contains(v, 's') AND {p.compile_rounds} > 0 THEN 'compile' ELSE 'repair' END AS phase,
    0 AS cn, 0 AS rn, NULL::VARCHAR AS cat, false AS rd, 0 AS rs, ''::VARCHAR AS h, NULL::VARCHAR AS fb, 0 AS n
  FROM (SELECT item_id, ({texts})[CAST(item_id % {len(FAULTS)} AS INTEGER) + 1] AS v FROM benchmark_problems)
  UNION ALL
  SELECT item_id, CASE WHEN phase = 'compile' THEN new WHEN w THEN t WHEN adopt THEN new ELSE t END,
    CASE WHEN w THEN t WHEN ok AND (phase = 'compile' OR NOT again) THEN new ELSE best1 END,
    CASE WHEN w THEN comp WHEN phase = 'compile' OR adopt THEN ok ELSE comp END, w,
    CASE WHEN w THEN 'done' WHEN phase = 'compile' THEN CASE WHEN ok THEN 'repair' WHEN cn + 1 >= {p.compile_rounds} THEN 'done' ELSE 'compile' END WHEN rn + 1 >= {p.repair_rounds} THEN 'done' ELSE 'repair' END,
    cn + CAST(phase = 'compile' AS INTEGER), rn + CAST(phase = 'repair' AS INTEGER), CASE WHEN again AND adopt THEN NULL WHEN phase = 'compile' THEN cat ELSE c END, rd OR again, rs + CAST(again AND {p.restarts} > 0 AS INTEGER),
    CASE WHEN phase = 'compile' OR w THEN h WHEN again THEN CASE WHEN adopt THEN '' ELSE h END ELSE right(h || {"f" if p.reflect else "'-'"}, 3) END, CASE WHEN phase = 'compile' THEN fb ELSE fb1 END, n + 1
  FROM (SELECT *, NOT contains(new, 's') AS ok, (NOT contains(new, 's') OR {yes(p.adopt_always)}) AS adopt FROM (
    SELECT *, CASE WHEN again THEN replace(t, 'r', '') WHEN f = 'B' THEN replace(t, 'B', 'bs') WHEN {removable} THEN replace(t, f, '') ELSE t END AS new FROM (
      SELECT *, CASE WHEN phase = 'compile' THEN cat WHEN {yes(p.categorise)} AND NOT w THEN coalesce(cat, f) ELSE cat END AS c,
        phase = 'repair' AND NOT w AND length(h) >= 2 AND lower(h[-1]) = lower(h[-2]) AND (({yes(p.reset)} AND NOT rd) OR rs < {p.restarts}) AS again FROM (
        SELECT *, phase = 'repair' AND t = '' AS w, CASE WHEN phase = 'compile' THEN 's' ELSE right(fb1, 1) END AS f FROM (
          SELECT *, CASE WHEN phase = 'compile' THEN fb WHEN {yes(p.refresh_feedback)} THEN said ELSE coalesce(fb, said) END AS fb1 FROM (
            SELECT *, CASE WHEN contains(t, 's') THEN 's' ELSE t[1] END AS said FROM (
              SELECT *, CASE WHEN {fresh} THEN replace(txt, 'r', '') ELSE txt END AS t, CASE WHEN {fresh} THEN replace(txt, 'r', '') ELSE best END AS best1 FROM st WHERE phase <> 'done')))))))
)
SELECT item_id, best AS final_text, comp AS compiled, passed, cn AS compile_no, rn AS repair_no, rd AS reset_done, rs AS restarts, cat AS category, CAST(n AS BIGINT) AS n_rounds
FROM st QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC) = 1"""


for _name, _policy in {"itr_repair_v11": "full", "itr_repair_v10": "plain", "itr_repair_cluster": "static_feedback", "itr_repair_v2": "single_step", "itr_loop_class": "class_loop", "itr_coordinate": "coordinated", "itr_fresh_start": "fresh_start"}.items():
    query(rounds_sql(_policy), name=_name)(_rounds(_policy))


@query("SELECT item_id, repair_no FROM (" + rounds_sql("full") + ") WHERE reset_done")
def itr_reset(spark, sf):
    """Problems whose loop was reset once because a diagnosis came back."""
    return _rounds("full")(spark, sf).filter("reset_done").select("item_id", "repair_no")


@query(
    """SELECT problem_id, CASE WHEN count(*) FILTER (test_result = 0) > 0 THEN arg_min(result_id, (finished_at, result_id)) FILTER (test_result = 0) ELSE max(result_id) END AS result_id FROM @rr@ GROUP BY 1"""
)
def itr_race(spark, sf):
    r = scan(spark, sf, "rr").select("problem_id", "result_id", F.struct("finished_at", "result_id").alias("done"), (F.col("test_result") == 0).alias("ok"))
    return iterate.race(r, "problem_id", "done", "ok", "result_id", "result_id").select("problem_id", "result_id")


@query("SELECT problem_id FROM benchmark_problems WHERE problem_id NOT IN (SELECT problem_id FROM @il@ WHERE action_name = 'saved' AND cycle_no = 11 AND problem_id IS NOT NULL)")
def itr_resume(spark, sf):
    """What is left of the last cycle."""
    return joins.not_done(rows(spark, sf, "bp").select("problem_id"), scan(spark, sf, "il").filter("action_name = 'saved' and cycle_no = 11").select("problem_id").distinct(), "problem_id")


@query("SELECT b.problem_id, coalesce(bool_or(r.test_result = 0), false) AS passed, floor(coalesce(CAST(sum(CAST(r.execution_s AS decimal(28,9))) AS DOUBLE), 0) * 1e6 + 0.5) / 1e6 AS elapsed_s FROM benchmark_problems b LEFT JOIN @rr@ r USING (problem_id) GROUP BY 1")
def itr_crash_row(spark, sf):
    """A problem without a result counts as failed in no time."""
    r = rows(spark, sf, "rr", "problem_id", "test_result", "execution_s").groupBy("problem_id").agg(F.bool_or(F.col("test_result") == 0).alias("passed"), F.sum(F.col("execution_s").cast(_DEC)).cast("double").alias("elapsed_s"))
    return rows(spark, sf, "bp").select("problem_id").join(r, "problem_id", "left").select("problem_id", F.coalesce("passed", F.lit(False)).alias("passed"), (F.floor(F.coalesce("elapsed_s", F.lit(0.0)) * 1e6 + 0.5) / 1e6).alias("elapsed_s"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 2 THEN NULL ELSE problem_id END AS answer FROM benchmark_problems")
def itr_retry(spark, sf):
    """Every second key needs a second try, every third fails three times and stays null."""
    from kilnspark.operators import adapters

    def make():
        seen: dict[str, int] = {}

        def step(x: str) -> str:
            n, _, name = x.partition("|")
            seen[x] = seen.get(x, 0) + 1
            if int(n) % 3 == 2 or (int(n) % 2 == 0 and seen[x] == 1):
                raise ValueError("not yet")
            return name

        return adapters.with_retries(step, tries=3, wait=0.0)

    b = rows(spark, sf, "bp").select("item_id", F.concat_ws("|", F.col("item_id").cast("string"), "problem_id").alias("x"))
    return adapters.apply_batch(b, F.col("x"), lambda xs: make()(xs), "answer").select("item_id", "answer")


# ------------------------------------------------------------------ the whole funnel


@query(
    f"""WITH g AS (SELECT doc_id, lang, text FROM documents WHERE length(text) > 50 AND length(text) < 3000), s AS ({_SIM_SQL.replace("@docs@", "true")})
    SELECT g.lang, count(*) AS n, count(*) FILTER (s.max_similarity < 0.3) AS n_clean, round(100.0 * count(*) FILTER (s.max_similarity < 0.3) / count(*), 6)::DOUBLE AS pct FROM g JOIN s USING (doc_id) GROUP BY 1"""
)
def corpus_funnel(spark, sf):
    """Flagship: size gate, similarity to the held-out problems, clean share by language."""
    d = rows(spark, sf, "docs").filter(filters.in_size(F.col("text"), word=None))
    s = joins.max_similarity(d, rows(spark, sf, "bp"), "doc_id", "text", "item_id", "prompt", ["lang"])
    clean = F.count_if(F.col("max_similarity") < 0.3)
    return s.groupBy("lang").agg(F.count("*").alias("n"), clean.alias("n_clean"), F.round(100.0 * clean / F.count("*"), 6).alias("pct"))
