"""Filters, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnspark.functions import text as T
from kilnspark.operators import adapters, builders, filters, rewards
from kilnspark.plans.base import query, rows, scan
from kilnspark.session import spread

ANSWERS_SQL = "(SELECT sample_id, pos, m.role AS role, m.content AS content FROM (SELECT sample_id, unnest(messages) AS m, generate_subscripts(messages, 1) AS pos FROM @ts@))"


def answers(spark, sf):
    """(sample_id, pos, content) of all assistant messages."""
    # patterns over whole answers: a table of a few splits is spread over the cores, a large one keeps its splits
    m = spread(scan(spark, sf, "ts").select("sample_id", "messages")).select("sample_id", F.posexplode("messages").alias("p", "m"))
    return m.filter("m.role = 'assistant'").select("sample_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.col("m.content").alias("content"))


def A(sql):
    return sql.replace("@answers@", f"(SELECT * FROM {ANSWERS_SQL} WHERE role = 'assistant')")


# ------------------------------------------------------------------ filters


@query("SELECT module_id FROM @rm@ WHERE regexp_matches(verilog, '[^@WS@]')", each=True)
def flt_nonblank(spark, sf):
    return scan(spark, sf, "rm").filter(~T.is_blank(F.col("verilog"))).select("module_id")


@query("SELECT module_id FROM @rm@ WHERE length(verilog) > 50 AND length(verilog) < 3000 AND contains(verilog, 'module')", each=True)
def flt_size(spark, sf):
    return scan(spark, sf, "rm").filter(filters.in_size(F.col("verilog"))).select("module_id")


_SIM_SQL = " OR ".join([f"contains(verilog, '{w}')" for w in T.SIM_TASKS + T.SIM_HEADERS] + [f"regexp_matches(verilog, '{p}')" for p in T.SIM_PATTERNS])


@query(f"SELECT module_id FROM @rm@ WHERE verilog IS NOT NULL AND NOT ({_SIM_SQL})", each=True)
def flt_synth(spark, sf):
    return scan(spark, sf, "rm").filter(filters.is_design(F.col("verilog"))).select("module_id")


_OK_SQL = r"regexp_matches(verilog, '\bmodule\b') AND regexp_matches(verilog, '\bendmodule\b') AND length(verilog) - length(replace(verilog, '(', '')) = length(verilog) - length(replace(verilog, ')', ''))"


def _checked(spark, sf, check, on_missing):
    return filters.validate(scan(spark, sf, "rm").select("module_id", "verilog"), "verilog", check, on_missing=on_missing).filter("valid").select("module_id")


@query(f"SELECT module_id FROM @rm@ WHERE {_OK_SQL}", each=True)
def flt_compile(spark, sf):
    return _checked(spark, sf, filters.balanced_module, "fail")


@query("SELECT module_id FROM @rm@", each=True)
def flt_lint(spark, sf):
    return _checked(spark, sf, None, "pass")  # the linter is missing: everything passes


@query("SELECT module_id, false AS valid FROM @rm@", each=True)
def flt_compile_eval(spark, sf):
    """The compiler is missing: every module is judged, and fails."""
    return filters.validate(scan(spark, sf, "rm").select("module_id", "verilog"), "verilog", None, on_missing="fail").select("module_id", "valid")


@query("SELECT module_id FROM @rm@", each=True)
def flt_compile_loop(spark, sf):
    return _checked(spark, sf, None, "pass")


@query("SELECT sample_id, quality_score FROM @ts@ WHERE quality_score >= 3", each=True)
def flt_min_score(spark, sf):
    return scan(spark, sf, "ts").filter("quality_score >= 3").select("sample_id", "quality_score")


_FENCE_SQL = r"regexp_replace(CASE WHEN regexp_matches(content, '(?s)```(?:verilog|systemverilog|sv)?\s*\n(.*?)```') THEN regexp_extract(content, '(?s)```(?:verilog|systemverilog|sv)?\s*\n(.*?)```', 1) ELSE content END, '^[@WS@]+|[@WS@]+$', '', 'g')"


@query(f"SELECT sample_id, task_type FROM (SELECT sample_id, task_type, {_FENCE_SQL} AS verilog FROM (SELECT sample_id, task_type, messages[2].content AS content FROM @ts@)) WHERE {_OK_SQL}", each=True)
def flt_final(spark, sf):
    """Samples whose second message holds code that the validator accepts."""
    s = scan(spark, sf, "ts").withColumn("code", T.fence(F.try_element_at("messages", F.lit(2))["content"])).select("sample_id", "task_type", "code")
    return filters.validate(s, "code", filters.balanced_module).filter("valid").select("sample_id", "task_type")


@query(
    """SELECT sample_id, CAST(len(regexp_extract_all(chat, '[\\p{L}\\p{N}_]+')) AS BIGINT) AS n_tokens
    FROM (SELECT sample_id, string_agg('<|' || role || '|>' || chr(10) || coalesce(content, '') || chr(10), '' ORDER BY pos) AS chat FROM """
    + ANSWERS_SQL
    + """ GROUP BY 1 HAVING count(*) FILTER (role IS NULL) = 0) WHERE len(regexp_extract_all(chat, '[\\p{L}\\p{N}_]+')) <= 200""",
    each=True,
)
def flt_token_len(spark, sf):
    """Rendered chats of at most 200 tokens, so that long ones are there to be dropped; no messages or a message without role make no chat."""
    m = F.col("messages")
    chat = F.when((F.size(m) > 0) & ~F.exists(m, lambda x: x.isNull() | x["role"].isNull()), builders.rendered(m))
    return filters.within_tokens(scan(spark, sf, "ts").select("sample_id", "messages"), chat, 200).select("sample_id", "n_tokens")


_REF_SQL = " OR ".join("contains(lower(content), '" + m.replace("'", "''") + "')" for m in T.REFUSAL_MARKERS)


@query(A(f"SELECT sample_id, pos FROM @answers@ WHERE {_REF_SQL}"), each=True)
def flt_refusal(spark, sf):
    return answers(spark, sf).filter(filters.is_refusal(F.col("content"))).select("sample_id", "pos")


_ASSERT_LINE = "(contains(l, 'AssertionError') OR (contains(lower(l), 'assert ') AND contains(l, '==')))"


@query(r"""SELECT result_id FROM @rr@ WHERE log IS NULL OR NOT (regexp_matches(log, '(?i)expected.*got|AssertionError') OR len(regexp_extract_all(log, '(?i)expected\s+([^\n,]{1,80}),?\s*got:?\s*([^\n]{1,80})')) > 0
   OR len(list_filter(regexp_split_to_array(log, '\r\n|\n|\r'), lambda l: """ + _ASSERT_LINE + ")) > 0)", each=True)
def flt_opaque(spark, sf):
    return scan(spark, sf, "rr").filter(filters.is_opaque(F.col("log"))).select("result_id")


@query(r"""SELECT result_id FROM @rr@ WHERE log IS NULL OR (len(regexp_extract_all(log, '(?i)expected\s+([^\n,]{1,80}),?\s*got:?\s*([^\n]{1,80})')) = 0 AND len(regexp_extract_all(log, 'FAILED\s+[\w./]+::(\w+)')) = 0
   AND length(regexp_replace(log, '^[@WS@]+|[@WS@]+$', '', 'g')) < 20)""", each=True)
def flt_short_error(spark, sf):
    return scan(spark, sf, "rr").filter(filters.is_short_error(F.col("log"))).select("result_id")


@query("SELECT row_id, problem_id FROM @il@ WHERE problem_id IN (SELECT problem_id FROM benchmark_problems WHERE list_contains(categories, 'easy'))")
def flt_key(spark, sf):
    keys = rows(spark, sf, "bp").filter(F.array_contains("categories", "easy")).select("problem_id")
    return rows(spark, sf, "il", "problem_id").join(keys, "problem_id", "left_semi").select("row_id", "problem_id")


@query(r"SELECT result_id FROM @rr@ WHERE test_result = 0 AND regexp_matches('1 passed ' || coalesce(log, ''), '\d+ passed') AND NOT regexp_matches('1 passed ' || coalesce(log, ''), '\d+ failed')", each=True)
def flt_pass_harness(spark, sf):
    out = F.concat(F.lit("1 passed "), F.coalesce("log", F.lit("")))
    return scan(spark, sf, "rr").filter(filters.harness_passed(F.col("test_result"), out)).select("result_id")


@query("SELECT result_id FROM @rr@ WHERE test_result = 0 AND error_msg IS NULL AND NOT coalesce(contains(log, 'FAILED'), false)", each=True)
def flt_pass_harness_v1(spark, sf):
    failures = F.col("error_msg").isNotNull().cast("int")
    return scan(spark, sf, "rr").filter(filters.harness_passed_strict(F.col("test_result"), F.col("log"), failures)).select("result_id")


# ------------------------------------------------------------------ projections

_CODE = "coalesce(verilog, '')"


def _mods(spark, sf):
    return scan(spark, sf, "rm").filter("verilog is not null").select("module_id", F.col("verilog").alias("c"), F.col("module_id").alias("seed"))


@query(r"""SELECT module_id, [{'role': 'user', 'content': 'Write synthesizable Verilog.' || chr(10) || chr(10) || '## Specification' || chr(10) || rtl_path}, {'role': 'assistant', 'content': '```verilog' || chr(10) || verilog || chr(10) || '```'}] AS messages, 'spec_to_rtl' AS task_type
   FROM @rm@ WHERE verilog IS NOT NULL""", each=True)
def prj_spec_to_rtl(spark, sf):
    m = scan(spark, sf, "rm").filter("verilog is not null")
    user = builders.sections("Write synthesizable Verilog.", ("Specification", F.col("rtl_path")))
    return m.select("module_id", builders.sample(user, builders.fenced(F.col("verilog"))).alias("messages"), F.lit("spec_to_rtl").alias("task_type"))


@query(r"""SELECT item_id, [{'role': 'user', 'content': prompt}, {'role': 'assistant', 'content': '```verilog' || chr(10) || harness_files['src/.env'] || chr(10) || '```'}] AS messages, CAST(5 AS INTEGER) AS quality_score, 'seed_pairs' AS source FROM benchmark_problems""")
def prj_seed(spark, sf):
    b = rows(spark, sf, "bp")
    return b.select("item_id", builders.sample(F.col("prompt"), builders.fenced(F.col("harness_files")["src/.env"])).alias("messages"), F.lit(5).alias("quality_score"), F.lit("seed_pairs").alias("source"))


@query(each=True)
def prj_debug(spark, sf):
    m = _mods(spark, sf).withColumn("fault", builders.chosen(builders.faults(F.col("c"), F.col("seed")), F.xxhash64("seed"))).filter("fault is not null")
    user = builders.sections("This Verilog has a fault, repair it.", ("Faulty code", builders.fenced(F.col("fault.code"))))
    return m.select("module_id", builders.sample(user, builders.fenced(F.col("c"))).alias("messages"), F.lit("debugging").alias("task_type"), F.col("fault.kind").alias("bug_type"))


@query(each=True)
def prj_edit(spark, sf):
    m = _mods(spark, sf).withColumn("mask", builders.masked(F.col("c"), F.col("seed"))).filter("mask is not null")
    user = builders.sections("Part of this Verilog is missing, write all of it.", ("Code so far", builders.fenced(F.col("mask.code"))))
    return m.select("module_id", builders.sample(user, builders.fenced(F.col("c"))).alias("messages"), F.lit("editing").alias("task_type"))


@query("SELECT module_id, regexp_replace(verilog, 'posedge', 'negedge') AS code FROM @rm@ WHERE contains(verilog, 'posedge')", each=True)
def prj_bug_posedge(spark, sf):
    return _mods(spark, sf).select("module_id", builders.flip_edge(F.col("c")).alias("code")).filter("code is not null")


@query(each=True)
def prj_bug_offbyone(spark, sf):
    return _mods(spark, sf).select("module_id", builders.off_by_one(F.col("c"), F.col("seed")).alias("code")).filter("code is not null")


@query(r"""SELECT module_id, h || CASE o WHEN '&' THEN '|' ELSE '&' END || substr(verilog, length(h) + 2) AS code FROM (SELECT module_id, verilog, left(verilog, strpos(verilog, a) - 1) || regexp_extract(a, '(?s)^(assign\s+\w+\s*=\s*[^;]+)[&|][^;]+;', 1) AS h,
   regexp_extract(a, '(?s)^assign\s+\w+\s*=\s*[^;]+([&|])[^;]+;', 1) AS o FROM (SELECT module_id, verilog, regexp_extract(verilog, '(?s)assign\s+\w+\s*=\s*[^;]+[&|][^;]+;') AS a FROM @rm@) WHERE a <> '')""", each=True)
def prj_bug_operator(spark, sf):
    return _mods(spark, sf).select("module_id", builders.swap_operator(F.col("c")).alias("code")).filter("code is not null")


@query(f"SELECT module_id, regexp_replace(verilog, '(?i){builders.RESET_BRANCH}', '') AS code FROM @rm@ WHERE regexp_matches(verilog, '(?i){builders.RESET_BRANCH}')", each=True)
def prj_bug_reset(spark, sf):
    return _mods(spark, sf).select("module_id", builders.drop_reset(F.col("c")).alias("code")).filter("code is not null")


@query(each=True)
def prj_bug_state(spark, sf):
    return _mods(spark, sf).select("module_id", builders.swap_states(F.col("c"), F.col("seed")).alias("code")).filter("code is not null")


@query(each=True)
def prj_bug_sens(spark, sf):
    return _mods(spark, sf).select("module_id", builders.drop_sensitivity(F.col("c"), F.col("seed")).alias("code")).filter("code is not null")


@query(each=True)
def prj_mask_always(spark, sf):
    return _mods(spark, sf).select("module_id", builders.mask_block(F.col("c")).alias("code")).filter("code is not null")


@query(each=True)
def prj_mask_assign(spark, sf):
    return _mods(spark, sf).select("module_id", builders.mask_assigns(F.col("c"), F.col("seed")).alias("code")).filter("code is not null")


@query(r"""SELECT module_id, regexp_replace(verilog, '(?s)(module\s+\w+[^;]+;)(.*?)(endmodule)', '\1' || chr(10) || chr(10) || '// TODO: implement module logic' || chr(10) || chr(10) || '\3') AS code
   FROM @rm@ WHERE length(regexp_replace(regexp_extract(verilog, '(?s)(module\s+\w+[^;]+;)(.*?)(endmodule)', 2), '^[@WS@]+|[@WS@]+$', '', 'g')) >= 50""", each=True)
def prj_mask_module(spark, sf):
    return _mods(spark, sf).select("module_id", builders.mask_module(F.col("c")).alias("code")).filter("code is not null")


@query("SELECT sample_id, string_agg('<|' || role || '|>' || chr(10) || coalesce(content, '') || chr(10), '' ORDER BY pos) AS chat FROM " + ANSWERS_SQL + " GROUP BY 1", each=True)
def prj_chat_render(spark, sf):
    return scan(spark, sf, "ts").filter(F.size("messages") > 0).select("sample_id", builders.rendered(F.col("messages")).alias("chat"))


_PROMPT_SQL = "concat_ws(chr(10) || chr(10), 'Repair the module.', CASE WHEN diagnosis IS NOT NULL THEN '## Diagnosis' || chr(10) || diagnosis END, CASE WHEN fix_instruction IS NOT NULL THEN '## Fix' || chr(10) || fix_instruction END)"


@query(f"SELECT row_id, {_PROMPT_SQL} AS prompt FROM @il@", each=True)
def prj_prompt_build(spark, sf):
    p = builders.sections("Repair the module.", ("Diagnosis", F.col("diagnosis")), ("Fix", F.col("fix_instruction")))
    return scan(spark, sf, "il").select("row_id", p.alias("prompt"))


@query(f"SELECT row_id, CASE WHEN try_cast(iteration AS INTEGER) > 1 THEN 'Earlier attempts failed.' || chr(10) || chr(10) || {_PROMPT_SQL} ELSE {_PROMPT_SQL} END AS prompt FROM @il@", each=True)
def prj_wrap_prompt(spark, sf):
    p = builders.sections("Repair the module.", ("Diagnosis", F.col("diagnosis")), ("Fix", F.col("fix_instruction")))
    again = F.col("iteration").try_cast("int") > 1
    return scan(spark, sf, "il").select("row_id", F.when(again, F.concat(F.lit("Earlier attempts failed.\n\n"), p)).otherwise(p).alias("prompt"))


@query(each=True)
def prj_error_block(spark, sf):
    return scan(spark, sf, "rr").filter("log is not null").select("result_id", builders.error_block(F.col("log")).alias("block"))


@query(each=True)
def prj_error_block_v2(spark, sf):
    return scan(spark, sf, "rr").filter("log is not null").select("result_id", builders.error_block_older(F.col("log"), "test").alias("block"))


_CODE_SQL = r"""regexp_replace(CASE WHEN regexp_matches(content, '(?is)```(?:verilog|systemverilog|sv)\n(.*?)```') THEN regexp_extract(content, '(?is)```(?:verilog|systemverilog|sv)\n(.*?)```', 1)
  WHEN regexp_matches(content, '(?is)```\n(.*?(?:module|endmodule).*?)```') THEN regexp_extract(content, '(?is)```\n(.*?(?:module|endmodule).*?)```', 1) @bare@ ELSE content END, '^[@WS@]+|[@WS@]+$', '', 'g')"""
_BARE_SQL = r"WHEN regexp_matches(content, '(?s)((?:^|\n)(?:`timescale\s+\S+|module\s+\w+).*?endmodule)') THEN regexp_extract(content, '(?s)((?:^|\n)(?:`timescale\s+\S+|module\s+\w+).*?endmodule)', 1)"
_SOFT_SQL = " OR ".join(f"contains(lower(e), '{m}')" for m in T.SOFT_MARKERS)
_HARD_SQL = " OR ".join(f"contains(lower(e), '{m}')" for m in T.HARD_MARKERS)


def _reward_sql(ok, soft):
    code = _CODE_SQL.replace("@bare@", _BARE_SQL)
    return A(
        f"""SELECT sample_id, pos, CAST(CASE WHEN content IS NULL OR {_REF_SQL} THEN 0.0 WHEN NOT (contains(code, 'module') AND contains(code, 'endmodule')) THEN 0.0 WHEN sample_id % 3 = 0 THEN {ok} WHEN {_HARD_SQL} THEN 0.0 WHEN {_SOFT_SQL} THEN {soft} ELSE 0.0 END AS DOUBLE) AS reward
        FROM (SELECT sample_id, pos, content, {code} AS code, CASE sample_id % 3 WHEN 1 THEN 'x.sv:3: error: Unknown port a' ELSE 'No such file or directory' END AS e FROM @answers@)"""
    )


def _reward(spark, sf, tested, soft):
    """Compiler results stand in for the absent tool: a third of the answers compiles, a third fails softly, a third hard."""
    m = F.col("sample_id") % 3
    msg = F.when(m == 1, "x.sv:3: error: Unknown port a").otherwise("No such file or directory")
    return answers(spark, sf).select("sample_id", "pos", rewards.tiered_reward(F.col("content"), m == 0, msg, tested, soft).alias("reward"))


@query(_reward_sql("1.0", "0.3"), each=True)
def prj_reward_v2(spark, sf):
    return _reward(spark, sf, None, 0.3)


@query(_reward_sql("CASE WHEN pos % 2 = 0 THEN 1.0 ELSE 0.5 END", "0.2"), each=True)
def prj_reward_v3(spark, sf):
    return _reward(spark, sf, F.col("pos") % 2 == 0, 0.2)


@query("SELECT row_id, coalesce(g.guidance, 'check the algorithm') AS guidance FROM @il@ i LEFT JOIN (VALUES ('reset_missing', 'check resets'), ('width_mismatch', 'check widths'), ('off_by_one', 'check bounds')) g(category, guidance) ON i.category = g.category WHERE i.category IS NOT NULL", each=True)
def prj_category_guidance(spark, sf):
    """A small lookup table by category with a default."""
    g = spark.createDataFrame([("reset_missing", "check resets"), ("width_mismatch", "check widths"), ("off_by_one", "check bounds")], "category string, guidance string")
    return scan(spark, sf, "il").filter("category is not null").join(F.broadcast(g), "category", "left").select("row_id", F.coalesce("guidance", F.lit("check the algorithm")).alias("guidance"))


@query("SELECT problem_id, round(sum(coalesce(gen_in_tok, 0)) / 1e6 * 3.0 + sum(coalesce(gen_out_tok, 0)) / 1e6 * 15.0, 6) AS cost FROM @il@ GROUP BY 1")
def prj_cost(spark, sf):
    g = rows(spark, sf, "il", "problem_id", "gen_in_tok", "gen_out_tok").groupBy("problem_id").agg(F.sum("gen_in_tok").alias("i"), F.sum("gen_out_tok").alias("o"))
    return g.select("problem_id", F.round(rewards.token_cost(F.col("i"), F.col("o"), 3.0, 15.0), 6).alias("cost"))


@query("SELECT cycle_no, round(CASE WHEN count(DISTINCT problem_id) > 0 THEN sum(coalesce(gen_in_tok, 0)) / 1e6 * (120.0::DOUBLE / count(DISTINCT problem_id)) ELSE 0 END, 6) AS projected FROM @il@ GROUP BY 1")
def prj_cost_extrapolate(spark, sf):
    g = rows(spark, sf, "il", "cycle_no", "problem_id", "gen_in_tok").groupBy("cycle_no").agg(F.sum("gen_in_tok").alias("i"), F.count_distinct("problem_id").alias("n"))
    return g.select("cycle_no", F.round(rewards.extrapolated(F.coalesce("i", F.lit(0)) / 1e6, F.col("n"), 120), 6).alias("projected"))


# ------------------------------------------------------------------ scalar functions


@query(r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def str_tokens(spark, sf):
    return rows(spark, sf, "docs").filter("text is not null").select("doc_id", F.size(T.tokens(F.col("text"))).cast("bigint").alias("n"))


_TOK = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"


@query(
    f"""SELECT row_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END, 6) AS s
    FROM (SELECT row_id, {_TOK.format("diagnosis")} AS a, {_TOK.format("fix_instruction")} AS b FROM @il@ WHERE diagnosis IS NOT NULL AND fix_instruction IS NOT NULL)""", each=True)
def str_jaccard(spark, sf):
    d = scan(spark, sf, "il").filter("diagnosis is not null and fix_instruction is not null")
    return d.select("row_id", F.round(T.jaccard(T.tokens(F.col("diagnosis")), T.tokens(F.col("fix_instruction"))), 6).alias("s"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.CAUSE_STOPWORDS) + "]"
_CAUSE = r"list_filter(list_distinct(regexp_extract_all(lower({0}), '\b[a-z_][a-z0-9_]{{2,}}\b')), lambda x: NOT list_contains(" + _STOP + ", x))"


@query(f"SELECT row_id, len(list_intersect(a, b)) >= 3 AND len(list_intersect(a, b)) / greatest(len(a), len(b), 1)::DOUBLE > 0.4 AS same FROM (SELECT row_id, {_CAUSE.format('diagnosis')} AS a, {_CAUSE.format('fix_instruction')} AS b FROM @il@ WHERE diagnosis IS NOT NULL AND fix_instruction IS NOT NULL)", each=True)
def str_overlap_ratio(spark, sf):
    d = scan(spark, sf, "il").filter("diagnosis is not null and fix_instruction is not null")
    return d.select("row_id", T.same_cause(F.col("diagnosis"), F.col("fix_instruction")).alias("same"))


@query("SELECT doc_id, CAST(length(regexp_replace(text, '^[@WS@]+|[@WS@]+$', '', 'g')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def str_strip(spark, sf):
    return rows(spark, sf, "docs").filter("text is not null").select("doc_id", F.length(T.strip(F.col("text"))).cast("bigint").alias("n"))


@query(A(r"""SELECT sample_id, pos, md5(regexp_replace(CASE WHEN regexp_matches(content, '(?s)```(?:verilog|systemverilog|sv)?\s*\n(.*?)```') THEN regexp_extract(content, '(?s)```(?:verilog|systemverilog|sv)?\s*\n(.*?)```', 1) ELSE content END, '^[@WS@]+|[@WS@]+$', '', 'g')) AS h
   FROM @answers@ WHERE content IS NOT NULL"""), each=True)
def str_fence_a(spark, sf):
    return answers(spark, sf).filter("content is not null").select("sample_id", "pos", F.md5(T.fence(F.col("content"))).alias("h"))


@query(A("SELECT sample_id, pos, md5(" + _CODE_SQL.replace("@bare@", "") + ") AS h FROM @answers@ WHERE content IS NOT NULL"), each=True)
def str_fence_b(spark, sf):
    return answers(spark, sf).filter("content is not null").select("sample_id", "pos", F.md5(T.code_of(F.col("content"))).alias("h"))


@query(A("SELECT sample_id, pos, md5(" + _CODE_SQL.replace("@bare@", _BARE_SQL) + ") AS h FROM @answers@ WHERE content IS NOT NULL"), each=True)
def str_fence_c(spark, sf):
    return answers(spark, sf).filter("content is not null").select("sample_id", "pos", F.md5(T.code_of(F.col("content"), bare=True)).alias("h"))


_PYT = "'FAILED src/t.py::test_' || result_id % 7 || chr(10) || 'FAILED src/u.py::test_' || result_id % 3 || chr(10) || coalesce(log, '')"


@query(rf"SELECT result_id, list_slice(list_filter(x, lambda v, i: list_position(x, v) = i), 1, 5) AS tests FROM (SELECT result_id, regexp_extract_all({_PYT}, 'FAILED\s+[\w./]+::(\w+)', 1) AS x FROM @rr@)", each=True)
def rx_failed_tests(spark, sf):
    """The logs have no such lines, so two are put before each."""
    r = F.col("result_id")
    log = F.concat(F.lit("FAILED src/t.py::test_"), (r % 7).cast("string"), F.lit("\nFAILED src/u.py::test_"), (r % 3).cast("string"), F.lit("\n"), F.coalesce("log", F.lit("")))
    return scan(spark, sf, "rr").select("result_id", T.failed_tests(log).alias("tests"))


_MIS = r"(?i)expected\s+([^\n,]{1,80}),?\s*got:?\s*([^\n]{1,80})"


@query(
    rf"""SELECT result_id, list_transform(list_slice(list_zip(regexp_extract_all(log, '{_MIS}', 1), regexp_extract_all(log, '{_MIS}', 2)), 1, 5),
       lambda p: {{'expected': regexp_replace(p[1], '^[@WS@]+|[@WS@]+$', '', 'g'), 'actual': regexp_replace(p[2], '^[@WS@]+|[@WS@]+$', '', 'g')}}) AS pairs FROM @rr@ WHERE log IS NOT NULL""", each=True)
def rx_mismatch(spark, sf):
    return scan(spark, sf, "rr").filter("log is not null").select("result_id", T.mismatches(F.col("log")).alias("pairs"))


@query(r"""SELECT result_id, CAST(len(list_filter(list_zip(regexp_extract_all(log, 'assert\s+(.+?)\s*==\s*(.+)', 1), regexp_extract_all(log, 'assert\s+(.+?)\s*==\s*(.+)', 2)),
   lambda p: regexp_replace(p[1], '^[@WS@]+|[@WS@]+$', '', 'g') <> regexp_replace(p[2], '^[@WS@]+|[@WS@]+$', '', 'g'))) AS BIGINT) AS n FROM @rr@ WHERE log IS NOT NULL""", each=True)
def rx_assert_eq(spark, sf):
    return scan(spark, sf, "rr").filter("log is not null").select("result_id", F.size(T.unequal_asserts(F.col("log"))).cast("bigint").alias("n"))


_CE = r"(\S+\.(?:sv|v)):(\d+):\s*(error|warning):\s*(.+)"


@query(
    rf"""SELECT result_id, list_slice(list_transform(regexp_extract_all(log, '{_CE}', 1), lambda x: string_split(x, '/')[-1]), 1, 5) AS files, list_slice(list_transform(regexp_extract_all(log, '{_CE}', 2), lambda x: CAST(x AS INTEGER)), 1, 5) AS lines,
    list_slice(regexp_extract_all(log, '{_CE}', 3), 1, 5) AS kinds FROM @rr@ WHERE log IS NOT NULL""", each=True)
def rx_compile_error(spark, sf):
    e = scan(spark, sf, "rr").filter("log is not null").select("result_id", T.compile_errors(F.col("log")).alias("e"))
    return e.select("result_id", F.col("e.file").alias("files"), F.col("e.line").alias("lines"), F.col("e.type").alias("kinds"))


_LINES = r"CASE WHEN log = '' THEN [] ELSE regexp_split_to_array(regexp_replace(log, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') END"


@query(
    rf"""SELECT result_id, CASE WHEN len(h) > 0 THEN array_to_string(list_transform(list_slice(h, 1, 5), lambda x: regexp_replace(x, '^[@WS@]+|[@WS@]+$', '', 'g')), chr(10)) ELSE left(log, 400) END AS text
    FROM (SELECT result_id, log, list_filter({_LINES}, lambda l: contains(lower(l), 'error') OR contains(lower(l), 'warning')) AS h FROM @rr@ WHERE log IS NOT NULL)""", each=True)
def rx_error_lines(spark, sf):
    return scan(spark, sf, "rr").filter("log is not null").select("result_id", T.error_lines(F.col("log")).alias("text"))


_TW = " OR ".join(f"contains(lower(l), '{w}')" for w in T.TIMING_WORDS)


@query(rf"SELECT result_id, list_transform(list_slice(list_filter({_LINES}, lambda l: contains(l, 'WARNING') AND ({_TW})), 1, 3), lambda x: regexp_replace(x, '^[@WS@]+|[@WS@]+$', '', 'g')) AS warnings FROM @rr@ WHERE log IS NOT NULL", each=True)
def rx_timing(spark, sf):
    return scan(spark, sf, "rr").filter("log is not null").select("result_id", T.timing_lines(F.col("log")).alias("warnings"))


@query("SELECT row_id, diagnosis, coalesce(fix_instruction, '') AS fix FROM @il@ WHERE regexp_matches(diagnosis, '[^@WS@]')".replace("SELECT row_id, diagnosis,", "SELECT row_id, regexp_replace(diagnosis, '^[@WS@]+|[@WS@]+$', '', 'g') AS diagnosis,").replace("coalesce(fix_instruction, '') AS fix", "regexp_replace(coalesce(fix_instruction, ''), '^[@WS@]+|[@WS@]+$', '', 'g') AS fix"), each=True)
def rx_sections(spark, sf):
    """A reply is put together from its two parts and taken apart again."""
    d = scan(spark, sf, "il").filter(~T.is_blank(F.col("diagnosis")))
    reply = F.concat(F.lit("## Diagnosis\n"), F.col("diagnosis"), F.lit("\n## Fix Instruction\n"), F.coalesce("fix_instruction", F.lit("")))
    return d.select("row_id", T.section(reply, "## Diagnosis", "## Fix").alias("diagnosis"), T.section(reply, "## Fix Instruction").alias("fix"))


@query("SELECT doc_id, try_cast(nullif(regexp_extract(text, '([1-5])', 1), '') AS INTEGER) AS score FROM documents WHERE text IS NOT NULL")
def rx_score(spark, sf):
    return rows(spark, sf, "docs").filter("text is not null").select("doc_id", T.score_of(F.col("text")).alias("score"))


@query("SELECT doc_id, left(text, 80) AS head, right(text, 80) AS tail FROM documents WHERE text IS NOT NULL", name="str_left_right")
def str_left_right(spark, sf):
    return rows(spark, sf, "docs").filter("text is not null").select("doc_id", F.left("text", F.lit(80)).alias("head"), F.right("text", F.lit(80)).alias("tail"))


@query(rf"SELECT result_id, CAST(len({_LINES}) AS BIGINT) AS n_lines, array_to_string(list_slice({_LINES}, 1, 80), chr(10)) AS head FROM @rr@ WHERE log IS NOT NULL", each=True)
def str_lines(spark, sf):
    ls = T.lines(F.col("log"))
    return scan(spark, sf, "rr").filter("log is not null").select("result_id", F.size(ls).cast("bigint").alias("n_lines"), F.array_join(F.slice(ls, 1, 80), "\n").alias("head"))


@query(r"SELECT item_id, regexp_replace(problem_id, '_[^_]*$', '') AS base, coalesce(try_cast(nullif(regexp_extract(problem_id, '_([0-9]+)$', 1), '') AS INTEGER), 1) AS num FROM benchmark_problems")
def str_key_split(spark, sf):
    return rows(spark, sf, "bp").select("item_id", T.key_base(F.col("problem_id")).alias("base"), T.key_number(F.col("problem_id")).alias("num"))


@query("SELECT module_id, string_split(rtl_path, '/')[-1] AS leaf FROM @rm@", each=True)
def str_basename(spark, sf):
    return scan(spark, sf, "rm").select("module_id", T.basename(F.col("rtl_path")).alias("leaf"))


@query(r"SELECT item_id, trim(split_part(list_filter(string_split(harness_files['src/.env'], chr(10)), lambda l: starts_with(l, 'TOPLEVEL') AND NOT contains(l, 'LANG'))[1], '=', 2)) AS top FROM benchmark_problems")
def str_toplevel(spark, sf):
    return rows(spark, sf, "bp").select("item_id", T.toplevel(F.col("harness_files")["src/.env"]).alias("top"))


@query("""SELECT item_id, '{"id": "' || problem_id || '", "n": ' || item_id || '}' AS fixed FROM benchmark_problems""")
def str_json_repair(spark, sf):
    broken = F.concat(F.lit("{id: "), F.col("problem_id"), F.lit(', "n": '), F.col("item_id").cast("string"), F.lit("}"))
    return rows(spark, sf, "bp").select("item_id", T.quote_json_words(broken).alias("fixed"))


@query("SELECT item_id, left(harness_files[list_filter(map_keys(harness_files), lambda k: k LIKE 'src/test_%.py' AND NOT contains(k, 'runner'))[1]], 3000) AS test FROM benchmark_problems")
def map_pick(spark, sf):
    return rows(spark, sf, "bp").select("item_id", T.pick_test(F.col("harness_files")).alias("test"))


@query("SELECT result_id, round_even(execution_s, 1) AS s FROM @rr@", each=True)
def num_round(spark, sf):
    """Half to even, as Python rounds."""
    return scan(spark, sf, "rr").select("result_id", F.bround("execution_s", 1).alias("s"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_parse(spark, sf):
    from kilnspark.sources.tables import table

    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT item_id, '{"item_id":' || item_id || ',"problem_id":"' || problem_id || '"}' AS j FROM benchmark_problems""")
def json_dump(spark, sf):
    return rows(spark, sf, "bp").select("item_id", F.to_json(F.struct("item_id", "problem_id")).alias("j"))


@query("SELECT item_id, true AS ok FROM benchmark_problems")
def now_uuid(spark, sf):
    return rows(spark, sf, "bp").select("item_id", (F.length(F.uuid()) == 36).alias("ok")).filter(F.current_timestamp().isNotNull())


# ------------------------------------------------------------------ extension points


@query("SELECT item_id, upper(regexp_replace(prompt, '^[@WS@]+|[@WS@]+$', '', 'g')) AS direct_text, true AS ok FROM benchmark_problems")
def udf_model(spark, sf):
    """A batch model behind retries, its answer as a text under one name and whether it succeeded; here one that repeats its whole prompt in capitals."""
    model = adapters.with_retries(lambda p: p.strip().upper(), wait=0.0)
    return adapters.apply_direct(rows(spark, sf, "bp").select("item_id", "prompt"), F.col("prompt"), model).select("item_id", "answer.direct_text", "ok")


_WORDS_SQL = "len(regexp_extract_all({0}, '[^@WS@]+'))"
_SCORE_SQL = "CASE WHEN regexp_matches({0}, '[^@WS@]') THEN least(5, 1 + " + _WORDS_SQL + " // 12) END"


@query(f"SELECT item_id, CAST({_SCORE_SQL.format('prompt')} AS DOUBLE) AS score FROM benchmark_problems")
def udf_factory(spark, sf):
    judge = adapters.create("kilnspark.operators.adapters:length_judge")
    return adapters.apply_batch(rows(spark, sf, "bp").select("item_id", "prompt"), F.col("prompt"), judge, "score", "double").select("item_id", "score")


@query("SELECT p.item_id, coalesce(max(r.error_msg), '') AS answer FROM benchmark_problems p LEFT JOIN @rr@ r ON p.problem_id = r.problem_id GROUP BY 1")
def udf_replay(spark, sf):
    rec = rows(spark, sf, "rr", "problem_id", "error_msg").groupBy("problem_id").agg(F.max("error_msg").alias("answer"))
    return adapters.replay(rows(spark, sf, "bp").select("item_id", "problem_id"), rec, "problem_id", "answer").select("item_id", "answer")


@query(f"SELECT module_id, CAST({_SCORE_SQL.format('verilog')} AS INTEGER) AS score FROM @rm@", each=True)
def udf_judge(spark, sf):
    m = scan(spark, sf, "rm").select("module_id", "verilog")
    return adapters.apply_batch(m, F.col("verilog"), adapters.create("length_judge"), "score", "double").select("module_id", F.col("score").cast("int").alias("score"))


_COUNT_SQL = "(length(verilog) - length(replace(verilog, '{0}', ''))) // {1}"


@query(
    f"""SELECT module_id, 'Module ' || name || ' with ' || {_COUNT_SQL.format('input', 5)} || ' inputs and ' || {_COUNT_SQL.format('output', 6)} || ' outputs.' AS spec
    FROM (SELECT module_id, verilog, regexp_extract(split_part(substr(verilog, strpos(verilog, 'module ') + 7), '(', 1), '[^@WS@]+') AS name FROM @rm@ WHERE contains(verilog, 'module ')) WHERE name <> ''""",
    each=True,
)
def udf_generate(spark, sf):
    m = scan(spark, sf, "rm").select("module_id", "verilog")
    return adapters.apply_batch(m, F.col("verilog"), adapters.create("headline_writer"), "spec").select("module_id", "spec").filter("spec is not null")


_STEP_IN = "coalesce(diagnosis, '')"
_SPACED = "regexp_replace(regexp_replace({0}, '[@WS@]+', ' ', 'g'), '^ | $', '', 'g')"


@query(
    f"""SELECT row_id, {_SPACED.format(_STEP_IN)} AS clarified, CASE WHEN contains(lower({_STEP_IN}), 'reset') THEN 'reset' WHEN contains(lower({_STEP_IN}), 'width') THEN 'width' ELSE 'other' END AS category,
    'The cause is: ' || {_SPACED.format(_STEP_IN)} AS diagnosis, CASE WHEN {_WORDS_SQL.format(_STEP_IN)} = 0 THEN 'start anew' ELSE 'avoid ' || regexp_extract({_STEP_IN}, '[^@WS@]+') END AS strategy,
    CAST({_WORDS_SQL.format(_STEP_IN)} AS BIGINT) AS in_tok FROM @il@""",
    each=True,
)
def udf_llm_steps(spark, sf):
    """Clarify, categorise, reflect and redesign: each a struct of the answer and its token counts, with a fallback where the model fails."""
    d = scan(spark, sf, "il").select("row_id", F.coalesce("diagnosis", F.lit("")).alias("d"))
    words = lambda t: " ".join(t.split())
    category = lambda t: next((k for k in ("reset", "width") if k in t.lower()), "other")
    first = lambda t: "avoid " + t.split()[0]  # noqa: E731  fails without a word, so the fallback answers
    steps = {"clarify": (words, ""), "categorise": (category, "other"), "reflect": (lambda t: "The cause is: " + words(t), ""), "redesign": (first, "start anew")}
    a = adapters.apply_steps(d, F.col("d"), steps)
    return a.select("row_id", F.col("clarify.text").alias("clarified"), F.col("categorise.text").alias("category"), F.col("reflect.text").alias("diagnosis"), F.col("redesign.text").alias("strategy"), F.col("clarify.in_tok").alias("in_tok"))


@query(each=True)
def udf_bug_list(spark, sf):
    return _mods(spark, sf).select("module_id", F.transform(builders.faults(F.col("c"), F.col("seed")), lambda f: f["kind"]).alias("kinds"))


@query(each=True)
def udf_mask_list(spark, sf):
    return _mods(spark, sf).select("module_id", builders.masked(F.col("c"), F.col("seed"))["kind"].alias("kind"))


@query("SELECT result_id, CASE WHEN log IS NULL THEN NULL ELSE test_result = 0 END AS passed FROM @rr@", each=True)
def udf_sim(spark, sf):
    """True, false, or null where the simulator left no output; recorded runs stand in for it."""
    return scan(spark, sf, "rr").select("result_id", F.when(F.col("log").isNotNull(), F.col("test_result") == 0).alias("passed"))
