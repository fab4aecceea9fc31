"""Bounded repair rounds over a state table.

The state has one row per key: the task, the current text, the best text so far,
counters, flags and the last entries of its history.  A round asks the steps
(models, compiler, tests: see :class:`Steps`) about the active keys and moves
every key at once; the driver only loops over rounds and stops when no key is
active.  What was done is appended to a log of its own, a row per key and round,
so a key's row does not grow.

Two checkpoints are written a round, after the tests and after the moves, so
that no step is asked twice and executors may be lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions import text as T
from kilnspark.session import cut

Step = Callable[[DataFrame], DataFrame]
HISTORY = 3  # entries of the history that a key keeps


@dataclass(frozen=True)
class Steps:
    """What the loop asks.  A step gets a frame of states (with ``new_text`` where it is about one) and adds its columns; null stands for an answer that failed."""

    compiles: Step  # of ``new_text``: ok_compile, message
    test: Step  # of ``text``: ok_test, message
    reflect: Step  # of text, message, history, category: diagnosis, fix
    generate: Step  # of task, text, diagnosis, fix, strategy and mode ('compile', 'repair', 'reset', 'fresh'): new_text
    clarify: Step | None = None  # of task: clarified
    categorise: Step | None = None  # of text, message: new_category
    redesign: Step | None = None  # of text, message, history: strategy
    decide: Step | None = None  # of history: restart


@dataclass(frozen=True)
class Policy:
    """What a variant of the loop does; the names of the variants are in :data:`POLICIES`."""

    compile_rounds: int = 3
    repair_rounds: int = 4
    clarify: bool = True  # a clarified task before the first round
    categorise: bool = True  # a category of the first error guides the repairs
    reflect: bool = True  # a diagnosis comes before each repair
    reset: bool = True  # once per key, when the last two diagnoses name one cause
    fresh_after: tuple[int, ...] = ()  # rounds after which a full rewrite is asked for
    refresh_feedback: bool = True  # else the first test's message serves all rounds
    adopt_always: bool = False  # else a text that does not compile is dropped
    restarts: int = 0  # rounds that may start anew, each of which still counts


_OLDER = Policy(clarify=False, categorise=False, reset=False)
POLICIES = {
    "full": Policy(),
    "plain": _OLDER,
    "static_feedback": Policy(refresh_feedback=False),
    "single_step": replace(_OLDER, compile_rounds=0, reflect=False),
    "class_loop": replace(_OLDER, compile_rounds=0, repair_rounds=5, adopt_always=True),
    "coordinated": replace(_OLDER, compile_rounds=0, repair_rounds=5, adopt_always=True, restarts=3),
    "fresh_start": replace(_OLDER, repair_rounds=7, fresh_after=(3, 6)),
}

STATE = "key task text best compiled passed phase compile_no repair_no category reset_done restarts history feedback message".split()
LOG = "key round action ok_compile passed category diagnosis".split()
_ENTRY = "array<struct<diagnosis:string,fix:string>>"


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _with(df: DataFrame, **cols: Column) -> DataFrame:
    return df.withColumns(cols)


def start_state(keys: DataFrame, key: str, task: Column, text: Column, steps: Steps, policy: Policy) -> DataFrame:
    """The state before the first round: the task clarified, the given text compiled; a null text has to be written first."""
    first = keys.select(F.col(key).alias("key"), task.alias("task"), text.alias("text"))
    if policy.clarify and steps.clarify is not None:
        first = _with(steps.clarify(first), task=F.coalesce("clarified", "task")).drop("clarified")
    checked = steps.compiles(_with(first, new_text=F.col("text"))).drop("new_text")
    ok = _yes("ok_compile")
    phase = F.when(ok | F.lit(policy.compile_rounds == 0), "repair").otherwise("compile")
    return _with(
        checked, best=F.col("text"), compiled=ok, passed=F.lit(False), phase=phase, compile_no=F.lit(0), repair_no=F.lit(0), category=_null(), reset_done=F.lit(False), restarts=F.lit(0), history=F.array().cast(_ENTRY), feedback=_null(),
    ).select(*STATE)


def _same_cause_twice() -> Column:
    n = F.size("history")
    return (n >= 2) & T.same_cause(F.try_element_at("history", F.lit(-1))["diagnosis"], F.try_element_at("history", F.lit(-2))["diagnosis"])


def _written(df: DataFrame, mode: str, steps: Steps) -> DataFrame:
    """A new text in the given mode, and whether it compiles; a text that could not be written leaves the old one."""
    blank = {c: _null() for c in ("diagnosis", "fix", "strategy") if c not in df.columns}
    made = steps.generate(_with(df, mode=F.lit(mode), **blank))
    made = _with(made, new_text=F.coalesce("new_text", "text"), before=F.col("message")).drop("message")
    return _with(steps.compiles(made), ok_compile=_yes("ok_compile"))


def _compile_round(active: DataFrame, steps: Steps, policy: Policy) -> DataFrame:
    """Texts that do not compile: diagnosed, rewritten, compiled; the new text stays in either case."""
    asked = steps.reflect(_with(active, category=F.lit("compile_error"))).drop("category") if policy.reflect else active
    w = _written(_with(asked, category=_null()), "compile", steps)
    ok, n = F.col("ok_compile"), F.col("compile_no") + 1
    phase = F.when(ok, "repair").when(n >= policy.compile_rounds, "done").otherwise("compile")
    return _with(w, text=F.col("new_text"), best=F.when(ok, F.col("new_text")).otherwise(F.col("best")), compiled=ok, compile_no=n, phase=phase, action=F.lit("compile_repair"))


def _tested(active: DataFrame, steps: Steps, policy: Policy) -> DataFrame:
    """Texts under repair: a full rewrite where the policy asks for one, then the test."""
    if policy.fresh_after:
        due = F.col("repair_no").isin(*policy.fresh_after)
        w = _written(active.filter(due), "fresh", steps)
        fresh = _with(w, text=F.when(F.col("ok_compile"), F.col("new_text")).otherwise(F.col("text")), best=F.when(F.col("ok_compile"), F.col("new_text")).otherwise(F.col("best")), message=F.col("before"))
        active = active.filter(~due).unionByName(fresh.select(*STATE))
    t = _with(steps.test(active.drop("message")), passed=_yes("ok_test"))
    said = F.col("message") if policy.refresh_feedback else F.coalesce("feedback", "message")
    t = _with(t, feedback=said, message=said)
    if policy.categorise and steps.categorise is not None:
        open_ = ~F.col("passed") & F.col("category").isNull()
        c = _with(steps.categorise(t.filter(open_)), category=F.col("new_category"))
        t = t.filter(~open_).select(*STATE).unionByName(c.select(*STATE))
    again = F.lit(False)
    if policy.reset:
        again = ~F.col("reset_done") & _same_cause_twice()
    if policy.restarts and steps.decide is not None:
        t = steps.decide(t)
        again = _yes("restart") & (F.col("restarts") < policy.restarts)
    mode = F.when(F.col("passed"), "passed").when(again, "reset").otherwise("repair")
    return _with(t, mode=mode).select(*STATE, "mode")


def _repair_round(seen: DataFrame, steps: Steps, policy: Policy) -> DataFrame:
    """Tested texts: those that passed are done, the others are rewritten, after a diagnosis or by a new design."""
    n = F.col("repair_no") + 1
    over = F.when(n >= policy.repair_rounds, "done").otherwise("repair")
    won = _with(seen.filter("mode = 'passed'"), best=F.col("text"), repair_no=n, phase=F.lit("done"), action=F.lit("passed"), ok_compile=F.lit(True), diagnosis=_null())

    anew = seen.filter("mode = 'reset'")
    w = _written(steps.redesign(anew) if steps.redesign is not None else anew, "reset", steps)
    ok = F.col("ok_compile") | F.lit(policy.adopt_always)
    reset = _with(
        w, text=F.when(ok, F.col("new_text")).otherwise(F.col("text")), history=F.when(ok, F.array().cast(_ENTRY)).otherwise(F.col("history")), category=F.when(ok, _null()).otherwise(F.col("category")),
        compiled=F.when(ok, F.col("ok_compile")).otherwise(F.col("compiled")), reset_done=F.lit(True), restarts=F.col("restarts") + F.lit(int(policy.restarts > 0)), repair_no=n, phase=over, action=F.lit("reset"), diagnosis=_null(), message=F.col("before"),
    )

    failed = seen.filter("mode = 'repair'")
    asked = steps.reflect(failed) if policy.reflect else _with(failed, diagnosis=_null(), fix=F.col("message"))
    w = _written(asked, "repair", steps)
    entry = F.array(F.struct("diagnosis", "fix"))
    kept = F.slice(F.concat("history", entry), F.greatest(F.size("history") + 2 - HISTORY, F.lit(1)), HISTORY)
    repaired = _with(
        w, text=F.when(ok, F.col("new_text")).otherwise(F.col("text")), best=F.when(F.col("ok_compile"), F.col("new_text")).otherwise(F.col("best")), compiled=F.when(ok, F.col("ok_compile")).otherwise(F.col("compiled")),
        history=kept, repair_no=n, phase=over, action=F.lit("repair"), message=F.col("before"),
    )
    cols = [*STATE, "action", "ok_compile", "diagnosis"]
    return won.select(*cols).unionByName(reset.select(*cols)).unionByName(repaired.select(*cols))


def run_rounds(keys: DataFrame, key: str, task: Column, text: Column, steps: Steps, policy: Policy = POLICIES["full"]) -> tuple[DataFrame, DataFrame]:
    """(state after all rounds with ``final_text``, log of a row per key and round)."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = cut(start_state(keys, key, task, text, steps, policy).repartition(parts, "key"))
    logs = []
    for no in range(1, policy.compile_rounds + policy.repair_rounds + 1):
        if state.filter("phase <> 'done'").isEmpty():
            break
        seen = cut(_tested(state.filter("phase = 'repair'"), steps, policy))
        moved = _repair_round(seen, steps, policy)
        if policy.compile_rounds:
            extra = ["action", "ok_compile", "diagnosis"]
            c = _compile_round(state.filter("phase = 'compile'"), steps, policy)
            c = c if "diagnosis" in c.columns else _with(c, diagnosis=_null())
            moved = moved.unionByName(c.select(*STATE, *extra))
        # a union adds up partitions, so each round goes back to the same number
        moved = cut(moved.repartition(parts, "key"))
        logs.append(moved.select("key", F.lit(no).alias("round"), "action", "ok_compile", "passed", "category", "diagnosis"))
        state = state.filter("phase = 'done'").unionByName(moved.select(*STATE)).coalesce(parts)
    log = logs[0] if logs else state.limit(0).select("key", F.lit(0).alias("round"), F.lit("").alias("action"), F.col("compiled").alias("ok_compile"), "passed", "category", _null().alias("diagnosis"))
    for x in logs[1:]:
        log = log.unionByName(x)
    return state.withColumn("final_text", F.coalesce("best", "text")), log.select(*LOG)


def race(replicas: DataFrame, key: str, finished: str, passed: str, submitted: str, value: str) -> DataFrame:
    """Of each key's replicas the first to pass; if none passes, the last one submitted."""
    won = F.min_by(F.struct(value, passed), F.when(F.col(passed), F.col(finished)))
    first = F.min(F.when(F.col(passed), F.col(finished)))
    last = F.max_by(F.struct(value, passed), F.col(submitted))
    return replicas.groupBy(key).agg(F.when(first.isNotNull(), won).otherwise(last).alias("r")).select(key, "r.*")
