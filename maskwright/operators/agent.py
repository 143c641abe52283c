"""Routing, rule planning, policy and reply handling as ordered CASE expressions over per-scope aggregates."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import HANDLE, bounded, confirm_text, guarded, is_handle, looks_like_pii, name_score, planner_score
from .labels import allowed_sink

# Verbs of the router and the planner, and verbs that can't be undone.
CLICK = "(click|press|tap|hit|choose|select|open|go to|submit|save|sign ?in|log ?in|continue|next|apply|send|search|download|upload|add|edit|create)"
SCROLL = "(scroll|page down|page up)"
CLEAR = "(clear|empty|reset|remove|delete|wipe|erase|blank)"
FILL = "(fill|complete|populate|autofill)"
WANTS_FILL = "(fill|enter|type|complete|apply|sign ?in|log ?in|register|submit|form)"
QUESTION = "(what|which|how many|is there|does|find|tell me|show me|read)"
IRREVERSIBLE = "(pay|payment|purchase|buy|order|checkout|confirm|delete|remove|cancel|send|submit|apply|transfer|withdraw|book|subscribe)"
STEP_CAP, WITH_VERB, BARE, MARGIN = 25, 0.60, 0.85, 0.25


def says(text: Column, words: str) -> Column:
    return text.rlike("(?i)" + bounded(words))


def actionable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("enabled") & (F.col("visible") | F.col("offscreen")))


def clickable(df: DataFrame) -> DataFrame:
    return actionable(df).filter(F.col("role").isin("button", "link"))


def route(tasks: DataFrame, elements: DataFrame) -> DataFrame:
    """(scope, task, step) with elements: scope, route, kind, target, confidence."""
    quoted = F.lower(F.trim(F.regexp_extract("task", "[\"'“]([^\"'”]{2,40})[\"'”]", 1)))
    controls = clickable(elements).select("scope", "id", "ord", "name")
    met = tasks.withColumn("quoted", quoted).join(controls, "scope")
    name = F.lower(F.trim("name"))
    verb = says(F.col("task"), CLICK) | says(F.col("task"), CLEAR)
    need = F.when(verb, WITH_VERB).otherwise(BARE)
    scored = met.withColumn("s", name_score(F.col("task"), F.col("name"))).withColumn("exact", (F.col("quoted") != "") & (name == F.col("quoted"))).withColumn("partial", (F.col("quoted") != "") & F.contains(F.lower("name"), F.col("quoted")))
    ranked = F.row_number().over(Window.partitionBy("scope").orderBy(F.when(F.col("s") >= need, F.col("s")).otherwise(-1.0).desc(), "ord"))
    best = scored.withColumn("fits", F.col("s") >= need).withColumn("r", ranked).groupBy("scope").agg(
        F.count_if("exact").alias("n_exact"), F.min(F.when(F.col("exact"), F.struct("ord", "id")))["id"].alias("exact_id"),
        F.count_if("partial").alias("n_partial"), F.min(F.when(F.col("partial"), F.struct("ord", "id")))["id"].alias("partial_id"),
        F.count_if("fits").alias("n"), F.max(F.when(F.col("fits") & (F.col("r") == 1), F.col("id"))).alias("top_id"),
        F.max(F.when(F.col("fits") & (F.col("r") == 1), F.col("s"))).alias("top"), F.max(F.when(F.col("fits") & (F.col("r") == 2), F.col("s"))).alias("second"),
    )
    t = F.col("task")
    out = lambda way, kind=None, target=None, confidence=None: F.struct(F.lit(way).alias("route"), F.lit(kind).cast("string").alias("kind"), (F.lit(None) if target is None else target).cast("string").alias("target"), (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"))
    clear = says(t, CLEAR) & ~says(t, CLICK)
    decision = (
        F.when(F.trim(t) == "", out("done")).when((F.col("step") == 0) & says(t, SCROLL) & ~says(t, CLICK), out("local", "scroll", None, F.lit(0.99)))
        .when(clear & (F.col("step") == 0), out("local", "clear", None, F.lit(0.99))).when(clear, out("done"))
        .when((says(t, FILL) | t.rlike("(?i)enter my")) & ~t.rlike(r"(?i)^\s*" + bounded("(click|press|tap|hit)")), out("server"))
        .when(F.col("n_exact") == 1, out("local", "click", F.col("exact_id"), F.lit(0.97))).when(F.col("n_partial") == 1, out("local", "click", F.col("partial_id"), F.lit(0.90)))
        .when((F.col("n") == 1) | ((F.col("n") > 1) & (F.col("top") - F.col("second") >= MARGIN)), out("local", "click", F.col("top_id"), F.least(F.lit(0.95), 0.6 + F.col("top") * 0.35))).otherwise(out("server"))
    )
    return tasks.join(best, "scope", "left").select("scope", "task", decision.alias("d")).select("scope", "task", "d.*")


def answer(elements: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """scope, n_elements, n_handles, kinds, n_secret, n_regions, cite: what a question about a scope is answered from."""
    holds = F.regexp_extract("holds", f"({HANDLE})", 1)
    has = holds != ""
    out = elements.groupBy("scope").agg(
        F.count("*").alias("n_elements"), F.count_if(has).alias("n_handles"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(has, F.substring_index(holds, "_", 1))))).alias("kinds"),
        F.count_if("sensitive").alias("n_secret"), F.transform(F.slice(F.array_sort(F.collect_list(F.when(has, F.struct("ord", "id")))), 1, 5), lambda e: e["id"]).alias("cite"),
    )
    if regions is None:
        return out.withColumn("n_regions", F.lit(0).cast("long"))
    return out.join(regions.groupBy("scope").agg(F.count("*").alias("n_regions")), "scope", "left").fillna({"n_regions": 0})


def plan(tasks: DataFrame, elements: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(scope, task, more_below) with safe elements (+ enabled, visible, offscreen): scope, type, kind, target, value, confidence."""
    spark = tasks.sparkSession
    if history is None:
        history = spark.createDataFrame([], "scope long, action string, target string, result string")
    asked = history.filter("action = 'ask_user'").select("scope", F.col("target").alias("id")).distinct().withColumn("asked", F.lit(True))
    clicked = history.filter("action = 'click' and result = 'ok'").select("scope", F.col("target").alias("id")).distinct().withColumn("clicked", F.lit(True))
    usable = actionable(elements).join(asked, ["scope", "id"], "left").join(clicked, ["scope", "id"], "left")
    met = tasks.withColumn("task", F.lower("task")).join(usable, "scope", "left")
    field, button = F.col("role").isin("textbox", "password", "select"), F.col("role").isin("button", "link")
    met = met.withColumn("s", F.when(button, planner_score(F.col("task"), F.coalesce("name", F.lit("")))).otherwise(0.0))
    first = lambda cond, *more: F.min(F.when(cond, F.struct("ord", "id", *more)))
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.col("s").desc(), "ord"))
    best = met.withColumn("r", rank).groupBy("scope", "task", "more_below").agg(
        first(field & F.col("wants").rlike(HANDLE), "wants").alias("fill"), first(field & F.col("sensitive") & F.col("asked").isNull()).alias("secret"),
        first(field & F.col("empty") & F.col("asked").isNull()).alias("blank"),
        F.max(F.when(F.col("r") == 1, F.struct("s", "id", F.col("clicked").isNotNull().alias("clicked")))).alias("top"), F.max(F.when(F.col("r") == 2, F.col("s"))).alias("second"),
    )
    none = F.lit(None)
    out = lambda kind, action=none, target=none, value=none, confidence=none: F.struct(F.lit(kind).alias("type"), action.cast("string").alias("kind"), target.cast("string").alias("target"), value.cast("string").alias("value"), confidence.cast("double").alias("confidence"))
    t, fills, top = F.col("task"), says(F.col("task"), WANTS_FILL), F.col("top.s")
    decision = (
        F.when(t.rlike("^" + bounded(QUESTION)), out("data")).when(says(t, CLEAR), out("action", F.lit("clear"), confidence=F.lit(0.95)))
        .when(fills & F.col("fill").isNotNull(), out("action", F.lit("fill"), F.col("fill.id"), F.regexp_extract("fill.wants", f"({HANDLE})", 1), F.lit(0.92)))
        .when(fills & F.col("secret").isNotNull(), out("ask_user", target=F.col("secret.id"))).when(fills & F.col("blank").isNotNull(), out("ask_user", target=F.col("blank.id")))
        .when((top >= 0.5) & F.col("top.clicked"), out("action", F.lit("done"), confidence=F.lit(0.95))).when((top >= 0.5) & (F.col("second") > 0) & (F.col("second") >= top - 0.05), out("ask_user"))
        .when(top >= 0.5, out("action", F.lit("click"), F.col("top.id"), confidence=F.least(F.lit(0.95), 0.5 + top * 0.45)))
        .when(F.col("more_below"), out("action", F.lit("scroll"), value=F.lit("600"), confidence=F.lit(0.6))).otherwise(out("data"))
    )
    return best.select("scope", decision.alias("d")).select("scope", "d.*")


def planned(rules: DataFrame, prompts: DataFrame | None = None, model: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Model first, rules where it fails: (scope, reply) of rules; model maps prompts (scope, prompt) to replies or None; the guard covers both."""
    out = rules
    if model is not None and prompts is not None:
        ask = F.pandas_udf(model, "string")
        replies = prompts.select("scope", ask("prompt").alias("model_reply"))
        out = rules.join(replies, "scope", "left").select("scope", F.coalesce(reply_json(F.col("model_reply")), F.col("reply")).alias("reply"))
    blocked = F.lit('{"type":"error","message":"blocked by the output guard"}')
    return out.withColumn("reply", F.when(guarded(F.col("reply")), blocked).otherwise(F.col("reply")))


def pruned(elements: DataFrame, most: int = 60) -> DataFrame:
    """What a model may see: interactive roles, so many rows a scope, eight columns."""
    roles = ("button", "link", "textbox", "password", "select", "checkbox", "radio")
    rows = elements.filter(F.col("role").isin(*roles)).withColumn("r", F.row_number().over(Window.partitionBy("scope").orderBy("ord"))).filter(F.col("r") <= most)
    return rows.select("scope", "ord", "id", "role", "name", "holds", "wants", "sensitive", "empty")


def check_policy(actions: DataFrame, cap: int = STEP_CAP) -> DataFrame:
    """actions: kind, target, value, step, autofill, element columns e_* (null id: absent), vault columns v_cls, v_value.
    Adds allow, resolved, confirm, reason."""
    kind, value = F.col("kind"), F.col("value")
    e = {c: F.col(f"e_{c}") for c in ("id", "role", "tag", "type", "name", "label", "placeholder", "autocomplete", "h", "visible", "offscreen", "enabled", "text")}
    writes = kind.isin("fill", "select") & value.isNotNull()
    handle = writes & is_handle(value)
    sink = F.coalesce(allowed_sink(F.col("v_cls"), *[e[c] for c in ("role", "tag", "type", "name", "label", "placeholder", "autocomplete", "h")]), F.lit(False))
    out = lambda allow, reason, confirm=F.lit(None), resolved=F.lit(None): F.struct(F.lit(allow).alias("allow"), resolved.cast("string").alias("resolved"), confirm.cast("string").alias("confirm"), F.lit(reason).alias("reason"))  # noqa: E731, B008
    resolved = F.when(handle, F.col("v_value")).otherwise(value)
    label = F.trim(F.concat(F.coalesce(e["name"], F.lit("")), F.lit(" "), F.coalesce(e["text"], F.lit(""))))
    verdict = (
        F.when(F.col("step") >= cap, out(False, "step cap")).when((kind == "navigate") & ~F.coalesce(value, F.lit("")).rlike("(?i)^https?://"), out(False, "not http"))
        .when(kind == "navigate", out(True, "navigation needs approval", confirm_text(value))).when(kind.isin("scroll", "wait", "done", "extract"), out(True, "non-mutating"))
        .when((kind == "clear") & F.col("target").isNull(), out(True, "global clear")).when(e["id"].isNull(), out(False, "target absent"))
        .when(~e["visible"] & ~e["offscreen"], out(False, "target covered")).when(~e["enabled"], out(False, "target disabled"))
        .when(handle & F.col("v_cls").isNull(), out(False, "unknown handle")).when(handle & F.col("v_cls").isin("password", "otp", "apikey") & ~F.col("autofill"), out(False, "secret autofill off"))
        .when(handle & ~sink, out(False, "sink not allowed")).when(writes & ~handle & looks_like_pii(value), out(False, "literal looks personal"))
        .when((kind == "click") & says(label, IRREVERSIBLE), out(True, "irreversible", F.concat(F.lit('Click "'), F.coalesce(e["name"], e["id"]), F.lit('"?')), resolved)).otherwise(out(True, "ok", resolved=resolved))
    )
    return actions.withColumn("v_", verdict).select(*actions.columns, "v_.*")


def _balanced(text: str | None) -> str | None:
    """The first balanced JSON object in a reply, fenced or not."""
    if text is None:
        return None
    if m := re.search(r"```(?:json)?\s*(.*?)```", text, re.S):
        text = m[1]
    depth, start, quoted, escaped = 0, None, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = (escaped or c != '"'), (c == "\\" and not escaped)
        elif c == '"' and depth:
            quoted, escaped = True, False
        elif c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


@F.pandas_udf(T.StringType())
def _reply_json(replies: pd.Series) -> pd.Series:
    return replies.map(_balanced)


def reply_json(reply: Column) -> Column:
    """The first JSON object of a model's reply, null if none."""
    return _reply_json(reply)


REPLY = "type string, thought string, confidence double, question string, target string, answer string, message string, action struct<kind:string,target:string,value:string>, steps array<struct<kind:string,target:string,value:string>>"


def validated(reply: Column) -> Column:
    """A typed reply; unknown types become errors, confidence is 0.5 unless given, plans keep three steps and run the first."""
    r = F.from_json(reply, REPLY)
    known = F.coalesce(r["type"], F.lit("")).isin("action", "plan", "data", "ask_user", "need_image", "error")
    first = F.when(r["type"] == "plan", F.get(F.slice(r["steps"], 1, 3), 0)).when(r["type"] == "action", r["action"])
    kind = F.when(known & ~(r["type"].isin("action", "plan") & first["kind"].isNull()), r["type"]).otherwise("error")
    return F.struct(kind.alias("type"), first["kind"].alias("kind"), first["target"].alias("target"), first["value"].alias("value"), F.coalesce(r["confidence"], F.lit(0.5)).alias("confidence"), F.least(F.coalesce(F.size(r["steps"]), F.lit(0)), F.lit(3)).alias("n_steps"))


def next_state(kind: Column) -> Column:
    """What a step does with a reply of this type."""
    return F.when(kind.isin("action", "plan"), "execute").when(kind == "data", "answer").when(kind == "ask_user", "wait").when(kind == "need_image", "retry_with_image").otherwise("stop")


def grounded(now: Column, expected: Column) -> Column:
    return F.coalesce(now == expected, F.lit(False))


def select_option(wanted: DataFrame, options: DataFrame) -> DataFrame:
    """(scope, value) with options (scope, ord, option_value, option_text): the first whose value is equal or text equal but for case."""
    met = wanted.join(options, "scope").filter((F.col("option_value") == F.col("value")) | (F.lower(F.trim("option_text")) == F.lower(F.trim("value"))))
    return met.groupBy("scope").agg(F.min_by("option_value", "ord").alias("option_value"))


def clear_counts(fields: DataFrame) -> DataFrame:
    """(scope, before, after, enabled): cleared, failed and skipped fields of a clear."""
    had = F.coalesce("before", F.lit("")) != ""
    now = F.coalesce("after", F.lit("")) == ""
    return fields.groupBy("scope").agg(F.count_if(F.col("enabled") & had & now).alias("cleared"), F.count_if(F.col("enabled") & had & ~now).alias("failed"), F.count_if(~F.col("enabled") | ~had).alias("skipped"))
