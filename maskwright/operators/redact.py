"""Typed stable handles and redaction.

A handle's number is its value's place of first appearance among the scope's handles of that prefix: elements in
order, value before text, within a string from the right. Folds run within one string; numbering is a window per scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import prefix
from ..session import cut

REMOVED = "[REMOVED]"


def mint(values: DataFrame) -> DataFrame:
    """Adds `handle` to (scope, cls, value, place): place orders first appearances."""
    first = values.groupBy("scope", "cls", "value").agg(F.min("place").alias("first"), prefix(F.first("cls")).alias("prefix"))
    number = F.row_number().over(Window.partitionBy("scope", "prefix").orderBy("first", "cls", "value"))
    named = first.select("scope", "cls", "value", F.concat("prefix", F.lit("_"), number.cast("string")).alias("handle"))
    return values.join(named, ["scope", "cls", "value"], "left")


def apply_spans(text: Column, spans: Column, most: int | None = None) -> Column:
    """Replaces array<struct<start,end,rep>> in text, from the right; then cuts to `most` characters if given."""
    order = F.array_sort(spans, lambda a, b: b["start"] - a["start"])
    out = F.aggregate(order, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), s["rep"], F.substring(t, s["end"] + 1, F.length(t))))
    return out if most is None else F.left(out, F.lit(most))


def redact_texts(texts: DataFrame, findings: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(scope, ord, text) with findings (scope, ord, start, end, cls, fate): redacted texts and the vault.

    The vault (scope, cls, value, handle) is a transient frame; writing it anywhere is the caller's decision."""
    spans = findings.join(texts, ["scope", "ord"]).select("scope", "ord", "start", "end", "cls", "fate", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("value"))
    named = mint(spans.filter("fate <> 'drop'").withColumn("place", F.struct(F.col("ord"), -F.col("start"))))
    replaced = named.select("scope", "ord", F.struct("start", "end", F.col("handle").alias("rep")).alias("s"))
    removed = spans.filter("fate = 'drop'").select("scope", "ord", F.struct("start", "end", F.lit(REMOVED).alias("rep")).alias("s"))
    lists = replaced.unionByName(removed).groupBy("scope", "ord").agg(F.collect_list("s").alias("spans"))
    out = texts.join(lists, ["scope", "ord"], "left")
    done = F.when(F.col("spans").isNull(), F.col("text") if most is None else F.left("text", F.lit(most))).otherwise(apply_spans(F.col("text"), F.col("spans"), most))
    vault = named.select("scope", "cls", "value", "handle").distinct()
    return out.select("scope", "ord", done.alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans")), vault


def safe_to_echo(role: Column, tag: Column, kind: Column) -> Column:
    return F.when(role == "password", False).otherwise((tag == "select") | F.coalesce(kind, F.lit("")).isin("checkbox", "radio", "search"))


def worth_asking(role: Column, kind: Column, label: Column, name: Column, placeholder: Column) -> Column:
    blank = ("search", "submit", "reset", "button", "image", "file", "hidden", "checkbox", "radio")
    named = F.greatest(*[F.length(F.coalesce(c, F.lit(""))) for c in (label, name, placeholder)]) > 0
    return (role != "password") & ~F.coalesce(kind, F.lit("")).isin(*blank) & named


_FOUND = "array<struct<field:string,start:int,end:int,cls:string,fate:string,p:double>>"
_MINTS = "array<struct<cls:string,value:string,f:int,s:int>>"


def _likeliest(found: Column) -> Column:
    """The class of the likeliest finding, the last in the alphabet of equals; null if there is none."""
    return F.array_max(F.transform(found, lambda x: F.struct(x["p"].alias("p"), x["cls"].alias("cls"))))["cls"]


def redact(elements: DataFrame, findings: DataFrame, profile: DataFrame | None = None, most: int = 240) -> tuple[DataFrame, DataFrame]:
    """Safe elements (scope, ord, id, role, tag, type, name, box and state, text, holds, wants, sensitive, empty, fate) and the vault.

    Value disposition, first that applies: any drop -> sensitive; a whole-value substitute -> its handle; spans -> the
    substituted string; harmless controls echo; a blank field -> wants, or empty. profile: cls, ord, value.
    An element's findings meet it once, as an array; values to be named go through `mint` and come back to their element once."""
    lists = findings.filter("anchored").groupBy("scope", "id").agg(F.collect_list(F.struct("field", "start", "end", "cls", "fate", "p")).alias("found"))
    e = elements.join(lists, ["scope", "id"], "left").withColumn("found", F.coalesce("found", F.array().cast(_FOUND)))
    of = lambda field, fate, spans: F.filter("found", lambda x: (x["field"] == field) & (x["fate"] == fate) & (x["start"].isNotNull() if spans else x["start"].isNull()))
    full, worded = F.coalesce(F.col("value"), F.lit("")) != "", F.coalesce(F.col("text"), F.lit("")) != ""
    sensitive = F.exists("found", lambda x: (x["field"] == "value") & (x["fate"] == "drop"))
    none = F.array().cast(_FOUND)
    e = e.withColumns({"sensitive": sensitive, "full": full, "whole": F.when(full, _likeliest(of("value", "substitute", False)))})
    e = e.withColumns({
        "value_spans": F.when(F.col("full") & F.col("whole").isNull(), of("value", "substitute", True)).otherwise(none), "text_spans": F.when(worded, of("text", "substitute", True)).otherwise(none),
        "removed": F.when(worded, of("text", "drop", True)).otherwise(none), "wanted": F.when(~F.col("full") & ~F.col("sensitive"), _likeliest(F.filter("found", lambda x: x["field"] == "value"))),
    })
    if profile is None:
        e = e.withColumn("slot", F.lit(None).cast("string"))
    else:  # a profile has one row for each of its few slots
        slots = profile.filter("value <> ''").groupBy(F.col("cls").alias("wanted")).agg(F.min_by("value", "ord").alias("slot"))
        e = e.join(F.broadcast(slots), "wanted", "left")
    one = lambda cls, value, f, s: F.struct(cls.alias("cls"), value.alias("value"), F.lit(f).alias("f"), s.alias("s"))
    part = lambda raw, f: lambda x: one(x["cls"], F.substring(F.col(raw), x["start"] + 1, x["end"] - x["start"]), f, -x["start"])
    single = lambda on, item: F.when(on, F.array(item)).otherwise(F.array().cast(_MINTS))
    mints = F.concat(
        single(F.col("whole").isNotNull(), one(F.col("whole"), F.col("value"), 0, F.lit(0))), F.transform("value_spans", part("value", 0)), F.transform("text_spans", part("text", 1)),
        single(F.col("slot").isNotNull(), one(F.col("wanted"), F.col("slot"), 0, F.lit(0))),
    )
    e = cut(e.withColumn("mints", mints).drop("found"))
    named = e.select("scope", "id", "ord", F.inline("mints")).select("scope", "id", "cls", "value", F.struct(F.col("ord").alias("o"), F.col("f").alias("f"), F.col("s").alias("s")).alias("place"))
    named = cut(mint(named))
    handles = named.groupBy("scope", "id").agg(F.collect_set(F.struct("cls", "value", "handle")).alias("handles"))
    out = e.join(handles, ["scope", "id"], "left")
    handle = lambda cls, value: F.get(F.filter("handles", lambda h: (h["cls"] == cls) & (h["value"] == value)), 0)["handle"]
    spans = lambda raw, found: F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), handle(x["cls"], F.substring(F.col(raw), x["start"] + 1, x["end"] - x["start"])).alias("rep")))
    gone = F.transform("removed", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(REMOVED).alias("rep")))
    out = out.withColumns({"value_reps": spans("value", "value_spans"), "text_reps": F.concat(spans("text", "text_spans"), gone)})
    some = lambda c: F.size(c) > 0
    wants = F.when(F.col("slot").isNotNull(), handle(F.col("wanted"), F.col("slot")))
    holds = (
        F.when(F.col("sensitive") | ~F.col("full"), F.lit(None)).when(F.col("whole").isNotNull(), handle(F.col("whole"), F.col("value")))
        .when(some("value_reps"), apply_spans(F.col("value"), F.col("value_reps"), most)).when(safe_to_echo(F.col("role"), F.col("tag"), F.col("type")), F.left("value", F.lit(120)))
    )
    text = F.when(some("text_reps"), apply_spans(F.col("text"), F.col("text_reps"), most)).otherwise(F.left("text", F.lit(most)))
    empty = ~F.col("full") & ~F.col("sensitive") & F.col("slot").isNull() & F.col("tag").isin("input", "textarea", "select") & worth_asking(F.col("role"), F.col("type"), F.col("label"), F.col("name"), F.col("placeholder"))
    safe = out.select(
        "scope", "ord", "id", "role", "tag", "type", "name", *"xywh", "visible", "offscreen", "enabled", "parent", text.alias("text"), holds.alias("holds"), wants.alias("wants"), "sensitive", empty.alias("empty"),
        F.when(F.col("sensitive"), "drop").when(F.col("full") & (F.col("whole").isNotNull() | some("value_reps")) | some("text_reps"), "substitute").otherwise("keep").alias("fate"),
    )
    return safe, named.select("scope", "cls", "value", "handle").distinct()


def regions(elements: DataFrame, findings: DataFrame) -> DataFrame:
    """scope, x, y, w, h, cls, unanchored: boxes to mask; findings without an element bring their own box in the id `v_x_y_w_h`."""
    masked = findings.filter("fate = 'mask'")
    own = masked.filter("anchored").select("scope", "id", "cls").join(elements.select("scope", "id", "x", "y", "w", "h"), ["scope", "id"]).select("scope", "x", "y", "w", "h", "cls", F.lit(False).alias("unanchored"))
    parts = F.split("id", "_")
    loose = masked.filter("not anchored").select("scope", *[F.get(parts, i + 1).try_cast("int").alias(c) for i, c in enumerate("xywh")], "cls", F.lit(True).alias("unanchored"))
    return own.unionByName(loose)


def scrub_task(tasks: DataFrame, vault: DataFrame, most: int = 500) -> DataFrame:
    """(scope, task) with known values of four characters or more replaced by their handles, in order of handle."""
    known = vault.filter(F.length("value") >= 4).groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("handle", "value"))).alias("known"))
    done = F.aggregate(F.coalesce("known", F.array().cast("array<struct<handle:string,value:string>>")), F.col("task"), lambda t, v: F.replace(t, v["value"], v["handle"]))
    return tasks.join(known, "scope", "left").select("scope", F.left(done, F.lit(most)).alias("task"))


def serialise(safe: DataFrame) -> DataFrame:
    """scope, payload: one JSON document per scope with a fixed key order."""
    e = F.struct("ord", "id", "role", "name", "text", "holds", "wants", "sensitive", "empty")
    lists = safe.groupBy("scope").agg(F.array_sort(F.collect_list(e)).alias("elements"))
    return lists.select("scope", F.to_json(F.struct(F.lit("sanitized/1").alias("schema"), F.transform("elements", lambda x: x.dropFields("ord")).alias("elements"))).alias("payload"))


#: An element's confidence and source where it was read from a page.
CONFIDENCE, SOURCE = 0.98, "dom"


def contexts(
    safe: DataFrame, pages: DataFrame, mode: str = "balanced", groups: DataFrame | None = None, regions: DataFrame | None = None, history: DataFrame | None = None, vault: DataFrame | None = None
) -> DataFrame:
    """scope, payload: the whole context that may leave, as JSON with a fixed key order; what is null is left out.

    pages: scope, task, url_class, title, width, height, scroll_y, doc_height. groups: scope, id, kind, name, children, x, y, w, h. regions: scope, x, y, w, h,
    cls. history: scope, step, action, target, result, note, of which the last six steps go. vault: known values are replaced in the task."""
    flag = lambda c: F.when(F.col(c), F.lit(True))
    box = lambda r: F.when(r("x").isNotNull(), F.struct(*[r(c).alias(c) for c in "xywh"]))
    here = lambda c: F.col(c)
    e = F.struct(
        "ord", "id", "role", "tag", "type", "name", F.when(F.col("x").isNotNull(), F.array(*"xywh")).alias("bbox"), "visible", flag("offscreen").alias("offscreen"), "enabled", "parent",
        F.lit(CONFIDENCE).alias("conf"), F.lit(SOURCE).alias("src"), "holds", "wants", flag("sensitive").alias("sensitive"), flag("empty").alias("empty"), "text",
    )
    out = safe.groupBy("scope").agg(F.array_sort(F.collect_list(e)).alias("elements"))
    tasks = pages.select("scope", F.left("task", F.lit(500)).alias("task")) if vault is None else scrub_task(pages.select("scope", "task"), vault)
    viewport = F.struct(F.col("width").alias("w"), F.col("height").alias("h"), F.col("scroll_y").alias("scrollY"), F.col("doc_height").alias("docH"))
    out = out.join(pages.select("scope", "url_class", "title", viewport.alias("viewport")), "scope", "left").join(tasks, "scope", "left")
    lists = {
        "groups": None if groups is None else groups.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct(F.length("id").alias("n"), "id", "kind", "name", "children", box(here).alias("bbox")))).alias("groups")),
        "regions": None if regions is None else regions.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct(F.array(*"xywh").alias("bbox"), "cls", F.lit("masked").alias("state")))).alias("regions")),
        "history": None if history is None else history.groupBy("scope").agg(F.slice(F.array_sort(F.collect_list(F.struct("step", "action", "target", "result", "note"))), -F.least(F.count("*"), F.lit(6)).cast("int"), 6).alias("history")),
    }
    inner = {"groups": "n", "history": "step"}  # what only orders a list
    without = lambda field: lambda x: x.dropFields(field)
    for name, some in lists.items():
        out = out.join(some, "scope", "left") if some is not None else out.withColumn(name, F.lit(None).cast("array<struct<id:string>>"))
        if name in inner and some is not None:
            out = out.withColumn(name, F.transform(name, without(inner[name])))
        empty = F.array().cast(out.schema[name].dataType)
        out = out.withColumn(name, F.coalesce(name, empty))
    whole = F.struct(
        F.lit("sanitized/1").alias("schema"), "task", F.lit(mode).alias("mode"), F.col("url_class").alias("urlClass"), "title", "viewport",
        F.transform("elements", lambda x: x.dropFields("ord")).alias("elements"), "groups", "regions", "history",
    )
    return out.select("scope", F.to_json(whole).alias("payload"))


def preview(cls: Column, value: Column) -> Column:
    """A value for display; secrets never."""
    return F.when(cls.isin("password", "otp", "apikey"), F.lit(None)).otherwise(value)
