"""HTML pages as element tables: one Arrow pass of a tolerant parser, then budgets, kinship and groups over nested sets.

The parser numbers elements in document order: `node` is an element's own number and `leave` the last one inside it, so that one element
contains another where node < other <= leave. A page has one text, white space collapsed, and each element its place in it (`begin`, `end`):
full texts are slices of it, and no text is held once for each of its ancestors.

Files have no layout: boxes are null, everything is visible and nothing is offscreen.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERACTIVE = frozenset("a button input select textarea summary".split())
MEDIA = frozenset("img svg canvas video iframe picture object embed".split())
TEXTY = frozenset("h1 h2 h3 h4 h5 h6 p li td th label legend figcaption dt dd span div".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("p div ul ol table section article h1 h2 h3 h4 h5 h6 form nav footer header".split())
_CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_WALLS = frozenset("ul ol table article div body".split())
#: Elements and texts of a page that are kept, and characters of a text.
BUDGET, TEXT_BUDGET, OWN_TEXT = 400, 400, 500
#: What a text has that may hold personal data.
SUSPICIOUS = r"\d{4,}|@"
#: Elements that may label what follows them, and characters of such a label.
_LABELS, SIBLING_LABEL = frozenset("label span div dt p strong b".split()), 48
NODES = "scope long, node int, leave int, up int, tag string, type string, explicit string, aria string, alt string, title string, placeholder string, autocomplete string, html_id string, label_for string, value string, own_text string, full_text string, begin int, end int, pass int, editable boolean, modal boolean, enabled boolean, labelled string, label string"
#: Rows that the parser hands on at once.
SLICE = 5_000
_SPACE = re.compile(r"\s+")


class _Nodes(HTMLParser):
    """rows: one for each element in document order; text(): the page's text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.stack, self.parts, self.size, self.blank = [], [], [], 0, True
        #: Places in the stack of each tag's open elements, and of those that end tags of items don't reach beyond.
        self.open, self.walls = {}, []

    def pop_to(self, k):
        while len(self.stack) > k:
            row = self.rows[self.stack.pop()]
            row["leave"], row["end"] = len(self.rows) - 1, self.size
            self.open[row["tag"]].pop()
            if row["tag"] in _WALLS:
                self.walls.pop()

    def handle_starttag(self, tag, attrs):
        for ends in _CLOSES.get(tag, ("p",) if tag in _BLOCKS else ()):
            there = self.open.get(ends)
            if there and (not self.walls or there[-1] >= self.walls[-1]):
                self.pop_to(there[-1])
        a = dict(attrs)
        n = len(self.rows)
        up = self.stack[-1] if self.stack else None
        interactive = tag in INTERACTIVE or "role" in a or "onclick" in a or "tabindex" in a or "contenteditable" in a
        role = (a.get("role") or "").lower()
        self.rows.append({
            "node": n, "leave": n, "up": up, "tag": tag, "type": a.get("type"), "explicit": a.get("role"), "aria": a.get("aria-label"), "alt": a.get("alt"), "title": a.get("title"), "placeholder": a.get("placeholder"),
            "autocomplete": a.get("autocomplete"), "html_id": a.get("id"), "label_for": a.get("for"), "value": a.get("value") if tag in ("input", "button") else None, "own_text": [], "begin": self.size, "end": self.size,
            "pass": 1 if interactive else 2 if tag in MEDIA else 3 if tag in TEXTY else 0, "editable": "contenteditable" in a or "onclick" in a,
            "modal": tag == "dialog" and "open" in a or role in ("dialog", "alertdialog") or a.get("aria-modal") == "true", "enabled": "disabled" not in a, "labelled": a.get("aria-labelledby"),
            "around": n if tag == "label" else self.rows[up]["around"] if up is not None else None,
        })
        if tag not in _VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            if tag in _WALLS:
                self.walls.append(len(self.stack))
            self.stack.append(n)

    def handle_endtag(self, tag):
        if there := self.open.get(tag):
            self.pop_to(there[-1])

    def handle_data(self, data):
        if self.stack and (row := self.rows[self.stack[-1]])["tag"] not in ("script", "style"):
            row["own_text"].append(data)
            said = _SPACE.sub(" ", data)
            if self.blank and said[:1] == " ":
                said = said[1:]
            if said:
                self.parts.append(said)
                self.size += len(said)
                self.blank = said[-1] == " "

    def done(self):
        """Ends what is open, cuts texts out, and resolves names by reference and labels: one for the element's id, else one around it, else a short sibling before it."""
        self.pop_to(0)
        page = "".join(self.parts)
        by_id, named, before = {}, {}, {}
        for r in self.rows:
            r["own_text"] = " ".join("".join(r["own_text"]).split())[:OWN_TEXT]
            r["full_text"] = page[r["begin"] : min(r["end"], r["begin"] + OWN_TEXT + 2)].strip()[:OWN_TEXT]
            if r["html_id"]:
                by_id.setdefault(r["html_id"], r["full_text"])
            if r["tag"] == "label" and r["label_for"]:
                named.setdefault(r["label_for"], r["full_text"])
        for r in self.rows:
            if r["labelled"]:
                r["labelled"] = " ".join(by_id.get(i, "") for i in r["labelled"].split())
            around = self.rows[r["around"]]["full_text"] if r["around"] is not None else ""
            sibling, before[r["up"]] = before.get(r["up"]), r["node"]
            beside = self.rows[sibling]["full_text"] if sibling is not None and self.rows[sibling]["tag"] in _LABELS else ""
            r["label"] = named.get(r["html_id"]) or around or (beside if len(beside) <= SIBLING_LABEL else "") or None
        return self.rows


def parse(page: str | None) -> list[dict]:
    parser = _Nodes()
    parser.feed(page or "")
    parser.close()
    return parser.done()


def nodes(pages: DataFrame) -> DataFrame:
    """Every element of every page, in document order; texts are cut at OWN_TEXT characters."""
    names = [c.split()[0] for c in NODES.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for scope, page in zip(batch["scope"], batch["html"]):
                out += [{"scope": scope} | r for r in parse(page)]
                while len(out) >= SLICE:
                    yield _frame(out[:SLICE])
                    out = out[SLICE:]
            yield _frame(out)

    def _frame(rows):
        frame = pd.DataFrame(rows, columns=names)
        frame["up"] = frame["up"].astype("Int32")
        return frame

    return pages.select(F.col("page_id").cast("long").alias("scope"), "html").mapInPandas(run, NODES)


def elements(found: DataFrame, suspicious: bool = False) -> DataFrame:
    """Kept elements: interactive, media, then text nodes; first pass wins; budgets per page.

    suspicious: of text nodes only those whose own text may hold personal data (SUSPICIOUS); else all that have a text, own or full."""
    from ..operators.lookup import within_budget
    from ..schema import accessible_name, role

    own = F.nullif("own_text", F.lit(""))
    text = F.when((F.col("pass") < 3) | ~F.lit(suspicious), F.coalesce(own, F.nullif("full_text", F.lit("")))).otherwise(F.when((F.length("own_text") > 1) & F.col("own_text").rlike(SUSPICIOUS), own))
    short = found.filter("pass > 0").withColumn("text", text).filter("pass < 3 or text is not null")
    texts = F.row_number().over(Window.partitionBy("scope", "pass").orderBy("node"))
    kept = within_budget(short.withColumn("t", texts).filter(f"pass < 3 or t <= {TEXT_BUDGET}"), BUDGET)
    button = F.when(F.col("tag").isin("button", "input"), F.coalesce("value", F.lit("")))
    named = kept.withColumn("name", accessible_name(*[F.col(c) if isinstance(c, str) else c for c in ("aria", "labelled", "label", "alt", button, "text", "title", "placeholder")]))
    none = F.lit(None).cast("int")
    return named.select(
        "scope", "ord", F.concat(F.lit("el_"), "node").alias("id"), role(F.col("tag"), F.col("type"), F.col("explicit"), F.col("editable")).alias("role"), "tag", "type", "name", F.nullif("value", F.lit("")).alias("value"), "text",
        *[none.alias(c) for c in "xywh"], F.lit(True).alias("visible"), F.lit(False).alias("offscreen"), "enabled", F.lit(None).cast("string").alias("parent"), "autocomplete", "placeholder", "label", "node", "leave",
    )


def _in_order(kept: DataFrame, *names: str) -> DataFrame:
    """scope, kept: each scope's elements (at most BUDGET) as one array in document order."""
    return kept.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("node", "leave", "id", *names))).alias("kept"))


def nearest_kept(kept: DataFrame) -> DataFrame:
    """scope, id, parent: each kept element's nearest kept ancestor, by one pass over the scope's nested sets with the open ones at hand."""
    start = F.expr("named_struct('open', cast(array() as array<struct<leave:int,id:string>>), 'out', cast(array() as array<struct<id:string,parent:string>>))")

    def step(s: Column, x: Column) -> Column:
        still = F.filter(s["open"], lambda o: o["leave"] >= x["node"])
        return F.struct(
            F.array_append(still, F.struct(x["leave"].alias("leave"), x["id"].alias("id"))).alias("open"),
            F.array_append(s["out"], F.struct(x["id"].alias("id"), F.try_element_at(still, F.lit(-1))["id"].alias("parent"))).alias("out"),
        )

    pairs = _in_order(kept).select("scope", F.inline(F.aggregate("kept", start, step)["out"]))
    return pairs.filter("parent is not null")


#: Kinds of groups, in the order in which a page's groups are numbered.
KINDS = ("form", "nav", "modal", "table")


def groups(found: DataFrame, kept: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """scope, id, kind, name, children, n, x, y, w, h: forms, navigation, dialogs and tables with two kept elements or more inside.

    boxes: scope, id, x, y, w, h of elements where a layout is known; a group's box is their union, else null. An element of two kinds is two groups."""
    from ..schema import accessible_name

    role = F.lower(F.coalesce("explicit", F.lit("")))
    marks = (F.col("tag") == "form", (F.col("tag") == "nav") | (role == "navigation"), F.col("modal"), F.col("tag") == "table")
    kinds = F.array_compact(F.array(*[F.when(m, F.struct(F.lit(k).alias("rank"), F.lit(kind).alias("kind"))) for k, (m, kind) in enumerate(zip(marks, KINDS))]))
    no = F.lit(None).cast("string")
    name = F.nullif(accessible_name(F.col("aria"), F.col("labelled"), F.col("label"), no, no, no, F.col("title"), F.col("placeholder")), F.lit(""))
    containers = found.select("scope", F.col("node").alias("at"), F.col("leave").alias("until"), name.alias("name"), F.explode(kinds).alias("k")).select("scope", "at", "until", "name", "k.rank", "k.kind")
    if boxes is None:
        placed = kept.select("scope", "ord", "node", "leave", "id", *[F.lit(None).cast("int").alias(c) for c in "xywh"])
    else:
        placed = kept.select("scope", "ord", "node", "leave", "id").join(boxes.select("scope", "id", *"xywh"), ["scope", "id"], "left")
    inside = F.filter("kept", lambda x: (x["node"] > F.col("at")) & (x["node"] <= F.col("until")))
    met = containers.join(_in_order(placed, "ord", *"xywh"), "scope").withColumn("inside", F.array_sort(F.transform(inside, lambda x: F.struct(x["ord"].alias("ord"), x["id"].alias("id"), *[x[c].alias(c) for c in "xywh"])))).filter(F.size("inside") >= 2)
    number = F.row_number().over(Window.partitionBy("scope").orderBy("rank", "at"))
    edge = lambda pick, f: pick(F.transform("inside", f))
    x, y = edge(F.array_min, lambda e: e["x"]), edge(F.array_min, lambda e: e["y"])
    right, low = edge(F.array_max, lambda e: e["x"] + e["w"]), edge(F.array_max, lambda e: e["y"] + e["h"])
    return met.select(
        "scope", F.concat(F.lit("g_"), number.cast("string")).alias("id"), "kind", "name", F.transform("inside", lambda e: e["id"]).alias("children"), F.size("inside").cast("long").alias("n"),
        x.alias("x"), y.alias("y"), (right - x).alias("w"), (low - y).alias("h"),
    )


def reading_order(df: DataFrame) -> DataFrame:
    return df.withColumn("reading", F.row_number().over(Window.partitionBy("scope").orderBy("y", "x", "ord")))
