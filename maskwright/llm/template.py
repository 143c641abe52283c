"""HTML extraction by deduction of page templates from equivalence classes.

A page's tokens are its elements, told apart by their path of tags and classes from the root, and the texts between two tags,
told apart by the path they stand in. Tokens of a host that occur equally often on the same pages share an occurrence
vector and form an equivalence class; vectors are compared by fingerprint - the xor over pages of hash(page, occurrences) -
so a host with a third of all pages is only ever summed, not gathered. A class is valid if its tokens occur equally
often on every page they are on and stand within tokens that are valid themselves; so classes are nested, from the root on, into the
host's template. What the template holds is constant text; what stands between its tokens are slots.

Extraction reads the host's main slot: the deepest template element, once on a page, that holds two thirds of all the host's text, and
those around it as long as they only add headings and paragraphs of their own. What stands in other slots goes by that alone; a page on which the
main slot holds less than half of the text is read as a page without one. Constant text is left out; within an article or main element only where
a box of its own holds nothing else. Hidden elements and those whose tag says
so (nav, footer, ...) are no slot; neither are forms and elements with a boilerplate name, unless an article or nearly
all of the text stands in them: names come last, and alone only where a host has no template. If article or main elements hold most of what remains, it is read from the largest of them alone.

Defined results: null and empty pages give an empty text; hosts with under LEAST_PAGES pages have no template; where nothing
but the template remains (copies of one page), the page is read without it; headings stay, as they are part of an article even where all
articles have them; unclosed elements end as HTML says (a paragraph at the next block, others with their parent), an
unclosed script or comment with the page; a url without a host is a host of its own; repeated rows are read alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Template tokens that are broadcast at most; beyond, templates are joined by host.
TOKEN_BOUND = 500_000
#: Pages of a host from which a template is deduced at least, and of which a token is on half at least.
LEAST_PAGES = 3
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark picture q s samp small source span strike strong sub sup time tt u var wbr".split())
_P = ("p",)
_ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option", "p"), "body": ("head", "title", "p")}
_SCOPES = frozenset("table ul ol dl div section article main body html select td th".split())
_DROPPED_TAGS = frozenset("nav footer aside head button select dialog menu object audio video canvas title".split())
#: Tags that are no part of an article, unless it stands in them.
_NAMED_TAGS = frozenset("form fieldset".split())
#: Elements that a main slot can be, and blocks that belong to the element they stand in.
_HOLDERS = frozenset("html body main article section div form center".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Share of a host's text that its main slot holds at least, in thirds, and of a page's, in halves.
SLOT_THIRDS, PAGE_HALVES = 2, 1
#: Names, as words of class, id or role, of what is not the article.
_DROPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe signup login search widget pagination pager hidden complementary contentinfo".split())
#: Words that free a name where they stand before the part's ("has-sidebar" has one beside it) or end it ("menu-open").
_BEFORE = frozenset("has with without no not is js".split())
_ENDINGS = frozenset("enabled disabled ready open closed active visible layout".split())
#: A header with such a word is an article's own, and with such a one never.
_OF_ARTICLES, _OF_PAGES = frozenset("article entry post story content section chapter".split()), frozenset("page site main top global".split())
#: A named element with such a share of the text around it is kept.
NEARLY_ALL = 0.9
_BOXES = frozenset("div section aside details table".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ARTICLE_ROLES = frozenset("main article articlebody".split())


class Node:
    __slots__ = ("tag", "key", "dropped", "named", "article", "up", "depth", "text", "block", "box")

    def __init__(self, tag, key, dropped, named, article, up):
        self.tag, self.key, self.dropped, self.named, self.article, self.up = tag, key, dropped, named, article, up
        self.depth, self.text = up.depth + 1 if up else 0, 0
        #: The nearest element that is not within a line, and the box within an article that the element stands in, if any.
        self.block = up.block if tag in _INLINE else self
        self.box = (self if tag in _BOXES else up.box) if up and up.article else None


def number(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def boilerplate(names: list[str], in_article: bool = False) -> bool:
    """Whether one of the class, id or role names is that of a part that is not the article."""
    for name in names:
        words = _PARTS.findall(name)
        if not words or words[-1] in _ENDINGS or not _BEFORE.isdisjoint(words[:-1]):
            continue
        if words[0] in _DROPPED_NAMES or words[-1] in _DROPPED_NAMES:
            return True
        if words[-1] == "header" and (not _OF_PAGES.isdisjoint(words) or not in_article and _OF_ARTICLES.isdisjoint(words)):
            return True
    return False


def read(page: str) -> tuple[list[Node], list[tuple[Node, str | None]]]:
    """Elements in page order, and the page's texts with their element; a text of None ends a block."""
    root = Node("", 0, False, False, False, None)
    nodes, flow, stack = [root], [], [root]
    #: Places in the stack of each tag's open elements, of blocks and of scopes: what an end tag closes is found without a search.
    places: dict[str, list[int]] = {}
    blocks, scopes = [0], [0]
    at = 0

    def say(text: str) -> None:
        if text:
            flow.append((stack[-1], html_.unescape(text) if "&" in text else text))

    def close(to: int) -> None:
        if blocks[-1] >= to:
            flow.append((stack[to], None))
        while len(stack) > to:
            places[stack.pop().tag].pop()
        while blocks[-1] >= to:
            blocks.pop()
        while scopes[-1] >= to:
            scopes.pop()

    for m in _MARKUP.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            # An end tag of a line's element closes nothing beyond the block it stands in.
            if (there := places.get(tag)) and (tag not in _INLINE or there[-1] > blocks[-1]):
                close(there[-1])
            continue
        if tag not in _INLINE or tag == "br":
            flow.append((stack[-1], None))
            if tag != "br":
                last = max((places[t][-1] for t in _ENDS.get(tag, _P) if places.get(t)), default=0)
                if last and last >= scopes[-1]:
                    close(last)
        names: list[str] = []
        hidden = article = False
        for a in _ATTRIBUTE.finditer(m[4]) if m[4] else ():
            key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
            hidden |= key == "hidden" or key == "aria-hidden" and value == "true"
            if key in ("class", "id", "role"):
                names += value.split()
            article |= key in ("role", "itemprop") and value in _ARTICLE_ROLES
        up = stack[-1]
        article |= tag in ("article", "main")
        dropped = up.dropped or hidden or tag in _DROPPED_TAGS or tag == "header" and not up.article
        named = tag not in ("html", "body", "article", "main") and (tag in _NAMED_TAGS or boilerplate(names, up.article))
        node = Node(tag, number(up.key, tag, *sorted(names)), dropped, named, article or up.article, up)
        nodes.append(node)
        if tag not in _VOID and not m[4].endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            if tag not in _INLINE:
                blocks.append(len(stack))
            if tag in _SCOPES:
                scopes.append(len(stack))
            stack.append(node)
    say(page[at:])
    return nodes, flow


def text_token(node: Node, text: str) -> int:
    return number(node.block.key, "#text", text)


def extract(page: str, template: frozenset[int] | set[int], main: int | None = None) -> str:
    """The blocks of the page's slots, joined by newlines; main: the token of the host's main slot."""
    nodes, flow = read(page)
    found: list[tuple[Node, str, bool]] = []
    held: list[tuple[Node, str]] = []
    for node, text in [*flow, (nodes[0], None)]:
        if text is not None:
            held.append((node, text))
            continue
        if held and (block := " ".join("".join(t for _, t in held).split())) and not (home := held[0][0].block).dropped:
            constant = bool(template) and home.tag not in _HEADINGS and all(text_token(n, clean) in template for n, t in held if (clean := " ".join(t.split())))
            found.append((home, block, constant))
        held = []
    if main:
        within: set[int] = set()
        for n in nodes:
            if n.key == main or n.up and id(n.up) in within:
                within.add(id(n))
        slot = [b for b in found if id(b[0]) in within]
        if 2 * sum(len(t) for _, t, _ in slot) >= PAGE_HALVES * sum(len(t) for _, t, _ in found):
            found = slot
    varied: set[int] = set()
    for node, _, constant in found:
        while not constant and node and id(node) not in varied:
            varied.add(id(node))
            node = node.up
    blocks = [(n, t) for n, t, constant in found if not constant or n.article and n.box is None or n.article and id(n.box) in varied]
    for node, text in blocks:
        node.text += len(text)
    for node in reversed(nodes):  # an element stands behind those it is in
        if node.up:
            node.up.text += node.text
    holds = {id(n.up) for n in nodes if n.article and n.up and not n.up.article}
    outer: set[int] = set()
    for n in reversed(nodes):
        if id(n) in holds and n.up:
            holds.add(id(n.up))
        if n.article and not n.up.article:
            outer.add(id(n))
    most, away = nodes[0].text, set()
    told = any(n.text for n in nodes if id(n) in outer)
    for n in nodes[1:]:
        # Names alone don't take what would leave next to nothing.
        beside = told if not n.up.article else n.text < NEARLY_ALL * n.up.text
        if id(n.up) in away or n.named and id(n) not in holds and (beside or n.text < NEARLY_ALL * most):
            away.add(id(n))
    blocks = [(n, t) for n, t in blocks if id(n) not in away]
    inside: dict[int, int] = {}
    for n in nodes:
        inside[id(n)] = id(n) if id(n) in outer else inside.get(id(n.up), 0)
    sizes: dict[int, int] = {}
    for n, t in blocks:
        sizes[inside[id(n)]] = sizes.get(inside[id(n)], 0) + len(t)
    slot = max((k for k in sizes if k), key=sizes.get, default=0)
    if slot and 2 * sizes[slot] >= sum(sizes.values()):
        blocks = [(n, t) for n, t in blocks if inside[id(n)] == slot]
    return "\n".join(t for _, t in blocks)


def main_part(page: str, template, main: int | None = None) -> str:
    """What remains beside the template; where that is nothing, what the page's own elements say."""
    return extract(page, template, main) or (extract(page, frozenset()) if template or main else "")


def host(url):
    return F.coalesce(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z]+://([^/:?#]*)", 1), F.lit(""))


def tokens(page: str) -> dict[int, list]:
    """token -> [occurrences, parent's token, depth, is it a text, can it be a main slot, characters in it, those of its own headings and paragraphs]; the root, once a page, included."""
    nodes, flow = read(page)
    seen: dict[int, list] = {}
    own: dict[int, int] = {}
    for n, text in flow:
        if text is not None and (text := " ".join(text.split())):
            home = n.block
            seen.setdefault(text_token(n, text), [0, home.key, home.depth + 1, True, False, 0, 0])[0] += 1
            if home.tag not in ("head", "title"):
                home.text += len(text)
                holder = home.up if home.tag in _PARAGRAPHS else home
                own[id(holder)] = own.get(id(holder), 0) + len(text)
    for n in reversed(nodes):
        if n.up and n.tag != "head":
            n.up.text += n.text
    for n in nodes:
        if n.tag not in _INLINE and n.tag not in _VOID:
            found = seen.setdefault(n.key, [0, n.up.block.key if n.up else 0, n.depth, False, n.tag in _HOLDERS or not n.up, 0, 0])
            found[0] += 1
            found[5] += n.text
            found[6] += own.get(id(n), 0)
    return seen


COUNTS = "host string, token long, key long, n long, parent long, depth int, is_text boolean, holder boolean, chars long, own long"


def occurrences(pages: DataFrame) -> DataFrame:
    """COUNTS; key is the page."""

    def run(batches):
        for hosts, keys, texts in common.steps(batches, "host", "key", "html"):
            rows = [(h, token, key, *x) for h, key, t in zip(hosts, keys, texts) for token, x in tokens(t).items()]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in COUNTS.split(", ")])

    rows = pages.select(host(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("key"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, COUNTS)


def main_slot(rows: dict[int, tuple]) -> int | None:
    """The token of the main slot among a host's valid elements: token -> row with parent, depth, once, holder, chars, own."""
    total = max((r.chars for r in rows.values()), default=0)
    able = [r for r in rows.values() if r.holder and r.least == r.most == 1 and 3 * r.chars >= SLOT_THIRDS * total > 0]
    if not able:
        return None
    slot = max(able, key=lambda r: (r.depth, r.chars, r.token))
    while slot.depth and (up := rows.get(slot.parent)) and up.holder and up.chars - slot.chars <= up.own:
        slot = up
    return slot.token if slot.depth else None


def nested(group: pd.DataFrame) -> pd.DataFrame:
    """The tokens of valid classes, with the number of their class and of the class around it (-1: none)."""
    group = group.sort_values(["depth", "token"])
    classes: dict[tuple, list] = {}
    for row in group.itertuples():
        classes.setdefault((row.vector, row.pages), []).append(row)
    even = {k for k, rows in classes.items() if len({(r.least, r.most) for r in rows}) == 1 and rows[0].least == rows[0].most}
    home = {r.token: k for k, rows in classes.items() for r in rows}
    valid: dict[int, tuple[int, int]] = {}
    order: dict[tuple, int] = {}
    for row in group.itertuples():  # from the root on
        own = home[row.token]
        if own in even and (row.depth == 0 or row.parent in valid):
            around = -1 if row.depth == 0 or home[row.parent] == own else order[home[row.parent]]
            valid[row.token] = (order.setdefault(own, len(order)), around)
    main = main_slot({r.token: r for r in group.itertuples() if r.token in valid and not r.is_text})
    some = group[group["token"].isin(valid.keys())]
    return pd.DataFrame({"host": some["host"], "token": some["token"], "is_text": some["is_text"], "main": some["token"] == (0 if main is None else main), "class": [valid[t][0] for t in some["token"]], "around": [valid[t][1] for t in some["token"]]})


def deduce(pages: DataFrame) -> DataFrame:
    """host, token, is_text, main (is it the main slot), class, around: each host's template. Tokens on fewer than half of a host's pages are no part of it."""
    sums = occurrences(pages).groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("key", "n")).alias("vector"), F.count("*").alias("pages"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.bool_and("is_text").alias("is_text"), F.bool_and("holder").alias("holder"), F.sum("chars").alias("chars"), F.sum("own").alias("own"),
    )
    every = pages.groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("all")).filter(F.col("all") >= LEAST_PAGES)
    frequent = sums.join(every, "host").filter((F.col("pages") * 2 >= F.col("all")) & (F.col("pages") >= LEAST_PAGES)).drop("all")
    return frequent.groupBy("host").applyInPandas(nested, "host string, token long, is_text boolean, main boolean, class int, around int")


def main_text(pages: DataFrame, bound: int = TOKEN_BOUND) -> DataFrame:
    """page_id, url, text, n_chars."""
    common.ship(pages.sparkSession)
    known = deduce(pages).filter("is_text or main").groupBy("host").agg(F.collect_set(F.when(F.col("is_text"), F.col("token"))).alias("template"), F.max(F.when(F.col("main"), F.col("token"))).alias("main"))
    known = common.materialise(known, "templates")
    small = (known.agg(F.sum(F.size("template") + 1)).first()[0] or 0) <= bound
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    kinds = rows.schema
    # Few templates go to each worker once; many come with their pages, and a worker builds a host's set once a batch.
    sent = pages.sparkSession.sparkContext.broadcast({r["host"]: (frozenset(r["template"]), r["main"]) for r in known.collect()}) if small else None
    whole = rows.select("page_id", "url", "host", F.lit(None).cast("array<bigint>").alias("template"), F.lit(None).cast("long").alias("main"), "html") if small else rows.join(known, "host", "left").select("page_id", "url", "host", "template", "main", "html")

    def run(batches):
        for batch in batches:
            sets: dict = {} if sent is None else sent.value
            for keys, urls, hosts, templates, mains, texts in common.steps(iter((batch,)), "page_id", "url", "host", "template", "main", "html"):
                if sent is None:
                    for h, t, m in zip(hosts, templates, mains):
                        if h not in sets:
                            sets[h] = (frozenset(t or ()), m)
                found = [main_part(t, *sets.get(h, (frozenset(), None))) for h, t in zip(hosts, texts)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, key), pa.array(urls, pa.string()), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    from pyspark.sql.pandas.types import to_arrow_type

    key = to_arrow_type(kinds["page_id"].dataType)
    return whole.mapInArrow(run, f"page_id {kinds['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages"))
