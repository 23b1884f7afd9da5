"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a chain of tags and class names, keyed by a
64-bit hash of its parent's key and its own label. Branches more than 64 nodes deep are judged with
their ancestor at that depth, so that a page of n tags has at most 64 n pairs of node and ancestor; their texts stay blocks of
their own. Two
entropies weigh a node. Content: a text that stands at the node on all of the host's pages has
entropy 1 and tells nothing, a text of one page has entropy 0; the content importance of a branch is
one minus the mean over its texts. Presentation: the entropy of the child sequences that the node
shows from page to page. A branch of low combined importance is cut from every page of the host.

Tags and names that stand for page furniture (navigation, footers, adverts, comments, ...) have no
presentation importance of their own and are cut even if their texts differ from page to page. A
class, id or role name and a form are weak signs: they do not cut a branch that holds the article.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agroseries.sources.shared import saved

# fixed values: names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary hr fieldset form nav header footer aside center dialog "
    "head legend menu search hgroup".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPE = frozenset("html body article section main div table ul ol dl blockquote td th form nav header footer aside".split())
WHOLE = frozenset("html body main article".split())  # hold the content whatever their class names
FURNITURE_TAGS = frozenset("head nav footer aside button select dialog menu search".split())
ROOT, MOST_DEPTH = 0, 64
HOLDER_SHARE = 0.1  # of the page's text, in an article or main that counts as the content
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar widget widgets related share sharing social comment comments commentlist disqus reply replies respond footer "
    "masthead toolbar pagination pager login signup contentinfo complementary dialog alert hidden".split()
)
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)>|<(?P<cut>/?[A-Za-z][^<>]*)\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def node_key(above: int, label: str) -> int:
    """Key of a node, as a signed long; the root of a host is 0."""
    key = xxhash.xxh64_intdigest(f"{above}/{label}")
    return key - (1 << 64) if key >> 63 else key


def label_of(tag: str, rest: str, inside: bool) -> tuple[str, bool, bool]:
    """Node label (tag and class words without digits), whether it is page furniture, and whether a name or form says so."""
    furniture = tag in FURNITURE_TAGS or (tag == "header" and not inside)
    classes: list[str] = []
    weak = tag == "form"
    if "=" in rest or "hidden" in rest:
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
        classes = sorted(re.findall(r"[a-z]+", values.get("class", "").lower()))
        named = [*classes, *re.findall(r"[a-z]+", f"{values.get('id', '')} {values.get('role', '')}".lower())]
        gone = "display:none" in values.get("style", "").replace(" ", "") or values.get("aria-hidden") == "true"
        furniture |= gone or bool(re.search(r"\shidden(\s|$|/)", rest))
        weak |= not FURNITURE_WORDS.isdisjoint(named)
    return ".".join([tag, *classes]), furniture, weak


class Block(NamedTuple):
    """A text block; ``weak`` and ``holders`` are the branches around it, outer first, by number."""

    node: int
    text: str
    furniture: bool
    weak: tuple[int, ...]
    holders: tuple[int, ...]
    heading: bool


def cut_names(blocks: list[Block], chains: dict[int, tuple[int, ...]], named: set[int]) -> set[int]:
    """Branches with a name of furniture, or a form, that do not hold the content of the page.

    ``chains``: the weak branches around every article and main; ``named``: those of them that have
    such a name themselves. Branches around all articles are opened from outside until one is in
    none. In an article, or on a page without one, a branch with a h1 or most of the text is opened.
    """
    texts = [b for b in blocks if not b.furniture]
    cut = {w for b in texts for w in b.weak}
    if not cut:
        return cut
    size = sum(len(b.text) for b in texts)
    held: Counter[int] = Counter()
    for b in texts:
        held.update(dict.fromkeys(b.holders, len(b.text)))
    big = [h for h, n in held.items() if n >= HOLDER_SHARE * size]
    holders = [h for h in big if h not in named] or big
    around = {h: [w for w in chains[h] if w in cut] for h in holders}
    while around and all(around.values()):
        cut -= {chain[0] for chain in around.values()}
        around = {h: [w for w in chain if w in cut] for h, chain in around.items()}
    scopes = {h for h, chain in around.items() if not chain}
    inside: Counter[tuple[int, int]] = Counter()  # text of a weak branch in a scope, -1 for the page
    headed = set()
    for b in texts:
        for h in [h for h in b.holders if h in scopes] if scopes else [-1]:
            for w in b.weak:
                if h < 0 or w not in chains[h]:
                    inside[w, h] += len(b.text)
                    if b.heading:
                        headed.add(w)
    return cut - headed - {w for (w, h), n in inside.items() if 2 * n > (size if h < 0 else held[h])}


class Element(NamedTuple):
    """An open element. ``level`` counts the nodes around it, ``weak`` and ``holders`` are as in a block."""

    tag: str
    node: int
    level: int
    furniture: bool
    inside: bool
    weak: tuple[int, ...]
    holders: tuple[int, ...]
    heading: bool


TOP = Element("", ROOT, 0, False, False, (), (), False)


def read_page(page: str) -> tuple[list[tuple[int, str, bool]], dict[int, str], dict[int, int]]:
    """Text blocks (node, text, furniture) in order, the child sequence and the parent of every block node.

    Of weak branches or articles nested in each other more than 64 deep the inner ones count as one.
    """
    blocks: list[Block] = []
    children: dict[int, list[str]] = {}
    parents: dict[int, int] = {}
    stack: list[Element] = []
    opened: Counter[str] = Counter()  # tags on the stack
    chains: dict[int, tuple[int, ...]] = {}
    named: set[int] = set()
    numbers = itertools.count()
    text: list[str] = []

    def end_block() -> None:
        words = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if words:
            at = stack[-1] if stack else TOP
            blocks.append(Block(at.node, words, at.furniture, at.weak, at.holders, at.heading))

    def drop(k: int) -> None:
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    def open_(tag: str, rest: str) -> None:
        if tag in BLOCKS:
            end_block()
            close_implied(("p",))
        if tag in CLOSES:
            close_implied(CLOSES[tag])
        _, node, level, furniture, inside, weak, holders, heading = stack[-1] if stack else TOP
        label, own, name = label_of(tag, rest, inside)
        if tag in ("article", "main"):
            if len(holders) < MOST_DEPTH:
                holder = next(numbers)
                holders, chains[holder] = (*holders, holder), weak
                named.update([holder] if name else [])
        elif name and tag not in WHOLE and len(weak) < MOST_DEPTH:
            weak = (*weak, next(numbers))
        if tag in BLOCKS or own or (name and tag not in WHOLE):
            if tag not in BLOCKS:
                end_block()
            seen = children.setdefault(node, [])
            if not seen or seen[-1] != label:
                seen.append(label)
            level += 1
            if level <= MOST_DEPTH:
                above, node = node, node_key(node, label)
                parents[node] = above
        opened[tag] += 1
        stack.append(Element(tag, node, level, furniture or own, bool(holders), weak, holders, heading or tag == "h1"))

    def close_implied(tags: tuple[str, ...]) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                end_block()
                drop(k)
            elif stack[k].tag in SCOPE:
                return

    def close(tag: str) -> None:
        if not opened[tag]:
            return
        k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag)
        if stack[-1].level != (stack[k - 1].level if k else 0):
            end_block()
        drop(k)

    at, lower = 0, None
    while found := MARKUP.search(page, at):
        text.append(page[at : found.start()])
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        if found["end"] or found["end2"]:
            close(tag)
        elif tag in RAW:
            lower = page.lower() if lower is None else lower
            stop = lower.find(f"</{tag}", at)
            stop = page.find(">", stop) if stop >= 0 else -1
            at = stop + 1 if stop >= 0 else len(page)
        elif tag in VOID:
            if tag == "hr":
                end_block()
            text.append(" ")
        else:
            open_(tag, found["rest"] or found["rest2"] or "")
    text.append(page[at:])
    end_block()
    cut = cut_names(blocks, chains, named)
    read = [(b.node, b.text, b.furniture or not cut.isdisjoint(b.weak)) for b in blocks]
    return read, {node: " ".join(labels) for node, labels in children.items()}, parents


BLOCK = "struct<node:bigint,text:string,furniture:boolean,first:boolean,line:array<bigint>>"
STYLE = "struct<node:bigint,style:string>"
_ARROW = pa.struct(
    [
        (
            "blocks",
            pa.list_(
                pa.struct(
                    [("node", pa.int64()), ("text", pa.string()), ("furniture", pa.bool_()), ("first", pa.bool_()), ("line", pa.list_(pa.int64()))]
                )
            ),
        ),
        ("styles", pa.list_(pa.struct([("node", pa.int64()), ("style", pa.string())]))),
    ]
)


def line_of(node: int, parents: dict[int, int]) -> list[int]:
    """The node and all nodes above it, the root last."""
    line = [node]
    while line[-1] != ROOT:
        line.append(parents[line[-1]])
    return line


def parse(page: Column) -> Column:
    """Blocks and node styles of a page (null: none).

    ``first`` marks a text's first block at its node; the first block of a node has its ``line``.
    """
    result = T.StructType.fromDDL(f"blocks array<{BLOCK}>, styles array<{STYLE}>")

    def rows(pages: pa.Array) -> Iterator[dict]:
        for value in pages:
            blocks, styles, parents = read_page((value.as_py() or b"").decode("utf-8", "replace"))
            seen, nodes, out = set(), set(), []
            for node, text, furniture in blocks:
                line = None if node in nodes else line_of(node, parents)
                out.append({"node": node, "text": text, "furniture": furniture, "first": (node, text) not in seen, "line": line})
                seen.add((node, text))
                nodes.add(node)
            yield {"blocks": out, "styles": [{"node": n, "style": s} for n, s in styles.items()]}

    @F.arrow_udf(result)
    def read(pages: pa.Array) -> pa.Array:
        return pa.array(list(rows(pages)), type=_ARROW)

    return read(page.cast("binary"))


def copy_key(blocks: Column) -> Column:
    """Equal for pages that show the same blocks outside page furniture, or are all furniture and equal."""
    shown = lambda chosen: F.xxhash64(F.transform(chosen, lambda b: F.struct(b["node"], b["text"])))
    content = F.filter(blocks, lambda b: ~b["furniture"])
    return F.when(F.size(content) > 0, shown(content)).otherwise(shown(blocks))


def cut_nodes(pages: DataFrame, least: float, least_pages: int, damping: float) -> DataFrame:
    """(host, node): nodes with text in a branch of the style tree whose combined importance is below ``least``.

    ``pages``: host, copy, blocks, styles. Pages of one host with the same ``copy`` count once, so that
    the entropies measure different pages. Texts are counted by (host, node, text hash) before anything is
    gathered by node, so a host with most of the pages is spread over its texts. Nodes on fewer than
    ``least_pages`` pages are not judged, nor is a host whose root is low: its pages are copies of
    each other, and then the entropies tell nothing.
    """
    blocks = pages.select("host", "copy", F.inline("blocks"))
    seen = blocks.where("first").withColumn("opens", F.col("line").isNotNull())
    once = seen.groupBy("host", "node", F.xxhash64("text").alias("key"), "copy").agg(F.max("opens").alias("opens"))
    counts = once.groupBy("host", "node", "key").agg(F.count("*").alias("n"), F.count_if("opens").alias("pages"))
    nodes = counts.groupBy("host", "node").agg(
        F.sum(F.log("n")).alias("logs"), F.count("*").alias("texts"), F.sum("pages").alias("pages")
    )
    lines = saved(blocks.select("host", "node", F.explode("line").alias("branch")).distinct(), "lines")
    # entropy of a text on n of m pages: log n / log m
    entropy = F.when(F.col("pages") > 1, F.col("logs") / F.log("pages")).otherwise(0.0)
    branch = lines.join(nodes.select("host", "node", entropy.alias("entropy"), "texts", "pages"), ["host", "node"])
    content = branch.groupBy("host", "branch").agg(
        (1 - F.sum("entropy") / F.sum("texts")).alias("content"), F.max("pages").alias("pages")
    )
    styles = pages.select("host", "copy", F.inline("styles")).distinct().groupBy("host", "node", "style").count()
    shown = styles.groupBy("host", F.col("node").alias("branch")).agg(
        F.sum("count").alias("m"), F.sum(F.col("count") * F.log("count")).alias("s"), F.count("*").alias("kinds")
    )
    # -sum p log_m p = log m - (sum c log c) / m, over log m
    varied = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    shown = shown.select("host", "branch", varied.alias("presentation"), "kinds")
    weight = F.pow(F.lit(damping), F.coalesce("kinds", F.lit(0)))
    both = content.join(shown, ["host", "branch"], "left")
    scored = both.withColumn(
        "importance", (1 - weight) * F.coalesce("presentation", F.lit(0.0)) + weight * F.col("content")
    )
    judged = (F.col("importance") < least) & (F.col("pages") >= least_pages)
    low = saved(scored.where(judged).select("host", "branch"), "low")
    copied = low.where(F.col("branch") == ROOT).select("host")
    return lines.join(low.join(copied, "host", "left_anti"), ["host", "branch"]).select("host", "node").distinct()


def main_text(
    df: DataFrame,
    url_col: str,
    html_col: str,
    least: float = 0.3,
    least_pages: int = 5,
    damping: float = 0.9,
) -> DataFrame:
    """All columns of ``df`` but the html, with ``text``: the main text of every page, blocks by LF.

    Null and empty pages have an empty text. Pages without a readable host form one site. Equal rows
    and repeated or null ids stay pages of their own; a column named ``text`` is replaced; an empty
    table gives none. A page is parsed once, whole, and its blocks are written.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    keep = [c for c in df.columns if c not in (html_col, "text")]
    parsed = df.select(
        F.struct(*keep).alias("row"), host.alias("host"), parse(F.col(html_col)).alias("page")
    ).select("row", "host", "page.*")
    pages = saved(parsed, "pages")
    low = cut_nodes(pages.withColumn("copy", copy_key(F.col("blocks"))), least, least_pages, damping)
    cuts = saved(low.groupBy("host").agg(F.collect_set("node").alias("cuts")), "cuts")
    own = F.transform(F.filter("blocks", lambda b: b["line"].isNotNull()), lambda b: b["node"])
    here = F.array_intersect(own, F.coalesce("cuts", F.array().cast("array<bigint>")))
    outside = lambda cut: F.filter("blocks", lambda b: ~b["furniture"] & ~F.array_contains(cut, b["node"]))
    left = F.element_at(F.transform(F.array(here), outside), 1)  # a bound variable, so that it is made once a page
    text = F.array_join(F.transform(left, lambda b: b["text"]), "\n")
    made = pages.join(cuts, "host", "left").withColumn("made", text)
    return made.select("row.*", F.col("made").alias("text"))
