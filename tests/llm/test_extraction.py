"""Personal data and pages."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from agroseries.llm import pages, pii
from tests.llm.helpers import awkward, clashing, empty

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    """The four patterns as they are stated, one after the other."""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_against_the_patterns(spark):
    rng = random.Random(6)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "999.1.1.1", "007.1.2.3", "+1 (555) 123-4567", "4111 1111 1111 1111", "12", "-", " ", "x", "%", "+", "\n", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    texts += ["a" * 50_000 + "@", "1" * 20_000, "a.b@c.d@e.f.g", "1.2.3.4.5.6.7.8", "+" * 5000]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text) if len(text) < 20_000 else pii.base_spans(text) is not None


def test_contexts_lead_to_unseen_identifiers(spark):
    rows = [(i, f"Reach us by phone at +1 (555) 010-{1000 + i} during the day") for i in range(8)]
    rows += [(100, "Reach us by phone at 555-010-2000 during the day"), (101, "in the year 20001234 nothing was seen"), (102, None)]
    rows += [(103, "Reach us by phone at 555-010-2000 during the day")]
    found = pii.find(spark.createDataFrame(rows, "doc_id int, text string"), "text")
    got = {r["doc_id"]: r for r in found.withColumn("list", pii.listed(F.col("spans"))).collect()}
    assert got[100]["list"] == got[103]["list"] == "phone:21:33" and got[100]["base"] == []
    assert got[101]["list"] == "" and got[102]["list"] == "" and got[0]["list"] == "phone:21:38"


def test_mixed_contexts_are_not_trusted(spark):
    rows = [(i, f"the number is {x} now") for i, x in enumerate(["+1 (555) 010-1000", "1.2.3.4", "a@b.cd", "+1 (555) 010-1001", "20001234"] * 6)]
    found = pii.find(spark.createDataFrame(rows, "doc_id int, text string"), "text")
    assert found.where(F.size("spans") > F.size("base")).count() == 0


def test_trust_is_a_share_in_every_round(spark):
    rows = [f"reach them by phone +1 (555) 010-{1000 + i} today" for i in range(30)]
    unseen = [f"555-010-{2000 + i}" for i in range(12)]
    rows += [f"reach them by phone {x} today" for x in unseen]  # 30 / (30 + 12 / 4) is over 0.9
    rows += [f"kept under entry {x} since" for x in [*unseen, *(f"3300{i:05d}" for i in range(33))]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    got = {r["text"]: len(r["spans"]) for r in pii.find(df, "text").collect()}
    assert all(got[f"{a} {x} {b}"] == 1 for x in unseen for a, b in (("reach them by phone", "today"), ("kept under entry", "since")))
    assert sum(got.values()) == 30 + 12 * 2


def test_unseen_numbers_with_blanks_are_found_whole(spark):
    rows = [f"Reach us by phone at +1 (555) 010-{1000 + i} during the day" for i in range(40)]
    cards = [x for x in (f"4111 1111 1111 {i:04d}" for i in range(1000, 1100)) if pii.luhn(x.replace(" ", ""))]
    rows += [f"It was charged to card {x} last week" for x in cards[:8]]
    phones = ["555 010 2000", "020 7946 0958", "(555) 010-2000", "555-010-2000", "555 - 010 (2000)"]
    rows += [f"Reach us by phone at {x} during the day" for x in phones] + ["Reach us by phone at 020 7946 0958."]
    rows += ["It was charged to card 4111 1111 1111 1112 last week", "Reach us by phone at 555-010-2000 20240101 is a date"]
    rows += ["in the years 2001 2002 2003 nothing was seen", "Reach us by phone at 020 7946\n0958 people"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    found = pii.find(df, "text").withColumn("clean", pii.redact(F.col("text"), F.col("spans")))
    clean = [r["clean"] for r in found.orderBy("doc_id").collect()]
    assert clean[:40] + clean[48:53] == ["Reach us by phone at <PHONE> during the day"] * 45
    assert clean[53] == "Reach us by phone at <PHONE>."
    assert clean[40:48] + clean[54:55] == ["It was charged to card <CARD> last week"] * 9
    assert clean[55] == "Reach us by phone at <PHONE> 20240101 is a date"
    assert clean[56] == rows[56] and "0958 people" in clean[57]


def test_redaction_and_awkward_rows(spark):
    df = spark.createDataFrame([(1, "é a@b.cd, 1.2.3.4!"), (2, None), (3, "")], "doc_id int, text string")
    found = pii.find(df, "text").withColumn("clean", pii.redact(F.col("text"), F.col("spans")))
    assert {r["doc_id"]: r["clean"] for r in found.collect()} == {1: "é <EMAIL>, <IP>!", 2: None, 3: ""}
    odd = clashing(awkward(spark), ["spans", "base", "mentions", "value", "kind", "pattern"])
    assert pii.find(odd, "text").count() == 8 and pii.find(empty(spark), "text").count() == 0


def texts_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r["page_id"]: r["text"] for r in pages.main_text(df, "url", "html").collect()}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "</p><p>no";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>old</p> --><div class="x7">Same on   all pages</div>
<div class="site-ad">Buy {n}</div><article><h1>Title {n}</h1><p><b>First &amp; {n}<br><p>Second&nbsp;line
 goes on</p><form><p>Search</p></form><ul><li>one<li>two {n}</ul><p data-x="a > b" hidden>gone</p></article>
<section id="comments"><p>I like {n}</p></section><footer>&copy; {n}</footer></body></html>"""


def test_style_tree_cuts_what_all_pages_repeat(spark):
    rows = [(n, "https://a.example/p", PAGE.replace("{n}", f"n{n}")) for n in range(8)]
    rows += [(100, "https://b.example/p", PAGE.replace("{n}", "alone"))]
    got = texts_of(spark, rows)
    assert got[3] == "Title n3\nFirst & n3\nSecond line goes on\none\ntwo n3"
    assert got[100] == "Same on all pages\nTitle alone\nFirst & alone\nSecond line goes on\none\ntwo alone"


def test_copies_of_one_page_keep_their_text(spark):
    got = texts_of(spark, [(n, "http://c.example/", "<p>only text</p>") for n in range(20)])
    assert set(got.values()) == {"only text"}


def test_copies_of_one_article_among_others_keep_their_blocks(spark):
    page = "<body><nav>Menu</nav><div class='bar'>On all pages</div><article><h1>Title {n}</h1><p>Text {n}</p>{more}</article></body>"
    once = "<blockquote>quoted</blockquote><table><tr><td>cell</td></tr></table><h4>small</h4>"
    rows = [(n, f"http://d.example/{n}", page.format(n=n, more="")) for n in range(12)]
    rows += [(n, f"http://d.example/a?from={n}", page.format(n="copied", more=once)) for n in range(100, 105)]
    rows += [(105, "http://d.example/print", page.format(n="copied", more=once).replace("<nav>Menu</nav>", "<nav>Print</nav>"))]
    got = texts_of(spark, rows)
    assert [got[n] for n in range(12)] == [f"Title {n}\nText {n}" for n in range(12)]
    assert {got[n] for n in range(100, 106)} == {"Title copied\nText copied\nquoted\ncell\nsmall"}


def test_names_and_forms_do_not_cut_the_article():
    body = "<h1>Title</h1><p>The first paragraph</p><p>The second one</p>"
    said = ["Title", "The first paragraph", "The second one"]
    left = lambda page: [text for _, text, furniture in pages.read_page(page)[0] if not furniture]
    for name in ('div id="page" class="has-sidebar"', 'div class="post comments-open"', 'section class="no-banner"', "form action='x.aspx'"):
        tag = name.split()[0]
        for held in (body, f"<article>{body}</article>", f"<main>{body}</main>", f"<div class='widgets'>{body}</div>"):
            assert left(f"<body><nav>Menu</nav><{name}>{held}</{tag}><div class='ad'>Buy</div></body>") == said, (name, held)
        assert left(f"<article><h1>Title</h1><{name}><p>The first paragraph</p><p>The second one</p></{tag}></article>") == said
        assert left(f"<h1>Title</h1><{name}><p>The first paragraph</p><p>The second one</p></{tag}>") == said
    comments = "<section id='comments'><article class='comment'><p>I like this a lot, and I say so at length here</p></article></section>"
    assert left(f"<div class='has-sidebar'><article>{body}</article>{comments}</div>") == said
    related = "<div class='related'><article><h1>Another</h1><p>Teaser</p></article></div>"
    assert left(f"<article>{body}<form><p>Search</p></form></article>{related}{comments}") == said


def test_given_pages_give_their_article(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in pages.main_text(df, "url", "html").collect()}
    import html

    for r in df.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)


def test_broken_markup_and_awkward_rows(spark):
    rows = [
        (1, None, None), (2, "", ""), (None, "no url", "plain text"), (4, "http://x/", "<p>a <b>b</p> c <div>d"),
        (4, "http://x/", "<p>a <b>b</p> c <div>d"), (5, "http://x/", "<" * 3000), (6, "http://x/", "<p title='open>x</p> y"),
        (7, "http://x/", "<table><tr><td>1<td>2<tr><td>3</table><script>never closed <p>x"), (8, "http://x/", "x &lt;p&gt; &#233;&eacute;" + "y" * 200_000),
    ]
    df = clashing(spark.createDataFrame(rows, "page_id bigint, url string, html string"), ["text", "host", "blocks", "path", "row"])
    out = pages.main_text(df, "url", "html").collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == 9 and got[1] == "" and got[2] == "" and got[None] == "plain text"
    assert got[4] == "a b\nc\nd" and got[7] == "1\n2\n3" and got[8].startswith("x <p> éé") and len(got[8]) == 200_008
    assert pages.main_text(df.limit(0), "url", "html").count() == 0


def looped_cuts(texts, least=0.3, least_pages=5, damping=0.9):
    """Nodes to cut of one host, from its pages, one node at a time."""
    read, seen = [], set()
    for text in texts:
        blocks, styles, parents = pages.read_page(text)
        key = tuple((n, t) for n, t, furniture in blocks if not furniture) or tuple((n, t) for n, t, _ in blocks)
        if key not in seen:
            seen.add(key)
            read.append((blocks, styles, parents))
    entropies, n_pages, below, shown = {}, {}, {}, {}
    for blocks, styles, parents in read:
        for node, text in {(n, t) for n, t, _ in blocks}:
            entropies.setdefault(node, Counter())[text] += 1
        for node in {n for n, _, _ in blocks}:
            n_pages[node] = n_pages.get(node, 0) + 1
            at = node
            while True:
                below.setdefault(at, set()).add(node)
                if at == pages.ROOT:
                    break
                at = parents[at]
        for node, style in styles.items():
            shown.setdefault(node, Counter())[style] += 1
    low = set()
    for branch, nodes in below.items():
        content = 1 - sum(
            sum(math.log(n) for n in entropies[x].values()) / math.log(n_pages[x]) if n_pages[x] > 1 else 0.0 for x in nodes
        ) / sum(len(entropies[x]) for x in nodes)
        kinds = shown.get(branch, Counter())
        m = sum(kinds.values())
        varied = -sum(c / m * math.log(c / m) for c in kinds.values()) / math.log(m) if m > 1 else float(m == 1)
        weight = damping ** len(kinds)
        if (1 - weight) * varied + weight * content < least and max(n_pages[x] for x in nodes) >= least_pages:
            low.add(branch)
    return set() if pages.ROOT in low else {node for branch in low for node in below[branch]}


def test_entropies_against_a_loop(spark):
    rng = random.Random(4)
    rows, cut = [], 0
    for host in range(6):
        for page in range(14):
            parts = []
            for name in range(5):
                text = f"same {name}" if rng.random() < (0.9, 0.5, 0.2, 0.95, 0)[name] else f"own {page} {name}"
                inner = "".join(f"<p>{text}</p>" for _ in range(rng.choice((1, 1, 2))))
                parts.append(f'<div class="k{"abcde"[name]}">{inner}</div>' if rng.random() < 0.9 else "")
            rows.append((page, f"http://h{host}.org/{page}", f"<html><body>{''.join(parts)}<section>{page if page % 3 else 0}</section></body></html>"))
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    parsed = df.select(F.regexp_extract("url", "//([^/]*)", 1).alias("host"), pages.parse(F.col("html")).alias("page"))
    parsed = parsed.select("host", "page.*").withColumn("copy", pages.copy_key(F.col("blocks")))
    got = {(r["host"], r["node"]) for r in pages.cut_nodes(parsed, 0.3, 5, 0.9).collect()}
    want = set()
    for host in range(6):
        want |= {(f"h{host}.org", n) for n in looped_cuts([h for _, u, h in rows if f"//h{host}." in u])}
    assert got == want and want


def test_very_deep_pages(spark):
    n = 100_000
    deep = [
        "".join(f'<div class="a">{k} ' for k in range(n)),
        "<div>" * n + "x" + "</div>" * n + "y",
        '<div class="ad">' * n + "x" + "</span>" * n,
        "<article class=menu>" * n + "x" + "<p>y" * n,
        "<span><p>" * n + "z",
    ]
    df = spark.createDataFrame([(k, "http://deep.org/", h) for k, h in enumerate(deep)], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.main_text(df, "url", "html").collect()}
    assert got[0] == "\n".join(map(str, range(n)))
    assert got[1] == "x\ny" and got[4] == "z"
    assert got[3].count("y") == n
    nodes = {b["node"] for b in df.where("page_id = 0").select(F.inline(pages.parse(F.col("html"))["blocks"])).collect()}
    assert len(nodes) == pages.MOST_DEPTH
