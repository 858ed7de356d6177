"""Main text of web pages from flat text blocks (operator 1).

A page is cut into blocks of text at block-level tags. Each block has its word count and link density, those of the
blocks before and after it, and those of the innermost container it lies in, set against the page. A decision tree,
trained on the small labelled table below, says which blocks are the article. What tags and class names say of a container
is a further feature of a block, and half of the labelled pages say nothing there: names help where counts cannot tell.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.llm.batches import bound_batches


# A tag's attributes hold no "<" outside quotes, so a search never goes far beyond the next one.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?/][^<>]*+>", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden|href)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
MOST_OPEN = 512  # containers kept open at a time; deeper ones still cut blocks, as parsers of browsers have it

RAW = frozenset("script style title textarea noscript template iframe svg math object noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "strike strong sub sup time tt u var wbr img".split())
PLAIN_INLINE = INLINE - {"label"}
ENDS_ALONE = {"p": frozenset(), "li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)),
              "td": frozenset(("table", "tr")), "th": frozenset(("table", "tr")), "tr": frozenset(("table",)),
              "option": frozenset(("select",))}
GROUPS = frozenset("article aside body center dialog div footer form header main menu nav ol section table ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# What a container says about the text in it.
NOTHING, ARTICLE, FURNITURE, NEVER, REPLIES = range(5)
TAGS = {"article": ARTICLE, "main": ARTICLE, "header": FURNITURE, "form": FURNITURE, "fieldset": FURNITURE, "menu": REPLIES,
        "nav": REPLIES, "aside": REPLIES, "footer": REPLIES, "dialog": REPLIES, "button": REPLIES, "select": REPLIES, "label": REPLIES,
        "option": REPLIES, "datalist": REPLIES, "head": REPLIES}
WORDS = dict.fromkeys("article content post entry story main body text articlebody".split(), ARTICLE) | dict.fromkeys(
    "sidebar header banner masthead topbar toolbar layout wrapper".split(), FURNITURE) | dict.fromkeys(
    "nav navbar navigation menu breadcrumb breadcrumbs footer ad ads advert adverts advertisement sponsor sponsored promo promotion "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe "
    "signup login search share sharing social related recommended widget tags pagination pager skip copyright legal disclaimer form "
    "complementary contentinfo dialog hidden".split(), NEVER) | dict.fromkeys("comment comments reply replies respond disqus".split(), REPLIES)
LABELS = frozenset("category tag has is no with js type status format theme page".split())  # what follows them names a topic or state


@dataclass
class Block:
    text: str
    words: int
    linked: int
    says: int
    heading: bool
    container: int  # number of the innermost container


def _name_says(name: str) -> tuple[int, int]:
    """(what a class name says, how plainly): a listed word as such, as the last part, or as the first one."""
    if name in WORDS:
        return WORDS[name], 3
    parts = [x for x in re.split(r"[_\-]+", name) if x]
    if len(parts) < 2 or parts[0] in LABELS:
        return NOTHING, 0
    if parts[-1] in WORDS:
        return WORDS[parts[-1]], 2
    return (WORDS[parts[0]], 1) if parts[0] in WORDS else (NOTHING, 0)


def _says(tag: str, attributes: str) -> int:
    """What a tag and the words of its class, id and role say. An article tag or word outranks words of furniture, unless
    a name as a whole is a word for readers' replies."""
    own = TAGS.get(tag, NOTHING)
    if tag in ("html", "body") or not attributes or "=" not in attributes and "hidden" not in attributes:
        return own
    heard = {}
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            for word in value.split():
                says, plain = _name_says(word)
                heard[says] = max(heard.get(says, 0), plain)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return REPLIES
    if heard.get(REPLIES, 0) == 3:
        return REPLIES
    if own == ARTICLE or own == NOTHING and ARTICLE in heard:
        return ARTICLE
    return own or next((says for says in (REPLIES, NEVER, FURNITURE) if says in heard), NOTHING)


def _inherit(outer: int, own: int, tag: str) -> int:
    """What holds inside: a tag for articles undoes what a class name around it said, not what a tag or replies say."""
    if outer == REPLIES or own == NOTHING or (outer == ARTICLE and own == FURNITURE):
        return outer
    if outer == NEVER:
        return own if own == REPLIES or tag in ("article", "main") else outer
    return own


def blocks(html: str | None) -> list[Block]:
    """The text blocks of a page in order. Scripts, styles, comments and the like hold no text."""
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int]] = []
    opened: Counter[str] = Counter()
    containers = 0
    pieces: list[str] = []
    linked = 0
    in_link = False

    def close() -> None:
        nonlocal linked
        words = "".join(pieces).split()
        if words:
            _, says, heading, container = stack[-1] if stack else ("", NOTHING, False, 0)
            out.append(Block(" ".join(words), len(words), min(linked, len(words)), says, heading, container))
        pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text.split())

    at, found = 0, TOKEN.search(html)
    while found:
        add(html[at:found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if tag:
            ending = found[1] or found[4]
            if tag == "a":
                in_link = not ending and "href" in (found[3] or found[6] or "").lower()
            if tag in PLAIN_INLINE:
                pass
            elif tag in VOID:
                if tag in ("br", "hr"):
                    close()
            elif ending:
                if opened[tag]:
                    if tag != "span" or stack[-1][1] != (stack[-2][1] if len(stack) > 1 else NOTHING):
                        close()
                    while True:
                        gone = stack.pop()[0]
                        opened[gone] -= 1
                        if gone == tag:
                            break
                elif tag != "span":
                    close()
            else:
                attributes = found[3] or found[6] or ""
                own = _says(tag, attributes)
                if tag in RAW:
                    close() if tag in ("textarea", "noscript") else None
                    end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.IGNORECASE).search(html, at)
                    at = end.end() if end else len(html)
                elif tag == "span" and own == NOTHING:
                    if len(stack) < MOST_OPEN:
                        outer = stack[-1] if stack else ("", NOTHING, False, 0)
                        stack.append((tag, *outer[1:]))
                        opened[tag] += 1
                else:
                    close()
                    if tag != "span" and tag in ENDS_ALONE or any(x[0] == "p" for x in stack[-3:]):
                        for name in ({tag} & ENDS_ALONE.keys()) | {"p"}:
                            for depth in range(len(stack) - 1, -1, -1):
                                if stack[depth][0] == name:
                                    opened.subtract(x[0] for x in stack[depth:])
                                    del stack[depth:]
                                    break
                                if stack[depth][0] in ENDS_ALONE[name] or stack[depth][0] in ("div", "section", "article", "body", "table", "aside", "blockquote"):
                                    break
                    outer = stack[-1] if stack else ("", NOTHING, False, 0)
                    if (not attributes.endswith("/") or tag not in TAGS) and len(stack) < MOST_OPEN:
                        says = _inherit(outer[1], own, tag)
                        if tag in GROUPS or says != outer[1]:
                            containers += 1
                            outer = (*outer[:3], containers)
                        stack.append((tag, says, outer[2] or tag in HEADINGS, outer[3]))
                        opened[tag] += 1
        found = TOKEN.search(html, at)
    add(html[at:])
    close()
    return out


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after",
            "container's share of the page", "container's link density", "what the container says", "heading")
SAID = {NOTHING: 0.0, ARTICLE: 1.0, FURNITURE: -1.0, NEVER: -2.0, REPLIES: -2.0}


def features(page: list[Block]) -> list[list[float]]:
    """The features of each block, in the order of FEATURES; nothing lies before the first and after the last."""
    own = [(float(min(b.words, 200)), b.linked / b.words) for b in page]
    edge = [(0.0, 0.0)]
    words, linked, total = Counter(), Counter(), max(1, sum(b.words for b in page))
    for b in page:
        words[b.container] += b.words
        linked[b.container] += b.linked
    return [[*own[i], *before, *after, words[b.container] / total, linked[b.container] / words[b.container], SAID[b.says], float(b.heading)]
            for i, (b, before, after) in enumerate(zip(page, edge + own, own[1:] + edge))]


# The labelled table: pages of our own, {n} stands for n filler words; blocks that open with + are article text.
LABELLED = (
    "<nav><ul><li><a href=x>{2}</a><li><a href=x>{1}</a></ul></nav><article><h1>+{8}</h1><p>+{60}<p>+{3}<p>+{25}</article><footer>{12}</footer>",
    "<header><h1>{4}</h1><p>{30}</p></header><main><h2>+{5}</h2><p>+{80}</p><p>+{12} <a href=x>{3}</a> {5}</p><aside><p>{40}</p></aside></main>",
    "<div class=menu><a href=x>{1}</a> <a href=x>{2}</a></div><div class=content><p>+{45}</p><ul><li>+{6}<li>+{7}</ul><p>+{2}</p></div><div id=comments><p>{50}</p><p>{7}</p></div>",
    "<div><a href=x>{2}</a></div><div><a href=x>{3}</a></div><div><p>+{70}</p><p>+{55}</p><p>+{40}</p></div><div><a href=x>{4}</a></div><div>{4}</div>",
    "<table><tr><td><a href=x>{1}</a><td><a href=x>{2}</a></table><p>+{90}</p><p>+{30}</p><p>+{100}</p><p>{5}</p><p><a href=x>{6}</a></p>",
    "<div class=cookie-notice><p>{35}</p><button>{1}</button></div><article><header><h1>+{7}</h1></header><p>+{20}</p><blockquote>+{15}</blockquote><p>+{1}</p></article>",
    "<form><label>{2}</label><p>{22}</p></form><div class=post><h2>+{3}</h2><p>+{33}</p></div><div class=related><a href=x>{8}</a><p>{28}</p></div>",
    "<div class=ad>{20}</div><article><p>+{5}</p><p>+{1}</p></article><div class=sidebar><p>{45}</p><h3>{2}</h3></div><footer><p>{60}</p></footer>",
    "<div><a href=x>{1}</a> {1} <a href=x>{1}</a></div><p>+{35}</p><p>+{28}</p><p>+{65}</p><div>{2}</div><div>{3}</div>",
    "<div>{3}</div><div>{2}</div><h1>+{6}</h1><p>+{48}</p><p>+{52}</p><h2>+{4}</h2><p>+{75}</p><div>{3}</div><div><a href=x>{2}</a></div><div>{1}</div>",
    "<article><p>+{120}</p><div class=share><a href=x>{1}</a></div><p>+{10}</p></article><section class=comments><article><p>{60}</p></article><article><p>{8}</p></article></section>",
    "<div class=sidebar-layout><article><h1>+{2}</h1><p>+{18}</p><p>+{150}</p></article></div><div class=newsletter><p>{26}</p><form><p>{4}</p></form></div>",
    "<p>{1}</p><p><a href=x>{5}</a></p><p><a href=x>{4}</a></p><p>{2}</p><p>+{22}</p><p>+{44}</p><p>+{31}</p><p><a href=x>{3}</a> {1}</p>",
    "<main><p>+{2}</p><p>+{4}</p><p>+<a href=x>{9}</a></p><p>+{3}</p></main><footer><a href=x>{2}</a> {9}</footer>",
    "<article><p>+{30}</p><p>+<a href=x>{10}</a> {10}</p><p>+{8} <a href=x>{4}</a></p><p>+{40}</p><p>+{9} <a href=x>{6}</a></p></article>",
    "<main><h1>+{6}</h1><p>+{12} <a href=x>{8}</a></p><p>+{50}</p><p>+<a href=x>{7}</a></p><p>+{20} <a href=x>{15}</a></p><p>+{33}</p></main>",
    "<nav><a href=x>{3}</a> {12}</nav><p>+{80}</p><p>+{60}</p><footer>{15}</footer>",
    "<div class=ad>{14}</div><div><p>+{95}</p></div><div class=notice>{10}</div><p>+{70}</p><p>+{6}</p><p>+{66}</p><div class=comments>{12}</div>",
    "<header><p>{9}</p></header><p>+{64}</p><p>+{5}</p><p>+{80}</p><p>+{9}</p><p>+{55}</p><aside>{18}</aside><p>+{58}</p>",
    "<div class=cookie>{25}</div><h1>+{5}</h1><p>+{50}</p><div class=related>{6}</div><p>+{45}</p><footer>{30}</footer>",
    "<form><p>{12}</p></form><h2>+{4}</h2><p>+{75}</p><h2>+{3}</h2><p>+{35}</p><p>+{4}</p><p>+{90}</p><menu><p>{8}</p><p>{40}</p></menu>",
    "<aside><p>{70}</p><p>{80}</p></aside><p>+{85}</p><div class=promo><p>{30}</p><p>{60}</p></div><p>+{40}</p>",
    "<nav><a href=x>{2}</a></nav><article><h1>+{3}</h1><p>+{300}</p><p>+{2}</p><p>+{4}</p><p>+{1}</p><p>+{5}</p></article><footer>{5}</footer>",
    "<article><p>+{1}</p><p>+{150}</p><p>+{3} <a href=x>{2}</a></p><p>+<a href=x>{4}</a></p><p>+{2}</p></article><div class=ad>{3}</div>",
    "<main><p>+{400}</p><p>+{3}</p><p>+<a href=x>{1}</a></p><p>+{5}</p><p>+<a href=x>{30}</a></p></main><footer>{4}</footer>",
    "<div class=entry><p>+{5}</p><p>+{2}</p><p>+{90}</p><p>+<a href=x>{12}</a></p><p>+<a href=x>{40}</a></p></div>",
    "<div class=post><p>+{4}</p><p>+<a href=x>{5}</a> {1}</p><p>+<a href=x>{3}</a></p></div><div class=footer>{3}</div>",
    "<article><p>+{2}</p><p>+{3}</p></article><footer>{14}</footer>",
    "<aside><p>{300}</p><p>{3}</p><p><a href=x>{9}</a></p></aside><article><p>+{9}</p></article>",
    "<div class=comments><p>{90}</p><p>{120}</p><p>{8}</p></div><article><p>+{40}</p><p>+{12}</p></article><div class=ad><p>{150}</p></div>",
    "<article><h1>+<a href=x>{6}</a></h1><ul><li>+<a href=x>{3}</a><li>+<a href=x>{4}</a></ul><p>+{14}</p></article><header><p>{16}</p></header>",
)
# More of them that say nothing in tags or names: here only counts and densities can tell.
UNNAMED = (
    "<div><a href=x>{2}</a> <a href=x>{1}</a></div><div><h1>+{6}</h1><p>+{62}</p><p>+{4}</p><p>+{38}</p></div><div>{6}</div><div><a href=x>{3}</a></div>",
    "<ul><li><a href=x>{1}</a><li><a href=x>{2}</a><li><a href=x>{1}</a></ul><div>{9}</div><div><p>+{54}</p><p>+{90}</p><p>+{12}</p></div><div>{11}</div>",
    "<div>{14}</div><div><h1>+{5}</h1><p>+{120}</p><p>+{30}</p><ul><li>+{8}<li>+{5}<li>+{9}</ul><p>+{45}</p></div><div>{3} <a href=x>{4}</a></div>",
    "<div><a href=x>{4}</a></div><div><p>+{40}</p><p>+{2}</p><p>+{70}</p><p>+{20} <a href=x>{5}</a> {9}</p></div><div><p>{10}</p><a href=x>{9}</a></div><div>{4}</div>",
    "<table><tr><td><a href=x>{2}</a><td>{2}</table><div><h2>+{4}</h2><p>+{33}</p><h2>+{3}</h2><p>+{47}</p><h2>+{5}</h2><p>+{28}</p></div><p>{2} <a href=x>{2}</a></p>",
    "<div><a href=x>{3}</a> {8} <a href=x>{6}</a></div><div><p>+{25}</p><p>+{85}</p><p>+{6}</p><p>+{1}</p><p>+{110}</p></div><ul><li><a href=x>{9}</a><li><a href=x>{12}</a></ul>",
    "<div>{1}</div><div>{7}</div><div><h1>+{9}</h1><p>+{200}</p><p>+{150}</p></div><div><a href=x>{20}</a></div><div>{12}</div>",
    "<div><a href=x>{1}</a></div><div>{12}</div><div><p>+{200}</p><p>+{9}</p><p>+{200}</p><p>+{15}</p><p>+{200}</p></div><div>{13}</div>",
    "<ul><li><a href=x>{2}</a><li><a href=x>{2}</a></ul><div><h1>+{7}</h1><p>+{20}</p><p>+{60}</p><p>+{18}</p></div><div>{15}</div>",
    "<div><p>+{65}</p><p>+{30} <a href=x>{12}</a> {20}</p><p>+{80}</p></div><div><a href=x>{5}</a> <a href=x>{4}</a> {3}</div><div>{8}</div>",
    "<p><a href=x>{3}</a></p><p>{3}</p><p>+{44}</p><p>+{96}</p><p>+{7}</p><p>+{58}</p><p>{4}</p><p><a href=x>{2}</a></p>",
    "<div>{10} <a href=x>{3}</a></div><div><h1>+{4}</h1><p>+{37}</p></div><ul><li><a href=x>{3}</a><li><a href=x>{6}</a></ul><div>{5}</div>",
)
DEPTH = 10


def labelled_rows() -> list[tuple[float, list[float]]]:
    """(1 for article text, features) of the blocks of LABELLED and UNNAMED."""
    rows = []
    for page in LABELLED + UNNAMED:
        filled = re.sub(r"\{(\d+)\}", lambda m: "w " * int(m[1]), page)
        found = blocks(filled)
        labels = [b.text.startswith("+") for b in found]
        for b in found:
            b.text = b.text.lstrip("+")
        rows += [(float(label), x) for label, x in zip(labels, features(found))]
    return rows


Tree = tuple  # (feature, threshold, tree at or below, tree above), or (verdict,)


def _read_tree(lines: list[str], at: int = 0) -> tuple[Tree, int]:
    """A tree from the lines in which a fitted model prints itself."""
    line = lines[at].strip()
    if line.startswith("Predict"):
        return (line.endswith("1.0"),), at + 1
    feature, threshold = re.search(r"feature (\d+) <= ([-\d.E]+)\)", line).groups()
    below, after = _read_tree(lines, at + 1)
    above, after = _read_tree(lines, after + 1)  # the line between says Else
    return (int(feature), float(threshold), below, above), after


@lru_cache(maxsize=1)
def _trained(spark: SparkSession) -> Tree:
    rows = spark.createDataFrame([(label, Vectors.dense(x)) for label, x in labelled_rows()], ["label", "features"])
    model = DecisionTreeClassifier(maxDepth=DEPTH, minInstancesPerNode=1, seed=1).fit(rows)
    return _read_tree(model.toDebugString.splitlines()[1:])[0]


def train(spark: SparkSession) -> Tree:
    """The decision tree of the labelled table, fitted once a session."""
    return _trained(spark)


def verdict(tree: Tree, x: list[float]) -> bool:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def main_text(html: str | None, tree: Tree) -> str:
    """The article's blocks in page order, joined by one space."""
    page = blocks(html)
    return " ".join(b.text for b, x in zip(page, features(page)) if verdict(tree, x))


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each row.

    A null or empty page has an empty text. White space in a block becomes one space; character references are
    decoded. Null ids and urls and repeated rows are kept; an empty table gives an empty one; further columns are not
    read. A tag that is not closed ends with its container or the page."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    tree = train(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py(), tree) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_column, "url": url_column})
