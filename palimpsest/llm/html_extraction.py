"""Main text of web pages by two passes of block rules.

A page is read once, tag by tag, and cut into blocks at elements that aren't inline. The first pass
judges every block by itself: what lies in a menu, footer, sidebar, notice, advert, form or among
readers' comments, by its elements' names, roles, classes and ids, is left out; of the rest, length,
density of links and density of stop words make a block good, bad or unsure. The second pass gives
an unsure block (a heading, a short paragraph) the label of its nearest decided neighbour.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

#: Code points below which a block is unsure, and from which stop words at ``SOME`` are enough.
SHORT, LONG = 70, 200
#: Shares of stop words: enough for a long block, and enough for any block that isn't short.
SOME, MANY = 0.2, 0.3
#: Share of a block's characters that stands in links, beyond which it is bad.
LINKED = 0.33
#: Elements nested deeper count as children of the last one, as in browsers.
DEEPEST = 512

SENTENCE_ENDS = (".", "!", "?", "…", "。", '."', ".”")

# Common words of four languages.
STOP_WORDS = frozenset("""
a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our out she so that the their there they
this to up was we were what when which who will with would you your
aber als am an auch auf aus bei bis das dass dem den der des die dies diese du durch ein eine einem einen einer er es für haben hat hier ich ihr im in ist ja kann mehr mit nach nicht noch nur oder
sein sich sie sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur
au aux avec ce ces cette comme dans de des du elle en est et être fait il ils je la le les leur lui mais me même ne nous on ont ou par pas plus pour qu que qui sa se ses si son sont sur tout un une vous
al algo como con contra cuando de del desde donde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se ser si sin sobre son su sus también todo un una y ya
""".split())
# Elements that cut blocks, those without content, those whose content is no markup, and those left out.
BLOCKS = frozenset("""
address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html
iframe legend li listing main menu nav noscript object ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul audio video canvas svg math map
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
LEFT_OUT = frozenset("head nav menu aside footer form search button select noscript template dialog svg canvas audio video object iframe noembed noframes script style title textarea".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end the one of the same kind before them, and where the search for it stops.
ENDED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that an end tag from within doesn't close, unless it is one of tables.
CELLS, TABLES = frozenset("td th caption template object".split()), frozenset("table tbody thead tfoot tr td th caption template object".split())

# Words of classes and ids that name what isn't main text, and words that say it is.
NAMED = frozenset("""
ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promos promoted promotion
nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar skip
header masthead banner footer foot colophon copyright
sidebar aside rail widget widgets related recommended recommendations popular trending teaser teasers
cookie cookies consent gdpr notice notices notification popup modal overlay alert disclaimer paywall
form newsletter subscribe subscription signup login register search searchbox share sharing social
comment comments disqus reply replies respond
""".split())
NAMED_WITHIN = re.compile("sidebar|footer|navbar|navigation|breadcrumb|comment(?!ary)|cookie|advert|newsletter|sponsor|masthead|copyright|pagination|disqus")
MAIN_NAMES = frozenset("content article post entry story".split())
#: Words that make a class a remark about the page (``has-sidebar``), and of elements whose header is their own.
REMARKS = frozenset("has with no without open enabled layout".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|</?[a-zA-Z][^>]*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])|\Z", re.I) for name in RAW}
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LETTERS = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Element:
    """An open element: ``out`` if its text is left out (``form``: because of a form), the innermost main part that it lies in, its place in the tree."""

    name: str
    out: bool
    form: bool
    box: Element | None
    parent: Element | None
    depth: int
    heading: bool
    link: bool


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    at: Element
    good: bool | None = field(default=None)


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), references.unescape(value.strip("\"'")))
    return found


def _says(names: str, own_header: bool) -> bool | None:
    """What classes or ids tell of an element: False for other than main text, True for main text, None for nothing."""
    main = None
    for name in names.split():
        words = {w.lower() for w in PARTS.findall(name)}
        if words & REMARKS:
            continue
        if words & {"header"} and (own_header or words & MAIN_NAMES):
            words -= {"header"}
        if words & NAMED or NAMED_WITHIN.search(name.lower()):
            return False
        if words & MAIN_NAMES:
            main = True
    return main


def _opened(name: str, attributes: dict[str, str], parent: Element) -> Element:
    names, role = f"{attributes.get('class', '')} {attributes.get('id', '')}", attributes.get("role")
    semantic = "article" if "article" in (name, role) else "main" if "main" in (name, role) else ""
    within = parent.box is not None and parent.box.name == "article"
    if name in ("html", "body"):
        said = None
    elif semantic:  # a comment or an advert may be an article of its own; other words tell of the whole page
        said = not (NAMED.intersection(names.lower().split()) or NAMED_WITHIN.match(names.strip().lower()))
    else:
        said = _says(names, within)
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDDEN.search(attributes.get("style", ""))
        if hidden or name in LEFT_OUT or (name == "header" and not within) or role in LEFT_OUT_ROLES:
            said = False
    main = bool(said and semantic)  # an article in a form is no part of it: forms stand around whole pages, too
    made = Element(
        semantic or name, parent.out or (said is False and name != "form"), (parent.form or name == "form") and not main, parent.box, parent,
        min(parent.depth + 1, DEEPEST), parent.heading or name in HEADINGS, parent.link or (name == "a" and "href" in attributes),
    )
    if main or (said and parent.box is None):
        made.box = made
    return made


def blocks_of(page: str) -> list[Block]:
    """The page's blocks that aren't left out by their elements, in order; of text in scripts, styles, comments and markup there is none."""
    root = Element("", False, False, None, None, 0, False, False)
    stack, names, opened = [root], [""], Counter()
    found: list[Block] = []
    pieces: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(text, min(linked, len(text)), stack[-1] if stack[-1].name != "a" else stack[-2]))
            pieces.clear()
        linked = 0

    def say(text: str):
        nonlocal linked
        if text and not stack[-1].out and not stack[-1].form:
            text = references.unescape(text) if "&" in text else text
            pieces.append(text)
            linked += len(text.strip()) if stack[-1].link else 0

    def close(names_: set[str] | frozenset[str], barriers: set[str] | frozenset[str]):
        """Closes up to the nearest open element of these names, if no barrier is nearer."""
        if not any(opened[n] for n in names_):
            return
        for k in range(len(stack) - 1, 0, -1):
            if names[k] in names_:
                for gone in names[k:]:
                    opened[gone] -= 1
                del stack[k:], names[k:]
                return
            if names[k] in barriers:
                return

    def start(name: str, attributes: dict[str, str]):
        stack.append(_opened(name, attributes, stack[-1]))
        names.append(name)
        opened[name] += 1

    at = 0
    while at < len(page):
        tag = TOKEN.search(page, at)
        if tag is None:
            say(page[at:])
            break
        say(page[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            say(" ")
            continue
        if tag["end"]:
            if name in BLOCKS:
                flush()
            close({name}, () if name in TABLES else CELLS)
            continue
        attributes = _attributes(tag["attributes"]) if tag["attributes"].strip() else {}
        if name in RAW:
            if name in BLOCKS:
                flush()
            at = RAW_ENDS[name].search(page, at).start()
            continue
        if name in BLOCKS:
            flush()
            close({"p"}, CELLS | {"button"})
            if name in ENDED:
                close(*ENDED[name])
            if name not in VOID:
                start(name, attributes)
        elif name == "a":
            close({"a"}, CELLS)
            start(name, attributes)
        elif name not in VOID and attributes and _opened(name, attributes, stack[-1]).out and not stack[-1].out:
            flush()  # a part of a line that is an advert or hidden
            start(name, attributes)
    flush()
    return found


def _stop_share(text: str) -> float:
    words = LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _shared_depth(a: Element, b: Element) -> int:
    """Depth of the nearest element that holds both."""
    while a is not b:
        if a.depth > b.depth:
            a = a.parent
        elif b.depth > a.depth or b.parent is None:
            b = b.parent
        else:
            a, b = (a.parent or a), b.parent
    return a.depth


def judge(blocks: list[Block]) -> list[Block]:
    """Gives every block its label: first by itself, then by the nearest decided neighbour."""
    shares = [_stop_share(b.text) for b in blocks]
    known = any(share >= SOME and len(b.text) >= SHORT for b, share in zip(blocks, shares))
    for b, share in zip(blocks, shares):
        size, boxed = len(b.text), b.at.box is not None
        if b.linked > LINKED * size:
            b.good = False
        elif b.at.heading or size < SHORT:
            b.good = False if "©" in b.text and not boxed else None
        elif not known:  # a language without a list: length decides
            b.good = True if boxed or size >= LONG else None
        elif share >= MANY or (share >= SOME and size >= LONG):
            b.good = True
        elif share < SOME and not boxed:
            b.good = False

    decided = [k for k, b in enumerate(blocks) if b.good is not None]
    labels, place = [b.good for b in blocks], 0
    for k, b in enumerate(blocks):
        while place < len(decided) and decided[place] < k:
            place += 1
        if b.good is not None:
            continue
        near = [decided[j] for j in (place - 1, place) if 0 <= j < len(decided) and blocks[decided[j]].at.box is b.at.box]
        if b.at.heading and near and near[-1] > k:
            near = near[-1:]  # a heading belongs to what follows
        nearest = sorted(((-_shared_depth(b.at, blocks[j].at), abs(j - k), labels[j]) for j in near), key=lambda n: n[:2])
        if not nearest:
            b.good = b.at.box is not None  # nothing decided in the same main part: the part decides, or there is none
        elif len(nearest) == 2 and nearest[0][:2] == nearest[1][:2] and nearest[0][2] != nearest[1][2]:
            b.good = b.at.box is not None or (b.linked == 0 and b.text.endswith(SENTENCE_ENDS))
        else:
            b.good = nearest[0][2]
    if any(b.good and _semantic(b.at.box) for b in blocks):
        for b in blocks:
            b.good = b.good and _semantic(b.at.box)
    return blocks


def _semantic(box: Element | None) -> bool:
    """Whether the main part, or one that holds it, is an article or main element."""
    while box is not None:
        if box.name in ("article", "main"):
            return True
        box = box.parent and box.parent.box
    return False


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in judge(blocks_of(page or "")) if b.good)


def extract_main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The columns ``keep`` of each page with ``text``, its main text, and ``n_chars``, that text's code points.

    A null, empty or markup-only page has the empty text; a null id or url is kept; a repeated row
    gives a repeated row; an empty table gives none; other columns of ``pages``, also ones named text
    or n_chars, are left out. Pages are read whole, one at a time, in time that grows with their length.
    Blocks that are unsure between a good and a bad neighbour equally near are main text within an
    article, or an element named as content, and elsewhere if they end as sentences do and hold no link. Where an article or main element holds
    good text, what stands outside such elements isn't main text. In a language whose stop words aren't
    listed, length and links decide alone.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(*keep, html)
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(len(keep)).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), sizes], [*keep, "text", "n_chars"])

    return rows.mapInArrow(run, f"{types}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op11_html_extraction": query}
#: The driver's pages keep their articles in one place, so that SQL can cut them out without any rule about blocks.
ORACLE_SQL = {
    "op11_html_extraction": r"""WITH held AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|\z)', 1) AS a FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(h1|p)>|<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS a FROM held),
decoded AS (SELECT page_id, url, regexp_replace(replace(a, '&quot;', '"'), '&amp;?', '&', 'g') AS a FROM plain),
texts AS (SELECT page_id, url, trim(regexp_replace(a, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts"""
}
