"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass: a block inside a boilerplate container, or made of
links outside an article, is bad; a long one with enough stop words is good; a long one with hardly any is bad
outside an article. Short blocks, long ones in between, and inside an article those of links or of few stop
words, stay open. Second pass: open blocks inherit the label of their nearest decided neighbours before and
behind. Where these differ, the one in the same article counts, then the one in the same container, then a
heading takes the label of what follows it, then the nearer one counts. A short block without decided
neighbours is good if it has no links or lies in an article; a long one is bad.

Structure thus says what is boilerplate and which neighbours are near; what is text is said by stop words,
lengths and links. An article in a language without stop words here needs ``stop_words`` of its own: its long
blocks are bad otherwise, since none of them is good.

Defined results: null or empty html gives an empty text; unclosed and stray tags, unclosed comments and
scripts are read as far as they go; repeated rows give repeated results. A lone <br> is white space, two
in a row end a block. <header> is boilerplate unless inside the article. A link that is never closed ends with
its block. Columns of ``keep`` named text or n_chars, in any case, are replaced by the results. A page costs
time in proportion to its length.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.textkeys import mapped, quoted
from docquarry.session import table

# HTML element names by role, class words of boilerplate, stop words of four languages.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul button canvas object".split()
)
CONTAINER = frozenset("article aside body blockquote button canvas center dd details dialog div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header main menu nav noscript object ol p pre search section select svg table template ul li span td th tr".split())
BOILERPLATE = frozenset("aside button canvas dialog footer form head menu nav noscript object search select svg template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the second set ends where one of the first begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus foot footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related recommended recommendations replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe teaser toolbar widget widgets".split()
)
STOP_WORDS = frozenset(
    "a an and are as at be been but by can do for from had has have he her his i if in into is it its not of on or our she so than that the their them then there they this to was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im ist ja kann man mit nach nicht noch nur oder sich sie sind so um und uns vom von vor war was wenn werden wie wir wird zu zum zur über "
    "au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais même ne nous on ont ou par pas plus pour qu que qui sa sans se ses si son sont sur un une vous y été être "
    "al como con cuando de del donde el ella en entre era es esta este estos fue ha hay la las le lo los me muy más no nos o para pero por porque que se ser si sin sobre son su sus también un una uno y ya".split()
)

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_ATTRS = re.compile(r"((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*=", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    links: int  # characters inside links
    bad: bool  # in a boilerplate container
    article: int  # number of the article it lies in, 0 for none
    parent: int  # number of the innermost container
    heading: bool


def _boilerplate(name: str, attrs: str, in_article: bool) -> bool:
    if name in BOILERPLATE or (name == "header" and not in_article):
        return True
    if not attrs or attrs.isspace():
        return False
    for key, value in _NAMED.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style":
            if _HIDDEN.search(value):
                return True
        elif key == "role":
            if value.strip().lower() in BAD_ROLES:
                return True
        elif name not in ("body", "html"):
            words = set(_SPLIT.split(_CAMEL.sub(" ", value).lower()))
            if words & BAD_WORDS or ("header" in words and not in_article):
                return True
    return False


def _tokens(page: str):
    """(text, "", "") or ("/" or "", name, attributes) of each piece of the page, raw elements left out."""
    at, quotes = 0, True
    while (here := page.find("<", at)) >= 0:
        if here > at:
            yield page[at:here], "", ""
        if m := _NAME.match(page, here + 1):
            name, rest = m[2].lower(), _ATTRS.match(page, m.end()) if quotes else None
            if rest:
                attrs, at = rest[1], rest.end()
            else:  # no end outside of quotes: from now on a tag ends at the next >
                quotes, end = False, page.find(">", m.end())
                attrs, at = page[m.end() : end] if end >= 0 else page[m.end() :], end + 1 if end >= 0 else len(page)
            if name in RAW:
                if not m[1]:
                    end = re.compile(rf"</{name}[^>]*+>?", re.I).search(page, at)
                    at = end.end() if end else len(page)
            else:
                yield m[1], name, attrs
        elif page.startswith("<!--", here):
            end = page.find("-->", here + 4)
            at = end + 3 if end >= 0 else len(page)
        elif page[here + 1 : here + 2] in ("!", "?", "/"):
            end = page.find(">", here)
            at = end + 1 if end >= 0 else len(page)
        else:
            yield "<", "", ""
            at = here + 1
    if at < len(page):
        yield page[at:], "", ""


def _unclosed(tokens: list[tuple[str, str, str]]) -> list[bool]:
    """Of each beginning of a link: whether the next one comes before its end."""
    ends = [closing == "/" for closing, name, _ in tokens if name == "a"]
    return [not b for a, b in zip(ends, [*ends, False][1:], strict=True) if not a]


def blocks(page: str) -> list[Block]:
    """The blocks that have text."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = [("", False, 0, 0)]  # name, boilerplate, article, number
    opened: Counter[str] = Counter()
    tokens = list(_tokens(page))
    open_links = iter(_unclosed(tokens))
    pieces: list[str] = []
    links = breaks = numbers = 0
    heading = linked = loose = False

    def flush() -> None:
        nonlocal links, breaks, heading, linked
        if pieces:
            if text := " ".join("".join(pieces).split()):
                _, bad, article, number = stack[-1]
                out.append(Block(text, links, bad, article, stack[-2][3] if stack[-1][0] in ("p", *HEADINGS) else number, heading))
                linked = linked and not loose
            pieces.clear()
        links = breaks = 0
        heading = False

    def popped() -> None:
        opened[stack.pop()[0]] -= 1

    for closing, name, attrs in tokens:
        if not name:
            text = _html.unescape(closing) if "&" in closing else closing
            pieces.append(text)
            if not text.isspace():
                breaks = 0
                if linked:
                    links += len(text.strip())
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                pieces.append(" ")
            continue
        if name == "a":
            linked = not closing and bool(_HREF.search(attrs))
            if not closing:
                loose = next(open_links)
            continue
        if name in BLOCK:
            flush()
        if name not in CONTAINER:
            continue
        if closing:
            if opened[name]:
                while stack[-1][0] != name:
                    if stack[-1][1] and not stack[-2][1]:
                        flush()
                    popped()
                if stack[-1][1] and not stack[-2][1]:
                    flush()
                popped()
            continue
        if name in BLOCK:
            while stack[-1][0] == "p" or name in ENDED_BY.get(stack[-1][0], ()):
                popped()
        if attrs.rstrip().endswith("/") and name not in ("p", "div", "span"):
            continue
        _, bad, article, _ = stack[-1]
        numbers += 1
        own = _boilerplate(name, attrs, article > 0)
        if own and not bad:
            flush()
        heading = name in HEADINGS or (heading and name == "span")
        stack.append((name, bad or own, numbers if name in ("article", "main") and not article else article, numbers))
        opened[name] += 1
    flush()
    return out


def first_labels(found: list[Block], low: int, high: int, few: float, stop_share: float, link_share: float, stop_words: frozenset[str]) -> list[str]:
    """good, bad, or open: "short" or "long"; "out" is bad for its container alone."""
    out = []
    for x in found:
        if x.bad:
            out.append("out")
        elif x.links > link_share * len(x.text):
            out.append(("short" if len(x.text) < low else "long") if x.article else "bad")
        elif len(x.text) < low:
            out.append("short")
        else:
            words = _LETTERS.findall(x.text.lower())
            stops = sum(w in stop_words for w in words)
            out.append("good" if stops >= stop_share * len(words) > 0 else "bad" if stops <= few * len(words) and len(x.text) >= high and not x.article else "long")
    inside = sum(len(x.text) for x, label in zip(found, out, strict=True) if label == "good" and x.article)
    outside = sum(len(x.text) for x, label in zip(found, out, strict=True) if label == "good" and not x.article)
    if inside > outside:
        return ["bad" if label == "good" and not x.article else label for x, label in zip(found, out, strict=True)]
    return out


def settled(found: list[Block], first: list[str]) -> list[bool]:
    """Whether each block is good: open ones by their nearest decided neighbours, in one pass each way."""
    n = len(found)
    before: list[int] = []
    last = -1
    for i in range(n):
        before.append(last)
        if first[i] in ("good", "bad"):
            last = i
    out, after = [False] * n, -1
    for i in range(n - 1, -1, -1):
        if first[i] in ("good", "bad"):
            out[i], after = first[i] == "good", i
        elif first[i] != "out":
            out[i] = _inherited(found, first, i, before[i], after)
    return out


def _inherited(found: list[Block], first: list[str], i: int, before: int, after: int) -> bool:
    own = found[i]
    near = [j for j in (before, after) if j >= 0]
    if inside := [j for j in near if own.article and found[j].article == own.article]:
        near = inside
    if not near or (own.article and not inside):
        return own.article > 0 or not own.links
    said = {first[j] for j in near}
    if len(said) == 1:
        return said == {"good"}
    same = [found[j].parent == own.parent for j in near]
    if same[0] != same[1]:
        return first[near[same.index(True)]] == "good"
    if own.heading:
        return first[after] == "good"
    return first[before if i - before <= after - i else after] == "good"


def main_text(page: str | None, low: int = 70, high: int = 300, few: float = 0.02, stop_share: float = 0.12, link_share: float = 0.5, stop_words: frozenset[str] | None = None) -> str:
    """The page's good blocks, one to a line. A block of under ``low`` code points is short, one of
    ``high`` and over is bad outside an article if no more than ``few`` of its words are stop words."""
    found = blocks(page or "")
    first = first_labels(found, low, high, few, stop_share, link_share, STOP_WORDS if stop_words is None else stop_words)
    return "\n".join(x.text for x, good in zip(found, settled(found, first), strict=True) if good)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, then text and n_chars (code points) of every page."""
    kept = [c for c in keep if c.lower() not in ("text", "n_chars")]
    page = "page" + "_" * max([len(c) for c in kept], default=0)
    schema = pages.select(*quoted(kept), F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(page).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.select(*quoted(kept), F.col(f"`{html}`").alias(page)).mapInArrow(mapped(run, page), schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
