"""HTML extraction (operator 3): line-block distribution.

Markup is stripped into lines, one per block element. A line weighs as many code points as its
text has outside links; boilerplate (menus, page headers, footers, sidebars, notices, adverts,
forms, comments, known by element, role, or a name in class or id) weighs nothing and stays in the line
list as a valley. Names that only say what a page has or lacks (``with-sidebar``, ``no-comments``) mean
nothing, nor do names of headings, paragraphs and articles inside or around an article unless they are adverts,
notices or comments. Outside an article a short line that says what a cookie notice says weighs nothing.
A name is a doubt only, and does not remove, where its words go on with other words than those of layout
(``search-engines``, ``social-history``) or where the element is named as content, too (``post top``): such a
line weighs THRESHOLD less, and the window sums decide. Weights are summed over sliding windows of WINDOW
lines. A surge point is where the sum first rises over the threshold, a dive point where it falls to
nothing; the lines between are the main text. A line of an article that the page names (``article`` or
``main``) weighs its whole text and THRESHOLD more, so that short paragraphs of the article rise, too.
Where named articles hold most of the page's text, a line outside weighs OUTSIDE thresholds less: a notice
in a plain element before the article falls, a long text outside still rises; on other pages lines outside
are weighed as if there were no article, and text outside that rises by itself or adjoins the article stays.

Each page is handled alone by one Arrow map: no shuffle, any page stays in one batch row. Time grows in
proportion to the page, whatever its markup: end tags without a start are passed over by a count of
open names, and an end that was once not found is not searched again.

Defined results: null or empty html gives empty text; unclosed and stray tags are tolerated, an
unfinished tag or comment at the end is dropped; a page that is all boilerplate gives empty text;
very long pages are read whole; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, THRESHOLD = 3, 86
#: What a line outside a ruling article loses, in thresholds.
OUTSIDE = 2

# What HTML calls these.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg object math canvas audio video noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th img".split())
TRACKED = frozenset("article aside body blockquote dd details dialog div dl dt fieldset figure footer form header html li main menu nav ol section select table tr ul button".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button select head".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion sidebar menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related "
    "recommended recommendations comment comments reply replies respond disqus widget widgets toolbar pagination pager login search skip copyright".split()
)
PAGE_WORDS = frozenset(["header", "topbar", "top"])
MODIFIERS = frozenset("with without no not has have hide hides hidden show shows is non sans".split())
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote figure figcaption table ul ol dl li".split())
STRONG_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription share sharing comment comments reply replies related".split()
)
LAYOUT_WORDS = frozenset(
    "area bar block body bottom box btn button buttons col column container content desktop field fixed form global group holder icon icons inner input item items js "
    "left line link links list main mobile module outer page panel primary region right row secondary section site slot sticky tag tags text title top unit wrap wrapper zone".split()
)
CONTENT_WORDS = frozenset("article story post entry content body text".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")
NOTICE = re.compile(r"\bcookies?\b.{0,120}\b(accept|agree|consent|policy|settings|browsing|experience)\b|\b(accept|agree|consent|uses?|using)\b.{0,60}\bcookies?\b", re.I | re.S)
#: Longer lines are no notices.
NOTICE_LENGTH = 300
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def boilerplate(name: str, attributes: str, in_article: bool) -> int:
    """2 for boilerplate, 1 for a doubt, 0 for neither."""
    if name in BOILER_TAGS or (name == "header" and not in_article):
        return 2
    if not attributes or name in ("html", "body"):
        return 0
    strong = name in ("article", "main") or (in_article and name in TEXT_TAGS)
    known = STRONG_WORDS if strong else BOILER_WORDS if in_article else BOILER_WORDS | PAGE_WORDS
    found, content = 0, False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return 2
        if key == "role" and value in BOILER_ROLES:
            return 2
        if key in ("class", "id") and name != "main":
            for said in value.split():
                words = WORDS.findall(said)
                content = content or (bool(words) and CONTENT_WORDS.issuperset(words))
                if words and words[0] not in MODIFIERS and not known.isdisjoint(words):
                    if not STRONG_WORDS.isdisjoint(words):
                        return 2
                    plain = all(w in known or w in LAYOUT_WORDS or len(w) == 1 or w.isdigit() for w in words)
                    found = max(found, 2 if plain else 1)
    return max(0, found - content)


def lines_of(page: str) -> list[tuple[str, bool, bool, int, bool]]:
    """(text, is boilerplate, is in the named article, code points in links, is doubted) of each line."""
    lines: list[tuple[str, bool, bool, int, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, is boilerplate, is an article, is a doubt
    opened: Counter[str] = Counter()  # how often each tag lies on the stack
    endless: set[str] = set()  # raw elements that have no end tag from here on
    boiler = article = doubts = links = linked = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                lines.append((text, boiler > 0, article > 0, linked, doubts > 0))
            parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    def close(k: int) -> None:
        nonlocal boiler, article, doubts
        while len(stack) > k:
            tag, b, a, doubt = stack.pop()
            opened[tag] -= 1
            boiler -= b
            article -= a
            doubts -= doubt

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            z = page.find("-->", lt + 4)
            at = end if z < 0 else z + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            z = page.find(">", lt)
            at = end if z < 0 else z + 1
            continue
        nxt = page[lt + 1 : lt + 3]
        if not (nxt[:1].isascii() and nxt[:1].isalpha() or (nxt[:1] == "/" and nxt[1:].isascii() and nxt[1:].isalpha())):
            say("<")
            at = lt + 1
            continue
        m = TAG.match(page, lt)
        if m is None:
            z = page.find(">", lt)
            if z < 0:
                break
            closing, name, attributes, at = page[lt + 1] == "/", re.match(r"/?([a-zA-Z][^\s/>]*)", page[lt + 1 : z + 1])[1].lower(), "", z + 1
        else:
            closing, name, attributes, at = m[1] == "/", m[2].lower(), m[3], m.end()
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
            continue
        if name in SPACED and not closing:
            parts.append(" ")
        if name in BLOCKS:
            flush()
        if closing:
            if not opened[name]:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush()
                    close(k)
                    break
            continue
        if name in RAW:
            if not attributes.endswith("/") or name in ("script", "style"):
                z = None if name in endless else RAW_END[name].search(page, at)
                if z is None:
                    endless.add(name)
                    at = end if name in ("script", "style", "textarea", "title") else at
                else:
                    gt = page.find(">", z.start())
                    at = end if gt < 0 else gt + 1
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in ("article", "main", "body"):
            # an article never lies in a menu, form or header that was left open
            while stack and stack[-1][1] and stack[-1][0] in ("nav", "header", "form", "head", "menu", "button", "select", "ul", "ol", "li"):
                flush()
                close(len(stack) - 1)
        level = boilerplate(name, attributes, article > 0)
        bad, doubt = level == 2, level == 1
        if level or name in TRACKED:
            flush()
            named = name in ("article", "main") and not bad and not boiler
            stack.append((name, bad, named, doubt))
            opened[name] += 1
            boiler += bad
            article += named
            doubts += doubt
    flush()
    return lines


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """Lines between surge and dive points, joined by line feeds."""
    lines = lines_of(page or "")
    held = [0, 0]  # text outside and inside named articles
    for text, bad, inside, linked, _ in lines:
        if not bad:
            held[inside] += max(0, len(text) - linked)
    outside = OUTSIDE * threshold if held[1] > held[0] else 0
    weight = []
    for text, bad, inside, linked, doubt in lines:
        own = max(0, len(text) - linked)
        if bad:
            weight.append(0)
        elif inside:
            weight.append(own if doubt else threshold + len(text))
        elif linked > own or (len(text) <= NOTICE_LENGTH and NOTICE.search(text)):
            weight.append(0)
        else:
            weight.append(max(0, own - outside - (threshold if doubt else 0)))
    n = len(weight)
    if not any(weight):
        return ""
    total = [0]
    for w in weight:
        total.append(total[-1] + w)
    sums = [total[min(n, i + window)] - total[i] for i in range(n)]
    level = min(threshold, max(sums))
    keep: list[str] = []
    i = 0
    while i < n:
        if sums[i] <= 0 or sums[i] < level:
            i += 1
            continue
        surge = i
        while surge and weight[surge - 1]:  # the rise begins with the first line of the slope
            surge -= 1
        dive = i
        while dive < n and sums[dive] > 0:
            dive += 1
        keep += [lines[j][0] for j in range(surge, dive) if weight[j]]
        i = dive
    return "\n".join(keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    schema = f"{id_col} long, {url_col} string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [main_text(h) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"]
                )

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, schema)
