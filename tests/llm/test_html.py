import html
import random
import re
import time

import pyarrow.parquet as pq

from walkmoments.llm.html import NOTICE, extract, lines_of, main_text

LONG = "A sentence of the story that goes on for a while, long enough to count as text."
CASES = {
    "named": (
        f"<html><head><title>T</title><script>if(a<b)x('</p>')</script></head><body class='sidebar-left'><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>"
        f"<article><h1>Title &amp; more</h1><p>One\n  two</p><aside>See also</aside><p>Er.</p><div class='ad box'>Buy</div><form><input><button>Send</button></form><p>{LONG}</p>"
        f"<section id='comments'><p>{LONG} by a reader</p></section></article><div class=sidebar>{LONG}</div><footer>&copy; x</footer></body></html>",
        f"Title & more\nOne two\nEr.\n{LONG}",
    ),
    "unnamed": (
        f"<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><div class='cookie-notice'>We use</div><div class=footer>Bottom</div>",
        f"Head\n{LONG}\n{LONG}",
    ),
    "inline": ("<main><p>a<b>b</b>c <i>d</i><br>e &lt;x&gt; 3 < 4</main>", "abc d e <x> 3 < 4"),
    "plain": ("just text", "just text"),
    "unclosed": ("<nav><a href=x>m</a><article><p>Kept<p>too<!-- gone", "Kept\ntoo"),
    "broken": ("<article><p>x</p><a href='", "x"),
    "list": ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one\ntwo\na b"),
    "modifiers": (f"<div class='content with-sidebar'><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
    "lacks": (f"<article class='post no-comments'><p>{LONG}</p></article><div class='comments'><p>{LONG}</p></div>", LONG),
    "headings": (f"<main><h1 class='banner'>Head</h1><p id='search'>{LONG}</p><p class='ad'>Buy</p></main>", f"Head\n{LONG}"),
    "notice": (f"<div><p>We use cookies to improve your experience. Accept all cookies?</p></div><div><a href=1>One</a></div><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
    "cookies": ("<article><p>We use cookies, she said, and agree on the experience.</p></article>", "We use cookies, she said, and agree on the experience."),
    "article named as a widget": (f"<article class='story widget'><p>{LONG}</p><p>Er.</p></article>", f"{LONG}\nEr."),
    "topic of a section": (f"<article><p>{LONG}</p><section class='search-engines'><h2>On search</h2><p>{LONG}</p></section></article>", f"{LONG}\nOn search\n{LONG}"),
    "topic of a division": (f"<main><div id='social-history'><p>{LONG}</p></div></main>", LONG),
    "content at the top": (f"<div class='post top'><p>{LONG * 2}</p><p>{LONG * 2}</p></div>", f"{LONG * 2}\n{LONG * 2}"),
    "doubt decided by sums": (f"<div class='social-history'><p>Follow us</p></div><div><a href=1>One</a></div><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
    "dense doubt": (f"<div class='social-history'><p>{LONG * 3}</p><p>{LONG * 3}</p></div>", f"{LONG * 3}\n{LONG * 3}"),
    "comment as an article": (f"<article><p>{LONG}</p></article><article class='comment odd'><p>{LONG}</p></article>", LONG),
    "privacy": (f"<div><p>We value your privacy. Our partners store information on your device and read it to show what you like.</p></div><article><h1>Head</h1><p>{LONG * 3}</p></article>", f"Head\n{LONG * 3}"),
    "long text outside": (f"<article><p>{LONG * 9}</p></article><div><p>{LONG * 5}</p></div>", f"{LONG * 9}\n{LONG * 5}"),
    "layout": (f"<div class='search-box'><p>{LONG * 3}</p></div><div class='widget-area-2'><p>{LONG * 3}</p></div><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
    "empty": ("", ""),
    "none": (None, ""),
    "boiler": ("<nav>x</nav><footer>y</footer>", ""),
}


def test_cases():
    for name, (page, want) in CASES.items():
        assert main_text(page) == want, name


def test_articles_of_the_table():
    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br|b)>", inner)
        plain = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks)
        assert main_text(r["html"]) == "\n".join(x for x in plain if x)


def test_text_beside_a_teaser_stays():
    story, teaser = f"<div><p>{LONG}</p><p>{LONG}</p></div>", "<article><h3>Next story</h3></article>"
    links = "<div><a href=1>One</a></div><div><a href=2>Two</a></div><div><a href=3>Three</a></div>"
    assert main_text(f"<nav>x</nav>{story}{links}{teaser}") == f"{LONG}\n{LONG}\nNext story"
    assert main_text(f"<main>{teaser}</main>{links}<div>Imprint</div>{links}{story}") == f"Next story\n{LONG}\n{LONG}"


def test_rows(spark):
    rows = [(k, None if k % 2 else f"http://x/{k}", page, "n") for k, (page, _) in enumerate(CASES.values())]
    rows += [(None, "u", "<p>" + "long " * 100_000, "n"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert [r.text for r in got[: len(CASES)]] == [w for _, w in CASES.values()]
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows) and got[-3].n_chars == 499_999
    assert extract(df.limit(0)).count() == 0


def by_windows(page, window=3, threshold=86):
    """The distribution over the lines, from its definition: a line is kept if it belongs to a slope whose sums reach the threshold."""
    lines = lines_of(page)
    weight = []
    plain = [(len(text) - min(linked, len(text)), inside) for text, bad, inside, linked, _ in lines if not bad]
    ruled = sum(x for x, inside in plain if inside) > sum(x for x, inside in plain if not inside)
    for text, bad, inside, linked, doubt in lines:
        own = max(0, len(text) - linked)
        notice = len(text) <= 300 and NOTICE.search(text)
        less = threshold * (2 * (ruled and not inside) + doubt)
        if bad or (not inside and (notice or linked > own)):
            weight.append(0)
        else:
            weight.append(max(0, (threshold + (own if doubt else len(text)) if inside else own) - less))
    sums = [sum(weight[k : k + window]) for k in range(len(weight))]
    level = min(threshold, max(sums, default=0))
    kept = set()
    for i, x in enumerate(sums):
        if x and x >= level:  # a surge: down the slope to the line before, and on to the dive
            j = i
            while j and weight[j - 1]:
                j -= 1
            while j < len(weight) and (j < i or sums[j]):
                kept.add(j)
                j += 1
    return "\n".join(lines[j][0] for j in sorted(kept) if weight[j])


def test_distribution_by_its_definition():
    rng = random.Random(5)
    bits = ["<p>", "</p>", "<div>", "</div>", "<div class=menu>", "<div class=social-history>", "<article>", "</article>", "<a href=1>", "</a>", "short", LONG, "a middling line of text", "<nav>", "</nav>", "<br>", "<h2>"]
    for _ in range(3000):
        page = "".join(rng.choices(bits, k=rng.randint(1, 40)))
        assert main_text(page) == by_windows(page), page


def test_hostile_markup_takes_linear_time():
    pages = ["<div>" * 80_000 + "</span>" * 80_000, "<svg>" * 100_000, "<div></p>" * 100_000, "<a '" * 100_000, "<ul><li>" * 60_000 + "</ol>" * 60_000, "<x y=\"" * 80_000, "<!--" * 100_000, "<" * 500_000]
    for page in pages:
        start = time.thread_time()
        main_text(page)
        assert time.thread_time() - start < 12, page[:20]
