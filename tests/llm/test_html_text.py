import random
import re
import time
from html import unescape
from pathlib import Path

import pytest

from gleaner.llm import html_text

LONG = "The river was wide and it ran to the sea, and the people of the town had built a bridge over it for the carts that came in from the hills. " * 2


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


CASES = [
    ("article", page(f"<nav><a href=x>Home</a></nav><article><h1>Head &amp; more</h1><p>{LONG}</p></article><footer>&copy; x</footer>"), ["Head & more", LONG.strip()]),
    ("broken tags", page(f"<article><h1>A</h1><p><b>{LONG}<br><p>Next para.<p>Zq xv wk.</article>") [:-14], ["A", LONG.strip(), "Next para.", "Zq xv wk."]),
    ("script with markup", page(f'<article><p>One <script>var t="</p><p>no";</script>two.</p><p>{LONG}</p></article>'), ["One two.", LONG.strip()]),
    ("no article", page(f"<div id=top><a href=a>A</a> <a href=b>B</a></div><div><h2>Title</h2><p>{LONG}</p><p>Short end.</p></div><div class='sidebar'><p>{LONG}</p></div>"), ["Title", LONG.strip(), "Short end."]),
    ("boilerplate by class", page(f"<article><p>{LONG}</p><div class='ad'>{LONG}</div><aside>{LONG}</aside><p>End.</p></article><section id='comments'><article><p>{LONG}</p></article></section><div class='cookie-notice'>{LONG}</div><form><p>{LONG}</p></form>"), [LONG.strip(), "End."]),
    ("wrapper named for what it holds beside", page(f"<div class='content has-sidebar sidebar-right'><main><p>{LONG}</p></main></div>"), [LONG.strip()]),
    ("unknown language", page("<nav><a href=x>Home</a></nav><article><h1>Zor bek</h1><p>" + "zor bek lum tri " * 30 + "</p></article>"), ["Zor bek", ("zor bek lum tri " * 30).strip()]),
    ("white space", page(f"<main><p>a\n\t b&nbsp;&nbsp;c</p><pre>{LONG}\n x</pre></main>"), ["a b c", LONG.strip() + " x"]),
    ("links", page(f"<article><p>{LONG}</p><ul><li><a href=1>First linked story of today</a></li><li><a href=2>Second</a></li></ul><p>With a <a href=3>link</a> in it.</p></article>"), [LONG.strip(), "With a link in it."]),
    ("hidden", page(f"<article><p hidden>{LONG}</p><p style='display: none'>{LONG}</p><p>{LONG}</p></article>"), [LONG.strip()]),
    ("headers of the article and of the page", page(f"<div class='page-header'>{LONG}</div><article><header class='entry-header'><h1>Head</h1></header><div class='article-header'>By A. Writer</div><p>{LONG}</p></article>"), ["Head", "By A. Writer", LONG.strip()]),
    ("a form around the page", f"<body><form id=aspnetForm class=form><div class='banner'>{LONG}</div><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><label>Name</label><button>Send</button><div id=comments><p>{LONG}</p></div></form></body>", ["Head", LONG.strip(), LONG.strip()]),
    ("inline elements with marks", page(f"<article><p>{LONG}<span class=ad>Buy now</span> and <b>more</b> of it.</p></article>"), [LONG.strip(), "and more of it."]),
    ("names of states", page(f"<article class='post has-comments'><p>{LONG}</p></article>"), [LONG.strip()]),
    ("names of states, no article", page(f"<div class='entry comments-open'><p>{LONG}</p></div>"), [LONG.strip()]),
    ("names that begin like boilerplate", page(f"<article><section id=search-algorithms><p>{LONG}</p></section><div class=related-work><p>{LONG}</p></div><p class=shareholder-note>{LONG}</p></article>"), [LONG.strip()] * 3),
    ("all that there is stands in a marked element", page(f"<div class='widget'><p>{LONG}</p><div class='comment-list'><p>{LONG}</p></div></div>"), [LONG.strip()]),
    ("comments only", page(f"<div class='CommentList'><p>{LONG}</p></div><div><h2>Short</h2><p>{LONG}</p></div>"), ["Short", LONG.strip()]),
    ("white space in a link", page(f"<article><p>The <a href=x>road{' ' * 500}map</a> is to be read by all of the people in the town.</p><p>{LONG}</p></article>"), ["The road map is to be read by all of the people in the town.", LONG.strip()]),
    ("nothing is good", page("<nav><a href=x>Home</a></nav><h1>Zor</h1><p>Bek lum.</p><footer>bye</footer>"), ["Zor", "Bek lum."]),
    ("plain", "Just a line of text", ["Just a line of text"]),
    ("stray", "<article><p>a < b and c > d <3 &lt;x&gt; &#233; &bogus; &am", ["a < b and c > d <3 <x> é &bogus; &am"]),
    ("end in a tag", f"<article><p>{LONG}</p><p>cut <a hre", [LONG.strip(), "cut"]),
    ("quotes", f"<article><p title='a > b' data-x=\"<p>\">{LONG}</p><p class=\"x>open quote</p></article>", [LONG.strip(), "open quote"]),
    ("comment", f"<article><!-- <p>no</p> --><p>{LONG}</p><!-- open {LONG}", [LONG.strip()]),
    ("a label in a sentence", page(f"<article><p>Mind the <label>gap</label> here, as the signs in the station say to all of us.</p><p>{LONG}</p><div><label>Name</label><button>Send</button></div></article>"), ["Mind the gap here, as the signs in the station say to all of us.", LONG.strip()]),
    ("sections with a subject", page(f"<article><p>{LONG}</p>" + "".join(f"<section id={x}><h2>The {x} of it</h2><p>{LONG}</p></section>" for x in ("legal", "related", "search", "notice")) + "</article>"), [LONG.strip(), *(y for x in ("legal", "related", "search", "notice") for y in (f"The {x} of it", LONG.strip()))]),
    ("a related list in an article", page(f"<article><p>{LONG}</p><section id=related><p>Read on in the town</p><p>More of it</p></section></article>"), [LONG.strip()]),
    ("a form longer than the article", page(f"<article><p>{LONG}</p></article><form><label>Your name</label><input name=a><p>{LONG * 4}</p><label>Mail</label><input name=b><button>Send</button></form>"), [LONG.strip()]),
    ("the same without an article element", page(f"<div><h2>Head</h2><p>{LONG}</p></div><form><label>Your name</label><input name=a><p>{LONG * 4}</p><label>Mail</label><input name=b></form>"), ["Head", LONG.strip()]),
    ("a page in a form", page(f"<form><input type=hidden><div><h2>Head</h2>" + f"<p>{LONG}</p>" * 6 + f"</div></form><div><p>{LONG}</p></div>"), ["Head", *[LONG.strip()] * 7]),
    ("comments by their heading", page(f"<div><h1>Head</h1><p>{LONG}</p></div><div class=discussion><h3>Readers said</h3><p>{LONG}</p><p>{LONG}</p></div>"), ["Head", LONG.strip()]),
    ("comments by their structure", page(f"<div><h1>Head</h1><p>{LONG}</p></div><ul class=voices>" + f"<li class=v><b class=author>Ann</b> <time>noon</time><p>{LONG}</p></li>" * 3 + "</ul>"), ["Head", LONG.strip()]),
    ("a chapter of discussion", page(f"<article><p>{LONG}</p><h2>Discussion</h2><p>{LONG}</p></article>"), [LONG.strip(), "Discussion", LONG.strip()]),
    ("a list of dates", page(f"<article><p>{LONG}</p><ul class=line>" + f"<li class=v><time>1900</time><p>{LONG}</p></li>" * 3 + "</ul></article>"), [LONG.strip(), *["1900", LONG.strip()] * 3]),
    ("empty", "", []),
    ("null", None, []),
    ("only boilerplate", page("<nav><a href=x>Home</a></nav><footer>bye</footer>"), []),
]


@pytest.mark.parametrize("name,html,want", CASES, ids=[c[0] for c in CASES])
def test_main_text(name, html, want):
    assert html_text.main_text(html) == "\n".join(want)


def test_long_and_deep_pages_are_read_whole():
    many = "".join(f"<p>{LONG} n{i}</p>" for i in range(2000))
    assert html_text.main_text(f"<article>{many}</article>").count("\n") == 1999
    assert "deep" in html_text.main_text("<div>" * 3000 + "deep")
    assert html_text.main_text("<a " + "x'\"" * 20_000) == ""


@pytest.mark.parametrize("name,html", [
    ("ends of nothing", "<i>" * 100_000 + "</b>" * 100_000 + "word"), ("nested marks", "<div class='ad'>" * 20_000 + f"<p>{LONG}</p>"), ("marks with text", f"<div class='ad'>x<p>{LONG}</p>" * 5_000),
    ("ends across blocks", "<b>" + "<div>" * 20_000 + "</b>" * 20_000 + "word"), ("lines in inline elements", "<i>" * 20_000 + "<hr>" * 20_000 + "word"), ("forms", f"<form><h1>x</h1><p>{LONG}</p>" * 3_000),
    ("comment headings", "<div>" * 5_000 + "<h3>Comments</h3>" * 5_000 + "word"),
])
def test_time_is_in_proportion(name, html):
    began = time.process_time()
    html_text.main_text(html)
    assert time.process_time() - began < 4


def test_report(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"u{i}", h, "x", 5) for i, (_, h, _) in enumerate(CASES)] * 2, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.report(df).collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        assert r.text == "\n".join(CASES[r.page_id][2]) and r.n_chars == len(r.text)
    assert html_text.report(df.limit(0)).count() == 0


def plain_text(found):
    """Both passes over (kind, place, text) of blocks outside articles, each rule as it is said; kind: p, h, div, link or out."""
    stop = lambda t: sum(w in html_text.STOP_WORDS for w in re.findall(r"[^\W\d_]+", t.lower())) / max(1, len(re.findall(r"[^\W\d_]+", t)))
    label = []
    for kind, _, t in found:
        if kind in ("out", "link"):
            label.append("bad")
        elif len(t) < 70:
            label.append("bad" if "\xa9" in t else "short")
        elif len(t) > 200 and stop(t) >= 0.3:
            label.append("good")
        else:
            label.append("near" if stop(t) >= 0.2 else "open")
    out = []
    for i, (kind, place, t) in enumerate(found):
        own = label[i]
        if own not in ("good", "bad"):
            near_good = kind in "ph" and any(x == "good" and k in "ph" and p == place for x, (k, p, _) in zip(label, found, strict=True))

            def voices(j):
                k, p, _ = found[j]
                if label[j] not in ("good", "bad") or (near_good and not (k in "ph" and p == place)):
                    return False
                return k != "out" or "good" in label

            left = next((j for j in range(i - 1, -1, -1) if voices(j)), None)
            right = next((j for j in range(i + 1, len(found)) if voices(j)), None)
            sides = {label[j] for j in (left, right) if j is not None}
            if not sides or (sides == {"bad"} and own in ("near", "open") and "good" not in label):
                own = "good"
            elif len(sides) == 1:
                own = sides.pop()
            elif own == "near" or (kind == "h" and label[right] == "good") or i - left == right - i:
                own = "good"
            else:
                own = label[left if i - left < right - i else right]
        if own == "good":
            out.append(t)
    return "\n".join(out)


def test_both_passes_against_a_plain_version():
    rng = random.Random(4)
    few = "zor bek lum tri "
    texts = [lambda: LONG * rng.randrange(1, 3), lambda: "the road of " + few * 6, lambda: few * 20, lambda: few, lambda: "Read on in the town", lambda: "\xa9 2020 Zor", lambda: LONG[:150]]
    for _ in range(400):
        html, found = "", []
        for place in range(rng.randrange(1, 5)):
            html += "<section>"
            for _ in range(rng.randrange(1, 6)):
                kind, text = rng.choice(["p", "p", "h", "div", "link", "out"]), rng.choice(texts)().strip()
                found.append((kind, place, text))
                html += {"p": "<p>{}</p>", "h": "<h2>{}</h2>", "div": "<div>{}</div>", "link": "<ul><li><a href=x>{}</a></li></ul>", "out": "<footer>{}</footer>"}[kind].format(text)
            html += "</section>"
        assert html_text.main_text(page(html)) == plain_text(found), found


PAGES = Path("/root/testdata/sf0.01/pages.parquet")


@pytest.mark.skipif(not PAGES.exists(), reason="no test tables here")
def test_pages_against_their_own_markup(spark):
    """These pages' articles hold headings, paragraphs, b and br alone, so plain cuts give the text."""
    pages = spark.read.parquet(str(PAGES))
    for r, got in zip(pages.orderBy("page_id").collect(), html_text.report(pages).orderBy("page_id").collect(), strict=True):
        article = r.html.partition("<article>")[2].partition("</article>")[0]
        cuts = (" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", article))
        assert got.text == "\n".join(filter(None, cuts))


@pytest.mark.skipif(not PAGES.exists(), reason="no test tables here")
def test_pages_without_article_elements(spark):
    """The rules alone find the same text, and so does the plain version of them."""
    for r in spark.read.parquet(str(PAGES)).collect():
        html = re.sub("</?article>", "", r.html)
        found = []
        for m in re.finditer("<(li|div class=\"ad\"|h1|p|footer)>(.*?)(?=<(?:li|div|h1|p|footer|/nav|/body)\\b|$)", html.partition("<body>")[2], re.S):
            text = " ".join(unescape(re.sub("<[^>]*>", " " if "<br" in m[2] else "", m[2])).split())
            if text:
                found.append(({"h1": "h", "p": "p"}.get(m[1], "out"), 0, text))
        assert html_text.main_text(html) == html_text.main_text(r.html) == plain_text(found)
