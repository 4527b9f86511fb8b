"""Main text of pages: against the text that generated pages were made from, odd markup, and long pages."""

import html
import random
import re
import time

import pytest

from geoloom.llm.html_text import extracted, main_text

WORDS = "river stone, garden light morning, paper window, quiet harbour summer field, letter music".split(" ")
WRAPPERS = ["layout has-sidebar", "story comments-open", "page-template-no-sidebar", "content", "row two-column-with-sidebar", "", "wrap nav-hidden", "entry-content"]
JUNK = ["sidebar", "site-footer", "cookie-notice", "related-posts", "comments-area", "share-buttons", "nav main-menu", "ad ad-slot", "newsletter-signup", "breadcrumbs"]
BITS = ['<svg class="i"/>', '<svg viewBox="0 0"><path d="M0"/><text>no</text></svg>', "<select><option>no<option>no", "<select><option>no</select>", "<object data=x>", "<!-- no -->", "<script>var no = '<p>no</p>';</script>", "<style>p{}</style>", "<canvas>", "<noscript><p>no</p></noscript>", "<hr>"]


def paragraph(rng, n=None):
    return " ".join(rng.choice(WORDS) for _ in range(n or rng.randint(14, 60))).strip(",") + "."


def made(rng):
    """(page, blocks of its article)."""
    out, want = [], []

    def block(tag, text, name=""):
        noted = text.replace("stone", "st<b>o</b>ne").replace("light", "light &amp; <a href='/x'>glow</a>")
        want.append(" ".join(text.replace("light", "light & glow").split()))
        out.append(f"<{tag}{name}>{noted}" + ("" if tag in ("li", "p") and rng.random() < 0.4 else f"</{tag}>"))

    body = rng.random() < 0.5
    open_, close = ("<article>", "</article>") if body else ("<div class='post'>", "</div>")
    block("h1", paragraph(rng, 4))
    for _ in range(rng.randint(2, 8)):
        kind = rng.random()
        out.append(rng.choice(["", *BITS]))
        if kind < 0.6:
            block("p", paragraph(rng))
        elif kind < 0.75:
            block("h2", paragraph(rng, 3), ' class="section-header"')
            block("p", paragraph(rng))
        else:
            out.append("<ul>")
            for _ in range(rng.randint(1, 4)):
                block("li", paragraph(rng, 6))
                if rng.random() < 0.3:
                    out.append("<ol>")
                    block("li", paragraph(rng, 5))
                    out.append("</ol></li>")
            out.append("</ul>")
    junk = [f'<div class="{rng.choice(JUNK)}"><p>{paragraph(rng)}</p><ul><li><a href=/a>a</a></ul></div>' for _ in range(4)]
    page = f"""<!doctype html><html><head><title>T</title><body><header class="site-header"><h2>Site</h2></header><nav><a href=/>Home</a></nav>{junk[0]}
    <div class="{rng.choice(WRAPPERS)}"><div class="{rng.choice(WRAPPERS)}">{open_}{"".join(out)}{close}{junk[1]}</div>{junk[2]}<aside><p>{paragraph(rng)}</p></aside></div>{junk[3]}<footer><p>{paragraph(rng)}</p>"""
    return page, want


@pytest.mark.parametrize("seed", range(300))
def test_generated_pages(seed):
    page, want = made(random.Random(seed))
    assert main_text(page).split("\n\n") == want


def test_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    for r in extracted(pages).join(pages, ["page_id", "url"]).collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_html_shapes(spark):
    page = """<header><h1>Site</h1><nav><a href=x>Home</a></nav></header><div id="cookie-notice"><p>We use cookies, really, many.</p></div>
    <div class="wrap"><main><h1>Title</h1><p>One, two &amp; three&nbsp;x <a href=y>link</a></p><div>loose &lt; text<ul><li>a<li>b</ul></div><script>var a="<p>no</p>";</script><!-- <p>no</p> -->
    <form><p>Email</p></form><section class="comments"><p>First, I say, nice, very nice.</p></section></main><aside><p>Related, more, and more, text here.</p></aside></div><footer><p>Foot, note, long, text, here.</p></footer>"""
    assert main_text(page) == "Title\n\nOne, two & three x link\n\nloose < text\n\na\n\nb"
    assert [main_text(x) for x in ("", "plain", "<p>a<p>b", "<!-- x", "<div" * 3, "<nav>x</nav>", "<article></article>")] == ["", "plain", "a\n\nb", "", "<div<div<div", "", ""]


LONG = "A paragraph, with commas, and enough words to be one of an article, as it seems."


@pytest.mark.parametrize(
    "page",
    [
        f'<article><p>{LONG}<svg class="i"/><p>end</article>',
        f"<article><p>{LONG}<select><p>end</article><footer><select><option>x</select></footer>",
        f"<article><p>{LONG}<p><object data=x>end</article>",
        f"<article><p>{LONG}<p><button>end</article>",
        f"<article><p>{LONG}<svg><path d='x'><p>end</article>",
        f"<title/><article><p>{LONG}<iframe src=x /><p>end</article>",
        f"<article><p>{LONG}<textarea><p>end</article>",
        f"<article><p>{LONG}<script>var x = 1;<p>end</article>",
        f"<article><p>{LONG}<!-- never closed ><p>end</article>",
        f'<article><p>{LONG}<a title="never closed><p>end</article>'.replace('"never', '"quoted" x="never'),
        f"<head><title>t</title><p>{LONG}<p>end",
        f"<form id=all><div><p>{LONG}<p>{LONG}<p>end</div></form>".replace(f"{LONG}<p>{LONG}", f"{LONG}"),
        f'<div class="layout has-sidebar"><p>{LONG}<p>end</div>',
        f'<div class="story comments-open"><p>{LONG}<p>end<div class="comments"><p>Nice, said a reader, very nice, and long, too.</div></div>',
        f'<div class="content-sidebar-wrap"><div class="content"><p>{LONG}<p>end</div><div class="sidebar"><p>{LONG}</div></div>',
        f'<div data-id="menu" title="hidden gems"><p>{LONG}<p>end</div>',
        f'<nav><a href=x>Home</a><div class=post><p>{LONG}<p>end</div>',
        f'<div class=modal><main><p>{LONG}<p>end</main></div>',
    ],
)
def test_nothing_of_the_article_is_lost(page):
    assert main_text(page) == f"{LONG}\n\nend"


SLUGS = ["advertising", "share", "subscribe", "related-work", "social-theory", "navigation", "comments-on-method", "menu", "sponsored-research", "footer", "newsletter"]


@pytest.mark.parametrize("seed", range(60))
def test_names_never_drop_what_an_article_says(seed):
    """Ids made of headings, topics as names of sections and paragraphs, and labels in sentences; true adverts and link lists go."""
    rng = random.Random(seed)
    out, want = [], []
    tag = rng.choice(["article", "main"])
    for _ in range(rng.randint(3, 8)):
        slug, title, text = rng.choice(SLUGS), paragraph(rng, 3), paragraph(rng, rng.randint(30, 60))
        head = f"<h{rng.randint(2, 4)} id='{slug}'>{title}</h2>".replace("</h2>", "")
        head += f"</{head[1:3]}>"
        kind = rng.random()
        if kind < 0.3:
            out.append(f"{head}<p>{text}</p>")
        elif kind < 0.5:
            out.append(f"<section id='{slug}'><h2 id='{slug}-2'>{title}</h2><p>{text}</p></section>")
        elif kind < 0.7:
            out.append(f"<section class='{rng.choice(['related-work', 'social', 'share', 'notice', 'banner'])}'><h3>{title}</h3><p>{text}</p></section>")
        elif kind < 0.85:
            out.append(f"{head}<p class='{rng.choice(['notice', 'menu', 'related-work', 'side'])}' id='{slug}'>{text}</p>")
        else:
            text = "Press the Enter key, " + text
            out.append(f"{head}<p>{text.replace('Enter', '<label>Enter</label>')}</p>")
        want += [title, text]
        out.append(rng.choice(["", f"<div class='ad'><p>{paragraph(rng)}</p></div>", "<div class='share-buttons'><a href=x>Tweet</a> <a href=y>Mail</a></div>", "<div id='newsletter'><label>Mail</label> Sign up</div>", "<div class='related-posts'><ul><li><a href=x>One more, and another</a></ul></div>", f"<section class='comments'><p>{paragraph(rng)}</p></section>"]))
    page = f"<body><nav id=menu><a href=/>Home</a></nav><{tag}>{''.join(out)}</{tag}><div id='sidebar'><p>{paragraph(rng)}</p></div><footer>{paragraph(rng)}</footer>"
    assert main_text(page).split("\n\n") == want


def test_ids_outside_article_elements():
    assert main_text(f"<div class=post><h2 id='advertising'>Advertising in 1920</h2><p>{LONG}</p><section id='related-work'><p>{LONG}</p></section></div>") == f"Advertising in 1920\n\n{LONG}\n\n{LONG}"
    assert main_text(f"<div class=post><p>{LONG}</p></div><div id='related-links'><a href=x>{LONG}</a></div><form><p>Say <label>this</label> or that, if you like</p></form>") == LONG


def test_readers_comments_never_are_the_article():
    talk = "".join(f"<div class='comment'><p>{LONG}</p></div>" for _ in range(50))
    assert main_text(f"<div class=post><p>Short, but it is all.</p></div><div class='comments'>{talk}</div>") == "Short, but it is all."
    assert main_text(f"<div class=post><p>Short, but it is all.</p></div><section id=comments>{talk.replace('comment', 'c')}</section>") == "Short, but it is all."


@pytest.mark.parametrize(
    "part",
    ["<a ", '<a "', "<div>", "</b>", "<td></td>", "<span>", "<!--", "<script>", "<a '\">", "<p>x, y</p>", "<ul><li>", "<a href=x><div>", "<div class='sidebar'>x, y ", "<select><option>", "</", "<", "&", "<a b='\">"],
)
def test_time_grows_with_the_page(part):
    def took(n):
        page = "<div>" * (n // 50) + part * (n // len(part)) + "</i>" * (n // 50) + "<div></div>" * (n // 50)
        begin = time.process_time()
        main_text(page)
        return time.process_time() - begin

    assert took(400_000) < 20 * max(took(40_000), 0.02)


def test_long_page_and_odd_rows(spark):
    long = "<article>" + f"<p>{LONG}</p>" * 15_000 + "</article>"
    rows = [(1, long, "x", 5), (1, long, "x", 5), (2, None, None, None), (None, "", "y", 1), (3, " ", "z", 2)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars long")
    got = sorted(((r["page_id"] or 0, r["n_chars"], r["text"]) for r in extracted(df).collect()))
    full = "\n\n".join([LONG] * 15_000)
    assert got == [(0, 0, ""), (1, len(full), full), (1, len(full), full), (2, 0, ""), (3, 0, "")]
    assert extracted(df.limit(0)).collect() == []
