import time
import random

import pytest

from colloquy.llm import html

ARTICLE = "<article><h1>A  title</h1><p>First paragraph, with &amp; and &eacute; in it.<p>Second\n paragraph<br>goes on.</article>"
TEXT = "A title\nFirst paragraph, with & and é in it.\nSecond paragraph goes on."


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{ARTICLE}</body>",
        f'<html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">Buy this, now.</div>{ARTICLE}<footer>&copy; me</footer></body></html>',
        f'<body><header><p>The site, its name.</p></header>{ARTICLE}<aside><p>Read this, too.</p></aside><section id="comments"><p>I think, therefore, I comment.</p></section></body>',
        f'<body><div class="cookie-notice"><p>We use, of course, cookies.</p></div><form><p>Your name, please</p></form>{ARTICLE}<div class="sidebar"><p>More, more, more.</p></div></body>',
        f'<body><div id="main-wrapper">{ARTICLE}</div><div style="display:none">hidden, text</div><div class="related-posts"><ul><li><a href="b">Another story, here</a></li></ul></div></body>',
        f'<body><!-- <p>no, not this</p> -->{ARTICLE.replace("</article>", "")}',
        ARTICLE.replace("<p>Second", '<div class="advert">Advert, advert</div><p>Second'),
        ARTICLE.replace("</article>", '<div class="comments"><div class="comment"><p>A reader, says this.</p></div></div></article>'),
        ARTICLE.replace("</article>", '<ul><li><a href="1">one</a></li><li><a href="2">two</a></li><li><a href="3">three</a></li></ul></article>'),
        f'<body><div class="content with-sidebar"><div class="header">Site, name</div>{ARTICLE.replace("<h1>", "<header class='entry-header'><h1 class='header'>").replace("</h1>", "</h1></header>")}</div><div class="sidebar">Side, text</div></body>',
        ARTICLE.replace("</article>", '<div class="entry-footer">Filed under, things</div><div class="post-share">Share, this</div></article>'),
        ARTICLE.replace("First", "<b>First").replace("with", "<a href='x'>with</a>"),
    ],
)
def test_article(page):
    assert html.main_text(page) == TEXT


def test_div_page_without_hints():
    body = "".join(f"<p>Sentence number {i}, which is long enough, goes here.</p>" for i in range(5))
    menu = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(9))
    page = f"<body><div><ul>{menu}</ul></div><div>{body}</div><div><a href='/x'>About</a> <a href='/y'>Contact</a></div></body>"
    assert html.main_text(page) == "\n".join(f"Sentence number {i}, which is long enough, goes here." for i in range(5))


@pytest.mark.parametrize("page", ["", "<", "<p", "<!-- open", "<script>var x", "&", "</p></div>", "<body></body>", "<a href='" + "x" * 10])
def test_broken_pages_do_not_raise(page):
    assert isinstance(html.main_text(page), str)


def test_lists_and_tables():
    page = "<article><p>Intro, first.</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><pre> x\n y </pre></article>"
    assert html.main_text(page) == "Intro, first.\none\ntwo\na\nb\nx y"


def test_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = html.extract(pages).collect()
    assert len(rows) == pages.count()
    assert all(r.n_chars == len(r.text) and r.text for r in rows)
    assert not any(w in r.text for r in rows for w in ("©", "track(", "<p>", "</"))


def test_edge_cases(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", "y"), (2, "v", "<p>" + "long, " * 100_000, "z"), (3, None, "plain text, no markup", None)]
    found = {(r.page_id, r.url): r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert found[1, "u"].text == "" and found[None, None].n_chars == 0
    assert found[2, "v"].text == ("long, " * 100_000).strip() and found[3, None].text == "plain text, no markup"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("wrap", ["<form action='/p'>{}</form>", "<form><fieldset><input name='q'><label>Search</label>{}<button>Go</button></fieldset></form>", "<form><div>{}</div><fieldset><p>Your name, please</p></fieldset></form>"])
def test_a_page_in_a_form_keeps_its_text(wrap):
    assert html.main_text(f"<body>{wrap.format(ARTICLE)}</body>") == TEXT
    plain = ARTICLE.replace("article>", "div>")
    assert html.main_text(f"<body>{wrap.format(plain)}</body>") == TEXT


LONG = "The third paragraph is long enough to be prose, of more than eighty characters, and has few links."


@pytest.mark.parametrize("attrs", ["id='discussion'", "class='related-work'", "class='feedback'", "id='responses'", "class='alert'", "id='announcement'", "class='tags'"])
def test_names_alone_drop_no_paragraphs(attrs):
    assert html.main_text(ARTICLE.replace("</article>", f"<section {attrs}><h2>Part</h2><p>{LONG}</p></section></article>")) == f"{TEXT}\nPart\n{LONG}"


@pytest.mark.parametrize("block", [f"<section class='responses'><div class='comment'><p>{LONG}</p></div></section>", f"<div class='related'><p><a href='x'>{LONG}</a></p></div>", f"<div class='hidden'><p>{LONG}</p></div>", "<div class='tags'>one, two</div>", f"<div class='ad'><p>{LONG}</p></div>"])
def test_named_blocks_of_another_shape_are_dropped(block):
    assert html.main_text(ARTICLE.replace("</article>", f"{block}</article>")) == TEXT


def test_lists_of_references_stay_and_menus_go():
    entries = "".join(f"<li><a href='{i}'>Paper {i}</a></li>" for i in range(4))
    assert html.main_text(ARTICLE.replace("</article>", f"<h2>References</h2><ol>{entries}</ol></article>")) == f"{TEXT}\nReferences\nPaper 0\nPaper 1\nPaper 2\nPaper 3"
    assert "Paper" not in html.main_text(ARTICLE.replace("</article>", f"<ul>{entries}</ul></article>"))


def test_a_title_and_a_short_paragraph_beside_the_best_div_stay():
    body = "".join(f"<p>{LONG}</p>" for _ in range(4))
    page = f"<body><div><a href='/'>Home</a></div><h1>A title</h1><p>By a writer.</p><div>{body}</div><p>The end.</p><h3>More</h3><div><a href='/x'>About</a></div></body>"
    assert html.main_text(page) == "\n".join(["A title", "By a writer.", *[LONG] * 4, "The end."])


@pytest.mark.parametrize("part", ["<svg/>", "<svg viewBox='0 0 1 1' />", "<iframe src='x'/>", "<iframe src=x>", "<select><option>a<option>b", "<svg><path d='x'>", "<object data='x'>", "<script src='x'/>", "<svg><text>label</text></svg>", "<select><option>a</select>", "<svg><foreignObject><div>label</div></foreignObject></svg>", "<label>label</label>", "<span hidden>label</span>"])
def test_foreign_elements_end_where_they_should(part):
    assert html.main_text(ARTICLE.replace("<p>Second", f"{part}<p>Second")) == TEXT
    assert html.main_text(ARTICLE.replace("in it.", f"in it.{part}")) == TEXT


def test_formulas_stay():
    page = ARTICLE.replace("in it.", "in it, <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math> here.")
    assert html.main_text(page) == TEXT.replace("in it.", "in it, E=m here.")


def test_comments_that_are_articles_go_and_names_that_deny_stay():
    assert html.main_text(ARTICLE.replace("</article>", f"<article class='comment'><p>{LONG}</p></article></article>")) == TEXT
    assert html.main_text(f"<body>{ARTICLE}<div class='no-print sidebar'><p>{LONG}</p></div></body>") == TEXT
    assert html.main_text(ARTICLE.replace("</article>", f"<div class='no-sidebar'><p>{LONG}</p></div></article>")) == f"{TEXT}\n{LONG}"


def test_short_divisions_beside_the_best_one():
    body = "".join(f"<p>{LONG}</p>" for _ in range(4))
    page = f"<body><h1>A title</h1><div>{body}</div><div><p>The end.</p></div><div><p>© A company</p></div></body>"
    assert html.main_text(page) == "\n".join(["A title", *[LONG] * 4, "The end."])


def test_lists_of_links_that_a_text_introduces():
    entries = "".join(f"<li><a href='{i}'>Paper {i}</a></li>" for i in range(3))
    want = "Paper 0\nPaper 1\nPaper 2"
    assert html.main_text(ARTICLE.replace("</article>", f"<p>As in:</p><ul>{entries}</ul></article>")) == f"{TEXT}\nAs in:\n{want}"
    assert html.main_text(ARTICLE.replace("</article>", f"<ol>{entries.replace('Paper', 'The paper')}</ol></article>")) == f"{TEXT}\n{want.replace('Paper', 'The paper')}"


def random_page(r):
    """A page and its main text."""

    def sentence():
        return " ".join(r.choice(["alpha", "beta,", "gamma", "delta", "&eacute;psilon", "a &lt; b", "<b>zeta</b>", "<a href='x'>eta</a>", "iota"]) for _ in range(r.randint(12, 40))) + "."

    def plain(text):
        for tag in ("<b>", "</b>", "<a href='x'>", "</a>"):
            text = text.replace(tag, "")
        return " ".join(text.replace("&eacute;", "é").replace("&lt;", "<").split())

    chrome = [
        "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>Blog</a></li><li>Third</li></ul></nav>",
        "<aside><p>Read this, too, and that.</p></aside>",
        "<div class='ad'>Buy it, now.</div>",
        "<form><label>Mail</label><input name='m'><button>Send</button></form>",
        "<script>var x = '<p>no</p>';</script>",
        "<style>p > a { color: red }</style>",
        "<section id='comments'><div class='comment'><p>I think, therefore.</p></div></section>",
        "<!-- <p>not this</p> -->",
        "<div class='cookie-banner'><p>We use, of course, cookies.</p></div>",
        "<svg><text>x</text></svg>",
    ]
    inside, want = [], []
    for _ in range(r.randint(3, 9)):
        kind = r.choice(["p", "p", "p", "h2", "ul", "pre", "blockquote"])
        texts = [sentence() for _ in range(r.randint(1, 3) if kind == "ul" else 1)]
        want += [plain(t) for t in texts]
        inside.append("<ul>" + "".join(f"<li>{t}</li>" for t in texts) + "</ul>" if kind == "ul" else f"<{kind}>{texts[0]}" + (f"</{kind}>" if kind != "p" or r.random() < 0.7 else ""))
        if r.random() < 0.3:
            inside.append(r.choice(chrome))
    tag = r.choice(["article", "main", "div"])
    sides = ["".join(r.choice(chrome) for _ in range(r.randint(0, 3))) for _ in range(2)]
    return f"<html><head><title>t</title></head><body>{sides[0]}<{tag}>{''.join(inside)}</{tag}>{sides[1]}<footer><p>&copy; me, all rights.</p></footer></body></html>", "\n".join(want)


def test_random_pages_give_the_text_they_were_made_of():
    r = random.Random(11)
    for _ in range(400):
        page, want = random_page(r)
        assert html.main_text(page) == want, page


def test_columns_that_clash_are_ignored(spark):
    rows = [(1, "u", "<p>one</p>", 7, "x")]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string"))
    assert found.columns == ["page_id", "url", "text", "n_chars"] and tuple(found.first()) == (1, "u", "one", 3)


def test_words_of_labels_and_buttons_stay_in_their_line():
    assert html.main_text("<p>A <label>term</label> here and more words follow in it.</p>") == "A term here and more words follow in it."
    assert html.main_text("<article><p>Press <button>OK</button> now to go on.</p><button>Share</button><div><label>Name</label></div></article>") == "Press OK now to go on."
    assert html.main_text("<form><label>Name</label><input><button>Send</button></form><p>Text of it, with words.</p>") == "Text of it, with words."


HOSTILE = {
    "nested": "<div>" * 30_000 + "text " * 30,
    "nested with text": "".join(f"<div>line {i}" for i in range(15_000)),
    "nested and named": "<div class=related>x" * 15_000,
    "lists": "<ul><li><a href=x>a</a><li><a>b</a><li><a>c</a></ul>" * 10_000,
    "inline": "<p>" + "<b>" * 20_000 + "</i>x" * 20_000,
    "headings": "<p>" + "<h1>" * 20_000,
    "entries": "<ul>" + "<b>" * 15_000 + "<li>x" * 15_000,
    "forms": "<form>x" * 15_000,
    "headers": "<header>x" * 15_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_time_grows_with_the_page(name):
    """Four times the page takes some four times as long, not sixteen."""
    took = []
    for page in (HOSTILE[name][: len(HOSTILE[name]) // 4], HOSTILE[name]):
        began = time.process_time()
        html.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 9 * took[0] + 0.3, took
