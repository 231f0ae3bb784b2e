import html as H
import re

import pytest

from colloquy.llm import op6_html as op

P = "A sentence, with marks. And another one; long enough to be text of an article."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<html><body><nav><a href=x>Home</a></nav></body></html>", ""),
        (f"<body><nav><ul><li><a>Menu</a></li></ul></nav><article><h1>Head</h1><p>{P}</p><p>Yes.</p></article><footer>&copy; x, y. z</footer>", f"Head\n{P}\nYes."),
        (f"<article><h1>T &amp;am &am</h1><p><b>{P}<br><p>{P}</article></body>", f"T &am &am\n{P}\n{P}"),
        (f"<script>var a='</p><p>{P}</p>';</script><style>p{{}}</style><!-- <p>{P}</p> --><div><p>{P}</p></div>", P),
        (f"<body><div class=ad>{P}</div><div class='side-bar sidebar'><p>{P}</p></div><div class=content><h2>Title</h2><p>a  b\n\t c &lt;i&gt; {P}</p></div><div id=comments><p>{P}</p></div></body>", f"Title\na b c <i> {P}"),
        (f"<main><p>{P}</p><form><p>{P}</p></form><aside>{P}</aside><section class=comments><p>{P}</p></section><p>one <a>li</a>nk, done.</p></main>", f"{P}\none link, done."),
        (f"<article><p>{P}</p><p>1 < 2 and <b>3</b> > 2</p></article><div hidden>{P}</div><p>cut <a href='", f"{P}\n1 < 2 and 3 > 2"),
        (f"<article><ul><li>one, a<li>two, b</ul><table><tr><td>{P}<td>x</table></article>", f"one, a\ntwo, b\n{P}\nx"),
    ],
)
def test_pages(page, text):
    assert op.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<body><div class="content has-sidebar"><p>{P}</p><p>{P}</p><p>{P}</p></div></body>', f"{P}\n{P}\n{P}"),
        (f'<body class="no-sidebar"><nav>x</nav><div><p>{P}</p><p>{P}</p></div></body>', f"{P}\n{P}"),
        (f'<article><p>{P}</p><p class="social-history">{P}</p><div class="zzbox">Buy our shoes now</div><p>{P}</p></article>', f"{P}\n{P}\n{P}"),
        (f'<article><h1>Head</h1><p>{P}</p><div class="zzbox"><h3>Sale</h3><p>Buy our shoes now</p></div><p>Yes.</p></article>', f"Head\n{P}\nYes."),
        (f'<div class="page sidebar"><p>{P}</p><p>{P}</p></div><div class="box">Home</div>', f"{P}\n{P}"),
        (f'<div class="site-footer"><p>{P}</p></div><div class="story"><h2 class="x1">Title here</h2><p class="t">{P}</p><p class="t">No.</p><p class="t">{P}</p></div><div id="comment-list"><p>{P}</p><p>{P}</p><p>{P}</p><p>{P}</p></div>', f"Title here\n{P}\nNo.\n{P}"),
        (f'<div class="cookieNotice"><p>{P}</p></div><main class="has-comments"><p>{P}</p><ul><li>Apples</li><li>Pears</li></ul><ul><li><a>Share</a></li><li><a>Mail</a></li></ul><p>{P}</p></main>', f"{P}\nApples\nPears\n{P}"),
        (f'<table><tr><td class="menu-left"><a>Home</a> <a>News</a></td><td class="text"><p>{P}</p><p>{P}</p></td></tr></table>', f"{P}\n{P}"),
        (f'<div role="navigation">Home, news.</div><div id="wrap"><div class="headline">A short headline</div><div class="para">{P}</div><div class="para">Yes.</div><div class="para">{P}</div><div class="ad-box">{P}</div></div>', f"A short headline\n{P}\nYes.\n{P}"),
    ],
)
def test_ratios_decide_and_names_only_scale(page, text):
    assert op.main_text(page) == text


def test_repeated_rows_and_ties(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{P}</p>")] * 3 + [(1, "u", f"<p>{P}</p><p>{P}</p>")], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in op.extract(df).collect()) == [len(P)] * 3 + [2 * len(P) + 1]


def test_long_and_deep_pages():
    body = "".join(f"<p>{P} {i}</p>" for i in range(20_000))
    assert op.main_text(f"<nav>x</nav><article>{body}</article>").count("\n") == 19_999
    assert op.main_text("<div>" * 3000 + P + "</div>" * 3000) == P


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{P}</p></article>"), (1, None, None), (None, "v", "")], "page_id long, url string, html string").selectExpr("*", "'z' as text")
    got = sorted((tuple(r) for r in op.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", P, len(P)), (1, None, "", 0), (None, "v", "", 0)], key=str)
    assert op.extract(df.limit(0)).collect() == []


def test_query_gives_the_article_of_every_page(spark):
    """The tables' pages have one article each, whose blocks can be cut out by its tag alone."""
    got = {r.page_id: r.text for r in op.op6_main_text(spark, "/root/testdata/sf0.01").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b), r.page_id


@pytest.mark.parametrize("many", [63, 2000])
@pytest.mark.parametrize("tag", ["div", "section", "blockquote"])
def test_one_long_block_does_not_drop_its_siblings(tag, many):
    short = [f"{P} {P} Number {i}." for i in range(10)]
    long = " ".join([P] * many)
    shorts = [f"<div>{s}</div>" for s in short]
    page = f"<body><nav><a>Home</a></nav><div><h2>Title</h2>{''.join(shorts[:5])}<{tag}>{long}</{tag}>{''.join(shorts[5:])}</div><div><a>Next</a></div></body>"
    assert op.main_text(page) == "\n".join(["Title", *short[:5], long, *short[5:]])


def test_long_cell_and_lead_of_a_long_section():
    long = " ".join([P] * 63)
    assert op.main_text(f"<body><table><tr><td>{P}</td><td>{long}</td></tr></table></body>") == f"{P}\n{long}"
    assert op.main_text(f"<body><div>{P} {P}</div><section><p>{long}</p><p>{long}</p><p>{long}</p></section></body>") == "\n".join([f"{P} {P}", long, long, long])
    assert op.main_text(f"<body><div>Daily, fresh.</div><div><p>{P}</p><p>{P}</p></div><div>(c) X, all rights.</div></body>") == f"{P}\n{P}"
