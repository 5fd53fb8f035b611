import random

import pytest

from tapeloom.llm.html_text import extract, main_text

LONG = "This is a paragraph of some length, with commas, and words enough to count as prose, as articles have."


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>t</title></head><body></body></html>", ""),
        ("<article>short</article>", "short"),
        ("plain text without a tag", "plain text without a tag"),
        (f"<body><nav><a href=/>Home</a></nav><article><h1>T &amp; x</h1><p>{LONG}<br>a&#233; b<p><b>bo</b>ld</article><footer>f</footer></body>", f"T & x {LONG} aé b bold"),
        (f'<div class="ad">{LONG}</div><div id="main"><p>{LONG}</p><div class="share"><a>x</a></div><p>tail</p></div>', f"{LONG} tail"),
        (f"<body><header><h1>Site</h1></header><main><p>{LONG}</p><aside>{LONG}</aside><form>{LONG}</form></main><section class=comments><p>{LONG}</p></section>", LONG),
        (f"<article><script>var t='</p>';</script><style>p{{}}</style><p>{LONG}</p><!-- {LONG} --><noscript>n</noscript></article>", LONG),
        (f'<article><p>{LONG}</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><ol><li>kept, item</ol></article>', f"{LONG} kept, item"),
        (f"<div><div><p>{LONG}</p></div><div><p>{LONG}</p><p>{LONG}</p></div></div>", f"{LONG} {LONG} {LONG}"),
        (f"<article><header><h1>Head</h1></header><p>{LONG}</p><div role=alert>no</div><p hidden>no</p></article>", f"Head {LONG}"),
        (f"<article><p>{LONG}</article></div></b><p>", LONG),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


LINKS = "".join(f"<li><a href={i}>source {i}</a>" for i in range(4))
LINK_TEXT = " ".join(f"source {i}" for i in range(4))


@pytest.mark.parametrize(
    "html,text",
    [
        (f"<body><div class='content with-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<body><div id='page' class='has-header'><p>{LONG}</p><div class='site-header'>no</div></div>", LONG),
        (f"<body><form action=x><label>no</label><input><p>{LONG}</p><p>{LONG}</p><select><option>no</select></form>", f"{LONG} {LONG}"),
        (f"<body><form><div class=menu>no</div><article><p>{LONG}</p></article><button>no</button></form>", LONG),
        (f"<body><div class=sidebar><main><p>{LONG}</p></main></div><div class=sidebar><p>{LONG}</p><p>{LONG}</p></div>", LONG),
        (f"<article><div class='article-header'><h1>Head</h1></div><p>{LONG}</p></article>", f"Head {LONG}"),
        (f"<article><p>{LONG}</p><h2>References</h2><ul>{LINKS}</ul></article>", f"{LONG} References {LINK_TEXT}"),
        (f"<article><p>{LONG}</p><div><ol class=references>{LINKS}</ol></div></article>", f"{LONG} {LINK_TEXT}"),
        (f"<article><p>{LONG}</p><ul class=related>{LINKS}</ul><div class=toc><ol class=toc>{LINKS}</ol></div></article>", LONG),
        (f"<body><div><p>{LONG}</p></div><div class=comments><article><p>{LONG}</p><p>{LONG}</p></article></div>", LONG),
    ],
)
def test_names_forms_and_references(html, text):
    assert main_text(html) == text


def test_generated_pages():
    """Pages composed of known blocks come back as exactly the article's blocks."""
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma,", "delta", "é&lt;b&gt;", "x&nbsp;y"]
    junk = ["<nav>{}</nav>", '<div class="sidebar">{}</div>', "<footer>{}</footer>", '<div id="cookie-notice">{}</div>', "<form><p>{}</p></form>", '<section id="comments"><p>{}</p></section>']
    for _ in range(300):
        say = lambda n: " ".join(rng.choices(words, k=n))
        blocks = [say(rng.randrange(1, 80)) for _ in range(rng.randrange(1, 8))]
        shapes = ["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<p><b>{}</b></p>", "<blockquote>{}</blockquote>", "<div>{}</div>"]
        body = "".join(rng.choice(shapes).format(b) for b in blocks)
        around = [rng.choice(junk).format(say(rng.randrange(1, 120))) for _ in range(4)]
        page = f"<html><body>{around[0]}{around[1]}<article>{body}</article>{around[2]}{around[3]}</body></html>"
        want = " ".join(" ".join(b.replace("&lt;", "<").replace("&gt;", ">").replace("&nbsp;", " ").split()) for b in blocks)
        assert main_text(page) == want


def test_deep_and_long():
    assert main_text("<div>" * 20_000 + LONG + "</div>" * 20_000) == LONG
    text = main_text("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>")
    assert len(text) == 5000 * (len(LONG) + 1) - 1


def test_extract(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "x", 5), (1, "u", f"<p>{LONG}</p>", "x", 5), (None, None, None, None, None), (2, "", "<p>é😀</p>", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in extract(pages).collect()), key=repr)
    assert got == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (2, "", "é😀", 2)], key=repr)
    assert extract(pages.limit(0)).count() == 0
