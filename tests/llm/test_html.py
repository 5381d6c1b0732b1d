"""Main text of hand-made pages."""

import re
from html import unescape

import pytest

from segspark.llm.html import main_text
from segspark.llm.queries import op3_html

SF = "/root/testdata/sf0.001"
LONG = "A long paragraph of the article, with enough words in it to be told from what stands around it, and then some more."
PAGES = [
    (None, ""),
    ("", ""),
    ("plain text &amp; more", "plain text & more"),
    ("<article><h1>T</h1><p>One.<p>Two<br>three &lt;b&gt; &#233;&eacute;</article><footer>x</footer>", "T One. Two three <b> éé"),
    (f"<nav><a href=/>Home</a></nav><div id=main><h1>Head</h1><p>{LONG}</p><p>Short.</p></div><div class='side-bar sidebar'>Side</div>", f"Head {LONG} Short."),
    (f"<header>Site</header><main><p>{LONG}</p><form><label>Mail</label><input></form><p>End</p><section class=comments><article><p>{LONG} by a reader</p></article></section></main>", f"{LONG} End"),
    ("<article><p>a</p><div class='ad-box'>Buy</div><aside>More</aside><p>b <a href=x>link</a></p><div class='cookie-notice'>ok?</div></article>", "a b link"),
    ("<body class='has-sidebar'><article>x<script>var a='</p>';if(a<b){}</script><style>p{}</style><!-- c <p> -->y</article>", "x y"),
    ("<article><p>a\n\t b\u00a0c</p>  <ul><li>1<li>2</ul><table><tr><td>t</td></tr></table></article>", "a b c 1 2 t"),
    ("<article><p hidden>h</p><p style='display: none'>n</p><span class=ad>x <span>y</span></span>z</article>", "z"),
    ("<article><p title='a > b'>1 < 2</article>", "1 < 2"),
    ("<title>x</title><article><p>in</p></article><p>after</p>", "in"),
    ("<article>" + "<p>w</p>" * 3000 + "</article>", " ".join(["w"] * 3000)),
    ("<script>never closed", ""),
    ("<article><p>İstanbul</p><script>x</script><p>z</p></article>", "İstanbul z"),
]


@pytest.mark.parametrize("page, text", PAGES, ids=range(len(PAGES)))
def test_pages(page, text):
    assert main_text(page) == text


def test_query(spark, tmp_path):
    """Against the text of the only article of each page, cut out by a pattern."""
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op3_html(spark, SF).collect():
        inner = re.search("<article>(.*)</article>", html[r.page_id], re.S)[1]
        want = " ".join(" ".join(unescape(x).split()) for x in re.split("<[^>]*>", inner) if x.strip())
        assert (r.text, r.n_chars) == (want, len(want))
    rows = [(i, None if i % 2 else "u", p, "t") for i, (p, _) in enumerate(PAGES)] * 2
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op3_html(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted((i, PAGES[i][1]) for i, *_ in rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op3_html(spark, str(tmp_path)).count() == 0


#: Hand-labelled pages: html, the lines that are its text. No page relies on one article element alone.
PROSE = "This paragraph is long enough to be told from menus and notices by the number of its characters alone, as prose is."
LABELLED = [
    ("<body><div>Home</div><div>About</div><div>Contact</div><nav>x</nav><div class=ad>y</div><aside>z</aside><form>q</form><div><p>" + PROSE + "</p><p>Short end.</p></div></body>", [PROSE, "Short end."]),
    ("<body><div><p>" + PROSE + "</p></div><footer>f</footer><nav>n</nav><aside>a</aside><div>Imprint</div><div>Terms</div></body>", [PROSE]),
    ("<body><article><p class=social-history>A short one.</p><p class=skip-none>Another.</p></article><nav>n</nav><aside>a</aside><nav>m</nav><article><p>" + PROSE + "</p></article></body>", ["A short one.", "Another.", PROSE]),
    ("<body><ul><li><a href=/>Home page of the whole site</a></li><li><a href=/n>News of today and of yesterday</a></li></ul><p>" + PROSE + "</p><div><p>" + PROSE.lower() + "</p></div></body>", [PROSE, PROSE.lower()]),
    ("<body><main><h1>T</h1><p>a</p><div class=cookie-notice>" + PROSE + "</div><p>b</p></main></body>", ["T", "a", "b"]),
    ("<body><p>one</p><p>two</p></body>", ["one", "two"]),
]


def test_labelled_pages_need_the_window():
    """All labelled pages come out right; without the window step some don't."""
    right = lambda **more: sum(main_text(page, **more) == " ".join(want) for page, want in LABELLED)
    assert right() == len(LABELLED) and right(window=False) == len(LABELLED) - 2
