"""Main text of pages: by element, by class, and by the template of a host."""

from deskloom.llm import extraction

from .conftest import prose


def main(html, boilerplate=(), slot=None):
    return extraction.choose(extraction.parse(html)[0], frozenset(boilerplate), slot)


def test_article_without_its_surroundings():
    html = """<!doctype html><head><title>T</title><style>p{}</style><script>var t="</p><p>";</script></head><body>
    <header>site</header><nav><ul><li><a href=x>Menu</a></ul></nav><!-- <p>no</p> --><div class="ad">buy</div>
    <article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>
      three&nbsp;four<br>five<p>Six<ul><li>a<li>b &lt;c&gt;</ul><form><input><button>Send</button></form>
      <div class="share-buttons social">tweet</div><table><tr><td>x<td>y</table>
      <section class="comments"><p>first!</p></section></article>
    <aside>side</aside><footer>&copy; me</footer>"""
    assert main(html).split("\n") == ["Head & line", "One two three four five", "Six", "a", "b <c>", "x", "y"]


def test_classes_are_words_not_letters():
    assert main('<article><p class="lead adapted">kept</p><p class="roadmap">too</p></article>') == "kept\ntoo"
    assert main('<article><p id="cookie-bar">x</p><p hidden>y</p><p role="navigation">z</p>k</article>') == "k"


def test_page_without_article_takes_its_largest_slot():
    html = f"<body><div id=a><a href=x>{prose(1, 40)}</a></div><div id=b><p>{prose(2, 20)}</p></div><div id=c>tiny</div>"
    assert main(html) == prose(2, 20)


def test_unclosed_and_broken_markup():
    assert main("<article><p>a<p>b</div></article><p>out") == "a\nb"
    assert main("<article><p>1 < 2 & 3 &bogus; <b>x</article>") == "1 < 2 & 3 &bogus; x"
    assert main("<article>x<script>never closed") == "x"
    assert main("<p>a</p><!-- open") == "a"
    assert main('<article><p title="a>b">t</p></article>') == "t"


def pages(spark, host, n, make, start=0):
    rows = [(start + i, f"https://{host}/p{i}", make(i)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, url string, html string")


def test_texts_of_the_template_go(spark):
    def make(i):
        return (
            f"<body><div class=top>Our fine site</div><div class=c{{}}><div class=body><p>Read this before all else</p>"
            f"<p>{prose(i, 30)}</p><p>{prose(1000 + i, 5 + i)}</p></div></div><div class=end>All about us {i}</div>"
        )

    found = extraction.extract(pages(spark, "a.example", 12, make)).collect()
    assert {row["id"]: row["text"] for row in found} == {i: f"{prose(i, 30)}\n{prose(1000 + i, 5 + i)}" for i in range(12)}


def test_pages_that_repeat_one_article_keep_it(spark):
    html = f"<body><nav>m</nav><article><p>{prose(1, 50)}</p></article></body>"
    found = extraction.extract(pages(spark, "b.example", 30, lambda i: html)).collect()
    assert {row["text"] for row in found} == {prose(1, 50)}


def test_few_pages_make_no_template(spark):
    html = f"<body><article><p>Hello</p><p>{prose(1, 50)}</p></article></body>"
    found = extraction.extract(pages(spark, "c.example", 3, lambda i: html)).collect()
    assert {row["text"] for row in found} == {f"Hello\n{prose(1, 50)}"}


def test_hosts_do_not_mix_and_large_tables_join(spark, monkeypatch):
    monkeypatch.setattr(extraction, "SMALL", -1)  # the way of templates too large to broadcast
    one = pages(spark, "d.example", 6, lambda i: f"<body><article><p>same</p><p>{prose(i, 9)}</p></article>")
    two = pages(spark, "e.example", 6, lambda i: f"<body><article><p>same {i}</p><p>{prose(i, 9)}</p></article>", 100)
    by = {row["id"]: row["text"] for row in extraction.extract(one.union(two)).collect()}
    assert by[0] == prose(0, 9) and by[100] == f"same 0\n{prose(0, 9)}"
