import itertools
import random

from fathomgrid.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class="article"><header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu entry</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, a long enough sentence to look like content, is it not so.</p></div>
<div class="ad">Buy now.</div>
<article><h1>Title</h1><p><b>First &lt;part&gt; of<br>a&nbsp;paragraph.<p>Short.</p><ul><li>One</li><li>Two</li></ul>
<table><tr><td>cell</td></tr></table><form><input name=q><label>Search</label></form><aside>Related stories</aside>
<blockquote>Quoted words &copy; 1999</blockquote><p>a < b &amp c</p><section id="comments"><h2>Comments</h2><p>Nice article, I read it twice.</p></section>
</article><footer>&copy; site</footer></body></html>"""


def test_page():
    assert ht.extract(PAGE).split("\n\n") == [
        "Title", "First <part> of a paragraph.", "Short.", "One", "Two", "cell", "Quoted words © 1999", "a < b & c"]


def test_broken_pages():
    assert ht.extract("") == ""
    assert ht.extract("<article><p>cut off in the mid") == "cut off in the mid"
    assert ht.extract("<article><p>one</p><p>two &am") == "one\n\ntwo &am"
    assert ht.extract("<article><p>one</p><p cla") == "one"
    assert ht.extract("<article><p>a</b></i></p></div>b</article>") == "a\n\nb"
    assert ht.extract("<article><!-- <p>x</p> --><p title='a > b'>y</p><script>never closed <p>z") == "y"


SENTENCE = "A sentence that is long enough to be read as a part of the article."


def test_elements_that_only_look_like_dropped_ones():
    around = lambda x: ht.extract(f"<article><p>{SENTENCE}</p>{x}<p>{SENTENCE}</p></article>").split("\n\n")
    two = [SENTENCE, SENTENCE]
    for x in ['<svg width="1"/>', "<math/>", "<svg-icon></svg-icon>", "<title-bar></title-bar>", "<svg><text>no</text></svg>",
              "<svg><svg>no</svg>no</svg>", "<canvas>", "<video src=a>", "<iframe>no</iframe>", "<object><p>no</p></object>", "</svg>",
              "<SVG viewBox='0 > 1'><title>no</title></SVG>", "<script>'<svg>'</script>", "<span data-x=/a/></span>"]:
        assert around(x) == two, x
    assert around("<p>Mass <math><mi>m</mi><mo>+</mo><mn>1</mn><annotation>tex</annotation></math> here.</p>")[1] == "Mass m+1 here."
    assert around(f'<p data-id="share" title="class=ad">{SENTENCE}</p>') == [*two, SENTENCE]
    assert around(f'<p class="share">{SENTENCE}</p>') == two
    assert around(f"<a href=/x/>{SENTENCE}</a>")[1] == SENTENCE


def test_deep_and_unclosed_pages():
    deep = "<div>" * 3000 + f"<article><p>{SENTENCE}</p></article>" + "</div>" * 3000
    assert ht.extract(deep) == SENTENCE
    assert ht.extract("<article>" + "<svg>" * 5000 + f"<p>{SENTENCE}</p>") == SENTENCE


def test_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 9)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randint(0, 12))]

        def cost(labels):
            return -sum(s for s, keep in zip(scores, labels) if keep) + sum(w for a, b, w in edges if labels[a] != labels[b])

        least = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(ht.minimum_cut(scores, edges)) - least) < 1e-9


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", PAGE, "x")]
    got = ht.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got)[:2] == [0, 0]
    assert all(r.n_chars == len(r.text) for r in got)
    assert ht.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
