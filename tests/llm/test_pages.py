"""Site templates inside articles, and names that remove nothing."""

import random
from collections import defaultdict

import pytest

from corpusflow.llm import pages

PAGE = "<html><body><nav>Home</nav><article>{}</article><footer>(c)</footer></body></html>"


@pytest.mark.parametrize(
    "body, want",
    [
        ('<p>Run it:</p><pre><code><span class="token comment"># install first</span>\nmake</code></pre>', "Run it:\n# install first make"),
        ('<p>One.</p><section class="related-work"><h2>Related work</h2><p>Two.</p></section>', "One.\nRelated work\nTwo."),
        ('<p>One.</p><p class="share-price">It rose.</p>', "One.\nIt rose."),
        ('<p>One.</p><aside class="pull-quote">Two.</aside><aside>Menu</aside>', "One.\nTwo."),
        ('<p>A <a class="share" href="#">link</a> and <em class="promo">more</em>.</p>', "A link and more."),
        ('<p>One.</p><div class="ad">Buy</div><div class="comments"><p>First!</p></div>', "One."),
        ('<p>One.</p><div class="x" hidden>No</div><form>Name</form>', "One."),
        ('<pre><div class="menu">kept as code</div></pre>', "kept as code"),
    ],
)
def test_names_inside_an_article(body, want):
    assert pages.main_text(pages.parse(PAGE.format(body)), set()) == want


def site(seed, n=40):
    """Pages of two hosts: own paragraphs, and boxes without a telling name that stand on many pages of one host."""
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta omega sigma".split()) + str(rng.randrange(400))
    boxes = ["Sign up for our weekly letter", "Listen to our show", "Rare box"]
    rows, texts = [], []
    for i in range(n):
        host = "big.example" if i % 4 else "small.example"
        own = [" ".join(word() for _ in range(rng.randrange(12, 30))) for _ in range(3)]
        shown = [0] * (host == "big.example") + [1] * (rng.random() < 0.6) + [2] * (i in (1, 2, 3))
        parts = [f"<p>{p}</p>" for p in own] + ["<h2>Introduction</h2>"] + [f'<div class="x7"><b>{boxes[b]}</b></div>' for b in shown]
        order = list(range(len(parts)))
        rng.shuffle(order)
        rows.append((i, f"https://{host}/{i}", PAGE.format("".join(parts[j] for j in order))))
        texts.append((host, [(own + ["Introduction"] + [boxes[b] for b in shown])[j] for j in order]))
    return rows, texts


@pytest.mark.parametrize("seed", [1, 2])
def test_sites_equal_a_count_of_lines(spark, seed):
    """A box goes if its text stands on five pages of the host; paragraphs and headings stay."""
    rows, texts = site(seed)
    frame = spark.createDataFrame([(*r, "h", "t", 1) for r in rows], "page_id long, url string, html string, host string, text string, n_chars int")
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extracted(frame).collect()}
    on = defaultdict(set)
    for i, (host, lines) in enumerate(texts):
        for line in lines:
            on[host, line].add(i)
    for i, (host, lines) in enumerate(texts):
        want = "\n".join(x for x in lines if x == "Introduction" or len(on[host, x]) < pages.MIN_PAGES)
        assert got[i] == (want, len(want))
    whole = {i: pages.main_text(pages.parse(html), set()) for i, _, html in rows}
    assert sum(whole[i] != got[i][0] for i in whole) > len(rows) / 2


def test_an_article_on_many_pages_stays(spark):
    """The same article in boxes, beside other sidebars: half of the text or more is no template."""
    body = "<div><p>One long story.</p></div><section><p>Its second part.</p></section>"
    rows = [(i, "http://a.example/", f"<aside>{i}</aside><p>see {i}</p><article>{body}</article>") for i in range(9)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in pages.extracted(frame).collect()} == {"One long story.\nIts second part."}
