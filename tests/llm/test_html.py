import itertools

import numpy as np
import pytest

from turnledger.llm import html_crf
from turnledger.llm.html_blocks import blocks
from turnledger.llm.labelled_pages import labelled_pages

SCHEMA = "page_id long, url string, html string, text string"


@pytest.fixture(scope="module")
def model():
    return html_crf.train()


def test_blocks_of_broken_markup():
    page = (
        "<html><head><title>no</title><style>x</style></head><body><script>if (a<b) '<p>'</script><p>One &amp; <b>two<br>three\n four</b>"
        '<p class="a > b">Five<!-- no --><ul><li>six<li><a href=x>seven</a> eight</ul>tail &lt;&nbsp;end<p>cut <a href="x'
    )
    found = blocks(page)
    assert [b.text for b in found] == ["One & two three four", "Five", "six", "seven eight", "tail < end", "cut"]
    assert [b.path[-1].split(".")[0] for b in found] == ["p", "p", "li", "li", "body", "p"] and found[3].linked == 5
    for text in ("", "   ", "plain", "<", "<p", "</p></p>", "<!--", "<script>", "a < b > c", "<p title='x>y", "&#x41;&bogus;"):
        blocks(text)
    assert [b.text for b in blocks("plain &#x41;")] == ["plain A"]


@pytest.mark.parametrize(
    "inner",
    ['<video-player src="x"></video-player>', "<title-card>one</title-card>", "<script-loader></script-loader>", '<svg class="i"/>', '<svg class="i" />',
     "<object data=x>", "<video src=x>", "<noscript>", "<video><p>no</p><source></video>", "<object>no <object>no</object> no</object>",
     "<svg><title>no</title><path/></svg>", "<noscript><iframe>no</noscript>", "</audio>"],
)
def test_hidden_elements_end_where_they_end(inner):
    """Custom elements are no hidden ones, and a hidden one without an end tag hides nothing."""
    found = [b.text for b in blocks(f"<article><p>one</p>{inner}<p>two</p><p>three</p></article>")]
    assert found == ["one", *["one"] * inner.startswith("<title-card"), "two", "three"]


def test_training_recovers_other_labelled_pages(model):
    right = total = 0
    for page in labelled_pages(120, seed=77):
        found = blocks(page)
        if found:
            right += sum(b.main == k for b, k in zip(found, html_crf.decode(found, model, {}), strict=True))
            total += len(found)
    assert right >= 0.98 * total


def test_viterbi_is_the_best_of_all_labellings(model):
    for page in labelled_pages(25, seed=5):
        found = blocks(page)[:9]
        own = [sum(model.weight.get(n, 0.0) for n in html_crf.path_features(*at) + html_crf.text_features(b)) for b, at in zip(found, html_crf.page_paths(found), strict=True)]

        def value(labels, own=own):
            chain = sum(model.move[a][b] for a, b in itertools.pairwise(labels))
            return sum(s for s, k in zip(own, labels, strict=True) if k) + chain + (model.start if labels[0] else 0)

        if found:
            best = max(value(labels) for labels in itertools.product((0, 1), repeat=len(found)))
            assert value([int(k) for k in html_crf.decode(found, model, {})]) == pytest.approx(best)


def test_gradient_climbs(model):
    """More rounds raise the probability of the labels of the training pages."""
    pages = labelled_pages(40)
    few, many = html_crf.train(pages, rounds=3), html_crf.train(pages, rounds=120)
    wrong = [sum(b.main != k for p in pages if (f := blocks(p)) for b, k in zip(f, html_crf.decode(f, m, {}), strict=True)) for m in (few, many)]
    assert wrong[1] < wrong[0]


def test_article_without_what_stands_around_it(spark, model):
    body = "The old bridge was closed in winter. It opened again in spring, to the joy of the village."
    page = f"""<html><body><header><h1>Daily</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
    <article><h1>The bridge</h1><p>{body}</p><div class="ad"><p>Buy two, get one.</p></div><p>A &lt;second&gt;
    paragraph,   with space.</p><form><label>Mail</label><button>Send</button></form><section class="comments"><h3>Comments</h3><div class="comment"><p>Nice article!</p></div></section></article>
    <aside><p>Most read this week</p></aside><footer>&copy; Daily</footer></body></html>"""
    rows = [(1, "u", page, "old"), (2, "u", None, "old"), (3, None, "", None), (None, "u", "<nav>a</nav>", None), (1, "u", page, "old")]
    out = html_crf.with_main_text(spark.createDataFrame(rows, SCHEMA), model).collect()
    want = f"The bridge\n\n{body}\n\nA <second> paragraph, with space."
    assert [r["text"] for r in out] == [want, "", "", "", want] and [r["n_chars"] for r in out] == [len(want), 0, 0, 0, len(want)]
    assert html_crf.with_main_text(spark.createDataFrame([], SCHEMA), model).isEmpty()


_PLAIN = "The old bridge was closed in winter. It opened again in spring, to the joy of the village."
_BAKING = (
    "Bake them for ten minutes, then subscribe to patience: privacy in the kitchen matters when cookies cool on the tray and nobody steals "
    "one before dinner is served to all the guests."
)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div><h1>The bridge</h1><p>{_PLAIN}</p><p>{_PLAIN}</p></div>", ["The bridge", _PLAIN, _PLAIN]),
        (f"<body>{_PLAIN}<br><br>{_PLAIN}</body>", [f"{_PLAIN} {_PLAIN}"]),
        (_PLAIN, [_PLAIN]),
        (f"<body><nav><a href=a>Home</a></nav><h1>The bridge</h1><p>{_PLAIN}</p><p>{_BAKING}</p><footer>&copy; Daily</footer>", ["The bridge", _PLAIN, _BAKING]),
        (f"<article><p>{_PLAIN}</p><aside>Most read this week</aside><p>{_PLAIN}</p></article>", [_PLAIN, _PLAIN]),
        (f"<article><p>{_PLAIN}</p><aside><p>{_PLAIN}</p></aside><p>{_PLAIN}</p></article>", [_PLAIN, _PLAIN]),
        (f"<article><p>{_PLAIN}</p><div class='disclaimer'>This is no advice.</div><p>{_PLAIN}</p></article>", [_PLAIN, _PLAIN]),
        (
            f"<article><header><h1>The bridge</h1><p class='byline'>By A Writer</p></header><p>{_PLAIN}</p><footer>Posted by A</footer></article>",
            ["The bridge", _PLAIN],
        ),
        *[(f"<article><p>{_PLAIN}</p><p {how}>{_PLAIN} no</p><p>{_PLAIN}</p></article>", [_PLAIN, _PLAIN]) for how in ("style='display:none'", "hidden")],
        (f"<article><p>{_PLAIN}</p></article><div class='talkback'><p>Nice one!</p><p>{_PLAIN}</p></div>", [_PLAIN]),
        (f"<article><p>{_PLAIN}</p><p>{_BAKING}</p></article>", [_PLAIN, _BAKING]),
        (f"<body><div>Accept all cookies</div><article><p>{_PLAIN}</p></article></body>", [_PLAIN]),
    ],
)
def test_plain_pages_and_what_stands_inside_an_article(model, page, want):
    assert html_crf.main_text(page, model, {}) == "\n\n".join(want)


def test_hidden_is_an_attribute_and_no_part_of_a_value():
    found = blocks("<p class='hidden-gem'>a</p><p title=' hidden '>b</p><p hidden>c</p><p style='color:red; display : none'>d</p><p aria-hidden='false'>e</p>")
    assert ["!unseen" in b.path[-1] for b in found] == [False, False, True, True, False]


def test_given_pages_give_their_articles(spark, model):
    """The pages' articles, read off by their tags, which the model is not told of."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in html_crf.with_main_text(pages, model).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)</article>", page["html"], re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert got[page["page_id"]]["text"] == "\n\n".join(p for p in parts if p)


def test_forward_backward_agrees_with_counting():
    """Weights of a tiny chain: the trained model's label odds follow the labelled frequencies."""
    pages = ["<div><p data-main>alpha beta gamma.</p><div class=x>alpha beta gamma.</div></div>"] * 6 + ["<div><p>alpha beta gamma.</p></div>"] * 2
    model = html_crf.train(pages, rounds=300, ridge=1e-4)
    labels = html_crf.decode(blocks(pages[0]), model, {})
    assert labels == [True, False] and np.isfinite(list(model.weight.values())).all()
