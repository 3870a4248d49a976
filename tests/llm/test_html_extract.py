import random
import re

from quillstream.llm import html_extract as h


def texts(source):
    return h.extract_pages([source], h.default_model())[0]


def test_held_out_labelled_pages():
    rng, model, wrong, total = random.Random(77), h.default_model(), 0, 0
    for _ in range(150):
        page = h.parse(h._labelled(rng))
        p, _ = h.Forest([page], model.place).marginals(model.weights, model.pairs)
        for k, t in enumerate(page.text):
            if t is not None:
                total += 1
                wrong += (p[k, h.MAIN] > 0.5) != (page.label[k] == h.MAIN)
    assert wrong / total < 0.02


def test_marginals_match_enumeration():
    import itertools

    import numpy as np

    page = h.parse("<div><p>a b</p><p class=x>c</p></div>")
    rng = np.random.default_rng(0)
    f = h.Forest([page], {"text": 0, "tag p": 1, "name x": 2})
    w, t = rng.normal(size=(3, 2)), rng.normal(size=(h.PART + 1, 3, 3))
    p, joint = f.marginals(w, t)
    n, total, want = len(f.parent), 0.0, np.zeros((len(f.parent), 3))
    for y in itertools.product(range(3), repeat=n):
        s = sum(w[c, y[r] - 1] for r, c in zip(f.row, f.col) if y[r]) + sum(t[f.kind[i], y[f.parent[i]], y[i]] for i in range(1, n))
        total += np.exp(s)
        for i in range(n):
            want[i, y[i]] += np.exp(s)
    assert np.allclose(p, want / total) and np.allclose(joint[1:].sum((1, 2)), 1)


def test_markup():
    assert texts("<article><h1>T &amp; u</h1><p>one <b>t</b>wo<br>three&nbsp;&#233;<p>four<script>x<y</script></article>") == "T & u\n\none two three é\n\nfour"
    page = "<body><nav><ul><li><a href=/>Home</a></ul></nav><article><p>Text of the article, long enough.</p><div class='ad'><p>Buy now.</p></div><section id=comments><p>I like this a lot.</p></section></article><footer>c</footer>"
    assert texts(page) == "Text of the article, long enough."
    for s in ("", "<", "<!-- x", "<a href='x>y", "<script>", "</p></div>", "<" * 500, "<div>" * 3000):
        texts(s)


def test_query(spark, sf):
    got = {r.page_id: r for r in h.op2_html_extract(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:  # these pages have one article of paragraphs
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(h.entities.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_defined_cases(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<main><p>Hello there.</p></main>", "x"), (3, "u", "<main><p>Hello there.</p></main>", "x")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in h.extract(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "Hello there.", 12), (3, "Hello there.", 12)]
    assert h.extract(spark.createDataFrame([], schema)).count() == 0


def test_pages_with_label_attributes_of_their_own():
    page = "<main><p{}>Text of the page, long enough.</p></main>"
    for value in ("", ' data-y="50%"', ' data-y="0.5"', " data-y=''", ' data-y="1"', ' data-y="7"'):
        assert texts(page.format(value)) == "Text of the page, long enough."


ONE = "The council agreed on Tuesday to rebuild the old bridge over the river, after months of talks about its cost and its place in the town."
TWO = "Work will begin in the spring, and the road will stay open for most of the year, said the mayor. Residents had asked for that."
ARTICLE, WANT = f"<p>{ONE}</p><p>{TWO}</p>", f"{ONE}\n\n{TWO}"
MENU = "<a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a>"
#: Pages that no template of the training has: hand-written, with few or no names.
OTHERS = {
    "loose": f"<html><body>{ARTICLE}</body></html>",
    "generated class": f'<body><div class="css-1x2y3z">{ARTICLE}</div></body>',
    "generated id": f'<body><div id="u42">{ARTICLE}</div></body>',
    "table": f"<body><table><tr><td>{MENU}</td><td>{ARTICLE}</td></tr><tr><td colspan=2>&copy; 2020 The Town Herald</td></tr></table></body>",
    "no names": f"<body><div>{MENU}</div><div>{ARTICLE}</div><div>&copy; 2020 Town</div></body>",
    "list menu": f"<body><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul>{ARTICLE}<footer>Imprint</footer></body>",
    "comments": f"<body><article>{ARTICLE}</article><section id=comments><h3>Comments</h3><p>I like this a lot.</p></section></body>",
    "sidebar": f'<body><div id="page"><aside><h3>Most read</h3><ul><li><a href=/1>Rain again</a></li><li><a href=/2>New shop</a></li></ul></aside><main>{ARTICLE}</main></div></body>',
    "notice": f'<body><div class="cookie-banner"><p>We use cookies. <a href=/p>Read more</a></p></div><article>{ARTICLE}</article><form><label>Mail</label><input><button>Go</button></form></body>',
}


def test_pages_of_other_templates():
    got = {k: texts(page) for k, page in OTHERS.items()}
    assert got == dict.fromkeys(OTHERS, WANT)
    title = texts(f"<body><div class=x7><h1>A new bridge</h1>{ARTICLE}<ul><li>First, the piers are built.</li><li>Then the deck is laid.</li></ul></div></body>")
    assert title == f"A new bridge\n\n{WANT}\n\nFirst, the piers are built.\n\nThen the deck is laid."


def test_parsing_is_linear():
    import time

    for piece in ("<a ", "<b>", "<b></i>", "<div>", "<p><b>", "<li><b>", "<td>", "<!--", '<a "', "< ", "<b><p>x"):
        start = time.process_time()
        h.parse(piece * 4000)
        small = time.process_time() - start
        start = time.process_time()
        h.parse(piece * 32_000)
        assert time.process_time() - start < 24 * max(small, 0.05), piece


def test_long_pages(spark):
    long = "<article>" + "".join(f"<p>{ONE} {i}</p>" for i in range(8000)) + "</article>"
    got = h.extract(spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string")).first()
    assert got.text.count("\n\n") == 7999 and got.n_chars == len(got.text)
