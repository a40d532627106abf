from rosterforge.llm import html_extract as H

PAGES = {
    1: ("<!DOCTYPE html><html><head><title>T</title><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href='/x'>menu</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy this now.</div>"
        "<article><h1>Title &amp; more</h1><p><b>Lead\n in.<br>next<p>Second <i>in</i>line.</p></article><footer>&copy; site</footer></body></html>", "Title & more\n\nLead in. next\n\nSecond inline."),
    2: ("<body><header><a>Home</a></header><div id=content><h2>Head</h2><div class='sidebar'><p>side</p></div><p>Long text about many different things here.</p><form><input>zz</form>"
        "<div class='comments'><p>A very long reader comment that goes on and on and on.</p></div></div><div role=contentinfo>legal</div></body>", "Head\n\nLong text about many different things here."),
    3: ("<main><article><p>one<p>two<ul><li>a<li>b</ul></article><article class='comment'><p>no</p></article></main>", "one\n\ntwo\n\na\n\nb"),
    4: (None, ""), 5: ("", ""), 6: ("<p>cut off &eacute;", "cut off é"), 7: ("<nav>only menu</nav>", ""), 8: ("</div></p>stray <b>text", "stray text"),
    9: ("<article>" + "<p>word word</p>" * 20_000 + "</article>", "\n\n".join(["word word"] * 20_000)),
}


def test_pages(spark):
    docs = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, (h, _) in PAGES.items()], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in H.extract_pages(docs).collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, (_, t) in PAGES.items()}
    assert all(r.n_chars == len(r.text) and r.url == f"u{i}" for i, r in got.items())
    assert H.extract_pages(docs.limit(0)).isEmpty()


def test_smoothing_and_threshold():
    assert H.two_means_threshold([1.0, 2.0, 9.0, 10.0]) == 5.5
    assert H.two_means_threshold([3.0, 3.0]) == 3.0
    flat = H.smooth([2.0] * 6)
    assert all(abs(x - 2.0) < 1e-12 for x in flat)


def test_siblings_and_wrappers_are_kept():
    a, b = "The first part tells of many things at some length. " * 4, "The second part is shorter. " * 3
    a, b = a.strip(), b.strip()
    both = f"{a}\n\n{b}"
    extract = H.extract
    assert extract(f"<body><nav>menu</nav><div class=content><section>{a}</section><section>{b}</section></div></body>") == both
    assert extract(f"<body><div>{a}</div><div>{b}</div><div class=ad>Buy</div></body>") == both
    assert extract(f"<body><article>{a}</article><article>{b}</article><footer>x</footer></body>") == both
    many = [f"Paragraph {i} of the text, which goes on for a while." for i in range(12)]
    assert extract("<body>" + "".join(f"<div>{x}</div>" for x in many) + "</body>") == "\n\n".join(many)
    for name in ("content has-sidebar", "container overflow-hidden"):
        page = f"<body><div class='{name}'>%s<div class='sidebar'>side links</div></div></body>"
        assert extract(page % f"<article>{a}</article>") == a
        assert extract(page % f"<div>{a}</div>") == a
    assert extract(f"<body><div>{a}</div><div class='comments'>{'A long comment. ' * 90}</div></body>") == a
    assert extract(f"<body><article>{a}</article><div class='related'><article>teaser</article></div></body>") == a
    assert extract(f"<html><head><style>p{{margin:0}}</style><script>{a}</script></head><body><div>{b}</div></body>") == b


def prose(k, n=40):
    return " ".join(f"word{(k * 31 + i * 7) % 97}" for i in range(n)) + "."


def unmarked_page():
    """No article, no main and no telling class: only the ratio of text to tags tells the content from the lists of links."""
    links = lambda n: "".join(f'<p><a href="/{i}"><b>go to</b> {i}</a></p>' for i in range(n))
    body = "<h2>Head</h2>" + "".join(f"<p>{prose(k)}</p>" for k in range(6)) + "<p>So.</p>"
    return f'<html><body><div id="x1"><div id="x2">{links(90)}</div><div id="x3">{body}</div><div id="x4">{links(60)}</div></div></body></html>'


def test_the_ratio_chooses_where_no_tag_tells(monkeypatch):
    want = "\n\n".join(["Head", *(prose(k) for k in range(6)), "So."])
    assert H.extract(unmarked_page()) == want
    monkeypatch.setattr(H, "smooth", lambda values: [1.0] * len(values))
    assert H.extract(unmarked_page()) != want


def test_the_ratio_chooses_among_table_cells():
    cell = "".join(f"{prose(k)}<br>" for k in range(4))
    page = f'<table><tr><td><a href="/a">a</a></td><td><a href="/b">b</a></td></tr><tr><td><p>{cell}</p><p>{prose(9)}</p></td><td><a href="/c">c</a></td></tr></table>'
    assert prose(9) in H.extract(page) and "b" not in H.extract(page).split("\n\n")


def test_repeated_rows_and_long_pages(spark):
    page = f"<article>{'<p>' + prose(3) + '</p>' * 1}</article>"
    long = "<article>" + "".join(f"<p>{prose(k)}</p>" for k in range(3000)) + "</article>"
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, long)], "page_id long, url string, html string")
    got = H.extract_pages(pages).collect()
    assert sorted(r.n_chars for r in got) == sorted([len(prose(3)), len(prose(3)), sum(len(prose(k)) for k in range(3000)) + 2 * 2999])
