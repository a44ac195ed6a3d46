import random

from pyspark.sql import functions as F

from sparrel.llm import html, urls

PAGES = "page_id long, url string, html string"


def _text(page):
    return html.main_lines(html.lines_of(page), None)


def test_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Menu</a></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use</div>
    <article><h1>Head &amp; more</h1><p>One
      two<br>three&nbsp;four<p><b>Five</b> six</p><aside>Side</aside><form><input>Mail<button>Go</button></form>
      <table><tr><td>a<td>b</table><!-- <p>no</p> --><div class="comments"><p>Reader</p></div><noscript>No</noscript></article>
    <section class="comment-list"><article class="comment"><p>First!</p></article></section><footer>&copy;</footer></body>"""
    assert _text(page) == ["Head & more", "One two three four", "Five six", "a", "b"]


def test_broken_markup():
    assert _text(None) == [] and _text("") == [] and _text("plain") == ["plain"]
    assert _text("<p>a < b</p>") == ["a < b"]
    assert _text("<nav><a>x</a><p>never closed") == ["x", "never closed"]
    assert _text("<article><p>a") == ["a"] and _text("<!-- open") == []
    assert _text("<script>open") == [] and _text("</p></div>a") == ["a"]
    assert _text("<p>" * 5000 + "x") == ["x"] and _text("<div>" * 3000 + "y") == ["y"]
    assert _text('<p title="a>b">c</p>') == ["c"]


def test_letters_that_grow_when_lowered():
    for n in (1, 12, 40, 500):
        page = f"<TITLE>{'İ' * n}</TITLE><p>{'İ' * n}</p><SCRIPT>var a;</SCRIPT><article><p>İlk</p></article><STYLE>p{{}}</STYLE><p>son</p><NAV>Menü</NAV>"
        assert html.lines_of(page) == [("İ" * n, False, False), ("İlk", True, False), ("son", False, False), ("Menü", False, True)]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        got = sorted(html.shared_lines(a, b))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        rest = iter(b)
        assert len(got) == best[-1][-1] and all(any(a[i] == y for y in rest) for i in got)


def test_differencing(spark):
    bare = "<body><div>Top line</div><p>{}</p><p>{}</p><div>All rights reserved</div></body>"
    own = "<body><article><p>Shared passage</p><p>{}</p></article></body>"
    rows = [
        (1, "http://h.org/a/1", bare.format("story one is here", "and goes on for long")),
        (2, "http://H.org/a/2?x", bare.format("another tale told", "with an end of its own")),
        (3, "http://h.org/b", bare.format("third one", "different")),
        (4, "http://copy.org/a", bare.format("same", "page")),
        (5, "http://copy.org/b", bare.format("same", "page")),
        (6, "http://own.org/a", own.format("mine")),
        (7, "http://own.org/b", own.format("yours")),
        (8, None, None),
        (9, "no host", "<p>x</p>"),
        (9, "no host", "<p>x</p>"),
    ]
    got = [(r.page_id, r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()]
    texts = dict((i, t) for i, t, _ in got)
    assert texts[1] == "story one is here\n\nand goes on for long" and texts[2] == "another tale told\n\nwith an end of its own"
    assert texts[3] == "third one\n\ndifferent"
    assert texts[4] == texts[5] == "Top line\n\nsame\n\npage\n\nAll rights reserved"
    assert texts[6] == "Shared passage\n\nmine" and texts[7] == "Shared passage\n\nyours"
    assert texts[8] == "" and [t for i, t, _ in got if i == 9] == ["x", "x"]
    assert all(n == len(t) for _, t, n in got)


def test_alignment_decides_outside_an_article(spark):
    body = '<body><div>Top line of the site</div><div class="story"><p>{}</p></div><article class="teaser"><p>{}</p></article><div>All rights reserved</div></body>'
    rows = [(1, "http://t.org/a", body.format("a story told at some length", "read this too")), (2, "http://t.org/b", body.format("another one, no shorter than it", "and that"))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "a story told at some length\n\nread this too", 2: "another one, no shorter than it\n\nand that"}


def test_large_frames_are_no_copies(spark):
    notice = "All rights reserved. No part of this site may be copied without the leave of its owners. " * 5
    frame = f"<body><div>Home Politics Sports Weather</div>{{}}<div>{notice}</div></body>"
    story = "<p>" + "A long tale that is told in full under two addresses. " * 40 + "</p>"
    rows = [
        (1, "http://two.org/a", frame.format("<p>A bridge was closed today</p>")),
        (2, "http://two.org/b", frame.format("<p>Rain is expected until Monday</p>")),
        (3, "http://few.org/a", frame.format("<p>Quite another subject here</p>")),
        (4, "http://few.org/b", frame.format(story + "<div>Buy these splendid shoes now</div>")),
        (5, "http://few.org/bb", frame.format(story + "<div>Fly south for little money</div>")),
        (6, "http://few.org/c", frame.format("<p>Something else entirely again</p>")),
        (7, "http://date.org/a", frame.format(story + "<div>Updated on 3 May 2024</div>")),
        (8, "http://date.org/b", frame.format(story + "<div>Updated on 14 May 2024</div>")),
    ]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    tale = " ".join(story[3:-4].split())
    assert got[1] == "A bridge was closed today" and got[2] == "Rain is expected until Monday"
    assert got[3] == "Quite another subject here" and got[6] == "Something else entirely again"
    assert got[4] == tale + "\n\nBuy these splendid shoes now" and got[5] == tale + "\n\nFly south for little money"
    assert tale in got[7] and tale in got[8]


def test_extract_keeps_rows_and_columns(spark):
    rows = [(i % 50, f"http://hot.org/{i % 7}", f"<p>page {i}</p>", f"k{i}", i) for i in range(500)]
    pages = spark.createDataFrame(rows, PAGES + ", `text` string, _x int")
    got = html.extract(pages)
    assert got.columns == ["page_id", "url", "_x", "text", "n_chars"]
    assert {r._x: r.text for r in got.collect()} == {i: f"page {i}" for i in range(500)}
    assert html.extract(pages.limit(0)).count() == 0


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Net/x": ("a.net", "/x", "net/", "block"),
        "http://a.net": ("a.net", "", None, None),
        "https://www.EXAMPLE.net/en/5?q": ("www.example.net", "/en/5", "example.net/en/", "allow"),
        "http://example.net/en": ("example.net", "/en", "net/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, None),
        "http://x.example.com/de/#t": ("x.example.com", "/de/", "example.com/de/", "block"),
        "ftp://u.org/fr/": ("u.org", "/fr/", "org/fr/", "allow"),
        "http://É.org?/fr/": ("É.org", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "mailto:x": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "http://q.org/a\nb": ("q.org", "/a\nb", None, None),
        "http://" + "x" * 50_000 + ".org/p": ("x" * 50_000 + ".org", "/p", None, None),
    }
    model = urls.train(urls.labelled(spark))
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(cases)], "page_id int, url string, rule string")
    rows = urls.judge(df, model=model).orderBy("page_id").collect()
    for (host, path, rule, verdict), r in zip(cases.values(), rows, strict=True):
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1


def test_regression_separates_its_table_and_unseen_names(spark):
    model = urls.train(urls.labelled(spark))
    rows = urls.judge(urls.labelled(spark), rules=(), model=model).collect()
    assert all((r.verdict == "block") == (r.label == 1) for r in rows)
    unseen = [("http://m.mega-casino.example.com/en/3", 1), ("http://cheap-pills-now.example.org/fr/1", 1), ("http://www.thanor.example.com/en/77", 0), ("http://blog.rivers.example.org/es/9", 0)]
    got = urls.judge(spark.createDataFrame(unseen, "url string, y int"), rules=(), model=model).collect()
    assert all((r.verdict == "block") == bool(r.y) for r in got)


def test_scores_against_brute_force_and_no_python(spark):
    model = urls.train(urls.labelled(spark))
    df = urls.labelled(spark).limit(5)
    judged = urls.judge(df, rules=(), model=model)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    for r, g in zip(judged.collect(), df.select(urls.grams(F.col("url")).alias("g")).collect(), strict=True):
        margin = model[1] + sum(model[0][b] for b in g.g)
        assert abs(r.score - 1 / (1 + 2.718281828459045**-margin)) < 1e-9


def test_no_labels_block_nothing(spark):
    weights, constant = urls.train(spark.createDataFrame([("http://a.org/", None)], "url string, label double"))
    assert not any(weights) and constant < 0


def test_pairs_do_not_depend_on_ranges(spark):
    rng = random.Random(5)
    body = "<div>{}</div><p>{}</p><p>{}</p><div>{}</div>"
    rows = []
    for i in range(120):
        url = rng.choice([None, f"http://hot.org/{rng.randrange(40)}/{rng.randrange(3)}", f"https://h{rng.randrange(12)}.org/x"])
        rows.append((rng.choice([i, i, None]), url, body.format(*(rng.choice(["top", "side", "a tale", f"own {i}", "end"]) for _ in range(4)))))
    rows += rows[:9]
    keyed = [(r.h, r.p, r.page_id is not None, r.page_id or 0, r.x, r.html) for r in spark.createDataFrame(rows, PAGES).select("*", html.host_of(F.col("url")).alias("h"), html.path_of(F.col("url")).alias("p"), F.xxhash64("html").alias("x")).collect()]
    keyed.sort()
    lines = [html.lines_of(k[5]) for k in keyed]

    def common(a, b):
        return next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    want = []
    for i, k in enumerate(keyed):
        prev, after = ([j] if 0 <= j < len(keyed) and keyed[j][0] == k[0] else [] for j in (i - 1, i + 1))
        pair = max(prev + after, key=lambda j: common(keyed[j][1], k[1]), default=None)
        want.append(("" if not k[2] else str(k[3]), "\n\n".join(html.main_lines(lines[i], None if pair is None else lines[pair]))))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 50, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = html.extract(spark.createDataFrame(rows, PAGES)).collect()
            assert sorted(("" if r.page_id is None else str(r.page_id), r.text) for r in got) == sorted(want), n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hostile_pages_take_linear_time():
    import time

    for unit in ("<a '", '<a "b>', "<nav>", '<a b="', '<a ">" ', "<a<a", "<x class=ad>", "<p><b>", "<b></i>", "<div></p>", '<a b=">" ', "<script/>", "&lt;<"):
        took = []
        for size in (25_000, 200_000):
            started = time.perf_counter()
            html.lines_of(unit * (size // len(unit)) + "<p>end")
            took.append(time.perf_counter() - started)
        assert took[1] < 32 * max(took[0], 0.005), unit  # eight times the text, not 64 times the time
    for page in ("<b>" * 40_000 + "</i>" * 40_000, "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000, "<b>" * 40_000 + "<p></p>" * 40_000, "<p " + "a" * 200_000 + ">x"):
        started = time.perf_counter()
        html.lines_of(page)
        assert time.perf_counter() - started < 5


def test_values_that_never_end():
    assert _text('<p class="x>one</p><p>two</p>') == ["one", "two"]
    assert _text("<p title='a>b' id=c>it's</p><p>don't</p>") == ["it's", "don't"]
    assert _text('<a href="x>y">in</a> <a href="z>out</a>') == ["in out"]


def test_links_in_an_article_go_if_the_neighbour_has_them(spark):
    body = '<body><article><div><a href="/1">News</a> <a href="/2">Sport</a></div><p>{}</p><p>Shared words of an article</p></article><p>{}</p><div>All rights reserved</div></body>'
    rows = [(1, "http://t.org/a", body.format("one tale of some length", "an afterword of its own")), (2, "http://t.org/b", body.format("another, no shorter", "some other last words")), (3, "http://u.org/", body.format("alone", "as it is"))]
    got = {r.page_id: r.text.split("\n\n") for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1] == ["one tale of some length", "Shared words of an article", "an afterword of its own"]
    assert got[2] == ["another, no shorter", "Shared words of an article", "some other last words"]
    assert got[3] == ["News Sport", "alone", "Shared words of an article", "as it is", "All rights reserved"]


def test_long_alignments_against_a_table():
    rng = random.Random(8)
    for n, m in ((300, 280), (257, 400), (1, 300), (300, 1)):
        a, b = ([rng.choice("abcdefgh") for _ in range(k)] for k in (n, m))
        row = [0] * (m + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        got = sorted(html.shared_lines(a, b))
        rest = iter(b)
        assert len(got) == row[-1] and all(any(a[i] == y for y in rest) for i in got)


def _independent(page, article):
    """Text blocks by the standard library's parser, for pages whose frame is marked by elements."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.off, self.inside, self.blocks, self.now = 0, 0, [], ""

        def flush(self):
            if (not article or self.inside) and not self.off and (t := " ".join(self.now.split())):
                self.blocks.append(t)
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag not in ("b", "i", "a", "br"):
                self.flush()
            self.now += "\n" * (tag == "br")
            self.off += tag in ("nav", "footer", "aside", "form", "script", "style")
            self.inside += tag == "article"

        def handle_endtag(self, tag):
            if tag not in ("b", "i", "a"):
                self.flush()
            self.off -= tag in ("nav", "footer", "aside", "form", "script", "style")
            self.inside -= tag == "article"

        def handle_data(self, data):
            self.now += data

    reader = Reader()
    reader.feed(page)
    reader.close()
    return reader.blocks


def test_extraction_against_an_independent_parser(spark):
    rng = random.Random(12)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa &amp; &lt;x&gt; caf&eacute; &#8212; İst ß".split()

    def prose():
        return " ".join(rng.choice(words) + rng.choice(["", "", "", " <b>bold</b>", "<br>", " <a href='/x?a=1&amp;b=2'>link</a>", "\n  "]) for _ in range(rng.randrange(3, 30)))

    def page(article):
        frame = "".join(f"<{t}>{prose()}</{t}>" for t in rng.choices(["nav", "aside", "form"], k=rng.randrange(4)))
        body = "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "<ul><li>{}</li></ul>", "<h2>{}</h2>"]).format(prose()) for _ in range(rng.randrange(6)))
        side = f"<aside><p>{prose()}</p></aside>" * rng.randrange(2)
        inner = f"<article>{body}{side}</article>" if article else f"<div>{body}{side}</div>"
        return f"<html><body><style>p{{}}</style>{frame}{inner}<script>if (a<b) {{}}</script><footer>{prose()}</footer></body></html>"

    made = [(i, f"http://h{i}.org/", page(i % 2)) for i in range(300)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(made, PAGES)).collect()}
    for i, _, text in made:
        assert got[i] == "\n\n".join(_independent(text, i % 2)), text


def test_regression_is_the_optimum_and_fits_once(spark):
    import numpy as np

    table = urls.labelled(spark)
    weights, constant = urls.train(table, penalty=0.05)
    rows = table.select("label", urls.grams(F.col("url")).alias("g")).collect()
    x, y = np.zeros((len(rows), urls.BUCKETS)), np.array([r.label for r in rows])
    for i, r in enumerate(rows):
        np.add.at(x[i], r.g, 1)
    p = 1 / (1 + np.exp(-(x @ weights + constant)))
    # at the least loss the gradient is zero
    assert np.abs(x.T @ (p - y) / len(y) + 0.05 * np.array(weights)).max() < 1e-8 and abs((p - y).mean()) < 1e-8
    urls.judge(table)
    assert urls._built_in(spark) is urls._built_in(None)
    try:
        urls.train(spark.range(urls.MOST_LABELLED + 1).selectExpr("'http://a.org/' as url", "id % 2 as label"))
        raise AssertionError("a large table was taken")
    except ValueError:
        pass


def test_urls_repeated_rows_empty_table_and_ties(spark):
    rows = spark.createDataFrame([(1, "http://a.net/x", "s"), (1, "http://a.net/x", "s"), (None, None, None)], "page_id long, url string, score string")
    got = urls.judge(rows)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "score"] and got.count() == 3
    assert [(r.rule, r.verdict) for r in got.where("page_id = 1").collect()] == [("net/", "block")] * 2
    assert urls.judge(rows.limit(0)).count() == 0
    tied = urls.judge(rows, rules=(("allow", "net", "/"), ("block", "net", "/")))
    assert {r.verdict for r in tied.where("page_id = 1").collect()} == {"allow"}  # the first of equally long rules


def test_long_page_and_empty_table(spark):
    story = "".join(f"<p>line {i} of a long tale</p>" for i in range(20_000))
    rows = [(1, "http://l.org/a", f"<div>Home</div>{story}<div>Imprint</div>"), (2, "http://l.org/b", "<div>Home</div><p>short one here</p><div>Imprint</div>")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1].text.startswith("line 0 of") and got[1].text.endswith("line 19999 of a long tale") and got[2].text == "short one here"
    assert html.extract(spark.createDataFrame([], PAGES)).collect() == []
