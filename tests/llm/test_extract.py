import pytest

from tidepool.llm import extract

CASES = [
    ("<p>a<p>b", "a\nb"), ("", ""), ("plain &lt;text&gt; &amp; more", "plain <text> & more"), ("<div class='ad'>x<article><h1>T</h1><p><b>q<br><p>z &amp; y</article><footer>f", "T\nq\nz & y"),
    ("<ul><li>1<li>2</ul>tail<nav>n</nav>e", "1\n2\ntail\ne"), ("<article><p>x</p><div class='comments'><p>c</p></div></article><p>out", "x"), ("<p>a <scr", "a"), ("<p>x &am", "x &am"),
    ("a < b <i>c</i>d<script>if(a<b)'</p>'</SCRIPT >k", "a < b cdk"), ("<main><p>m</p></main><p>o</p>", "m"), ("<p>\n a \t b&nbsp;c </p>", "a b c"), ("<!-- <p>no</p> --><p>yes", "yes"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<p title='a>b'>t</p>", "t"), ("<form><p>f</p></form><p id=cookie-notice>n</p>z", "z"), ("<article>a</article><article>b</article>", "a\nb"), ("<p>&#233;&#xe9;&eacute;", "ééé"),
]


@pytest.mark.parametrize("source,text", CASES)
def test_main_text(source, text):
    assert extract.Page(source).main_text() == text


def test_templates_of_a_host_go_and_quotes_stay(spark):
    rows = []
    for i in range(12):
        rows.append((i, f"http://h.example/{i}", f"<body><div class=x><p>Read our terms now</p></div><div><p>Story {i}</p></div><p>A common passage</p></body>"))
        rows.append((100 + i, "http://one.example/", "<article><div>Same copy</div></article>"))
    rows += [(200, "http://other.example/", "<div class=x><p>Read our terms now</p></div>"), (201, None, None), (None, "u", "<p>x</p>"), (201, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", __import__("pyspark").sql.functions.lit(1)).withColumn("host", __import__("pyspark").sql.functions.lit("clash"))
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extract.report(pages).collect()), key=str)
    want = []
    for i in range(12):
        want += [(i, f"Story {i}\nA common passage", len(f"Story {i}\nA common passage")), (100 + i, "Same copy", 9)]
    want += [(200, "Read our terms now", 18), (201, "", 0), (None, "x", 1), (201, "", 0)]
    assert got == sorted(want, key=str)


def test_join_paths_agree(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    one = sorted(map(tuple, extract.report(pages).collect()))
    monkeypatch.setattr(extract, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, extract.report(pages).collect())) == one
    assert extract.report(pages.limit(0)).count() == 0


def test_given_pages_depend_on_the_counts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    articles = {r.page_id: extract.Page(r.html or "").main_text() for r in pages.collect()}
    assert {r.page_id: r.text for r in extract.report(pages).collect()} == articles
    # without templates, menus and adverts of the larger hosts stay
    off = {r.page_id: r.text for r in extract.report(pages, 10**9).collect()}
    assert sum(off[k] != articles[k] for k in off) > 20


def test_counts_decide_where_names_say_nothing(spark):
    rows = []
    for i in range(20):
        extra = "<div class='comments'><p>I agree</p></div>" if i % 5 == 0 else ""
        rows.append((i, f"http://big.example/{i}", f"<body><div class='q7'><i>word {i}</i></div><article><div><p>Story {i}</p></div>{extra}</article>loose {i}<section><p>more {i}</p></section></body>"))
    rows.append((99, "http://small.example/", "<body><div class='q7'>x</div><article><p>Y</p><div class='comments'><p>c</p></div></article>loose</body>"))
    got = {r.page_id: r.text for r in extract.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Story {i}" for i in range(20)}, 99: "Y"}


@pytest.mark.parametrize("words", [True, False])
def test_a_page_does_not_depend_on_its_hosts_size(spark, monkeypatch, words):
    """The same page on hosts of 11, 12 and 40 pages, with and without names: menus, adverts and
    a tip inside the article recur and go, on small hosts the menus too."""
    sizes, rows = (2, 3, 8, 11, 12, 40), []
    mark = (lambda w: w) if words else (lambda w: f"q{len(w)}")  # class words that say nothing
    for n in sizes:
        for i in range(n):
            rows.append((n * 100 + i, f"http://h{n}.example/{i}", f"<body><div class='{mark('menu')}'><i>Page {i}</i></div><article><h1>T {i}</h1><p>Body {i} of the page.</p><div><p>Always the same tip.</p></div></article><div class='{mark('advert')}'><p>Buy {i * 7}</p></div></body>"))
    got = {r.page_id: r.text for r in extract.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in sizes:
        tip = "" if n >= extract.MIN_PAGES else "\nAlways the same tip."
        for i in range(n):
            assert got[n * 100 + i] == f"T {i}\nBody {i} of the page." + tip, n


def test_long_and_deep_pages(spark):
    import time

    deep = "<div>" * 50_000 + "<p>in</p>" + "<li>x" * 2_000 + "</b></span>" * 20_000
    long = "<article>" + "<p>one &amp; two</p>" * 100_000 + "</article>"
    start = time.time()
    pages = spark.createDataFrame([(1, "http://a/", deep), (2, "http://a/", long)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.report(pages).collect()}
    assert got[1] == "in\n" + "\n".join("x" for _ in range(2_000)) and got[2].count("one & two") == 100_000
    assert time.time() - start < 60
