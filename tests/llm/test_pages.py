"""Main text of pages: templates of several kinds, odd markup, odd rows."""

import time

import duckdb

from palimpsest.llm import html_extraction
from palimpsest.llm.html_extraction import main_text

PROSE = "The house of the old man is in the middle of a small town, and it was built by his father when there was no road to the sea."
GERMAN = "Das Haus in der Mitte der Stadt ist von seinem Vater gebaut, und es war nicht so alt wie die Kirche auf dem Berg über dem Fluss."

HEAD = "<!DOCTYPE html><html><head><title>A title of the page</title><style>p{margin:0}</style><script>var t='</p><p>no text';</script></head><body class='has-sidebar comments-open'>"
SIDE = (
    "<header class='site'><h1>The site</h1></header><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News of the day</a></li></ul></nav>"
    f"<div class='cookie-notice'>{PROSE} We use cookies.</div><aside><p>{PROSE} Aside.</p></aside><form><label>Your name</label><p>{PROSE}</p><button>Send it</button></form>"
)
FOOT = f"<div id='comments'><article class='comment'><p>{PROSE} I think so too.</p></article></div><footer>&copy; 2020 The site &middot; {PROSE}</footer></body></html>"


def test_an_article_stays_and_what_surrounds_it_goes():
    page = f"{HEAD}{SIDE}<article class='post'><header><h1>Head line</h1></header><p>{PROSE}</p><p>Short.</p><div class='ad'>{PROSE} Buy!</div><p>{GERMAN}<br>End.</p><section class='comments'><p>{PROSE}</p></section></article>{FOOT}"
    assert main_text(page) == f"Head line {PROSE} Short. {GERMAN} End."


def test_blocks_decide_where_no_element_says_so():
    page = f"{HEAD}{SIDE}<div id='page'><h2>Head line</h2><p>Short.</p><p>{PROSE} {PROSE}</p><p>End.</p><p><a href='/x'>Another story of the same day that has nothing to do with it at all</a></p></div>{FOOT}"
    assert main_text(page) == f"Head line Short. {PROSE} {PROSE} End."


def test_a_short_text_in_a_part_named_content_stays():
    assert main_text(f"{HEAD}{SIDE}<div class='content'><p>Word.</p></div>{FOOT}") == "Word."
    assert main_text(f"{HEAD}{SIDE}<article><p>Word.</p></article>{FOOT}") == "Word."
    assert main_text(f"<form action='/'>{SIDE}<article><p>{PROSE}</p></article></form>") == PROSE


def test_a_language_without_a_list_is_judged_by_length():
    text = "привет мир как дела " * 20
    assert main_text(f"<div><a href='/'>дом</a></div><p>{text}</p>") == text.strip()


def test_references_blanks_and_odd_markup():
    assert main_text("<article><p>a&nbsp;&nbsp;b &lt;p&gt; &#65;&#x42; &amp;amp; caf&eacute; x<b>y</b>z<br>q</p><pre>l1\n  l2</pre></article>") == "a b <p> AB &amp; café xyz q l1 l2"
    assert main_text("<article><p>A &am &amp B<!-- c > --> c<p title=\"a > b\">T</p><p title='it>'>U</article>") == "A &am & B c T U"
    assert main_text(f"<article><p>{PROSE}<a hre") == PROSE
    assert main_text("<article>a < b and 3<4 c</article>") == "a < b and 3<4 c"
    assert main_text(f"<table><tr><td><a href='a'>x</a><td>{PROSE}{PROSE}</table>") == PROSE + PROSE
    assert main_text(f"<article><p>{PROSE}</p><p style='display: none'>{PROSE}</p><span hidden>h</span></article>") == PROSE
    assert [main_text(p) for p in (None, "", " ", "<p>", "<!--", "<script>x", PROSE)] == ["", "", "", "", "", "", PROSE]


def test_time_grows_with_the_length_of_the_page():
    began = time.perf_counter()
    for page in ("<div>" * 100_000 + "x", "<p>a" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, "<" * 200_000, '<a href="' * 50_000, "<ul>" + "<li><div>" * 50_000):
        main_text(page)
    assert time.perf_counter() - began < 30
    assert main_text(f"<article>{f'<p>{PROSE}</p>' * 20_000}</article>") == " ".join([PROSE] * 20_000)


def test_rows_are_kept_as_they_are(spark):
    schema = "page_id long, url string, html string, text string, N_CHARS int"
    rows = [(1, "u", f"<article><p>{PROSE}</p></article>", "t", 1), (1, "u", f"<article><p>{PROSE}</p></article>", "t", 1), (None, None, None, None, None), (2, "v", "", "t", 2), (3, "w", "<article>é😀</article>", "", 0)]
    found = html_extraction.extract_main_text(spark.createDataFrame(rows, schema))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "u", PROSE, len(PROSE))] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", "é😀", 2)], key=str)
    assert html_extraction.extract_main_text(spark.createDataFrame([], schema)).count() == 0


def test_the_query_is_its_sql_on_odd_pages(spark, tmp_path):
    rows = [(i, f"u{i}", f"{HEAD}<nav><a href='/'>x</a></nav><div class='ad'>{PROSE}</div><article><h1>T{i}</h1><p><b>{PROSE}&amp;&amp{'x' * (i % 3)}<br><p>{GERMAN} &quot;</p><p>Kurz.</p></article><footer>&copy; f</footer>{'</body></html>' * (i % 2)}") for i in range(30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = db.sql(html_extraction.ORACLE_SQL["op11_html_extraction"]).fetchall()
    assert sorted(want) == sorted(map(tuple, html_extraction.query(spark, str(tmp_path)).collect()))
