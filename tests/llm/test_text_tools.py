"""Token attribution and page wrappers."""

import random
import time

import numpy as np
from pyspark.sql import functions as F, types as T

from intentlane.llm import html_wrapper as H, token_counts as C
from intentlane.session import ship_package


def test_attribution_matches_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        cuts = sorted({0, 40, *(rnd.randrange(41) for _ in range(8))})
        start, end = np.array(cuts[:-1]), np.array(cuts[1:])
        marks = sorted(rnd.sample(range(41), 6))
        first, past = np.array(marks[::2]), np.array(marks[1::2])
        for rule in C.RULES:
            want = np.zeros(3)
            for s, e in zip(start, end):
                over = [max(0, min(e, b) - max(s, a)) for a, b in zip(first, past)]
                if sum(over) == 0:
                    continue
                if rule == "fraction":
                    want += np.array(over) / (e - s)
                else:
                    want[over.index(max(over)) if rule == "majority" else next(i for i, o in enumerate(over) if o)] += 1
            assert np.allclose(C.attribute(start, end, first, past, rule), want), rule


def test_token_jobs(spark):
    ship_package(spark)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("section", T.StringType())])
    rows = [(1, "Hello wörld\nsecond line 😀\n", "x"), (2, None, None), (3, "", None), (None, "a b", None), (4, "\n\n", None), (5, "word " * 20000, None)]
    df = spark.createDataFrame(rows, schema)
    got = C.section_tokens(df).collect()
    tok = C.Tokenizer(C.read_ranks(spark, C.TOKENIZER))
    for d, text, _ in rows:
        mine = sorted((r["section"], r["char_start"], r["char_end"], r["n_tokens"]) for r in got if r["doc_id"] == d)
        assert sum(r[3] for r in mine) == len(tok.encoding.encode_ordinary(text or ""))
        assert [r[0] for r in mine] == list(range(len(mine))) and mine[0][1] == 0 and mine[-1][2] == len(text or "")
    text, sections = C.fields_text([("a", F.col("text")), ("b", F.col("section"))])
    named = C.section_tokens(df, text=text, sections=sections, rule="fraction").collect()
    assert {r["name"] for r in named} == {"a", "b"} and len(named) == 2 * len(rows)
    assert C.section_tokens(df.limit(0)).count() == 0


PAGE = ("<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a>"
        "</li></ul></nav><!-- ad --><div class=\"ad\">Buy {0}</div><article><h1>Title {0} &amp; more</h1><p><b>First\n\n {0}<br><p>Second.</p>{1}"
        "<div class='comments'><p>nice post</p></div></article><aside>side</aside><form><input>go</form><footer>&copy; us</footer>")
PLAIN = "<body><div class=top>Site name</div><div id=x><h2>Head {0}</h2><p>Body <i>{0}</i></p>{1}</div><ul><li><a href=1>a</a></li></ul><div>All rights</div></body>"


def test_wrapper_reads_main_text():
    assert H.main_text(PAGE.format("one", ""), None) == "Title one & more\nFirst one\nSecond."
    wrapper = H.new_wrapper()
    for n in range(4):
        H.learn_page(wrapper, H.parse(PLAIN.format(n, "<h2>x</h2><p>y</p>" * (n % 3))))
    assert H.main_text(PLAIN.format(9, "<h2>x</h2><p>y</p>"), wrapper) == "Head 9\nBody 9\nx\ny"
    assert [H.main_text(x, None) for x in (None, "", "<<>> a < b &lt;", "<p>open")] == ["", "", "<<>> a < b <", "open"]
    assert H.main_text("<div>" * 3000 + "deep" + "</div>" * 3000, None) == "deep"


def test_merged_wrappers_cover_both():
    a, b = H.new_wrapper(), H.new_wrapper()
    H.learn_page(a, H.parse("<div>same</div><p>one</p>"))
    H.learn_page(b, H.parse("<div>same</div><section>s</section><p>two</p><p>three</p>"))
    merged = H.merge(a, b)
    parts = {p[H.KEY]: p for p in merged[H.PARTS]}
    assert parts["section"][H.OPTIONAL] and parts["flow"][H.REPEATED] and not parts["div"][H.OPTIONAL]
    assert parts["div"][H.PARTS][0][H.TEXT] == "same" and parts["flow"][H.PARTS][0][H.TEXT] is None


def test_pages_job(spark):
    ship_package(spark)
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                           T.StructField("host", T.StringType()), T.StructField("wrapper", T.StringType())])
    rows = [(i, f"http://big.example/{i}", PAGE.format(i, ""), "x", "y") for i in range(60)]
    rows += [(100, None, None, None, None), (101, "http://other.example/", "", None, None), (None, "http://big.example/z", PAGE.format("z", ""), None, None),
             (102, "no url", "<p>" + "long " * 50000, None, None), (1, "http://big.example/1", PAGE.format(1, ""), None, None)]
    got = H.extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[7] == "Title 7 & more\nFirst 7\nSecond." and text[100] == text[101] == ""
    assert len(text[102]) == 249999 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert H.extract_main_text(spark.createDataFrame([], schema)).count() == 0


def _learned(*pages):
    wrapper = H.new_wrapper()
    for page in pages:
        H.learn_page(wrapper, H.parse(page))
    return wrapper


def test_template_texts_in_the_article_are_left_out():
    page = "<body><div>Site name</div><article><h1>Title {0}</h1><p>Body {0}</p><div>Pass it on</div><ul><li>By {0}</ul></article></body>"
    wrapper = _learned(*(page.format(n) for n in range(5)))
    assert H.main_text(page.format(9), wrapper) == "Title 9\nBody 9\nBy 9"
    assert H.main_text("<body><div>Site name</div><p>No article here</p></body>", wrapper) == "No article here"


def test_copies_of_a_page_are_no_template():
    page = "<body><script>t({0})</script><div class=ad>Buy {0}</div><div class=top>Site name</div><div class=body>The only paragraph</div></body>"
    copies = [page.format(n) for n in range(6)]
    assert H.main_text(copies[0], _learned(*copies)) == "Site name\nThe only paragraph"
    assert H.main_text(copies[0], H.merge(_learned(*copies[:3]), _learned(*copies[3:]))) == "Site name\nThe only paragraph"
    others = [page.format(n).replace("only", f"{n}.") for n in range(3)]
    assert H.main_text(copies[0], _learned(*copies, *others)) == "The only paragraph"
    rows = "<body><ul><li>Read on<li>Read on<li>Read on</ul><p>Body {0}</p></body>"  # three times on each of two pages
    assert H.main_text(rows.format(1), _learned(rows.format(1), rows.format(2))) == "Read on\nRead on\nRead on\nBody 1"


def test_marked_words_do_not_hide_the_article():
    article = "<article><h1>Title</h1><p>Body</p></article>"
    for around in ('class="page right-sidebar"', 'id="wrap" class="layout-sidebar"'):
        page = f'<body><div {around}><div class=sidebar>Side</div>{article}<div class=related><article>Teaser of another</article></div></div></body>'
        assert H.main_text(page, None) == "Title\nBody"
        assert H.main_text(page, _learned(page)) == "Title\nBody"
    assert H.main_text(f"<body>{article}<div id=comments><article>A longer comment on it all</article></div></body>", None) == "Title\nBody"
    inside = ('<article><section id="related-work"><h2 id="comment-on-results">Results</h2><p>Text</p></section>'
              '<section id="search"><h2><span id="search">Search</span></h2></section><div class="related">Other</div></article>')
    assert H.main_text(inside, None) == "Results\nText\nSearch"


def test_marked_inline_elements_are_text_beside_text():
    cases = {'<article><span class="social">Tweet</span><h1>T</h1><p>Body</p></article>': "T\nBody",
             '<p>It is <span class="alert">not</span> safe.</p>': "It is not safe.",
             '<article>See <a class="related">this</a> and more text</article>': "See this and more text",
             '<article><p>a <img class="share-icon"> b</p></article>': "a b",
             '<article><span class="ad">Buy<span>x</span> now</span><p>Text</p><a class="related"><h3>Other</h3></a><p>More</p></article>': "Text\nMore",
             '<article><p>One <b class="ad">never closed</p><p>Two</p></article>': "One never closed\nTwo",
             '<article><div><span class="notice">Hear</div><p>Two <span>x</span></p></article>': "Two x"}
    for page, want in cases.items():
        assert H.main_text(page, None) == want, page


def test_classes_that_name_something_else_stay_in_the_article():
    kept = ("share-price", "alert-levels", "social-history", "search-results-table", "promotion-rules")
    left_out = ("share", "share-buttons", "related-posts", "ad-box", "reply", "comment-thread", "newsletter-signup", "sidebar right")
    page = "<article>" + "".join(f'<div class="{c}">{c} text</div>' for c in kept + left_out) + "</article>"
    assert H.main_text(page, None).split("\n") == [f"{c} text" for c in kept]


def test_main_part_with_more_text_is_read():
    page = "<main><h1>Story</h1><p>" + "long text " * 30 + "</p></main><article>Teaser</article>"
    want = "Story\n" + ("long text " * 30).strip()
    assert H.main_text(page, None) == want and H.main_text(page, _learned("<article><p>own text of another page</p></article>", page)) == want
    both = "<main><p>Lead</p><article><p>" + "long text " * 30 + "</p></article></main>"
    assert H.main_text(both, None) == ("long text " * 30).strip()


def test_constant_headings_and_sentences_of_the_article_stay():
    page = ('<body><div>Site name</div><article><h2 class="sec">Summary</h2><p>Body {0}</p><div>All prices are given in euro here.</div>'
            '<div class="end">Pass it on</div><p><a href="/all">All articles</a></p></article></body>')
    wrapper = _learned(*(page.format(n) for n in range(5)))
    assert H.main_text(page.format(9), wrapper) == "Summary\nBody 9\nAll prices are given in euro here."


def test_only_the_alignment_tells_this_boilerplate():
    """No class, no telling element, no main part: the host's other pages show what is the template's."""
    page = "<body><div><b>Top of the site</b></div><p>{0}</p><div>Written with care in Utrecht</div></body>"
    stories = [f"Story number {n} is about thing {n * n}." for n in range(6)]
    wrapper = _learned(*(page.format(s) for s in stories))
    assert H.main_text(page.format(stories[2]), wrapper) == stories[2]
    assert H.main_text(page.format(stories[2]), None).count("\n") == 2


def test_long_lists_align_in_linear_memory(monkeypatch):
    rnd = random.Random(1)
    for cells in (50, 4_000_000):
        monkeypatch.setattr(H, "_TABLE_CELLS", cells)
        for _ in range(100):
            a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(1, 45))] for _ in range(2))
            got = H._matched_long(a, b)
            assert got == sorted(got) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
            assert len(got) == len(H.matched(a, b)) and all(a[i] == b[j] for i, j in got)
    mixed = lambda seed: "<article>" + "".join(f"<{t}>{'w' * 110} {i}</{t}>" for i, t in enumerate(
        random.Random(seed).choices(["p", "div", "section", "ul", "table", "dl"], k=4500))) + "</article>"
    start = time.process_time()
    wrapper = _learned(mixed(1), mixed(2))
    assert H.main_text(mixed(1), wrapper).count("\n") == 4499 and time.process_time() - start < 20
