"""Main text of pages that are made by hand."""

from feedloom.operators import pages

WORDS = "A sentence that is long enough to count as text, number {}."


def page(body, head=""):
    return f"<html><head><title> A &amp;\n title </title>{head}</head><body>{body}</body></html>"


def test_main_text(spark):
    text = "".join(f"<p>{WORDS.format(i)}</p>" for i in range(4))
    nav = "<nav><ul>" + "".join(f"<li><a href=/{i}>A link of the site, and a long one at that {i}</a></li>" for i in range(30)) + "</ul></nav>"
    cases = {
        1: (page(f"{nav}<div id=main><h2>Head</h2>{text}</div><footer>{text}</footer>"), ["Head", *map(WORDS.format, range(4))]),
        # two sections that read alike are joined; comments, scripts, shares and boxes of links aren't
        2: (page(f"<main><section>{text}</section><div class='share-box'>{text}</div><section><p>{WORDS.format(9)}<br>And <b>more</b> of <a href=x>it</a>.</section><ul><li><a href=y>{WORDS}</a></ul></main><div class=comments>{text * 9}</div><script>var p = '<p>{WORDS}</p>'</script>"),
            [*map(WORDS.format, range(4)), WORDS.format(9) + " And more of it."]),
        # paragraphs that nobody closed, tags that were never opened, a comment in between
        3: (f"<div>{text.replace('</p>', '')}</i></td><!-- <p>gone</p> --><p>caf&eacute; &#8217;&nbsp;&lt;p&gt;", [*map(WORDS.format, range(4)), "café ’ <p>"]),
        4: (page("Short."), ["Short."]), 5: ("", []), 6: (None, []), 7: (page(f"<article>{'<div>' * 200}{text}"), [*map(WORDS.format, range(4))]),
        8: (page("<div>" + "<p>" + "long " * 50000 + "</p></div>"), [("long " * 50000).strip()]),
    }
    meta = "<meta property='og:title' content='Other  title'><meta name=author content='Ann &amp; Bo'><meta property='article:published_time' content='2024-03-01T10:00:00Z'>"
    rows = [(k, f"https://www.Site{k}.example/a?b", h, "x") for k, (h, _) in cases.items()] + [(9, None, page(f"<time datetime='2023-01-02'>then</time>{text}", meta), "x")]
    got = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id int, url string, html string, text string")).collect()}
    assert {k: got[k].text.split("\n\n") if got[k].text else [] for k in cases} == {k: v for k, (_, v) in cases.items()}
    assert (got[1].title, got[1].site, got[1].published, got[1].blocks) == ("A & title", "site1.example", None, 5) and (got[3].title, got[6].title) == ("", "")
    assert (got[9].title, got[9].author, got[9].site, got[9].published) == ("Other title", "Ann & Bo", "", "2024-03-01")


def test_references_that_were_cut(spark):
    html = page("<article><p>Salt &amp; pepper &amp, A&ampB &#38 x</p></article>").replace(" A &amp;\n title ", "and&amp;&amp")
    rows = spark.createDataFrame([(1, "https://a.example/", html)], "page_id int, url string, html string")
    told = lambda bare: tuple(pages.main_text(rows, bare=bare).select("title", "text").first())
    assert told(False) == ("and&&amp", "Salt & pepper &amp, A&ampB &#38 x")
    assert told(True) == ("and&&", "Salt & pepper &, A&B & x")
