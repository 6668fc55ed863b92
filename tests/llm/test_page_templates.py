"""Pages whose text is not what an article or the largest block holds."""

from sparkloom.llm import pages

SHELL = "<html><body><nav><a href=/>Home</a></nav>{}<footer>us</footer></body></html>"


def extract(spark, bodies, host="a.example"):
    rows = [(i, f"http://{host}/{i}", SHELL.format(x)) for i, x in enumerate(bodies)]
    return {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_text_outside_a_teaser_article(spark):
    story = "A story of number {0}, with many words of its own that stand in no article at all."
    got = extract(spark, [f"<article><p>Teaser {i}</p></article><div class=story><p>{story.format(i)}</p></div>" for i in range(4)])
    assert got == {i: f"Teaser {i}\n{story.format(i)}" for i in range(4)}


def test_template_text_inside_an_article(spark):
    story = "A story of number {0}, with many words of its own that stand in an article."
    got = extract(spark, [f"<article><p>{story.format(i)}</p><div class=box><p>Read more with us</p></div></article>" for i in range(4)])
    assert got == {i: story.format(i) for i in range(4)}


def test_titles_lists_and_quotations_stay(spark):
    body = "<div class=content><h1>Title {0}</h1><p>{1}</p><ul><li>first {0}</li><li><a href=x>second {0}</a></li></ul><blockquote><p>said {0}</p></blockquote><p>{1} again</p></div>"
    long = [f"words of page {i} " * 150 for i in range(5)]
    want = {i: f"Title {i}\n{long[i].strip()}\nfirst {i}\nsecond {i}\nsaid {i}\n{long[i]}again" for i in range(5)}
    got = extract(spark, [body.format(i, long[i]) for i in range(5)])
    assert {i: x.replace("  ", " ") for i, x in got.items()} == want
    assert extract(spark, [body.format(0, long[0])]) == {0: want[0]}


def test_copies_of_one_article_keep_their_text(spark):
    same = "<article><h1>Same title</h1><p>The same long paragraph on each of these pages.</p></article>"
    assert set(extract(spark, [f"{same}<p>No {i}</p>" for i in range(4)]).values()) == {f"Same title\nThe same long paragraph on each of these pages.\nNo {i}" for i in range(4)}
