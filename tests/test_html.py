"""P-18: markup by one left-to-right pattern, against the standard library's tokenizer."""

from html.parser import HTMLParser

import pytest

from redline.functions.text import html_text

PAGES = {
    '<a title="x > y">t</a>': "t",
    "<script>if(a<b){}</script >after": "after",
    "a < b and c > d": "a < b and c > d",
    "<!-- <b> > -->x<!--y": "x",
    "<SCRIPT src='a>b'>var x = '<p>';</SCRIPT\n><p>ok</p>": "ok",
    "<style>p > a {}</style><scripted>kept</scripted>": "kept",
    "<script>never closed <b>": "",
    "<p class='a>b' id=\"c'>d\">q</p>": "q",
    '<a title="never closed>rest</a>': "rest",
    "<br/>x<br />y</p >z": "x y z",
    "<!DOCTYPE html><?xml version='1'?>&lt;b&gt; &amp;": "<b> &",
    "": "", "plain": "plain",
}


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.raw = [], 0

    def handle_starttag(self, tag, attrs):
        self.raw += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style") and self.raw > 0

    def handle_data(self, data):
        if not self.raw:
            self.parts.append(data)


@pytest.fixture(scope="module")
def texts(spark):
    df = spark.createDataFrame([(p,) for p in PAGES], "h string")
    return {r.h: r.t for r in df.select("h", html_text("h").alias("t")).collect()}


@pytest.mark.parametrize("page", list(PAGES))
def test_pages(texts, page):
    assert texts[page] == PAGES[page]


def test_same_text_as_the_tokenizer(spark):
    """On the given pages, blanks aside."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", html_text("html").alias("t")).collect()
    for r in rows:
        p = Plain()
        p.feed(r.html)
        p.close()
        assert "".join(r.t.split()) == "".join("".join(p.parts).replace("\xa0", " ").split())


def test_long_tags_do_not_exhaust_the_stack(spark):
    long = "<p " + " ".join(f"a{k}='{k} > x'" for k in range(3000)) + ">t</p>" + "<img src='" + "x" * 200_000 + "'>u"
    assert spark.createDataFrame([(long,)], "h string").select(html_text("h")).first()[0] == "t u"
