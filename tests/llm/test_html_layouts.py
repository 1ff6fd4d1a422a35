"""Hand-written layouts of main-text extraction, each with and without the tags that HTML lets authors leave out."""

import pytest

from terrapane.llm import html_extract

PARAS = [" ".join(f"Word{i} goes on and on, sentence {j} of text." for j in range(4)) for i in range(10)]
TITLE = "A title of the piece"
BODY = f"<h1>{TITLE}</h1>" + "".join(f"<p>{p}</p>" for p in PARAS)
OPEN = f"<h1>{TITLE}</h1>" + "".join(f"<p>{p}" for p in PARAS)
LAYOUTS = {
    "article": f"<nav><ul><li><a href=/a>first</a><li><a href=/b>second</a></ul></nav><article>{BODY}</article><footer>Copyright 2020</footer>",
    "div of a class": f"<div class=menu><a href=/a>first</a></div><div class=content>{BODY}</div><div id=footer>(c) 2020</div>",
    "bare div": f"<div><a href=/>home</a></div><div>{BODY}</div>",
    "straight in the body": f"<a href=/>home</a>{BODY}",
    "main": f"<header><a href=/>home</a></header><main>{BODY}</main><aside><h3>More</h3><ul><li><a href=/x>elsewhere</a></ul></aside>",
    "nested wrappers": f"<div id=page><div id=main><div class=post>{BODY}</div></div></div>",
    "section and form": f"<section>{BODY}</section><form><label>Search</label><input name=q><button>go</button></form>",
    "slashes": f'<div class=top/></div><br/><hr/><img src="/x.png"/><article>{BODY}</article>',
    "unclosed paragraphs": f"<div class=story>{OPEN}</div><div class=footer>Imprint</div>",
    "scripts and styles": f"<style>p {{ color: red }}</style><script>var a = '<p>no</p>';</script><article>{BODY}</article><noscript>Turn on scripts</noscript>",
}
AROUND = [("", ""), ("<html>", "</html>"), ("<body>", "</body>"), ('<!DOCTYPE html><html lang="en"><head><title>t</title></head><body>', "</body></html>"), ("<title>t</title><meta charset=utf-8>", "")]


@pytest.fixture(scope="module")
def model():
    return html_extract.default_model()


@pytest.mark.parametrize("name", LAYOUTS)
def test_articles_are_whole_with_and_without_optional_tags(model, name):
    for before, after in AROUND:
        got = html_extract.extract([before + LAYOUTS[name] + after], model)[0].split("\n")
        kept = [b for b in got if b in (TITLE, *PARAS)]
        assert kept == [TITLE, *PARAS], (name, before)
        assert len(got) - len(kept) <= (name == "straight in the body"), (name, before, got)


def test_one_html_and_one_body():
    page = html_extract.Page("<html><body class=a><p>x</body></html><p>y<body id=b>")
    assert page.tag == ["#page", "html", "body", "p", "p"] and page.parent == [-1, 0, 1, 2, 2] and "class=a" in page.attrs[2] and "id=b" in page.attrs[2]
    assert html_extract.Page("<div/>a<div>b").parent == [-1, 0, 1, 2, 3]


def test_texts_without_tags_and_empty_pages(model):
    assert html_extract.extract(["plain text &amp; more", "", "<html><body></body></html>", " \n "], model) == ["plain text & more", "", "", ""]


def test_odd_pages(spark):
    rows = [(1, "u", None, 9), (2, None, "", 9), (None, "u", f"<article>{BODY}</article>", 9), (3, "u", f"<article>{BODY}</article>", 9), (3, "u", f"<article>{BODY}</article>", 9), (4, "u", "<div>" * 3000 + f"<article>{BODY}</article>", 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_extract.main_text(df).collect()
    whole = "\n".join([TITLE, *PARAS])
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got if r["page_id"] != 4) == [(0, len(whole)), (1, 0), (2, 0), (3, len(whole)), (3, len(whole))]
    assert all(r["text"] == whole for r in got if r["page_id"] in (None, 3)) and len(got) == 6
    assert html_extract.main_text(df.where("false")).collect() == []
