import pytest

from docindex.helpers.html_tree import parse, table_to_markdown, tidy, title_of, to_markdown
from docindex.operators import html


def markdown(page, **options):
    return tidy(to_markdown(parse(page), **options)[0])


def test_page():
    page = "<html><head><title> T </title></head><body><h1>A</h1><p>line<a>447</a>of</p><!-- c --><ul><li>x</li><li>y<ul><li>z</li></ul></li></ul><pre>int f();\n</pre></body></html>"
    root = parse(page)
    assert title_of(root) == "T"
    assert to_markdown(root)[1] == ["A"]
    assert markdown(page) == "# A\n\nline447of\n\nc\n\n- x\n- yz\n\n```\nint f();\n```"


def test_tables():
    one = parse("<table><tr><th>Name</th><th>Type</th></tr><tr><td>a|b</td></tr></table>").children[0]
    assert table_to_markdown(one) == "| Name | Type |\n| --- | --- |\n| a\\|b |  |"
    nested = "<table><tr><td>o<table><tr><td>i</td></tr></table></td></tr></table>"
    assert markdown(nested) == "| oi | i |\n| --- | --- |\n| i |  |"
    assert markdown(nested, nested_tables=False) == "| oi |\n| --- |"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<b>x<p>b", "ax\n\nb"),  # a new paragraph closes the open one and what is in it
        ("<ul><li>a<li>b</ul>", "- a\n- b"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "| a | b |\n| --- | --- |\n| c |  |"),
        ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
        ("a<br>b", "a\n\nb"),
        ("<p>x</div></p>y", "x\n\ny"),  # stray end tags count for nothing
        ("<body><script>var t='</p>';</script>x", "var t='</p>';\nx"),
        ("<p>&lt;b&gt; caf&eacute; 日本 😀</p>", "<b> café 日本 😀"),
        ("<h2> </h2><h3>t</h3>", "### t"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"),
        ("", ""),
    ],
)
def test_repairs(page, text):
    assert markdown(page) == text


def test_links_and_depth():
    assert markdown("<div><a href='u'>x</a></div>", keep_links=True) == "[x](u)"
    assert markdown("<div><a href='u'>x</a></div>") == "x"
    assert markdown("<div>" * 20_000 + "deep") == "deep"


def test_operator(spark):
    rows = [("a", "<title>T</title><body><nav>menu</nav><div class='ad-x'>ad</div><p>text</p></body>"), ("b", None), ("c", " \n ")]
    df = spark.createDataFrame(rows, "path string, html string")
    plain = {r["source_file"]: r for r in html.clean_html(df).collect()}
    assert plain["a"]["content"] == "menu\nad\n\ntext" and plain["a"]["title"] == "T"
    clean = {r["source_file"]: r["content"] for r in html.clean_html(df, remove_boilerplate=True).collect()}
    assert clean["a"] == "text"
    good, bad = html.drop_empty(html.clean_html(df))
    assert [r["source_file"] for r in good.collect()] == ["a"]
    assert {r["source_file"] for r in bad.collect()} == {"b", "c"}
    assert html.clean_html(df.limit(0)).count() == 0


def test_deeply_nested_tables():
    import random
    import time

    def plain(table):
        rows = ([c.text(strip=True).replace("|", "\\|") for c in r.find_all("th", "td")] for r in table.find_all("tr"))
        return [r for r in rows if r]

    rng = random.Random(4)

    def grow(depth):
        rows = "".join("<tr>" + "".join(rng.choice(["<td>", "<th>"]) + rng.choice(["a|b", " x ", "", "<b>c</b>d", "<script>s</script>", "<!-- c -->", grow(depth + 1) if depth < 4 else "e"]) for _ in range(rng.randrange(3))) for _ in range(rng.randrange(3)))
        return f"<table>{rows}</table>"

    from docindex.helpers.html_tree import table_rows

    for _ in range(200):
        table = parse(grow(0)).children[0]
        assert table_rows(table, True) == plain(table)
    deep = parse("<table><tr><td>" * 2000 + "x" + "</td></tr></table>" * 2000)
    began = time.process_time()
    text = to_markdown(deep)[0]
    assert time.process_time() - began < 2 and text.count("\n") > 2000
