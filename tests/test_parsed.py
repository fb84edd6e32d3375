"""Nested sources: YAML, JSON, XML, HTML and Markdown containers, by hand-made cases, independent parsers and time."""

import re
import time
from html.parser import HTMLParser

import pytest

from ledgerline.sources.containers import Tree, markdown_tree
from ledgerline.sources.markup import html_runs, markup_atoms, xml_runs
from ledgerline.sources.structured import coverage, structured_segments
from ledgerline.sources.yaml_scan import leaves
from tests.conftest import DATA

YAML = """a: [1, "two, \\u0033", {b: , c: 'it''s'}, k: v]
'quoted: key': x # note
list:
- - 1
  - -2.5
-
  deep:
    text: >+
      one
      two

        indented
      three

    last: !!str 7
empty:
plain: goes
  on and

  on: here
"""


def test_yaml_leaves():
    text = YAML.replace("\n  on: here", "\n  on here")
    got = leaves(text)
    assert [x[:3] for x in got] == [
        ("a[0]", "scalar_int", "1"), ("a[1]", "scalar_string", "two, 3"), ("a[2].b", "scalar_string", ""), ("a[2].c", "scalar_string", "it's"), ("a[3].k", "scalar_string", "v"),
        ("quoted: key", "scalar_string", "x"), ("list[0][0]", "scalar_int", "1"), ("list[0][1]", "scalar_float", "-2.5"), ("list[1].deep.text", "scalar_string", "one two\n\n  indented\nthree\n\n"),
        ("list[1].deep.last", "scalar_int", "7"), ("empty", "scalar_string", ""), ("plain", "scalar_string", "goes on and\non here"),
    ]
    assert text[got[1][3] : got[1][4]] == '"two, \\u0033"' and text[got[3][3] : got[3][4]] == "'it''s'"


@pytest.mark.parametrize("text", [YAML, "a: [1", "a: 'x", 'a: "\\q"', "a: 1\n- b", "? a\n: b", "[a,,b]", "{a: 1 b: 2}", "a: @x", "a: b\n c: d", "a: 'x' y"])
def test_malformed_yaml(text):
    with pytest.raises(ValueError):
        leaves(text)


def test_yaml_without_leaves():
    for text in ("", "# only\n", "---\n", "...\n", "{}", "[]", "*a", "\n\n"):
        assert leaves(text) == []


def test_yaml_time_is_in_proportion():
    def took(n):
        text = "".join(f'- name: "v{i}"\n  body: >\n    line é\n    line\n\n  list: [1, {{x: y}}]\n' for i in range(n)) + "- |\n" + "  z z\n" * n + "- " + "x" * n
        began = time.process_time()
        assert len(leaves(text)) == 4 * n + 2
        return time.process_time() - began

    took(500)
    assert took(24_000) < 12 * max(took(6_000), 0.05)


def test_segments_cover_odd_sources(spark):
    texts = ['{"é": [1, 2.0, null, "\\n"], "b": true}', '"alone"', "{broken", "", None, " [] ", YAML]
    rows = [(f"{form}{i}", form, t) for form in ("json", "yaml") for i, t in enumerate(texts)] + [("other", "ini", "x=1")]
    docs = spark.createDataFrame(rows, "source string, format string, text string")
    found = structured_segments(docs)
    cover = {r["source"]: r for r in coverage(found).collect()}
    sizes = {s: len(t.encode()) for s, _, t in rows if t}
    assert {s: r["bytes"] for s, r in cover.items()} == sizes and all(r["tiles"] for r in cover.values())
    errors = {r["source"] for r in found.where("kind = 'error'").collect()}
    assert errors == {"json2", "json6", "yaml2", "yaml6", "other"}
    by = {(r["source"], r["path"]): (r["node_kind"], r["value"], r["start_line"], r["start_column"]) for r in found.collect()}
    assert by["json0", "é[1]"] == ("scalar_float", "2.0", 1, 12) and by["json0", "é[2]"][:2] == ("scalar_null", "") and by["json1", "$"][1] == "alone"


def test_coverage_sees_gaps_and_overlaps(spark):
    rows = [("gap", 0, 3), ("gap", 4, 6), ("over", 0, 3), ("over", 2, 6), ("over", 6, 7), ("late", 1, 4), ("good", 0, 3), ("good", 3, 6)]
    df = spark.createDataFrame([(s, "text", a, b) for s, a, b in rows], "source string, kind string, start_byte long, end_byte long")
    assert {r["source"]: r["tiles"] for r in coverage(df).collect()} == {"gap": False, "over": False, "late": False, "good": True}


def test_xml_runs():
    text = "<?xml version='1.0'?><r:a xmlns:r='u' r:about='x/eli/1'>t&lt;<b id='n'/><b>u<!-- - -->v</b><c href='y/eli/2'> &#x41;<d><![CDATA[<&]]></d></c></r:a>"
    got = list(xml_runs(text))
    assert [x[:4] for x in got] == [("/a", "x/eli/1", 1, "t<"), ("/a/b[2]", "x/eli/1", 2, "u"), ("/a/b[2]", "x/eli/1", 2, "v"), ("/a/c", "y/eli/2", 2, "A"), ("/a/c/d", "y/eli/2", 3, "<&")]
    assert text[got[3][4] : got[3][5]] == " &#x41;"


@pytest.mark.parametrize("text", ["<a>", "<a></b>", "<a>&x;</a>", "<a", "<a b=c/>", "</a>", "<a>&#xD800;</a>", "<a><![CDATA[x</a>"])
def test_malformed_xml(text):
    with pytest.raises(ValueError):
        list(xml_runs(text))


class Plain(HTMLParser):
    """Runs of text outside scripts and styles, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.runs, self.raw, self.own = [], 0, ""

    def end(self):
        if self.own.strip():
            self.runs.append(self.own.strip())
        self.own = ""

    def handle_starttag(self, tag, attrs):
        self.end()
        self.raw += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.end()
        self.raw -= tag in ("script", "style")

    def handle_comment(self, data):
        self.end()

    handle_decl = handle_comment

    def handle_data(self, data):
        self.own += "" if self.raw else data

    def handle_entityref(self, name):
        self.own += f"&{name};"

    def handle_charref(self, name):
        self.own += f"&#{name};"


def test_html_runs_by_another_parser(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    for page in pages:
        p = Plain()
        p.feed(page)
        p.close()
        p.end()
        got = list(html_runs(page))
        assert [x[3] for x in got] == p.runs and all(page[x[4] : x[5]] == x[3] for x in got)


def test_html_paths_and_odd_markup(spark):
    got = [(x[0], x[3]) for x in html_runs("<ul><li>a<li>b<b>c</ul><p>d<p>e<div>f</i>g</div><br>h< 1 <img src=x>i<p title='>'>j<script>k</script>l<p")]
    assert got == [("/ul/li", "a"), ("/ul/li[2]", "b"), ("/ul/li[2]/b", "c"), ("/p", "d"), ("/p[2]", "e"), ("/div", "f"), ("/div", "g"), ("", "h"), ("", "< 1"), ("", "i"), ("/p[3]", "j"), ("/p[3]", "l")]
    rows = [("1", "html", "<a href='/eli/z'>x</a>y"), ("2", "html", ""), ("3", "html", None), ("4", "xml", "<a>"), ("5", "odd", "x"), ("6", "html", "é" * 20 + "<b>é")]
    found = markup_atoms(spark.createDataFrame(rows, "source string, format string, text string"))
    assert {r["source"]: r["tiles"] for r in coverage(found).collect()} == {s: True for s in "1456"}
    assert sorted(r["source"] for r in found.where("kind = 'error'").collect()) == ["4", "5"]
    assert [r["ref"] for r in found.where("source = '1' and kind = 'text'").orderBy("start_byte").collect()] == ["/eli/z#/a", "1#"]
    began = time.process_time()
    assert len(list(html_runs("<p>x</p>" * 50_000 + '<a "' * 50_001))) >= 50_000
    assert time.process_time() - began < 10


MARKDOWN = """1. one [l](u)
   still one
   - a
     > quoted in item
     >
     > | h | i |
     > | --- | --- |
     > | x \\| y | ![p](q) |
   - b
2. two

| just | bars |

> [!WARNING] now
> heed
> 1. do
"""


def tree(text):
    rows = Tree("s", text).rows
    ids = {r[1]: r for r in rows}
    return rows, ids


def test_markdown_containers():
    rows, ids = tree(MARKDOWN)

    def way(r):
        return (way(ids[r[2]]) + "/" if r[2] else "") + r[3]

    ways = [way(r) for r in rows]
    inner = "list/list_item/list/list_item/blockquote"
    assert f"{inner}/paragraph" in ways and f"{inner}/table/table_row/table_cell/image_ref" in ways and "list/list_item/link" in ways and "callout/list/list_item" in ways and "callout/paragraph" in ways
    assert "paragraph" in ways and ways.count("list/list_item") == 2 and ways.count("list/list_item/list/list_item") == 2
    raw = MARKDOWN.encode()
    assert "x \\| y" in [raw[r[5] : r[6]].decode().strip() for r in rows if r[3] == "table_cell"]
    assert next(r[12] for r in rows if r[3] == "table_row") == "h=x \\| y; i=![p](q)"


@pytest.mark.parametrize("text", [MARKDOWN, "", "\n\n", "- a\n" * 50, "> " * 60 + "deep\n", "".join(" " * 2 * i + "- x\n" for i in range(60)), "```\n> - x", "é | b\n--- | ---\nà | c", "# h [a](b)\r\n- é\r\n"])
def test_segments_lie_within_parents(text):
    rows, ids = tree(text)
    raw = text.encode()
    assert len(ids) == len(rows)
    roots = sorted((r[5], r[6]) for r in rows if r[2] is None)
    assert [b for _, b in roots[:-1]] == [a for a, _ in roots[1:]] and (not roots or (roots[0][0], roots[-1][1]) == (0, len(raw)))
    for r in rows:
        if r[2]:
            assert ids[r[2]][5] <= r[5] < r[6] <= ids[r[2]][6]
        assert re.sub(r"(?m)^[ >]*", "", raw[r[5] : r[6]].decode()) == re.sub(r"(?m)^[ >]*", "", r[9])


def test_null_markdown(spark):
    assert markdown_tree(spark.createDataFrame([("a", None), ("b", "")], "source string, text string")).count() == 0
