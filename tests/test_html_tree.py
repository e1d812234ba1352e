"""The tree of marked-up texts, against what the HTML standard's algorithm gives."""

import random
import time

import pytest

from crawlspark.functions.html import parse_html
from crawlspark.functions.html_tree import Node, parse

VOID = {"br", "img", "input", "hr", "col", "meta", "link", "base"}


def shown(node) -> str:
    if isinstance(node, str):
        return node
    inside = "".join(map(shown, node.children))
    name = node.tag + "".join(f" {k}={v}" for k, v in node.attrs.items())
    return f"<{name}>" if node.tag in VOID else f"<{name}>{inside}</{node.tag}>"


def tree(text: str) -> str:
    return "".join(map(shown, parse(text).children))


CASES = [
    # implied ends
    ("<p>a<p>b", "<p>a</p><p>b</p>"),
    ("<p>a<div>b</div>c", "<p>a</p><div>b</div>c"),
    ("<p>a<span>b<p>c", "<p>a<span>b</span></p><p>c</p>"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>e"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("<h1>A<h2>B</h2>", "<h1>A</h1><h2>B</h2>"),
    ("<h1>A</h2>B", "<h1>A</h1>B"),
    ("a</p>b", "a<p></p>b"),
    ("<button>a<button>b", "<button>a</button><button>b</button>"),
    ("<button><p>a</button>b", "<button><p>a</p></button>b"),
    ("<ruby>a<rp>(<rt>b<rp>)</ruby>", "<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>"),
    # formatting elements
    ("<b>1<p>2</b>3", "<b>1</b><p><b>2</b>3</p>"),
    ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
    ("<b>1<p>2</p></b>3", "<b>1<p>2</p></b>3"),
    ("<p><b>1<p>2", "<p><b>1</b></p><p><b>2</b></p>"),
    ("<a href=1>x<a href=2>y", "<a href=1>x</a><a href=2>y</a>"),
    ("<a href=1>x<div><a href=2>y", "<a href=1>x</a><div><a href=1></a><a href=2>y</a></div>"),
    ("<a href=1><p>x</a>y", "<a href=1></a><p><a href=1>x</a>y</p>"),
    ("<p><a href=1>x</p><p>more</p>", "<p><a href=1>x</a></p><p><a href=1>more</a></p>"),
    ("<b><b><b><b><p>x", "<b><b><b><b><p>x</p></b></b></b></b>"),
    ("<p><b><b><b><b></p>x", "<p><b><b><b><b></b></b></b></b></p><b><b><b>x</b></b></b>"),
    ("<nobr>a<nobr>b", "<nobr>a</nobr><nobr>b</nobr>"),
    ("<i>a<b>b<div>c</i>d</div>", "<i>a<b>b</b></i><b><div><i>c</i>d</div></b>"),
    ("<object><b>a</object>c", "<object><b>a</b></object>c"),
    # tables
    ("<table><tr><td>a<td>b<tr><td>c</table>d", "<table><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>d"),
    ("<table>x<tr><td>a</table>", "x<table><tbody><tr><td>a</td></tr></tbody></table>"),
    ("<table><a href=1>x</a><tr><td>a</table>", "<a href=1>x</a><table><tbody><tr><td>a</td></tr></tbody></table>"),
    ("<table><td>a</table>", "<table><tbody><tr><td>a</td></tr></tbody></table>"),
    ("<table><caption>c<tr><td>a</table>", "<table><caption>c</caption><tbody><tr><td>a</td></tr></tbody></table>"),
    ("<table><tr><td><a href=1>x<td>y</table>z", "<table><tbody><tr><td><a href=1>x</a></td><td>y</td></tr></tbody></table>z"),
    ("<table><tr><td><table><tr><td>x</table>y</table>", "<table><tbody><tr><td><table><tbody><tr><td>x</td></tr></tbody></table>y</td></tr></tbody></table>"),
    ("<table><tr><table><tr><td>x", "<table><tbody><tr></tr></tbody></table><table><tbody><tr><td>x</td></tr></tbody></table>"),
    ("<td>a</td><tr>b", "ab"),
    ("<!doctype html><p>a<table></table>", "<p>a</p><table></table>"),
    ("<p>a<table></table>", "<p>a<table></table></p>"),
    ("<table><colgroup><col><tr><td>x", "<table><colgroup><col></colgroup><tbody><tr><td>x</td></tr></tbody></table>"),
    ("<table><input type=hidden><input>", "<input><table><input type=hidden></table>"),
    # raw text
    ("<noscript><a href=/n>x</a></noscript>y", "<noscript><a href=/n>x</a></noscript>y"),
    ("<textarea><a href=/q>&amp;</textarea>y", "<textarea><a href=/q>&</textarea>y"),
    ("<title>a<b>&lt;</title>c", "<title>a<b><</title>c"),
    ("<script>'</p>'</SCRIPT >b", "<script>'</p>'</script>b"),
    ("<style></styl></style>x<xmp><b></xmp>", "<style></styl></style>x<xmp><b></xmp>"),
    ("a<plaintext></plaintext><b>", "a<plaintext></plaintext><b></plaintext>"),
    # lists of options
    ("<select><a href=1>x</a><option>a<option>b</select>c", "<select>x<option>a</option><option>b</option></select>c"),
    ("<select><optgroup><option>a<optgroup>b<input>", "<select><optgroup><option>a</option></optgroup><optgroup>b</optgroup></select><input>"),
    # svg
    ("<svg><title>a<b>c</title></svg>", "<svg><title>a<b>c</b></title></svg>"),
    ("<svg><a href=1>x</a><path/>y</svg>z", "<svg><a href=1>x</a><path></path>y</svg>z"),
    ("<svg><g><p>x", "<svg><g></g></svg><p>x</p>"),
    ("<svg><![CDATA[a<b]]></svg>", "<svg>a<b</svg>"),
    ("<svg><foreignObject><p>a<p>b</p></foreignObject></svg>c", "<svg><foreignobject><p>a</p><p>b</p></foreignobject></svg>c"),
    ("<svg><foreignObject><p>b</foreignObject></svg>c", "<svg><foreignobject><p>bc</p></foreignobject></svg>"),
    ("<math><mi><b>x</mi>y</math>z", "<math><mi><b>xyz</b></mi></math>"),
    ("<span><math><mi><b>x</span>y", "<span><math><mi><b>xy</b></mi></math></span>"),
    # tags as such
    ("<a/href=x/>y", "<a href=x/>y</a>"),
    ("<A HREF='q' href=z Title>t", "<a href=q title=>t</a>"),
    ("<a href = x >y", "<a href=x>y</a>"),
    ("<br/></br>a</>b< c<3", "<br><br>ab< c<3"),
    ("<!-->a<!---->b<!--c--!>d<!x>e<?f>g</ h>i", "abdegi"),
    ("a<b c='", "a"),
    ("<form>a<form>b</form>c</form>d", "<form>ab</form>cd"),
    ("<template><tr><td>a</template>b", "<template><tr><td>a</td></tr></template>b"),
    ("x</body></html><p>y", "x<p>y</p>"),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert tree(text) == want


def test_page_fields():
    got = lambda t: parse_html(t, "https://s.test/", "s.test", False)
    assert [x["text"] for x in got("<p><a href=/1>x</p><p>more</p>")["links"]] == ["x"]
    assert got("<noscript><a href=/n>x</a></noscript><textarea><a href=/q>q</a></textarea>")["links"] == []
    assert got("<h1>A<h2>B</h2>")["h1"] == "A"
    assert got("<table><tr><a href=/in>t</a><td>x</table><a href=/after>u</a>")["links"][0]["url"] == "https://s.test/in"
    assert got("<svg><title>icon</title></svg><title>page</title>")["title"] == "icon"


def test_any_text_gives_a_tree_that_holds_together():
    r = random.Random(3)
    tags = "a b i p div table tr td th tbody caption select option svg title h1 h2 li ul button nobr template form font script math mi foreignobject br input object".split()
    for _ in range(3000):
        text = "".join(r.choice([f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", "x", " ", f"<{r.choice(tags)} href={r.randint(0, 3)}>"]) for _ in range(r.randint(1, 40)))
        root, seen = parse(text), set()
        for n in root.walk():
            if isinstance(n, Node):
                assert id(n) not in seen
                seen.add(id(n))
                assert all(c.parent is n for c in n.children if isinstance(c, Node))


@pytest.mark.parametrize("part", ["<div>", "<b>", "<p><b>", "<a href=x>", "<table>", "</b>", "<li>", "<i><div>", "<", "<!--", "<svg>", "<a b='", "&amp;"])
def test_long_texts(part):
    began = time.time()
    parse(part * 3000)
    assert time.time() - began < 20
