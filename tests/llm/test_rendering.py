"""Pages and the text they show."""

import pytest

from tailrace.llm.rendering import render_pages, visible_text

CASES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>a<p>b": "a\n\nb",
    "a <b>b</b>\n  c<br>d": "a b c\nd",
    "<head><title>t</title><style>p{}</style></head><body>x<script>if (a<b) '</p>'</script>y": "xy",
    "<!-- <p>no</p> -->a<!-- open": "a",
    "<ul><li>a<li>b<ul><li>c</ul></ul>end": "- a\n- b\n  - c\n\nend",
    "<ol start=3><li>a<li value=9>b<li>c</ol>": "3. a\n9. b\n10. c",
    "<ol reversed><li>a<li>b</ol>": "2. a\n1. b",
    "<dl><dt>t<dd>d</dl>": "t\n    d",
    "<p hidden>a</p><p style='display: none'>b</p><p style='color:red'>c</p>": "c",
    "<style>.x{display:none} p.y, #z{visibility:hidden}</style><i class='w x'>a</i><p class=y>b</p><div id=z>c</div>d": "d",
    "<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>": "a    bb\nccc  d",
    "<table><td>a<td>b</table>": "a  b",
    "<table><tr><td colspan=2>wide<td>z<tr><td>1<td>2<td>3</table>": "wide     z\n1     2  3",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<pre>\n a\n  b</pre>": " a\n  b",
    "<details><summary>s</summary>body</details>": "s",
    "<details open><summary>s</summary>body</details>": "s\nbody",
    "<dialog>no</dialog><noscript>no</noscript><template>no</template>yes": "yes",
    "a < b and <3": "a < b and <3",
    "<textarea>t <b></textarea>": "t <b>",
    "<b><p>one</b> two</p>": "one two",
    "a&nbsp;&nbsp;b": "a  b",
}


@pytest.mark.parametrize("page", list(CASES))
def test_page(page):
    assert visible_text(page) == CASES[page]


def test_deep_and_broken_pages():
    assert visible_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert visible_text("<a " * 2_000).count("<") <= 2_000
    assert visible_text("<p>" * 5_000) == ""
    assert "tail" in visible_text("<table>" * 300 + "tail")


def test_pages(spark):
    rows = [(1, "u", "<p>a<p>b"), (2, "u", None), (3, None, ""), (3, None, ""), (None, "u", "é")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    found = render_pages(frame.withColumn("text", frame["url"]))
    assert found.columns == ["page_id", "url", "text", "n_chars", "n_lines"]
    got = sorted(((r.page_id, r.text, r.n_chars, r.n_lines) for r in found.collect()), key=repr)
    assert got == sorted([(1, "a\n\nb", 4, 3), (2, None, None, None), (3, "", 0, 0), (3, "", 0, 0), (None, "é", 1, 1)], key=repr)
    assert render_pages(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # Deep nesting keeps what it hides hidden, and shows the rest.
        ("<div>" * 260 + 'a<span style="display:none">secret<b>more</b></span>b' + "</div>" * 260 + "c", "ab\nc"),
        ("<i>" * 5_000 + "deep" + "</i>" * 5_000, "deep"),
        # Rules for print do not count, those for screens do.
        ("<style>@media print{.a{display:none}}</style><p class=a>shown", "shown"),
        ("<style>@media screen{.a{display:none}} .b{color:red}</style><p class=a>x<p class=b>y", "y"),
        ("<style>@import 'x.css'; @font-face{a:b} .a{display:none}</style><p class=a>x<p>y", "y"),
        ("<style>@media (max-width: 5px){p{display:none}}</style><p>y", "y"),
        # The last rule wins, a more specific one before it, an important one before both.
        ("<style>.a{display:none}.a{display:block}</style><p class=a>shown", "shown"),
        ("<style>#i{display:none} p{display:block}</style><p id=i>x<p>y", "y"),
        ("<style>p{display:none!important}</style><p style='display:block'>x</p><div>y</div>", "y"),
        ("<style>.a{display:block}</style><p class=a hidden>shown", "shown"),
        # Visibility is inherited and can be taken back.
        ("<div style='visibility:hidden'>x<p style='visibility:visible'>y</p>z</div>", "y"),
        ("<style>.h{visibility:hidden}.v{visibility:visible}</style><ul class=h><li>x<li class=v>y</ul>", "- y"),
        # Descendants and children.
        ("<style>.n p{display:none}</style><div class=n><div><p>x</p></div></div><p>y", "y"),
        ("<style>.n > p{display:none}</style><div class=n><div><p>x</p></div><p>z</p></div><p>y", "x\n\ny"),
        ("<style>/* .a{} */ p.a.b{display:none}</style><p class='b a'>x<p class=a>y", "y"),
        ("<style>p:hover{display:none}</style><p>y", "y"),
        # Long cells are wrapped, so that what follows stays in its column.
        (
            "<table><tr><td>a<td>b<tr><td>" + "word " * 12 + "<td>c</table>",
            "a" + " " * 40 + "b\n" + " ".join(["word"] * 8) + "  c\n" + " ".join(["word"] * 4),
        ),
    ],
)
def test_styles_depth_and_wide_cells(page, text):
    assert visible_text(page) == text
