import random
import re

from rillmark.llm import html


def text(s):
    return html.render(html.parse(s))


def test_blocks_inline_and_entities():
    assert text("<p>a <b>b</b>c<p>d &amp; e<div>f<br>g</div>h") == "a bc\n\nd & e\n\nf\ng\nh"
    assert text("<h1>T</h1>\n text\n more <span> x </span>y") == "T\n\ntext more x y"
    assert text("<pre>a\n  b</pre>c") == "a\n  b\n\nc"


def test_hidden_parts_and_raw_text():
    page = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t='</p>';</script></head><body><p>a</p><!-- c --><div hidden>no</div><p style='color:red; display : none'>no</p><noscript>no</noscript><template>no</template>b</body>"
    assert text(page) == "a\n\nb"
    assert html.title_of(html.parse(page)) == "x"
    assert text("a<script>x") == "a" and text("a<!-- b") == "a"


def test_implied_ends():
    root = html.parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3<td>4</table><dl><dt>k<dd>v<dt>l<dd>w</dl>")
    assert [c.tag for c in root.children] == ["ul", "table", "dl"]
    assert [c.tag for c in root.children[0].children] == ["li"] * 3
    assert [[x.tag for x in c.children] for c in root.children[1].children] == [["td", "td"]] * 2
    assert [c.tag for c in root.children[2].children] == ["dt", "dd", "dt", "dd"]
    assert text("<head><meta charset=x><p>a</p></head>b") == "a\n\nb"


def test_lists_with_marks_and_indents():
    assert text("<ol start=3><li>a<li>b<ul><li>c<li>d</ul></ol>e") == "3. a\n4. b\n   - c\n   - d\n\ne"
    assert text("<ul><li><p>a</p><li><b>b</b> c</ul>") == "- a\n\n- b c"


def test_tables_are_aligned():
    assert text("<table><caption>T</caption><tr><th>name<th>n<tr><td>long one<td>1<tr><td>x</table>z") == "T\nname     | n\nlong one | 1\nx\n\nz"
    assert text("<table><tr><td><table><tr><td>in<td>ner</table><td>b</table>") == "in | ner | b"


def test_text_that_cannot_stand_in_a_table_moves_before_it():
    assert text("<table>stray<tr><td>a<td>b</table>") == "stray\n\na | b"
    assert text("<table><tr><td>a</td>loose<b>bold</b></tr></table>") == "loosebold\n\na"
    assert text("<table><form><tr><td>x</form></table>") == "x"
    assert text("<table><tr><form><td>x<td>y</table>z") == "x | y\n\nz"
    assert text("<table><tr><td>a <table>in<tr><td>b</table></table>") == "a in\nb"


def test_spans_lists_and_lines_in_cells():
    assert text("<table><tr><td colspan=2>head<td>c<tr><td>1<td>2<td>3</table>") == "head  | c\n1 | 2 | 3"
    assert text("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a | b\n  | c"
    assert text("<table><tr><td><ul><li>x<li>y</ul><td>z</table>") == "- x | z\n- y |"
    assert text("<table><tfoot><tr><td>f</tfoot><tbody><tr><td>b</tbody><thead><tr><td>h</table>") == "h\nb\nf"


def test_form_controls_and_foreign_text():
    assert text("<select><option>one<option>two</select><textarea>a &lt; b\n c</textarea>x") == "one\ntwo\na < b\n c\nx"
    assert text("<xmp><b>raw</b></xmp>") == "<b>raw</b>"
    assert text("a <svg><title>no</title><text>drawn</text></svg> <math><mi>x</mi></math>") == "a drawn x"
    assert text("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details><dialog>no</dialog>") == "s\nt\nyes"


def test_rules_and_visibility():
    page = "<style>.no, #gone {display:none} em{visibility:hidden} p.no{display:block} @media print {b{display:none}}</style>"
    assert text(page + "<div class='x no'>1</div><p class=no>2</p><i id=gone>3</i><em>4<u style='visibility:visible'>5</u></em><b>6</b><div class=no style='display:block'>7</div>") == "2\n\n56\n7"
    assert text("<div style='visibility:hidden'>a<p style='visibility:visible'>b</div>") == "b"
    assert text("<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>c").split() == ["|", "b", "c"]


def random_page(r, depth=0):
    """Markup, and the words of it that show."""
    out, shown = [], []
    for _ in range(r.randint(1, 4)):
        kind = r.random()
        if kind < 0.4 or depth > 5:
            w = f"w{r.randint(0, 10**9)}"
            out.append(f" {w} "), shown.append(w)
        elif kind < 0.5:
            inner, _ = random_page(r, depth + 1)
            out.append(r.choice(["<div hidden>{}</div>", "<span style='display:none'>{}</span>", "<template>{}</template>", "<div class=off>{}</div>"]).format(inner))
        elif kind < 0.65:
            cells = [random_page(r, depth + 1) for _ in range(4)]
            stray, word = random_page(r, 6)
            out.append("<table>{}<tr><td>{}<td colspan=2>{}</tr><tr><td rowspan=2>{}<td>{}</table>".format(stray, *(c[0] for c in cells)))
            shown += word + [w for c in cells for w in c[1]]
        else:
            inner, words = random_page(r, depth + 1)
            out.append(r.choice(["<blockquote>{}</blockquote>", "<ul><li>{}</ul>", "<ol><li>x{}</ol>".replace("x", ""), "<div>{}</div>", "<b>{}</b>", "<select><option>{}</select>", "<section><h2>{}</h2></section>", "<pre>{}</pre>"]).format(inner))
            shown += words
    return "".join(out), shown


def test_every_visible_word_of_random_pages_shows_once():
    r = random.Random(8)
    for _ in range(300):
        page, words = random_page(r)
        got = re.findall(r"w\d+", text("<style>.off{display:none}</style>" + page))
        assert sorted(got) == sorted(words), page


def test_hidden_stays_hidden_at_any_depth():
    assert text("<div>" * 500 + "<p hidden>secret</p>seen") == "seen"
    assert text("<table><tr><td>" * 3000 + "deep") == "deep"


def test_broken_markup_and_depth():
    assert text("a < b <3 </x> <p") == "a < b <3"
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text("x" * 200_000).count("x") == 200_000
    assert text("") == "" and text("<a href='x>y") == ""


def test_pages(spark):
    rows = [(1, "u", "<title>t</title><p>a<p>b"), (2, None, None), (3, "v", ""), (None, "w", "x"), (1, "u", "<title>t</title><p>a<p>b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as title")
    out = html.extract(df).collect()
    assert sorted((r.page_id or -1, r.title, r.text, r.n_lines, r.n_chars) for r in out if r.title) == [(1, "t", "a\n\nb", 3, 4)] * 2
    assert sorted((r.page_id or -1, r.text, r.n_lines) for r in out if not r.title) == [(-1, "x", 1), (2, "", 0), (3, "", 0)]
    assert html.extract(df.where("page_id > 5")).count() == 0


def test_rules_for_descendants_children_attributes_and_screens():
    page = """<style>.m .s{display:none} nav > ul li{display:none} [hidden-by~=css]{display:none} a[href^="http://ads"]{visibility:hidden} @media screen{.banner{display:none}} @media print{.p{display:none}}
    @media screen and (max-width: 10px){.q{display:none}} div.x > .y{display:none} .z:hover .w{display:none} #one .s{display:block} .m
    .deep
    .er{display:none}</style>
    <div class=m><p>stay1</p><p class=s>gone1</p><div><i class=s>gone2</i></div></div><p class=s>stay2</p>
    <nav><ul><li>gone3<ul><li>gone4</li></ul></ul><div><ul><li>stay3</ul></div></nav><p hidden-by="a css b">gone5</p><p hidden-by=cssx>stay4</p>
    <a href="http://ads.x">gone6</a><a href="http://x">stay5</a><div class=banner>gone7</div><p class=p>stay6</p><p class=q>stay7</p>
    <div class=x><p class=y>gone8</p><section><p class=y>stay8</p></section></div><p class=z><b class=w>stay9</b></p>
    <div id=one><div class=m><p class=s>stay10</p></div></div><div class=m><div class=deep><div><p class=er>gone9</p></div></div></div><div class=deep><p class=er>stay11</p></div>"""
    shown = text(page)
    assert re.findall(r"stay\d+", shown) == [f"stay{i}" for i in range(1, 12)] and "gone" not in shown
