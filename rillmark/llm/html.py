"""Layout-aware text of HTML pages.

A tree builder reads tags leniently: void elements have no children, end tags are implied where the
standard lets authors leave them out (paragraphs, list items, table parts, options, head), unmatched
end tags are dropped, what cannot stand in a table moves before it. Attributes and simple rules of
style sheets say what is not shown. The renderer walks the tree without those parts and lays the text
out in lines: blocks on lines of their own, paragraphs and headings apart, list items with their marks
and indents, table cells padded to the width of their columns. Neither uses recursion, so elements may
be nested as deeply as a page likes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rillmark.llm._base import small_batches

#: Fixed values of the HTML standard: elements by how they are parsed and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link datalist iframe object audio video canvas noembed noframes rp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre section summary table textarea ul caption tr xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr xmp".split())
PREFORMATTED = frozenset("pre listing xmp textarea".split())
HEAD_PARTS = frozenset("base link meta script style template title noscript".split())
#: Where only parts of a table may stand, and those parts.
TABLE_CONTEXT = frozenset("table tbody thead tfoot tr".split())
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
#: A start tag of the key ends open elements of the first set, looked for up to one of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
#: A block's start tag does not end a paragraph beyond these.
P_SCOPE = frozenset("td th table caption button object html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_KNOWN = re.compile(r"hidden|style|start|span|open", re.I)
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
#: What one element is asked for: a tag, ids, classes and attributes.
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\[\]]*\])*)")
_ASKED = re.compile(r"""\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([\w-]+))\s*)?\]""")
_SPACE = re.compile(r"[ \t\r\n\f]+")


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by lower-case name; of several of one name the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape("".join(values)))
    return out


class Node:
    """An element. `hidden`: not displayed; `unseen`: its own visibility (None: its parent's)."""

    __slots__ = ("tag", "children", "hidden", "unseen", "start", "spans", "closed", "raw", "lines")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.children, self.start, self.raw = tag, [], 1, raw
        self.hidden, self.unseen, self.spans, self.lines = tag in HIDDEN or tag == "dialog", None, (1, 1), None
        self.closed = tag == "details"
        if raw and _KNOWN.search(raw):
            a = attributes_of(raw)
            if "open" in a:
                self.closed = False
                self.hidden = self.hidden and tag != "dialog"
            if "hidden" in a:
                self.hidden = True
            if "style" in a:
                self.style(a["style"])
            if re.fullmatch(r"-?\d{1,9}", a.get("start", "")):
                self.start = int(a["start"])
            if tag in ("td", "th"):
                read = lambda k, most: min(max(int(a[k]), 1), most) if re.fullmatch(r"\d{1,9}", a.get(k, "")) else 1
                self.spans = read("colspan", 1000), read("rowspan", 65534)

    def style(self, text: str) -> None:
        if found := _DISPLAY.findall(text):
            self.hidden = found[-1].lower() == "none"
        if found := _VISIBILITY.findall(text):
            self.unseen = found[-1].lower() in ("hidden", "collapse")


class Stack:
    """Open elements, and for each tag where it stands among them."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """Ends the elements from place k on."""
        while len(self.nodes) > k:
            self.at[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags, -1 without."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


def parse(html: str) -> Node:
    """The tree of a page, under a root node."""
    root = Node("html")
    stack = Stack(root)
    sheets: list[str] = []

    def close(tags, stop) -> bool:
        k = stack.last(tags)
        if k > max(0, stack.last(stop)):
            stack.cut(k)
            return True
        return False

    def place(child) -> None:
        """Into the open element, or before the open table if it cannot stand in one."""
        here = stack.nodes[-1]
        stray = child.strip() != "" if isinstance(child, str) else child.tag not in TABLE_PARTS and child.tag not in ("script", "style", "template")
        if here.tag in TABLE_CONTEXT and stray and (k := stack.last(("table",))) > 0:
            above = stack.nodes[k - 1].children
            above.insert(len(above) - 1, child)  # the open table is the last child
        else:
            here.children.append(child)

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[:2] not in ("<!", "<?"):
                if stack.nodes[-1].tag == "head" and text.strip():
                    stack.cut(len(stack.nodes) - 1)
                place(unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and stack.last(("p",)) < 0:
                place(Node("p"))
            k = stack.last((tag,))
            fence = -1 if tag in TABLE_CONTEXT else stack.last(("td", "th", "table"))
            if k > 0 and k >= fence:
                stack.cut(k)
            continue
        if tag == "html" or (tag == "body" and stack.last(("body",)) >= 0) or (tag == "form" and stack.nodes[-1].tag in TABLE_CONTEXT):
            continue
        if stack.nodes[-1].tag == "head" and tag not in HEAD_PARTS:
            stack.cut(len(stack.nodes) - 1)
        if tag in BLOCK:
            close({"p"}, P_SCOPE)
        if tag in TABLE_PARTS:
            k = stack.last(TABLE_CONTEXT)
            if k > max(0, stack.last(("td", "th", "caption"))):
                stack.cut(k + 1)  # what moved before the table ends
        if tag in ENDS:
            while close(*ENDS[tag]):  # a row ends its cell, then the row before it
                pass
        node = Node(tag, m[3])
        place(node)
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            inside = html[at : found.start() if found else end]
            if tag in ("textarea", "title"):
                node.children.append(unescape(inside).removeprefix("\n"))
            elif tag == "xmp":
                node.children.append(inside)
            elif tag == "style":
                sheets.append(inside)
            at = found.end() if found else end
        elif tag not in VOID and not m[3].rstrip().endswith("/") or tag in BLOCK - {"hr"}:
            stack.push(node)
    if sheets:
        _apply(root, "\n".join(sheets))
    return root


def _compound(text: str) -> tuple | None:
    """Tag, ids, classes and attributes (name, operator, value) that a selector without blanks asks for;
    None where it has what is not known here, as pseudo-classes."""
    m = _SELECTOR.fullmatch(text)
    if not m or not text:
        return None
    asked = [(x[1].lower(), x[2] or "", x[3] or x[4] or x[5] or "") for x in _ASKED.finditer(m[2])]
    if len(asked) != m[2].count("["):
        return None
    marks = re.findall(r"([.#])([\w-]+)", _ASKED.sub("", m[2]))
    return (m[1] or "*").lower(), [v for k, v in marks if k == "#"], {v for k, v in marks if k == "."}, asked


def _has(a: dict[str, str], name: str, operator: str, value: str) -> bool:
    if name not in a:
        return False
    own = a[name]
    tests = {"": True, "=": own == value, "~=": value in own.split(), "^=": bool(value) and own.startswith(value), "$=": bool(value) and own.endswith(value), "*=": bool(value) and value in own, "|=": own == value or own.startswith(value + "-")}
    return tests[operator]


def _matches(parts: list[tuple], link: tuple | None) -> bool:
    """Whether an element, given as (node, attributes, classes, parent's link), fits a selector's parts, each
    with whether it must be the parent of the next; ancestors are tried from the nearest on."""
    if link is None:
        return False
    node, a, own, above = link
    (tag, ids, classes, asked), *_ = parts[-1]
    if tag not in ("*", node.tag) or not own.issuperset(classes) or any(a.get("id") != i for i in ids) or not all(_has(a, *x) for x in asked):
        return False
    if len(parts) == 1:
        return True
    if parts[-2][1]:
        return _matches(parts[:-1], above)
    while above is not None:
        if _matches(parts[:-1], above):
            return True
        above = above[3]
    return False


def _apply(root: Node, css: str) -> None:
    """Display and visibility rules by tag, id, class and attribute, of elements and of their descendants and
    children. Ids weigh more than classes and attributes, those more than tags, later rules more than earlier
    ones, the style attribute most. Rules for all media and for screens count; selectors with
    pseudo-classes or siblings, and rules under other conditions, are left out."""
    css = re.sub(r"/\*.*?(?:\*/|\Z)", "", css, flags=re.S)
    css = re.sub(r"@media\s+(?:only\s+)?(?:screen|all)\s*\{((?:[^{}]*\{[^{}]*\})*[^{}]*)\}", r"\1", css, flags=re.I)
    css = re.sub(r"@[^{};]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}|@[^{};]*;", "", css)  # rules for some media only
    rules = []
    for selectors, body in _RULE.findall(css):
        if not (_DISPLAY.search(body) or _VISIBILITY.search(body)):
            continue
        for one in selectors.split(","):
            words = re.sub(r"\s*>\s*", " > ", one.strip()).split()
            parts = [_compound(w) for w in words if w != ">"]
            child = [words[i + 1 : i + 2] == [">"] for i, w in enumerate(words) if w != ">"]
            if parts and None not in parts and words[0] != ">" and words[-1] != ">":
                weight = (sum(len(p[1]) for p in parts), sum(len(p[2]) + len(p[3]) for p in parts), sum(p[0] != "*" for p in parts))
                rules.append((weight, len(rules), list(zip(parts, child, strict=True)), body))
    if not rules:
        return
    rules.sort(key=lambda r: r[:2])
    todo: list[tuple[Node, tuple | None]] = [(root, None)]
    while todo:
        node, above = todo.pop()
        a = attributes_of(node.raw) if node.raw else {}
        link = (node, a, set(a.get("class", "").split()), above)
        todo += [(c, link) for c in node.children if not isinstance(c, str)]
        touched = False
        for _, _, parts, body in rules:
            if _matches(parts, link) and not (node.tag in HIDDEN and parts[-1][0][0] == "*"):
                node.style(body)
                touched = True
        if touched and "style" in a:
            node.style(a["style"])


class Page:
    """Lines of text in the making."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.space = "", False, False

    def text(self, text: str, pre: bool, indent: str) -> None:
        if pre:
            first, *rest = text.split("\n")
            self.line += first if self.line else indent + first
            for x in rest:
                self.end(True)
                self.line = indent + x
            return
        flat = _SPACE.sub(" ", text)
        if not flat or flat == " ":
            self.space = self.space or bool(flat)
            return
        lead = (self.space or flat[0] == " ") and self.line.strip() != "" and not self.line.endswith(" ")
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.line = indent
        self.line += (" " if lead else "") + flat.strip(" ")
        self.space = flat[-1] == " "

    def end(self, always: bool = False) -> None:
        if self.line.strip() or always:
            if self.line.strip():
                if self.gap and self.lines:
                    self.lines.append("")
                self.gap = False
            self.lines.append(self.line.rstrip())
        self.line, self.space = "", False

    def apart(self) -> None:
        self.end()
        self.gap = True


def _rows(table: Node) -> tuple[list[Node], list[list[tuple[int, int, list[str]]]]]:
    """Captions, and rows of (first column, columns, lines) of visible cells: heads first, feet last.
    Cells that reach down keep their columns in the rows below."""
    captions: list[Node] = []
    parts: tuple[list[Node], list[Node], list[Node]] = ([], [], [])
    todo = [(c, 1) for c in reversed(table.children)]
    while todo:
        node, part = todo.pop()
        if isinstance(node, str) or node.hidden:
            continue
        if node.tag == "caption":
            captions.append(node)
        elif node.tag == "tr":
            parts[part].append(node)
        elif node.tag in ("thead", "tbody", "tfoot"):
            inner = {"thead": 0, "tbody": 1, "tfoot": 2}[node.tag]
            todo += [(c, inner) for c in reversed(node.children)]
        elif node.tag in ("td", "th"):  # a cell without its row
            row = Node("tr")
            row.children = [node]
            parts[part].append(row)
    rows = []
    taken: dict[int, int] = {}  # rows for which a column is still taken
    for tr in (*parts[0], *parts[1], *parts[2]):
        column, row, after = 0, [], {k: n - 1 for k, n in taken.items() if n > 1}
        for cell in tr.children:
            if isinstance(cell, str) or cell.hidden or cell.tag not in ("td", "th"):
                continue
            while taken.get(column):
                column += 1
            across, down = cell.spans
            if down > 1:
                after.update((k, down - 1) for k in range(column, column + across))
            unseen = bool(table.unseen if tr.unseen is None else tr.unseen)
            row.append((column, across, [x for x in lay_out(cell, unseen).split("\n") if x.strip()]))
            column += across
        taken = after
        if any(lines for _, _, lines in row):
            rows.append(row)
    return captions, rows


def _table(node: Node) -> list[str]:
    """The lines of a table whose inner tables have theirs."""
    captions, rows = _rows(node)
    widths: dict[int, int] = {}
    for r in rows:
        for column, across, lines in r:
            if across == 1:
                widths[column] = max(widths.get(column, 0), *map(len, lines), 0)
    for r in rows:  # what spans columns widens its last one
        for column, across, lines in r:
            if across > 1 and lines:
                across = min(across, max([*widths, column]) - column + 1)
                have = sum(widths.get(k, 0) for k in range(column, column + across)) + 3 * (across - 1)
                last = column + across - 1
                widths[last] = widths.get(last, 0) + max(0, max(map(len, lines)) - have)
    out = [x for c in captions for x in lay_out(c, bool(node.unseen)).split("\n") if x.strip()]
    end = max(widths, default=-1) + 1
    for r in rows:
        for k in range(max(len(lines) for _, _, lines in r)):
            cells, column = [], 0
            for first, across, lines in r:
                cells += [" " * widths.get(x, 0) for x in range(column, min(first, end))]
                across = max(1, min(across, end - first))
                wide = sum(widths.get(x, 0) for x in range(first, first + across)) + 3 * (across - 1)
                cells.append((lines[k] if k < len(lines) else "").ljust(wide))
                column = first + across
            out.append(" | ".join(cells).rstrip())
    return out


def render(root: Node) -> str:
    """The text of a tree: tables get their lines first, inner ones before outer ones."""
    tables, todo = [], [(root, False)]
    while todo:
        node, unseen = todo.pop()
        unseen = unseen if node.unseen is None else node.unseen
        if node.tag in TABLE_CONTEXT:
            node.unseen = unseen
        if node.tag == "table":
            tables.append(node)
        todo += [(c, unseen) for c in node.children if not isinstance(c, str) and not c.hidden]
    for t in reversed(tables):
        t.lines = _table(t)
    return lay_out(root)


def lay_out(root: Node, unseen: bool = False) -> str:
    page = Page()
    # what is left to do, last first: a node with its setting, a text, or what follows a block
    todo: list[tuple] = [("node", root, False, "", None, unseen)]
    while todo:
        what, node, pre, indent, mark, unseen = todo.pop()
        if what == "after":
            page.apart() if node in SPACED else page.end()
            continue
        if isinstance(node, str):
            if unseen:
                continue
            if mark and mark[0] and node.strip():
                if page.gap and page.lines and not page.line:
                    page.lines.append("")
                page.gap = False
                page.line, mark[0] = indent[: -len(mark[0])] + mark[0] if len(mark[0]) <= len(indent) else mark[0], ""
            page.text(node, pre, indent)
            continue
        if node.hidden:
            continue
        tag = node.tag
        unseen = unseen if node.unseen is None else node.unseen
        if tag == "br":
            page.end(True)
            continue
        if tag == "table" and node.lines is not None:
            page.apart()
            for x in node.lines:
                if page.gap and page.lines:
                    page.lines.append("")
                page.gap = False
                page.lines.append((indent + x).rstrip())
            page.apart()
            continue
        nested_list = tag in ("ul", "ol") and bool(indent)
        if tag in BLOCK:
            page.apart() if tag in SPACED and not nested_list else page.end()
            todo.append(("after", "li" if nested_list else tag, pre, indent, None, unseen))
        inner = indent
        marks = mark
        if tag in ("ul", "ol", "menu", "dir"):
            number = node.start
            items = []
            for c in node.children:
                if not isinstance(c, str) and c.tag == "li" and not c.hidden:
                    label = f"{number}. " if tag == "ol" else "- "
                    number += 1
                    items.append(("node", c, pre, indent + " " * len(label), [label], unseen))
                elif not isinstance(c, str) or c.strip():
                    items.append(("node", c, pre, indent, None, unseen))
            todo += reversed(items)
            continue
        if tag in ("blockquote", "dd"):
            inner = indent + "  "
        if tag == "hr":
            continue
        keep = pre or tag in PREFORMATTED
        children = [c for c in node.children if not isinstance(c, str) and c.tag == "summary"] if node.closed else node.children
        todo += [("node", c, keep, inner, marks, unseen) for c in reversed(children)]
    page.end()
    lines = page.lines
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines))


def title_of(root: Node) -> str | None:
    todo = [root]
    while todo:
        n = todo.pop()
        if not isinstance(n, str):
            if n.tag == "title":
                return " ".join("".join(c for c in n.children if isinstance(c, str)).split())
            todo += reversed(n.children)
    return None


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, title (null if the page has none), text, n_lines, n_chars of each page.

    Null and empty pages have empty text, no title and no lines. Repeated rows are alike; an empty
    table gives no rows; other columns are ignored. Broken markup never fails: what cannot be a tag
    is text.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(id_col, url_col, html_col)
    schema = T.StructType([rows.schema[id_col], rows.schema[url_col], T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_chars", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, texts = [], []
            for html in batch.column(2).to_pylist():
                root = parse(html or "")
                titles.append(title_of(root))
                texts.append(render(root))
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(work, schema)
