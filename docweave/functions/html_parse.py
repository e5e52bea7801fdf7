"""Per-page HTML event collector (stdlib ``html.parser``).

This is the only Python that touches HTML. It turns one page into flat,
ordered arrays that every HTML operator then consumes with Spark
expressions; it makes no decisions about cleaning, filtering or output
format.

Tree rules (a simplified HTML5 reading, stated because the parse library the
reference used is not available):
* text inside ``script``, ``style``, ``template`` and comments is not text;
* an open ``<p>`` is closed by the next ``<p>`` or block start tag, by the end
  tag of any element that was opened before it, or by ``</p>``;
* an open ``<li>`` is closed by the next ``<li>`` of the same list;
* an open ``<td>/<th>`` is closed by the next cell, and a ``<tr>`` by the next
  row, of the same table;
* end tags with no open element are ignored; void elements never open.
"""

from __future__ import annotations

from html.parser import HTMLParser

# Fixed tag sets (HTML5 parsing rules).
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
HIDDEN = frozenset(["script", "style", "template"])
CLOSES_P = frozenset(
    (
        "address article aside blockquote center details dialog dir div dl "
        "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
        "hr li main menu nav ol p pre section summary table ul"
    ).split()
)

PAGE_SCHEMA = (
    "nodes array<struct<text:string,p:int>>, "
    "paras array<array<string>>, "
    "lists array<struct<kind:string,items:array<array<string>>>>, "
    "stray_items array<array<string>>, "
    "tables array<array<array<string>>>, "
    "links array<string>"
)


class _Collector(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.hidden = 0
        self.nodes: list[tuple[str, int]] = []
        self.paras: list[list[str]] = []
        self.open_p = -1
        self.p_depth = -1
        self.items: list[list[str]] = []
        self.open_items: list[int] = []  # li indexes still open (nested)
        self.lists: list[tuple[str, list[int]]] = []
        self.open_lists: list[int] = []
        self.tables: list[list[list[list[str]]]] = []
        self.open_tables: list[int] = []
        self.open_cells: list[tuple[int, int, int]] = []
        self.links: list[str] = []

    # -- helpers -------------------------------------------------------
    def _close_p(self) -> None:
        self.open_p = -1
        self.p_depth = -1

    def _pop_to(self, tag: str) -> None:
        idx = len(self.stack) - 1 - self.stack[::-1].index(tag)
        for closed in self.stack[idx:][::-1]:
            self._closed(closed)
        del self.stack[idx:]
        if self.open_p >= 0 and len(self.stack) <= self.p_depth:
            self._close_p()

    def _closed(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden -= 1
        elif tag == "li" and self.open_items:
            self.open_items.pop()
        elif tag in ("ul", "ol") and self.open_lists:
            self.open_lists.pop()
        elif tag in ("td", "th") and self.open_cells:
            self.open_cells.pop()
        elif tag == "table" and self.open_tables:
            self.open_tables.pop()
        elif tag == "p":
            self._close_p()

    # -- events --------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        if tag == "a":
            for k, v in attrs:
                if k == "href":
                    self.links.append(v or "")
                    break
        if tag in CLOSES_P and self.open_p >= 0:
            if "p" in self.stack:
                self._pop_to("p")
            self._close_p()
        if tag == "li" and "li" in self.stack:
            # a new item closes the previous item of the same list
            last_li = len(self.stack) - 1 - self.stack[::-1].index("li")
            last_list = max(
                (i for i, t in enumerate(self.stack) if t in ("ul", "ol")), default=-1
            )
            if last_li > last_list:
                self._pop_to("li")
        if tag in ("td", "th", "tr") and self.open_tables:
            # a new cell/row closes the previous one of the same table
            last_table = len(self.stack) - 1 - self.stack[::-1].index("table")
            closers = ("td", "th") if tag != "tr" else ("td", "th", "tr")
            for t in closers:
                if t in self.stack[last_table:]:
                    self._pop_to(t)
        if tag in VOID:
            return
        self.stack.append(tag)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "p":
            self.paras.append([])
            self.open_p = len(self.paras) - 1
            self.p_depth = len(self.stack) - 1
        elif tag == "li":
            self.items.append([])
            self.open_items.append(len(self.items) - 1)
            for li_list in self.open_lists:
                self.lists[li_list][1].append(len(self.items) - 1)
        elif tag in ("ul", "ol"):
            self.lists.append((tag, []))
            self.open_lists.append(len(self.lists) - 1)
        elif tag == "table":
            self.tables.append([])
            self.open_tables.append(len(self.tables) - 1)
        elif tag == "tr" and self.open_tables:
            self.tables[self.open_tables[-1]].append([])
        elif tag in ("td", "th") and self.open_tables:
            t = self.open_tables[-1]
            if not self.tables[t]:
                self.tables[t].append([])
            self.tables[t][-1].append([])
            self.open_cells.append((t, len(self.tables[t]) - 1, len(self.tables[t][-1]) - 1))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1] == tag:
            self._pop_to(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            self._pop_to(tag)

    def handle_data(self, data):
        if self.hidden or not data:
            return
        self.nodes.append((data, self.open_p))
        if self.open_p >= 0:
            self.paras[self.open_p].append(data)
        for i in self.open_items:
            self.items[i].append(data)
        for t, r, c in self.open_cells:
            self.tables[t][r][c].append(data)


def parse_page(html: str | None) -> dict:
    """One page -> dict matching ``PAGE_SCHEMA``."""
    c = _Collector()
    if html:
        try:
            c.feed(html)
            c.close()
        except Exception:  # malformed markup: keep what was collected
            pass
    return {
        "nodes": [{"text": t, "p": p} for t, p in c.nodes],
        "paras": c.paras,
        "lists": [
            {"kind": kind, "items": [c.items[i] for i in idx]} for kind, idx in c.lists
        ],
        "stray_items": c.items,
        # a cell's text is its strings stripped and concatenated
        "tables": [
            [["".join(s.strip() for s in cell) for cell in row] for row in table]
            for table in c.tables
        ],
        "links": c.links,
    }
