"""HTML to blocks: headings, paragraphs, list items, quotes, code, captions and tables; active content goes."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from fluvial.sources.parsed import block, parsed

# What is dropped with all it holds, and the kind of block of each tag.
DROPPED = ("script", "style", "iframe", "object", "embed", "svg")
KINDS = {"p": "paragraph", "li": "list", "blockquote": "quote", "pre": "code"} | {f"h{n}": "heading" for n in range(1, 7)}


class _Blocks(HTMLParser):
    """Collects (kind, text, first line, last line). Texts outside blocks are dropped; a block ends where the next begins.

    `tables` holds the open tables, innermost last, each as (first line, rows); a row is a list of cells, a cell a list
    of texts. Within a table only its rows and cells count.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, int, int]] = []
        self.skip, self.kind, self.start, self.texts = 0, "", 1, []
        self.tables: list[dict] = []

    def put(self, kind: str, text: str, start: int) -> None:
        if text:
            self.found.append((kind, text, start, self.getpos()[0]))

    def end_block(self) -> None:
        whole = "".join(self.texts)
        self.put(self.kind, whole.strip() if self.kind == "code" else " ".join(whole.split()), self.start) if self.kind else None
        self.kind, self.texts = "", []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in DROPPED
        if self.skip:
            return
        if tag == "table":
            if not self.tables:
                self.end_block()
            self.tables.append({"start": self.getpos()[0], "rows": [], "row": False, "cell": False})
        elif self.tables:
            t = self.tables[-1]
            if tag == "tr" or (tag in ("td", "th") and not t["row"]):
                t["rows"].append([])
                t["row"], t["cell"] = True, False
            if tag in ("td", "th"):
                t["rows"][-1].append([])
                t["cell"] = True
        elif tag in KINDS:
            self.end_block()
            self.kind, self.start = KINDS[tag], self.getpos()[0]
        elif tag == "img":
            self.put("caption", (dict(attrs).get("alt") or "").strip(), self.getpos()[0])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif self.tables:
            t = self.tables[-1]
            t["cell"] = t["cell"] and tag not in ("td", "th", "tr")
            t["row"] = t["row"] and tag != "tr"
            if tag == "table":
                lines = ["\t".join(" ".join("".join(c).split()) for c in row) for row in self.tables.pop()["rows"] if row]
                self.put("table", "\n".join(lines), t["start"])
        elif tag in KINDS:
            self.end_block()

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.tables:
            if self.tables[-1]["cell"]:
                self.tables[-1]["rows"][-1][-1].append(data)
        elif self.kind:
            self.texts.append(data)


def items(html: str) -> list[tuple[str, str, int, int]]:
    p = _Blocks()
    p.feed(html)
    p.close()
    p.end_block()
    return p.found


def blocks_of(html: str) -> Iterator[dict]:
    """One section, named by the first heading."""
    found = items(html)
    path = [text for kind, text, _, _ in found if kind == "heading"][:1]
    for at, (kind, text, start, end) in enumerate(found):
        yield block(0, path, at, kind, text, start, end)


def blocks(pages: DataFrame, column: str = "html", key: str = "page_id") -> DataFrame:
    return parsed(pages, blocks_of, column, key)
