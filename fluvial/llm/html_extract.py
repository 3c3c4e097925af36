"""Main text of web pages by minimum cuts.

A page becomes a chain of text blocks. Each block has the cost of calling it content and that of calling it
boilerplate, a classifier's log-odds; these are the capacities of its terminals. Blocks that stand next to each other
pay for different labels, the more the fewer elements lie between them, and so do neighbours within one element and a
block and what stands before it in an element around. The labelling of least cost is a minimum cut, found by maximum flow, page by page. No block's own cost is above that of
its edges within an element, so the cut decides, whatever a block's tags and names say.

The classifier is logistic. It sees lengths, links, punctuation and tags, and, as two features among others, whether
tags and names around the block speak of content or of boilerplate. Its weights start from PRIOR and are fitted to
votes, of which no source decides alone: what the markup says, whether a text is on several pages, whether it is the
page's title, and whether it is prose or links. Every block is learnt twice, with and without what the markup says, so
pages without telling markup are judged as well. The fit takes the pages whose page_id hashes lowest: SAMPLE of them at
most, and each if its whole html still fits into SAMPLE_BYTES.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.staging import bounded_batches

SAMPLE, SAMPLE_BYTES = 2_000, 32 << 20
#: Bound of a block's log-odds; cost of a change between neighbours in the page, at no distance, and in an element.
JUDGED, NEXT, TOGETHER = 4.0, 1.0, 1.6
FEATURES = ("one", "length", "words", "linked", "linked_before", "linked_after", "marks", "word_length", "paragraph", "item", "heading", "towards", "away")
#: Log-odds of content before any page is seen, by feature.
PRIOR = np.array([0.0, 2.0, 2.0, -3.0, -0.3, -0.3, 3.0, 0.0, 0.3, -0.3, 1.0, 7.0, -7.0])
#: Elements that are no step between blocks unless they have a name.
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td th tr dd dt".split())
#: Elements between two blocks from which on their nearness in the tree costs nothing.
FAR = 8
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile("</title", re.I)

#: Elements whose content is no markup, up to their end tag; names of tags, and where they end.
_RAW = re.compile(r"<(script|style|noscript|template|iframe|textarea|title)\b", re.I)
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in "script style noscript template iframe textarea title".split()}
_NAME, _NAME_END, _SPECIAL = re.compile(r"</?[a-zA-Z]"), re.compile(r"[\s/>]"), re.compile("[>\"']")
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page. Without an end tag in the block around them, the next block ends them.
SKIPPED = frozenset("svg object select canvas audio video".split())
#: An opening block ends these if they are open directly around it.
ENDED = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
HINT = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
AWAY = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|promo|sponsor(?:ed)?|banner|cookies?|consent|notice|alert|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|sidebar|widget|related|recommended|share|sharing|social|comments?|replies|disqus|subscribe|newsletter|popup|modal|login|signup|search|pagination|pager|copyright|disclaimer|toolbar|complementary|contentinfo)(?:$|[-_\s])",
    re.I,
)
TOWARDS = re.compile(r"(?:^|[-_\s])(?:article|content|main|post|entry|story|body)(?:$|[-_\s])", re.I)
AWAY_TAGS, TOWARDS_TAGS = frozenset("nav footer aside form head menu dialog button".split()), frozenset("article main".split())
#: Tags on which names that speak of boilerplate say nothing; tags that hold for all inside; words that do; names that tell what a page has; words of a state, which may be the page's.
FRAME, LASTING_TAGS = frozenset("html body article main".split()), frozenset("nav aside footer menu dialog button".split())
COMMENTS = re.compile(r"(?:^|[-_])(?:comments?|replies|disqus)(?:$|[-_])", re.I)
FOREIGN = re.compile(r"(?:^|[-_])(?:ads?|adverts?|advertisement|advertising|promo|sponsor(?:ed)?|cookies?|consent|related|recommended)(?:$|[-_])", re.I)
WITHOUT = re.compile(r"(?:no|not|has|with|without)[-_]", re.I)
STATE = re.compile(r"(?:^|[-_])(?:is|show|hide|open|opened|closed?|enabled|disabled|fixed|sticky|visible|hidden|on|off)(?:$|[-_])", re.I)


class Block(NamedTuple):
    text: str
    linked: int
    tag: str
    parent: int
    said: int  # what the nearest telling element says: 1 content, -1 boilerplate, 0 nothing
    steps: int  # elements that end or begin between the block before and this one
    above: int = -1  # the last block before that stands in an element around this one's, and the elements between
    depth: int = 0


class Token(NamedTuple):
    text: str  # what is between tags, else empty
    slash: str
    tag: str  # in lower case; empty for text and for what is dropped
    attributes: str


def tokens_of(page: str) -> Iterator[Token]:
    """Text and tags of a page, in order. Comments, declarations and raw elements are dropped; a `<` that begins none of these is text.

    A tag ends at the first `>` outside of quotes. Where such an end, a name's end or a quote's is looked for, what was
    found is kept for later starts, so no part of a page is read over and over, whatever it holds.
    """
    size, last = len(page), page.rfind(">")
    ends: dict[int, int] = {}  # from a place outside of quotes to the tag's end, -1 if there is none
    name_from = name_to = -1
    quote = -1  # the first quote from a start in the name on, size if there is none

    def tag_end(at: int) -> int:
        seen = []
        while True:
            m = _SPECIAL.search(page, at)
            if m is None:
                end = -1
                break
            k = m.start()
            if k in ends:
                end = ends[k]
                break
            seen.append(k)
            if m[0] == ">":
                end = k
                break
            at = page.find(m[0], k + 1) + 1
            if not at:
                end = -1
                break
        ends.update(dict.fromkeys(seen, end))
        return end

    start = at = 0  # text that isn't given out yet begins at start
    while True:
        k = page.find("<", at)
        if k < 0:
            break
        end, token = -1, Token("", "", "", "")
        if page.startswith("<!--", k):
            end = page.find("-->", k + 4)
            end = size if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), k):
            end = page.find(">", k + 2)
            end = size if end < 0 else end + 1
        elif k < last:
            raw = _RAW.match(page, k)
            if raw:
                m = _RAW_END[raw[1].lower()].search(page, page.find(">", k) + 1)
                end = m.end() if m else size
            elif _NAME.match(page, k):
                first = k + 1 + (page[k + 1] == "/")
                if not name_from <= first < name_to:
                    name_from, name_to, quote = first, _NAME_END.search(page, first).start(), -1
                name_end, close = name_to, tag_end(name_to)
                if close < 0:  # a quote within the name may be an attribute's
                    if quote < first:
                        m = _SPECIAL.search(page, first, name_to)
                        quote = m.start() if m else size
                    if quote < size:
                        name_end, close = quote, tag_end(quote)
                if close >= 0:
                    end, token = close + 1, Token("", "/" if first > k + 1 else "", page[first:name_end].lower(), page[name_end:close])
        if end < 0:
            at = k + 1
            continue
        if start < k:
            yield Token(page[start:k], "", "", "")
        yield token
        start = at = end
    if start < size:
        yield Token(page[start:], "", "", "")


def title_of(page: str) -> str:
    """The text of the page's first title, empty without one."""
    m = _TITLE.search(page, 0, page.rfind(">") + 1)
    end = m and _TITLE_END.search(page, m.end())
    return page[m.end() : end.start()] if end else ""


def _skips(tokens: list[Token]) -> dict[int, int]:
    """Places of opening tags of SKIPPED elements, with that of the end tag, or of the next block's tag if there is none."""
    found: dict[int, int] = {}
    around: list[tuple[str, int]] = []
    number = Counter()  # of open elements by tag
    for i, (_, slash, tag, attributes) in enumerate(tokens):
        if tag not in SKIPPED and (tag not in BLOCK or tag == "hr"):
            continue
        if not slash:
            if tag != "svg" or not attributes.endswith("/"):
                around.append((tag, i))
                number[tag] += 1
        elif number[tag]:
            if tag in SKIPPED:
                at = next(k for k in range(len(around) - 1, -1, -1) if around[k][0] == tag)
                found[around[at][1]] = i
            while True:
                own, _ = around.pop()
                number[own] -= 1
                if own == tag:
                    break
    last = len(tokens)
    for i in range(len(tokens) - 1, -1, -1):
        _, slash, tag, attributes = tokens[i]
        if tag in SKIPPED and not slash and not (tag == "svg" and attributes.endswith("/")):
            found.setdefault(i, last - 1)
        elif tag in BLOCK:
            last = i
    return found


class Element(NamedTuple):
    tag: str
    names: str
    around: int


def _said(elements: list[Element]) -> list[int]:
    """What each element says of its text. The first is the page.

    A name that speaks of boilerplate says nothing on the page's frame: on html, body, article and main, on what holds
    an article or a main, and on what holds all that is named as content in a page without those. Comments hold for all
    inside, unless a main is; advertisements and related pages do, unless all of the page's articles are inside.
    """
    tagged = [e.tag in TOWARDS_TAGS for e in elements]
    mains = [e.tag == "main" for e in elements]
    named = [bool(e.names and TOWARDS.search(e.names)) and e.tag not in ("html", "body") for e in elements]
    held = [list(map(int, x)) for x in (tagged, mains, named)]
    for i in range(len(elements) - 1, 0, -1):
        for x in held:
            x[elements[i].around] += x[i]
    articles, main, content = held
    out = [(0, False, False)]  # what it says, whether that holds for all inside, whether it is inside an article
    for i, e in enumerate(elements[1:], 1):
        said, firm, inside = out[e.around]
        if e.tag in ("html", "body"):
            said, firm = 0, False
        words = [x for x in e.names.split() if AWAY.search(x) and not WITHOUT.match(x)] if e.names and e.tag not in FRAME else []
        away, lasting = bool(words), False
        if away:
            words = [x for x in words if not STATE.search(x)]
            if any(map(COMMENTS.search, words)):
                away, lasting = not main[i], not main[i]
            elif any(map(FOREIGN.search, words)):
                away = lasting = not articles[i] or articles[i] < articles[0]
            else:
                away = not articles[i] and bool(words or not named[i]) and (bool(articles[0]) or not content[i] - named[i] or content[i] < content[0])
                lasting = away and bool(words)
        if e.tag in AWAY_TAGS or (e.tag == "header" and not inside) or away:
            out.append((-1, firm or lasting or e.tag in LASTING_TAGS, inside))
        elif not firm and (e.tag in TOWARDS_TAGS or named[i] or (e.tag in ("html", "body") and TOWARDS.search(e.names))):
            out.append((1, False, True))
        else:
            out.append((said, firm, inside))
    return [x[0] for x in out]


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. Tags need not be closed; text outside of any block is a block, too."""
    out: list[tuple[str, int, str, int, int]] = []
    elements = [Element("", "", 0)]
    stack: list[tuple[str, int]] = [("", 0)]  # tag, place in elements
    parts: list[str] = []
    linked, in_link, skip = 0, False, -1

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tag, element = stack[-1]
                parent = stack[-2][1] if len(stack) > 1 and tag in LEAVES else element
                out.append((text, min(linked, len(text)), tag, parent, element))
            parts.clear()
        linked = 0

    tokens = list(tokens_of(page))
    skips = _skips(tokens)
    inside = Counter({"": 1})  # open elements by tag

    def push(tag: str, names: str) -> None:
        elements.append(Element(tag, names, stack[-1][1]))
        stack.append((tag, len(elements) - 1))
        inside[tag] += 1

    for i, (text, slash, tag, attributes) in enumerate(tokens):
        if i <= skip:
            continue
        if not tag:
            if text:
                parts.append(text)
                if in_link:
                    linked += len(text)
            continue
        if tag not in BLOCK:
            if tag == "a":
                in_link = not slash
            elif tag == "br":
                parts.append(" ")
            elif tag == "button" and not slash:
                push(tag, "")
            elif tag == "button" and stack[-1][0] == "button":
                close()
                inside[stack.pop()[0]] -= 1
            else:
                skip = skips.get(i, skip)
            continue
        close()
        in_link = False
        if slash:
            while inside[tag]:
                own = stack.pop()[0]
                inside[own] -= 1
                if own == tag:
                    break
            continue
        if tag == "hr":
            continue
        ended = ENDED.get(tag, ("p",))
        while stack[-1][0] in ended:
            inside[stack.pop()[0]] -= 1
        push(tag, " ".join(filter(None, (x for h in HINT.findall(attributes) for x in h))) if attributes else "")
    close()
    said, steps = _said(elements), _steps(elements, [x[4] for x in out])
    above = _above(elements, [x[3] for x in out])
    return [Block(text, n, tag, parent, said[element], d, *a) for (text, n, tag, parent, element), d, a in zip(out, steps, above, strict=True)]


def _step(e: Element) -> bool:
    return not (e.tag in LEAVES and not e.names)


def _above(elements: list[Element], parents: list[int]) -> list[tuple[int, int]]:
    """For each block, the last one before it whose parent is around its own, at less than FAR elements, and how many they are; -1 if none."""
    last: dict[int, int] = {}
    out = []
    for i, own in enumerate(parents):
        at, n = own, 0
        while at and n < FAR:
            n += _step(elements[at])
            at = elements[at].around
            if at in last:
                break
        out.append((last[at], n) if at in last and at != own and n < FAR else (-1, 0))
        last[own] = i
    return out


def _steps(elements: list[Element], places: list[int]) -> list[int]:
    """For each place in the tree, the elements between it and the place before, LEAVES without a name not counted."""
    depth = [0] * len(elements)
    for i in range(1, len(elements)):
        depth[i] = depth[elements[i].around] + 1
    out, before = [], 0
    for place in places:
        x, y, n = before, place, 0
        while x != y:
            if depth[x] < depth[y]:
                x, y = y, x
            n += _step(elements[x])
            x = elements[x].around
        out.append(n)
        before = place
    return out


def described(page: list[Block]) -> np.ndarray:
    """The FEATURES of each block."""
    linked = [b.linked / len(b.text) for b in page]
    out = np.zeros((len(page), len(FEATURES)))
    for i, b in enumerate(page):
        n, words = len(b.text), b.text.count(" ") + 1
        around = linked[i - 1] if i else 0.5, linked[i + 1] if i + 1 < len(page) else 0.5
        marks = min(1.0, sum(map(b.text.count, ".!?,;。，！？")) / words)
        tags = b.tag == "p", b.tag in ("li", "td", "th"), b.tag[:1] == "h" and b.tag[1:].isdigit()
        # beyond 300 characters and 50 words a text is prose, and more of it says no more
        out[i] = (1, (math.log1p(min(n, 300)) - 4) / 3, (math.log1p(min(words, 50)) - 2.5) / 3, linked[i], *around, min(marks, 0.3), min(n / words, 30) / 10 - 0.5, *tags, b.said > 0, b.said < 0)
    return out


def votes(page: list[Block], title: str) -> np.ndarray:
    """What speaks for each block as content (above 0) or boilerplate, but for its text being on other pages."""
    out = np.zeros(len(page))
    for i, b in enumerate(page):
        share, words = b.linked / len(b.text), b.text.count(" ") + 1
        out[i] = b.said + (words >= 25 and share < 0.2) - (share > 0.6) + (bool(title) and b.text == title)
    return out


OBSERVED = "page long, text long, vote double, seen array<double>"


def fit(pages: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, steps: int = 300, trust: float = 0.02) -> np.ndarray:
    """Weights of the classifier: PRIOR, moved by the votes on blocks of the sample. Without both kinds of blocks: PRIOR."""
    rows = pages.filter("page_id is not null and html <> ''").select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64("html").alias("page"), F.octet_length("html").alias("n"), "html")
    taken, room = [], most_bytes
    for r in rows.select("page_id", "page", "n").orderBy(F.xxhash64("page_id"), "page_id", "page").limit(sample).distinct().orderBy(F.xxhash64("page_id"), "page_id", "page").collect():  # `sample` rows, without html
        if r.n <= room:
            taken.append((r.page_id, r.page))
            room -= r.n
    if not taken:
        return PRIOR.copy()
    few = pages.sparkSession.createDataFrame(taken, "page_id long, page long")
    drawn = rows.join(F.broadcast(few), ["page_id", "page"]).select("page", "html").dropDuplicates(["page"])  # copies of a page count once

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch["page"].to_pylist(), batch["html"], strict=True):
                page = blocks(text.as_py())
                title = " ".join(html.unescape(title_of(text.as_py())).split())
                hashes = [int.from_bytes(hashlib.blake2b(b.text.encode(errors="replace"), digest_size=8).digest(), "little", signed=True) for b in page]
                yield pa.record_batch([pa.array([key] * len(page), pa.int64()), pa.array(hashes, pa.int64()), pa.array(votes(page, title)), pa.array(described(page).tolist(), pa.list_(pa.float64()))], ["page", "text", "vote", "seen"])

    found = drawn.mapInArrow(observe, OBSERVED).toArrow()  # some hundred bytes a block of the sample
    order = np.lexsort((found["vote"].to_numpy(), found["text"].to_numpy(), found["page"].to_numpy()))  # the fit is the same however rows come
    texts, key = found["text"].to_numpy()[order], found["page"].to_numpy()[order]
    pairs = np.unique(np.stack([texts, key]), axis=1)[0] if len(order) else texts
    several = {t for t, n in Counter(pairs.tolist()).items() if n > 1}
    vote = found["vote"].to_numpy()[order] - np.array([t in several for t in texts.tolist()], float)
    x = found["seen"].combine_chunks().flatten().to_numpy().reshape(len(order), len(FEATURES))[order] if len(order) else np.zeros((0, len(FEATURES)))
    x, y = x[vote != 0], vote[vote != 0] > 0
    if y.all() or not y.any():
        return PRIOR.copy()
    blind = x.copy()
    blind[:, -2:] = 0  # without what the markup says
    x, y = np.concatenate([x, blind]), np.concatenate([y, y]).astype(float)
    even = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += 1.0 * (((y - p) * even) @ x / len(y) - trust * (w - PRIOR))
    return w


def minimum_cut(gain: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """True for blocks on the content side of a minimum cut.

    gain: what calling a block content saves against boilerplate, the capacity from the source if above 0, else
    (its amount) to the sink. edges: (block, block, cost of different labels). Flow is pushed along shortest ways.
    """
    n = len(gain)
    ends: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def add(a: int, b: int, there: float, back: float) -> None:
        ends[a].append(len(to))
        ends[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    source, sink = n, n + 1
    for i, g in enumerate(gain.tolist()):
        add(source, i, g, 0.0) if g > 0 else add(i, sink, -g, 0.0)
    for a, b, cost in edges:
        add(a, b, cost, cost)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in ends[x]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array([level[i] >= 0 for i in range(n)], bool)
        turn = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                first = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                x = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[x] < len(ends[x]):
                e = ends[x][turn[x]]
                if room[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    break
                turn[x] += 1
            else:
                if x == source:
                    break
                e = path.pop()
                x = to[e ^ 1]
                turn[x] += 1
                continue
            path.append(e)
            x = to[e]


def costs(page: list[Block], weights: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """What calling each block content saves, and the edges (block, block, cost of different labels)."""
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(page):
        if i:
            edges.append((i - 1, i, NEXT / (1 + b.steps)))
        if b.parent in last:
            edges.append((last[b.parent], i, TOGETHER / (1 + b.steps) if last[b.parent] == i - 1 else TOGETHER))
        last[b.parent] = i
        if b.above >= 0:
            edges.append((b.above, i, TOGETHER / (1 + b.depth)))
    return np.clip(described(page) @ weights, -JUDGED, JUDGED), edges


def labels(page: list[Block], weights: np.ndarray) -> np.ndarray:
    """True for the blocks of the main text."""
    return minimum_cut(*costs(page, weights)) if page else np.zeros(0, bool)


def main_text(page: str, weights: np.ndarray = PRIOR) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, labels(found, weights), strict=True) if keep)


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A null or empty html, and one without main text, gives empty text. A page of any length is read whole. A null page_id
    or url stays null. Repeated rows give repeated results, an empty table an empty one; other columns, whatever their
    names, are ignored.
    """
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages) if weights is None else weights)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py() or "", shared.value) for x in batch["html"]]
            yield pa.record_batch([batch["page_id"], batch["url"], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
