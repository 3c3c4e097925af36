"""Markdown blocks against a walk along the lines, on made-up texts and on all documents of a table."""

import random
import re

import pytest

from fluvial.plans import sections as plans
from fluvial.sources import markdown, sections

HEADING, ITEM, FENCE = re.compile(r"(#{1,6})\s+(.+?)\s*"), re.compile(r"\s*(?:[-+*]|\d+[.)])\s+"), ("```", "~~~")
RULE = re.compile(r"\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*")


def walk(text):
    """(section, path, kind, text, first line, last line) of each block."""
    lines, out, path, section, i = text.splitlines(), [], [], -1, 0
    if lines and lines[0].strip() == "---":
        end = next((k for k, x in enumerate(lines[1:51], 1) if x.strip() == "---"), None)
        i = 0 if end is None else end + 1

    def put(kind, body, a, b):
        nonlocal section
        section = max(section, 0)
        out.append((section, tuple(p for p in path if p), kind, body, a + 1, b))

    while i < len(lines):
        line, a = lines[i], i
        m = HEADING.fullmatch(line)
        if m:
            level = len(m[1])
            path[level - 1 :] = []
            path += [""] * (level - 1 - len(path)) + [m[2].strip()]
            section += 1
            i += 1
            put("heading", m[2].strip(), a, i)
        elif line.lstrip().startswith(FENCE):
            mark = line.lstrip()[:3]
            i += 1
            while i < len(lines) and not lines[i].lstrip().startswith(mark):
                i += 1
            body = "\n".join(lines[a + 1 : i])
            i = min(i + 1, len(lines))
            put("code", body, a, i)
        elif ITEM.match(line):
            while i < len(lines) and ITEM.match(lines[i]):
                i += 1
            put("list", "\n".join(ITEM.sub("", x, count=1).strip() for x in lines[a:i]), a, i)
        elif "|" in line and i + 1 < len(lines) and RULE.fullmatch(lines[i + 1]):
            i += 2
            while i < len(lines) and "|" in lines[i] and lines[i].strip():
                i += 1
            put("table", "\n".join([line, *lines[a + 2 : i]]), a, i)
        elif line.strip():
            i += 1
            while i < len(lines) and lines[i].strip() and not HEADING.fullmatch(lines[i]) and not ITEM.match(lines[i]) and not lines[i].lstrip().startswith(FENCE):
                i += 1
            put("paragraph", "\n".join(x.rstrip() for x in lines[a:i]), a, i)
        else:
            i += 1
    return out


def found(text):
    return [(b["section_ord"], tuple(b["heading_path"]), b["kind"], b["text"], b["line_start"], b["line_end"]) for b in markdown.blocks_of(text)]


def test_random_texts():
    rng = random.Random(6)
    parts = ["# A", "## B ", "### C", "###", "text", "  more  ", "", " ", "- x", "2) y", "* ", "```", "```py", "~~~", "a | b", "|---|---|", "--- |", "| c | d |", "---", "title: t", "####### no", "  # no"]
    for _ in range(4000):
        text = "\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert [b[2:] for b in found(text)] == [b[2:] for b in walk(text)], text
        assert [b[:2] for b in found(text)] == [b[:2] for b in walk(text)], text


def test_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = plans._marked_docs(spark, sf)
    got = {}
    for r in markdown.blocks(docs).collect():
        got.setdefault(r.doc_id, []).append((r.block_ord, r.section_ord, tuple(r.heading_path), r.kind, r.text, r.line_start, r.line_end))
    kinds = set()
    for r in docs.collect():
        want = walk(r.text)
        assert [b[1:] for b in sorted(got.get(r.doc_id, []))] == want
        kinds |= {b[2] for b in want}
    assert {"heading", "code", "paragraph"} <= kinds


@pytest.mark.parametrize("padded", [False, True])
def test_sections_of_random_headings(spark, padded):
    """Paths, fences and texts against a stack, whatever levels follow each other."""
    rng = random.Random(padded)
    parts = ["# A", "## B ##", "### C", "   #### D", "###### E #", "    # no", "#no", "text", "", "```", "````", "~~~~", "```x", "  ~~~"]
    rows = [(i, "\r\n".join(f"{rng.choice(parts)}" for _ in range(rng.randrange(1, 40)))) for i in range(150)] + [(None, "# T\nbody"), (500, None), (501, "")]
    want = []
    for doc, text in rows:
        stack, path, heading, level, body, fence, n = [], ["Untitled"], "Untitled", 0, [], "", 0
        for line in [*(text or "").splitlines(), None]:
            mark = line is not None and re.match(r"\s{0,3}(`{3,}|~{3,})", line)
            m = None if line is None or fence or mark else re.fullmatch(r"\s{0,3}(#{1,6})[ \t]+(.+?)(?:[ \t]+#+[ \t]*)?", line)
            if mark:
                fence = mark[1] if not fence else "" if mark[1].startswith(fence) else fence
            if line is None or m:
                if "\n".join(body).strip():
                    want.append((doc, n, heading, level, tuple(path), "\n".join(body).strip()))
                    n += 1
                if m:
                    level, heading, body = len(m[1]), m[2].strip(), []
                    stack = stack[: level - 1] + ([""] * (level - 1 - len(stack)) if padded else []) + [heading]
                    path = [p for p in stack if p]
            else:
                body.append(line)
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    got = [(r.doc_id, r.ordinal, r.heading, r.level, tuple(r.heading_path), r.text) for r in sections.markdown_sections(df, padded=padded).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 200


def test_texts_of_sections_are_not_shuffled_line_by_line(spark, monkeypatch):
    """What is stored of lines are headings and fences, whatever else a document has; white space of all kinds goes at a section's ends."""
    stored, keep = {}, sections.materialize

    def kept(df, name):
        out = keep(df, name)
        stored.setdefault(name, out.count())
        return out

    monkeypatch.setattr(sections, "materialize", kept)
    text = "\n".join(["a"] * 500 + ["# One"] + [" \xa0b "] * 300 + ["```", "# no", "```", "## Two", "　 \x1c", "### Three", " 　", "c\r\n\x85 "])
    got = [(r.ordinal, r.heading, r.level, r.heading_path, r.text) for r in sections.markdown_sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ordinal").collect()]
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(0, "Untitled", 0, ["Untitled"]), (1, "One", 1, ["One"]), (2, "Three", 3, ["One", "Two", "Three"])]
    assert got[0][4] == "\n".join(["a"] * 500) and got[1][4].startswith("b \n \xa0b") and got[1][4].endswith("```\n# no\n```") and got[2][4] == "c"
    assert max(n for name, n in stored.items()) < 10
