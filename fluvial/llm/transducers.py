"""A conversation's cheapest repair as a shortest path through three composed machines.

- The input acceptor spells a conversation, a letter a row (LETTERS: initial of the role and fault).
- The edit transducer reads a row and writes a role's initial: Keep, Rerole, Delete; Insert writes without reading.
- The grammar acceptor takes (s?(ua)+)?.

Their composition is never built: `arcs` gives what leaves a state (place in the word, inserts since the last row, state of
the grammar), and the shortest path goes through the states in reverse topological order, so only states of one place are
held. Two inserts in a row lead anywhere that inserts can lead, hence more of them would only go round in a circle.

A weight is (cost, labels): costs are added, labels concatenated, the less weight is the better one. Concatenation in front
keeps that order, and paths of one segment never are beginnings of each other: each has a label for each row and ends with
that of the last. So a conversation may be cut into segments: each has a weight for each pair of states of the grammar.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Letters of rows: by fault, then by the initial of the role: s, u, a or another.
INITIALS = "suao"
LETTERS = {"sound": "suao", "truncated": "SUAO", "blank": "0123", "duplicate": "4567"}
#: Costs of edits, and what a truncated row that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The grammar: states before anything, behind s, behind u, behind a; what each takes; where it may end.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
STATES, FINAL = range(len(GRAMMAR)), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
MOST_INSERTS = 2

Weight = tuple[int, str]
Place = tuple[int, int, int]


def initial(letter: str) -> str:
    return INITIALS[next(x for x in LETTERS.values() if letter in x).index(letter)]


def arcs(word: str, place: Place) -> Iterator[tuple[str, str, int, Place]]:
    """(label, written initial, cost, next state) of what leaves a state of the composition."""
    i, inserts, g = place
    if inserts < MOST_INSERTS:
        for x in ROLES:
            if x in GRAMMAR[g]:
                yield "I", x, INSERT, (i, inserts + 1, GRAMMAR[g][x])
    if i == len(word):
        return
    letter = word[i]
    yield "D", "", DELETE, (i + 1, 0, g)
    if letter in LETTERS["blank"] or letter in LETTERS["duplicate"]:
        return
    more = TRUNCATED if letter in LETTERS["truncated"] else 0
    if initial(letter) in GRAMMAR[g]:
        yield "K", initial(letter), KEEP + more, (i + 1, 0, GRAMMAR[g][initial(letter)])
    for x in ROLES:
        if x in GRAMMAR[g]:
            yield "R", x, REROLE + more, (i + 1, 0, GRAMMAR[g][x])


def _relax(word: str, i: int, here: dict[Place, Weight], after: dict[Place, Weight]) -> None:
    """Give each state of place i the least weight of what leaves it, given the weights of the next place's states."""
    for inserts in range(MOST_INSERTS, -1, -1):
        for g in STATES:
            place = (i, inserts, g)
            for label, _, cost, to in arcs(word, place):
                rest = (here if to[0] == i else after).get(to)
                if rest is not None:
                    weight = (cost + rest[0], label + rest[1])
                    if place not in here or weight < here[place]:
                        here[place] = weight


def distances(word: str, ends: tuple[int, ...], behind: bool) -> list[Weight | None]:
    """For each state of the grammar, the least weight of the paths through a word to one of the states `ends`, with or without inserts behind the last row."""
    here: dict[Place, Weight] = {(len(word), k, g): (0, "") for g in ends for k in range(MOST_INSERTS + 1)}
    if behind:
        _relax(word, len(word), here, {})
    for i in reversed(range(len(word))):
        after, here = here, {}
        _relax(word, i, here, after)
    return [here.get((0, 0, g)) for g in STATES]


#: From each state of the grammar to the end of a conversation, behind its last row.
TAILS = distances("", FINAL, True)


def segment_weights(word: str) -> list[Weight | None]:
    """The least weight from state g to state h through a segment, at g * 4 + h; inserts behind its last row belong to what follows."""
    columns = [distances(word, (h,), False) for h in STATES]
    return [columns[h][g] for g in STATES for h in STATES]


def best_chain(segments: list[tuple[list[int | None], list[int | None]]]) -> tuple[int, list[tuple[int, int]]]:
    """Cost of a conversation, and the grammar's states before and behind each of its segments.

    segments: costs and ranks (by labels, equal ones equal) of segment_weights. Behind each segment, the best way to the
    end from each state has a cost and a rank among the four, so the labels themselves are never joined here.
    """
    ranks = sorted({w[1] for w in TAILS})
    rest = [(cost, ranks.index(labels)) for cost, labels in TAILS]
    ways: list[list[int]] = []
    for costs, order in reversed(segments):
        found: list[tuple[tuple[int, int, int], int] | None] = []
        for g in STATES:
            every = [((costs[g * 4 + h] + rest[h][0], order[g * 4 + h], rest[h][1]), h) for h in STATES if costs[g * 4 + h] is not None and rest[h] is not None]
            found.append(min(every, default=None))
        ranks = sorted({f[0][1:] for f in found if f})
        rest = [f and (f[0][0], ranks.index(f[0][1:])) for f in found]
        ways.append([f[1] if f else -1 for f in found])
    g, chain = 0, []
    for way in reversed(ways):
        chain.append((g, way[g]))
        g = way[g]
    return rest[0][0], chain


def edits(word: str, audit: str, g: int) -> list[str]:
    """For each row what to write: initials of inserted roles, then k (the row as it is), u or a (with that role) or d (nothing). Inserts behind the last row are one more."""
    out, now, i = [], "", 0
    for label in audit:
        x = next((x for x in ROLES if x in GRAMMAR[g]), "")  # no state takes both
        if label == "I":
            now += x
        else:
            out.append(now + {"D": "d", "K": "k", "R": x}[label])
            x = {"D": "", "K": initial(word[i]), "R": x}[label]
            now, i = "", i + 1
        g = GRAMMAR[g][x] if x else g
    return [*out, now] if now else out
