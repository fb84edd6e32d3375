"""Detected references against brute force on random lines, and odd lines."""

import random
import re

from ledgerline.operators import citations as ci

PIECES = ["see", "Section", "section 3.2", "§", " ", " ", " ", ", ", "Annex", "app. B", "[", "]", "[1]", "[x]", "[RFC 9]", "(#a)", "(./b)", "(http://c)", "[note]", "(Roe, 2001)", "(Roe et al., 1999)", "cf.", "Article L.1", "article", "per", "7", "Z-9", "é", "voir chapitre II"]


def brute(line):
    every = lambda p: list(re.finditer(p, line, re.ASCII))
    out = {("annex", m[0], m[2].upper(), f"{m[1]} {m[2]}", "high") for m in every(ci.ANNEX)}
    for m in every(ci.BRACKETS):
        behind = line[line.index(m[0]) + len(m[0]) :]
        if m[1] not in ("x", "X") and not behind.startswith("("):
            sure = re.fullmatch("[0-9]{1,3}", m[1].strip(" ")) or m[1].strip(" ").upper().startswith(ci.PUBLISHERS)
            out.add(("bibliographic", m[0], m[1], "", "high" if sure else "medium"))
    out |= {("bibliographic", m[0], f"{m[1]} {m[2]}", m[1], "high") for m in every(ci.AUTHOR_YEAR)}
    near = [(m[0], m[2], m[1], "high") for m in [*every(ci.CUE), *(m for m in every(ci.LINK) if m[2].startswith(("#", "./", "../")))]]
    for m in every(ci.PLACE):
        if not any(m[0] in raw or raw in m[0] for raw, *_ in near):
            near.append((m[0], m[2], m[1], "medium"))
    return out | {("cross_reference", *x) for x in near}


def test_references_equal_brute_force(spark):
    r = random.Random(3)
    lines = [(k // 7, k % 7, "".join(r.choice(PIECES) for _ in range(r.randint(0, 25)))) for k in range(800)]
    got = {}
    for x in ci.detected_references(spark.createDataFrame(lines, "document long, line_no long, text string")).collect():
        assert tuple(x[2:]) not in got.setdefault((x[0], x[1]), set())
        got[x[0], x[1]].add(tuple(x[2:]))
    assert sum(map(len, got.values())) > 1000
    for d, n, text in lines:
        assert got.get((d, n), set()) == brute(text), text


def test_odd_lines(spark):
    lines = [("a", 1, None), ("b", 1, ""), ("c", 1, "[1] " * 20_000 + "see 5 " * 20_000)]
    got = ci.detected_references(spark.createDataFrame(lines, "document string, line_no int, text string")).collect()
    assert sorted((x["document"], x["raw"]) for x in got) == [("c", "[1]"), ("c", "see 5")]
