"""Governed phrases against a plain search, in one block and in many."""

import random

import pytest

from ledgerline.operators.lexicon import phrase_key, term_uses
from ledgerline.sources.shared import ensure_checkpoints


def plain(text, lexicon):
    words, i, out = phrase_key(text).split(), 0, []
    longest = max(len(k.split()) for k in lexicon)
    while i < len(words):
        n = next((n for n in range(longest, 0, -1) if i + n <= len(words) and " ".join(words[i : i + n]) in lexicon), 0)
        if n:
            out.append((" ".join(words[i : i + n]), i, n))
        i += max(n, 1)
    return out


@pytest.mark.parametrize("block", [8_000_000, 40])
def test_longest_first(spark, block):
    ensure_checkpoints(spark)
    r = random.Random(block)
    vocabulary = ["a", "b", "c", "Dé", "e1"]
    terms = {" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 4))) for _ in range(25)}
    texts = [(str(i), "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "-"]) for _ in range(r.randint(0, 60)))) for i in range(40)] + [("none", None), ("empty", "")]
    lexicon = spark.createDataFrame([(t, t, "preferred") for t in terms], "term string, canonical string, status string")
    docs = spark.createDataFrame(texts, "source string, text string")
    found = {}
    for x in sorted(term_uses(docs, lexicon, block).collect()):
        text = dict(texts)[x["source"]]
        assert phrase_key(text[x["start"] : x["end"]]) == x["phrase"]
        found.setdefault(x["source"], []).append((x["phrase"], x["word_no"], x["words"]))
    keys = {phrase_key(t) for t in terms}
    assert {s: sorted(f, key=lambda z: z[1]) for s, f in found.items()} == {s: w for s, t in texts if (w := plain(t or "", keys))}


def test_precedence(spark):
    ensure_checkpoints(spark)
    rows = [("Old Term", "new", "synonym"), ("old term", "new", "deprecated"), ("old TERM", "newer", "deprecated"), ("alias", "z", "synonym"), ("alias", "alias", "preferred"), ("...", "x", "preferred"), ("odd", "x", "unknown")]
    docs = spark.createDataFrame([("1", "The old-term, alias odd.")], "source string, text string")
    got = term_uses(docs, spark.createDataFrame(rows, "term string, canonical string, status string")).collect()
    assert sorted((x["phrase"], x["canonical"], x["status"]) for x in got) == [("alias", "alias", "preferred"), ("old term", "new", "synonym")]
    assert term_uses(docs, spark.createDataFrame([], "term string, canonical string, status string")).count() == 0
