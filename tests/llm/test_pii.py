"""What trusted contexts discover, how much of it, and how far back contexts are read."""

import random
import time

from ledgerline.llm.pii import Contexts, base_entities, contexts, shortened, with_spans

FILL = "so then they went on to see what had been said about it before the next one came along".split()


def found(spark, rows):
    return {r["row_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["rank"] == 4] for r in with_spans(spark.createDataFrame(rows, "row_id long, text string")).collect()}


def test_groups_and_dotted_words_behind_trusted_patterns(spark):
    mails = [(k, f"please write to mail: user{k}@host{k}.org soon and see www.example.org there") for k in range(20)]
    calls = [(100 + k, f"you may ring phone: +44 20 7946 {1000 + k} today or 12 or 13 days") for k in range(20)]
    asked = ["0171 555 2368", "123 45 6789", "DE89 3704 0044 0532 0130 00", "(0)711-23 99 4"]
    own = [(200 + k, f"you may ring phone: {x} today") for k, x in enumerate(asked)] + [(300, "please write to mail: jane.roe(at)host.org, today")]
    got = found(spark, [*mails, *calls, *own])
    for k, x in enumerate(asked):
        own_text = f"you may ring phone: {x} today"
        assert [own_text[a:z].strip("()") for a, z in got[200 + k]] == [x.strip("()")]
    assert got[300] == [(22, 42)]
    assert not any(got[k] for k in range(120) if k in got)


def test_recall_and_precision_of_discovery(spark):
    r = random.Random(4)
    rows, planted, clean = [], {}, []
    for k in range(600):
        words = [r.choice(FILL) for _ in range(30)]
        at = r.randint(3, 27)
        if k % 3 == 0:
            words[at] = f"contact e-mail: u{k}@mail{k % 7}.com"
        elif k % 3 == 1:
            x = f"user{k}[at]mail{k % 5}.com"
            words[at] = f"contact e-mail: {x}"
            text = " ".join(words)
            planted[k] = (text.index(x), text.index(x) + len(x))
        else:
            words[at] = r.choice(["chapter 12 of 40", "version 2.10.3rc1 came", "page 100234", "see notes.final.draft now"])
            clean.append(k)
        rows.append((k, " ".join(words)))
    got = found(spark, rows)
    assert sum(got[k] == [x] for k, x in planted.items()) == len(planted)
    assert not any(got[k] for k in clean)


def test_contexts_reach_back_as_far_as_needed():
    assert contexts("Call Me" + " " * 5000 + "7", 5007) == ("me", "call me")
    assert contexts("7", 0) == ("^", "^ ^") and contexts("a 7", 2) == ("a", "^ a")
    long = "W" * 700
    one, two = contexts(f"tel {long} 7", 705)
    assert one.startswith("#") and len(one) == 41 and two == f"tel {one}"


def brute_contexts(text, start):
    words = text[:start].translate({ord(c): " " for c in "\t\n\v\f\r"}).split(" ")
    one, two = ["^", "^", *(shortened(w) for w in words if w)][-1:-3:-1]
    return one, f"{two} {one}"


def test_contexts_of_all_places_equal_brute_force():
    r = random.Random(9)
    for _ in range(60):
        text = "".join(r.choice([" ", "\n", "\xa0", "Ab", "xΣ", "y" * 99, "Q" * 101, " " * 250, "ß" * 300, "\x1c"]) for _ in range(r.randint(0, 30)))
        every = Contexts(text)
        assert [every.before(k) for k in range(len(text) + 1)] == [brute_contexts(text, k) for k in range(len(text) + 1)]


def test_contexts_take_time_in_proportion_to_texts_without_spaces():
    def seconds(n):
        text = "write:a@b.org;" * n
        began, every = time.process_time(), Contexts(text)
        got = [every.before(a) for a, _, _ in base_entities(text)]
        assert len(set(got)) == n
        return time.process_time() - began

    seconds(1000)
    small, large = seconds(20_000), seconds(160_000)
    assert large < 16 * small and large < 30
