"""Markov spans against a plain version, keys behind names, and long texts."""

import random
import re
import time

from ledgerline.llm.secret_scans import ALPHABET, LEAST, LONG, THRESHOLD, TOTAL, redact, train_markov, with_spans
from tests.conftest import DATA
from tests.llm.test_operators import secrets


def brute_spans(text, model):
    base = [tuple(map(int, x.split(":")[1:])) for x in secrets(text).split(",") if x]
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{%d,}" % LEAST, text):
        v = m[0]
        if len(v) < LONG and not re.search("[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]", v):
            continue
        k = [ALPHABET.index(c) for c in v]
        r = [round(model[x * len(ALPHABET) + y], 5) for x, y in zip(k, k[1:])]
        best, here, start = (0.0, 0, 1), 0.0, 0
        for i, x in enumerate(r, 1):
            here, start = (here + x, start) if here > 0 else (x, i - 1)
            if here > best[0]:
                best = (here, start, i + 1)
        total, a, z = best
        if total > TOTAL and total / (z - a - 1) > THRESHOLD:
            while a and v[a - 1].isalnum():
                a -= 1
            z += len(re.match("[A-Za-z0-9]*=*", v[z:])[0])
            a, z = m.start() + a, m.start() + z
            if not any(a < e and s < z for s, e in base):
                out.append((a, z))
    return out


def key(r, n):
    return "".join(r.choice(ALPHABET[:62]) for _ in range(n))


def test_markov_spans_are_those_of_a_plain_version(spark):
    model, r = train_markov(spark.read.parquet(f"{DATA}/documents.parquet")), random.Random(8)
    names = ["service/config/production", "api_client_v2", "camelCaseName7", "2024-01-15", "4111111111111111", "é日本", "the", "password=" + key(r, 12), "0" * 30, "f" * 24]
    rows = [(k, r.choice(" \n/=").join(r.choice([*names, key(r, r.randint(6, 40))]) for _ in range(r.randint(0, 90)))) for k in range(60)]
    got = {x["doc_id"]: x["secret_spans"] for x in with_spans(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    found = 0
    for k, text in rows:
        want = brute_spans(text, model)
        assert [(s["start"], s["end"]) for s in got[k] if s["kind"] == "markov"] == want, text
        found += len(want)
    assert found > 100


def test_keys_of_sixteen_characters_and_behind_paths(spark):
    model, r = train_markov(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), random.Random(2)
    keys = [key(r, 16) for _ in range(50)]
    rows = spark.createDataFrame([(k, f"see {x} or service/config/production/api={x}") for k, x in enumerate(keys)], "doc_id long, text string")
    left = [x for k, t in sorted(redact(rows, model).select("doc_id", "text").collect()) for x in [keys[k]] if x in t]
    assert len(left) <= 3


def test_long_texts_take_time_in_proportion(spark):
    model = [0.0] * len(ALPHABET) ** 2

    def took(n):
        text, began = " ".join(f"{k:024x}" for k in range(n)), time.time()
        row = redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
        assert row["text"] == " ".join(["<secret>"] * n)
        return time.time() - began

    took(10)
    assert took(80_000) < 8 * took(20_000) + 10
