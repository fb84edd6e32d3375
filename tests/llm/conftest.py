import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, rank string, keep_ string, `a.b` int"
WORDS = "the of and to in is that for with as was on are by this be at from or an which you were all their there been has more when who will".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(WORDS) + r.choice("aeiou") * r.randint(0, 2) + str(r.randint(0, 9)) * (r.random() < 0.05) for _ in range(r.randint(3, 30))) for _ in range(max(1, n // 16)))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, near and exact copies, clashing column names."""
    base = [prose(120, k) for k in range(12)]
    near = base[0].replace("the", "thee", 1)
    rows = [(k, t) for k, t in enumerate(base)] + [(20, near), (21, base[1]), (22, base[1]), (3, base[3]), (3, base[3]), (5, base[6]), (None, base[2]), (None, None), (30, None), (31, ""), (32, " \n\n "), (33, "x" * 30_000), (34, "é" * 500 + " 日本語 🎉"), (35, "one two three"), (36, base[4] + "\n" + base[5]), (37, "\n".join([base[7]] * 3))]
    return spark.createDataFrame([(i, t, None if k % 5 == 4 else "en", None if k % 7 == 6 else "s", None if t is None else len(t), "x", "y", "z", 1) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def odd_dir(spark, odd_documents, tmp_path_factory):
    """The odd documents as a folder of tables, with conversations and vectors as odd."""
    d = str(tmp_path_factory.mktemp("odd"))
    odd_documents.write.parquet(f"{d}/documents.parquet")
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|end|>\n</s> \\ <|turn|>"), (2, 0, None, None), (2, None, "assistant", "late"), (None, 0, "user", "lost"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, 5, "user", "[INST] <s> [/INST]\\"), (4, 6, "assistant", "é🎉" * 2000)]
    spark.createDataFrame([(*x, "extra") for x in talk], "conv_id long, turn long, role string, text string, path string").write.parquet(f"{d}/conversations.parquet")
    nan, inf = float("nan"), float("inf")
    r = random.Random(3)
    vecs = [(k, [r.gauss(0, 0.2) for _ in range(8)]) for k in range(400)] + [(k, [0.5] * 8) for k in range(400, 480)] + [(500, None), (520, []), (540, [nan] * 8), (560, [inf] + [0.1] * 7), (580, [None] + [0.1] * 7), (600, [0.1, 0.2]), (601, [0.3, 0.2]), (None, [0.1] * 8), (20, [0.9] * 8)]
    spark.createDataFrame([(*x, 7, None if k % 9 == 4 else k % 4) for k, x in enumerate(vecs)], "vec_id long, embedding array<float>, score int, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "conversations", "embeddings"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d
