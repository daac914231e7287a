import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["h", "cell", "g", "block", "fp", "digest", "value", "_value", "label", "part", "tail", "rank", "c", "o0", "item", "version", "starts", "id"]


def prose(rng: random.Random, n: int) -> str:
    parts = "an be er in on re st th ou wh ti le".split()
    out = []
    for i in range(n):
        w = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        out.append(w + (".\n" if i % 9 == 8 else ""))
    return " ".join(out).replace("\n ", "\n")


def rows():
    """Plain texts, copies, near copies, shared passages, empty, null and very long texts, repeated rows and ids."""
    rng = random.Random(5)
    docs = [prose(rng, rng.randint(15, 200)) for _ in range(60)]
    passage = prose(rng, 90)
    docs += [docs[0]] * 12 + [d[:-6] + "edits." for d in docs[1:9]] + [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40) for _ in range(5)]
    docs += ["", None, "one", "one two", "Été naïve 😀 " * 30, "x" * 5000, "\n\n\n", "a\nb\nc\na\nb\nc\na\nb\nc", prose(rng, 30_000)]
    docs += [" ".join(f"{w}" for w in docs[2].split()[:60]).upper()]
    out = [(i, t, "en", f"s{i % 3}" if i % 4 else "s0", len(t or "")) for i, t in enumerate(docs)]
    out += [out[3], out[3], (None, docs[5], None, None, None), (None, None, None, None, None), (7, "another text under a known id", "en", "s1", 29), (500, None, None, "nobody", 0)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
