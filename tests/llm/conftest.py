import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bin string, value string, n string, text_sha256 string"
SYLLABLES = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls in every column, empty and long texts, copies, near copies, shared
    passages and lines, ties, repeated rows, and columns whose names clash."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    lines = "\n".join(prose(rng, 8) for _ in range(5))
    base = prose(rng, 200).split(" ")
    texts: list[str | None] = [None, "", "   \n\t ", "one", "one two three four", "One Two three four", "ÀÉ ünï", "12 34 !!", "To " * 400]
    texts += [prose(rng, rng.randint(5, 120)) for _ in range(25)]
    texts += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 10) for _ in range(6)]
    texts += [prose(rng, 12) + "\n" + lines + "\n" + prose(rng, 5) for _ in range(5)]
    for k in range(40):  # a large group of near copies
        words = list(base)
        for _ in range(k % 5):
            words[rng.randrange(len(words))] = prose(rng, 1)
        texts.append(" ".join(words))
    texts += [texts[12], texts[13].upper(), texts[14], texts[14]]
    texts.append(prose(rng, 30_000))
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None if t is None else len(t), "x", "y", "z", "w") for i, t in enumerate(texts)]
    rng.shuffle(out)
    return [*out, out[3], out[3], (None, "null id " + texts[20], None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
