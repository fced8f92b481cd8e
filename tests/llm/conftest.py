import random

import pytest
from pyspark.sql import functions as F

#: names that the operators use inside
CLASHING = ["node", "key", "k", "size", "class", "row", "h", "first", "n", "c", "s", "pivot", "maybe", "gone", "w", "doc", "start", "version", "slot"]


def rows_of_words(seed: int = 4):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = say(120).split()
    near = []
    for _ in range(40):      # copies with a few edits each: some pairs link, others don't
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        near.append(" ".join(w))
    line = say(30)
    texts = [None, "", " \n\t ", "one", "one two three four", "One two\tthree  four", "a " * 3000, say(30_000), *near, near[0], near[0],
             line + "\n" + say(12), say(9) + "\n" + line.upper() + "\n\n" + line[:-3], "é" * 500 + " \U0001F600 ÀÉ ſK", "x\n" * 50]
    rows = [(i, t, ["a", "b", None, "", "c"][i % 5]) for i, t in enumerate(texts)]
    return rows + [rows[8], rows[1], (None, near[3], "a"), (None, None, None)]


@pytest.fixture(scope="session")
def edge_rows():
    return rows_of_words()


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    df = spark.createDataFrame(edge_rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).cache()


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
