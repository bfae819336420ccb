import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, blob string, fp long, salt int, w string, p int, task int, row long, k1 long, held boolean"
EXTRA = (0.5, "x", 1, 2, "y", 3, 4, 5, 6, True)


def prose(rnd, n, stock=None):
    stock = stock or ["alpha", "Beta", "gamma,", "delta.", "épsilon", "zeta", "Eta", "theta\n", "iota", "kappa", "ça", "über", "x1"]
    return " ".join(rnd.choice(stock) for _ in range(n))


def texts():
    """Nulls, blanks, odd white space, long texts, exact and near copies, shared passages."""
    rnd = random.Random(20)
    long = prose(rnd, 6000, [f"w{i}" for i in range(4000)])
    shared = prose(rnd, 60, [f"s{i}" for i in range(300)])
    base = prose(rnd, 200, [f"b{i}" for i in range(900)])
    near = base.split(" ")
    near[100] = "changed"
    return [
        None, "", " ", "  \n\t ", "one", "one two", "ONE two three", "a  b\t\tc \r\n d ", "tab\x0bfeed\x0c end", "▁ mark ▁▁ x", "emoji \U0001f600 日本 mixed",
        "<|endoftext|> inside <s> text </s>", long, long, base, " ".join(near), base.upper(), shared, f"start {shared} stop", f"{prose(rnd, 50)} {shared} {prose(rnd, 40)}",
        " ".join(["same"] * 120), "same " * 36, prose(rnd, 300), prose(rnd, 34), prose(rnd, 35), "don't it's we'll 12 345 !!! ...", "q" * 3000, "tail space ", " lead",
    ]


def rows():
    out = [(i * 3 + 1, t, ("en", "fr", None)[i % 3], ("hot", "hot", "b", None)[i % 4], None if t is None else len(t), *EXTRA) for i, t in enumerate(texts())]
    out.append((None, "no id one two three", None, None, 19, *EXTRA))
    out.append(out[14])  # a repeated row
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
