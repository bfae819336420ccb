import numpy as np

from quillpack.functions.text import MASK_ID
from quillpack.operators.generation import decode_block, generate, generated


def counting(context, block):
    """Says its position in the whole text; surest at the right."""
    at = len(context) + np.arange(len(block))
    return at, np.linspace(0.5, 1.0, len(block))


def test_blocks():
    b, calls = decode_block(counting, np.zeros(3, int), 6, 3)
    assert b.tolist() == [3, 4, 5, 6, 7, 8] and calls == 3
    b, calls = decode_block(counting, np.zeros(0, int), 6, 6, least=0.85)
    assert b.tolist() == [0, 1, 2, 3, 4, 5] and calls == 5
    b, calls = decode_block(counting, np.zeros(0, int), 6, 1, least=2.0)
    assert calls == 2 and (b == MASK_ID).sum() == 4
    assert generate(counting, np.zeros(2, int), 4, 4, 5, end=9).tolist() == [2, 3, 4, 5, 6, 7, 8, 9]
    assert len(generate(counting, np.zeros(2, int), 4, 4, 2, end=99)) == 8


def test_generated(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, [])], "id long, prompt array<int>")
    got = {r["id"]: (r["tokens"], r["valid"], r["total"]) for r in generated(df, lambda: counting, 4, 4, 3, end=6, least=None).collect()}
    assert got == {1: ([2, 3, 4, 5, 6], 5, 8), 2: ([0, 1, 2, 3, 4, 5, 6], 7, 8)}
