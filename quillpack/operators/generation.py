"""Block-wise decoding of masked sequences with a model that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import MASK_ID

#: model(context, block) -> (token, confidence) of every position of the block
Model = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def schedule(masked: int, steps: int) -> list[int]:
    return [masked // steps + (i < masked % steps) for i in range(steps)]


def decode_block(model: Model, context: np.ndarray, length: int, steps: int, least: float | None = None) -> tuple[np.ndarray, int]:
    """(block, model calls). By steps: each reveals its share of the surest positions. By threshold: all that are sure enough, else
    the surest one, for at most twice the steps; what is still masked then stays masked."""
    block, calls = np.full(length, MASK_ID), 0
    shares = schedule(length, steps)
    for i in range(steps if least is None else 2 * steps):
        masked = block == MASK_ID
        if not masked.any():
            break
        tokens, sure = model(context, block)
        calls += 1
        order = np.lexsort((np.arange(length), -np.where(masked, sure, -np.inf)))
        if least is None:
            take = order[: shares[i]]
        else:
            take = np.flatnonzero(masked & (sure >= least))
            if not len(take):
                take = order[:1]
        block[take] = tokens[take]
    return block, calls


def generate(model: Model, prompt: np.ndarray, block: int, steps: int, most: int, end: int, least: float | None = None) -> np.ndarray:
    """Blocks behind a prompt up to and including the first end mark, or `most` blocks."""
    made: list[np.ndarray] = []
    for _ in range(most):
        b, _ = decode_block(model, np.concatenate([prompt, *made]), block, steps, least)
        stop = np.flatnonzero(b == end)
        if len(stop):
            made.append(b[: stop[0] + 1])
            break
        made.append(b)
    return np.concatenate(made) if made else np.zeros(0, int)


def generated(requests: DataFrame, make: Callable[[], Model], block: int = 32, steps: int = 32, most: int = 32, end: int = 126081, least: float | None = 0.95) -> DataFrame:
    """id, tokens, valid, total for requests (id, prompt: array<int>); the model is made once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            out = [generate(model, np.asarray(p, int), block, steps, most, end, least) for p in batch["prompt"]]
            yield pd.DataFrame({"id": batch["id"], "tokens": [x.tolist() for x in out], "valid": list(map(len, out)), "total": [-(-len(x) // block) * block for x in out]})

    return requests.select("id", "prompt").mapInPandas(run, "id long, tokens array<int>, valid long, total long")
