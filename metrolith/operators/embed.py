"""Vectors of texts by a model that each Python worker loads once.

No model comes with this package: `load` returns whatever encodes texts, such as an ONNX session with its tokenizer. It
is called in the worker, so what it loads is never shipped, and must be importable there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import wide_embedding

BATCH, TOKENS = 16, 512

#: Texts and the most tokens of each to (states: texts x tokens x dims, mask: texts x tokens).
Encode = Callable[[list[str], int], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class EmbeddingModel:
    key: str
    dims: int
    load: Callable[[], Encode]


MODELS: dict[str, EmbeddingModel] = {}
_LOADED: dict[str, Encode] = {}


def register_model(key: str, dims: int, load: Callable[[], Encode]) -> EmbeddingModel:
    MODELS[key] = EmbeddingModel(key, dims, load)
    return MODELS[key]


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the tokens' states, those of padding left out."""
    weight = mask[:, :, None].astype(np.float64)
    return (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)


def embed(fragments: DataFrame, model: str, id_col: str = "fragment_id", text_col: str = "code") -> DataFrame:
    """(fragment_id, vector): batches of 16 texts of at most 512 tokens, mean-pooled. A blank or null text is encoded as
    a space, so every row has its vector; rows keep their number. An unknown model raises ValueError."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model}; there are {sorted(MODELS)}")
    spec = MODELS[model]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _LOADED.get(spec.key)
        if encode is None:
            encode = _LOADED[spec.key] = spec.load()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = [t if t and t.strip() else " " for t in part.column(1).to_pylist()]
                vectors = pooled(*encode(texts, TOKENS))
                if len(vectors) != len(texts):
                    raise ValueError(f"{spec.key} gave {len(vectors)} vectors for {len(texts)} texts")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))], names=["fragment_id", "vector"])

    given = fragments.select(F.col(id_col).cast("string").alias("fragment_id"), F.col(text_col).cast("string").alias("t"))
    return given.mapInArrow(run, "fragment_id string, vector array<float>")


def embedding_frame(fragments: DataFrame, model: str, id_col: str = "fragment_id", text_col: str = "code") -> DataFrame:
    """(fragment_id, model, dim_0 ...): as wide as the model is declared, padded with zero or cut."""
    return wide_embedding(embed(fragments, model, id_col, text_col), "fragment_id", "vector", MODELS[model].dims, model)
