"""Where models plug in: plain Python callables run over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def embed(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 10) -> DataFrame:
    """Vectors for ``text``: network_id, person_id, vector. The model sees ``batch`` texts at a time."""

    def run(frames):
        for pdf in frames:
            vectors = []
            for i in range(0, len(pdf), batch):
                vectors += model(pdf["text"].iloc[i : i + batch].tolist())
            yield pd.DataFrame({"network_id": pdf["network_id"], "person_id": pdf["person_id"], "vector": vectors})

    return texts.select("network_id", "person_id", "text").mapInPandas(run, "network_id string, person_id long, vector array<float>")


def answer(requests: DataFrame, model: Callable[[str], str], keys: list[str], tries: int = 2) -> DataFrame:
    """JSON answers to ``payload``: keys, raw, error. A call that keeps failing leaves an error."""
    fields = [f for f in requests.schema.fields if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", raw string, error string"

    def call(payload: str) -> tuple[str | None, str | None]:
        problem = None
        for _ in range(max(1, tries)):
            try:
                return model(payload), None
            except Exception as e:  # the model is foreign code; its failure is a result
                problem = str(e)
        return None, problem

    def run(frames):
        for pdf in frames:
            out = [call(p) for p in pdf["payload"]]
            yield pdf[[f.name for f in fields]].assign(raw=[r for r, _ in out], error=[e for _, e in out])

    return requests.select(*[f.name for f in fields], "payload").mapInPandas(run, schema)


def score_pairs(pairs: DataFrame, model: Callable[[list[str], list[str]], list[float]], batch: int = 64) -> DataFrame:
    """Pair scores for (goal text, person text): goal_id, person_id, pair_score.

    pairs: goal_id, person_id, query, text. Rows without a text or query are not scored.
    """

    def run(frames):
        for pdf in frames:
            scores = []
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                scores += [float(s) for s in model(part["query"].tolist(), part["text"].tolist())]
            yield pd.DataFrame({"goal_id": pdf["goal_id"], "person_id": pdf["person_id"], "pair_score": scores})

    told = pairs.filter((F.trim("query") != "") & (F.trim("text") != ""))
    return told.select("goal_id", "person_id", "query", "text").mapInPandas(run, "goal_id long, person_id long, pair_score double")
