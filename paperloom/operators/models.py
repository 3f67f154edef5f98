"""Models as plug-ins: each is loaded once per Python worker and fed batches of texts (embedder, zero-shot scorer, reranker)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.sources.files import scratch_folder

#: A loader gives a model: a function of one or more lists of equal length to a sequence of results, one for each place.
Loader = Callable[[], Callable[..., Sequence[Any]]]
#: Rows that a model sees at once, and models that a worker keeps.
BATCH, KEPT = 64, 3

_LOADED: dict[str, Callable[..., Sequence[Any]]] = {}


def loaded(key: str, load: Loader) -> Callable[..., Sequence[Any]]:
    """This worker's model of a key; the model that was loaded first goes when there are more than KEPT."""
    if key not in _LOADED:
        while len(_LOADED) >= KEPT:
            _LOADED.pop(next(iter(_LOADED)))
        _LOADED[key] = load()
    return _LOADED[key]


def model_column(load: Loader, kind: str, batch: int = BATCH) -> Callable[..., Column]:
    """A function of columns that asks a model, `kind` being the type of its results.

    Rows with a null among their columns are not shown to the model and give
    null. A model that gives another number of results than it was asked for is
    an error.
    """
    key = uuid.uuid4().hex

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for given in batches:
            columns = given if isinstance(given, tuple) else (given,)  # a single column comes bare
            known = np.flatnonzero(~np.logical_or.reduce([c.isna().to_numpy() for c in columns]))
            out: list[Any] = [None] * len(columns[0])
            for at in np.split(known, range(batch, len(known), batch)):
                if not len(at):
                    continue
                made = loaded(key, load)(*(c.iloc[at].tolist() for c in columns))
                if len(made) != len(at):
                    raise ValueError(f"a model gave {len(made)} results for {len(at)} rows")
                for row, value in zip(at.tolist(), made, strict=True):
                    out[row] = value
            yield pd.Series(out, dtype=object)

    # pandas_udf reads the kind of function from the annotations, which are text in this module
    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def unit_vectors(load: Loader) -> Loader:
    """A model of vectors with its results brought to length 1, as doubles; a vector of zeros stays."""

    def make():
        model = load()

        def embed(texts: list[str]) -> list[np.ndarray]:
            vectors = [np.asarray(v, np.float64) for v in model(texts)]
            return [v / (np.sqrt(v @ v) or 1.0) for v in vectors]

        return embed

    return make


def embedded(rows: DataFrame, load: Loader, text_col: str = "content", vector_col: str = "embedding", batch: int = BATCH) -> DataFrame:
    """SC25: `rows` with the vector of length 1 that a model gives for each text; a null text has none.

    A column of the vector's name is an error; repeated rows fare alike, and an
    empty table stays empty.
    """
    if vector_col in rows.columns:
        raise ValueError(f"there is a column named {vector_col}")
    return rows.withColumn(vector_col, model_column(unit_vectors(load), "array<double>", batch)(F.col(text_col)))


def embedded_once(rows: DataFrame, load: Loader, text_col: str = "content", vector_col: str = "embedding", batch: int = BATCH) -> DataFrame:
    """`embedded`, written to the shared folder and read again, so a model sees each text once, however often and by whatever filters the rows are read."""
    path = scratch_folder(rows.sparkSession)
    embedded(rows, load, text_col, vector_col, batch).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def zero_shot_scorer(load: Loader, labels: Sequence[str], batch: int = BATCH) -> Callable[[Column], Column]:
    """A column function: (label, top, second) of a text, by a model that gives a score for each of `labels`, in their order; of equal scores the first label counts."""
    scores = model_column(load, "array<double>", batch)
    names = F.array(*map(F.lit, labels))

    def decide(c: Column) -> Column:
        # best first; a struct sorts by its fields, so equal scores by their labels' places
        ranked = F.array_sort(F.transform(scores(c), lambda s, k: F.struct((-s).alias("s"), k.alias("k"))))
        return F.transform(
            F.array(ranked), lambda r: F.when(r.isNotNull(), F.struct(F.get(names, F.get(r, F.lit(0)).k).alias("label"), (-F.get(r, F.lit(0)).s).alias("top"), (-F.get(r, F.lit(1)).s).alias("second")))
        )[0]

    return decide


def classified(questions: DataFrame, load: Loader, labels: Sequence[str], text_col: str = "question", intent_col: str = "intent", batch: int = BATCH) -> DataFrame:
    """SC16/SC17: `questions` with their intent: by the cheap rules where these decide, else by a model's scores of the labels.

    The model sees only questions that the rules leave open. A null question is
    a fact lookup, as an empty one.
    """
    fast = X.fast_intent(F.col(text_col))
    best = zero_shot_scorer(load, labels, batch)(F.when(fast.isNull(), F.col(text_col)))
    rows = questions.withColumn("_best", best)
    by_model = X.zero_shot_intent(F.col("_best.label"), F.col("_best.top"), F.col("_best.second"))
    return rows.withColumn(intent_col, F.coalesce(fast, by_model)).drop("_best")


def model_scorer(load: Loader, batch: int = BATCH) -> Callable[[Column, Column], Column]:
    """TK04: a scorer for `retrieval.candidates` and `retrieval.rerank`: a model of (questions, contents) that gives a number for each pair; a null text gets 0."""
    score = model_column(load, "double", batch)
    return lambda question, content: F.coalesce(score(question, content), F.lit(0.0))
