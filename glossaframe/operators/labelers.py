"""Models as plug-ins. Each is a transformation that adds one column to a frame.

* a labeler adds a JSON answer `{"value": ...}` for a payload column and a `Request`, which holds the question,
* a classifier adds a label for a text column,
* an encoder adds an `array<float>` for a text column.

The built-in ones are deterministic. The rule labeler and the hashing encoder are Catalyst expressions and
Spark ML transformers: their rows never leave the JVM. Python models get Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import matches, text_or_empty, words


def with_batches(df: DataFrame, source: str, out: str, out_type: T.DataType,
                 make: Callable[[], Callable[[list], Iterable]], batch_size: int | None = None) -> DataFrame:
    """Add `out = model(source)` batch by batch. `make` builds the model once per task, on the worker."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            values = frame[source].tolist()
            step = batch_size or max(1, len(values))
            results: list = []
            for start in range(0, len(values), step):
                results.extend(model(values[start:start + step]))
            yield frame.assign(**{out: pd.Series(results, index=frame.index, dtype="object")})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(out, out_type)]))


# ---- labelers -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Request:
    """What is asked about each payload. Everything here is also part of a judgement's key.

    `labels` are the allowed values; of a parent/child taxonomy they are `(parent, child)` pairs.
    `definitions` has one text per label, empty where none was given.
    """

    prompt: str = ""
    output_type: str = "string"
    labels: tuple = ()
    definitions: tuple[str, ...] = ()
    goal: str = ""
    polarity: str = ""

    def text(self) -> str:
        """The request in words, for models that read text; a payload goes below it."""
        said = [self.prompt]
        if self.polarity:
            said.append(f"Polarity: {self.polarity}.")
        for label, definition in zip(self.labels, self.definitions or [""] * len(self.labels)):
            name = label if isinstance(label, str) else " / ".join(label)
            said.append(f"- {name}: {definition}" if definition else f"- {name}")
        shape = '{"parent": ..., "child": ...}' if self.output_type == "pair" else self.output_type
        said.append(f'Answer with JSON {{"value": {shape}}} and nothing else.')
        return "\n".join(said)


class RuleLabeler:
    """The first rule whose pattern is found in the lower-cased payload gives the value.

    `rules` is a list of `(regex, value)`; values are anything that can be written as JSON.
    """

    expression = True

    def __init__(self, name: str, rules: Sequence[tuple[str, object]], default: object = None):
        self.name, self.rules, self.default = name, list(rules), default

    @staticmethod
    def _answer(value) -> Column:
        return F.lit(json.dumps({"value": value}, ensure_ascii=False))

    def label(self, df: DataFrame, payload: str, out: str, request: Request) -> DataFrame:
        text = F.lower(F.col(payload))
        answer = None
        for pattern, value in self.rules:
            test = matches(text, pattern)
            answer = F.when(test, self._answer(value)) if answer is None else answer.when(test, self._answer(value))
        fallback = self._answer(self.default)
        return df.withColumn(out, fallback if answer is None else answer.otherwise(fallback))


class ColumnLabeler:
    """A labeler given as a Spark expression from the payload column to the JSON answer."""

    expression = True

    def __init__(self, name: str, answer: Callable[[Column], Column]):
        self.name, self.answer = name, answer

    def label(self, df: DataFrame, payload: str, out: str, request: Request) -> DataFrame:
        return df.withColumn(out, self.answer(F.col(payload)))


class PromptedLabeler:
    """A labeler given as a Spark expression from the payload column and the request to the JSON answer."""

    expression = True

    def __init__(self, name: str, answer: Callable[[Column, Request], Column]):
        self.name, self.answer = name, answer

    def label(self, df: DataFrame, payload: str, out: str, request: Request) -> DataFrame:
        return df.withColumn(out, self.answer(F.col(payload), request))


class PythonLabeler:
    """Calls `make()` once per task and then the returned function once per payload.

    For model services: up to `concurrency` payloads are in flight per task, and a call that raises leaves
    that row without an answer. With `prompted` the function is called with the payload and the request's fields as a
    dict, whose `text` has them in words; without, what is asked is fixed by the caller.
    """

    expression = False

    def __init__(self, name: str, make: Callable[[], Callable[..., str]], concurrency: int = 8,
                 num_partitions: int | None = None, prompted: bool = False):
        self.name, self.make, self.concurrency, self.num_partitions = name, make, concurrency, num_partitions
        self.prompted = prompted

    def label(self, df: DataFrame, payload: str, out: str, request: Request) -> DataFrame:
        make, concurrency = self.make, self.concurrency
        asked = ({**asdict(request), "text": request.text()},) if self.prompted else ()

        def build():
            ask = make()

            def safe(text):
                try:
                    return ask(text, *asked)
                except Exception:  # one failed row must not fail the job
                    return None

            def batch(texts):
                if concurrency <= 1 or len(texts) <= 1:
                    return [safe(t) for t in texts]
                with ThreadPoolExecutor(concurrency) as pool:
                    return list(pool.map(safe, texts))

            return batch

        if self.num_partitions:
            df = df.repartition(self.num_partitions)
        return with_batches(df, payload, out, T.StringType(), build)


# ---- classifiers ----------------------------------------------------------------------------------------


class BatchClassifier:
    """A Python model from a batch of texts to a batch of labels, loaded once per task."""

    def __init__(self, name: str, make: Callable[[], Callable[[list[str]], Sequence[str]]]):
        self.name, self.make = name, make

    def classify(self, df: DataFrame, text: str, out: str, batch_size: int) -> DataFrame:
        return with_batches(df, text, out, T.StringType(), self.make, batch_size)


class PipelineClassifier:
    """A fitted Spark ML pipeline that ends in an indexed prediction; `labels[i]` names class `i`."""

    def __init__(self, name: str, model, labels: Sequence[str], input_column: str = "text",
                 prediction_column: str = "prediction"):
        self.name, self.model, self.labels = name, model, list(labels)
        self.input_column, self.prediction_column = input_column, prediction_column

    def classify(self, df: DataFrame, text: str, out: str, batch_size: int) -> DataFrame:
        scored = self.model.transform(df.withColumn(self.input_column, F.col(text)))
        names = F.array(*[F.lit(n) for n in self.labels])
        return scored.select(
            *[F.col(f"`{c}`") for c in df.columns],
            F.get(names, F.col(self.prediction_column).cast("int")).alias(out),
        )


# ---- encoders -------------------------------------------------------------------------------------------


class HashingEncoder:
    """Unit-length hashed word counts, by Spark ML."""

    def __init__(self, dim: int = 256):
        self.dim, self.name = dim, f"hashing-{dim}"

    def encode(self, df: DataFrame, text: str, out: str) -> DataFrame:
        counted = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=self.dim).transform(
            df.withColumn("__words", words(text_or_empty(F.col(text))))
        )
        unit = Normalizer(inputCol="__tf", outputCol="__unit", p=2.0).transform(counted)
        return unit.withColumn(out, vector_to_array("__unit", "float32")).drop("__words", "__tf", "__unit")


class WeightedEncoder:
    """Unit-length word counts, each weighted by ln((rows + 1) / (rows with the word + 1)), over a fitted vocabulary.

    The name, which is part of the content key, holds a hash of the fit: vectors of different fits are never mixed.
    Rows without a word of the vocabulary, and rows of which each such word is in all rows, get zero vectors.
    """

    def __init__(self, frequencies: Sequence[tuple[str, int]], n_rows: int):
        if not frequencies:
            raise ValueError("no word to weight")
        self.terms = [term for term, _ in frequencies]
        self.weights = [math.log((n_rows + 1) / (n + 1)) for _, n in frequencies]
        self.frequencies, self.n_rows, self.dim = list(frequencies), n_rows, len(self.terms)
        fit = json.dumps([n_rows, [list(f) for f in frequencies]], ensure_ascii=False)
        self.name = f"weighted-{self.dim}-{hashlib.sha256(fit.encode()).hexdigest()[:16]}"

    @classmethod
    def fit(cls, df: DataFrame, text: str, size: int = 4096, min_rows: int = 1) -> WeightedEncoder:
        """The `size` words that are in most rows, at least `min_rows` (ties: by word), with their numbers of rows,
        counted over all rows. Only these come to the driver."""
        distinct = F.array_distinct(words(text_or_empty(F.col(text))))
        counts = df.select(F.explode(distinct).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        top = counts.where(F.col("n") >= min_rows).orderBy(F.desc("n"), "term").limit(size).collect()
        return cls([(r["term"], r["n"]) for r in top], df.count())

    def encode(self, df: DataFrame, text: str, out: str) -> DataFrame:
        counted = CountVectorizerModel.from_vocabulary(self.terms, inputCol="__words", outputCol="__tf").transform(
            df.withColumn("__words", words(text_or_empty(F.col(text))))
        )
        weighted = ElementwiseProduct(scalingVec=Vectors.dense(self.weights), inputCol="__tf", outputCol="__weighted").transform(counted)
        unit = Normalizer(inputCol="__weighted", outputCol="__unit", p=2.0).transform(weighted)
        return unit.withColumn(out, vector_to_array("__unit", "float32")).drop("__words", "__tf", "__weighted", "__unit")


class BatchEncoder:
    """A Python model from a batch of texts to a batch of vectors, loaded once per task."""

    def __init__(self, name: str, make: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]],
                 batch_size: int | None = None):
        self.name, self.make, self.batch_size = name, make, batch_size

    def encode(self, df: DataFrame, text: str, out: str) -> DataFrame:
        make = self.make

        def build():
            model = make()
            return lambda texts: [[float(x) for x in v] for v in model(["" if t is None else t for t in texts])]

        return with_batches(df, text, out, T.ArrayType(T.FloatType()), build, self.batch_size)
