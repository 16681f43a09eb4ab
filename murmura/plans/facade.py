"""One object for a whole study: representations, indexes, retrieval, answers, evaluation; every step is a function from DataFrames to a DataFrame.

What calls a model is plugged in by name: a representation turns a table into text, an
encoder gives texts their vectors, a strategy makes prompts, a reader answers them. Each
is a function of a DataFrame or of columns, so any of them may be a join with a table of
results made elsewhere, built-in functions, or a pandas UDF. plugins.py makes plain Python
functions into representations and retrievers that SQL can call too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions import render
from murmura.functions.names import index_key
from murmura.operators import records, relevance, retrieve
from murmura.sources import readers, writers


def markdown(**params) -> Callable[[DataFrame], Column]:
    """The built-in representation: file and sheet names, header and rows as a markdown table."""

    def text(corpus: DataFrame) -> Column:
        given = {n: F.col(n) for n in ("file_name", "sheet_name") if n in corpus.columns}
        return render.table_text(F.col("header"), F.col("instances"), **given, **params)

    return text


@dataclass
class Study:
    """representations: by name, a factory of functions from a corpus to its column of text, or to (id, representation, metadata). encoders: by name, a function that adds the column embedding to (id, text). strategies: by name, a function (question, tables) to a prompt column. readers: by name, a function that adds the column answer to rows with a prompt."""

    spark: SparkSession
    folder: str
    representations: dict[str, Callable[..., Callable[[DataFrame], Column]]] = field(default_factory=lambda: {"markdown": markdown})
    encoders: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    strategies: dict[str, Callable[[Column, Column], Column]] = field(default_factory=lambda: {"zero-shot": lambda question, tables: render.user_prompt(question, render.prompt_tables(tables))})
    readers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def build_representations(self, corpus: DataFrame, name: str = "markdown", **params) -> DataFrame:
        """(id, representation, metadata) of each table of ``corpus``, one for each id, written as JSON lines and read again."""
        made = self.representations[name](**params)(corpus)
        made = made if isinstance(made, DataFrame) else corpus.select("id", made.alias("representation"), "metadata")
        made = made.dropDuplicates(["id"])
        path = f"{self.folder}/representations/{index_key(name, params)}"
        writers.json_lines(made, path)
        return readers.representations(self.spark, path)

    def encode_indices(self, representations: DataFrame, encoder: str, **params) -> str:
        """Writes the vectors of all representations as an index; its key."""
        key = index_key(encoder, params)
        writers.vector_index(self.encoders[encoder](representations.select("id", F.col("representation").alias("text"))), f"{self.folder}/indices", key)
        return key

    def indices(self) -> DataFrame:
        return writers.index_keys(self.spark, f"{self.folder}/indices")

    def delete_index(self, key: str) -> bool:
        return writers.delete_index(self.spark, f"{self.folder}/indices", key)

    def retrieve_tables(self, asked: DataFrame, key: str, encoder: str, k: int) -> DataFrame:
        """(question, rank, id, score): the k nearest tables of each question (query_id a number, question)."""
        vectors = self.encoders[encoder](asked.select(F.col("query_id").alias("id"), F.col("question").alias("text")))
        found = retrieve.cosine_topk(vectors.select(F.col("id").alias("query_id"), "embedding"), writers.load_index(self.spark, f"{self.folder}/indices", key), k)
        return found.join(asked.select(F.col("query_id").cast("long").alias("query_id"), "question"), "query_id").select("question", "rank", "id", "score")

    def cache_retrieval(self, retrieved: DataFrame, name: str) -> None:
        writers.retrieval_lines(retrieved, f"{self.folder}/retrieval/{name}")

    def load_retrieval(self, name: str, top: int | None = None) -> DataFrame:
        return readers.retrievals(self.spark, f"{self.folder}/retrieval/{name}", top)

    def reason(self, asked: DataFrame, contexts: DataFrame, representations: DataFrame, reader: str, strategy: str = "zero-shot", most_tokens: int = 8000, most_tables: int | None = None) -> DataFrame:
        """(query_id, question, prompt, answer): each question with the tables of its context, cut to most_tokens each, put to a reader."""
        met = asked.join(records.injected_tables(contexts, representations, most_tokens, most_tables), "query_id")
        prompts = met.select("query_id", "question", self.strategies[strategy](F.col("question"), F.col("tables")).alias("prompt"))
        return self.readers[reader](prompts)

    def evaluate(self, asked: DataFrame, retrieved: DataFrame, gold: DataFrame, ks: list[int], available: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Metrics of every query and depth, and their means."""
        each = relevance.metrics(asked, retrieved, gold, ks, available)
        return each, relevance.averaged(each)

    def run_retrieval(self, corpus: DataFrame, asked: DataFrame, gold: DataFrame, encoder: str, ks: list[int], name: str = "markdown", **params) -> tuple[DataFrame, DataFrame]:
        """From tables to metrics: representations, index, retrieval, cache, evaluation over the tables that the index holds. gold: query_id, id."""
        made = self.build_representations(corpus, name, **params)
        key = self.encode_indices(made, encoder, **params)
        self.cache_retrieval(self.retrieve_tables(asked, key, encoder, max(ks)), key)
        found = self.load_retrieval(key, max(ks)).join(asked.select("query_id", "question"), "question").select("query_id", "rank", "id", "score")
        return self.evaluate(asked, found, gold, ks, made.select("id"))
