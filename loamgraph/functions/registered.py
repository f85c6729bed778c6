"""Functions for SQL: table functions with their own schemas and partitions, and an aggregate."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, pandas_udf, udtf

from ..operators.chunking import packed


def _whole(argument: AnalyzeArgument | None, name: str, default: int) -> int:
    if argument is None:
        return default
    if argument.isTable or not isinstance(argument.value, int):
        raise ValueError(f"{name} must be a whole number")
    return argument.value


def _named(argument: AnalyzeArgument | None, name: str, default: str, table: AnalyzeArgument) -> str:
    value = default if argument is None else argument.value
    if value not in table.dataType.names:
        raise ValueError(f"the table has no column {value!r} ({name})")
    return value


@dataclass
class _Chunking(AnalyzeResult):
    text: str = "text"
    kept: list = field(default_factory=list)
    most: int = 512
    overlap: int = 0


@dataclass
class _Batching(AnalyzeResult):
    size: str = ""
    budget: int = 0
    most: int = 0


class ChunkTexts:
    """chunk_texts(TABLE(rows), max_tokens => 512, overlap => 0, text_col => 'text'): a row for each chunk of each text.

    All columns but the text stay, whatever they are; chunk_index, text and token_count follow.  Chunks are those of
    `chunking.chunk_documents`; null and empty texts have none.
    """

    def __init__(self, analyzed=None):
        self.given = analyzed

    @staticmethod
    def analyze(table: AnalyzeArgument, max_tokens: AnalyzeArgument = None, overlap: AnalyzeArgument = None, text_col: AnalyzeArgument = None) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument must be a table")
        text, most = _named(text_col, "text_col", "text", table), _whole(max_tokens, "max_tokens", 512)
        if most < 1:
            raise ValueError("max_tokens must be 1 at least")
        kept = [f for f in table.dataType.fields if f.name != text]
        taken = {f.name for f in kept} & {"chunk_index", "token_count"}
        if taken:
            raise ValueError(f"the table has columns of the result: {sorted(taken)}")
        schema = T.StructType([*kept, T.StructField("chunk_index", T.IntegerType()), T.StructField(text, T.StringType()), T.StructField("token_count", T.IntegerType())])
        return _Chunking(schema=schema, text=text, kept=[f.name for f in kept], most=most, overlap=max(0, min(_whole(overlap, "overlap", 0), most // 2)))

    def eval(self, table, *_, **__):
        g = self.given
        for k, piece in enumerate(packed(table[g.text] or "", g.most, g.overlap)):
            yield *(table[c] for c in g.kept), k, piece, len(piece.split())


class TokenBatches:
    """token_batches(TABLE(rows), group_col => 'g', order_col => 'o', size_col => 'n', budget => 4000, most => 100): rows with their batch.

    The function asks for its rows by group and in order; it carries the open batch's sums only, as `batches_by_budget` does.
    """

    def __init__(self, analyzed=None):
        self.given, self.batch, self.total, self.n = analyzed, 0, 0, 0

    @staticmethod
    def analyze(table: AnalyzeArgument, group_col: AnalyzeArgument, order_col: AnalyzeArgument, size_col: AnalyzeArgument, budget: AnalyzeArgument = None, most: AnalyzeArgument = None) -> AnalyzeResult:
        group, order, size = (_named(a, n, "", table) for a, n in ((group_col, "group_col"), (order_col, "order_col"), (size_col, "size_col")))
        schema = T.StructType([*table.dataType.fields, T.StructField("batch", T.IntegerType())])
        return _Batching(schema=schema, partitionBy=[PartitioningColumn(group)], orderBy=[OrderingColumn(order)], size=size, budget=_whole(budget, "budget", 4000), most=_whole(most, "most", 100))

    def eval(self, table, *_, **__):
        size = int(table[self.given.size] or 0)
        if self.n and (self.total + size > self.given.budget or self.n >= self.given.most):
            self.batch, self.total, self.n = self.batch + 1, 0, 0
        self.total, self.n = self.total + size, self.n + 1
        yield *table, self.batch


def _calibration(confidence: pd.Series, right: pd.Series) -> float | None:
    """Expected calibration error over ten equal bands of confidence; null without rows.  A group is one series, so give it groups that fit a task."""
    own = pd.DataFrame({"c": confidence, "r": right}).dropna()
    if not len(own):
        return None
    band = np.clip((own["c"] * 10).astype(int), 0, 9)
    by = own.groupby(band).agg(c=("c", "mean"), r=("r", "mean"), n=("c", "size"))
    return float((by["n"] * (by["c"] - by["r"]).abs()).sum() / len(own))


def register(spark: SparkSession) -> None:
    """Makes chunk_texts, token_batches and calibration_gap callable from the session's SQL."""
    spark.udtf.register("chunk_texts", udtf(ChunkTexts))
    spark.udtf.register("token_batches", udtf(TokenBatches))
    spark.udf.register("calibration_gap", pandas_udf(_calibration, "double"))
