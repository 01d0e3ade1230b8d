"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from halyard.llm import invindex, language, license, mixing, quality, simhash, tokens, toxicity, warc, webp
from halyard.llm.common import ship

MODULES = (quality, mixing, tokens, invindex, language, license, simhash, toxicity, warc, webp)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(q) for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def _pipeline() -> None:
    import corpus_pipeline

    QUERIES["pipeline"] = _shipped(corpus_pipeline.run)
    if corpus_pipeline.ORACLE_SQL:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


_pipeline()
