"""Queries that learn from ``labels``."""
from __future__ import annotations

from . import toxicity
from .quality import score_documents
from .queries import query, table


@query("op1_quality_fourier_ridge")
def op1(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_toxicity_chain")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
