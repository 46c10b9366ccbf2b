"""All queries of the retrieval engine: name -> (function, DuckDB SQL or None)."""
from __future__ import annotations

from sparquill.plans import analysis, answers, chunks, evaluation, evidence, files, graph, lifecycle, questions, relational, retrieval, texts

ALL = {**retrieval.QUERIES, **relational.QUERIES, **texts.QUERIES, **chunks.QUERIES, **graph.QUERIES, **evidence.QUERIES, **analysis.QUERIES, **questions.QUERIES, **answers.QUERIES, **lifecycle.QUERIES, **evaluation.QUERIES, **files.QUERIES}
