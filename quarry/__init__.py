"""quarry — Spark-native analytics over labelled code/text corpora and findings.

Sub-packages:
  sources/    readers for tables, report files, fixed rule tables; sinks
  functions/  column-expression builders (text, maps, features)
  operators/  DataFrame -> DataFrame operators (corpus, findings, rules,
              scoring, evaluation, results) and scale helpers
  plans/      demo views over the driver tables and the query registry
  streaming/  Structured Streaming jobs
"""

__all__ = ["session"]
