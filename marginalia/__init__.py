"""Annotated-text analytics on Spark: corpora, spans, scoring, linking, error analysis."""
