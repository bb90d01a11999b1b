"""Operators for large-scale training-data preparation.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it. ``QUERIES`` maps the registered query names to
callables ``(spark, sf_dir) -> DataFrame``; ``ORACLES`` holds DuckDB SQL for those that SQL can express.
"""
