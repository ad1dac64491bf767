"""Labelled string corpora as Spark tables: load, clean, split, tokenize, pool, score and report."""
