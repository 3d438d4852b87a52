"""Pairwise sequence alignment analytics on Spark, and operators for training corpora."""
