"""Verified-index analytics on Spark: a positional corpus, phrase verification and index assembly as DataFrame functions."""

__version__ = "0.1.0"
