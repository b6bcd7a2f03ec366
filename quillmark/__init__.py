"""Quillmark: document-integrity analytics over whole corpora, as Spark plans."""

__version__ = "0.1.0"
