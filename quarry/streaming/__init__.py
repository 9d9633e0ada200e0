"""Incremental intake of documents."""
