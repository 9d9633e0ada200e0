"""Readers and writers of run, judgment, feature, query, document and vector files."""
