"""Readers and writers for corpora, rule documents, configurations, reports and texts."""
