"""Registered queries over the given tables, and an SQL oracle for each that has one."""

from __future__ import annotations


def _load():
    from ruleloom.catalog import evidence_queries, registry, report_queries, setup_queries, text_queries  # noqa: F401

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
