"""Relational operators of the audit: scoping, matching, evidence, rules, configs, reports, checks, texts."""
