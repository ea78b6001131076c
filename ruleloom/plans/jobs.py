"""The four jobs a user runs, each from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.paths import resolve_from
from ruleloom.functions.variants import string_only
from ruleloom.operators import evidence as E
from ruleloom.operators import prompts as P
from ruleloom.operators import quality as Q
from ruleloom.operators import reports as R
from ruleloom.operators.configs import LIST_KEYS, MAP_KEYS, NESTED, config_chains, effective_configs, entry_value
from ruleloom.operators.rules import effective_rules, latest_rules, rule_chains, with_detect_columns
from ruleloom.session import shuffled, staged

CONTEXT_VERSION = "0.3"


def load_projects(config_table: DataFrame, project_configs: DataFrame) -> DataFrame:
    """Effective configuration per project. ``project_configs`` maps ``project_id`` to ``config_path``."""
    chains = config_chains(config_table, project_configs.select(F.col("config_path").alias("start")))
    return projects_of(chains, project_configs)


def projects_of(chains: DataFrame, project_configs: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """``fields`` names the merged columns that are read later, by default all (:func:`effective_configs`)."""
    projects = effective_configs(chains, fields).join(shuffled(project_configs), "config_path")
    if fields is None or "i18n" in fields:
        named = string_only(entry_value(F.col("i18n"), "defaultLocale"), "$")
        projects = projects.withColumn("locale", F.coalesce(F.nullif(named, F.lit("")), F.lit("en")))
    # Small next to the corpus, and every check reads it again.
    return staged(projects, "projects")


def rules_paths(projects: DataFrame, default: str) -> DataFrame:
    """``project_id, rules_path``: the rule document that a project's merged configuration names.

    ``rulesFile`` is seen from the configuration's folder; without it ``default`` is. The result
    serves :func:`load_rules` and the setup check.
    """
    named = F.coalesce(F.nullif("rulesFile", F.lit("")), F.lit(default))
    return projects.select("project_id", resolve_from(F.col("config_path"), named).alias("rules_path"))


def load_rules(rule_table: DataFrame, project_rules: DataFrame) -> DataFrame:
    """Effective rules per project. ``project_rules`` maps ``project_id`` to ``rules_path``."""
    chains = rule_chains(rule_table, project_rules.select(F.col("rules_path").alias("start")))
    return rules_of(chains, project_rules)


def rules_of(chains: DataFrame, project_rules: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """``fields`` names the columns that are read later, by default all."""
    rules = effective_rules(chains).join(shuffled(project_rules.withColumnRenamed("rules_path", "document")), "document")
    rules = with_detect_columns(rules)
    return staged(rules if fields is None else rules.select("project_id", "rule_pos", *fields), "rules")


def audit(
    files: DataFrame, projects: DataFrame, rules: DataFrame, locales: DataFrame, parsed: DataFrame | None = None, locale: str | None = None
) -> dict[str, DataFrame]:
    """Findings, evidence and prompts. Projects with error findings are left out of the scan.

    ``parsed`` names the projects whose rule documents could be read; others stop, too,
    whatever their configuration enables. Without it all count as read.

    ``locale``, unless empty, goes before the locales that the configurations name.

    ``projects`` and ``rules`` come from :func:`load_projects` and :func:`load_rules`.
    Gating before the scan saves reading the texts of projects whose prompt would be withheld.
    """
    findings = Q.rule_findings(rules, projects)
    ready = projects if parsed is None else projects.join(shuffled(parsed.select("project_id")), "project_id", "left_semi")
    open_projects = staged(Q.without_errors(ready, findings), "open-projects")
    open_rules = rules.join(shuffled(open_projects.select("project_id")), "project_id", "left_semi")
    resolved = E.resolve_rules(open_rules, exceptions_of(open_projects))
    evidence = staged(E.evidence_records(E.files_in_scope(files, open_projects), resolved), "evidence")
    active = Q.active_rules(open_rules, open_projects)
    maps = P.locale_maps(locales)
    wanted = open_projects.withColumn("locale", F.lit(locale)) if locale else open_projects
    headers = P.audit_headers(P.resolve_locales(wanted, locales), maps)
    prompts = P.audit_prompts(headers, P.rule_sections(active), P.evidence_sections(active, evidence))
    return {"projects": open_projects, "findings": findings, "evidence": evidence, "prompts": prompts}


def exceptions_of(projects: DataFrame) -> DataFrame:
    return projects.select("project_id", "exceptions")


def audit_context(projects: DataFrame, rules: DataFrame, evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """One nested row per audited project (S6): its configuration, rules, evidence and findings.

    ``projects`` are the open ones of :func:`audit`. Groups hold a project's rules and what was
    kept for each, not its corpus.
    """

    def packed(table: DataFrame, order: str, name: str, *drop: str) -> DataFrame:
        fields = [order] + [c for c in table.columns if c not in ("project_id", order, *drop)]
        # Maps cannot be compared, so the order is fixed on the position alone.
        listed = F.collect_list(F.struct(*fields))
        by_order = F.array_sort(
            listed,
            lambda a, b: F.when(a[order] < b[order], F.lit(-1)).when(a[order] > b[order], F.lit(1)).otherwise(F.lit(0)),
        )
        return table.groupBy("project_id").agg(by_order.alias(name))

    # Keys with a merge rule come merged, all others as written.
    merged = (*LIST_KEYS, *MAP_KEYS, "exceptions", *NESTED)
    others = F.filter("plain", lambda e: ~e["key"].isin(*merged))
    maps = [F.map_from_entries(c).alias(c) for c in (*MAP_KEYS, "exceptions", "prompt")]
    detect = F.struct("include", "exclude").alias("detectOptions")
    config = F.struct(F.map_from_entries(others).alias("plain"), *LIST_KEYS, *maps, detect)
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    out = projects.select("project_id", F.lit(CONTEXT_VERSION).alias("version"), stamp.alias("generatedAt"), "locale", config.alias("config"))
    for table, order, name in ((rules, "rule_pos", "rules"), (evidence, "rule_pos", "evidence"), (findings, "seq", "findings")):
        out = out.join(shuffled(packed(table, order, name)), "project_id", "left")
    return out


def validate_reports(reports: DataFrame, raw: str = "raw") -> dict[str, DataFrame]:
    """Normalised violations, findings and pass/fail summary of report texts."""
    # Parsed once; all four are read off the report's row.
    normal = staged(R.report_violations(reports, raw), "reports")
    severities = F.transform("violations", lambda v: v["severity"])
    return {
        "violations": R.violation_rows(normal),
        "findings": Q.report_findings(normal),
        "summary": normal.select(*R.REPORT_KEY, R.severity_counts(severities).alias("s")).select(*R.REPORT_KEY, "s.*"),
        "status": Q.report_status(normal),
    }


def fix_issues(
    reports: DataFrame, rules: DataFrame, projects: DataFrame, issue_id: Column | None = None, rule_id: Column | None = None
) -> DataFrame:
    """Reports that pass, their issues joined to the last definition of their rule.

    ``reports`` come from :func:`ruleloom.operators.reports.report_violations`; ``projects`` are those
    whose configuration was found and loaded; issues of others get no rule metadata. With ``issue_id``
    only the first issue of that id stays in each report, and ``rule_id`` then overrides its rule; with
    ``rule_id`` alone only the issues of that rule stay. Reports without any such issue are left out.
    """
    rules = rules.join(shuffled(projects.select("project_id")), "project_id", "left_semi")
    # The gate would otherwise move below the parsing and repeat it.
    clean = Q.clean_reports(staged(reports, "reports"))
    if issue_id is not None:
        clean = R.select_issue(clean, issue_id, rule_id)
    elif rule_id is not None:
        clean = R.select_rule(clean, rule_id)
    return P.enrich_issues(clean, latest_rules(rules))


def doctor(inputs: DataFrame, config_chain_table: DataFrame, projects: DataFrame, rule_chain_table: DataFrame, rules: DataFrame) -> DataFrame:
    """Setup findings per project, in check order; a missing input ends a project's checks.

    ``inputs`` has ``project_id, config_path, rules_path`` and the flags of
    :func:`ruleloom.operators.quality.missing_inputs`.
    """

    def step_rows(table: DataFrame, step) -> DataFrame:
        seq = F.struct(
            step.alias("step"), F.lit(0).cast("bigint").alias("rule_pos"), F.lit(0).alias("check"), F.lit(0).alias("sub")
        )
        return table.select("project_id", seq.alias("seq"), F.lit("error").alias("level"), "message")

    missing = Q.missing_inputs(inputs)
    unloadable = Q.broken_chains(config_chain_table, "config").join(
        shuffled(inputs.where("has_config").select("project_id", F.col("config_path").alias("start"))), "start"
    )
    unparsed = (
        Q.broken_chains(rule_chain_table, "rule")
        .join(shuffled(inputs.where("has_config and has_rules").select("project_id", F.col("rules_path").alias("start"))), "start")
        .join(shuffled(projects.select("project_id")), "project_id", "left_semi")
    )
    # Without rules, a loaded project still gets its configuration checked; one without
    # loadable configuration gets no rule finding, because rule checks join on projects.
    no_rules = missing.where("step = 0").unionByName(
        missing.where("step = 6").join(shuffled(projects.select("project_id")), "project_id", "left_semi")
    )
    parsed = inputs.where("has_rules").select("project_id", F.col("rules_path").alias("start")).join(
        shuffled(rule_chain_table.where("status = 'ok'").select("start")), "start", "left_semi"
    )
    checked = projects.join(shuffled(parsed.select("project_id")), "project_id", "left_semi")
    return (
        step_rows(no_rules, F.col("step"))
        .unionByName(step_rows(unloadable, F.lit(1)))
        .unionByName(Q.config_findings(projects))
        .unionByName(Q.threshold_findings(projects))
        .unionByName(Q.exception_findings(projects))
        .unionByName(step_rows(unparsed, F.lit(7)))
        .unionByName(Q.as_doctor_rows(Q.rule_findings(rules, checked)))
    )
