"""Checks on rules, configurations, inputs and reports; each emits findings.

A finding is ``(<keys>, seq, level, message)`` where ``seq`` orders findings of one subject.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions import variants as V
from ruleloom.functions.entries import occurrences
from ruleloom.functions.text import bind
from ruleloom.operators.configs import entry_value
from ruleloom.operators.reports import REPORT_KEY, SEVERITIES, UNKNOWN_ISSUE, UNKNOWN_RULE
from ruleloom.operators.rules import duplicate_rules
from ruleloom.session import shuffled

# Name that messages give to a project's configuration file.
CONFIG_FILE = "project.json"

# Fields every rule must fill.
RULE_FIELDS = {"rule_id": "id", "severity": "severity", "scope": "scope", "intent": "intent", "fix": "fix"}
PROMPT_FIELDS = ("violation", "requirement", "solution")
FINDING = ("seq", "level", "message")


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _text(*parts: str | Column) -> Column:
    """Message from literal texts and columns; a missing value prints as ``undefined``."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("undefined")) for p in parts])


def _rule_finding(check: int, level: str, message: Column, bad: Column, sub: int = 0) -> Column:
    """A finding struct when ``bad`` holds, else NULL."""
    seq = F.struct(
        F.col("rule_pos").cast("bigint").alias("rule_pos"), F.lit(check).alias("check"), F.lit(sub).alias("sub")
    )
    return F.when(bad, F.struct(seq.alias("seq"), F.lit(level).alias("level"), message.alias("message")))


def _emit(rules: DataFrame, findings: list[Column]) -> DataFrame:
    return rules.select("project_id", "rule_id", F.inline(F.array_compact(F.array(*findings))))


def _field_gaps() -> list[Column]:
    shown = F.coalesce(F.nullif(F.col("rule_id"), F.lit("")), F.lit("UNKNOWN"))
    return [
        _rule_finding(1, "error", _text("Rule '", shown, f"' is missing required field '{name}'."), _blank(F.col(column)), at)
        for at, (column, name) in enumerate(RULE_FIELDS.items())
    ]


def _prompt_gaps() -> list[Column]:
    return [
        _rule_finding(
            5,
            "error",
            _text("Rule '", F.col("rule_id"), f"' is missing prompt.{name}."),
            _blank(F.try_element_at("prompt", F.lit(name))),
            at,
        )
        for at, name in enumerate(PROMPT_FIELDS)
    ]


def _severity_gap() -> Column:
    severity = F.col("severity")
    message = _text("Rule '", F.col("rule_id"), "' has invalid severity '", severity, "'.")
    return _rule_finding(2, "error", message, ~_blank(severity) & ~severity.isin(*SEVERITIES))


def _scope_gap() -> Column:
    scope, declared = F.col("scope"), F.col("scopes")
    message = _text("Rule '", F.col("rule_id"), "' uses scope '", scope, f"' that is not declared in {CONFIG_FILE}.")
    return _rule_finding(3, "error", message, ~_blank(scope) & (F.size(declared) > 0) & ~F.array_contains(declared, scope))


def _detect_gap() -> Column:
    message = _text("Rule '", F.col("rule_id"), "' must declare a detect block.")
    return _rule_finding(4, "error", message, F.coalesce(F.size("detect"), F.lit(0)) <= 0)


def _enabled_gap() -> Column:
    message = _text("Rule '", F.col("rule_id"), f"' is defined but not enabled in {CONFIG_FILE}.")
    idle = ~F.array_contains(F.coalesce("enabledRuleIds", F.array().cast("array<string>")), F.col("rule_id"))
    return _rule_finding(6, "warn", message, idle)


def missing_fields(rules: DataFrame) -> DataFrame:
    """One row per required rule field that is empty."""
    return _emit(rules, _field_gaps())


def missing_prompts(rules: DataFrame) -> DataFrame:
    """One row per required prompt text that is empty."""
    return _emit(rules, _prompt_gaps())


def bad_rule_severity(rules: DataFrame) -> DataFrame:
    """D3."""
    return _emit(rules, [_severity_gap()])


def rules_without_detect(rules: DataFrame) -> DataFrame:
    """D4."""
    return _emit(rules, [_detect_gap()])


def _configured(rules: DataFrame, projects: DataFrame) -> DataFrame:
    return rules.join(shuffled(projects.select("project_id", "scopes", "enabledRuleIds")), "project_id")


def unknown_scopes(rules: DataFrame, projects: DataFrame) -> DataFrame:
    """Scopes a project does not declare, when it declares any."""
    return _emit(_configured(rules, projects), [_scope_gap()])


def rules_not_enabled(rules: DataFrame, projects: DataFrame) -> DataFrame:
    """J4, a warning. The enabled list comes with the project row, so no second join is needed."""
    return _emit(_configured(rules, projects), [_enabled_gap()])


def repeated_rules(rules: DataFrame) -> DataFrame:
    repeat = _rule_finding(0, "error", _text("Duplicate ruleId '", F.col("rule_id"), "'."), F.lit(True))
    return _emit(duplicate_rules(rules), [repeat])


def enabled_ids(projects: DataFrame) -> DataFrame:
    """Enabled rule ids per project with their first place in the list."""
    return projects.select("project_id", F.posexplode(F.array_distinct("enabledRuleIds")).alias("at", "rule_id"))


def active_rules(rules: DataFrame, projects: DataFrame) -> DataFrame:
    """Rules their project enables."""
    return rules.join(shuffled(enabled_ids(projects)), ["project_id", "rule_id"], "left_semi")


def enabled_missing(rules: DataFrame, projects: DataFrame) -> DataFrame:
    """Enabled ids no rule defines. They follow all rule findings."""
    absent = enabled_ids(projects).join(shuffled(rules.select("project_id", "rule_id")), ["project_id", "rule_id"], "left_anti")
    seq = F.struct(F.lit((1 << 63) - 1).alias("rule_pos"), F.lit(7).alias("check"), F.col("at").alias("sub"))
    return absent.select(
        "project_id",
        "rule_id",
        seq.alias("seq"),
        F.lit("error").alias("level"),
        _text("enabledRuleIds references missing rule '", F.col("rule_id"), "'.").alias("message"),
    )


def rule_findings(rules: DataFrame, projects: DataFrame) -> DataFrame:
    """All rule checks of the projects that have a configuration, ordered by ``seq``.

    The row-wise checks share one pass over the rules; only the two set checks add one each.
    """
    known = _configured(rules, projects)
    row_wise = [*_field_gaps(), _severity_gap(), _scope_gap(), _detect_gap(), *_prompt_gaps(), _enabled_gap()]
    return (
        _emit(known, row_wise)
        .unionByName(repeated_rules(known.drop("scopes", "enabledRuleIds")))
        .unionByName(enabled_missing(rules, projects))
    )


def _entry_findings(configs: DataFrame, entries: Column, good: Column, message: Column, check: int) -> DataFrame:
    rows = configs.select("project_id", F.posexplode(entries).alias("at", "entry")).where(~good)
    return rows.select("project_id", _doctor_seq(check, F.col("at")), F.lit("error").alias("level"), message.alias("message"))


def _doctor_seq(check: int, sub: Column | None = None) -> Column:
    return F.struct(
        F.lit(check).alias("step"),
        F.lit(0).cast("bigint").alias("rule_pos"),
        F.lit(0).alias("check"),
        (F.lit(0) if sub is None else sub).cast("int").alias("sub"),
    ).alias("seq")


def _not_an_object(configs: DataFrame, key: str, check: int) -> DataFrame:
    # A lone document keeps the value as written; a merge always leaves an object.
    value = entry_value(F.col("plain"), key)
    odd = (F.col("n_documents") == 1) & V.truthy(value).isNotNull() & ~V.kind(value).startswith("OBJECT")
    return configs.where(odd).select(
        "project_id", _doctor_seq(check), F.lit("error").alias("level"), F.lit(f"{key} must be an object map.").alias("message")
    )


def threshold_findings(configs: DataFrame) -> DataFrame:
    """Thresholds must be an object of finite numbers."""
    message = _text("thresholds.", F.col("entry.key"), " must be a finite number.")
    good = V.is_number(F.col("entry.value"))
    return _not_an_object(configs, "thresholds", 4).unionByName(
        _entry_findings(configs, F.col("thresholds"), good, message, 4)
    )


def exception_findings(configs: DataFrame) -> DataFrame:
    """Exceptions must be an object of text arrays."""
    value = F.col("entry.value")
    items = V.elements(value, "$")
    texts = items.isNotNull() & ~F.exists(
        F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.coalesce(V.kind(x), F.lit("VOID")) != "STRING"
    )
    # Merging a child's bare text into a parent turns it into a list of characters.
    good = texts | ((F.col("entry.level") > 0) & F.coalesce(V.kind(value) == "STRING", F.lit(False)))
    message = _text("exceptions.", F.col("entry.key"), " must be an array of glob strings.")
    return _not_an_object(configs, "exceptions", 5).unionByName(
        _entry_findings(configs, F.col("exception_entries"), good, message, 5)
    )


def config_findings(configs: DataFrame) -> DataFrame:
    """The enabled list must not be empty, the scope list should not be."""
    nothing = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    no_rules = configs.where(nothing("enabledRuleIds")).select(
        "project_id", _doctor_seq(2), F.lit("error").alias("level"),
        F.lit("enabledRuleIds must be a non-empty array.").alias("message"),
    )
    no_scopes = configs.where(nothing("scopes")).select(
        "project_id", _doctor_seq(3), F.lit("warn").alias("level"),
        F.lit("scopes is empty; scope validation will be limited.").alias("message"),
    )
    return no_rules.unionByName(no_scopes)


def missing_inputs(projects: DataFrame, folder: str = "setup", config_file: str = CONFIG_FILE) -> DataFrame:
    """D9 for a project table with ``has_folder, has_config, has_rules, rules_path`` flags.

    Each project reports the first input it lacks; later checks do not apply to it. ``folder``
    and ``config_file`` are the names that the messages tell.
    """
    message = (
        F.when(~F.col("has_folder"), f"{folder} directory not found.")
        .when(~F.col("has_config"), f"{folder}/{config_file} not found.")
        .when(~F.col("has_rules"), F.concat(F.lit("Rules file not found: "), "rules_path"))
    )
    step = F.when(~F.col("has_folder") | ~F.col("has_config"), 0).otherwise(6)
    return projects.select("project_id", step.alias("step"), message.alias("message")).where("message is not null")


def broken_chains(chains: DataFrame, what: str) -> DataFrame:
    """Load failures of inherited documents: a cycle, a parent that does not exist, text that is no JSON."""
    subject = {"config": "Failed to load config: ", "rule": "Failed to parse rules: "}[what]
    reason = (
        F.when(F.col("status") == "cycle", F.concat(F.lit(f"Circular {what} extends detected: "), "trouble"))
        .when(F.col("status") == "unreadable", F.concat(F.lit("not valid JSON: "), "trouble"))
        .otherwise(F.concat(F.lit("no such file: "), "trouble"))
    )
    return chains.where("status <> 'ok'").select("start", F.concat(F.lit(subject), reason).alias("message"))


def as_doctor_rows(rule_rows: DataFrame, step: int = 7) -> DataFrame:
    """Rule findings with the wider ``seq`` of a whole setup check."""
    seq = F.struct(F.lit(step).alias("step"), F.col("seq.rule_pos"), F.col("seq.check"), F.col("seq.sub"))
    return rule_rows.select("project_id", seq.alias("seq"), "level", "message")


def finding_summary(subjects: DataFrame, findings: DataFrame, *keys: str, strict: bool = False) -> DataFrame:
    """Counts per subject and whether it passes; ``strict`` lets warnings fail, too.

    Each of ``subjects`` has its row, also without any finding.
    """
    on = list(keys or ("project_id",))
    found = findings.groupBy(*on).agg(
        F.count_if(F.col("level") == "error").alias("errors"),
        F.count_if(F.col("level") == "warn").alias("warnings"),
    )
    none = F.lit(0).cast("bigint")
    counted = (
        subjects.select(*on)
        .distinct()
        .join(shuffled(found), on, "left")
        .select(*on, F.coalesce("errors", none).alias("errors"), F.coalesce("warnings", none).alias("warnings"))
    )
    failing = F.col("errors") > 0
    if strict:
        failing = failing | (F.col("warnings") > 0)
    return counted.withColumn("passed", ~failing)


def without_errors(subjects: DataFrame, findings: DataFrame, *keys: str) -> DataFrame:
    """drop every subject that has an error finding (Q22)."""
    on = list(keys or ("project_id",))
    return subjects.join(shuffled(findings.where("level = 'error'").select(*on)), on, "left_anti")


def issue_findings(violations: Column) -> Column:
    """D10 for the violations of one report: missing ids, repeated ids, bad severity, missing repair prompt.

    An array of ``seq, level, message`` in the order of the issues and checks, made within the row.
    """

    def checked(v: Column, nth: Column) -> Column:
        issue, rule, severity = v["issue_id"], v["rule_id"], v["severity"]
        checks = [
            (issue == UNKNOWN_ISSUE, "error", _text("Violation for rule '", rule, "' is missing issueId.")),
            ((issue != UNKNOWN_ISSUE) & (nth > 1), "error", _text("Duplicate issueId '", issue, "' found in report.")),
            (rule == UNKNOWN_RULE, "error", _text("Violation '", issue, "' is missing ruleId.")),
            (~severity.isin(*SEVERITIES), "error", _text("Violation '", issue, "' has invalid severity '", severity, "'.")),
            (_blank(v["repair_prompt"]), "warn", _text("Violation '", issue, "' is missing repairPrompt.")),
        ]
        found = [
            F.when(bad, F.struct(F.struct(v["pos"].alias("pos"), F.lit(at).alias("check")).alias("seq"), F.lit(level).alias("level"), text.alias("message")))
            for at, (bad, level, text) in enumerate(checks)
        ]
        return F.array_compact(F.array(*found))

    nths = occurrences(F.transform(violations, lambda v: v["issue_id"]))
    return F.flatten(bind(nths, lambda n: F.transform(violations, lambda v, at: checked(v, F.get(n, at)))))


def report_findings(reports: DataFrame) -> DataFrame:
    """D10 findings of :func:`ruleloom.operators.reports.report_violations`, one row each, ordered by ``seq``. No shuffle."""
    return reports.select(*REPORT_KEY, F.inline(issue_findings(F.col("violations"))))


def report_status(reports: DataFrame) -> DataFrame:
    """A6 for reports: errors, warnings and whether a report passes, read off its row."""
    levels = reports.select(*REPORT_KEY, F.transform(issue_findings(F.col("violations")), lambda f: f["level"]).alias("levels"))
    count = lambda level: F.size(F.filter("levels", lambda x: x == level)).cast("bigint")
    return levels.select(*REPORT_KEY, count("error").alias("errors"), count("warn").alias("warnings"), (count("error") == 0).alias("passed"))


def clean_reports(reports: DataFrame) -> DataFrame:
    """F12 for reports: those without an error finding (Q22)."""
    return reports.where(~F.exists(issue_findings(F.col("violations")), lambda f: f["level"] == "error"))
