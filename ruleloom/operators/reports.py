"""Findings reports: loosely shaped JSON to one strict schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions import variants as V
from ruleloom.functions.entries import grouped, occurrences
from ruleloom.functions.text import bind, made_once

REPORT_KEY = ("project_id", "report_id")

# Defaults and domains of the normalised report.
SEVERITIES = ("FATAL", "WARN", "INFO")
SEVERITY_ALIASES = {"ERROR": "FATAL", "WARNING": "WARN"}
UNKNOWN_ISSUE = "UNKNOWN-ISSUE"
UNKNOWN_RULE = "UNKNOWN-RULE"
NO_DESCRIPTION = "No detailed description was provided in the report."
DEFAULT_VERSION = "1.1"
ROOT_KEYS = ("violations", "issues", "results")
SOURCES = {"detect.regex": "local-regex", "detect.import": "local-import", "detect.include": "local-import"}


def issue_array(report: Column) -> Column:
    """The report itself when it is an array, else the first root key that holds one (Q19)."""
    return F.coalesce(V.elements(report, "$"), *[V.elements(report, f"$.{k}") for k in ROOT_KEYS])


def parsed_reports(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """Report key and ``doc``, the parsed report, of each readable report; parsed once, in the task it is dealt to."""
    return reports.select(*REPORT_KEY, made_once(F.try_parse_json(raw), "doc")).where("doc is not null")


def report_issues(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per issue: report key, ``pos`` from 0, ``issue`` VARIANT. No shuffle."""
    # Unreadable reports have no array and so yield no rows; a filter would parse twice.
    parsed = reports.select(*REPORT_KEY, F.try_parse_json(raw).alias("doc"))
    return parsed.select(*REPORT_KEY, F.posexplode(issue_array(F.col("doc"))).alias("pos", "issue"))


def normalize_severity(issue: Column) -> Column:
    """Upper-cased severity with aliases; anything but text is INFO, unknown words stay (Q18)."""

    def known(upper: Column) -> Column:
        meant = F.coalesce(upper, F.lit("INFO"))
        for word, meaning in SEVERITY_ALIASES.items():
            meant = F.when(upper == word, F.lit(meaning)).otherwise(meant)
        return meant

    return bind(F.upper(V.string_only(issue, "$.severity")), known)


def normalize_confidence(issue: Column) -> Column:
    """Number clamped to 0..1, NULL for anything else."""
    clamped = lambda found: F.least(F.greatest(F.try_variant_get(found, "$", "double"), F.lit(0.0)), F.lit(1.0))
    return bind(V.field(issue, "$.confidence"), lambda found: F.when(V.is_number(found), clamped(found)))


def normalize_line(issue: Column) -> Column:
    """First truthy alias, then NULL unless it is a number: the type is tested after the choice (Q17)."""
    chosen = F.coalesce(*[V.truthy(V.field(issue, f"$.{k}")) for k in ("line", "lineNumber", "row")])
    return bind(chosen, lambda c: F.when(V.is_number(c), F.try_variant_get(c, "$", "double")))


def repair_prompt(issue: Column) -> Column:
    """First of five places that holds text, even empty text."""
    places = ("repairPrompt", "fixPrompt", "prompt", "prompt.repair", "repair.prompt")
    return F.coalesce(*[V.string_only(issue, f"$.{p}") for p in places])


def issue_context(issue: Column) -> Column:
    texts = lambda path: F.try_variant_get(issue, path, "array<string>")
    single = bind(V.string_only(issue, "$.context"), lambda s: F.when(s.isNotNull(), F.array(s)))
    return F.coalesce(texts("$.context"), texts("$.assets"), single, F.array().cast("array<string>"))


def matched_by(issue: Column) -> Column:
    return F.coalesce(V.string_only(issue, "$.evidence.matchedBy"), V.string_only(issue, "$.detect"), F.lit("unknown"))


def evidence_source(issue: Column, by: Column) -> Column:
    def inferred(detected: Column) -> Column:
        source_of = F.lit("ai-only")
        for detector, source in SOURCES.items():
            source_of = F.when(detected == detector, F.lit(source)).otherwise(source_of)
        return source_of

    return F.coalesce(V.truthy_text(issue, "$.evidence.source"), bind(by, inferred))


def _fields(issue: Column) -> dict[str, Column]:
    """The normalised fields of an issue (R2-R9), flat."""
    pick = lambda *names: V.cascade_text(issue, *[f"$.{n}" for n in names])
    by = matched_by(issue)
    return {
        "issue_id": F.coalesce(pick("issueId", "issue_id"), F.lit(UNKNOWN_ISSUE)),
        "rule_id": F.coalesce(pick("ruleId", "rule_id", "id", "code"), F.lit(UNKNOWN_RULE)),
        "severity": normalize_severity(issue),
        "confidence": normalize_confidence(issue),
        "file": pick("file", "filePath", "path"),
        "line": normalize_line(issue),
        "snippet": pick("snippet", "codeSnippet"),
        "description": F.coalesce(pick("description", "message", "reason"), F.lit(NO_DESCRIPTION)),
        "fix_suggestion": pick("fixSuggestion", "suggestion", "repair.suggestion"),
        "repair_prompt": repair_prompt(issue),
        "evidence_source": evidence_source(issue, by),
        "matched_by": by,
        "context": issue_context(issue),
    }


# Names of an issue's fields in a normalised report.
DOCUMENTED = {
    "issueId": "issue_id", "ruleId": "rule_id", "severity": "severity", "confidence": "confidence", "file": "file", "line": "line",
    "snippet": "snippet", "description": "description", "fixSuggestion": "fix_suggestion", "repairPrompt": "repair_prompt",
}


def documented_issue(issue: Column) -> Column:
    """A normalised issue as a normalised report holds it."""
    found = _fields(issue)
    evidence = F.struct(found["evidence_source"].alias("source"), found["matched_by"].alias("matchedBy"))
    plain = [found[own].alias(name) for name, own in DOCUMENTED.items()]
    return F.struct(*plain, evidence.alias("evidence"), found["context"].alias("context"))


#: Fields that the checks of a report read.
CHECKED = ("issue_id", "rule_id", "severity", "repair_prompt")


def report_violations(reports: DataFrame, raw: str = "raw", fields: tuple[str, ...] | None = None) -> DataFrame:
    """One row per readable report: ``violations``, its normalised issues with ``pos`` from 0.

    Parsed once and kept in the report's row, so that checks and texts of a report need no shuffle.
    ``fields`` names the ones to make, by default all.
    """
    parsed = parsed_reports(reports, raw)
    issues = F.coalesce(issue_array(F.col("doc")), F.array().cast("array<variant>"))
    wanted = lambda issue: {n: c for n, c in _fields(issue).items() if fields is None or n in fields}
    one = lambda issue, pos: F.struct(pos.alias("pos"), *[c.alias(name) for name, c in wanted(issue).items()])
    return parsed.select(*REPORT_KEY, made_once(F.transform(issues, one), "violations"))


def violation_rows(reports: DataFrame) -> DataFrame:
    """The violations of :func:`report_violations`, one row each."""
    return reports.select(*REPORT_KEY, F.inline("violations"))


def normalize_issues(issues: DataFrame) -> DataFrame:
    """All normalised fields in one projection over ``issue`` VARIANT rows."""
    keys = [c for c in issues.columns if c != "issue"]
    return issues.select(*keys, *[c.alias(name) for name, c in _fields(F.col("issue")).items()])


def report_header(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """Version, timestamp and project object of each readable report, with defaults."""
    doc = F.col("doc")
    project = V.field(doc, "$.project")
    is_object = V.kind(project).rlike(r"\A(OBJECT|ARRAY)")
    return parsed_reports(reports, raw).select(
        *REPORT_KEY,
        F.coalesce(V.string_only(doc, "$.version"), F.lit(DEFAULT_VERSION)).alias("version"),
        V.string_only(doc, "$.generatedAt").alias("generated_at"),
        F.when(is_object, F.to_json(project)).otherwise("{}").alias("project"),
    )


def severity_counts(severities: Column) -> Column:
    """Struct of counts for an array of severities; unknown ones only count in ``total`` (Q18)."""
    count = lambda s: F.size(F.filter(severities, lambda x: x == s)).cast("bigint")
    return F.struct(F.size(severities).cast("bigint").alias("total"), *[count(s).alias(s.lower()) for s in SEVERITIES])


def severity_summary(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """Counts of every readable report, zeros for one without issues. Read off the row, no shuffle."""
    parsed = parsed_reports(reports, raw)
    issues = F.coalesce(issue_array(F.col("doc")), F.array().cast("array<variant>"))
    severities = parsed.select(*REPORT_KEY, F.transform(issues, normalize_severity).alias("severities"))
    return severities.select(*REPORT_KEY, severity_counts(F.col("severities")).alias("s")).select(*REPORT_KEY, "s.*")


def location_text(file: Column, line: Column) -> Column:
    """``file:line``, ``file`` without a line, NULL without a file; line 0 counts as none."""
    given = F.nullif(file, F.lit(""))
    return F.when(F.coalesce(line, F.lit(0.0)) != 0, F.concat(given, F.lit(":"), V.number_text(line))).otherwise(given)


def duplicate_issues(reports: DataFrame) -> DataFrame:
    """Repeats of an issue id within a report, after the first (Q20), one row each."""

    def repeats(violations: Column, nth: Column) -> Column:
        return F.filter(violations, lambda v, at: (v["issue_id"] != UNKNOWN_ISSUE) & (F.get(nth, at) > 1))

    nth = occurrences(F.transform("violations", lambda v: v["issue_id"]))
    return reports.select(*REPORT_KEY, F.inline(bind(nth, lambda n: repeats(F.col("violations"), n))))


def issues_grouped(reports: DataFrame) -> DataFrame:
    """Issues per report and rule; ``first_pos`` gives first-seen order (A5, Q26)."""

    def made(first: Column, own: Column) -> Column:
        return F.struct(first["rule_id"].alias("rule_id"), F.size(own).cast("bigint").alias("n_issues"), first["pos"].alias("first_pos"))

    return reports.select(*REPORT_KEY, F.inline(grouped(F.col("violations"), lambda v: v["rule_id"], made)))


def _with_some(reports: DataFrame, violations: Column) -> DataFrame:
    """Reports with other violations, without those that then have none."""
    others = [c for c in reports.columns if c != "violations"]
    return reports.select(*others, made_once(violations, "violations")).where(F.size("violations") > 0).select(*reports.columns)


def select_rule(reports: DataFrame, rule_id: Column) -> DataFrame:
    """Reports with their issues of one rule only (F9); the id may differ from report to report."""
    own = F.filter("violations", lambda v: v["rule_id"] == rule_id)
    return _with_some(reports, own)


def select_issue(reports: DataFrame, issue_id: Column, rule_id: Column | None = None) -> DataFrame:
    """Reports with the first issue of an id only (F10); ``rule_id``, unless empty, takes the place of the issue's own."""
    found = F.slice(F.filter("violations", lambda v: v["issue_id"] == issue_id), F.lit(1), F.lit(1))
    if rule_id is not None:
        given = F.nullif(rule_id, F.lit(""))
        found = F.transform(found, lambda v: v.withField("rule_id", F.coalesce(given, v["rule_id"])))
    return _with_some(reports, found)


def at_or_above(violations: DataFrame, threshold: Column) -> DataFrame:
    """Violations at or above a severity threshold; unknown severities stay out."""
    ranks = F.create_map(*[x for i, s in enumerate(reversed(SEVERITIES)) for x in (F.lit(s), F.lit(i))])
    rank = lambda c: F.try_element_at(ranks, c)
    return violations.where(rank(F.col("severity")) >= rank(threshold))


def normalized_reports(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """One nested row per readable report (R12), with the documented names of the normalised form.

    Each report is parsed once and stays in its row; nothing is shuffled.
    """
    doc = F.col("doc")
    project = V.field(doc, "$.project")
    is_object = F.coalesce(V.kind(project).rlike(r"\A(OBJECT|ARRAY)"), F.lit(False))
    parsed = parsed_reports(reports, raw)
    issues = F.coalesce(issue_array(doc), F.array().cast("array<variant>"))
    normal = parsed.select(
        *REPORT_KEY,
        F.coalesce(V.string_only(doc, "$.version"), F.lit(DEFAULT_VERSION)).alias("version"),
        V.string_only(doc, "$.generatedAt").alias("generatedAt"),
        F.when(is_object, project).otherwise(F.parse_json(F.lit("{}"))).alias("project"),
        F.transform(issues, documented_issue).alias("violations"),
    )
    severities = F.transform("violations", lambda v: v["severity"])
    return normal.select(*REPORT_KEY, "version", "generatedAt", "project", severity_counts(severities).alias("summary"), "violations")
