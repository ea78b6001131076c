"""Queries over findings reports. Oracles state each value from the event columns, without JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.catalog import inputs as I
from ruleloom.catalog.registry import query
from ruleloom.operators import quality as Q
from ruleloom.operators import reports as R
from ruleloom.sources.documents import json_rejects
from ruleloom.sources.sinks import as_json

# --- oracle building blocks -----------------------------------------------------------------

# One row per issue with its shape number ``n``; broken and empty reports hold none.
ISSUES = """
ev as (select *, cast(regexp_extract(props, '([0-9]+)', 1) as integer) as k, 'proj-' || user_id as project_id,
         event_id as report_id, user_id % 2 = 0 as clean from events),
raw_issues as (select ev.*, i as pos, (event_id + i) % 4 as n,
         case when clean or event_id % 7 > 0 then 'ISSUE-' || event_id || '-' || i else 'ISSUE-0' end as iid,
         case event_id % 3 when 0 then 'PART-' when 1 then 'EXTRA-' else 'NONE-' end || user_id as rid
       from ev, (values (0), (1), (2)) t(i) where event_id % 97 not in (5, 6, 7)),
v as (select project_id, report_id, pos, clean, k, user_id, n,
    case when n = 2 and not clean then 'UNKNOWN-ISSUE' else iid end as issue_id,
    case when n = 2 and not clean then 'UNKNOWN-RULE' else rid end as rule_id,
    case n when 0 then 'WARN' when 1 then 'FATAL' when 2 then case when clean then 'INFO' else 'OOPS' end else 'INFO' end as severity,
    case n when 0 then least(k + 0.5, 1.0)
           when 1 then cast('0.' || k as double) end::double as confidence,
    case when n < 3 then 'u' || user_id || '.ts' end as file,
    case when n = 2 or k = 0 then null else k end::double as line,
    case when n = 0 then 'a ' || pos end as snippet,
    case n when 1 then 'm ' || pos when 3 then 'm' else 'No detailed description was provided in the report.' end as description,
    case n when 1 then 'swap' when 3 then 'use b' end as fix_suggestion,
    case n when 0 then 'fix it' || chr(10) || 'then test' when 1 then 'patch' end as repair_prompt,
    case when n = 3 then 'local-regex' else 'ai-only' end as evidence_source,
    case when n = 3 then 'detect.regex' else 'unknown' end as matched_by,
    case when n = 0 then 'src/a|docs/x.md' when n = 2 and clean then 'src/b' when n = 3 then 'src/a' else '' end as context
  from raw_issues)"""

LOCATION = "case when line is null or line = 0 then file else file || ':' || cast(line as bigint) end"

READABLE = "readable as (select 'proj-' || user_id as project_id, event_id as report_id from events where event_id % 97 <> 5)"

SUMMARY = """select r.project_id, r.report_id, count(v.pos) as total, count(*) filter (severity = 'FATAL') as fatal,
  count(*) filter (severity = 'WARN') as warn, count(*) filter (severity = 'INFO') as info
from readable r left join v on v.project_id = r.project_id and v.report_id = r.report_id group by all"""

REPEATS = """
repeats as (
  select * from (select *, row_number() over (partition by project_id, report_id, issue_id order by pos) as nth
                 from v where issue_id <> 'UNKNOWN-ISSUE') x where nth > 1)"""

FINDINGS = f"""
{REPEATS},
findings as (
  select project_id, report_id, pos, 0 as chk, 'error' as level, 'Violation for rule ''' || rule_id || ''' is missing issueId.' as message
  from v where issue_id = 'UNKNOWN-ISSUE'
  union all select project_id, report_id, pos, 1, 'error', 'Duplicate issueId ''' || issue_id || ''' found in report.' from repeats
  union all select project_id, report_id, pos, 2, 'error', 'Violation ''' || issue_id || ''' is missing ruleId.' from v where rule_id = 'UNKNOWN-RULE'
  union all select project_id, report_id, pos, 3, 'error', 'Violation ''' || issue_id || ''' has invalid severity ''' || severity || '''.'
    from v where severity not in ('FATAL', 'WARN', 'INFO')
  union all select project_id, report_id, pos, 4, 'warn', 'Violation ''' || issue_id || ''' is missing repairPrompt.'
    from v where repair_prompt is null)"""

_KEYS = "project_id, report_id, cast(pos as bigint) as pos"


def violations(i: I.Inputs):
    return R.normalize_issues(R.report_issues(i.reports())).withColumn("pos", F.col("pos").cast("bigint"))


def report_violations(i: I.Inputs, *fields: str):
    return R.report_violations(i.reports(), fields=fields or None)


def _position(rows):
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


# --- queries --------------------------------------------------------------------------------


@query(
    "report_parse_rejects",
    """select 'proj-' || user_id as project_id, event_id as report_id, cast(4 as bigint) as n_chars,
  'Failed to read report' as message from events where event_id % 97 = 5""",
)
def report_parse_rejects(i):
    return json_rejects(i.reports(), "raw")


@query("report_issues", f"with {ISSUES} select {_KEYS} from v")
def report_issues(i):
    issues = R.report_issues(i.reports())
    return issues.select("project_id", "report_id", F.col("pos").cast("bigint").alias("pos"))


@query(
    "violations_normalized",
    f"""with {ISSUES} select {_KEYS}, issue_id, rule_id, severity, confidence, file, line, snippet, description,
  fix_suggestion, repair_prompt, evidence_source, matched_by, context from v""",
)
def violations_normalized(i):
    return violations(i).withColumn("context", F.array_join("context", "|"))


@query("severity_normalized", f"with {ISSUES} select {_KEYS}, severity from v")
def severity_normalized(i):
    return violations(i).select("project_id", "report_id", "pos", "severity")


@query("confidence_clamped", f"with {ISSUES} select {_KEYS}, confidence from v")
def confidence_clamped(i):
    return violations(i).select("project_id", "report_id", "pos", "confidence")


@query("repair_prompt", f"with {ISSUES} select {_KEYS}, repair_prompt from v")
def repair_prompt(i):
    return violations(i).select("project_id", "report_id", "pos", "repair_prompt")


@query("issue_context", f"with {ISSUES} select {_KEYS}, context from v")
def issue_context(i):
    return violations(i).select("project_id", "report_id", "pos", F.array_join("context", "|").alias("context"))


@query("matched_by", f"with {ISSUES} select {_KEYS}, matched_by, evidence_source from v")
def matched_by(i):
    return violations(i).select("project_id", "report_id", "pos", "matched_by", "evidence_source")


@query("issue_location", f"with {ISSUES} select {_KEYS}, {LOCATION} as location from v")
def issue_location(i):
    return violations(i).select(
        "project_id", "report_id", "pos", R.location_text(F.col("file"), F.col("line")).alias("location")
    )


@query(
    "report_header",
    """select 'proj-' || user_id as project_id, event_id as report_id,
  case when event_id % 97 not in (6, 7) and event_id % 5 = 0 then '1.0' else '1.1' end as version,
  case when event_id % 97 not in (6, 7) and event_id % 5 = 0 then '2024-01-01T00:00:00Z' end as generated_at,
  case when event_id % 97 not in (6, 7) and event_id % 5 = 0 then '{"cwd":"."}' else '{}' end as project
from events where event_id % 97 <> 5""",
)
def report_header(i):
    return R.report_header(i.reports())


@query("severity_summary", f"with {ISSUES}, {READABLE} {SUMMARY}")
def severity_summary(i):
    return R.severity_summary(i.reports())


@query(
    "issues_by_rule",
    f"with {ISSUES} select {_KEYS}, issue_id, rule_id from v where rule_id like 'EXTRA-%'",
)
def issues_by_rule(i):
    wanted = F.concat(F.lit("EXTRA-"), F.regexp_replace("project_id", "proj-", ""))
    found = R.violation_rows(R.select_rule(report_violations(i, "issue_id", "rule_id"), wanted))
    return _position(found).select("project_id", "report_id", "pos", "issue_id", "rule_id")


@query(
    "issue_lookup",
    f"""with {ISSUES} select {_KEYS}, issue_id, rule_id, severity from (
  select *, row_number() over (partition by project_id, report_id order by pos) as nth from v where issue_id = 'ISSUE-0') x
where nth = 1""",
)
def issue_lookup(i):
    found = R.violation_rows(R.select_issue(report_violations(i, "issue_id", "rule_id", "severity"), F.lit("ISSUE-0")))
    return _position(found).select("project_id", "report_id", "pos", "issue_id", "rule_id", "severity")


@query(
    "severity_threshold",
    f"with {ISSUES} select {_KEYS}, issue_id, severity from v where severity in ('FATAL', 'WARN')",
)
def severity_threshold(i):
    return R.at_or_above(violations(i), F.lit("WARN")).select("project_id", "report_id", "pos", "issue_id", "severity")


@query(
    "issues_grouped",
    f"""with {ISSUES} select project_id, report_id, rule_id, count(*) as n_issues, cast(min(pos) as bigint) as first_pos
from v group by all""",
)
def issues_grouped(i):
    return R.issues_grouped(report_violations(i, "rule_id")).withColumn("first_pos", F.col("first_pos").cast("bigint"))


@query("duplicate_issues", f"with {ISSUES}, {REPEATS} select {_KEYS}, issue_id, rule_id from repeats")
def duplicate_issues(i):
    return _position(R.duplicate_issues(report_violations(i, "issue_id", "rule_id"))).select("project_id", "report_id", "pos", "issue_id", "rule_id")


@query(
    "report_findings",
    f"with {ISSUES}, {FINDINGS} select {_KEYS}, cast(chk as bigint) as check_no, level, message from findings",
)
def report_findings(i):
    return Q.report_findings(report_violations(i, *R.CHECKED)).select(
        "project_id", "report_id", F.col("seq.pos").cast("bigint").alias("pos"), F.col("seq.check").cast("bigint").alias("check_no"), "level", "message"
    )


@query(
    "report_status",
    f"""with {ISSUES}, {FINDINGS}, {READABLE} select r.project_id, r.report_id, count(*) filter (level = 'error') as errors,
  count(*) filter (level = 'warn') as warnings, count(*) filter (level = 'error') = 0 as passed
from readable r left join findings f on f.project_id = r.project_id and f.report_id = r.report_id group by all""",
)
def report_status(i):
    return Q.report_status(report_violations(i, *R.CHECKED))


@query(
    "gated_projects",
    f"""with {ISSUES}, {FINDINGS}, {READABLE}
select project_id, report_id from readable
where (project_id, report_id) not in (select project_id, report_id from findings where level = 'error')""",
)
def gated_projects(i):
    return Q.clean_reports(report_violations(i, *R.CHECKED)).select(*R.REPORT_KEY)


# A report's issues in their documented form, as one text of all twelve fields.
_TEXT = "coalesce(cast({} as varchar), '-')"
_SHOWN = " || '/' || ".join(
    _TEXT.format(x)
    for x in (
        "issue_id", "rule_id", "severity", "confidence", "file", "cast(line as bigint)", "snippet", "description", "fix_suggestion",
        "repair_prompt", "evidence_source", "matched_by", "context",
    )
)

NORMALIZED = f"""with {ISSUES}, {READABLE}, s as ({SUMMARY}),
packed as (select project_id, report_id, string_agg({_SHOWN}, ' ; ' order by pos) as issues from v group by all)
select 'proj-' || user_id as project_id, event_id as report_id,
  case when event_id % 97 not in (6, 7) and event_id % 5 = 0 then '1.0' else '1.1' end as version,
  case when event_id % 97 not in (6, 7) and event_id % 5 = 0 then '2024-01-01T00:00:00Z' end as generated_at,
  case when event_id % 97 not in (6, 7) and event_id % 5 = 0 then '{{"cwd":"."}}' else '{{}}' end as project,
  total, fatal, warn, info, coalesce(issues, '') as issues
from events
join s on s.report_id = event_id and s.project_id = 'proj-' || user_id
left join packed p on p.report_id = event_id and p.project_id = 'proj-' || user_id
where event_id % 97 <> 5"""


def _shown(violations):
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    names = ("issueId", "ruleId", "severity", "confidence", "file", "line", "snippet", "description", "fixSuggestion", "repairPrompt")

    def one(x):
        plain = [text(x[n].cast("bigint") if n == "line" else x[n]) for n in names]
        return F.concat_ws("/", *plain, text(x["evidence"]["source"]), text(x["evidence"]["matchedBy"]), F.array_join(x["context"], "|"))

    return F.array_join(F.transform(violations, one), " ; ")


@query("report_normalized", NORMALIZED)
def report_normalized(i):
    return R.normalized_reports(i.reports()).select(
        "project_id", "report_id", "version", F.col("generatedAt").alias("generated_at"), F.to_json("project").alias("project"), "summary.*",
        _shown(F.col("violations")).alias("issues"),
    )


REPORT_FORM = """version string, generatedAt string, project variant, summary struct<total: bigint, fatal: bigint, warn: bigint, info: bigint>,
violations array<struct<issueId: string, ruleId: string, severity: string, confidence: double, file: string, line: double, snippet: string,
description: string, fixSuggestion: string, repairPrompt: string, evidence: struct<source: string, matchedBy: string>, context: array<string>>>"""


@query("report_json", NORMALIZED)
def report_json(i):
    """The written JSON, read again by its documented names."""
    written = as_json(R.normalized_reports(i.reports()), *R.REPORT_KEY)
    read = written.select(*R.REPORT_KEY, F.from_json("json", REPORT_FORM, {"mode": "FAILFAST"}).alias("j")).select(*R.REPORT_KEY, "j.*")
    return read.select(
        "project_id", "report_id", "version", F.col("generatedAt").alias("generated_at"), F.to_json("project").alias("project"), "summary.*",
        _shown(F.col("violations")).alias("issues"),
    )
