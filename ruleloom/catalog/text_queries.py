"""Queries that render audit and repair texts, and localise templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.catalog import inputs as I
from ruleloom.catalog.evidence_queries import HITS, LINES, PATTERN_LISTS, SCOPED, corpus, sql_trim, _MODE
from ruleloom.catalog.registry import query
from ruleloom.catalog.report_queries import FINDINGS, ISSUES, LOCATION, report_violations
from ruleloom.catalog.setup_queries import BOTH, CONFIG, RULE_FINDINGS, RULES, configs, project_rules, rule_chain_table, rules
from ruleloom.operators import evidence as E
from ruleloom.operators import prompts as P
from ruleloom.operators import quality as Q
from ruleloom.operators import reports as R
from ruleloom.operators.configs import DETECT_LISTS, LIST_KEYS, PROMPT_MAPS
from ruleloom.operators.rules import latest_rules
from ruleloom.plans import jobs
from ruleloom.session import lookup_join, shuffled, staged
from ruleloom.sources.sinks import as_json

# --- oracle building blocks -----------------------------------------------------------------

_LOCALE_ROWS = ", ".join("(" + ", ".join("'" + v + "'" for v in row) + ")" for row in I.LOCALES)
LOCALES = f"locales(locale, key, text) as (values {_LOCALE_ROWS})"
_LOCALE_OF = "case when {0} in (select locale from locales) then {0} else 'en' end"


def _lookup(locale: str, key: str) -> str:
    return f"coalesce(nullif((select max(text) from locales z where z.locale = {locale} and z.key = {key}), ''), {key})"


RULE_TEXT = """'### ' || rule_id || chr(10) || '- severity: ' || severity || chr(10) || '- scope: ' || scope || chr(10)
  || '- intent: ' || intent || chr(10) || '- fix direction: ' || coalesce(fix, 'undefined') || chr(10) || '- detect: ' || detect || chr(10)
  || '- requirement: ' || requirement || chr(10) || '- violation wording: ' || violation || chr(10)
  || '- solution wording: ' || coalesce(solution, 'undefined') || chr(10)
  || '- context assets: ' || coalesce(nullif(context, ''), '(none)')"""


def evidence_text(records: str) -> str:
    """Section text from a relation with rule_id, mode, n, note, patterns, s and shown."""
    return f"""select project_id, cast(rule_pos as bigint) as rule_pos, rule_id,
  '- ' || rule_id || ' (' || mode || ', totalMatches=' || n || ')'
  || case when note is not null then chr(10) || '  note: ' || note else '' end
  || case when patterns <> '' then chr(10) || '  exceptions: ' || patterns else '' end
  || case when s > 0 then chr(10) || '  suppressed files: ' || s else '' end
  || chr(10) || coalesce(shown, '  matches: none') as section
from {records}"""


_AI_NOTE = "'This rule uses AST or semantic detection and requires AI judgment.'"
_SHOWN = "string_agg('  - ' || path || ':' || line_no || chr(10) || '    snippet: ' || snippet, chr(10) order by rank)"

PACK_RECORDS = f"""
records as (
  select r.project_id, r.rule_pos, r.rule_id, {_MODE} as mode, coalesce(n, 0) as n,
    case when rule_id = 'SEM-901' then {_AI_NOTE} end as note, {PATTERN_LISTS} as patterns, coalesce(s, 0) as s, shown
  from rules r
  left join (select project_id, rule_pos, count(*) as n from hits group by all) a on r.project_id = a.project_id and r.rule_pos = a.rule_pos
  left join (select project_id, rule_pos, count(*) as s from rule_files where suppressed group by all) b
    on r.project_id = b.project_id and r.rule_pos = b.rule_pos
  left join (select project_id, rule_pos, {_SHOWN} as shown from top where rank <= 5 group by all) c
    on r.project_id = c.project_id and r.rule_pos = c.rule_pos)"""

FIX = f"""
{ISSUES}, {FINDINGS}, {BOTH},
clean as (select * from v where (project_id, report_id) not in (select project_id, report_id from findings where level = 'error')),
latest as (select * from erules where project_id in (select project_id from config) qualify row_number() over (partition by project_id, rule_id order by rule_pos desc) = 1),
enriched as (
  select c.*, r.rule_id is not null as known, r.severity as r_severity, r.scope as r_scope, r.intent as r_intent, r.fix as r_fix,
    r.requirement as r_requirement, r.context as r_context, {LOCATION} as location,
    coalesce(c.fix_suggestion, r.fix, 'Refactor this code path to satisfy the rule intent and architecture boundaries.') as direction,
    list_distinct_ordered(string_split(c.context, '|'), string_split(coalesce(r.context, ''), ', ')) as merged
  from clean c left join latest r on r.project_id = c.project_id and r.rule_id = c.rule_id)"""

# Ordered distinct union of the two context lists, without empty entries.
_MERGED = (
    "list_reduce([[]::varchar[]] || list_transform(list_filter(string_split(c.context, '|') || string_split(coalesce(r.context, ''), ', '), lambda x: x <> ''), "
    "lambda x: [x]), lambda a, b: case when list_contains(a, b[1]) then a else a || b end)"
)
FIX = FIX.replace("list_distinct_ordered(string_split(c.context, '|'), string_split(coalesce(r.context, ''), ', '))", _MERGED)

FALLBACK = """'You violated rule ' || rule_id || '.'
  || case when known then chr(10) || 'Rule intent: ' || r_intent || chr(10) || 'Requirement: ' || r_requirement else '' end
  || case when location is not null then chr(10) || 'Location: ' || location || '.' else '' end
  || case when snippet is not null then chr(10) || 'Snippet: ' || snippet else '' end
  || chr(10) || 'Issue: ' || description
  || chr(10) || 'Task: Provide a minimal patch that fixes this violation and keeps existing architecture boundaries intact.'
  || chr(10) || 'Expected output: short step-by-step fix plan + patch-ready code edits.'
  || chr(10) || 'Suggested direction: ' || direction
  || case when r_fix is not null then chr(10) || 'Rule fix guidance: ' || r_fix else '' end
  || case when len(merged) > 0 then chr(10) || 'Available context: ' || array_to_string(merged, ', ') else '' end"""

_INDENTED = f"'    ' || replace(coalesce(repair_prompt, {FALLBACK}), chr(10), chr(10) || '    ')"
_CONFIDENCE = "case when confidence = 1 then '1' when confidence = 0 then '0' else cast(confidence as varchar) end"

ISSUE_DETAILED = f"""'- IssueId: ' || issue_id
  || case when location is not null then chr(10) || '  Location: ' || location else '' end
  || case when confidence is not null then chr(10) || '  Confidence: ' || {_CONFIDENCE} else '' end
  || chr(10) || '  Issue: ' || description || chr(10) || '  Suggested direction: ' || direction
  || case when snippet is not null then chr(10) || '  Snippet: ' || snippet else '' end
  || chr(10) || '  Evidence: source=' || evidence_source || ', matchedBy=' || matched_by
  || chr(10) || '  Repair prompt:' || chr(10) || {_INDENTED}"""

ISSUE_FLAT = f"""'- Rule: ' || rule_id || ' | IssueId: ' || issue_id
  || case when location is not null then chr(10) || '  Location: ' || location else '' end
  || chr(10) || '  Issue: ' || description || chr(10) || '  Suggested direction: ' || direction
  || case when snippet is not null then chr(10) || '  Snippet: ' || snippet else '' end
  || chr(10) || '  Repair prompt:' || chr(10) || {_INDENTED}"""

BY_RULE = f"""
by_rule as (
  select project_id, report_id, rule_id, min(pos) as first_pos,
    'You need to fix violations of rule ' || rule_id || '.' || chr(10)
    || 'Task: Fix all reported instances of ' || rule_id || ' while preserving architecture boundaries and existing behavior.' || chr(10)
    || 'Expected output: short fix plan + minimal patch-ready code edits + tests when behavior changes.' || chr(10) || chr(10)
    || 'Rule context:' || chr(10)
    || case when known then '- severity: ' || r_severity || chr(10) || '- scope: ' || r_scope || chr(10) || '- intent: ' || r_intent || chr(10)
         || '- requirement: ' || r_requirement || chr(10) || '- fix guidance: ' || coalesce(r_fix, 'unknown')
         || case when r_context <> '' then chr(10) || '- context assets: ' || r_context else '' end
       else '- Rule metadata for ' || rule_id || ' was not found locally.' end
    || chr(10) || chr(10) || 'Violations:' || chr(10) || string_agg({ISSUE_DETAILED}, chr(10) order by pos) as prompt
  from enriched group by project_id, report_id, rule_id, known, r_severity, r_scope, r_intent, r_requirement, r_fix, r_context)"""

# Fixed value: the shape of a report that the audit text asks for.
_REPORT_SHAPE = '''{ "version": "1.1", "generatedAt": "ISO-8601", "project": { "cwd": ".", "stack": "optional" }, "summary": { "total": 0, "fatal": 0, "warn": 0, "info": 0 }, "violations": [ { "issueId": "ISSUE-001", "ruleId": "RULE-001", "severity": "FATAL|WARN|INFO", "confidence": 0.0, "file": "src/...", "line": 1, "snippet": "...", "description": "...", "fixSuggestion": "...", "repairPrompt": "...", "evidence": { "source": "local-regex|local-import|ai-only", "matchedBy": "detect.regex|detect.import|detect.include|detect.ast|detect.semantic|unknown" }, "context": ["optional/path"] } ] }'''  # noqa: E501

# Audit of the configured projects: their files, hand-written globs, gate, and prompt text.
AUDIT = f"""
{BOTH}, {RULE_FINDINGS}, {LOCALES},
open_projects as (select * from config where project_id not in (select project_id from rule_findings where level = 'error')
  and project_id in (select project_id from erules)),
project_files as ({I.PROJECT_FILES}),
scoped as (
  select f.* from project_files f join open_projects o using (project_id)
  where case when o.lone then path like 'lib/%' else (path like 'src/%' or path like 'public/%' or path like 'lib/%') end),
{LINES},
active as (select e.* from erules e join enabled using (project_id, rule_id) where project_id in (select project_id from open_projects)),
skips as (
  select project_id, path from scoped s join open_projects using (project_id) where path like 'old/%' or path like 'gen/%' or path like 'src/x/%'),
refs as (
  select project_id, path, line_no, line, generate_subscripts(r, 1) - 1 as ord, unnest(r) as reference
  from (select *, regexp_extract_all(line, 'from\\s+["'']([^"'']+)["'']', 1) || regexp_extract_all(line, 'import\\s+["'']([^"'']+)["'']', 1)
                  || regexp_extract_all(line, 'require\\(\\s*["'']([^"'']+)["'']\\s*\\)', 1) as r from lines) x),
hits as (
  select a.project_id, a.rule_pos, a.rule_id, refs.path, line_no, ord, coalesce(nullif({sql_trim("line")}, ''), line) as snippet
  from refs join active a using (project_id) where a.detect_kind = 'import' and reference like 'lib/%'
  union all
  select a.project_id, a.rule_pos, a.rule_id, lines.path, line_no, 0, coalesce(nullif({sql_trim("line")}, ''), line)
  from lines join active a using (project_id)
  where a.detect_kind = 'include' and lines.path not like 'native/%' and regexp_matches(line, '#include\\s+[<"]sys/[^/]*\\.h[>"]')
  union all
  select a.project_id, a.rule_pos, a.rule_id, lines.path, line_no, 0, coalesce(nullif({sql_trim("line")}, ''), line)
  from lines join active a using (project_id)
  where a.detect_kind = 'regex' and lines.path like 'src/%' and contains(line, regexp_extract(a.detect, 'regex=(.*), where', 1))),
top as (select *, row_number() over (partition by project_id, rule_pos order by path, line_no, ord) as rank from hits qualify rank <= 5),
records as (
  select a.project_id, a.rule_pos, a.rule_id, case detect_kind when 'regex' then 'local-regex' when 'semantic' then 'ai-only' else 'local-import' end as mode,
    coalesce(n, 0) as n, case when detect_kind = 'semantic' then {_AI_NOTE} end as note,
    coalesce(case when a.rule_id like 'EXTRA-%' then case when c % 17 = 3 then case when lone then 'src/x/**' else 'gen/**, old/**, src/x/**' end
        when c % 17 = 4 then case when lone then '' else 'gen/**, old/**' end
        else case when lone then 'src/x/**, gen/**' else 'gen/**, old/**, src/x/**' end end
      when a.rule_id = 'BASE-1' and c % 17 not in (3, 4) then 'native/**' end, '') as patterns,
    0 as s, shown
  from active a join open_projects using (project_id)
  left join (select project_id, rule_pos, count(*) as n from hits group by all) h on h.project_id = a.project_id and h.rule_pos = a.rule_pos
  left join (select project_id, rule_pos, {_SHOWN} as shown from top group by all) t on t.project_id = a.project_id and t.rule_pos = a.rule_pos),
rule_texts as (select project_id, string_agg({RULE_TEXT}, chr(10) order by rule_pos) as body from active group by all),
evidence_texts as (select project_id, string_agg(section, chr(10) order by rule_pos) as body from ({evidence_text("records")}) group by all),
audit as (
  select o.project_id,
    case when c % 8 = 6 then 'own system' else {_lookup(_LOCALE_OF.format("o.locale"), "'prompt.audit.system'")} end || chr(10) || chr(10)
    || case when c % 8 = 6 then 'own user' else {_lookup(_LOCALE_OF.format("o.locale"), "'prompt.audit.user'")} end || chr(10) || chr(10)
    || 'Project config summary:' || chr(10) || '- stack: ' || coalesce(stack, 'unknown') || chr(10)
    || '- severity threshold: ' || coalesce(severity_threshold, 'INFO') || chr(10)
    || '- include paths: ' || include || chr(10) || '- exclude paths: ' || coalesce(nullif(exclude, ''), '(none)') || chr(10)
    || '- scopes: ' || coalesce(nullif(array_to_string(scopes, ', '), ''), '(none)') || chr(10)
    || '- thresholds: ' || thresholds || chr(10) || '- exception rules: ' || exception_summary || chr(10) || chr(10)
    || 'Resolved rules:' || coalesce(chr(10) || r.body, '') || chr(10) || chr(10)
    || 'Local evidence candidates:' || coalesce(chr(10) || e.body, '') || chr(10) || chr(10) || 'Output requirements:' || chr(10)
    || 'Return strict JSON only with shape: ' || '{_REPORT_SHAPE}' || chr(10)
    || '- Only report violations at or above the configured severity threshold.' || chr(10)
    || '- Each issue must reference exactly one ruleId.' || chr(10)
    || '- Use local evidence when available, but do not fabricate certainty if evidence is weak.' || chr(10)
    || '- If no violations are found, return an empty violations array.' as prompt
  from open_projects o left join rule_texts r using (project_id) left join evidence_texts e using (project_id))"""


# --- audit texts ----------------------------------------------------------------------------


@query("rule_sections_text", f"with {RULES} select project_id, rule_pos, {RULE_TEXT} as section from erules")
def rule_sections_text(i):
    return P.rule_sections(rules(i)).select("project_id", "rule_pos", "section")


@query(
    "rules_with_evidence",
    f"with {SCOPED}, {HITS}, {PACK_RECORDS} select project_id, rule_id, mode, cast(n as bigint) as total_matches, patterns from records",
)
def rules_with_evidence(i):
    records = staged(E.evidence_records(*corpus(i)), "records")
    joined = P.rules_with_evidence(i.pack(i.corpus_projects()), records)
    return joined.select(
        "project_id", "rule_id", "mode", "total_matches", F.array_join("exception_patterns", ", ").alias("patterns")
    )


@query(
    "evidence_sections_text",
    f"with {SCOPED}, {HITS}, {PACK_RECORDS} {evidence_text('records')}",
)
def evidence_sections_text(i):
    records = staged(E.evidence_records(*corpus(i)), "records")
    return P.evidence_sections(i.pack(i.corpus_projects()), records)


def parsed_projects(i: I.Inputs, chains: DataFrame) -> DataFrame:
    """Projects whose rule document and all it extends could be read."""
    read = chains.where("status = 'ok'").select(F.col("start").alias("rules_path"))
    return project_rules(i).join(shuffled(read), "rules_path", "left_semi").select("project_id")


def audit_job(i: I.Inputs, *fields: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The job's tables and the rules; ``fields`` names the merged columns of a configuration that are read."""
    chains = rule_chain_table(i)  # parsed once for both
    found = jobs.rules_of(chains, project_rules(i))
    return jobs.audit(i.sql(I.PROJECT_FILES), configs(i, *fields), found, i.locales(), parsed_projects(i, chains)), found


@query("audit_prompts", f"with {AUDIT} select project_id, prompt from audit")
def audit_prompts(i):
    fields = ("stack", "severityThreshold", *LIST_KEYS, *DETECT_LISTS, "i18n", "thresholds", *PROMPT_MAPS, "exceptions")
    return audit_job(i, *fields)[0]["prompts"]


# The audit context holds all rules of a project, not only the enabled ones.
AUDIT_ALL = AUDIT.replace(
    "active as (select e.* from erules e join enabled using (project_id, rule_id) where project_id in (select project_id from open_projects))",
    "active as (select e.* from erules e where project_id in (select project_id from open_projects))",
)
CONTEXT_FORM = """version string, generatedAt string, locale string, config struct<enabledRuleIds: array<string>, scopes: array<string>>,
rules array<struct<rule_id: string>>, evidence array<struct<rule_id: string, mode: string, total_matches: bigint>>,
findings array<struct<level: string, message: string>>"""


@query(
    "audit_context",
    f"""with {AUDIT_ALL} select o.project_id, '0.3' as version, true as stamped, o.locale, array_to_string(o.enabled, ',') as enabled,
  array_to_string(o.scopes, ',') as scopes, r.rules, e.evidence, f.findings
from open_projects o
left join (select project_id, string_agg(rule_id, ',' order by rule_pos) as rules from erules group by all) r using (project_id)
left join (select project_id, string_agg(rule_id || ':' || mode || ':' || n, ',' order by rule_pos) as evidence from records group by all) e using (project_id)
left join (select project_id, string_agg(level || ' ' || message, chr(10) order by rule_pos, chk, sub) as findings from rule_findings group by all) f using (project_id)""",
)
def audit_context(i):
    """The written JSON, read again by its documented names."""
    job, found = audit_job(i)
    written = as_json(jobs.audit_context(job["projects"], found, job["evidence"], job["findings"]), "project_id")
    read = written.select("project_id", F.from_json("json", CONTEXT_FORM, {"mode": "FAILFAST"}).alias("j")).select("project_id", "j.*")
    joined = lambda items, text, sep=",": F.array_join(F.transform(items, text), sep)
    return read.select(
        "project_id", "version", F.col("generatedAt").rlike(r"\A\d{4}-\d\d-\d\dT[\d:.]+Z\z").alias("stamped"), "locale",
        F.array_join("config.enabledRuleIds", ",").alias("enabled"), F.array_join("config.scopes", ",").alias("scopes"),
        joined("rules", lambda x: x["rule_id"]).alias("rules"),
        joined("evidence", lambda x: F.concat_ws(":", x["rule_id"], x["mode"], x["total_matches"])).alias("evidence"),
        joined("findings", lambda x: F.concat_ws(" ", x["level"], x["message"]), "\n").alias("findings"),
    )


# --- repair texts ---------------------------------------------------------------------------


def enriched_reports(i: I.Inputs) -> DataFrame:
    return jobs.fix_issues(report_violations(i), rules(i, *P.RULE_COLUMNS), configs(i, *LIST_KEYS))


def enriched_issues(i: I.Inputs) -> DataFrame:
    """One row per issue, the issue as a struct."""
    rows = enriched_reports(i).select(*R.REPORT_KEY, F.explode("violations").alias("issue"))
    return rows.withColumn("pos", F.col("issue.pos").cast("bigint"))


@query(
    "issues_enriched",
    f"with {FIX} select project_id, report_id, cast(pos as bigint) as pos, issue_id, rule_id, known, r_severity as rule_severity, r_fix as rule_fix from enriched",
)
def issues_enriched(i):
    return enriched_issues(i).select(
        "project_id", "report_id", "pos", "issue.issue_id", "issue.rule_id", F.col("issue.rule").isNotNull().alias("known"),
        F.col("issue.rule.severity").alias("rule_severity"), F.col("issue.rule.fix").alias("rule_fix"),
    )


@query(
    "merged_context",
    f"""with {FIX} select project_id, report_id, cast(pos as bigint) as pos,
  nullif(array_to_string(merged, ', '), '') as context from enriched""",
)
def merged_context(i):
    return enriched_issues(i).select(
        "project_id", "report_id", "pos", P.merged_context(F.col("issue.context"), F.col("issue.rule.context")).alias("context")
    )


@query(
    "fallback_prompts",
    f"with {FIX} select project_id, report_id, cast(pos as bigint) as pos, {FALLBACK} as prompt from enriched",
)
def fallback_prompts(i):
    return enriched_issues(i).select("project_id", "report_id", "pos", P.fallback_prompt(F.col("issue")).alias("prompt"))


@query(
    "fix_prompts_by_rule",
    f"with {FIX}, {BY_RULE} select project_id, report_id, rule_id, cast(first_pos as bigint) as first_pos, prompt from by_rule",
)
def fix_prompts_by_rule(i):
    return P.fix_prompts_by_rule(enriched_reports(i)).withColumn("first_pos", F.col("first_pos").cast("bigint"))


@query(
    "fix_prompts_by_issue",
    f"""with {FIX}, one as (select * from enriched qualify row_number() over (partition by project_id, report_id, issue_id order by pos) = 1),
{BY_RULE.replace("group by project_id, report_id, rule_id,", "group by project_id, report_id, rule_id, issue_id,").replace("report_id, rule_id, min(pos)", "report_id, rule_id, issue_id, min(pos)").replace("from enriched", "from one")}
select project_id, report_id, rule_id, issue_id, prompt from by_rule""",
)
def fix_prompts_by_issue(i):
    return P.fix_prompts_by_issue(enriched_reports(i))


@query(
    "fix_prompts_all",
    f"""with {FIX} select project_id, report_id,
  'You have multiple rule violations in this report.' || chr(10)
  || 'Task: Fix all violations across all rules with minimal, safe edits.' || chr(10)
  || 'Expected output: short fix plan + grouped patch-ready code edits + tests when needed.' || chr(10) || chr(10)
  || 'Violations:' || chr(10) || string_agg({ISSUE_FLAT}, chr(10) order by pos) as prompt
from enriched group by all""",
)
def fix_prompts_all(i):
    return P.fix_prompts_all(enriched_reports(i))


@query(
    "fix_prompts_grouped",
    f"""with {FIX}, {BY_RULE} select project_id, report_id, string_agg(prompt, chr(10) || chr(10) order by first_pos) as prompt
from by_rule group by all""",
)
def fix_prompts_grouped(i):
    return P.fix_prompts_grouped(enriched_reports(i))


# One issue of each report, under another rule than its own.
FIX_ONE = FIX.replace("from clean c left join", "from chosen c left join").replace(
    "latest as (", "chosen as (select * replace ('EXTRA-' || user_id as rule_id) from clean where issue_id = 'ISSUE-' || report_id || '-1'),\nlatest as ("
)


@query("fix_prompt_of_issue", f"with {FIX_ONE}, {BY_RULE} select project_id, report_id, rule_id, cast(first_pos as bigint) as first_pos, prompt from by_rule")
def fix_prompt_of_issue(i):
    issue = F.concat(F.lit("ISSUE-"), "report_id", F.lit("-1"))
    rule = F.concat(F.lit("EXTRA-"), F.regexp_replace("project_id", "proj-", ""))
    chosen = jobs.fix_issues(report_violations(i), rules(i, *P.RULE_COLUMNS), configs(i, *LIST_KEYS), issue, rule)
    return P.fix_prompts_by_rule(chosen).withColumn("first_pos", F.col("first_pos").cast("bigint"))


# --- localisation ---------------------------------------------------------------------------

_TEMPLATE = "(select p_partkey as k, 'templates/' || p_partkey || '.md' as path, case p_partkey % 3 when 0 then 'zh-CN' when 1 then 'en' else 'fr' end as wanted from part) t"


@query(
    "locale_fallback",
    f"with {LOCALES} select path, wanted as wanted_locale, {_LOCALE_OF.format('wanted')} as locale from {_TEMPLATE}",
)
def locale_fallback(i):
    return P.resolve_locales(i.rule_templates().select("path", "locale"), i.locales())


@query(
    "localize_keys",
    f"""with {LOCALES}, x as (select path, {_LOCALE_OF.format('wanted')} as locale, 'rule.fix.' || (k % 4) as key from {_TEMPLATE})
select path, locale, key, {_lookup('x.locale', 'x.key')} as text from x""",
)
def localize_keys(i):
    wanted = i.rule_templates().select("path", "locale", F.regexp_extract("content", r"fixKey: (\S+)", 1).alias("key"))
    known = i.locales()
    named = lookup_join(P.resolve_locales(wanted, known).drop("wanted_locale"), P.locale_maps(known), "locale")
    return named.select("path", "locale", "key", P.localize(F.col("texts"), F.col("key")).alias("text"))


def _line(text: str) -> str:
    return f"{text} || chr(10) || "


@query(
    "localized_rules",
    f"""with {LOCALES}, x as (select path, k, {_LOCALE_OF.format('wanted')} as locale, 'desc.' || (k % 3) as d, 'rule.fix.' || (k % 4) as f from {_TEMPLATE})
select path, locale,
  {_line("'extends: ../new-base.md'")} {_line("'### RULE: TPL-' || k")} {_line("'  title: ' || " + _lookup("x.locale", "'rule.title'"))}
  {_line("' description:'")} {_line("'   - ' || " + _lookup("x.locale", "'desc.a'"))} {_line("'   - ' || " + _lookup("x.locale", "x.d"))}
  case when locale = 'en' then 'Why: intent: intent' else 'intent: intent' end || chr(10) ||
  {_line("'fix: ' || " + _lookup("x.locale", "x.f"))} {_line("'prompt:'")} {_line("'  violation: ' || " + _lookup("x.locale", "'rule.title'"))}
  {_line("'  requirement: rule.none'")} {_line("'- plain'")} {_line("'  violation: kept'")} '' as content
from x""",
)
def localized_rules(i):
    known = i.locales()
    documents = P.resolve_locales(i.rule_templates(), known).drop("wanted_locale")
    return P.localized_rules(documents.withColumn("extends_path", F.lit("../new-base.md")), P.locale_maps(known))


_CONFIG_LOCALE = "case c % 3 when 0 then 'zh-CN' else 'en' end"
# Configurations with their keys in order, as a VARIANT prints them.
LOCALIZED_CONFIGS = f"""
  select 'projects/proj-' || c || '/project.json' as path, '{{"detectOptions":{{"include":["lib/**"]}},"enabledRuleIds":['
    || case when c % 19 = 3 then '' else '"PART-' || c || '","EXTRA-' || c || case when c % 4 = 0 then '' else '","GHOST-' || (c % 5) || '","PART-' || c end || '"' end || '],'
    || case when c % 17 = 3 then '"exceptions":{{"EXTRA-*":["src/x/**"],"X-1":[5],"Y-1":"no"}},' when c % 17 = 4 then ''
            else '"exceptions":{{"BASE-1":["native/**"],"EXTRA-*":["src/x/**","gen/**"]}},' end
    || '"extends":"./base-config.json",'
    || case when c % 8 = 6 then '"prompt":{{"promptTemplates":{{"auditSystem":"own system","auditUser":"own user"}}}},'
            else '"prompt":{{"promptTemplates":{{"auditSystem":"' || {_lookup(_CONFIG_LOCALE, "'prompt.audit.system'")} || '","repairUser":"'
              || {_lookup(_CONFIG_LOCALE, "'prompt.repair.user'")} || '"}},"style":"strict"}},' end
    || case when c % 7 = 3 and c % 2 = 0 then '' else '"scopes":["extra","' || case c % 3 when 0 then 'ECONOMY' when 1 then 'SMALL' else 'base' end || '"],' end
    || case when c % 9 = 4 then '"stack":null,' when c % 9 = 5 then '' else '"stack":"' || c_mktsegment || '",' end
    || case when c % 13 = 5 then '"thresholds":{{"maxLines":null,"zMax":"80"}}' when c % 7 = 3 and c % 4 = 1 then '"thresholds":[1]'
            else '"thresholds":{{"ratio":0.25,"zMax":' || (c % 100) || '}}' end || '}}' as content
  from (select *, c_custkey as c from customer) x
  union all
  select 'nations/' || n_nationkey || '.json', '{{"detectOptions":{{"exclude":["dist/**"],"include":["src/**"]}},"enabledRuleIds":["BASE-1"'
    || case when n_nationkey % 5 = 0 then ',"NATION-0"' else '' end || '],"exceptions":{{"EXTRA-*":["gen/**","old/**"],"SECRET-*":["gen/**"]}},'
    || '"pathAliases":{{"@nation":"src/n"}},"scopes":["base","brand","SMALL"],"stack":"' || n_name || '","thresholds":{{"maxParams":5,"zMax":80}},"version":"2.0"}}'
  from nation
  union all
  select 'regions/' || r_regionkey || '.json', '{{"detectOptions":{{"exclude":["tmp/**"],"include":["src/**","public/**"]}},"enabledRuleIds":["BASE-1"],'
    || '"pathAliases":{{"@root":"src"}},"rulesFile":"house-rules.md","severityThreshold":"WARN","stack":"' || r_name || '","thresholds":{{"maxParams":9,"ratio":0.5}},"version":"1.0"}}'
  from region"""


@query("localized_config", f"with {LOCALES} {LOCALIZED_CONFIGS}")
def localized_config(i):
    known = i.locales()
    wanted = F.regexp_extract("content", r'"defaultLocale":"([^"]+)"', 1)
    named = lookup_join(P.resolve_locales(i.configs().withColumn("locale", wanted), known), P.locale_maps(known), "locale")
    own = F.when(F.col("path").startswith("projects/"), F.lit("./base-config.json"))
    made = named.select("path", P.localized_config(F.col("content"), F.col("texts"), own).alias("content"))
    return made.select("path", F.to_json(F.parse_json("content")).alias("content"))
