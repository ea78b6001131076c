"""Example-based checks of the operators, on small tables."""

import json

from pyspark.sql import functions as F

from ruleloom.operators import configs as C
from ruleloom.operators import evidence as E
from ruleloom.operators import prompts as P
from ruleloom.operators import quality as Q
from ruleloom.operators import reports as R
from ruleloom.operators import rules as RU
from ruleloom.operators.inheritance import chain_links
from ruleloom.plans import jobs
from ruleloom.session import lookup_join
from ruleloom.sources.sinks import as_json

RULE_ROW = "project_id string, rule_pos bigint, rule_id string, regex string, `import` string, include string, `where` string"
PROJECT_ROW = "project_id string, include array<string>, exclude array<string>, exceptions array<struct<key:string,globs:array<string>>>"


def records(spark, files, rules, include=(), exclude=(), exceptions=()):
    files = spark.createDataFrame([("p", *f) for f in files], "project_id string, path string, content string")
    rules = spark.createDataFrame([("p", n, *r) for n, r in enumerate(rules)], RULE_ROW)
    projects = spark.createDataFrame([("p", list(include), list(exclude), list(exceptions))], PROJECT_ROW)
    found = E.evidence_records(E.files_in_scope(files, projects), E.resolve_rules(rules, projects))
    return {r.rule_id: r for r in found.collect()}


def test_each_kind_of_rule(spark):
    job = "open ledger\nfrom 'billing/core/tax'\nopen ledger again; open till\n"
    got = records(
        spark,
        [("jobs/night/close.py", job), ("jobs/readme.rst", job), ("web/close.py", job)],
        [
            ("LEDGER", r"open\s+ledger", None, None, "filePath in jobs/**"),
            ("TAX", None, "billing/*/t?x", None, None),
            ("TAX-WEB", None, "billing/**", None, "importer in web/*"),
            ("TONE", None, None, None, "wherever it reads badly"),
        ],
        include=["**/*.py"],
    )
    assert {k: (r.mode, r.total_matches) for k, r in got.items()} == {
        "LEDGER": ("local-regex", 2), "TAX": ("local-import", 2), "TAX-WEB": ("local-import", 1), "TONE": ("ai-only", 0),
    }
    assert [(m.path, m.line_no) for m in got["LEDGER"].matches] == [("jobs/night/close.py", 1), ("jobs/night/close.py", 3)]
    assert {m.reference for m in got["TAX"].matches} == {"billing/core/tax"}
    assert got["TONE"].note and not got["LEDGER"].note and not got["TONE"].matches


def test_exceptions_by_id_and_wildcard(spark):
    got = records(
        spark,
        [("lab/a.sql", "drop table t"), ("lab/b.sql", "drop table u"), ("prod/c.sql", "drop table v"), ("prod/d.sql", "select 1")],
        [("DDL-7", "drop table", None, None, None), ("DDL-8", "drop table", None, None, "filePath in prod/*"), ("STYLE", None, None, None, None)],
        exceptions=[("DDL-*", ["lab/a.*"]), ("DDL-?", ["**"]), ("DDL-7", ["lab/a.*", "lab/b.sql"]), ("STYLE", ["prod/**"])],
    )
    assert (got["DDL-7"].total_matches, got["DDL-7"].exception_patterns, got["DDL-7"].suppressed_file_count) == (1, ["lab/a.*", "lab/b.sql"], 2)
    assert (got["DDL-8"].total_matches, got["DDL-8"].suppressed_file_count) == (1, 0)
    assert got["STYLE"].suppressed_file_count == 2


def test_white_space_and_targets_of_the_rule_language(spark):
    got = records(
        spark,
        [("a.ts", 'import\u00a0"platform/z"\nfrom "platform/y"\n'), ("b.c", "#include\u3000<sys/q.h>")],
        [("BACK", None, ".\\platform\\**", None, None), ("FRONT", None, "./platform/**", None, None), ("SYS", None, None, "sys/*", None), ("GAP", r"t\s\"p", None, None, None)],
    )
    assert {k: r.total_matches for k, r in got.items()} == {"BACK": 2, "FRONT": 2, "SYS": 1, "GAP": 1}


def test_pattern_that_cannot_run_is_told_apart(spark):
    rules = spark.createDataFrame([("p", 0, "ODD", "x\\0", None, None, None), ("p", 1, "BAD", "(", None, None, None)], RULE_ROW)
    projects = spark.createDataFrame([("p", [], [], [])], PROJECT_ROW)
    files = spark.createDataFrame([("p", "a", "x")], "project_id string, path string, content string")
    resolved = E.resolve_rules(rules, projects)
    assert [r.rule_id for r in E.invalid_regex_hits(files, resolved).collect()] == ["BAD"]
    assert [r.rule_id for r in E.untranslatable_patterns(resolved).collect()] == ["ODD"]


def test_hit_details(spark):
    lines = "\r\n".join(f"x{n} hit hit" for n in range(12)) + "\n"
    got = records(
        spark,
        [("b.c", "#include <sys/a.h> #include \"sys/b.h\"\n#include<sys/c.h>\n"), ("a.txt", lines), ("z.txt", "")],
        [
            ("HIT", "hit", None, None, None),
            ("INC", None, None, "sys/*.h", "anything else"),
            ("BOTH", "x0", "sys/**", None, None),
            ("BAD", "(", None, None, "filePath in *.txt"),
            ("END", "^$", None, None, "filePath in z.txt"),
        ],
    )
    assert got["HIT"].total_matches == 12
    assert [m.line_no for m in got["HIT"].matches] == list(range(1, 11))
    assert [m.reference for m in got["INC"].matches] == ["sys/a.h", "sys/b.h"]
    assert got["BOTH"].mode == "local-regex" and got["BOTH"].total_matches == 1
    assert [(m.path, m.line_no, m.note) for m in got["BAD"].matches] == [("a.txt", 1, "invalid-regex"), ("z.txt", 1, "invalid-regex")]
    assert got["BAD"].matches[0].snippet == "Invalid regex pattern: ("
    assert got["END"].total_matches == 1


def test_import_order_within_line(spark):
    files = spark.createDataFrame(
        [("p", "a.ts", 'require("r"); import "i"; export * from \'f\'; import("d")')], "project_id string, path string, content string"
    )
    refs = E.extract_references(files).orderBy("ord").collect()
    assert [r.reference for r in refs] == ["f", "i", "r"]


def test_many_path_conditions(spark):
    files = [(f"d{n}/a.txt", "word") for n in range(50)]
    rules = [(f"R{n}", "word", None, None, f"filePath in d{n}/*") for n in range(50)]
    got = records(spark, files, rules)
    assert {r.total_matches for r in got.values()} == {1}


def config_of(spark, docs, start):
    table = spark.createDataFrame([(p, json.dumps(d)) for p, d in docs.items()], "path string, content string")
    starts = spark.createDataFrame([(start,)], "start string")
    chains = C.config_chains(table, starts)
    return chains, C.effective_configs(chains)


def test_three_configs_merge(spark):
    docs = {
        "all.json": {
            "version": "9", "severityThreshold": "INFO", "scopes": ["core", "edge"], "thresholds": {"depth": 4, "width": 100},
            "exceptions": {"NET-?": ["vendor/**"]}, "detectOptions": {"include": ["lib/**"], "maxBytes": 10, "follow": True},
            "prompt": {"tone": "calm", "promptTemplates": {"auditUser": "look"}}, "rulesFile": "team.md",
        },
        "teams/pay.json": {
            "extends": "../all.json", "scopes": ["edge", "pay"], "thresholds": {"width": 80}, "enabledRuleIds": ["NET-1"], "version": None,
            "exceptions": {"NET-?": ["vendor/**", "tmp/*"], "PAY": ["old/*"]}, "detectOptions": {"exclude": ["out/**"], "follow": False},
        },
        "teams/eu/tax.json": {
            "extends": "./../pay.json", "pathAliases": {"~": "src"}, "enabledRuleIds": ["PAY", "NET-1"], "detectOptions": {"include": ["eu/**", "lib/**"]},
            "prompt": {"language": "fr", "promptTemplates": {"repairUser": "mend"}}, "stack": "sql",
        },
    }
    _, merged = config_of(spark, docs, "teams/eu/tax.json")
    text = {c: C.entries_text(F.col(c)) for c in ("thresholds", "pathAliases", "promptTemplates", "prompt", "detectOptions")}
    row = merged.withColumns({f"_{c}": t for c, t in text.items()}).withColumn("summary", C.exception_summary(F.col("exceptions"))).first()
    assert (row.stack, row.version, row.severityThreshold, row.rulesFile) == ("sql", None, "INFO", "team.md")
    assert (row.scopes, row.enabledRuleIds) == (["core", "edge", "pay"], ["NET-1", "PAY"])
    assert (row.include, row.exclude) == (["lib/**", "eu/**"], ["out/**"])
    assert (row._thresholds, row._pathAliases, row._promptTemplates) == ("depth=4, width=80", "~=src", "auditUser=look, repairUser=mend")
    assert row._prompt.startswith("tone=calm, promptTemplates=") and row._prompt.endswith("language=fr")
    assert "maxBytes=10" in row._detectOptions and "follow=false" in row._detectOptions
    assert {e.key: e.globs for e in row.exceptions} == {"NET-?": ["vendor/**", "tmp/*"], "PAY": ["old/*"]} and row.summary == "NET-?:2, PAY:1"
    assert "extends" not in [e.key for e in row.plain]


def test_merged_config_names_the_rule_document(spark):
    docs = [("t/base.json", '{"rulesFile":"../rules/team.md"}'), ("t/p/a.json", '{"extends":"../base.json"}'), ("t/q/b.json", '{"rulesFile":""}')]
    places = spark.createDataFrame([("a", "t/p/a.json"), ("b", "t/q/b.json")], "project_id string, config_path string")
    projects = jobs.load_projects(spark.createDataFrame(docs, "path string, content string"), places)
    found = {r.project_id: r.rules_path for r in jobs.rules_paths(projects, "rules.md").collect()}
    assert found == {"a": "t/rules/team.md", "b": "t/q/rules.md"}


def test_unreadable_config_is_a_load_failure(spark):
    rows = [("a.json", '{"extends":"b.json"}'), ("b.json", "{nope"), ("c.json", '{"version":"1","version":"2"}')]
    chains = C.config_chains(spark.createDataFrame(rows, "path string, content string"))
    found = {r.start: (r.status, r.trouble) for r in chains.collect()}
    assert (found["a.json"], found["b.json"]) == (("unreadable", "b.json"), ("unreadable", "b.json"))
    assert {r.start: r.message for r in Q.broken_chains(chains, "config").collect()}["a.json"] == "Failed to load config: not valid JSON: b.json"
    assert [r.version for r in C.effective_configs(chains).collect()] == ["2"]


def test_config_cycle_and_missing_parent(spark):
    chains, _ = config_of(spark, {"a.json": {"extends": "b.json"}, "b.json": {"extends": "./a.json"}}, "a.json")
    row = chains.first()
    assert (row.status, row.trouble, [c.path for c in row.chain]) == ("cycle", "a.json", ["a.json", "b.json"])
    chains, merged = config_of(spark, {"a.json": {"extends": "gone.json"}}, "a.json")
    assert chains.first().status == "missing" and merged.isEmpty()


def test_lone_config_keeps_repeats(spark):
    _, merged = config_of(spark, {"a.json": {"scopes": ["x", "x"]}}, "a.json")
    assert merged.first().scopes == ["x", "x"]


def rule_doc(*blocks):
    return "\n".join(blocks)


COMMON_DOC = rule_doc(
    "preface", "### RULE: LOG-4", "severity: INFO", "scope: ops", "intent: keep logs short", "detect:", '  regex: "print"', "  where: files everywhere",
    "fix: use the logger", "context:", "  - ops/log", "  - 'ops/wiki page'", "prompt:", "  violation: prints", "  solution: log", "  requirement: no print",
)
OWN_DOC = rule_doc(
    "extends: ../shared/common.md", "### RULE: MAIL-2", "severity: FATAL", "scope: mail", "detect:", "  import: smtp/**", "fix: use the queue", "",
    "### RULE: LOG-4", "severity: WARN", "context:", "  - own/log",
)


def test_rule_documents_extend_each_other(spark):
    docs = spark.createDataFrame([("shared/common.md", COMMON_DOC), ("mail/own.md", OWN_DOC)], "path string, content string")
    chains = RU.rule_chains(docs, spark.createDataFrame([("mail/own.md",)], "start string"))
    assert {(x.depth, x.path) for x in chain_links(chains).collect()} == {(0, "mail/own.md"), (1, "shared/common.md")}
    rules = RU.effective_rules(chains).orderBy("rule_pos")
    assert [(r.rule_id, r.severity, r.detect_kind) for r in rules.collect()][:2] == [("LOG-4", "INFO", "regex"), ("MAIL-2", "FATAL", "import")]
    assert rules.first().context == ["ops/log", "ops/wiki page"]
    table = rules.withColumn("project_id", F.lit("p"))
    last = {r.rule_id: (r.severity, r.context) for r in RU.latest_rules(table).collect()}
    assert last == {"LOG-4": ("WARN", ["own/log"]), "MAIL-2": ("FATAL", [])}
    assert [r.rule_id for r in RU.duplicate_rules(table).collect()] == ["LOG-4"]


def test_rule_grammar_corners(spark):
    doc = rule_doc(
        "extends:", "extends: 'a.md'", "extends: b.md", "  ### RULE:  X-1 ", "extends: c.md", "severity: 'WARN\"", "detect:",
        "  severity: inner", "    deep: \"1:2\"", "", "  no colon here", "---", "  stray: y", "detect:", "  regex: \"q\"",
        "prompt: ignored", "context:", "  - 'a b'", "  -x", "fix: one", "fix: two",
    )
    docs = spark.createDataFrame([("d/r.md", doc)], "path string, content string")
    assert RU.rule_documents(docs).first().parent == "d/a.md"
    rule = RU.parse_rules(docs).first()
    assert (rule.rule_id, rule.severity, rule.fix, rule.context) == ("X-1", "'WARN\"", "two", ["a b"])
    assert rule.detect == {"regex": "q"} and rule.prompt == {}


RULE_META = "project_id string, rule_pos bigint, rule_id string, severity string, scope string, intent string, fix string, detect map<string,string>, prompt map<string,string>, context array<string>"
PROMPT = {"violation": "v", "requirement": "r", "solution": "s"}


def test_rule_checks_in_order(spark):
    rows = [("p", 0, "LOG-4", "LOUD", "mail", "short logs", "", {"regex": "x"}, PROMPT, []), ("p", 1, "MAIL-2", "INFO", "ops", "i", "f", {}, {"violation": "v"}, [])]
    rules = spark.createDataFrame(rows, RULE_META)
    projects = spark.createDataFrame([("p", ["LOG-4", "GONE-1", "GONE-2"], ["ops"])], "project_id string, enabledRuleIds array<string>, scopes array<string>")
    found = Q.rule_findings(rules, projects)
    messages = [(r.level, r.message) for r in found.orderBy("seq").collect()]
    assert [m for _, m in messages if "LOG-4" in m][-2:] == [
        "Rule 'LOG-4' has invalid severity 'LOUD'.", "Rule 'LOG-4' uses scope 'mail' that is not declared in project.json.",
    ]
    assert ("warn", "Rule 'MAIL-2' is defined but not enabled in project.json.") in messages
    assert [m for _, m in messages if "GONE" in m] == [f"enabledRuleIds references missing rule 'GONE-{n}'." for n in (1, 2)]
    assert Q.without_errors(projects, found).isEmpty()


def test_clean_subjects_pass(spark):
    subjects = spark.createDataFrame([("a",), ("b",), ("c",)], "project_id string")
    findings = spark.createDataFrame([("b", "warn"), ("c", "error"), ("c", "warn")], "project_id string, level string")
    found = {r.project_id: (r.errors, r.warnings, r.passed) for r in Q.finding_summary(subjects, findings).collect()}
    assert found == {"a": (0, 0, True), "b": (0, 1, True), "c": (1, 1, False)}
    assert {r.project_id for r in Q.finding_summary(subjects, findings, strict=True).where("passed").collect()} == {"a"}


def test_projects_without_readable_rules_are_not_audited(spark):
    table = spark.createDataFrame([("a.json", "{}"), ("b.json", "{}")], "path string, content string")
    projects = jobs.load_projects(table, spark.createDataFrame([("a", "a.json"), ("b", "b.json")], "project_id string, config_path string"))
    docs = spark.createDataFrame([("a.md", "### RULE: X"), ("b.md", "extends: gone.md")], "path string, content string")
    places = spark.createDataFrame([("a", "a.md"), ("b", "b.md")], "project_id string, rules_path string")
    rules = jobs.load_rules(docs, places).where("false")
    files = spark.createDataFrame([], "project_id string, path string, content string")
    locales = spark.createDataFrame([("en", "k", "t")], "locale string, key string, text string")
    job = jobs.audit(files, projects, rules, locales, places.where("project_id = 'a'"))
    assert [r.project_id for r in job["projects"].collect()] == ["a"]


def report_row(spark, *raws):
    rows = [("p", n, json.dumps(raw)) for n, raw in enumerate(raws, 1)]
    return R.report_violations(spark.createDataFrame(rows, "project_id string, report_id bigint, raw string"))


def report_of(spark, raw):
    reports = spark.createDataFrame([("p", 1, json.dumps(raw))], "project_id string, report_id bigint, raw string")
    found = R.normalize_issues(R.report_issues(reports))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.violation_rows(report_row(spark, raw)).collect()))
    return found


def test_old_field_names(spark):
    found = report_of(
        spark,
        {"findings": "none", "results": [
            {"code": "NET-1", "issueId": "n9", "severity": "Error", "filePath": "net/dial.go", "lineNumber": 31, "reason": "dials out", "repair": {"suggestion": "proxy", "prompt": "route it"}},
            {"id": "PAY", "issue_id": 17, "severity": "critical", "codeSnippet": "x=1", "detect": "detect.import"},
        ]},
    )
    a, b = found.orderBy("pos").collect()
    assert (a.issue_id, a.rule_id, a.severity, a.file, a.line, a.description) == ("n9", "NET-1", "FATAL", "net/dial.go", 31.0, "dials out")
    assert (a.fix_suggestion, a.repair_prompt, a.evidence_source) == ("proxy", "route it", "ai-only")
    assert (b.issue_id, b.rule_id, b.snippet, b.evidence_source) == ("17", "PAY", "x=1", "local-import")


def test_reports_with_and_without_issues(spark):
    rows = [("p", 1, "[]"), ("p", 2, '{"project":{"a":1}}'), ("p", 3, "{bad"), ("p", 4, '[{"issueId":"n1","ruleId":"r","severity":"low"},{"severity":"WARN"}]')]
    reports = spark.createDataFrame(rows, "project_id string, report_id bigint, raw string")
    counts = {r.report_id: (r.total, r.fatal, r.warn, r.info) for r in R.severity_summary(reports).collect()}
    assert {k: v[0] for k, v in counts.items()} == {1: 0, 2: 0, 4: 2} and counts[4][2] == 1
    form = {r.report_id: json.loads(r.json) for r in as_json(R.normalized_reports(reports), *R.REPORT_KEY).collect()}
    assert form[2]["project"] == {"a": 1} and form[1]["violations"] == [] and form[1]["summary"]["total"] == 0 and form[1]["generatedAt"] is None
    assert list(form[4]["violations"][0]) == [
        "issueId", "ruleId", "severity", "confidence", "file", "line", "snippet", "description", "fixSuggestion", "repairPrompt", "evidence", "context",
    ]
    assert form[4]["violations"][0]["evidence"] == {"source": "ai-only", "matchedBy": "unknown"}
    job = jobs.validate_reports(reports)
    assert {r.report_id: (r.errors, r.passed) for r in job["status"].collect()} == {1: (0, True), 2: (0, True), 4: (3, False)}
    assert {r.report_id: (r.total, r.fatal, r.warn, r.info) for r in job["summary"].collect()} == counts


def test_faults_of_a_report(spark):
    found = report_row(spark, {"issues": [{"issueId": "t", "ruleId": "A"}, {"ruleId": "A"}, {"issueId": "t", "severity": "meh", "fixPrompt": "p"}]})
    messages = [(r.level, r.message) for r in Q.report_findings(found).orderBy("seq").collect()]
    assert ("error", "Violation for rule 'A' is missing issueId.") in messages
    assert ("error", "Duplicate issueId 't' found in report.") in messages and ("error", "Violation 't' has invalid severity 'MEH'.") in messages
    assert [m for m in messages if m[0] == "warn"] == [("warn", "Violation 't' is missing repairPrompt."), ("warn", "Violation 'UNKNOWN-ISSUE' is missing repairPrompt.")]


def test_selection_within_reports(spark):
    one = [{"issueId": "a", "ruleId": "X"}, {"issueId": "b", "ruleId": "Y"}, {"issueId": "b", "ruleId": "X", "file": "later"}, {"ruleId": "X"}]
    rows = report_row(spark, one, [{"issueId": "c", "ruleId": "Y"}], [])
    told = lambda found: {r.report_id: [(v.issue_id, v.rule_id, v.pos) for v in r.violations] for r in found.collect()}
    assert told(R.select_rule(rows, F.lit("X"))) == {1: [("a", "X", 0), ("b", "X", 2), ("UNKNOWN-ISSUE", "X", 3)]}
    assert told(R.select_issue(rows, F.lit("b"))) == {1: [("b", "Y", 1)]}
    assert told(R.select_issue(rows, F.lit("b"), F.lit("Z"))) == {1: [("b", "Z", 1)]}
    assert told(R.select_issue(rows, F.lit("b"), F.lit(""))) == {1: [("b", "Y", 1)]}
    assert told(R.select_issue(rows, F.lit("none"))) == {}
    assert [(r.issue_id, r.pos) for r in R.duplicate_issues(rows).collect()] == [("b", 2)]
    grouped = {(r.report_id, r.rule_id): (r.n_issues, r.first_pos) for r in R.issues_grouped(rows).collect()}
    assert grouped == {(1, "X"): (3, 0), (1, "Y"): (1, 1), (2, "Y"): (1, 0)}


def test_checks_of_reports_shuffle_nothing(spark):
    rows = report_row(spark, [{"issueId": "a", "ruleId": "X"}])
    for found in (Q.report_findings(rows), Q.report_status(rows), Q.clean_reports(rows), R.duplicate_issues(rows), R.issues_grouped(rows), R.select_issue(rows, F.lit("a"))):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_texts_for_one_issue_under_another_rule(spark):
    rows = report_row(spark, [{"issueId": "a", "ruleId": "X", "message": "m", "repairPrompt": "p"}, {"issueId": "b", "ruleId": "Y", "message": "n"}])
    rules = spark.createDataFrame(
        [("p", 0, n, "WARN", "s", f"intent {n}", None, [], {}) for n in ("X", "Z")],
        "project_id string, rule_pos bigint, rule_id string, severity string, scope string, intent string, fix string, context array<string>, prompt map<string,string>",
    )
    projects = spark.createDataFrame([("p",)], "project_id string")
    own = P.fix_prompts_by_rule(jobs.fix_issues(rows, rules, projects, F.lit("b"))).collect()
    assert [(r.rule_id, r.first_pos) for r in own] == [("Y", 1)] and "Rule metadata for Y was not found" in own[0].prompt
    other = P.fix_prompts_by_rule(jobs.fix_issues(rows, rules, projects, F.lit("b"), F.lit("Z"))).collect()
    assert [r.rule_id for r in other] == ["Z"] and "You violated rule Z." in other[0].prompt and "intent Z" in other[0].prompt
    ruled = P.fix_prompts_all(jobs.fix_issues(rows, rules, projects, rule_id=F.lit("X"))).collect()
    assert len(ruled) == 1 and "IssueId: a" in ruled[0].prompt and "IssueId: b" not in ruled[0].prompt


def test_a_given_locale_goes_before_the_configured_one(spark):
    table = spark.createDataFrame([("a.json", '{"i18n":{"defaultLocale":"fr"}}')], "path string, content string")
    projects = jobs.load_projects(table, spark.createDataFrame([("a", "a.json")], "project_id string, config_path string"))
    rules = jobs.load_rules(spark.createDataFrame([("a.md", "")], "path string, content string"), spark.createDataFrame([("a", "a.md")], "project_id string, rules_path string"))
    files = spark.createDataFrame([], "project_id string, path string, content string")
    locales = spark.createDataFrame([(x, P.AUDIT_KEYS[0], f"say {x}") for x in ("en", "fr", "de")], "locale string, key string, text string")
    for given, said in ((None, "fr"), ("", "fr"), ("de", "de"), ("xx", "en")):
        assert jobs.audit(files, projects, rules, locales, locale=given)["prompts"].first().prompt.startswith(f"say {said}\n")


def test_falsy_cascades(spark):
    found = report_of(
        spark,
        [
            {"issueId": 0, "issue_id": False, "line": "12", "row": 8, "confidence": 7, "severity": 3, "context": [1, "a"]},
            {"issueId": "0", "line": 0, "row": 2.5, "confidence": "1", "repairPrompt": "", "prompt": "x", "severity": " warn"},
            {"issueId": 12, "confidence": -1, "context": "c", "assets": ["b"], "evidence": {"source": "mine", "matchedBy": 5}, "detect": "detect.include"},
            "text",
        ],
    )
    a, b, c, d = found.orderBy("pos").collect()
    assert (a.issue_id, a.line, a.confidence, a.severity, a.context) == ("UNKNOWN-ISSUE", None, 1.0, "INFO", ["1", "a"])
    assert (b.issue_id, b.line, b.confidence, b.repair_prompt, b.severity) == ("0", 2.5, None, "", " WARN")
    assert (c.issue_id, c.confidence, c.context, c.evidence_source, c.matched_by) == ("12", 0.0, ["b"], "mine", "detect.include")
    assert (d.issue_id, d.rule_id) == ("UNKNOWN-ISSUE", "UNKNOWN-RULE")


def test_audit_text_parts(spark):
    rules = spark.createDataFrame(
        [("p", 0, "LOG-4", "WARN", "ops", "Short logs", "Cut", {"regex": "print\\(", "where": "filePath in ops/**"}, PROMPT, ["ops/wiki"])],
        RULE_META,
    )
    section = P.rule_sections(rules).first().section
    assert section.startswith("### LOG-4\n- severity: WARN") and section.endswith("- context assets: ops/wiki")
    assert "- detect: regex=print\\(, where=filePath in ops/**" in section
    assert P.evidence_sections(rules, spark.createDataFrame(
        [("p", 0, "OTHER", "ai-only", [], 0, [], 0, None)],
        "project_id string, rule_pos bigint, rule_id string, mode string, matches array<struct<path:string,line_no:int,snippet:string>>, "
        "total_matches bigint, exception_patterns array<string>, suppressed_file_count bigint, note string",
    )).first().section == "- LOG-4: no evidence collected"


def test_localized_document(spark):
    texts = F.create_map(*[F.lit(x) for x in ("k", "Text", "a", "A")])
    doc = "titleKey: k\n  descriptionKeys:\n- a\n  - zz\nend\npromptKeys:\n violation: a\nother: 1\n solution: a"
    got = spark.range(1).select(P.localized_document(F.lit(doc), texts)).first()[0]
    assert got == "title: Text\n  description:\n    - A\n    - zz\nend\nprompt:\n  violation: A\nother: 1\n solution: a"


def test_localized_config(spark):
    content = {"extends": "../x", "i18n": {"a": 1}, "n": None, "prompt": {"style": "s", "promptTemplateKeys": {"auditSystem": "k", "repairUser": "q"}}}
    texts = F.create_map(F.lit("k"), F.lit("Text"))
    one = lambda ext: json.loads(spark.range(1).select(P.localized_config(F.lit(json.dumps(content)), texts, F.lit(ext).cast("string"))).first()[0])
    want = {"n": None, "prompt": {"style": "s", "promptTemplates": {"auditSystem": "Text", "repairUser": "q"}}}
    assert one(None) == want
    assert one("../base") == {"extends": "../base", **want}


def test_few_keys_are_looked_up_without_a_shuffle_by_key(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 10 > 0, "en").when(F.col("id") > 0, "fr").alias("locale"), F.lit("text").alias("content"))
    known = P.locale_maps(spark.createDataFrame([("en", "k", "one"), ("en", "l", "two"), ("fr", "k", "un"), ("zh", "k", "-")], "locale string, key string, text string"))
    for bound in (1 << 20, 0):
        found = lookup_join(rows, known, "locale", bound)
        assert not bound or "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        counted = {r.locale: r.n for r in found.groupBy("locale").agg(F.count_if(F.col("texts")["k"].isNotNull()).alias("n")).collect()}
        assert counted == {"en": 1800, "fr": 199, None: 0}


def test_no_plan_deals_rows_by_locale(spark):
    locales = spark.createDataFrame([("en", "k", "one"), ("fr", "k", "un")], "locale string, key string, text string")
    documents = spark.createDataFrame([("a", "titleKey: k", "fr"), ("b", "titleKey: k", "xx")], "path string, content string, locale string")
    named = P.resolve_locales(documents, locales).drop("wanted_locale")
    done = P.localized_rules(named, P.locale_maps(locales))
    assert "hashpartitioning" not in done._jdf.queryExecution().executedPlan().toString()
    assert {r.path: (r.locale, r.content) for r in done.collect()} == {"a": ("fr", "title: un"), "b": ("en", "title: one")}
