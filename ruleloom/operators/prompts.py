"""Audit and repair texts as datasets, and localisation of rule and config templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions import variants as V
from ruleloom.functions.entries import grouped
from ruleloom.functions.text import BLANK, bind, first_text, fold_out, indent_block, joined_or_none, lines_of, made_once, replace_first, trim_blank
from ruleloom.operators.configs import entries_text, entry_value, exception_summary, object_entries, raw_field
from ruleloom.operators.evidence import MATCHES_SHOWN
from ruleloom.operators.reports import REPORT_KEY, location_text
from ruleloom.session import broadcast_if_small, lookup_join, shuffled, staged

# Wording of the audit text, in output order.
AUDIT_KEYS = ("prompt.audit.system", "prompt.audit.user")
SUMMARY_TITLE = "Project config summary:"
RULES_TITLE = "Resolved rules:"
EVIDENCE_TITLE = "Local evidence candidates:"
OUTPUT_TITLE = "Output requirements:"
SCHEMA_LEAD = "Return strict JSON only with shape: "
OUTPUT_LINES = (
    "- Only report violations at or above the configured severity threshold.",
    "- Each issue must reference exactly one ruleId.",
    "- Use local evidence when available, but do not fabricate certainty if evidence is weak.",
    "- If no violations are found, return an empty violations array.",
)
REPORT_SCHEMA = '{ "version": "1.1", "generatedAt": "ISO-8601", "project": { "cwd": ".", "stack": "optional" }, "summary": { "total": 0, "fatal": 0, "warn": 0, "info": 0 }, "violations": [ { "issueId": "ISSUE-001", "ruleId": "RULE-001", "severity": "FATAL|WARN|INFO", "confidence": 0.0, "file": "src/...", "line": 1, "snippet": "...", "description": "...", "fixSuggestion": "...", "repairPrompt": "...", "evidence": { "source": "local-regex|local-import|ai-only", "matchedBy": "detect.regex|detect.import|detect.include|detect.ast|detect.semantic|unknown" }, "context": ["optional/path"] } ] }'  # noqa: E501
# Wording of the repair texts.
FALLBACK_TASK = "Task: Provide a minimal patch that fixes this violation and keeps existing architecture boundaries intact."
FALLBACK_OUTPUT = "Expected output: short step-by-step fix plan + patch-ready code edits."
NO_SUGGESTION = "Refactor this code path to satisfy the rule intent and architecture boundaries."
RULE_OUTPUT = "Expected output: short fix plan + minimal patch-ready code edits + tests when behavior changes."
ALL_INTRO = (
    "You have multiple rule violations in this report.",
    "Task: Fix all violations across all rules with minimal, safe edits.",
    "Expected output: short fix plan + grouped patch-ready code edits + tests when needed.",
    "",
    "Violations:",
)


def _say(*parts: str | Column) -> Column:
    """One line from texts and columns; a missing value prints as ``undefined``."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("undefined")) for p in parts])


def _lines(*lines: Column | str) -> Column:
    """Join lines, leaving out NULL ones."""
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


# --- audit text -----------------------------------------------------------------------------


def detect_text(detect: Column) -> Column:
    parts = F.transform(F.map_entries(detect), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, F.array_join(parts, ", ")).otherwise("none")


# The labels of the lines below.
def rule_section(rules: DataFrame) -> Column:
    """Text of one rule in the audit prompt."""
    said = lambda key: F.try_element_at("prompt", F.lit(key))
    return _lines(
        _say("### ", F.col("rule_id")),
        _say("- severity: ", F.col("severity")),
        _say("- scope: ", F.col("scope")),
        _say("- intent: ", F.col("intent")),
        _say("- fix direction: ", F.col("fix")),
        _say("- detect: ", detect_text(F.col("detect"))),
        _say("- requirement: ", said("requirement")),
        _say("- violation wording: ", said("violation")),
        _say("- solution wording: ", said("solution")),
        _say("- context assets: ", joined_or_none(F.col("context"))),
    )


def rule_sections(rules: DataFrame) -> DataFrame:
    return rules.select("project_id", "rule_pos", "rule_id", rule_section(rules).alias("section"))


# The labels of the lines below.
def evidence_section() -> Column:
    """Text of one evidence record (P2); NULL ``mode`` means no record."""

    def shown(match: Column) -> Column:
        return F.concat(
            F.lit("  - "), match["path"], F.lit(":"), match["line_no"].cast("string"),
            F.lit("\n    snippet: "), match["snippet"],
        )

    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    record = _lines(
        _say("- ", F.col("rule_id"), " (", F.col("mode"), ", totalMatches=", F.col("total_matches").cast("string"), ")"),
        F.concat(F.lit("  note: "), F.col("note")),
        F.when(some("exception_patterns"), F.concat(F.lit("  exceptions: "), F.array_join("exception_patterns", ", "))),
        F.when(
            F.col("suppressed_file_count") > 0,
            F.concat(F.lit("  suppressed files: "), F.col("suppressed_file_count").cast("string")),
        ),
        F.when(
            some("matches"),
            F.array_join(F.transform(F.slice("matches", 1, MATCHES_SHOWN), shown), "\n"),
        ).otherwise("  matches: none"),
    )
    return F.when(F.col("mode").isNull(), _say("- ", F.col("rule_id"), ": no evidence collected")).otherwise(record)


def rules_with_evidence(rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rules with the last evidence record of their id."""
    fields = [c for c in evidence.columns if c not in ("project_id", "rule_pos", "rule_id")]
    last = evidence.groupBy("project_id", "rule_id").agg(F.max_by(F.struct(*fields), "rule_pos").alias("_record"))
    return rules.join(shuffled(last.select("project_id", "rule_id", "_record.*")), ["project_id", "rule_id"], "left")


def evidence_sections(rules: DataFrame, evidence: DataFrame) -> DataFrame:
    joined = rules_with_evidence(rules.select("project_id", "rule_pos", "rule_id"), evidence)
    return joined.select("project_id", "rule_pos", "rule_id", evidence_section().alias("section"))


# The labels of the lines below.
def config_summary() -> Column:
    """Configuration lines of the audit prompt."""
    return _lines(
        SUMMARY_TITLE,
        _say("- stack: ", F.coalesce(first_text(F.col("stack")), F.lit("unknown"))),
        _say("- severity threshold: ", F.coalesce(first_text(F.col("severityThreshold")), F.lit("INFO"))),
        _say("- include paths: ", joined_or_none(F.col("include"))),
        _say("- exclude paths: ", joined_or_none(F.col("exclude"))),
        _say("- scopes: ", joined_or_none(F.col("scopes"))),
        _say("- thresholds: ", entries_text(F.col("thresholds"))),
        _say("- exception rules: ", exception_summary(F.col("exceptions"))),
    )


def audit_headers(configs: DataFrame, locale_maps: DataFrame) -> DataFrame:
    """First lines of the audit prompt: own templates, else locale texts by key (Q23).

    ``configs`` carries ``locale``; ``locale_maps`` has one ``(locale, texts)`` map per locale.
    An empty template map counts as absent.
    """
    own, keys, texts = F.col("promptTemplates"), F.col("promptTemplateKeys"), F.col("texts")

    def text(place: str, default_key: str) -> Column:
        key = F.coalesce(V.as_text(V.truthy(entry_value(keys, place))), F.lit(default_key))
        localized = F.coalesce(first_text(F.try_element_at(texts, key)), key)
        return F.when(F.size(own) > 0, F.coalesce(V.as_text(entry_value(own, place)), F.lit(""))).otherwise(localized)

    header = _lines(text("auditSystem", AUDIT_KEYS[0]), "", text("auditUser", AUDIT_KEYS[1]), "", config_summary())
    return lookup_join(configs, locale_maps, "locale").select("project_id", header.alias("header"))


def audit_prompts(headers: DataFrame, rule_texts: DataFrame, evidence_texts: DataFrame) -> DataFrame:
    """Audit prompt per project.

    A group holds the sections of one project's rules, which come from its rule documents,
    and at most five matches for each; it does not grow with the corpus.
    """
    part = lambda table, no: table.select("project_id", F.struct(F.lit(no).alias("part"), "rule_pos", "section").alias("piece"))
    pieces = part(rule_texts, 0).unionByName(part(evidence_texts, 1))
    gathered = pieces.groupBy("project_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    chosen = lambda no: F.transform(F.filter("pieces", lambda p: p["part"] == no), lambda p: p["section"])
    body = F.flatten(
        F.array(
            F.array(F.col("header"), F.lit(""), F.lit(RULES_TITLE)),
            F.coalesce(chosen(0), F.array().cast("array<string>")),
            F.array(F.lit(""), F.lit(EVIDENCE_TITLE)),
            F.coalesce(chosen(1), F.array().cast("array<string>")),
            F.array(*[F.lit(x) for x in ("", OUTPUT_TITLE, SCHEMA_LEAD + REPORT_SCHEMA, *OUTPUT_LINES)]),
        )
    )
    return headers.join(shuffled(gathered), "project_id", "left").select("project_id", F.array_join(body, "\n").alias("prompt"))


# --- repair texts ---------------------------------------------------------------------------

#: What :func:`enrich_issues` reads of a rule.
RULE_COLUMNS = ("rule_id", "severity", "scope", "intent", "fix", "context", "prompt")


def enrich_issues(reports: DataFrame, rules: DataFrame) -> DataFrame:
    """Reports whose ``violations`` carry the metadata of their rule as struct ``rule``, NULL when unknown.

    ``rules`` is unique per project and rule id. A project's rules make one map, which meets each of
    its reports once; that side is broadcast when it is small. All texts are then made in the row.
    """
    meta = F.struct("severity", "scope", "intent", "fix", "context", F.try_element_at("prompt", F.lit("requirement")).alias("requirement"))
    maps = rules.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("rule_id", meta.alias("rule")))).alias("_rules"))
    met = reports.join(broadcast_if_small(staged(maps, "rule-maps")), "project_id", "left")
    rule = lambda v: F.try_element_at("_rules", v["rule_id"])
    return met.select(*REPORT_KEY, made_once(F.transform("violations", lambda v: v.withField("rule", rule(v))), "violations"))


def merged_context(issue_context: Column, rule_context: Column) -> Column:
    """Ordered distinct union as text, NULL when both are empty."""
    empty = F.array().cast("array<string>")
    both = F.array_union(F.coalesce(issue_context, empty), F.coalesce(rule_context, empty))
    return F.when(F.size(both) > 0, F.array_join(both, ", ", "null"))


def suggestion(issue: Column) -> Column:
    return F.coalesce(first_text(issue["fix_suggestion"], issue["rule"]["fix"]), F.lit(NO_SUGGESTION))


# The labels of the lines below.
def fallback_prompt(issue: Column) -> Column:
    """Repair text for an issue whose report gives none (P5)."""
    location, rule = location_text(issue["file"], issue["line"]), issue["rule"]
    labelled = lambda label, text, tail="": F.concat(F.lit(label), F.nullif(text, F.lit("")), F.lit(tail))
    return _lines(
        _say("You violated rule ", issue["rule_id"], "."),
        labelled("Rule intent: ", rule["intent"]),
        labelled("Requirement: ", rule["requirement"]),
        labelled("Location: ", location, "."),
        labelled("Snippet: ", issue["snippet"]),
        _say("Issue: ", issue["description"]),
        FALLBACK_TASK,
        FALLBACK_OUTPUT,
        _say("Suggested direction: ", suggestion(issue)),
        labelled("Rule fix guidance: ", rule["fix"]),
        labelled("Available context: ", merged_context(issue["context"], rule["context"])),
    )


# The labels of the lines below.
def _issue_lines(issue: Column, first: Column, detailed: bool) -> Column:
    """Lines of one issue. Only the per-rule form shows confidence and evidence (Q24)."""
    location = location_text(issue["file"], issue["line"])
    text = F.coalesce(first_text(issue["repair_prompt"]), fallback_prompt(issue))
    confidence = F.concat(F.lit("  Confidence: "), V.number_text(issue["confidence"]))
    evidence = _say("  Evidence: source=", issue["evidence_source"], ", matchedBy=", first_text(issue["matched_by"]))
    return _lines(
        first,
        F.concat(F.lit("  Location: "), location),
        confidence if detailed else F.lit(None).cast("string"),
        _say("  Issue: ", issue["description"]),
        _say("  Suggested direction: ", suggestion(issue)),
        F.concat(F.lit("  Snippet: "), F.nullif(issue["snippet"], F.lit(""))),
        evidence if detailed else F.lit(None).cast("string"),
        "  Repair prompt:",
        indent_block(text, 4),
    )


# The labels of the lines below.
def rule_context(rule_id: Column, rule: Column) -> Column:
    """Rule metadata lines of a repair text."""
    known = lambda c: F.coalesce(first_text(c), F.lit("unknown"))
    lines = _lines(
        _say("- severity: ", known(rule["severity"])),
        _say("- scope: ", known(rule["scope"])),
        _say("- intent: ", known(rule["intent"])),
        _say("- requirement: ", known(rule["requirement"])),
        _say("- fix guidance: ", known(rule["fix"])),
        F.when(F.size(rule["context"]) > 0, _say("- context assets: ", F.array_join(rule["context"], ", "))),
    )
    return F.when(rule.isNull(), _say("- Rule metadata for ", rule_id, " was not found locally.")).otherwise(lines)


def rule_prompt(first: Column, issues: Column) -> Column:
    """Repair text for issues of one rule (P6), ``first`` being the first of them."""
    rule_id = first["rule_id"]
    head = _lines(
        _say("You need to fix violations of rule ", rule_id, "."),
        _say("Task: Fix all reported instances of ", rule_id, " while preserving architecture boundaries and existing behavior."),
        RULE_OUTPUT,
        "",
        "Rule context:",
        rule_context(rule_id, first["rule"]),
        "",
        "Violations:",
    )
    texts = F.transform(issues, lambda v: _issue_lines(v, _say("- IssueId: ", v["issue_id"]), detailed=True))
    return _lines(head, F.array_join(texts, "\n"))


def _rule_prompts() -> Column:
    """Texts of a report's rules, in first-seen order."""

    def made(first: Column, own: Column) -> Column:
        return F.struct(first["rule_id"].alias("rule_id"), first["pos"].alias("first_pos"), rule_prompt(first, own).alias("prompt"))

    return grouped(F.col("violations"), lambda v: v["rule_id"], made)


def fix_prompts_by_rule(enriched: DataFrame) -> DataFrame:
    """Repair text per report and rule."""
    return enriched.select(*REPORT_KEY, F.inline(_rule_prompts()))


def fix_prompts_by_issue(enriched: DataFrame) -> DataFrame:
    """Repair text per report and issue id; of a repeated id the first issue counts."""

    def made(first: Column, own: Column) -> Column:
        return F.struct(first["rule_id"].alias("rule_id"), first["issue_id"].alias("issue_id"), rule_prompt(first, F.array(first)).alias("prompt"))

    return enriched.select(*REPORT_KEY, F.inline(grouped(F.col("violations"), lambda v: v["issue_id"], made)))


def fix_prompts_all(enriched: DataFrame) -> DataFrame:
    """Flat repair text over all issues of a report."""
    first = lambda v: _say("- Rule: ", v["rule_id"], " | IssueId: ", v["issue_id"])
    body = F.array_join(F.transform("violations", lambda v: _issue_lines(v, first(v), detailed=False)), "\n")
    return enriched.where(F.size("violations") > 0).select(*REPORT_KEY, _lines(*ALL_INTRO, body).alias("prompt"))


def fix_prompts_grouped(enriched: DataFrame) -> DataFrame:
    """Per-rule repair texts of a report in first-seen order (Q26)."""
    texts = F.array_join(F.transform(_rule_prompts(), lambda p: p["prompt"]), "\n\n")
    return enriched.where(F.size("violations") > 0).select(*REPORT_KEY, texts.alias("prompt"))


# --- localisation ---------------------------------------------------------------------------


def locale_maps(entries: DataFrame) -> DataFrame:
    """``(locale, key, text)`` rows as one map per locale, the form texts are looked up in."""
    pairs = entries.groupBy("locale").agg(F.collect_list(F.struct("key", "text")).alias("pairs"))
    return pairs.select("locale", F.map_from_entries("pairs").alias("texts"))


def resolve_locales(wanted: DataFrame, known: DataFrame, fallback: str = "en") -> DataFrame:
    """Locale each project really gets: the wanted one if it has texts, else the fallback."""
    have = known.select("locale", F.col("locale").alias("_have")).distinct()
    return lookup_join(wanted, have, "locale").select(
        *[c for c in wanted.columns if c != "locale"],
        F.col("locale").alias("wanted_locale"),
        F.coalesce("_have", F.lit(fallback)).alias("locale"),
    )


def localize(texts: Column, key: Column) -> Column:
    """Text of a key, or the key itself."""
    return F.coalesce(first_text(F.try_element_at(texts, key)), key)


# Template words and what they become.
LINE_KEYS = {"titleKey": "title", "intentKey": "intent", "fixKey": "fix"}
PROMPT_LINE = r"\A(violation|requirement|solution):"


def localized_document(content: Column, texts: Column, extends_path: Column | None = None) -> Column:
    """Rule template with its keys replaced by texts.

    Key lists run until the first line of another form, so lines are folded in order; the
    state is the open list and its indentation. The fold is linear in the lines.
    """
    state_type = "struct<open:string,pad:string>"

    def line_parts(line: Column) -> Column:
        """What the fold needs to know about a line, computed once."""

        def parts(trimmed: Column) -> Column:
            after = trim_blank(F.regexp_replace(trimmed, r"(?s)\A[^:]*:?", ""))
            pad = F.regexp_extract(line, rf"\A({BLANK}*)", 1)
            return F.struct(line.alias("line"), trimmed.alias("trimmed"), after.alias("after"), pad.alias("pad"))

        return bind(trim_blank(line), parts)

    def step(state: Column, x: Column) -> Column:
        line, trimmed, after, pad = x["line"], x["trimmed"], x["after"], x["pad"]

        def put(opened: str, new_pad: Column, text: Column) -> Column:
            now = F.struct(F.lit(opened).alias("open"), new_pad.alias("pad")).cast(state_type)
            return F.struct(now.alias("state"), F.array(text).alias("more"))

        item = (state["open"] == "list") & trimmed.startswith("- ")
        out = F.when(item, put("list", state["pad"], F.concat(state["pad"], F.lit("  - "), localize(texts, F.substr(trimmed, F.lit(3))))))
        name = trim_blank(F.substring_index(trimmed, ":", 1))
        out = out.when(
            (state["open"] == "prompt") & trimmed.rlike(PROMPT_LINE),
            put("prompt", state["pad"], F.concat(state["pad"], F.lit("  "), name, F.lit(": "), localize(texts, after))),
        )
        for word, becomes in LINE_KEYS.items():
            renamed = replace_first(line, F.lit(word), F.lit(becomes))
            out = out.when(trimmed.startswith(word + ":"), put("", pad, replace_first(renamed, after, localize(texts, after))))
        out = out.when(trimmed.startswith("descriptionKeys:"), put("list", pad, F.concat(pad, F.lit("description:"))))
        out = out.when(trimmed.startswith("promptKeys:"), put("prompt", pad, F.concat(pad, F.lit("prompt:"))))
        if extends_path is not None:
            moved = trimmed.startswith("extends:") & (F.coalesce(extends_path, F.lit("")) != "")
            out = out.when(moved, put("", pad, F.concat(pad, F.lit("extends: "), extends_path)))
        return out.otherwise(put("", pad, line))

    start = F.struct(F.lit("").alias("open"), F.lit("").alias("pad")).cast(state_type)
    return F.array_join(fold_out(F.transform(lines_of(content), line_parts), start, step, "string"), "\n")


def localized_rules(documents: DataFrame, maps: DataFrame) -> DataFrame:
    """``documents`` has ``path, content, locale`` and an optional ``extends_path``."""
    target = F.col("extends_path") if "extends_path" in documents.columns else None
    keep = [c for c in documents.columns if c not in ("content", "extends_path")]
    return lookup_join(documents, maps, "locale").select(
        *keep, localized_document(F.col("content"), F.col("texts"), target).alias("content")
    )


TEMPLATE_PLACES = ("auditSystem", "auditUser", "repairSystem", "repairUser")


def _object_json(entries: Column) -> Column:
    """JSON object text from ``array<struct<key, json>>``."""
    quoted = lambda k: F.substr(F.to_json(F.array(k)), F.lit(2), F.length(F.to_json(F.array(k))) - 2)
    parts = F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["json"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _json_entries(json: Column) -> Column:
    shown = lambda v: F.coalesce(F.to_json(v), F.lit("null"))
    return F.transform(object_entries(json), lambda e: F.struct(e["key"].alias("key"), shown(e["value"]).alias("json")))


def _text_json(text: Column) -> Column:
    wrapped = F.to_json(F.array(text))
    return F.substr(wrapped, F.lit(2), F.length(wrapped) - 2)


def localized_config(content: Column, texts: Column, extends_path: Column) -> Column:
    """Configuration template as a project's own configuration.

    The parent link is replaced or dropped, language settings go, and template keys become texts.
    """
    prompt = raw_field(content, "prompt")
    keys = raw_field(prompt, "promptTemplateKeys")
    one = lambda k, j: F.array(F.struct(F.lit(k).alias("key"), j.alias("json")))
    templates = _object_json(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        V.as_text(entry_value(object_entries(keys), p)).isNotNull(),
                        F.struct(
                            F.lit(p).alias("key"),
                            _text_json(localize(texts, V.as_text(entry_value(object_entries(keys), p)))).alias("json"),
                        ),
                    )
                    for p in TEMPLATE_PLACES
                ]
            )
        )
    )
    other = lambda entries, *drop: F.filter(entries, lambda e: ~e["key"].isin(*drop))
    new_prompt = _object_json(
        F.concat(other(_json_entries(prompt), "promptTemplateKeys", "promptTemplates"), one("promptTemplates", templates))
    )
    entries = _json_entries(content)
    place = F.transform(
        F.filter(entries, lambda e: e["key"] != "i18n"),
        lambda e: F.struct(
            e["key"].alias("key"),
            F.when((e["key"] == "prompt") & keys.isNotNull(), new_prompt)
            .when(e["key"] == "extends", F.coalesce(_text_json(extends_path), F.lit("")))
            .otherwise(e["json"])
            .alias("json"),
        ),
    )
    parent = F.when(
        extends_path.isNotNull() & ~F.exists(entries, lambda e: e["key"] == "extends"),
        one("extends", _text_json(extends_path)),
    ).otherwise(F.array().cast("array<struct<key:string,json:string>>"))
    kept = F.filter(place, lambda e: ~((e["key"] == "extends") & extends_path.isNull()))
    return _object_json(F.concat(kept, parent))
