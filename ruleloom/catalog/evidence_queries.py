"""Queries over the corpus: scoping, matching, evidence. Oracles restate every glob by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.catalog import inputs as I
from ruleloom.catalog.registry import query
from ruleloom.functions.globs import glob_regex, path_matches
from ruleloom.operators import evidence as E
from ruleloom.session import staged
from ruleloom.sources.documents import count_lines

# --- oracle building blocks -----------------------------------------------------------------

_RULE_ROWS = ", ".join(
    "(%d, %s)"
    % (i, ", ".join("cast(null as varchar)" if v is None else "'" + v.replace("'", "''") + "'" for v in rule))
    for i, rule in enumerate(I.RULE_PACK)
)

TRIM_SET = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{TRIM_SET}+|{TRIM_SET}+$', '', 'g')"


SCOPED = rf"""
files as ({I.ALL_FILES}),
scoped as (
  select * from files
  where (project_id like '%7'
         or regexp_matches(path, '^src/(.*/)?[^/]*\.(txt|ts)$') or path like 'public/%'
         or regexp_matches(path, '^(stories|native)/(.*/)?[^/]*\..$'))
    and (project_id like '%3'
         or not (regexp_matches(path, '^src/de/.\.txt$') or regexp_matches(path, '^public/6/[^/]*$')
                 or regexp_matches(path, '^(.*/)?u1./.*$')))),
projects as (select distinct project_id from files),
pack(rule_pos, rule_id, severity, regex, import, include, wher) as (values {_RULE_ROWS}),
rules as (select project_id, pack.* from projects, pack),
rule_files as (
  select r.project_id, r.rule_pos, r.rule_id, r.regex, f.path, f.content,
    case rule_id
      when 'SECRET-101' then path like 'src/de/%' or regexp_matches(path, '^src/en/[^/]*1\.txt$')
      when 'DOM-601' then regexp_matches(path, '^src/ui/u1[^/]*/.*$')
      when 'LIC-201' then path like 'stories/%' or path like 'src/de/%'
      when 'INC-801' then path like 'stories/%' or path like 'src/de/%'
      when 'IMP-701' then regexp_matches(path, '^(.*/)?u4/.*$')
      else false end as suppressed
  from rules r join scoped f using (project_id)
  where case rule_id
      when 'LIC-201' then path like 'src/en/%'
      when 'NET-401' then regexp_matches(path, '^src/(de|fr)/[^/]*\.txt$')
      when 'SCRIPT-501' then regexp_matches(path, '^public/(.*/)?[^/]*\.html$')
      when 'DOM-601' then path like 'src/ui/%'
      when 'IMP-701' then path like 'src/%'
      when 'INC-801' then path like 'native/%'
      when 'BAD-001' then path like 'native/%'
      else true end)"""

LINES = r"""
lines as (
  select project_id, path, generate_subscripts(l, 1) as line_no, unnest(l) as line
  from (select project_id, path, string_split_regex(content, '\r?\n') as l from scoped) x)"""

HITS = rf"""
{LINES},
regex_hits as (
  select rf.project_id, rf.rule_pos, rf.rule_id, rf.path, line_no, 0 as ord,
    coalesce(nullif({sql_trim("line")}, ''), line) as snippet, cast(null as varchar) as reference, cast(null as varchar) as note
  from lines join rule_files rf on rf.project_id = lines.project_id and rf.path = lines.path
  where rf.regex is not null and rf.rule_id <> 'BAD-001' and not suppressed
    and regexp_matches(line, case when rf.rule_id = 'BAD-001' then 'x' else rf.regex end)),
refs as (
  select project_id, path, line_no, line, 'import' as target_kind, generate_subscripts(r, 1) - 1 as ord, unnest(r) as reference
  from (select *, regexp_extract_all(line, 'from\s+["'']([^"'']+)["'']', 1)
                  || regexp_extract_all(line, 'import\s+["'']([^"'']+)["'']', 1)
                  || regexp_extract_all(line, 'require\(\s*["'']([^"'']+)["'']\s*\)', 1) as r from lines) x
  union all
  select project_id, path, line_no, line, 'include', generate_subscripts(r, 1) - 1, unnest(r)
  from (select *, regexp_extract_all(line, '#include\s+[<"]([^>"]+)[>"]', 1) as r from lines) x),
import_hits as (
  select rf.project_id, rf.rule_pos, rf.rule_id, rf.path, line_no, ord,
    coalesce(nullif({sql_trim("line")}, ''), line) as snippet, reference, cast(null as varchar) as note
  from refs join rule_files rf on rf.project_id = refs.project_id and rf.path = refs.path
  where not suppressed
    and ((rf.rule_id = 'IMP-701' and target_kind = 'import' and reference like 'platform/%')
      or (rf.rule_id = 'INC-801' and target_kind = 'include' and regexp_matches(reference, '^sys/[^/]*\.h$')))),
invalid_hits as (
  select project_id, rule_pos, rule_id, path, 1 as line_no, 0 as ord,
    'Invalid regex pattern: ' || regex as snippet, cast(null as varchar) as reference, 'invalid-regex' as note
  from rule_files where rule_id = 'BAD-001' and not suppressed),
hits as (select * from regex_hits union all select * from import_hits union all select * from invalid_hits),
top as (
  select *, row_number() over (partition by project_id, rule_pos order by path, line_no, ord) as rank
  from hits qualify rank <= 10)"""

_HIT_COLUMNS = "project_id, rule_id, path, cast(line_no as bigint) as line_no, cast(ord as bigint) as ord, snippet, reference, note"
_MODE = """case when regex is not null then 'local-regex'
  when import is not null or include is not null then 'local-import' else 'ai-only' end"""

PATTERN_LISTS = """case rule_id
      when 'SECRET-101' then 'src/de/**, src/en/*1.txt' when 'DOM-601' then 'src/ui/u1*/**'
      when 'LIC-201' then 'stories/**, src/de/**' when 'INC-801' then 'stories/**, src/de/**'
      when 'IMP-701' then '**/u4/**' else '' end"""


# --- shared Spark inputs --------------------------------------------------------------------


def corpus(i: I.Inputs):
    """Files in scope and resolved rules. The project list and the rule table are staged:

    they are small, but finding the projects reads a column of every table.
    """
    projects = staged(i.corpus_projects(), "projects")
    resolved = staged(E.resolve_rules(i.pack(projects), projects), "rules")
    return E.files_in_scope(i.files(), projects), resolved


def scoped_files(i: I.Inputs):
    return E.files_in_scope(i.files(), i.corpus_projects())


def resolved_rules(i: I.Inputs):
    projects = i.corpus_projects()
    return E.resolve_rules(i.pack(projects), projects)


def _longs(df, *columns):
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def _hit_view(hits):
    return _longs(hits, "line_no", "ord").select(
        "project_id", "rule_id", "path", "line_no", "ord", "snippet", "reference", "note"
    )


# --- queries --------------------------------------------------------------------------------


@query(
    "corpus_scan",
    rf"""with files as ({I.ALL_FILES})
select project_id, path, length(content) as n_chars, len(string_split_regex(content, '\r?\n')) as n_lines from files""",
)
def corpus_scan(i):
    files = i.files()
    return files.select(
        "project_id", "path", F.length("content").cast("bigint").alias("n_chars"), count_lines(F.col("content")).alias("n_lines")
    )


# Fixed list of probe globs; every path of the corpus is tested against each.
PROBE_GLOBS = {
    "**/*.ts": r"^(.*/)?[^/]*\.ts$",
    "src/?i/**": r"^src/.i/.*$",
    "./public/{0,1}/*": r"^public/(0|1)/[^/]*$",
    "src\\*\\*.txt": r"^src/[^/]*/[^/]*\.txt$",
    "{a,{native,stories}}/**": r"^\{a,(native|stories)\}/.*$",
    "src/**/u{1,2}*/e?9*.ts": r"^src/(.*/)?u(1|2)[^/]*/e.9[^/]*\.ts$",
}


@query(
    "glob_match",
    f"with files as ({I.ALL_FILES}) "
    + " union all ".join(
        f"select '{g}' as glob, project_id, path from files where regexp_matches(path, '{rx}')" for g, rx in PROBE_GLOBS.items()
    ),
)
def glob_match(i):
    # Literals: each glob becomes a regex once, while the plan is made.
    globs = F.inline(F.array(*[F.struct(F.lit(g).alias("glob"), glob_regex(F.lit(g)).alias("regex")) for g in PROBE_GLOBS]))
    probes = i.files().select("project_id", "path", globs)
    return probes.where(path_matches(F.col("path"), F.col("regex"))).select("glob", "project_id", "path")


@query("files_in_scope", f"with {SCOPED} select project_id, path from scoped")
def files_in_scope(i):
    return E.files_in_scope(i.files(), i.corpus_projects()).select("project_id", "path")


@query("rule_file_scope", f"with {SCOPED} select project_id, rule_id, path, suppressed from rule_files")
def rule_file_scope(i):
    scope = E.rule_file_scope(*corpus(i))
    return scope.select("project_id", "rule_id", "path", "suppressed")


@query("suppressed_files", f"with {SCOPED} select project_id, rule_id, path from rule_files where suppressed")
def suppressed_files(i):
    scope = E.rule_file_scope(*corpus(i))
    return scope.where("suppressed").select("project_id", "rule_id", "path")


@query(
    "suppressed_counts",
    f"""with {SCOPED} select r.project_id, r.rule_id, coalesce(n, 0) as suppressed_files
from rules r left join (select project_id, rule_pos, count(*) as n from rule_files where suppressed group by all) c
  on r.project_id = c.project_id and r.rule_pos = c.rule_pos""",
)
def suppressed_counts(i):
    files, resolved = corpus(i)
    return E.suppressed_counts(files, resolved).select("project_id", "rule_id", "suppressed_files")


@query("rule_mode", f"with {SCOPED} select project_id, rule_id, {_MODE} as mode from rules")
def rule_mode(i):
    rules = i.pack(i.corpus_projects())
    return rules.select(
        "project_id", "rule_id", E.rule_mode(F.col("regex"), F.col("import"), F.col("include")).alias("mode")
    )


@query("exception_patterns", f"with {SCOPED} select project_id, rule_id, {PATTERN_LISTS} as patterns from rules")
def exception_patterns(i):
    return resolved_rules(i).select("project_id", "rule_id", F.array_join("exception_patterns", ", ").alias("patterns"))


@query("corpus_lines", f"with {SCOPED}, {LINES} select project_id, path, cast(line_no as bigint) as line_no, line from lines")
def corpus_lines(i):
    return _longs(E.corpus_lines(scoped_files(i)), "line_no")


@query("regex_hits", f"with {SCOPED}, {HITS} select {_HIT_COLUMNS} from regex_hits")
def regex_hits(i):
    return _hit_view(E.regex_hits(*corpus(i)))


@query("invalid_regex_hits", f"with {SCOPED}, {HITS} select {_HIT_COLUMNS} from invalid_hits")
def invalid_regex_hits(i):
    return _hit_view(E.invalid_regex_hits(*corpus(i)))


@query(
    "reference_extract",
    f"""with {SCOPED}, {HITS}
select project_id, path, cast(line_no as bigint) as line_no, target_kind, cast(ord as bigint) as ord, reference from refs""",
)
def reference_extract(i):
    refs = E.extract_references(scoped_files(i))
    return _longs(refs, "line_no", "ord").select("project_id", "path", "line_no", "target_kind", "ord", "reference")


@query("import_hits", f"with {SCOPED}, {HITS} select {_HIT_COLUMNS} from import_hits")
def import_hits(i):
    return _hit_view(E.import_hits(*corpus(i)))


@query(
    "evidence_totals",
    f"""with {SCOPED}, {HITS}
select r.project_id, r.rule_id, {_MODE} as mode, coalesce(n, 0) as total_matches
from rules r left join (select project_id, rule_pos, count(*) as n from hits group by all) c
  on r.project_id = c.project_id and r.rule_pos = c.rule_pos""",
)
def evidence_totals(i):
    files, resolved = corpus(i)
    totals = E.evidence_totals(E.found_in_files(files, resolved, 0), resolved)
    return totals.select("project_id", "rule_id", "mode", "total_matches")


@query("top_matches", f"with {SCOPED}, {HITS} select {_HIT_COLUMNS}, rank from top")
def top_matches(i):
    best = E.top_matches(E.found_in_files(*corpus(i), E.MATCHES_KEPT))
    return _longs(best, "line_no", "ord", "rank").select(
        "project_id", "rule_id", "path", "line_no", "ord", "snippet", "reference", "note", "rank"
    )


@query(
    "evidence_records",
    f"""with {SCOPED}, {HITS}
select r.project_id, r.rule_id, {_MODE} as mode, coalesce(n, 0) as total_matches,
  {PATTERN_LISTS} as exception_patterns, coalesce(s, 0) as suppressed_file_count,
  case when rule_id = 'SEM-901' then 'This rule uses AST or semantic detection and requires AI judgment.' end as note,
  coalesce(m, '') as matches
from rules r
left join (select project_id, rule_pos, count(*) as n from hits group by all) c on r.project_id = c.project_id and r.rule_pos = c.rule_pos
left join (select project_id, rule_pos, count(*) as s from rule_files where suppressed group by all) d on r.project_id = d.project_id and r.rule_pos = d.rule_pos
left join (select project_id, rule_pos,
    string_agg(path || ':' || line_no || ' ' || snippet || coalesce(' -> ' || reference, ''), chr(10) order by rank) as m
  from top group by all) e on r.project_id = e.project_id and r.rule_pos = e.rule_pos""",
)
def evidence_records(i):
    records = E.evidence_records(*corpus(i))
    shown = F.transform(
        "matches",
        lambda m: F.concat(
            m["path"], F.lit(":"), m["line_no"].cast("string"), F.lit(" "), m["snippet"],
            F.coalesce(F.concat(F.lit(" -> "), m["reference"]), F.lit("")),
        ),
    )
    return records.select(
        "project_id", "rule_id", "mode", "total_matches",
        F.array_join("exception_patterns", ", ").alias("exception_patterns"),
        "suppressed_file_count", "note", F.array_join(shown, "\n").alias("matches"),
    )
