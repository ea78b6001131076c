"""Audit inputs derived from the given tables.

Each text is SQL that Spark and DuckDB both run, so that a query and its oracle start from
equal rows. All are projections of whole tables: they grow with the data, and no group of
rows is gathered to build a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.session import dealt

NL = "chr(10)"

TEXT_FILES = """
select source as project_id, concat('src/', lang, '/', doc_id, '.txt') as path, text as content
from documents"""

PAGE_FILES = """
select regexp_extract(url, '^https?://([^/]+)', 1) as project_id,
       concat('public/', page_id % 7, '/', page_id, '.html') as path, html as content
from pages"""

CODE_FILES = """
select concat('p', user_id % 20) as project_id,
       concat(case user_id % 4 when 0 then 'src/ui/u' when 1 then 'src/services/u'
                               when 2 then 'stories/u' else 'native/u' end,
              user_id, '/e', event_id, case user_id % 4 when 3 then '.c' else '.ts' end) as path,
       concat('// ', event_type, case when event_id % 3 = 0 then concat(chr(13), chr(10)) else chr(10) end,
              case event_type
                when 'click'    then concat('import a from "platform/', k, '";')
                when 'view'     then concat('const x = require("lib/', k, '"), y = require("platform/', k, '");')
                when 'error'    then concat(chr(9), '#include <sys/', k, '.h>')
                when 'purchase' then concat('  fetch("/api/', k, '")', chr(9))
                else 'el.innerHTML = v;' end,
              chr(10)) as content
from (select *, regexp_extract(props, '([0-9]+)', 1) as k from events) e"""

ALL_FILES = f"{TEXT_FILES} union all {PAGE_FILES} union all {CODE_FILES}"

# Scope and exceptions of every corpus project, as lists.
CORPUS_PROJECTS = f"""
select project_id,
       case when project_id like '%7' then {{none}} else {{include}} end as include,
       case when project_id like '%3' then {{none}} else {{exclude}} end as exclude
from (select source as project_id from documents
      union select regexp_extract(url, '^https?://([^/]+)', 1) as project_id from pages
      union select concat('p', user_id % 20) as project_id from events) p"""

INCLUDE_GLOBS = ["src/**/*.{txt,ts}", "public/**", "{stories,native}/**/*.?"]
EXCLUDE_GLOBS = ["src/de/?.txt", "public/6/*", "**/u1?/**"]
EXCEPTIONS = [
    ("SECRET-*", ["src/de/**", "src/en/*1.txt"]),
    ("DOM-601", ["src/ui/u1*/**"]),
    ("*C-?01", ["stories/**", "src/de/**"]),
    ("IMP-*", ["**/u4/**"]),
    ("SECRET-1?1", ["**"]),
]

# (rule_id, severity, regex, import, include, where)
RULE_PACK = [
    ("SECRET-101", "FATAL", r"(token|secret|password|api_key)\s*=", None, None, None),
    ("LIC-201", "INFO", "MIT License", None, None, "filePath in src/en/**"),
    ("PII-301", "WARN", r"[A-Za-z0-9_.]+@[A-Za-z0-9_]+\.[A-Za-z]+", None, None, None),
    ("NET-401", "WARN", r"[0-9]{1,3}(\.[0-9]{1,3}){3}", None, None, "filePath in src/{de,fr}/*.txt"),
    ("SCRIPT-501", "WARN", "<script", None, None, "filePath in public/**/*.html"),
    ("DOM-601", "FATAL", "innerHTML", None, None, "filePath in src/ui/**"),
    ("IMP-701", "WARN", None, "platform/**", None, "importer in src/**"),
    ("INC-801", "INFO", None, None, "sys/*.h", "includer in native/**"),
    ("SEM-901", "INFO", None, None, None, "files near the entry point"),
    ("BAD-001", "INFO", r"fetch\\(", None, None, "filePath in native/**"),
]

_KEYED_EVENTS = "(select *, regexp_extract(props, '([0-9]+)', 1) as k from events) e"


def issue_json(i: int) -> str:
    """SQL text of issue ``i`` of an event's report, in four drifted shapes."""
    n = f"((event_id + {i}) % 4)"
    clean = "user_id % 2 = 0"
    issue_id = f"case when {clean} or event_id % 7 > 0 then concat('ISSUE-', event_id, '-', {i}) else 'ISSUE-0' end"
    rule = f"concat(case event_id % 3 when 0 then 'PART-' when 1 then 'EXTRA-' else 'NONE-' end, user_id)"
    return f"""case {n}
      when 0 then concat('{{"issueId":"', {issue_id}, '","ruleId":"', {rule}, '","severity":"warning","confidence":', k, '.5,"file":"u', user_id, '.ts","line":', k, ',"repairPrompt":"fix it', chr(92), 'nthen test","context":["src/a","docs/x.md"],"snippet":"a {i}"}}')
      when 1 then concat('{{"issue_id":"', {issue_id}, '","rule_id":"', {rule}, '","severity":"ERROR","confidence":0.', k, ',"path":"u', user_id, '.ts","row":', k, ',"prompt":{{"repair":"patch"}},"message":"m {i}","suggestion":"swap"}}')
      when 2 then case when {clean}
                  then concat('{{"issueId":"', {issue_id}, '","code":"', {rule}, '","severity":"info","filePath":"u', user_id, '.ts","line":"', k, '","lineNumber":7,"confidence":"high","assets":["src/b"]}}')
                  else concat('{{"issueId":"","code":"", "severity":"oops","filePath":"u', user_id, '.ts","line":"', k, '","lineNumber":7}}') end
      else concat('{{"issueId":"', {issue_id}, '","id":"', {rule}, '","message":"m","lineNumber":0,"row":', k, ',"context":"src/a","evidence":{{"matchedBy":"detect.regex"}},"repair":{{"suggestion":"use b"}}}}') end"""


def report_raw() -> str:
    items = ", ',', ".join(issue_json(i) for i in range(3))
    body = f"concat({items})"
    return f"""
select concat('proj-', user_id) as project_id, event_id as report_id,
  case when event_id % 97 = 5 then '{{bad'
       when event_id % 97 = 6 then '{{"violations":[],"issues":[{{}}]}}'
       when event_id % 97 = 7 then '{{"violations":{{"0":1}},"findings":[{{}}]}}'
       else case event_id % 5
         when 0 then concat('{{"version":"1.0","generatedAt":"2024-01-01T00:00:00Z","project":{{"cwd":"."}},"violations":[', {body}, ']}}')
         when 1 then concat('{{"version":2,"project":"none","issues":[', {body}, ']}}')
         when 2 then concat('{{"violations":"none","results":[', {body}, ']}}')
         else concat('[', {body}, ']') end end as raw
from {_KEYED_EVENTS}"""


REPORTS = report_raw()

_RULE_EXTENDS = f"""case when p_partkey % 50 = 0 then concat('extends: ../proj-', p_partkey + 1, '/house-rules.md', {NL})
            when p_partkey % 50 = 1 then concat('extends: ../proj-', p_partkey - 1, '/house-rules.md', {NL})
            when p_partkey % 50 = 2 then concat('extends: ../../brands/nowhere.md', {NL})
            when p_partkey % 11 = 0 then ''
            else concat('  extends: ', chr(34), './../../brands/', p_brand, '.md', chr(34), {NL}) end"""

PROJECT_RULE_DOCS = f"""
select concat('projects/proj-', p_partkey, case when p_partkey % 23 = 9 and p_partkey % 50 > 2 then '/old-rules.md' else '/house-rules.md' end) as path,
  concat('# Rules', {NL}, {_RULE_EXTENDS}, {NL},
    '### RULE: PART-', p_partkey, {NL},
    'severity: ', case p_size % 4 when 0 then 'FATAL' when 1 then 'WARN' when 2 then 'INFO' else 'HIGH' end, {NL},
    'scope: ', p_type, {NL},
    '  intent: keep ', p_name, ': always ', {NL}, {NL},
    'detect:', {NL}, '  regex: "', p_name, '"', {NL}, '    where: filePath in src/**', {NL},
    case when p_partkey % 5 = 0 then '' else concat('fix: none', {NL}) end,
    'context:', {NL}, '  - src/', p_brand, {NL}, '  note', {NL}, '  - ''docs/', p_name, '.md''', {NL},
    'prompt:', {NL}, '  violation: found ', p_name, {NL}, '  severity: inside', {NL}, '  requirement: no ', p_name, {NL},
    case when p_partkey % 3 = 0 then '' else concat('  solution: swap "', p_name, '"', {NL}) end,
    '---', {NL},
    '  ### RULE: ', case when p_partkey % 13 = 0 then 'PART-' else 'EXTRA-' end, p_partkey, '  ', chr(13), {NL},
    'severity: WARN', {NL}, 'severity: INFO', chr(13), {NL}, 'scope: extra', {NL}, 'intent: ''second rule''', {NL},
    'unknown: word', {NL},
    case when p_partkey % 6 = 0 then '' else concat('detect:', {NL}, '  import: platform/**', {NL}, '  import: lib/**', {NL}, '  ast: x', {NL}) end,
    'prompt:', {NL}, '  violation: v', {NL}, '  requirement: r', {NL}, '  solution: s', {NL}, 'fix: redo') as content
from part"""

BRAND_RULE_DOCS = f"""
select concat('brands/', p_brand, '.md') as path,
  concat('extends: ../base.md', {NL}, '### RULE: BRAND-', p_brand, {NL}, 'severity: WARN', {NL}, 'scope: brand', {NL},
    'intent: brand rule', {NL}, 'detect:', {NL}, '  semantic: brand use', {NL}, 'fix: ask', {NL},
    'prompt:', {NL}, '  violation: v', {NL}, '  requirement: r', {NL}, '  solution: s') as content
from (select distinct p_brand from part) b"""

BASE_RULE_DOC = f"""
select 'base.md' as path,
  concat('### RULE: BASE-1', {NL}, 'severity: FATAL', {NL}, 'scope: base', {NL}, 'intent: base rule', {NL},
    'detect:', {NL}, '  include: sys/*.h', {NL}, 'fix: drop', {NL},
    'prompt:', {NL}, '  violation: v', {NL}, '  requirement: r', {NL}, '  solution: s') as content
from (select count(*) as n from part) c"""

SHARED_RULE_DOCS = f"{BRAND_RULE_DOCS} union all {BASE_RULE_DOC}"

PROJECT_CONFIGS = """
select concat('projects/proj-', c_custkey, '/project.json') as path,
  concat('{',
    case when c_custkey % 50 = 10 then concat('"extends":"../proj-', c_custkey + 1, '/project.json",')
         when c_custkey % 50 = 11 then concat('"extends":"../proj-', c_custkey - 1, '/project.json",')
         when c_custkey % 50 = 12 then '"extends":"../../nations/none.json",'
         when c_custkey % 7 = 3 then ''
         else concat('"extends":"../../nations/', c_nationkey, '.json",') end,
    case when c_custkey % 9 = 4 then '"stack":null,' when c_custkey % 9 = 5 then '' else concat('"stack":"', c_mktsegment, '",') end,
    case when c_custkey % 19 = 3 then '"enabledRuleIds":[],'
         else concat('"enabledRuleIds":["PART-', c_custkey, '","EXTRA-', c_custkey,
           case when c_custkey % 4 = 0 then '' else concat('","GHOST-', c_custkey % 5, '","PART-', c_custkey) end, '"],') end,
    case when c_custkey % 7 = 3 and c_custkey % 2 = 0 then ''
         else concat('"scopes":["extra","', case c_custkey % 3 when 0 then 'ECONOMY' when 1 then 'SMALL' else 'base' end, '"],') end,
    case when c_custkey % 13 = 5 then '"thresholds":{"zMax":"80","maxLines":null},'
         when c_custkey % 7 = 3 and c_custkey % 4 = 1 then '"thresholds":[1],'
         else concat('"thresholds":{"zMax":', c_custkey % 100, ',"ratio":0.25},') end,
    case when c_custkey % 17 = 3 then '"exceptions":{"EXTRA-*":["src/x/**"],"X-1":[5],"Y-1":"no"},'
         when c_custkey % 17 = 4 then ''
         else '"exceptions":{"EXTRA-*":["src/x/**","gen/**"],"BASE-1":["native/**"]},' end,
    '"i18n":{"defaultLocale":"', case c_custkey % 3 when 0 then 'zh-CN' when 1 then 'en' else 'fr' end, '"},',
    case when c_custkey % 8 = 6 then '"prompt":{"promptTemplates":{"auditSystem":"own system","auditUser":"own user"}},'
         else '"prompt":{"style":"strict","promptTemplateKeys":{"auditSystem":"prompt.audit.system","repairUser":"prompt.repair.user"}},' end,
    '"detectOptions":{"include":["lib/**"]}}') as content
from customer"""

NATION_CONFIGS = """
select concat('nations/', n_nationkey, '.json') as path,
  concat('{"extends":"../regions/', n_regionkey, '.json","stack":"', n_name, '","version":"2.0",',
    '"enabledRuleIds":["BASE-1"', case when n_nationkey % 5 = 0 then ',"NATION-0"' else '' end, '],"scopes":["base","brand","SMALL"],',
    '"pathAliases":{"@nation":"src/n"},"thresholds":{"maxParams":5,"zMax":80},',
    '"exceptions":{"SECRET-*":["gen/**"],"EXTRA-*":["gen/**","old/**"]},',
    '"detectOptions":{"include":["src/**"],"exclude":["dist/**"]}}') as content
from nation"""

REGION_CONFIGS = """
select concat('regions/', r_regionkey, '.json') as path,
  concat('{"version":"1.0","stack":"', r_name, '","severityThreshold":"WARN","rulesFile":"house-rules.md",',
    '"enabledRuleIds":["BASE-1"],"pathAliases":{"@root":"src"},"thresholds":{"ratio":0.5,"maxParams":9},',
    '"detectOptions":{"include":["src/**","public/**"],"exclude":["tmp/**"]}}') as content
from region"""

SHARED_CONFIGS = f"{NATION_CONFIGS} union all {REGION_CONFIGS}"

# Source files of the configured projects.
PROJECT_FILES = CODE_FILES.replace("concat('p', user_id % 20) as project_id", "concat('proj-', user_id) as project_id")

# All projects somebody expects to exist: with or without configuration and rules.
PROJECTS = "select distinct concat('proj-', cast(floor(o_orderkey / 6) as bigint)) as project_id from orders"

RULE_TEMPLATES = f"""
select concat('templates/', p_partkey, '.md') as path,
  case p_partkey % 3 when 0 then 'zh-CN' when 1 then 'en' else 'fr' end as locale,
  concat('extends: ../old.md', {NL}, '### RULE: TPL-', p_partkey, {NL}, '  titleKey: rule.title', {NL},
    ' descriptionKeys:', {NL}, '  - desc.a', {NL}, '- desc.', p_partkey % 3, {NL}, 'intentKey: intent', {NL},
    'fixKey: rule.fix.', p_partkey % 4, {NL}, 'promptKeys:', {NL}, '  violation: rule.title', {NL},
    '  requirement: rule.none', {NL}, '- plain', {NL}, '  violation: kept', {NL}) as content
from part"""

LOCALES = [
    ("en", "prompt.audit.system", "You review code."),
    ("en", "prompt.audit.user", "Check the rules below."),
    ("en", "prompt.repair.user", "Repair it."),
    ("en", "rule.title", "Title"),
    ("en", "intent", "Why: intent"),
    ("en", "rule.fix.1", "Fix one"),
    ("en", "desc.a", "First part"),
    ("en", "desc.1", "Second part"),
    ("zh-CN", "prompt.audit.system", "审查代码。"),
    ("zh-CN", "prompt.audit.user", "检查以下规则。"),
    ("zh-CN", "rule.title", "标题"),
    ("zh-CN", "rule.fix.0", "修复"),
    ("zh-CN", "desc.a", "第一"),
    ("zh-CN", "desc.0", ""),
]

#: Tables of short rows, each of which becomes a long text, with the key that they are dealt by.
DEALT = {"part": "p_partkey", "customer": "c_custkey", "events": "event_id"}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Inputs:
    """The derived inputs for one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def sql(self, text: str, deal: bool = False) -> DataFrame:
        """``deal`` spreads short rows over tasks by their number, as their bytes tell little of the work."""
        for name in TABLES:
            if name in text:
                rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                rows = dealt(rows, DEALT[name]) if deal and name in DEALT else rows
                rows.createOrReplaceTempView(name)
        return self.spark.sql(text)

    def files(self) -> DataFrame:
        return self.sql(ALL_FILES)

    def corpus_projects(self) -> DataFrame:
        arr = lambda globs: "array(" + ", ".join(f"'{g}'" for g in globs) + ")"
        text = CORPUS_PROJECTS.format(
            none="cast(array() as array<string>)", include=arr(INCLUDE_GLOBS), exclude=arr(EXCLUDE_GLOBS)
        )
        exceptions = F.array(
            *[
                F.struct(F.lit(k).alias("key"), F.array(*[F.lit(g) for g in globs]).alias("globs"))
                for k, globs in EXCEPTIONS
            ]
        )
        return self.sql(text).withColumn("exceptions", exceptions)

    def pack(self, projects: DataFrame) -> DataFrame:
        """The rule pack for every project, as rows."""
        names = ("rule_id", "severity", "regex", "import", "include", "where")
        rules = [
            F.struct(F.lit(i).cast("bigint").alias("rule_pos"), *[F.lit(v).cast("string").alias(n) for n, v in zip(names, rule)])
            for i, rule in enumerate(RULE_PACK)
        ]
        return projects.select("project_id", F.inline(F.array(*rules)))

    def reports(self) -> DataFrame:
        return self.sql(REPORTS, deal=True)

    def rule_docs(self, deal: bool = True) -> DataFrame:
        return self.sql(PROJECT_RULE_DOCS, deal).unionByName(self.sql(SHARED_RULE_DOCS))

    def configs(self, deal: bool = True) -> DataFrame:
        return self.sql(PROJECT_CONFIGS, deal).unionByName(self.sql(SHARED_CONFIGS))

    def projects(self) -> DataFrame:
        return self.sql(PROJECTS)

    def rule_templates(self) -> DataFrame:
        return self.sql(RULE_TEMPLATES, deal=True)

    def locales(self) -> DataFrame:
        return self.spark.createDataFrame(LOCALES, "locale string, key string, text string")
