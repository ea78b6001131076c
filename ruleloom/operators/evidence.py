"""Evidence collection: which files each rule looks at, and what it finds there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions.globs import any_glob_regex, glob_regex, matches_regex, path_matches
from ruleloom.functions.paths import forward_slashes
from ruleloom.functions.patterns import pattern_table
from ruleloom.functions.text import BLANK, bind, lines_of, snippet, trim_blank
from ruleloom.session import broadcast_if_small, staged

#: Rules with a required literal in one project from which on trigrams choose the ones to look at, and files that tell which trigrams are rare.
INDEX_FROM = 100
SAMPLE_FILES = 500

MATCHES_KEPT = 10
MATCHES_SHOWN = 5

# Note texts of evidence records.
AI_NOTE = "This rule uses AST or semantic detection and requires AI judgment."
BAD_PATTERN_NOTE = "invalid-regex"
BAD_PATTERN_TEXT = "Invalid regex pattern: "
# Own note: the pattern is valid, but this library cannot run it.
UNSUPPORTED_TEXT = "Regex pattern cannot be run here: "

# How source lines name other modules, in the order they are tried.
IMPORT_FORMS = (
    rf"""from{BLANK}+["']([^"']+)["']""",
    rf"""import{BLANK}+["']([^"']+)["']""",
    rf"""require\({BLANK}*["']([^"']+)["']{BLANK}*\)""",
)
INCLUDE_FORM = rf"""#include{BLANK}+[<"]([^>"]+)[>"]"""

RULE_KEY = ("project_id", "rule_pos", "rule_id")
HIT_ORDER = ("path", "line_no", "ord")


def files_in_scope(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Files with (no include globs or any include match) and no exclude match.

    ``projects`` holds one row per project with ``include`` and ``exclude`` glob lists; each
    list becomes one regex, so a file meets exactly one row of it.
    """
    scope = projects.select(
        "project_id", any_glob_regex(F.col("include")).alias("_in"), any_glob_regex(F.col("exclude")).alias("_out")
    )
    path = F.col("path")
    wanted = F.coalesce(path_matches(path, F.col("_in")), F.lit(True))
    unwanted = F.coalesce(path_matches(path, F.col("_out")), F.lit(False))
    return files.join(broadcast_if_small(scope), "project_id").where(wanted & ~unwanted).drop("_in", "_out")


def rule_mode(regex: Column, import_glob: Column, include_glob: Column) -> Column:
    """Detection mode of a rule: a regex wins over references, anything else needs judgment (Q5)."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(given(regex), "local-regex")
        .when(given(import_glob) | given(include_glob), "local-import")
        .otherwise("ai-only")
    )


def where_glob(where: Column) -> Column:
    """Glob of a ``where`` text, NULL when the text is not understood and keeps all files (Q4)."""
    glob = F.regexp_extract(F.coalesce(where, F.lit("")), r"\A(?:filePath|importer|includer) in ([^\n\r]+)\z", 1)
    return F.when(glob != "", trim_blank(glob))


def rule_key_matches(rule_id: Column, key: Column) -> Column:
    """An exception key with ``*`` is a glob on the rule id, any other is the id itself (Q11)."""
    return F.when(key.contains("*"), matches_regex(rule_id, glob_regex(key))).otherwise(
        (rule_id == key) & (key != "")
    )


def exception_patterns(rule_id: Column, exceptions: Column) -> Column:
    """Ordered distinct file globs of all exception entries that apply to a rule.

    ``exceptions`` is an ordered ``array<struct<key, globs>>``.
    """
    applying = F.filter(exceptions, lambda e: rule_key_matches(rule_id, e["key"]))
    globs = F.flatten(F.transform(applying, lambda e: F.coalesce(e["globs"], F.array().cast("array<string>"))))
    return F.coalesce(F.array_distinct(globs), F.array().cast("array<string>"))


def resolve_rules(rules: DataFrame, projects: DataFrame) -> DataFrame:
    """Rule dimension ready for matching: mode, path regexes, target regex, exception list.

    ``rules`` needs ``project_id, rule_pos, rule_id, regex, import, include, where``;
    ``projects`` needs ``project_id, exceptions``.
    """
    with_exceptions = rules.join(projects.select("project_id", "exceptions"), "project_id", "left").withColumn(
        "exception_patterns", exception_patterns(F.col("rule_id"), F.col("exceptions"))
    )
    target = F.when(F.coalesce("import", F.lit("")) != "", F.col("import")).otherwise(F.col("include"))
    return with_exceptions.drop("exceptions").select(
        "*",
        rule_mode(F.col("regex"), F.col("import"), F.col("include")).alias("mode"),
        F.when(F.coalesce("import", F.lit("")) != "", "import").otherwise("include").alias("target_kind"),
        target.alias("target"),
        glob_regex(target).alias("target_re"),
        glob_regex(where_glob(F.col("where"))).alias("where_re"),
        any_glob_regex(F.col("exception_patterns")).alias("exception_re"),
    )


def looked_at(rule: Column | None = None) -> Column:
    """The ``where`` glob takes the file; of a rule given as a struct, else of the row's own."""
    glob = F.col("where_re") if rule is None else rule["where_re"]
    return F.coalesce(path_matches(F.col("path"), glob), F.lit(True))


def suppressed(rule: Column | None = None) -> Column:
    """An exception of the rule names the file."""
    globs = F.col("exception_re") if rule is None else rule["exception_re"]
    return F.coalesce(path_matches(F.col("path"), globs), F.lit(False))


def kept(rule: Column | None = None) -> Column:
    return looked_at(rule) & ~suppressed(rule)


def rule_file_scope(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pairs of rule and file after ``where``, with the exception flag. Reads no content."""
    dim = resolved.select(*RULE_KEY, "where_re", "exception_re")
    pairs = files.select("project_id", "path").join(broadcast_if_small(dim), "project_id")
    return pairs.where(looked_at()).select(*RULE_KEY, "path", suppressed().alias("suppressed"))


def suppressed_counts(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """Files each rule skips because of exceptions, zero-filled. Rules without any meet no file."""
    dim = resolved.where("exception_re is not null").select(*RULE_KEY, "where_re", "exception_re")
    pairs = files.select("project_id", "path").join(broadcast_if_small(dim), "project_id")
    counted = pairs.where(looked_at() & suppressed()).groupBy(*RULE_KEY).agg(F.count("*").alias("suppressed_files"))
    return (
        resolved.select(*RULE_KEY)
        .join(counted, list(RULE_KEY), "left")
        .withColumn("suppressed_files", F.coalesce("suppressed_files", F.lit(0)))
    )


def corpus_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    return files.select("project_id", "path", F.posexplode(lines_of(F.col("content"))).alias("_at", "line")).select(
        "project_id", "path", (F.col("_at") + 1).alias("line_no"), "line"
    )


def detector_dim(resolved: DataFrame, patterns: DataFrame, *modes: str) -> DataFrame:
    """Detectors of the rules in ``modes``: pattern or target, and the literal a hit must hold.

    A reference that matches a glob starts with the glob's plain beginning, so that text is
    the required literal of a reference rule.
    """
    plain = F.regexp_replace(forward_slashes(F.col("target")), r"\A\./", "")
    beginning = F.regexp_extract(plain, r"\A([^*?{}/]*)", 1)
    detectors = resolved.where(F.col("mode").isin(*modes)).join(patterns, "regex", "left")
    return detectors.where("pattern_ok or mode = 'local-import'").select(
        *RULE_KEY,
        "mode",
        "pattern",
        F.when(F.col("mode") == "local-import", F.nullif(beginning, F.lit(""))).otherwise(F.col("literal")).alias("literal"),
        "target_kind",
        "target_re",
        "where_re",
        "exception_re",
    )


def _may_hold_reference(text: Column) -> Column:
    # Plain-text tests only; they skip texts and lines that cannot hold a reference.
    return text.contains("from") | text.contains("import") | text.contains("require(") | text.contains("#include")


def _import_references(line: Column) -> Column:
    return F.concat(*[F.regexp_extract_all(line, F.lit(form), 1) for form in IMPORT_FORMS])


def _include_references(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(INCLUDE_FORM), 1)


def trigrams(text: Column) -> Column:
    """Every three letters in a row of a text, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), 1))


def with_rarest_trigram(detectors: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``gram``: of the required literal's trigrams the one that fewest files hold; NULL for a shorter literal.

    A sample of files tells which are rare; results do not depend on it.
    """
    grams = detectors.select("literal").where("length(literal) > 2").distinct()
    grams = staged(grams.select("literal", F.explode(trigrams(F.col("literal"))).alias("gram")), "trigrams")
    held = files.limit(SAMPLE_FILES).select(F.explode(trigrams(F.col("content"))).alias("gram"))
    counted = held.join(broadcast_if_small(grams.select("gram").distinct()), "gram").groupBy("gram").agg(F.count("*").alias("files"))
    rank = F.struct(F.coalesce("files", F.lit(0)), "gram")
    rarest = grams.join(counted, "gram", "left").groupBy("literal").agg(F.min_by("gram", rank).alias("gram"))
    return detectors.join(rarest, "literal", "left")


def project_detectors(detectors: DataFrame, files: DataFrame, index_from: int | None = None) -> tuple[DataFrame, bool]:
    """One row per project with its ``detectors`` as an array, and whether they are indexed by trigrams.

    With an index, ``grams`` holds the distinct trigrams by which a project's detectors are found.
    """
    detectors = staged(detectors, "detectors")
    most = detectors.where("length(literal) > 2").groupBy("project_id").count().agg(F.max("count")).first()[0] or 0
    indexed = most >= (INDEX_FROM if index_from is None else index_from)
    if indexed:
        detectors = with_rarest_trigram(detectors, files)
    else:
        detectors = detectors.withColumn("gram", F.lit(None).cast("string"))
    fields = F.struct(*[c for c in detectors.columns if c != "project_id"])
    projects = detectors.groupBy("project_id").agg(F.collect_list(fields).alias("detectors"), F.collect_set("gram").alias("grams"))
    return staged(projects, "project-detectors"), indexed


def file_hits(files: DataFrame, detectors: DataFrame, keep: int | None = None, share_copies: bool = False) -> DataFrame:
    """What each detector finds in each file: ``n`` hits, of which ``hits`` holds the first ``keep``.

    One scan of the texts, without any shuffle of them; a file meets one row, its project's detectors
    as an array, and gives one row for each rule with a hit. The literal a rule requires weeds out
    detectors by a byte search; from ``INDEX_FROM`` rules on, those whose rarest trigram is not among
    the file's are left out before. Path conditions follow. The text is split, and its references are
    taken, once for all detectors left, and only lines that hold the literal reach the regex engine.
    A regex gives at most one hit per line (Q6), a reference rule one for each matching reference
    (Q9). A file's hits are in their final order, so the first ones per rule are among the first
    ones per file.

    ``share_copies`` matches files of a project with equal contents once, whatever their paths.
    """
    projects, indexed = project_detectors(detectors, files)
    if share_copies:
        return _shared_hits(files, projects, indexed, keep)
    return _hits(files, projects, indexed, kept, keep).select(*RULE_KEY, "path", "n", "hits")


def _hits(files: DataFrame, projects: DataFrame, indexed: bool, applies: Callable[[Column], Column], keep: int | None, *more: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    content = F.col("content")

    def holds(text: Column, d: Column) -> Column:
        return d["literal"].isNull() | F.contains(text, d["literal"])

    def remaining(grams: Column) -> Column:
        by_regex = lambda d: d["mode"] == "local-regex"
        found = lambda d: d["gram"].isNull() | F.array_contains(grams, d["gram"]) if indexed else F.lit(True)
        return F.filter("detectors", lambda d: found(d) & holds(content, d) & (by_regex(d) | _may_hold_reference(content)) & applies(d))

    def hit(line_no: Column, ord_: Column, line: Column, reference: Column) -> Column:
        return F.struct(line_no.alias("line_no"), ord_.alias("ord"), line.alias("line"), reference.alias("reference"))

    def references(lines: Column, taken: Callable[[Column], Column]) -> Column:
        candidates = F.filter(lines, lambda x: _may_hold_reference(x["line"]))
        return F.flatten(F.transform(candidates, lambda x: F.transform(taken(x["line"]), lambda r, at: hit(x["line_no"], at, x["line"], r))))

    def within(lines: Column, left: Column) -> Column:
        """Hits of all remaining detectors in the lines of one file."""
        of_kind = lambda kind: F.exists(left, lambda d: (d["mode"] == "local-import") & (d["target_kind"] == kind))
        none = F.array().cast("array<struct<line_no:int,ord:int,line:string,reference:string>>")
        imports = F.when(of_kind("import"), references(lines, _import_references)).otherwise(none)
        includes = F.when(of_kind("include"), references(lines, _include_references)).otherwise(none)

        def found(d: Column, refs: Column) -> Column:
            own = F.filter(lines, lambda x: holds(x["line"], d) & matches_regex(x["line"], d["pattern"]))
            whole = F.transform(own, lambda x: hit(x["line_no"], F.lit(0), x["line"], nothing))
            listed = F.when(d["target_kind"] == "import", refs["imports"]).otherwise(refs["includes"])
            matching = F.filter(listed, lambda h: path_matches(h["reference"], d["target_re"]))
            return F.when(d["mode"] == "local-regex", whole).otherwise(matching)

        def shown(d: Column, hits: Column) -> Column:
            first = hits if keep is None else F.slice(hits, 1, keep)
            cut = F.transform(
                first,
                lambda h: F.struct(h["line_no"].alias("line_no"), h["ord"].alias("ord"), snippet(h["line"]).alias("snippet"), h["reference"].alias("reference"), nothing.alias("note")),
            )
            extra = [d[name].alias(name) for name in ("where_re", "exception_re")]
            return F.struct(d["rule_pos"].alias("rule_pos"), d["rule_id"].alias("rule_id"), *extra, F.size(hits).cast("bigint").alias("n"), cut.alias("hits"))

        refs = F.struct(imports.alias("imports"), includes.alias("includes"))
        return bind(refs, lambda r: F.transform(left, lambda d: bind(found(d, r), lambda h: shown(d, h))))

    def in_file(left: Column) -> Column:
        numbered = F.transform(lines_of(content), lambda line, at: F.struct((at + 1).alias("line_no"), line.alias("line")))
        return F.when(F.size(left) > 0, bind(numbered, lambda lines: F.filter(within(lines, left), lambda x: x["n"] > 0)))

    grams = F.array_intersect(trigrams(content), F.col("grams")) if indexed else F.array().cast("array<string>")
    found = bind(grams, lambda g: bind(remaining(g), in_file))
    met = files.join(broadcast_if_small(projects), "project_id")
    return met.select("project_id", "path", *more, F.inline(found))


def _shared_hits(files: DataFrame, projects: DataFrame, indexed: bool, keep: int | None) -> DataFrame:
    """:func:`file_hits` with equal contents of a project matched once.

    Contents are told apart by 128 bits of hash and their length. The first path of each stands for
    all; path conditions, which differ between copies, follow when the hits are joined back.
    """
    same = [F.xxhash64("content").alias("_a"), F.xxhash64("content", F.lit(1)).alias("_b"), F.octet_length("content").alias("_n")]
    key = ["project_id", "_a", "_b", "_n"]
    copies = staged(files.select("project_id", "path", *same), "contents")
    firsts = staged(copies.groupBy(*key).agg(F.min("path").alias("path")), "first-contents")
    once = files.join(broadcast_if_small(firsts), ["project_id", "path"])
    found = staged(_hits(once, projects, indexed, lambda _: F.lit(True), keep, "_a", "_b", "_n").drop("path"), "shared-hits")
    # Contents without a hit end here; those that many files share are spread by the join's split of skewed keys.
    return copies.join(broadcast_if_small(found), key).where(kept()).select(*RULE_KEY, "path", "n", "hits")


def hit_rows(found: DataFrame) -> DataFrame:
    """One row for each hit that :func:`file_hits` holds."""
    return found.select(*RULE_KEY, "path", F.inline("hits"))


def content_hits(files: DataFrame, detectors: DataFrame) -> DataFrame:
    """Hits of all detectors, one row each."""
    return hit_rows(file_hits(files, detectors))


def regex_hits(files: DataFrame, resolved: DataFrame) -> DataFrame:
    return content_hits(files, detector_dim(resolved, pattern_table(resolved), "local-regex"))


def import_hits(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """References that match a rule's import or include glob."""
    return content_hits(files, detector_dim(resolved, pattern_table(resolved), "local-import"))


def invalid_regex_hits(files: DataFrame, resolved: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """A rule whose pattern is not a regex marks every file it keeps, on line 1 (Q7). Reads no content."""
    patterns = pattern_table(resolved) if patterns is None else patterns
    dim = (
        resolved.where("mode = 'local-regex'")
        .join(patterns.where("not valid"), "regex")
        .select(*RULE_KEY, "regex", "where_re", "exception_re")
    )
    return (
        files.select("project_id", "path")
        .join(broadcast_if_small(dim), "project_id")
        .where(kept())
        .select(
            *RULE_KEY,
            "path",
            F.lit(1).alias("line_no"),
            F.lit(0).alias("ord"),
            F.concat(F.lit(BAD_PATTERN_TEXT), "regex").alias("snippet"),
            F.lit(None).cast("string").alias("reference"),
            F.lit(BAD_PATTERN_NOTE).alias("note"),
        )
    )


def untranslatable_patterns(resolved: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Rules whose pattern the rule language allows but Java does not: they match nothing, and say so."""
    patterns = pattern_table(resolved) if patterns is None else patterns
    found = resolved.where("mode = 'local-regex'").join(patterns.where("valid and not pattern_ok"), "regex")
    return found.select(*RULE_KEY, F.lit("warn").alias("level"), F.concat(F.lit(UNSUPPORTED_TEXT), "regex").alias("message"))


def extract_references(files: DataFrame) -> DataFrame:
    """Import and include references per line, one row each, in the order they are tried (Q9)."""
    line = F.col("line")
    tagged = F.array(
        F.struct(F.lit("import").alias("target_kind"), _import_references(line).alias("refs")),
        F.struct(F.lit("include").alias("target_kind"), _include_references(line).alias("refs")),
    )
    lines = corpus_lines(files.where(_may_hold_reference(F.col("content")))).where(_may_hold_reference(line))
    kinds = lines.select("project_id", "path", "line_no", "line", F.inline(tagged))
    return kinds.select(
        "project_id", "path", "line_no", "line", "target_kind", F.posexplode("refs").alias("ord", "reference")
    )


def found_in_files(files: DataFrame, resolved: DataFrame, keep: int | None = None, share_copies: bool = False) -> DataFrame:
    """Rows of :func:`file_hits` for every rule, those with an invalid pattern included."""
    patterns = staged(pattern_table(resolved), "patterns")
    found = file_hits(files, detector_dim(resolved, patterns, "local-regex", "local-import"), keep, share_copies)
    bad = invalid_regex_hits(files, resolved, patterns)
    one = F.array(F.struct("line_no", "ord", "snippet", "reference", "note"))
    return found.unionByName(bad.select(*RULE_KEY, "path", F.lit(1).cast("bigint").alias("n"), one.alias("hits")))


def evidence_totals(found: DataFrame, resolved: DataFrame) -> DataFrame:
    """Uncapped number of matches per rule, zero for rules without any."""
    counted = found.groupBy(*RULE_KEY).agg(F.sum("n").alias("total_matches"))
    return (
        resolved.select(*RULE_KEY, "mode")
        .join(counted, list(RULE_KEY), "left")
        .withColumn("total_matches", F.coalesce("total_matches", F.lit(0)))
    )


def top_matches(found: DataFrame, keep: int = MATCHES_KEPT) -> DataFrame:
    """First ``keep`` matches of every rule (Q10, Q13).

    Each task forwards at most ``keep`` rows per rule (window group limit), so a rule that
    holds most hits does not pile them up behind one key.
    """
    first = Window.partitionBy(*RULE_KEY).orderBy(*HIT_ORDER)
    return hit_rows(found).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= keep)


def evidence_records(files: DataFrame, resolved: DataFrame, share_copies: bool = False) -> DataFrame:
    """One record per project and rule: mode, first matches, totals, exceptions (A3)."""
    found = found_in_files(files, resolved, MATCHES_KEPT, share_copies)
    key = list(RULE_KEY)
    # Two consumers follow; a row per file and rule with a hit, ten hits at most, is what they read.
    found = staged(found, "found")
    best = (
        top_matches(found)
        .groupBy(*RULE_KEY)
        # At most ten rows per group.
        .agg(F.array_sort(F.collect_list(F.struct("rank", "path", "line_no", "snippet", "reference", "note"))).alias("matches"))
    )
    totals = evidence_totals(found, resolved)
    skipped = suppressed_counts(files, resolved)
    return (
        totals.join(best, key, "left")
        .join(skipped, key)
        .join(resolved.select(*key, "exception_patterns"), key)
        .select(
            *key,
            "mode",
            F.coalesce("matches", F.array().cast(best.schema["matches"].dataType)).alias("matches"),
            "total_matches",
            "exception_patterns",
            F.col("suppressed_files").alias("suppressed_file_count"),
            F.when(F.col("mode") == "ai-only", AI_NOTE).alias("note"),
        )
    )
