"""Sources beside tables: trees of files, histories, differences, traces and note vaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.norm import duration_ns, language, url_path

#: Folders that hold no source of the project's own, and those that a quick look leaves out, too
#: (fixed values).
SKIPPED = (
    ".git", ".hg", ".svn", ".worktrees", ".idea", ".vs", ".vscode", ".eclipse", ".cache", ".eggs", ".env", ".mypy_cache", ".nox", ".pytest_cache", ".ruff_cache", ".tox",
    ".venv", "__pycache__", "env", "htmlcov", "site-packages", "venv", ".npm", ".nyc_output", ".pnpm-store", ".yarn", "bower_components", "coverage", "node_modules",
    ".next", ".nuxt", ".svelte-kit", ".angular", ".turbo", ".parcel-cache", ".docusaurus", ".expo", "dist", "obj", "Pods", "target", "temp", "tmp", ".terraform", ".serverless",
    "bazel-bin", "bazel-out", "bazel-testlogs", ".cargo", ".stack-work", ".dart_tool", "zig-cache", "zig-out", ".metals", ".bloop", ".bsp", ".ccls-cache", ".clangd", "elm-stuff",
    "_opam", ".cpcache", ".shadow-cljs", ".vercel", ".netlify", "deploy", "deployed", ".tmp", "vendor", "vendored",
)
SKIPPED_WHEN_FAST = (
    "generated", "gen", "auto-generated", "fixtures", "testdata", "test_data", "__tests__", "__mocks__", "__snapshots__", "__fixtures__", "__test__", "docs", "doc", "documentation",
    "examples", "example", "samples", "sample", "assets", "static", "public", "media", "third_party", "thirdparty", "3rdparty", "external", "migrations", "seeds", "e2e", "integration",
    "locale", "locales", "i18n", "l10n", "scripts", "tools", "hack", "bin", "build", "out",
)
#: Files that say which paths to leave out, below their own folder.
IGNORE_FILES = (".gitignore", ".skeinignore")


def kept_paths(files: DataFrame, rules: DataFrame, fast: bool = False, only_known: bool = True) -> DataFrame:
    """`files(path, ...)` with `language`, without those that folders or ignore files leave out.
    `rules(folder, n, pattern)` are the lines of ignore files, in order, each for paths below its
    folder ('' for the top); of the rules that cover a path the one of the deepest folder, then
    the last line, decides, and `!` takes a path back in. Patterns become regular expressions
    once; a path meets the rules of its own folders only, in an equi-join."""
    skipped = "|".join(x.replace(".", r"\.") for x in (*SKIPPED, *(SKIPPED_WHEN_FAST if fast else ())))
    rows = files.withColumn("language", language(F.col("path"))).where(~F.col("path").rlike(f"(^|/)({skipped})/"))
    if only_known:
        rows = rows.where(F.col("language").isNotNull())
    p = F.trim("pattern")
    told = rules.select("folder", "n", p.alias("pattern")).where("pattern <> '' and not startswith(pattern, '#')")
    told = told.select("folder", "n", F.col("pattern").startswith("!").alias("back"), pattern_regex(F.regexp_replace("pattern", "^!", "")).alias("regex"))
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    covered = rows.select("path", F.explode(folders).alias("folder")).join(told, "folder").where(F.expr("regexp(if(folder = '', path, substring(path, length(folder) + 2)), regex)"))
    last = covered.groupBy("path").agg(F.max_by("back", F.struct(F.length("folder").alias("deep"), "n")).alias("back"))
    return rows.join(last.where("not back"), "path", "left_anti")


def pattern_regex(pattern: Column) -> Column:
    """The regular expression of an ignore pattern: `name`, `dir/`, `*.ext`, `/top`, `a/**/b`."""
    body = F.regexp_replace(pattern, r"^/|/$", "")
    quoted = F.regexp_replace(body, r"([.+^$(){}|\[\]\\])", r"\\$1")
    for mark, plain in ((r"\*\*/", "\u0001"), (r"\*\*", "\u0002"), (r"\*", "\u0003"), (r"\?", "\u0004")):
        quoted = F.regexp_replace(quoted, mark, plain)
    for plain, regex in (("\u0001", "(.*/)?"), ("\u0002", ".*"), ("\u0003", "[^/]*"), ("\u0004", "[^/]")):
        quoted = F.replace(quoted, F.lit(plain), F.lit(regex))
    top = pattern.startswith("/") | F.regexp_replace(pattern, r"/$", "").contains("/")
    return F.concat(F.when(top, "^").otherwise("(^|/)"), quoted, F.when(pattern.endswith("/"), "/").otherwise("(/|$)"))


def discover(spark: SparkSession, root: str, ignore: Sequence[str] = (), fast: bool = False, only_known: bool = True) -> DataFrame:
    """(path, size, mtime, language) of the source files below `root`, listed by the executors'
    reader without reading contents; ignore files below `root` and the lines of `ignore` leave
    paths out (see `kept_paths`), and so do the folders of SKIPPED, with `fast` more of them. A
    folder that can't be read is an error, so a missing file is never taken for a deleted one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    below = lambda c: F.regexp_replace(F.substring_index(c, base, -1), r"^/+", "")
    rows = files.select(below("path").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    own = spark.createDataFrame([("", i, p) for i, p in enumerate(ignore)], "folder string, n int, pattern string")
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="{" + ",".join(IGNORE_FILES) + "}").select(below(F.col("_metadata.file_path")).alias("path"), "value")
    told = texts.select(F.regexp_replace("path", r"(^|/)[^/]*$", "").alias("folder"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "pattern"))
    return kept_paths(rows, own.unionByName(told.withColumn("n", F.col("n") + len(ignore))), fast, only_known)


def carried(rows: DataFrame, by: str, order: str, value: Column, span: int = 100_000) -> DataFrame:
    """`rows` with `carried`: the last value that isn't null up to each row of its `by`, in the
    order of the whole number `order`. Ranges of `span` numbers are walked on their own, behind
    the last values of the ranges before, so no task walks all rows of one key."""
    r = rows.withColumn("__v", value).withColumn("__range", F.floor(F.col(order) / span))
    inside = Window.partitionBy(by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = r.where("__v is not null").groupBy(by, "__range").agg(F.max_by("__v", order).alias("__last"))
    ranges = r.select(by, "__range").distinct().join(ends, [by, "__range"], "left")
    before = ranges.withColumn("__before", F.last("__last", ignorenulls=True).over(Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).drop("__last")
    return r.withColumn("__in", F.last("__v", ignorenulls=True).over(inside)).join(before, [by, "__range"]).withColumn("carried", F.coalesce("__in", "__before")).drop("__v", "__range", "__in", "__before")


def git_log(log: DataFrame, since: str | None = None) -> DataFrame:
    """(repo, commit, at, file) from `log(repo, n, value)`, the lines of each repository in order
    `n`, as `git log --name-only --format=COMMIT:%H:%ct` prints them. Lock files and vendored
    files are left out; `since` leaves out older commits."""
    head = F.regexp_extract("value", r"^COMMIT:([0-9a-f]+):(\d+)$", 1)
    at = F.regexp_extract("value", r"^COMMIT:[0-9a-f]+:(\d+)$", 1).cast("bigint")
    rows = carried(log, "repo", "n", F.when(head != "", F.struct(head.alias("h"), at.alias("t"))))
    rows = rows.where((head == "") & (F.trim("value") != "") & F.col("carried").isNotNull())
    rows = rows.where(~F.col("value").rlike(r"(^|/)(node_modules|vendor|dist)/|(^|/)(package-lock\.json|yarn\.lock|Cargo\.lock|go\.sum)$"))
    if since:
        rows = rows.where(F.col("carried.t") >= F.unix_timestamp(F.lit(since)))
    return rows.select("repo", F.col("carried.h").alias("commit"), F.timestamp_seconds("carried.t").alias("at"), F.col("value").alias("file"))


def git_status(lines: DataFrame) -> DataFrame:
    """(file, status, old_file) from the lines of `git diff --name-status`."""
    parts = F.split("value", "\t")
    kind = F.substring(parts[0], 1, 1)
    name = F.when(kind.isin("R", "C"), parts[2]).otherwise(parts[1])
    label = F.create_map(*[F.lit(x) for kv in {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied"}.items() for x in kv])[kind]
    return lines.where(F.size(parts) > 1).select(name.alias("file"), F.coalesce(label, F.lit("modified")).alias("status"), F.when(kind.isin("R", "C"), parts[1]).alias("old_file"))


def git_hunks(lines: DataFrame) -> DataFrame:
    """(diff, file, start, count) of the changed ranges in the lines (`diff`, `n`, `value`) of
    `git diff --unified=0`; a range without a count is one line."""
    name = F.regexp_extract("value", r"^\+\+\+ b/(.*)$", 1)
    rows = carried(lines, "diff", "n", F.when(name != "", name))
    at = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"
    count = F.regexp_extract("value", at, 2)
    return rows.where(F.col("value").rlike(at)).select("diff", F.col("carried").alias("file"), F.regexp_extract("value", at, 1).cast("int").alias("start"), F.when(count == "", 1).otherwise(count.try_cast("int")).alias("count"))


def spans(otlp: DataFrame, *keep: str) -> DataFrame:
    """(*keep, trace_id, span_id, method, path, duration_ns) of the HTTP spans in OTLP JSON
    documents (`value`)."""
    attr = "array<struct<key string, value struct<stringValue string>>>"
    schema = f"struct<resourceSpans array<struct<scopeSpans array<struct<spans array<struct<traceId string, spanId string, startTimeUnixNano string, endTimeUnixNano string, attributes {attr}>>>>>>>"
    doc = otlp.select(*keep, F.from_json("value", schema).alias("d"))
    s = doc.select(*keep, F.explode("d.resourceSpans").alias("r")).select(*keep, F.explode("r.scopeSpans").alias("c")).select(*keep, F.explode("c.spans").alias("s"))

    value = lambda *keys: F.coalesce(*[_attribute(k) for k in keys])
    rows = s.select(
        *keep, F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), value("http.method", "http.request.method").alias("method"),
        value("http.route", "url.path", "http.target", "http.url").alias("url"), duration_ns(F.col("s.startTimeUnixNano"), F.col("s.endTimeUnixNano")).alias("duration_ns"),
    )
    return rows.where("method is not null").select(*keep, "trace_id", "span_id", "method", url_path(F.col("url")).alias("path"), "duration_ns")


def _attribute(key: str) -> Column:
    return F.get(F.filter("s.attributes", lambda a: a["key"] == key), F.lit(0))["value"]["stringValue"]


def vault(spark: SparkSession, root: str) -> DataFrame:
    """(path, frontmatter, body) of the Markdown files below a folder."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    return split_note(files)


def split_note(files: DataFrame) -> DataFrame:
    """Frontmatter, as a map of its top-level keys, and body of Markdown in `value`. A list, `[a, b]`
    or `- a` lines below its key, is the items joined by commas; of a repeated key the last counts."""
    front = F.regexp_extract("value", r"^---\r?\n([\s\S]*?)\r?\n---\r?\n?", 1)
    body = F.regexp_replace("value", r"^---\r?\n[\s\S]*?\r?\n---\r?\n?", "")
    # items go up to the line of their key: `key:`, then `- a`, becomes `key:\u0001a`
    flat = F.regexp_replace(front, r"\r?\n\s*-\s+", "\u0001")
    pairs = F.filter(F.split(flat, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    bare = lambda c: F.regexp_replace(F.btrim(c), r"""^["']|["']$""", "")
    items = lambda c: F.array_join(F.transform(F.filter(F.split(c, "[\u0001,]"), lambda y: F.btrim(y) != ""), bare), ",")
    text = lambda x: F.btrim(F.regexp_extract(x, r"^[\w-]+:([\s\S]*)$", 1))
    value = lambda x: F.when(x.contains("\u0001"), items(x)).when(x.rlike(r"^\[.*\]$"), items(F.regexp_replace(x, r"^\[|\]$", ""))).otherwise(bare(x))
    entry = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("k"), value(text(x)).alias("v")))
    last = F.aggregate(entry, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.create_map(e["k"], e["v"])))
    return files.select("file", last.alias("frontmatter"), body.alias("body"))


def human_section(body: Column) -> Column:
    """The part of a note that people write: between its marks, null if it has none."""
    part = F.regexp_extract(body, r"<!-- HUMAN NOTES -->\r?\n?([\s\S]*?)<!-- /HUMAN NOTES -->", 1)
    return F.when(body.contains("<!-- HUMAN NOTES -->"), part)

