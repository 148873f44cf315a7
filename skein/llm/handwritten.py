"""Generated, minified, vendored and data files among source files."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import materialize

#: Words of four languages by which a header says that a tool wrote the file (fixed values).
MADE_BY_TOOL = [
    r"code generated by .*do not edit",
    r"@generated\b(?!.*\bby hand\b)",
    r"<auto-?generated\b",
    r"\bauto-?generated (file|code)\b",
    r"\b(this|the) (file|code|module|source) (was|is|has been) (auto(matically)?[- ]?)?(generated|produced|built|emitted|created|written|rendered)\b",
    r"\boutput of \S+ --?\w+",
    r"\bautomatisch (erzeugt|generiert|erstellt)\b",
    r"\bfichier (produit|généré) (automatiquement )?par\b",
    r"\b(archivo|fichero) generado (automáticamente )?por\b",
    r"\b(generated|produced|built|emitted|created mechanically|rendered|written out|compiled|derived)( automatically)? (\(\S+ [\d.]+\)|by\b|from\b)"
    r".*(do not (modify|edit|touch|change)|don't edit|leave untouched|(any|hand|manual) (edits?|changes?) (is|are|get|will be) (overwritten|lost)|never commit|change \S+ instead)",
    r"\bgenerated by the \S+ compiler from\b",
]
#: A name with a version behind it, as headers of packages write them.
NAMED_VERSION = r"([a-z][a-z0-9_.-]*[a-z0-9])(?:@| v?)\d+(?:\.\d+)+"
#: Folders and name endings that tools and package managers reserve (fixed values).
TOOL_PATH = r"(^|/)(__generated__|generated|autogen|auto-generated|autogenerated)/|\.pb\.(go|cc|h)$|_pb2(_grpc)?\.pyi?$|\.g\.(ts|dart|cs)$|\.generated\.\w+$|(^|/)zz_generated[._]"
OUTSIDE_PATH = r"(^|/)(node_modules|bower_components|site-packages|vendor|vendored|third_party|thirdparty|third-party|3rdparty)/|(^|/)external/[^/]+/|(^|/)deps/[^/]+-\d+(\.\d+)+/"

_LITERAL = re.compile(r"0x[0-9a-fA-F]+|\\x[0-9a-fA-F]{2}|-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|[A-Za-z0-9+/=_-]{40,}")
_TOKEN = re.compile(r"0x[0-9a-fA-F]+|\d+(?:\.\d+)*|[A-Za-z_$]+|[^\sA-Za-z0-9_$]")


def re_pair(sequence: list) -> tuple[list, dict[int, tuple], Counter]:
    """The Re-Pair grammar of a sequence: what is left of it, the rules (number to pair), and how
    often each rule is used. The commonest pair of neighbours becomes a rule until none occurs
    twice without overlap; of equally common pairs the one met first is taken.

    The sequence is a linked list, and every pair knows where it occurs, so a replacement touches
    its neighbours only: the work is linear in the sequence but for the heap of counts.
    """
    seq: list = list(sequence)
    n = len(seq)
    rules: dict[int, tuple] = {}
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    at: dict[tuple, dict[int, None]] = {}  # places of a pair, in order
    for i in range(n - 1):
        at.setdefault((seq[i], seq[i + 1]), {})[i] = None
    first = {pair: i for i, pair in enumerate(at)}
    heap = [(-len(places), first[pair], pair) for pair, places in at.items() if len(places) > 1]
    heapq.heapify(heap)
    alive = n
    while heap and alive > 3:
        count, _, pair = heapq.heappop(heap)
        places = at.get(pair)
        if not places or len(places) < 2:
            continue
        if pair[0] == pair[1]:  # of a run every other place counts
            kept, free = [], -1
            for i in sorted(places):
                if i >= free:
                    kept.append(i)
                    free = after[after[i]]
        else:
            kept = sorted(places)
        if len(kept) < -count:
            if len(kept) > 1:
                heapq.heappush(heap, (-len(kept), first[pair], pair))
            continue
        rule = len(rules) + (1 << 32)
        rules[rule] = pair
        del at[pair]
        fresh: set[tuple] = set()
        for i in kept:
            j = after[i]
            left, right = before[i], after[j]
            if left >= 0:
                at.get((seq[left], seq[i]), {}).pop(left, None)
            if right < n:
                at.get((seq[j], seq[right]), {}).pop(j, None)
            seq[i], seq[j] = rule, None
            alive -= 1
            after[i] = right
            if right < n:
                before[right] = i
                at.setdefault((rule, seq[right]), {})[i] = None
                fresh.add((rule, seq[right]))
            if left >= 0:
                at.setdefault((seq[left], rule), {})[left] = None
                fresh.add((seq[left], rule))
        for new in sorted(fresh, key=lambda p: min(at.get(p) or (n,))):
            first.setdefault(new, n + len(first))
            if len(at.get(new, ())) > 1:
                heapq.heappush(heap, (-len(at[new]), first[new], new))
    left_over = [x for x in seq if x is not None]
    uses: Counter = Counter(x for x in left_over if x in rules)
    for a, b in rules.values():
        uses.update(x for x in (a, b) if x in rules)
    return left_over, rules, uses


def expansions(rules: dict[int, tuple], least: int) -> list[str]:
    """The texts of the rules that stand for at least `least` tokens."""
    text: dict[int, list] = {}
    for number, pair in rules.items():  # a rule is made of earlier ones
        text[number] = [t for x in pair for t in (text[x] if x in text else [x])]
    return [" ".join(map(str, t)) for t in text.values() if len(t) >= least]


def grammar_ratio(sequence: list) -> float:
    """Size of the Re-Pair grammar against the sequence: small where rules are reused much, near 1
    where nothing repeats; 1 for an empty sequence."""
    return _figures(sequence)[0]


def _figures(sequence: list) -> tuple[float, float, dict[int, tuple]]:
    """Ratio, reuse and rules of the grammar; reuse is the mean number of uses of a rule, 0 if
    there is none."""
    if not sequence:
        return 1.0, 0.0, {}
    seq, rules, uses = re_pair(sequence)
    return (len(seq) + 2 * len(rules)) / len(sequence), sum(uses.values()) / len(rules) if rules else 0.0, rules


def features(head: str | None) -> tuple[float, float, float, float, int, str, list[str]]:
    """(shape_ratio, rule_reuse, literal_share, literal_ratio, longest_line, header, rules) of a
    file's head.

    shape_ratio: grammar ratio of its tokens with single-letter names and numbers made alike, so a
    minifier's idioms become rules. rule_reuse: how often such a rule is used, on average.
    literal_share: the part of its characters inside numbers and long unbroken strings.
    literal_ratio: grammar ratio of those characters, near 1 for data that is close to random.
    header: the comments before the first line of code, in lower case. rules: the texts of the
    grammar's rules of `RULE_TOKENS` tokens and more.
    """
    head = head or ""
    shape = [("n" if t[0].isdigit() else "v" if len(t) == 1 and t.isalpha() else t) for t in _TOKEN.findall(head)]
    literals = _LITERAL.findall(head)
    text = "".join(x[2:] if x[:2] in ("0x", "\\x") else x for x in literals)
    dense = sum(map(len, literals)) / max(1, len(re.sub(r"[\s,'\"+]", "", head)))
    lines, block = [], False
    for line in head.split("\n"):
        s = line.strip()
        if block or s.startswith(("/*", "//", "#", "*", "--", "<!--", '"""', "'''", ";;")):
            if s.startswith(("#include", "#define", "#if", "#pragma", "#import")):
                break
            block = (block or s.startswith("/*")) and "*/" not in s
            lines.append(s)
        elif s:
            break
    header = re.sub(r"\s+", " ", " ".join(lines)).lower()
    ratio, reuse, rules = _figures(shape)
    return ratio, reuse, min(1.0, dense), grammar_ratio(list(text)), max(map(len, head.split("\n"))), header, expansions(rules, RULE_TOKENS)


#: Shorter rules are idioms of a language, not of a file.
RULE_TOKENS = 8
_HEAD = pa.schema(
    [("file_id", pa.int64()), ("shape_ratio", pa.float64()), ("rule_reuse", pa.float64()), ("literal_share", pa.float64()), ("literal_ratio", pa.float64()), ("longest_line", pa.int32()), ("header", pa.string()), ("rules", pa.list_(pa.string()))]
)


def _read_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [features(h) for h in batch.columns[1].to_pylist()]
        cols = list(zip(*got, strict=True)) if got else [[]] * (len(_HEAD) - 1)
        yield pa.RecordBatch.from_arrays([batch.columns[0], *[pa.array(list(c), f.type) for c, f in zip(cols, list(_HEAD)[1:], strict=True)]], schema=_HEAD)


def shared_rules(read: DataFrame, projects: DataFrame) -> DataFrame:
    """(file_id, n_rules, n_shared) of `read(file_id, rules)`: how many of a file's rules occur in
    files of more than one project of `projects(file_id, project)`. Rules meet by their text's
    hash, and only (rule, project) pairs are counted, so a rule of very many files is small."""
    each = read.select("file_id", F.explode("rules").alias("rule")).select("file_id", F.xxhash64("rule").alias("rule")).join(projects, "file_id")
    spread = each.groupBy("rule", "project").agg(F.lit(1).alias("one")).groupBy("rule").agg(F.count("one").alias("n"))
    told = each.join(spread.where("n > 1").select("rule", F.lit(1).alias("shared")), "rule", "left")
    return told.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_rules"), F.count("shared").alias("n_shared"))


def _any(column: Column, patterns: list[str]) -> Column:
    return F.coalesce(column.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def classify(files: DataFrame, heads: DataFrame, known: DataFrame) -> DataFrame:
    """One row per file id of `files(id, project, file_path, size, content_hash)`: its grammar
    figures and `kind`, the first of 'data', 'minified', 'vendored', 'generated' that applies, or
    null for hand-written source.

    data: most of the head is numbers or unbroken strings whose grammar finds little to reuse.
    minified: long lines, on average and in the head, whose grammar reuses rules, and no data.
    vendored: a hash on the list `known(package, content_hash)`, a folder that package managers
    reserve, or a header that names a package of the list with a version. generated: a name or
    folder that generators reserve, or a header that says a tool wrote the file. Only comments
    before the first code are headers, whole ones, and names count by their reserved form, never
    for a word in them. `n_rules` and `n_shared` are the file's grammar rules and how many of them
    other projects share.

    `heads(file_id, n_lines, head)` may lack files or hold nulls: such a file is judged by path
    and hash. Hashes compare without case and blanks, paths without case and with either slash.
    Repeated rows of a file count once; of differing rows the greatest values count.
    """
    path = F.lower(F.regexp_replace("file_path", r"\\", "/"))
    one = files.groupBy(F.col("id").alias("file_id")).agg(
        F.max(path).alias("path"), F.max("size").alias("size"), F.max(F.lower(F.trim("content_hash"))).alias("hash"), F.max("project").alias("project")
    )
    first = heads.groupBy("file_id").agg(F.max("n_lines").alias("n_lines"), F.max("head").alias("head"))
    schema = "file_id bigint, shape_ratio double, rule_reuse double, literal_share double, literal_ratio double, longest_line int, header string, rules array<string>"
    read = materialize(first.select(F.col("file_id").cast("bigint").alias("file_id"), "head").mapInArrow(_read_heads, schema), "heads")
    listed = known.select(F.lower(F.trim("content_hash")).alias("hash"), F.lit(True).alias("listed")).where("hash is not null").distinct()
    names = F.array_distinct(F.transform(F.regexp_extract_all("header", F.lit(NAMED_VERSION), F.lit(1)), lambda x: x))
    packages = known.select(F.lower(F.trim("package")).alias("package")).where("package <> ''").distinct()
    named = read.where(F.col("header").rlike(NAMED_VERSION)).select("file_id", F.explode(names).alias("package")).join(packages, "package", "left_semi").select("file_id").distinct().withColumn("named", F.lit(True))
    shared = shared_rules(read, one.select("file_id", "project"))
    every = one.join(first.drop("head"), "file_id", "left").join(read.drop("rules"), "file_id", "left").join(listed, "hash", "left").join(named, "file_id", "left").join(shared, "file_id", "left")
    header = F.coalesce("header", F.lit(""))
    per_line = F.col("size") / F.greatest(F.col("n_lines"), F.lit(1))
    data = (F.col("literal_share") >= 0.6) & (F.col("literal_ratio") >= 0.35) & (F.col("size") >= 2000)
    minified = (per_line >= 100) & (F.col("longest_line") >= 120) & (F.col("shape_ratio") < 0.95)
    vendored = F.coalesce("listed", "named", F.lit(False)) | path_like(OUTSIDE_PATH)
    generated = path_like(TOOL_PATH) | _any(header, MADE_BY_TOOL)
    kind = (
        F.when(F.coalesce(data, F.lit(False)), "data")
        .when(F.coalesce(minified, F.lit(False)), "minified")
        .when(F.coalesce(vendored, F.lit(False)), "vendored")
        .when(F.coalesce(generated, F.lit(False)), "generated")
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rules", "n_shared")]
    return every.select("file_id", "path", "size", "n_lines", "shape_ratio", "rule_reuse", "literal_share", "literal_ratio", "longest_line", "header", *counts, kind.alias("kind"))


def path_like(pattern: str) -> Column:
    return F.coalesce(F.col("path").rlike(pattern), F.lit(False))
