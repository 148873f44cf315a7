"""Ranked full-text search, literal and pattern search, and links inside notes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.norm import camel_words, glob_to_like, graph_path
from skein.plans.graph import PropertyGraph

K1, B = 1.2, 0.75
#: What a label adds to a node's rank, and labels that are never found (fixed values).
BOOST = {"Function": 10.0, "Method": 10.0, "Route": 8.0, "Class": 5.0, "Interface": 5.0, "Type": 5.0, "Enum": 5.0}
NOISE = ("File", "Folder", "Module", "Section", "Variable", "Project")


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def code_words(g: PropertyGraph) -> DataFrame:
    """(id, words): what a node can be found by: its name, whole and split, its qualified name,
    label and path."""
    return g.nodes.select("id", "label", F.concat(words(F.col("name")), camel_words(F.coalesce("name", F.lit(""))), words(F.col("qualified_name")), words(F.col("label")), words(F.col("file_path"))).alias("words"))


def query_words(text: str) -> list[str]:
    return list(dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z0-9_]+", text)))


def bm25(docs: DataFrame, terms: Sequence[str], every: bool = False) -> DataFrame:
    """(id, score) of the documents `docs(id, words)` that hold a term, or all of them if `every`.

    score is the sum over the terms of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length /
    mean length)), idf being ln((N - df + 0.5) / (df + 0.5)), at least 1e-6. Term counts are taken
    inside each row; only the totals, one row, are gathered before scoring.
    """
    terms = list(dict.fromkeys(terms))
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    counted = docs.select("id", F.size("words").alias("len"), *[_count(t).alias(f"t{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.sum((F.col(f"t{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(terms))])
    hit = None
    for i in range(len(terms)):
        here = F.col(f"t{i}") > 0
        hit = here if hit is None else (hit & here if every else hit | here)
    scored = counted.where(hit).join(F.broadcast(stats), F.lit(True))
    score = F.lit(0.0)
    for i in range(len(terms)):
        t, d = F.col(f"t{i}"), F.col(f"d{i}")
        idf = F.greatest(F.log((F.col("n") - d + 0.5) / (d + 0.5)), F.lit(1e-6))
        score = score + idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return scored.select("id", score.alias("score"))


def _count(term: str) -> Column:
    return F.size(F.filter("words", lambda w: w == term))


def search_nodes(g: PropertyGraph, text: str, top: int = 50, file: str | None = None) -> DataFrame:
    """Nodes by BM25 and the boost of their label, the best first; `file` keeps those whose path
    fits a glob. Scores are of the whole graph."""
    found = g.nodes.where(~F.col("label").isin(*NOISE))
    if file is not None:
        found = found.where(F.lower("file_path").like(glob_to_like(file.lower())))
    hits = bm25(code_words(g), query_words(text)).join(found.select("id", "label", "name"), "id")
    boost = F.coalesce(F.create_map(*[F.lit(x) for kv in BOOST.items() for x in kv])[F.col("label")], F.lit(0.0))
    return hits.select("id", "label", "name", F.round(F.col("score") + boost, 6).alias("rank")).orderBy(F.desc("rank"), "id").limit(top)


def search_code(g: PropertyGraph, text: str) -> DataFrame:
    """Nodes that hold the words of `text` next to each other; if there are none, nodes whose name
    or qualified name holds the text, case apart."""
    phrase = " " + " ".join(query_words(text)) + " "
    found = code_words(g).where(F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).contains(phrase)).select("id")
    if found.isEmpty():
        low = text.lower()
        found = g.nodes.where(F.lower("name").contains(low) | F.lower("qualified_name").contains(low)).select("id")
    return found


def search_notes(notes: DataFrame, text: str, top: int = 50) -> DataFrame:
    """Notes in use that hold all words in title, body or tags, by BM25; if there are none, those
    whose texts hold the whole phrase, the latest first."""
    live = notes.where("status <> 'deprecated'")
    docs = live.select("id", F.concat(words(F.col("title")), words(F.col("body_markdown")), words(F.array_join("tags", " "))).alias("words"))
    hits = bm25(docs, query_words(text), every=True)
    if hits.isEmpty():
        low = text.lower()
        holds = F.lit(False)
        for c in ("title", "body_markdown", "slug", "author", "source_file"):
            holds = holds | F.coalesce(F.lower(c).contains(low), F.lit(False))
        return live.where(holds).orderBy(F.desc("updated_at"), "id").limit(top).select("id", F.lit(0.0).alias("score"))
    return hits.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(top)


def interleaved(hits: dict[str, DataFrame], top: int) -> DataFrame:
    """(source, id, r, total): the hits of each source, `id` in order, in turn: the first of each,
    then the second, up to `top` rows. Only `top` rows a source are ranked; `total` counts all."""
    parts = []
    for name, df in hits.items():
        ids = df.select("id").distinct()
        total = ids.agg(F.count(F.lit(1)).alias("total"))
        few = ids.orderBy("id").limit(top).withColumn("r", F.row_number().over(Window.orderBy("id")))
        parts.append(few.join(F.broadcast(total), F.lit(True)).select(F.lit(name).alias("source"), "id", "r", "total"))
    return reduce(DataFrame.unionByName, parts).orderBy("r", "source", "id").limit(top)


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """The lines of each text with their numbers from 1."""
    return docs.select("*", F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("line_no", F.col("n") + 1).drop("n", text)


def grep(docs: DataFrame, pattern: str, literal: bool = False) -> DataFrame:
    """Lines that hold a text or match a pattern; several words match in order, with anything
    between. The text is tested whole first, so texts without a hit are never split."""
    if not literal and " " in pattern and not re.search(r"[\\^$.|?*+()\[\]{}]", pattern):
        pattern = ".*".join(pattern.split())
    test = (lambda c: c.contains(pattern)) if literal else (lambda c: c.rlike(pattern))
    return lines(docs.where(test(F.col("text")))).where(test(F.col("line")))


def literal_hits(docs: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Every line and column, from 1, at which one of a few literal texts stands, the hits of one
    text in a line not overlapping. Empty texts stand nowhere."""
    wanted = [w for w in dict.fromkeys(wanted) if w]
    if not wanted:
        return docs.select("doc_id", F.lit(0).alias("line_no"), F.lit("").alias("literal"), F.lit(0).alias("column")).where(F.lit(False))

    def hits(w: str) -> Column:
        parts = F.split("line", re.escape(w).replace(r"\ ", " "), -1)
        ends = F.aggregate(
            F.slice(parts, 1, F.size(parts) - 1), F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(F.concat(acc["at"], F.array(acc["n"] + F.length(p) + 1)).alias("at"), (acc["n"] + F.length(p) + len(w)).alias("n")),
        )["at"]
        return F.transform(ends, lambda c: F.struct(F.lit(w).alias("literal"), c.alias("column")))

    any_of = reduce(lambda a, b: a | b, [F.col("text").contains(w) for w in wanted])
    here = reduce(lambda a, b: a | b, [F.col("line").contains(w) for w in wanted])
    found = lines(docs.where(any_of)).where(here).withColumn("hit", F.explode(F.concat(*[hits(w) for w in wanted])))
    return found.select("doc_id", "line_no", "hit.literal", "hit.column")


def score_hits(g: PropertyGraph, hits: DataFrame) -> DataFrame:
    """A score per node that was hit: calls into it, 10 for callables, 15 for routes, less 50 in
    vendored paths and 5 in tests."""
    d = g.degrees("CALLS").select("id", "in_degree")
    n = g.nodes.join(hits.select("id").distinct(), "id", "left_semi").join(d, "id", "left")
    p = F.lower(graph_path(F.col("file_path")))
    bonus = F.when(F.col("label").isin("Function", "Method"), 10).when(F.col("label") == "Route", 15).otherwise(0)
    malus = F.when(p.rlike(r"(^|/)(vendor|vendored|third_party|node_modules)/"), 50).otherwise(0) + F.when(p.contains("test"), 5).otherwise(0)
    return n.select("id", "name", (F.coalesce("in_degree", F.lit(0)) + bonus - malus).alias("score"))


#: A link and its other name, as notes write them, and what the heading above a link makes of it,
#: in order: the first row of which a word stands in the heading (fixed values).
LINK = r"\[\[([^\]|\[]+)(?:\|([^\]]+))?\]\]"
HEADING_WORDS = [
    (("décision", "decision"), "DECIDES"),
    (("bug",), "AFFECTS"),
    (("à faire", "todo", "refactor"), "TODO_FOR"),
    (("explication", "explique", "contexte"), "EXPLAINS"),
]
#: What a target is by its form, in order (fixed values).
TARGET_FORMS = [(r"[0-9]+", "code"), (r".*[/\\].*", "path"), (r"[a-z0-9][a-z0-9-]*", "human")]
_LINK = re.compile(LINK)


def _edge_type(heading: str) -> str:
    return next((kind for words_, kind in HEADING_WORDS if any(w in heading for w in words_)), "MENTIONS")


def link_kind(target: str) -> str:
    return next((kind for form, kind in TARGET_FORMS if re.fullmatch(form, target, re.S)), "unknown")


def wikilinks_of(markdown: str | None) -> list[tuple[str, str | None, str, str]]:
    """(target, alias, kind, edge type) of each link; the edge type follows the last heading above
    it, headings inside code fences not counting."""
    out: list[tuple[str, str | None, str, str]] = []
    fence, kind = "", "MENTIONS"
    for line in (markdown or "").split("\n"):
        if fence:
            if line.startswith(fence * 3):
                fence = ""
            inside = True
        else:
            m = re.match(r"(`{3,}|~{3,})", line)
            inside = bool(m)
            fence = m[1][0] if m else ""
        links = _LINK.findall(line)
        heading = None if inside else re.match(r"#{1,6}\s+(.+)$", line)
        out += [(t.strip(), a.strip() or None, link_kind(t.strip()), kind) for t, a in links]
        if heading:
            kind = _edge_type(heading[1].lower().strip())
    return out


def wikilinks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links between notes, one row each. Texts without a link are dropped before parsing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, *x) for i, t in zip(b["id"], b["text"], strict=True) for n, x in enumerate(wikilinks_of(t))]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "target", "alias", "kind", "edge_type"])

    picked = docs.where(F.col(text_col).contains("[[")).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(run, "id bigint, ordinal int, target string, alias string, kind string, edge_type string")


#: The sections of a decision document, in order (fixed values).
SECTIONS = ("PURPOSE", "STACK", "ARCHITECTURE", "PATTERNS", "TRADEOFFS", "PHILOSOPHY")


def doc_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section, body): the parts under the six known second-level headings."""
    names = "|".join(SECTIONS)
    # split before each known heading: no repeated group, so long texts are safe
    parts = F.split(F.concat(F.lit("\n"), F.col(text_col)), rf"\n(?=## (?:{names})[ \t\r]*(?:\n|$))")
    rows = docs.select(F.col(id_col).alias("id"), F.explode(parts).alias("part")).where(F.col("part").rlike(rf"^## (?:{names})[ \t\r]*(\n|$)"))
    body = F.regexp_replace("part", r"^## \w+[ \t\r]*", "")
    return rows.select("id", F.regexp_extract("part", r"^## (\w+)", 1).alias("section"), F.btrim(body, F.lit(" \n")).alias("body"))


def section_problems(sections: DataFrame) -> DataFrame:
    """(id, problem): what keeps (id, section, body) rows from being a decision document: an
    'unknown' section, a section that is 'empty', or one that is 'repeated'."""
    n = F.count(F.lit(1)).over(Window.partitionBy("id", "section"))
    problem = F.when(~F.coalesce(F.col("section").isin(*SECTIONS), F.lit(False)), "unknown").when(F.coalesce(F.trim("body"), F.lit("")) == "", "empty").when(n > 1, "repeated")
    return sections.withColumn("problem", problem).where("problem is not null").select("id", "section", "problem").distinct()


def merge_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, section, body): the sections of `new` over those of `old`; others are kept."""
    return old.join(new.select("id", "section"), ["id", "section"], "left_anti").select("id", "section", "body").unionByName(new.select("id", "section", "body"))


def render_sections(sections: DataFrame) -> DataFrame:
    """Documents put together again from (id, section, body), sections in their order."""
    order = F.create_map(*[x for i, s in enumerate(SECTIONS) for x in (F.lit(s), F.lit(i))])[F.col("section")]
    part = F.struct(order.alias("o"), F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.col("body")).alias("t"))
    return sections.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("text"))
