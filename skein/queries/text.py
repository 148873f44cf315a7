"""Text search, similarity, derivation and community queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import norm
from skein.operators import community as C
from skein.operators import derive as D
from skein.operators import lookup as L
from skein.operators import reach as R
from skein.operators import reports as P
from skein.operators import resolve as V
from skein.operators import similarity as S
from skein.operators import textsearch as T
from skein.plans.graph import PropertyGraph, prop
from skein.queries.cypher import GRAPH, j
from skein.queries.graph import _P
from skein.queries.reach import NOTES
from skein.session import materialize, table

_TABLE: dict = {}


def _g(sql: str | None = None):
    def add(f):
        _TABLE[f.__name__] = (lambda spark, sf_dir: f(PropertyGraph.from_tables(spark, sf_dir)), sql and GRAPH + sql)
        return f

    return add


def _n(sql: str | None = None):
    def add(f):
        _TABLE[f.__name__] = (lambda spark, sf_dir: f(P.note_states(table(spark, sf_dir, "human_nodes"))), sql and GRAPH + NOTES + sql)
        return f

    return add


def _t(sql: str | None = None):
    def add(f):
        _TABLE[f.__name__] = (f, sql)
        return f

    return add


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


_CAMEL = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(coalesce({0}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
CW = f", cw as (select id, label, name, {_words('name')} || {_CAMEL.format('name')} || {_words('qualified_name')} || {_words('label')} || {_words('file_path')} ws from n)\n"


def _bm25(docs: str, terms: list[str], every: bool = False) -> str:
    """SQL of the scores over a table `docs(id, ws)`."""
    tf = ", ".join(f"len(list_filter(ws, lambda w: w = '{t}')) t{i}" for i, t in enumerate(terms))
    ds = ", ".join(f"sum((t{i} > 0)::int) d{i}" for i in range(len(terms)))
    part = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(terms)))
    hit = (" and " if every else " or ").join(f"t{i} > 0" for i in range(len(terms)))
    return f", tf as (select id, len(ws) len, {tf} from {docs}), st as (select count(*) n, avg(len) mean, {ds} from tf), sc as (select id, {part} score from tf, st where {hit})\n"


@_g(CW + _bm25("cw", ["load", "guard"]) + "select id, label, name, round(score + case when label in ('Function', 'Method') then 10 when label in ('Class', 'Interface') then 5 else 0 end, 6) rank from sc join n using (id) where label not in ('File', 'Folder', 'Module', 'Section', 'Variable', 'Project') order by rank desc, id limit 50")
def s_bm25(g):
    return T.search_nodes(g, "load guard")


@_g(CW + _bm25("cw", ["load", "guard"]) + "select id, label, name, round(score + case when label in ('Function', 'Method') then 10 when label in ('Class', 'Interface') then 5 else 0 end, 6) rank from sc join n using (id) where label not in ('File', 'Folder', 'Module', 'Section', 'Variable', 'Project') and file_path ilike 'src%.ts' order by rank desc, id limit 50")
def s_bm25_glob(g):
    return T.search_nodes(g, "load guard", file="src/**.ts")


@_g(CW + "select id from cw where contains(' ' || array_to_string(ws, ' ') || ' ', ' load guard ')")
def s_search_code(g):
    return T.search_code(g, "load guard")


@_n(f", nd as (select id, {_words('title')} || {_words('body_markdown')} || {_words('array_to_string(tags, chr(32))')} ws from notes where status <> 'deprecated')" + _bm25("nd", ["reader", "graph"], True) + "select id, round(score, 6) score from sc order by 2 desc, 1 limit 50")
def s_notes(notes):
    return T.search_notes(notes, "reader graph")


_LINES = "with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no from documents)\n"


@_t(_LINES + "select doc_id, line_no, line from l where regexp_matches(line, 'export (class|function) [a-z]+Guard')")
def s_grep(spark, sf_dir):
    return T.grep(table(spark, sf_dir, "documents").select("doc_id", "text"), "export (class|function) [a-z]+Guard").select("doc_id", "line_no", "line")


@_t(
    _LINES
    + """, w as (select unnest(['retry budget', 'façade', 'return']) literal), h as (select doc_id, line_no, literal, string_split(line, literal) p from l, w where instr(line, literal) > 0),
 i as (select doc_id, line_no, literal, p, unnest(range(1, len(p))) k from h) select doc_id, line_no, literal, (1 + list_sum(list_transform(p[1:k], lambda x: len(x))) + (k - 1) * len(literal))::int as \"column\" from i"""
)
def s_literal(spark, sf_dir):
    return T.literal_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), ["retry budget", "façade", "return"])


@_t(
    GRAPH
    + f""", h as (select distinct n.id from documents d join n on n.project = d.project and n.qualified_name = d.about_qn where contains(d.text, 'return')), c as (select target_id id, count(*) k from calls group by 1)
 select n.id id, n.name, (coalesce(k, 0) + case when label in ('Function', 'Method') then 10 when label = 'Route' then 15 else 0 end - case when regexp_matches(lower({_P}), '(^|/)(vendor|vendored|third_party|node_modules)/') then 50 else 0 end - case when contains(lower({_P}), 'test') then 5 else 0 end)::bigint score
 from n join h on h.id = n.id left join c on c.id = n.id"""
)
def s_grep_score(spark, sf_dir):
    """The symbols that texts with a call are about, by their calls, kind and place."""
    g = PropertyGraph.from_tables(spark, sf_dir)
    about = g.nodes.select("id", "project", F.col("qualified_name").alias("about_qn"))
    hits = T.grep(table(spark, sf_dir, "documents").select("doc_id", "project", "about_qn", "text"), "return").join(about, ["project", "about_qn"])
    return T.score_hits(g, hits).select("id", "name", F.col("score").cast("bigint").alias("score"))


@_g(f"select distinct project, split_part({_P}, '/', 1) top from n where {_P} like '%/%'")
def s_toplevel(g):
    p = norm.graph_path(F.col("file_path"))
    return g.nodes.where(p.contains("/")).select("project", F.substring_index(p, "/", 1).alias("top")).distinct()


def join_grep_to_symbol(spark, sf_dir):
    """Lines that hold a call, in texts about a symbol: the innermost definition at that place of
    the symbol's file, with its score."""
    g = PropertyGraph.from_tables(spark, sf_dir)
    about = g.nodes.select("project", F.col("qualified_name").alias("about_qn"), "file_path", F.coalesce("start_line", F.lit(1)).alias("s"))
    hits = T.grep(table(spark, sf_dir, "documents").select("doc_id", "project", "about_qn", "text"), "return")
    points = hits.join(about, ["project", "about_qn"]).select(F.concat_ws(":", "doc_id", "line_no").alias("point_id"), "project", "file_path", (F.col("s") + F.col("line_no") - 1).alias("line"))
    return L.innermost(g, points)


_TABLE["join_grep_to_symbol"] = (
    join_grep_to_symbol,
    GRAPH
    + ", l as (select doc_id, project, about_qn, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no from documents), p as (select doc_id || ':' || line_no point_id, n.project, n.file_path, coalesce(n.start_line, 1) + line_no - 1 ln from l join n on n.project = l.project and n.qualified_name = about_qn where contains(line, 'return'))"
    " select point_id, d.id, d.start_line, d.end_line, row_number() over (partition by point_id order by d.end_line - d.start_line, d.start_line desc, d.id) rank from p join n d on d.project = p.project and d.file_path = p.file_path and ln between d.start_line and d.end_line and d.label not in ('Module', 'Package', 'File', 'Folder') qualify rank <= 1",
)


@_n(", s as (select id, regexp_replace(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:200] slug from notes) select id, slug from s")
def fn_slugify(notes):
    return notes.select("id", norm.slug(F.col("title")).alias("slug"))


def _linked(notes):
    """The notes with a link to each node they name under a heading of their label."""
    heading = F.when(F.col("label") == "BugNote", "# Bug").when(F.col("label") == "ADR", "# Décision").when(F.col("label") == "RefactorPlan", "## TODO").otherwise("# Notes")
    links = F.transform(F.coalesce("cbm_node_ids", F.array().cast("array<bigint>")), lambda x: F.concat(F.lit("see [["), x.cast("string"), F.lit("|node]] and [["), F.col("slug"), F.lit("]]")))
    return notes.select("id", F.concat(heading, F.lit("\n"), F.array_join(links, "\n")).alias("text"))


@_n(
    ", x as (select id, label, slug, unnest(cbm_node_ids) node, generate_subscripts(cbm_node_ids, 1) i from notes), k as (select *, case label when 'BugNote' then 'AFFECTS' when 'ADR' then 'DECIDES' when 'RefactorPlan' then 'TODO_FOR' else 'MENTIONS' end edge_type from x where node is not null and slug is not null)"
    " select id, target, alias, kind, edge_type, count(*) n from (select id, node::varchar target, 'node' alias, case when node >= 0 then 'code' else 'unknown' end kind, edge_type from k union all select id, trim(slug), null, case when regexp_full_match(trim(slug), '[0-9]+') then 'code' when contains(slug, '/') then 'path' when regexp_full_match(trim(slug), '[a-z0-9][a-z0-9-]*') then 'human' else 'unknown' end, edge_type from k) group by all"
)
def fn_wikilinks(notes):
    return T.wikilinks(_linked(notes), "id", "text").groupBy("id", "target", "alias", "kind", "edge_type").agg(F.count(F.lit(1)).alias("n"))


def _decisions(notes):
    """A decision document of three sections from each note."""
    text = F.concat(F.lit("intro\n## PURPOSE\n\n"), "title", F.lit("\n## NOTES\nno section\n## STACK\n"), F.coalesce("status", F.lit("")), F.lit("\n\n## PHILOSOPHY\n"), F.coalesce("source", F.lit("")))
    return notes.where("title is not null").select("id", text.alias("text"))


@_n(" select id, 'PURPOSE' \"section\", title || chr(10) || '## NOTES' || chr(10) || 'no section' body from notes where title is not null union all select id, 'STACK', coalesce(status, '') from notes where title is not null union all select id, 'PHILOSOPHY', coalesce(source, '') from notes where title is not null")
def fn_doc_sections(notes):
    return T.doc_sections(_decisions(notes), "id", "text")


@_n(" select id, 'STACK' \"section\", 'empty' problem from notes where title is not null and trim(coalesce(status, '')) = '' union all select id, 'PHILOSOPHY', 'empty' from notes where title is not null and trim(coalesce(source, '')) = '' union all select id, 'STATUS', 'unknown' from notes where title is not null and id % 7 = 0 union all select id, 'PURPOSE', 'repeated' from notes where title is not null and id % 5 = 0")
def fn_doc_problems(notes):
    """The sections of decision documents, some with a section too many, that keep them from being valid."""
    s = T.doc_sections(_decisions(notes), "id", "text")
    more = s.where("section = 'PURPOSE' and id % 5 = 0").unionByName(s.where("section = 'PURPOSE' and id % 7 = 0").withColumn("section", F.lit("STATUS")))
    return T.section_problems(s.unionByName(more))


@_n(" select id, '## PURPOSE' || chr(10) || chr(10) || title || chr(10) || '## NOTES' || chr(10) || 'no section' || chr(10) || chr(10) || case when id % 2 = 0 then '## STACK' || chr(10) || chr(10) || 'none' else '## STACK' || chr(10) || chr(10) || coalesce(status, '') end || chr(10) || chr(10) || '## PHILOSOPHY' || chr(10) || chr(10) || coalesce(source, '') \"text\" from notes where title is not null")
def fn_doc_merge(notes):
    """Decision documents with a new stack section for every second note, written out again."""
    s = T.doc_sections(_decisions(notes), "id", "text")
    new = s.where("section = 'STACK' and id % 2 = 0").withColumn("body", F.lit("none"))
    return T.render_sections(T.merge_sections(s, new))


@_g(f"select id, {_CAMEL.format('name')} words from n")
def fn_camel_split(g):
    return g.nodes.select("id", norm.camel_words(F.coalesce("name", F.lit(""))).alias("words"))


@_g(f", w as (select id, unnest(list_distinct({_CAMEL.format('name')})) token from n where label = 'Function'), d as (select token, count(*) df from w group by 1) select token, df, round(ln((select count(*) from n where label = 'Function') / df), 6) idf from d")
def fn_idf(g):
    docs = g.nodes.where("label = 'Function'").select("id", norm.camel_words(F.coalesce("name", F.lit(""))).alias("tokens"))
    return S.idf(docs).select("token", "df", F.round("idf", 6).alias("idf"))


_AB = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in S.ABBREVIATIONS.items()) + "}"
_TOKENS = f"list_concat({_CAMEL.format('name')}, list_filter(list_transform({_CAMEL.format('name')}, lambda x: ({_AB})[x]), lambda x: x is not null))"


@_g(f"select id, {_TOKENS} tokens from n")
def fn_tokenize(g):
    return g.nodes.select("id", S.name_tokens(F.coalesce("name", F.lit(""))).alias("tokens"))


@_g(f"select e.id id, case when coalesce({j('e', 'confidence')}, '') = '' then '' when try_cast({j('e', 'confidence')} as double) >= 0.7 then 'high' when try_cast({j('e', 'confidence')} as double) >= 0.45 then 'medium' when try_cast({j('e', 'confidence')} as double) >= 0.25 then 'speculative' else '' end band from e where type = 'CALLS'")
def fn_confidence_band(g):
    return g.calls.select("id", norm.confidence_band(prop("confidence").try_cast("double")).alias("band"))


def _near(a: str, b: str) -> str:
    fold = lambda x: f"string_split(trim(regexp_replace(replace(coalesce({x}, ''), '\\', '/'), '^[A-Za-z]:/', '/'), '/'), '/')[:-2]"
    same = f"len(list_filter(range(1, least(len({fold(a)}), len({fold(b)})) + 1), lambda i: ({fold(a)})[1:i] = ({fold(b)})[1:i]))"
    return f"case when greatest(len({fold(a)}), len({fold(b)})) > 0 then 1.0 + 0.1 * {same} / greatest(len({fold(a)}), len({fold(b)})) else 1.0 end"


@_g(f"select e.id id, round({_near('a.file_path', 'b.file_path')}, 6)::double proximity from calls e join n a on a.id = source_id join n b on b.id = target_id")
def fn_proximity(g):
    p = g.nodes.select("id", "file_path")
    both = g.calls.join(p.select(F.col("id").alias("source_id"), F.col("file_path").alias("a")), "source_id").join(p.select(F.col("id").alias("target_id"), F.col("file_path").alias("b")), "target_id")
    return both.select("id", F.round(norm.proximity(F.col("a"), F.col("b")), 6).alias("proximity"))


@_t("select a.vec_id query_id, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding, b.embedding)::double, 5) desc, b.vec_id) rank, b.vec_id id from embeddings a, embeddings b where a.vec_id % 100 = 0 qualify rank <= 3")
def fn_cosine(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return S.nearest(v, v.where("id % 100 = 0"), 3).select("query_id", "rank", "id")


@_t("select b.vec_id id, round(least(list_cosine_similarity(b.embedding::double[], p.embedding::double[]), list_cosine_similarity(b.embedding::double[], q.embedding::double[])), 6) score from embeddings b, (select embedding from embeddings where vec_id = 0) p, (select embedding from embeddings where vec_id = 100) q order by 2 desc, 1 limit 16")
def s_vector_search(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    keys = [list(r["v"]) for r in v.where("id in (0, 100)").orderBy("id").collect()]  # the keywords of one question
    return S.keyword_search(v, keys)


@_t("with u as (select vec_id, list_transform(embedding, lambda x: round(x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))) * 127)) q from embeddings), z as (select q from u where vec_id = 0) select vec_id id, round(list_dot_product(u.q, z.q) / sqrt(list_dot_product(u.q, u.q) * list_dot_product(z.q, z.q)), 6) cosine from u, z")
def fn_cosine_i8(spark, sf_dir):
    """The cosine of every vector, as bytes, to the first one."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), S.quantized(F.col("embedding")).alias("q"))
    one = v.where("id = 0").select(F.col("q").alias("z"))
    return v.join(F.broadcast(one), F.lit(True)).select("id", F.round(S.cosine_i8(F.col("q"), F.col("z")), 6).alias("cosine"))


@_t()
def s_minhash(spark, sf_dir):
    sig = S.signatures(table(spark, sf_dir, "documents"), "doc_id", T.words(F.col("text")))
    return sig.select("doc_id", S.signature_hex(F.col("signature")).alias("fp"))


@_t(
    f"""with w as (select doc_id, {_words('text')} ws from documents), s as (select doc_id, list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) items from w where len(ws) >= 5),
 c as (select items, min(doc_id) class_id from s group by 1), u as (select class_id, len(items) n, unnest(items) item from c), j as (select a.class_id a, b.class_id b, any_value(a.n) na, any_value(b.n) nb, count(*) k from u a join u b on a.item = b.item and a.class_id < b.class_id group by 1, 2),
 p as (select a, b from j where k >= 0.8 * (na + nb - k)), l as (select class_id, count(*) n_links from (select a class_id from p union all select b from p) group by 1)
 select w.doc_id, coalesce(c.class_id, w.doc_id) class_id, coalesce(n_links, 0) n_links from w left join s on s.doc_id = w.doc_id left join c on c.items = s.items left join l on l.class_id = c.class_id"""
)
def s_similar(spark, sf_dir):
    return S.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", T.words(F.col("text")))


def _function_vectors(g):
    f = g.nodes.where("label in ('Function', 'Method')").select("id", F.concat(S.name_tokens(F.coalesce("name", F.lit(""))), T.words(F.col("qualified_name"))).alias("tokens"))
    return materialize(S.tfidf(f), "tfidf")


_TFIDF = f""", tk as (select id, list_concat({_TOKENS}, {_words('qualified_name')}) ts from n where label in ('Function', 'Method')), tf as (select id, token, count(*) tf from (select id, unnest(ts) token from tk) group by 1, 2), df as (select token, ln((select count(*) from tk) / count(*)) idf from tf group by 1),
 tw as (select id, token, tf * idf x from tf join df using (token) where idf > 0), tv as (select id, token, x / sqrt(sum(x * x) over (partition by id)) w from tw)
"""


@_g(_TFIDF + "select id, token, round(w, 6) w from tv")
def fn_tfidf(g):
    return _function_vectors(g).select("id", "token", F.round("w", 6).alias("w"))


@_g(
    _TFIDF
    + f", hit as (select x.id a, y.id b, sum(x.w * y.w) cosine from tv x join tv y on x.token = y.token and x.id < y.id group by 1, 2 having sum(x.w * y.w) >= 0.75) select a, b, round(cosine * {_near('p.file_path', 'q.file_path')}, 5)::double score from hit join n p on p.id = a join n q on q.id = b where regexp_extract(p.file_path, '\\.(\\w+)$', 1) = regexp_extract(q.file_path, '\\.(\\w+)$', 1)"
)
def s_semantic(g):
    """Functions alike by their words: every pair with a cosine of at least 0.75, exact, nearer
    paths weighing more."""
    p = g.nodes.select("id", "file_path")
    hit = S.cosine_join(_function_vectors(g), 0.75).join(p.withColumnsRenamed({"id": "a", "file_path": "pa"}), "a").join(p.withColumnsRenamed({"id": "b", "file_path": "pb"}), "b")
    hit = hit.where(F.regexp_extract("pa", r"\.(\w+)$", 1) == F.regexp_extract("pb", r"\.(\w+)$", 1))
    return hit.select("a", "b", F.round(F.col("cosine") * norm.proximity(F.col("pa"), F.col("pb")), 5).alias("score"))


@_n()
def s_ri(notes):
    """Two passes over the words of all notes, in the full 768 dimensions."""
    return S.blended_index(notes.select("id", T.words(F.col("body_markdown")).alias("tokens"))).select("token", "position", F.round("x", 6).alias("x"))


@_g()
def fn_random_index(g):
    w = g.nodes.select(F.explode(norm.camel_words(F.coalesce("name", F.lit("")))).alias("token")).distinct()
    return w.select("token", F.explode(S.index_positions(F.col("token"))).alias("p")).select("token", "p.position", "p.sign")


_VEC = f", v as (select id, [1.0::double, coalesce(start_line, 0)::double, coalesce(try_cast({j('n', 'complexity')} as double), 0)] v from n)\n"


@_g(
    _VEC
    + ", lk as (select distinct source_id src, target_id dst from calls), m as (select src id, [avg(v[1]), avg(v[2]), avg(v[3])] m from lk join v on v.id = dst group by 1), x as (select v.id, case when m is null then v else [0.7 * v[1] + 0.3 * m[1], 0.7 * v[2] + 0.3 * m[2], 0.7 * v[3] + 0.3 * m[3]] end u from v left join m on m.id = v.id)"
    " select id, round(u[1] / sqrt(u[1] * u[1] + u[2] * u[2] + u[3] * u[3]), 6) x from x"
)
def s_diffuse(g):
    v = g.nodes.select("id", F.array(F.lit(1.0), F.coalesce("start_line", F.lit(0)).cast("double"), F.coalesce(prop("complexity").try_cast("double"), F.lit(0.0))).alias("v"))
    return S.diffuse(v, R.links(g, "CALLS")).select("id", F.round(F.col("v")[0], 6).alias("x"))


# --- derivations


def _file_imports(g):
    """Imports as a source names them: the target file's name without its ending, seen from the
    importing file's folder."""
    p = g.nodes.where("label = 'File'").select("id", "project", "file_path")
    both = g.edges.where("type = 'IMPORTS'").drop("project").join(p.withColumnRenamed("id", "source_id"), "source_id")
    t = g.nodes.select(F.col("id").alias("target_id"), F.concat(F.lit("./"), F.regexp_extract(norm.graph_path(F.col("file_path")), r"([^/]*?)(\.\w+)?$", 1)).alias("source_module"))
    return both.join(t, "target_id").select("project", "file_path", "source_module")


_EXT = "['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs']"


@_g(
    f", i as (select distinct f.project, f.file_path, './' || regexp_extract(trim(regexp_replace(replace(coalesce(t.file_path, ''), '\\', '/'), '^[A-Za-z]:/', '/'), '/'), '([^/]*?)(\\.\\w+)?$', 1) source_module from e join n f on f.id = source_id and f.label = 'File' join n t on t.id = target_id where e.type = 'IMPORTS'),"
    f" b as (select *, trim(regexp_replace({_P}, '(^|/)[^/]*$', '') || '/' || source_module[3:], '/') base from i), c as (select b.*, unnest({_EXT}) x, generate_subscripts({_EXT}, 1) r from b),"
    f" k as (select project, {_P} p, min(file_path) found from n where label = 'File' group by 1, 2), h as (select c.project, c.file_path, source_module, arg_min(found, r) resolved from c join k on k.project = c.project and k.p = base || x group by 1, 2, 3)"
    " select i.project, i.file_path, i.source_module, resolved from i left join h on h.project = i.project and h.file_path = i.file_path and h.source_module = i.source_module"
)
def d_module_path(g):
    return D.module_paths(_file_imports(g), g.nodes.where("label = 'File'").select("project", "file_path"))


_XKEY = "concat_ws(':', x.project, x.file_path)"
_XPORT = f""", fx as (select distinct s.project || ':' || s.file_path f, t.project || ':' || t.file_path src from e join n s on s.id = source_id join n t on t.id = target_id where e.type = 'IMPORTS' and s.label = 'File' and s.file_path <> t.file_path),
 loc as (select {_XKEY} f, name from n x where coalesce({j('x', 'is_exported')}, '') in ('true', '1') and name is not null), twice as (select distinct f from (select f from loc group by f, name having count(*) > 1)),
 want as (select distinct {_XKEY} f, y.name nm from n x join n y on y.project = x.project and y.id % 9 = x.id % 9 where x.label = 'File' and y.label = 'Function' and y.id % 3 = 0),
 w(wf, wn, f) as (select f, nm, f from want union select wf, wn, fx.src from w join fx on fx.f = w.f where not exists (select 1 from twice where twice.f = w.f) and not exists (select 1 from loc where loc.f = w.f and loc.name = w.wn)),
 en as (select wf, wn, bool_or(exists (select 1 from twice where twice.f = w.f)) amb, count(distinct case when not exists (select 1 from twice where twice.f = w.f) and exists (select 1 from loc where loc.f = w.f and loc.name = w.wn) then f end) k, min(case when not exists (select 1 from twice where twice.f = w.f) and exists (select 1 from loc where loc.f = w.f and loc.name = w.wn) then f end) t from w group by 1, 2)
"""


@_g(_XPORT + "select wf file_path, wn \"name\", case when amb or k > 1 then 'ambiguous' when k = 1 then 'resolved' else 'missing' end status, case when not amb and k = 1 then t end target_file, case when not amb and k = 1 then wn end target_name from en")
def d_exports(g):
    """Where files find names, when every import is a `export *`: own exports first, then, over any
    number of files, those of what they import."""
    key = F.concat_ws(":", "project", "file_path")
    p = g.nodes.select("id", "project", "file_path", "name", F.coalesce(prop("is_exported"), F.lit("")).isin("true", "1").alias("x"), "label")
    none = lambda n: F.lit(None).cast("string").alias(n)
    local = p.where("x and name is not null").select(key.alias("file_path"), F.col("name").alias("exported_name"), F.col("name").alias("local_name"), none("imported_name"), none("source_file"), F.lit("local_named").alias("export_kind"))
    at = p.where("project is not null and file_path is not null").select("id", key.alias("f"), "file_path", "label")
    stars = g.edges.where("type = 'IMPORTS'").select("source_id", "target_id").join(at.where("label = 'File'").toDF("source_id", "f", "pa", "l"), "source_id").join(at.toDF("target_id", "src", "pb", "l2"), "target_id").where("pa <> pb")
    stars = stars.select(F.col("f").alias("file_path"), none("exported_name"), none("local_name"), none("imported_name"), F.col("src").alias("source_file"), F.lit("star_re_export").alias("export_kind")).distinct()
    wanted = p.where("label = 'File'").select("project", key.alias("file_path"), (F.col("id") % 9).alias("r")).join(p.where("label = 'Function' and id % 3 = 0").select("project", "name", (F.col("id") % 9).alias("r")), ["project", "r"]).select("file_path", "name").distinct()
    return D.resolve_exports(local.unionByName(stars), wanted)


_SITES = f""", st as (select e.id site_id, s.project, s.file_path, case e.id % 4 when 0 then lower(t.name) when 1 then regexp_replace(regexp_extract(t.qualified_name, '([^/]*)$', 1), '::', '.', 'g') else t.name end callee from calls e join n s on s.id = source_id join n t on t.id = target_id),
 d as (select id, project, file_path, name, qualified_name from n where label in ('Function', 'Method'))
"""


@_g(
    _SITES
    + """, sl as (select *, regexp_extract(callee, '([^.]*)$', 1) last from st), sm as (select distinct project, file_path, name from d), nm as (select project, name, count(*) c from d group by 1, 2), lo as (select project, lower(name) name, count(*) c from d group by 1, 2),
 dp as (select id, project, string_split(replace(qualified_name, '::', '.'), '.') p from d), tl as (select project, tail from (select id, project, array_to_string(p[len(p) - k + 1:], '.') tail from (select *, unnest(range(2, len(p) + 1)) k from dp)) group by 1, 2 having count(*) = 1)
 select site_id, case when sm.name is not null then 'same_module' when nm.c = 1 then 'unique_name' when tl.tail is not null and contains(callee, '.') then 'qualified_tail' when nm.c > 1 then 'suffix_match' when lo.c = 1 then 'fuzzy' else 'fuzzy_many' end strategy
 from sl left join sm on sm.project = sl.project and sm.file_path = sl.file_path and sm.name = sl.last left join nm on nm.project = sl.project and nm.name = sl.last left join tl on tl.project = sl.project and tl.tail = sl.callee left join lo on lo.project = sl.project and lo.name = lower(sl.last)
 where coalesce(sm.name, nm.name, tl.tail, lo.name) is not null"""
)
def d_calls_v1(g):
    """The calls of the graph as sources write them, by name, in small letters or with the path's
    last part in front, resolved again."""
    return D.resolve_calls(_call_sites(g), g.nodes.where("label in ('Function', 'Method')")).select("site_id", "strategy")


def _call_sites(g):
    src = g.nodes.select(F.col("id").alias("source_id"), F.col("project").alias("p"), "file_path")
    t = g.nodes.select(F.col("id").alias("target_id"), "name", "qualified_name")
    tail = F.regexp_replace(F.regexp_extract("qualified_name", r"([^/]*)$", 1), "::", ".")
    callee = F.when(F.col("id") % 4 == 0, F.lower("name")).when(F.col("id") % 4 == 1, tail).otherwise(F.col("name"))
    return g.calls.select("id", "source_id", "target_id").join(src, "source_id").join(t, "target_id").select(F.col("id").alias("site_id"), F.col("p").alias("project"), "file_path", callee.alias("callee"))


_TF = "regexp_matches(coalesce({0}.file_path, ''), '(^|/)(__tests__|tests|test|spec)/|(^|/)test_[^/]*$|_test\\.(go|py|rs|cpp|lua)$|\\.(test|spec)\\.(ts|js|tsx)|Test\\.(java|kt|cs|php)$|Spec\\.scala$|_spec\\.rb$')"
_TN = "coalesce(regexp_matches({0}.name, '^(Test|Benchmark|Example)([A-Z]|$)|^test_|^test[A-Z]') or {0}.name in ('test', 'it', 'describe', 'beforeAll', 'afterAll', 'beforeEach', 'afterEach', '@testset', '@test'), false)"


@_g(f"select distinct source_id, target_id from calls join n a on a.id = source_id join n b on b.id = target_id where ({_TF.format('a')} or {_TN.format('a')}) and not {_TF.format('b')} and not {_TN.format('b')}")
def d_tests(g):
    return D.tests_edges(g)


@_g(f", p as (select distinct project, string_split({_P}, '/') a from n where label = 'File' and {_P} <> '') select distinct project, array_to_string(a[1:i - 1], '/') parent, array_to_string(a[1:i], '/') child, case when i = len(a) then 'CONTAINS_FILE' else 'CONTAINS_FOLDER' end kind from (select project, a, unnest(range(1, len(a) + 1)) i from p)")
def d_structure(g):
    return D.structure(g.nodes.where("label = 'File'"))


@_g(f", w as (select distinct source_id id, unnest({_CAMEL.format('t.name')}) word from e join n t on t.id = target_id where e.type in ('DECORATES', 'USAGE')), c as (select word from w group by 1 having count(*) >= 2) select id, list(word order by word) tags from w where word in (select word from c) group by 1")
def d_decorator_tags(g):
    """The words of what decorates or marks a node, those that at least two nodes share."""
    t = g.nodes.select(F.col("id").alias("target_id"), norm.camel_words(F.coalesce("name", F.lit(""))).alias("words"))
    marks = g.edges.where("type in ('DECORATES', 'USAGE')").select(F.col("source_id").alias("id"), "target_id").join(t, "target_id").select("id", F.explode("words").alias("word")).distinct()
    return D.shared_tags(marks.groupBy("id").agg(F.collect_list("word").alias("words")))


@_g(f"select id, source_id, target_id from e where starts_with({j('e', 'resolution')}, 'cross_file')")
def d_stale_clear(g):
    return D.stale_derived(g).select("id", "source_id", "target_id")


@_t("""with c as (select l_orderkey "commit", l_partkey file, max(l_shipdate) "at" from lineitem group by 1, 2), k as (select * from c where "commit" in (select "commit" from c group by 1 having count(*) <= 20)),
 n as (select file, count(*) c from k group by 1), p as (select a.file a, b.file b, count(*) n from k a join k b on a."commit" = b."commit" and a.file < b.file group by 1, 2 having count(*) >= 2)
 select a, b, p.n n, round(p.n / least(x.c, y.c), 6) score from p join n x on x.file = a join n y on y.file = b where p.n / least(x.c, y.c) >= 0.05""")
def agg_coupling(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"), F.col("l_shipdate").alias("at"))
    return D.coupling(li, least=2, score=0.05).select("a", "b", "n", "score")


def _plain(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


_CONTAINED = "select k.id key_id, s.id symbol_id, (case when k.w = s.w then {same} else {part} end)::double confidence from k join s on k.project = s.project and k.w <> '' and (k.w = s.w or (len(k.w) >= 4 and contains(s.w, k.w)))"


@_g(f", k as (select id, project, {_plain('name')} w from n where label = 'Class'), s as (select id, project, {_plain('name')} w from n where label in ('Interface', 'Variable', 'Method')) " + _CONTAINED.format(same=0.85, part=0.75))
def join_config(g):
    """Classes as settings, and what is named after them."""
    return D.config_links(g.nodes.where("label = 'Class'"), g.nodes.where("label in ('Interface', 'Variable', 'Method')"))


@_g(f", k as (select id, project, {_plain('name')} w from n where label = 'Interface'), s as (select e.id, s.project, {_plain('t.name')} w from e join n s on s.id = source_id join n t on t.id = target_id where e.type = 'IMPORTS') " + _CONTAINED.format(same=0.95, part=0.8))
def join_dependency(g):
    """Interfaces as declared dependencies, and the imports that use one of their name."""
    own = g.nodes.select(F.col("id").alias("source_id"), F.col("project").alias("p"))
    t = g.nodes.select(F.col("id").alias("target_id"), "name")
    imports = g.edges.where("type = 'IMPORTS'").join(own, "source_id").join(t, "target_id").select("id", F.col("p").alias("project"), "name")
    return D.dependency_links(g.nodes.where("label = 'Interface'"), imports)


@_g(
    f", v as (select e.id, s.project, case when e.id % 2 = 0 then t.file_path else regexp_extract(replace(t.file_path, '\\', '/'), '([^/]*)$', 1) end file_path from e join n s on s.id = source_id join n t on t.id = target_id where e.type = 'CONFIGURES'), vp as (select id, project, {_P} p from v), f as (select id, project, {_P} p from n where label = 'File')"
    " select vp.id value_id, f.id file_id, (case when vp.p = f.p then 0.9 else 0.7 end)::double confidence from vp join f on f.project = vp.project and vp.p <> '' and f.p <> '' and regexp_extract(vp.p, '([^/]*)$', 1) = regexp_extract(f.p, '([^/]*)$', 1)"
)
def join_config_file(g):
    """The files that settings name, by path or by last part."""
    own = g.nodes.select(F.col("id").alias("source_id"), F.col("project").alias("p"))
    t = g.nodes.select(F.col("id").alias("target_id"), "file_path")
    value = F.when(F.col("id") % 2 == 0, F.col("file_path")).otherwise(F.regexp_extract(F.regexp_replace("file_path", r"\\", "/"), r"([^/]*)$", 1))
    values = g.edges.where("type = 'CONFIGURES'").select("id", "source_id", "target_id").join(own, "source_id").join(t, "target_id").select("id", F.col("p").alias("project"), value.alias("value"))
    return D.file_links(values, g.nodes.where("label = 'File'"))


@_g(", a as (select distinct t.name, s.project p from e join n t on t.id = target_id join n s on s.id = source_id where e.type = 'EMITS'), b as (select distinct t.name, s.project p from e join n t on t.id = target_id join n s on s.id = source_id where e.type = 'LISTENS_ON') select a.p from_project, b.p to_project, count(distinct a.name) n_channels from a join b on a.name = b.name and a.p <> b.p group by 1, 2")
def join_cross_repo(g):
    return D.cross_project(g)


_HTTP = """, hc as (select e.id call_id, s.id caller, s.project cp, case e.id % 3 when 0 then 'GET' when 1 then 'POST' end m, '/' || lower(t.name) || '/{}' path from e join n s on s.id = source_id join n t on t.id = target_id where e.type = 'HTTP_CALLS'),
 rt as (select id route_id, project rp, case id % 4 when 0 then 'GET' when 1 then 'POST' else 'ANY' end rm, '/' || lower(name) || '/{}' path from n where label in ('Function', 'Method'))
"""


def _http_calls(g):
    own = g.nodes.select(F.col("id").alias("source_id"), F.col("project").alias("p"))
    t = g.nodes.select(F.col("id").alias("target_id"), "name")
    h = g.edges.where("type = 'HTTP_CALLS'").select("id", "source_id", "target_id").join(own, "source_id").join(t, "target_id")
    return h.select(F.col("id").alias("call_id"), F.col("source_id").alias("caller_id"), F.col("p").alias("project"), F.when(F.col("id") % 3 == 0, "get").when(F.col("id") % 3 == 1, "POST").alias("method"), F.concat(F.lit("/"), F.lower("name"), F.lit("/:id")).alias("path"))


def _handlers(g):
    f = g.nodes.where("label in ('Function', 'Method')")
    return f.select(F.col("id").alias("route_id"), "project", F.when(F.col("id") % 4 == 0, "GET").when(F.col("id") % 4 == 1, "post").otherwise("ANY").alias("method"), F.concat(F.lit("/"), F.lower("name"), F.lit("/{id}")).alias("path"))


@_g(
    _HTTP
    + ", b as (select call_id, arg_min(route_id, coalesce(rm <> m, false)::int * 1000000000000 + route_id) route_id from hc join rt on rt.path = hc.path and cp <> rp and (m = rm or rm = 'ANY') group by 1) select call_id \"source\", route_id target, 'forward' direction from b union all select route_id, call_id, 'backward' from b"
)
def join_cross_routes(g):
    """HTTP calls to the functions that serve their route in other projects, both ways."""
    return D.both_ways(D.route_matches(_http_calls(g), _handlers(g)), "call_id", "route_id")


@_g(_HTTP + "select distinct caller caller_id, route_id handler_id from hc join rt on rt.path = hc.path and (coalesce(m, 'ANY') = rm or rm = 'ANY')")
def d_route_flows(g):
    return V.route_flows(_http_calls(g), _handlers(g).withColumnRenamed("route_id", "handler_id"))


@_g(
    """, x as (select project, name, min(id) t from n where label in ('Class', 'Interface') group by 1, 2), y as (select project, name, min(id) t from n where label in ('Function', 'Method', 'Class') group by 1, 2),
 w as (select a.id s, a.project p, b.name nm, e.type k from e join n a on a.id = source_id join n b on b.id = target_id where e.type in ('INHERITS', 'DECORATES'))
 select distinct s source_id, t target_id, k as \"type\" from w join x on x.project = w.p and x.name = w.nm where k = 'INHERITS' and s <> t union select distinct s, t, k from w join y on y.project = w.p and y.name = w.nm where k = 'DECORATES' and s <> t"""
)
def d_relations(g):
    """INHERITS and DECORATES found again from the names that sources give."""
    t = g.nodes.select(F.col("id").alias("target_id"), "name")
    own = g.nodes.select(F.col("id").alias("source_id"), F.col("project").alias("p"))
    told = g.edges.select("source_id", "target_id", "type").join(own, "source_id").join(t, "target_id").select("source_id", F.col("p").alias("project"), "name", "type")
    return D.relations(g, told.where("type = 'INHERITS'"), "INHERITS").unionByName(D.relations(g, told.where("type = 'DECORATES'"), "DECORATES"))


@_g(
    f", p as (select distinct project, {_P} f from n where {_P} <> ''), t as (select project, f, regexp_replace(regexp_replace(regexp_replace(f, '\\.(test|spec)(\\.\\w+)$', '\\2'), '_test(\\.\\w+)$', '\\1'), '(^|/)test_([^/]+)$', '\\1\\2') q from (select distinct project, case when id % 2 = 0 then regexp_replace({_P}, '(\\.\\w+)$', '.test\\1') else regexp_replace({_P}, '([^/]+)$', 'test_\\1') end f from n where label = 'File' and {_P} <> ''))"
    " select t.project, t.f test_path, q tested_path from t join p on p.project = t.project and p.f = q where q <> t.f and regexp_matches(t.f, '(^|/)(__tests__|tests|test|spec)/|(^|/)test_[^/]*$|_test\\.(go|py|rs|cpp|lua)$|\\.(test|spec)\\.(ts|js|tsx)')"
)
def d_tests_files(g):
    """Test files, one made up for every file, and what they test."""
    p = norm.graph_path(F.col("file_path"))
    f = g.nodes.where("label = 'File'").where(p != "")
    made = F.when(F.col("id") % 2 == 0, F.regexp_replace(p, r"(\.\w+)$", ".test$1")).otherwise(F.regexp_replace(p, r"([^/]+)$", "test_$1"))
    tests = f.select("project", made.alias("file_path")).distinct()
    return D.tests_files(tests.unionByName(g.nodes.select("project", "file_path"))).join(tests.select("project", F.col("file_path").alias("test_path")), ["project", "test_path"], "left_semi")


@_g(
    ", st as (select e.id site_id, s.project, s.file_path, t.name nm, e.type kind from e join n s on s.id = source_id join n t on t.id = target_id where e.type in ('USAGE', 'THROWS', 'DATA_FLOWS')), h as (select project, file_path, name, min(id) a from n where label in ('Function', 'Method') group by 1, 2, 3),"
    " o as (select project, name, min(id) b from n where label in ('Function', 'Method') group by 1, 2 having count(*) = 1) select site_id, kind type, coalesce(a, b) target_id from st left join h on h.project = st.project and h.file_path = st.file_path and h.name = nm left join o on o.project = st.project and o.name = nm where coalesce(a, b) is not null"
)
def d_usages(g):
    """What code uses and throws, found again by name."""
    src = g.nodes.select(F.col("id").alias("source_id"), F.col("project").alias("p"), "file_path")
    t = g.nodes.select(F.col("id").alias("target_id"), "name")
    sites = g.edges.where("type in ('USAGE', 'THROWS', 'DATA_FLOWS')").select("id", "source_id", "target_id", "type").join(src, "source_id").join(t, "target_id").select(F.col("id").alias("site_id"), F.col("p").alias("project"), "file_path", "name", "type")
    return V.usages(sites, g.nodes.where("label in ('Function', 'Method')"))


_V2 = """, sv as (select e.id site_id, s.project, s.file_path, t.name head, t.name tail, false as member from calls e join n s on s.id = source_id join n t on t.id = target_id where e.id % 3 <> 0
  union all select e.id, s.project, s.file_path, 'ns', t.name, true from calls e join n s on s.id = source_id join n t on t.id = target_id where e.id % 3 = 0),
 im as (select distinct s.project, s.file_path, case when e.id % 2 = 0 then t.name else 'ns' end local_name, case when e.id % 2 = 0 then t.name end imported, case when e.id % 2 = 0 then 'named' else 'namespace' end kind, t.file_path module from e join n s on s.id = source_id join n t on t.id = target_id where e.type = 'IMPORTS' and s.project = t.project and s.file_path <> t.file_path),
 df as (select project, file_path, name, min(id) id from n where label in ('Function', 'Method') group by 1, 2, 3),
 ex as (select project, file_path, name, count(*) c from n where label in ('Function', 'Method') and name is not null group by 1, 2, 3), bad as (select distinct project, file_path from ex where c > 1),
 asked as (select sv.site_id, sv.project, im.module, case when kind = 'namespace' then tail when not member then imported end want, kind from sv join im on im.project = sv.project and im.file_path = sv.file_path and im.local_name = sv.head),
 byi as (select site_id, id target_id, 'import_' || kind kind, 0.95 confidence from asked join ex on ex.project = asked.project and ex.file_path = asked.module and ex.name = asked.want join df on df.project = asked.project and df.file_path = asked.module and df.name = asked.want where (asked.project, asked.module) not in (select project, file_path from bad)),
 rest as (select * from sv where site_id not in (select site_id from asked)), same as (select site_id, id target_id, 'same_file' kind, 0.9 confidence from rest join df on df.project = rest.project and df.file_path = rest.file_path and df.name = rest.tail where not member),
 al as (select project, name, id, count(*) over (partition by project, name) c from n where label in ('Function', 'Method'))
"""


@_g(
    _V2
    + "select site_id, target_id, kind, confidence::double confidence from byi union all select site_id, target_id, kind, confidence::double from same union all select site_id, al.id, 'name', round(case when member then least(0.3, 1.0 / c) else 1.0 / c end, 6)::double from rest join al on al.project = rest.project and al.name = rest.tail where site_id not in (select site_id from same)"
)
def d_calls_v2(g):
    """The calls of the graph, a third of them as members of a namespace, through named and
    namespace imports of the files that import each other, their own file, or by name."""
    src = g.nodes.select(F.col("id").alias("source_id"), F.col("project").alias("p"), F.col("file_path").alias("f"))
    t = g.nodes.select(F.col("id").alias("target_id"), "name", F.col("project").alias("tp"), F.col("file_path").alias("tf"))
    both = lambda e: e.select("id", "source_id", "target_id").join(src, "source_id").join(t, "target_id")
    member = F.col("id") % 3 == 0
    sites = both(g.calls).select(F.col("id").alias("site_id"), F.col("p").alias("project"), F.col("f").alias("file_path"), F.when(member, F.concat(F.lit("ns."), "name")).otherwise(F.col("name")).alias("callee"), F.when(member, "member_call").otherwise("identifier_call").alias("call_kind"))
    named = F.col("id") % 2 == 0
    one = both(g.edges.where("type = 'IMPORTS'")).where("p = tp and f <> tf")
    # a module is named by its path from the top, seen from the importing file's folder
    depth = F.size(F.split(norm.graph_path(F.col("f")), "/")) - 1
    module = F.concat(F.lit("./"), F.array_join(F.array_repeat(F.lit(".."), depth), "/"), F.lit("/"), norm.graph_path(F.col("tf")))
    imports = one.select(F.col("p").alias("project"), F.col("f").alias("file_path"), F.when(named, F.col("name")).otherwise("ns").alias("local_name"), module.alias("source_module"), F.when(named, F.col("name")).alias("imported_name"), F.when(named, "named").otherwise("namespace").alias("import_kind")).distinct()
    d = g.nodes.where("label in ('Function', 'Method')").select("id", "project", "file_path", "name")
    none = F.lit(None).cast("string")
    exports = d.where("name is not null").select("project", "file_path", F.col("name").alias("exported_name"), F.col("name").alias("local_name"), none.alias("source_module"), none.alias("imported_name"), F.lit("local_named").alias("export_kind"))
    return V.resolve_sites(sites, imports, exports, d, g.nodes.select("project", "file_path").distinct())


@_g(_HTTP + "select cp project, coalesce(m, 'ANY') as \"method\", path, count(*) n_calls from hc group by 1, 2, 3")
def d_routes(g):
    return V.route_nodes(_http_calls(g))


@_g(
    ", m as (select distinct o.id owner, case when o.id % 2 = 0 then 'Class' else 'Interface' end kind, o.project, c.name from e join n o on o.id = source_id and o.label in ('Class', 'Interface', 'Function') join n c on c.id = target_id where e.type = 'CALLS')"
    " select c.owner class_id, i.owner interface_id from m c join m i on c.kind = 'Class' and i.kind = 'Interface' and c.project = i.project and c.name = i.name group by 1, 2 having count(*) = (select count(*) from m x where x.owner = i.owner)"
)
def d_semantic_rel(g):
    """Owners that have all that another asks for, the names that classes and functions call
    standing for methods: even ids as classes, odd ones as interfaces."""
    own = g.calls.select(F.col("source_id").alias("owner_id"), "target_id").distinct()
    o = g.nodes.where("label in ('Class', 'Interface', 'Function')").select(F.col("id").alias("owner_id"), "project", F.when(F.col("id") % 2 == 0, "Class").otherwise("Interface").alias("kind"))
    m = g.nodes.select(F.col("id").alias("target_id"), "name")
    return D.implements(own.join(o, "owner_id").join(m, "target_id").select("owner_id", "kind", "project", "name"))


# --- communities and capped selections


@_g()
def g_leiden(g):
    return C.communities(R.links(g, "CALLS"))


@_g()
def g_clusters(g):
    links = materialize(R.links(g, "CALLS"), "links")
    return C.cluster_report(C.communities(links), links, g.nodes.select(F.col("id").alias("node"), "name", "label", "qualified_name"))


@_g()
def cap_dual(g):
    return C.dual_cap(g.edges, 8, 8).select("project", "source_id", "target_id", "type")


@_g('select project, true "within", true "full" from (select distinct project from e)')
def cap_dual_sound(g):
    """Per project: that no node keeps more edges than it may, and that no edge was left out that
    has room at both ends; repeated edges count once."""
    kept = materialize(C.dual_cap(g.edges, 8, 8).select("project", "source_id", "target_id", "type"), "kept")
    side = lambda end, n: kept.groupBy(F.col("project").alias(f"p{n}"), F.col(end).alias(f"e{n}")).agg(F.count(F.lit(1)).alias(n))
    outs, ins = side("source_id", "o"), side("target_id", "i")
    both = _marked(g, kept).join(outs, F.col("project").eqNullSafe(F.col("po")) & (F.col("source_id") == F.col("eo")), "left").join(ins, F.col("project").eqNullSafe(F.col("pi")) & (F.col("target_id") == F.col("ei")), "left")
    o, i = F.coalesce("o", F.lit(0)), F.coalesce("i", F.lit(0))
    return both.groupBy("project").agg(F.bool_and((o <= 8) & (i <= 8)).alias("within"), F.bool_and(F.coalesce("kept", F.lit(False)) | (o >= 8) | (i >= 8)).alias("full"))


def _marked(g, kept):
    key = ["project", "source_id", "target_id", "type"]
    k = kept.distinct().toDF(*[f"k_{c}" for c in key]).withColumn("kept", F.lit(True))
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    return g.edges.select(*key).distinct().join(k, on, "left").select(*key, "kept")


@_g("select count(*) n_nodes, true connected, true named from (select source_id id from calls where source_id <> target_id union select target_id from calls where source_id <> target_id)")
def g_leiden_sound(g):
    """What must hold of communities: each is connected, and named after its least node."""
    links = R.links(g, "CALLS").where("src <> dst")
    found = materialize(C.communities(links), "communities")
    of = lambda x: found.toDF(x, f"c_{x}")
    inner = links.join(of("src"), "src").join(of("dst"), "dst").where("c_src = c_dst").select("src", "dst")
    parts = R.components(inner)
    least = found.groupBy("community").agg(F.min("node").alias("least"))
    told = found.join(parts, "node", "left").join(least, "community")
    return told.agg(F.count(F.lit(1)).alias("n_nodes"), F.bool_and(F.coalesce("component", "node") == F.col("community")).alias("connected"), F.bool_and(F.col("least") == F.col("community")).alias("named"))


@_g(
    NOTES
    + """, hn as (select id, row_number() over (order by id) r, count(*) over () total from notes where title ilike '%guard%' and coalesce(status, '') <> 'deprecated'), hs as (select id, row_number() over (order by id) r, count(*) over () total from n where name ilike '%guard%')
 select 'note' "source", id, r, total from hn where r <= 40 union all select 'code', id, r, total from hs where r <= 40 order by r, 1, id limit 40"""
)
def _tool_interleave(g):
    """The SQL of `tool_interleave`, which reads notes beside the graph."""


def tool_interleave(spark, sf_dir):
    """Code and notes in turn: the first of each, the second of each, and so on; `total` is how
    many of the kind there are."""
    g, notes = PropertyGraph.from_tables(spark, sf_dir), P.note_states(table(spark, sf_dir, "human_nodes"))
    return T.interleaved(
        {"note": notes.where(F.lower("title").contains("guard") & (F.coalesce("status", F.lit("")) != "deprecated")).select("id"), "code": g.nodes.where(F.lower("name").contains("guard")).select("id")}, 40
    )


_TABLE["tool_interleave"] = (tool_interleave, _TABLE.pop("_tool_interleave")[1])


def queries() -> dict:
    return {k: f for k, (f, _) in _TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _TABLE.items() if s}
