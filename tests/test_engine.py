"""Query language, resolution, sources, sinks, streams and similarity on small cases."""

import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import norm
from skein.operators import community as C
from skein.operators import derive as D
from skein.operators import memory as M
from skein.operators import cycles as Y
from skein.operators import reach as R
from skein.operators import resolve as V
from skein.operators import similarity as S
from skein.operators import textsearch as T
from skein.plans import syntax
from skein.plans.cypher import query
from skein.plans.graph import PropertyGraph
from skein.queries.text import s_semantic
from skein.queries.upkeep import architecture
from skein.session import materialize
from skein.sources import readers, sinks
from skein.streaming import changes as X

T0 = datetime(2025, 1, 1)
NODE = "id bigint, project string, label string, name string, qualified_name string, file_path string, start_line int, end_line int, properties_json string"
EDGE = "id bigint, project string, source_id bigint, target_id bigint, type string, properties_json string"


def graph(spark, nodes, edges):
    n = [(i, "p", label, name, f"p.m.{name}", "src/a.ts", 10 * i, 10 * i + 5, props) for i, label, name, props in nodes]
    e = [(k, "p", s, t, kind, props) for k, (s, t, kind, props) in enumerate(edges)]
    return PropertyGraph(spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE))


@pytest.fixture(scope="module")
def small(spark):
    return graph(
        spark,
        [(1, "Function", "main", '{"c":3}'), (2, "Function", "load", '{"c":"12"}'), (3, "Method", "save", None), (4, "Class", "Store", "{broken"), (5, "Function", "lone", "")],
        [(1, 2, "CALLS", "{}"), (2, 3, "CALLS", None), (3, 1, "CALLS", None), (4, 3, "DEFINES", None), (2, 2, "CALLS", None), (1, 2, "USAGE", None)],
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- query language


def test_refused_and_wrong_texts():
    for text in ("CREATE (n)", "MATCH (n) SET n.x = 1 RETURN n", "MATCH (n) RETURN nope(n)", "MATCH (n RETURN n", "RETURN", "", "MATCH (n) WHERE RETURN n", "MATCH (n) RETURN n LIMIT x", "MATCH (n) RETURN n $"):
        with pytest.raises(syntax.QueryError):
            syntax.parse(text)


def test_unknown_names_are_errors(small):
    for text in ("MATCH (n) RETURN m.name", "MATCH (n) WHERE m.x = 1 RETURN n", "MATCH (n) RETURN n.name AS a, n.id AS a", "MATCH (n)-[r]->(r) RETURN n"):
        with pytest.raises(syntax.QueryError):
            query(small, text)


def test_comments_strings_and_precedence(small):
    got = query(small, "MATCH (n) // c\n WHERE n.name = 'main' OR n.name = \"load\" AND NOT n.label = 'Function' /* x */ RETURN n.name AS a")
    assert rows(got) == [("main",)]
    assert rows(query(small, "MATCH (n) WHERE (n.name = 'main' XOR n.id < 3) RETURN n.id AS i")) == [(2,)]


def test_self_loops_cycles_and_hops(small):
    assert rows(query(small, "MATCH (a)-[:CALLS]-(b) WHERE a.id = 2 RETURN b.id AS b")) == [(1,), (2,), (2,), (3,)]
    assert rows(query(small, "MATCH (a)-[:CALLS*2..2]->(b) WHERE a.id = 1 RETURN b.id AS b")) == [(2,), (3,)]
    assert rows(query(small, "MATCH (a)-[:CALLS*0..1]->(b) WHERE a.id = 5 RETURN b.id AS b")) == [(5,)]
    assert rows(query(small, "MATCH (a)-[:CALLS]->(b)-[:CALLS]->(c)-[:CALLS]->(a) WHERE a.id < b.id AND b.id < c.id RETURN a.id AS a, c.id AS c")) == [(1, 3)]


def test_optional_exists_and_null(small):
    assert rows(query(small, "MATCH (c:Class) OPTIONAL MATCH (c)-[:CALLS]->(x) RETURN c.id AS c, x.id AS x, count(x) AS n")) == [(4, None, 0)]
    assert rows(query(small, "MATCH (n) WHERE NOT EXISTS { (n)-[:CALLS]->() } RETURN n.id AS i")) == [(4,), (5,)]
    assert rows(query(small, "MATCH (n) WHERE EXISTS { (n)-[:DEFINES]->(:Method) } RETURN n.id AS i")) == [(4,)]
    assert rows(query(small, "MATCH (n) WHERE n.c IS NULL RETURN n.id AS i")) == [(3,), (4,), (5,)]
    assert rows(query(small, "MATCH (n) WHERE n.c > 3 RETURN n.id AS i")) == [(2,)]


def test_compat_renders_text(small):
    assert rows(query(small, "MATCH (n) WHERE n.id IN [1, 3] RETURN n.c AS c, n.id AS i, avg(n.start_line) AS m", compat=True)) == [("", "3", "30"), ("3", "1", "10")]


def test_union_with_and_unwind(small):
    assert rows(query(small, "MATCH (n:Class) RETURN n.id AS i UNION ALL MATCH (n:Class) RETURN n.id AS i UNION MATCH (n:Class) RETURN n.id AS i")) == [(4,)] * 3
    assert rows(query(small, "MATCH (n:Class) RETURN n.id AS i UNION MATCH (n:Class) RETURN n.id AS i")) == [(4,)]
    assert rows(query(small, "UNWIND [1, 2, 2] AS x RETURN x, count(*) AS n")) == [(1, 1), (2, 2)]
    assert rows(query(small, "MATCH (n)-[:CALLS]->(m) WITH n, count(m) AS k WHERE k > 1 MATCH (n)-[:USAGE|CALLS]->(z) RETURN n.id AS n, z.id AS z")) == [(2, 2), (2, 3)]


def brute_paths(edges, hops):
    out = {(s, t) for s, t in edges}
    at = set(out)
    for _ in range(hops - 1):
        at = {(s, y) for s, t in at for x, y in edges if x == t}
        yield_ = at
        out |= yield_
    return out


def test_random_graphs_against_brute_force(spark):
    rng = random.Random(4)
    for _ in range(3):
        edges = [(rng.randrange(1, 12), rng.randrange(1, 12)) for _ in range(20)]
        g = graph(spark, [(i, "Function", f"f{i}", None) for i in range(1, 12)], [(s, t, "CALLS", None) for s, t in edges])
        got = {tuple(r) for r in query(g, "MATCH (a)-[:CALLS*1..3]->(b) RETURN DISTINCT a.id AS a, b.id AS b").collect()}
        assert got == brute_paths(set(edges), 3)
        hops = {(r["start"], r["node"]): r["hop"] for r in R.min_hops(g.nodes.select(F.col("id").alias("node")), R.links(g, "CALLS"), 12).collect()}
        for s in range(1, 12):
            dist, at, d = {}, {s}, 0
            while at and d < 12:
                d += 1
                at = {t for x, t in edges if x in at} - dist.keys()
                dist |= dict.fromkeys(at, d)
            assert {t: h for (x, t), h in hops.items() if x == s} == dist


def test_shortest_path_and_components(spark, small):
    path = lambda a, b, **k: [r["node"] for r in R.shortest_path(small, a, b, **k)[0].orderBy("position").collect()]
    assert path(4, 2) == [4, 3, 2]
    assert path(1, 5) == [] and path(5, 5) == [5]
    assert R.shortest_path(small, 1, 10**9)[1].first()["status"] == "no_node"
    assert R.shortest_path(small, 4, 2, max_hops=1)[1].first()["status"] == "max_hops"
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "src bigint, dst bigint")
    assert {r["component"] for r in R.components(chain).collect()} == {0, 100}
    rng = random.Random(2)
    some = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(35)], "src bigint, dst bigint")
    assert rows(R.components(some)) == rows(R.components(some, 0))


def brute_path(edges, a, b, hops):
    """Levels from the source; then back from the target by the least edge id."""
    near = {}
    for i, s, t in edges:
        for x, y in ((s, t), (t, s)):
            if s != t:
                near.setdefault(x, []).append((i, y))
    level, at = {a: 0}, [a]
    while at:
        new = {y for x in at for _, y in near.get(x, []) if y not in level}
        level |= {y: level[at[0]] + 1 for y in new}
        at = sorted(new)
    if level.get(b, hops + 1) > hops:
        return None
    out = [b]
    while out[-1] != a:
        out.append(min((i, y) for i, y in near[out[-1]] if level.get(y) == level[out[-1]] - 1)[1])
    return out[::-1]


def test_shortest_paths_against_brute_force(spark):
    rng = random.Random(21)
    edges = [(i, rng.randrange(25), rng.randrange(25)) for i in range(34)]
    g = PropertyGraph(spark.createDataFrame([(i, "p") for i in range(25)], "id bigint, project string"), spark.createDataFrame([(i, s, t, "CALLS") for i, s, t in edges], "id bigint, source_id bigint, target_id bigint, type string"))
    for a, b in [(0, 1), (2, 9), (3, 17), (20, 4)]:
        path, state = R.shortest_path(g, a, b)
        got = [r["node"] for r in path.orderBy("position").collect()]
        want = brute_path(edges, a, b, 6)
        assert got == (want or []) and (state.first()["status"] == "found") == (want is not None)


def test_cycles_and_longest_ways_are_the_same_by_joins_and_in_one_task(spark):
    rng = random.Random(6)
    pairs = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(18)})
    reach = {a: {b for x, b in pairs if x == a} for a in range(12)}
    while True:
        more = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
        if more == reach:
            break
        reach = more
    ring = {a: max(b for b in r if a in reach[b]) for a, r in reach.items() if any(b != a and a in reach[b] for b in r)}
    df = spark.createDataFrame(pairs, "src bigint, dst bigint")
    for small in (0, 1000):
        assert {r["node"]: r["component"] for r in Y.strong_components(df, small).collect()} == ring
    dag = [(a, b) for a, b in pairs if a < b]
    own = {i: i % 3 for i in range(12)}
    total = {}
    for i in range(11, -1, -1):
        total[i] = own[i] + max([total[b] for a, b in dag if a == i], default=0)
    for small in (0, 1000):
        got = Y.longest(spark.createDataFrame(list(own.items()), "id bigint, depth int"), spark.createDataFrame(dag, "src bigint, dst bigint"), small)
        assert {r["id"]: r["total"] for r in got.collect()} == total


def test_a_long_chain_of_calls_is_no_cycle(spark):
    g = graph(spark, [(i, "Function", f"f{i}", None) for i in range(600)], [(i, i + 1, "CALLS", None) for i in range(599)])
    got = {r["id"]: (r["total"], r["recursive"]) for r in R.loop_depth(g, g.nodes.select("id", F.lit(1).alias("depth"))).collect()}
    assert got == {i: (600 - i, False) for i in range(600)}


def test_callers_tell_whether_they_are_all(spark):
    g = graph(spark, [(i, "Function", f"f{i}", None) for i in range(6)], [(i + 1, i, "CALLS", None) for i in range(5)])
    start = g.nodes.where("id = 0").select(F.col("id").alias("node"))
    got, state = R.callers_multi(g, start, 3)
    assert {r["node"]: r["depth"] for r in got.collect()} == {1: 1, 2: 2, 3: 3}
    assert tuple(state.first()) == (False, 3, 1, "max_hops")
    assert tuple(R.callers_multi(g, start, 9)[1].first()) == (True, 5, 0, None)


def test_loop_depth(spark):
    g = graph(spark, [(i, "Function", f"f{i}", None) for i in range(1, 7)], [(1, 2, "CALLS", None), (2, 3, "CALLS", None), (4, 5, "CALLS", None), (5, 4, "CALLS", None), (5, 3, "CALLS", None), (6, 6, "CALLS", None)])
    own = g.nodes.select("id", F.lit(1).alias("depth"))
    got = {r["id"]: (r["total"], r["recursive"]) for r in R.loop_depth(g, own).collect()}
    assert got == {1: (3, False), 2: (2, False), 3: (1, False), 4: (1, True), 5: (2, True), 6: (1, True)}


def test_call_chain(small):
    ids = lambda *x: small.nodes.where(F.col("id").isin(*x)).select(F.col("id").alias("node"))
    assert [r["path"] for r in R.call_chains(small, ids(1), ids(3)).collect()] == [[1, 2, 3]]


def test_call_chains_are_the_shortest_whatever_the_width(spark):
    rng = random.Random(8)
    calls = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(70)})
    g = graph(spark, [(i, "Function", f"f{i}", None) for i in range(30)], [(a, b, "CALLS", None) for a, b in calls])
    starts, targets = range(0, 30, 2), (5, 21)

    def chains(path):
        if path[-1] in targets:
            yield path
        elif len(path) <= 4:
            for a, b in calls:
                if a == path[-1] and b not in path:
                    yield from chains([*path, b])

    every = sorted((c for s in starts for c in chains([s])), key=lambda c: (len(c), c))
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "node bigint")
    assert len(every) > 12
    for keep in (5, len(every) - 1):
        assert [r["path"] for r in R.call_chains(g, ids(starts), ids(targets), 4, keep, 2).collect()] == every[:keep]


# --- normal forms


def test_normal_forms(spark):
    df = spark.createDataFrame([("C:\\src\\a\\b\\c\\d.ts",), ("top.ts",), (None,), ("/tests/x.py",)], "p string")
    got = rows(df.select(norm.community_key(F.col("p"), F.lit("File")), norm.domain_key(F.col("p"), F.lit("File")), norm.is_test_path(F.col("p"))))
    assert got == sorted([("src/a/b", "src", False), ("(root)", "(root)", False), ("(virtual)/File", "(virtual)", False), ("tests", "tests", True)], key=str)
    one = spark.range(1)
    assert one.select(norm.route_path(F.lit("/a/:id/{x}/<y>/${z}"))).first()[0] == "/a/{}/{}/{}/{}"
    assert one.select(norm.slug(F.lit("Décision: l'été — №1!"))).first()[0] == "decision-l-ete-1"
    assert one.select(norm.url_path(F.lit("http://h/a/b"))).first()[0] == "/a/b"
    assert one.select(norm.owner_qn(F.lit("a::f::anonymous#1::<anonymous>"))).first()[0] == "a::f"
    assert norm.path_scope(" .//src//a/ ") == "src/a" and norm.glob_to_like("src/**/*.ts") == "src%%.ts" and norm.glob_to_like("a_b") == "%a\\_b%"
    assert one.select(norm.risk_score(F.lit(100), F.lit(40), F.lit(0))).first()[0] == 1.0
    assert one.select(norm.proximity(F.lit("a/b/c.ts"), F.lit("a/b/d.ts"))).first()[0] == pytest.approx(1.1)


# --- resolution


def test_module_paths(spark):
    files = spark.createDataFrame([("p", f) for f in ("src/a.ts", "src/b.tsx", "src/c/index.js", "lib/d.ts", "src/e.js")], "project string, file_path string")
    imports = spark.createDataFrame([("p", "src/a.ts", m) for m in ("./b", "./c", "../lib/d.js", "./e.js", "./none", "react", "../../up")], "project string, file_path string, source_module string")
    got = {r["source_module"]: r["resolved"] for r in D.module_paths(imports, files).collect()}
    assert got == {"./b": "src/b.tsx", "./c": "src/c/index.js", "../lib/d.js": "lib/d.ts", "./e.js": "src/e.js", "./none": None, "react": None, "../../up": None}


def test_exports(spark):
    rows_ = [
        ("a", "f", "f", None, None, "local_named"), ("b", "g", None, "f", "a", "re_export_alias"), ("c", None, None, None, "b", "star_re_export"), ("c", None, None, None, "d", "star_re_export"),
        ("d", "g", "g", None, None, "local_named"), ("d", "default", "x", None, None, "type_only_default"), ("e", "h", None, "h", None, "re_export_named"), ("x", None, None, None, "y", "star_re_export"),
        ("y", None, None, None, "x", "star_re_export"), ("y", "k", "k", None, None, "local_named"), ("t", "z", "z", None, None, "local_named"), ("t", "z", "z2", None, None, "local_named"), ("u", None, None, None, None, "star_re_export"),
    ]
    ex = spark.createDataFrame(rows_, "file_path string, exported_name string, local_name string, imported_name string, source_file string, export_kind string")
    want = spark.createDataFrame([("a", "f"), ("b", "g"), ("c", "g"), ("c", "default"), ("e", "h"), ("x", "k"), ("x", "none"), ("t", "z"), ("u", "q"), ("nofile", "n")], "file_path string, name string")
    got = {(r["file_path"], r["name"]): (r["status"], r["target_file"], r["target_name"]) for r in D.resolve_exports(ex, want).collect()}
    assert got == {
        ("a", "f"): ("resolved", "a", "f"), ("b", "g"): ("resolved", "a", "f"), ("c", "g"): ("ambiguous", None, None), ("c", "default"): ("missing", None, None), ("e", "h"): ("unknown", None, None),
        ("x", "k"): ("resolved", "y", "k"), ("x", "none"): ("missing", None, None), ("t", "z"): ("ambiguous", None, None), ("u", "q"): ("unknown", None, None), ("nofile", "n"): ("missing", None, None),
    }


def test_calls_through_imports(spark):
    files = spark.createDataFrame([("p", "a.ts"), ("p", "b.ts")], "project string, file_path string")
    defs = spark.createDataFrame([(1, "p", "b.ts", "load"), (2, "p", "a.ts", "own"), (3, "p", "b.ts", "push"), (4, "p", "b.ts", "twin"), (5, "p", "c.ts", "twin")], "id bigint, project string, file_path string, name string")
    imports = spark.createDataFrame([("p", "a.ts", "ld", "./b", "load", "alias"), ("p", "a.ts", "ns", "./b", None, "namespace"), ("p", "a.ts", "gone", "./b", "gone", "named")], "project string, file_path string, local_name string, source_module string, imported_name string, import_kind string")
    exports = spark.createDataFrame([("p", "b.ts", "load", "load", None, None, "local_named")], "project string, file_path string, exported_name string, local_name string, source_module string, imported_name string, export_kind string")
    sites = spark.createDataFrame([(i, "p", "a.ts", c, "member_call" if "." in c else "identifier_call") for i, c in enumerate(("ld", "ns.load", "own", "x.push", "twin", "o.twin", "gone", "nobody"))], "site_id bigint, project string, file_path string, callee string, call_kind string")
    got = rows(V.resolve_sites(sites, imports, exports, defs, files))
    assert got == sorted([(0, 1, "import_alias", 0.95), (1, 1, "import_namespace", 0.95), (2, 2, "same_file", 0.9), (4, 4, "name", 0.5), (4, 5, "name", 0.5), (5, 4, "name", 0.3), (5, 5, "name", 0.3)], key=str)


def test_registry_resolution_routes_and_coupling(spark):
    defs = spark.createDataFrame(
        [(1, "p", "src/a/x.ts", "f", "src.a.x.f"), (2, "p", "src/b/y.ts", "f", "src.b.y.f"), (3, "p", "src/b/z.ts", "one", "src.b.z.one"), (4, "p", "src/b/test_y.ts", "f", "src.b.test_y.f"), (5, "p", "src/c/v.ts", "Twin", "src.c.v.A.Twin"), (6, "p", "src/c/v.ts", "Twin", "src.c.v.B.Twin")],
        "id bigint, project string, file_path string, name string, qualified_name string",
    )
    asked = {10: ("src/b/q.ts", "f"), 11: ("src/a/x.ts", "f"), 12: ("w.ts", "one"), 13: ("w.ts", "no"), 14: ("w.ts", "B.Twin"), 15: ("w.ts", "ONE"), 16: ("w.ts", "twin"), 17: ("w.ts", "lib.f"), 18: ("w.ts", "own")}
    sites = spark.createDataFrame([(i, "p", f, c) for i, (f, c) in asked.items()], "site_id bigint, project string, file_path string, callee string")
    imports = spark.createDataFrame([("p", "w.ts", "lib", 3), ("p", "w.ts", "own", 1)], "project string, file_path string, local_name string, target_id bigint")
    far = defs.unionByName(defs.where("id = 3").withColumn("id", F.lit(7).cast("bigint")).withColumn("name", F.lit("f")).withColumn("qualified_name", F.lit("src.b.z.f")))
    assert rows(D.resolve_calls(sites, defs)) == [(10, 2, "suffix_match", 0.55), (11, 1, "same_module", 0.9), (12, 3, "unique_name", 0.75), (14, 6, "qualified_tail", 0.9), (15, 3, "fuzzy", 0.4), (16, 5, "fuzzy_many", 0.3), (17, 1, "suffix_match", 0.55)]
    got = {r[0]: r[1:] for r in rows(D.resolve_calls(sites, far, imports))}
    assert got[17] == (7, "import_map_suffix", 0.85) and got[18] == (1, "import_map", 0.95)
    flows = V.route_flows(spark.createDataFrame([(1, "get", "/u/:id"), (2, None, "/v")], "caller_id bigint, method string, path string"), spark.createDataFrame([(7, "GET", "/u/{x}"), (8, "ANY", "/v"), (9, "POST", "/v")], "handler_id bigint, method string, path string"))
    assert rows(flows) == [(1, 7), (2, 8)]
    tests = spark.createDataFrame([("p", "a/x.test.ts"), ("p", "a/x.ts"), ("p", "b/test_y.py"), ("p", "b/y.py"), ("p", "c/z_test.go")], "project string, file_path string")
    assert rows(D.tests_files(tests)) == [("p", "a/x.test.ts", "a/x.ts"), ("p", "b/test_y.py", "b/y.py")]
    calls = spark.createDataFrame([(1, "a", "get", "/u/:id"), (2, "a", "post", "/u/{x}"), (3, "a", "get", "/none")], "call_id bigint, project string, method string, path string")
    rts = spark.createDataFrame([(7, "b", "GET", "/u/<n>"), (8, "b", "ANY", "/u/{id}"), (9, "a", "GET", "/none")], "route_id bigint, project string, method string, path string")
    assert rows(D.route_matches(calls, rts)) == [(1, 7), (2, 8)]
    commits = spark.createDataFrame([(c, f, T0) for c in range(4) for f in ("x", "y")] + [(9, f"f{i}", T0) for i in range(30)] + [(10, "x", T0)], "commit bigint, file string, at timestamp")
    assert [(r["a"], r["b"], r["n"], r["score"]) for r in D.coupling(commits).collect()] == [("x", "y", 4, 1.0)]
    m = spark.createDataFrame([(1, "Class", "p", "a"), (1, "Class", "p", "b"), (2, "Interface", "p", "a"), (3, "Interface", "p", "a"), (3, "Interface", "p", "c")], "owner_id bigint, kind string, project string, name string")
    assert rows(D.implements(m)) == [(1, 2)]
    keys = spark.createDataFrame([(1, "p", "Max_Size"), (2, "p", "abc"), (3, "q", "maxsize"), (4, "p", None)], "id bigint, project string, name string")
    symbols = spark.createDataFrame([(5, "p", "maxSize"), (6, "p", "getMaxSizeOf"), (7, "p", "xabcx"), (8, "p", "ABC"), (9, "p", "")], "id bigint, project string, name string")
    assert rows(D.config_links(keys, symbols)) == [(1, 5, 0.85), (1, 6, 0.75), (2, 8, 0.85)]


def test_guard_and_aspects(small):
    assert query(small, "MATCH (n) RETURN n.id AS id", ceiling=100).count() == 5
    with pytest.raises(syntax.QueryError):
        query(small, "MATCH (n) RETURN n.id AS id", ceiling=5)
    with pytest.raises(ValueError):
        architecture(small, ["nothing"])
    assert set(architecture(small, ["languages", "overview"])) > {"languages", "layers"}


def test_sites_have_all_candidates_of_a_name(spark):
    sites = spark.createDataFrame([(1, "p", "a.ts", "load", "identifier_call"), (2, "p", "a.ts", "x.load", "member_call")], "site_id bigint, project string, file_path string, callee string, call_kind string")
    imports = spark.createDataFrame([], "project string, file_path string, local_name string, source_module string, imported_name string, import_kind string")
    exports = spark.createDataFrame([], "project string, file_path string, exported_name string, local_name string, source_module string, imported_name string, export_kind string")
    defs = spark.createDataFrame([(i, "p", f"f{i}.ts", "load") for i in range(8)] + [(9, "q", "a.ts", "load")], "id bigint, project string, file_path string, name string")
    got = rows(V.resolve_sites(sites, imports, exports, defs, defs.select("project", "file_path")))
    assert got == [(s, i, "name", 0.125) for s in (1, 2) for i in range(8)]


# --- communities


def test_leiden_finds_cliques():
    g = {}
    for base in (0, 10, 20):
        for a in range(base, base + 5):
            g[a] = {b: 1.0 for b in range(base, base + 5) if b != a}
    for a, b in ((0, 10), (10, 20), (20, 0)):
        g[a][b] = g[b][a] = 1.0
    got = C.leiden(g)
    assert {tuple(sorted(u for u in got if got[u] == c)) for c in set(got.values())} == {tuple(range(b, b + 5)) for b in (0, 10, 20)}
    assert C.leiden({}) == {}


def test_communities_small_and_large_agree(spark, monkeypatch):
    edges = [(a, b) for base in (0, 10, 20) for a in range(base, base + 6) for b in range(a + 1, base + 6)] + [(5, 10), (15, 20)]
    links = spark.createDataFrame(edges, "src bigint, dst bigint")
    small = C.communities(links)
    assert small.select("community").distinct().count() == 3
    assert C.modularity(small, links).first()[0] > 0.5
    monkeypatch.setattr(C, "SMALL", 1)
    large = C.communities(links)
    assert large.count() == small.count() and C.modularity(large, links).first()[0] > 0.3
    assert C.communities(links.where("false")).count() == 0


def test_communities_are_leiden_by_joins_too(spark, monkeypatch):
    rng = random.Random(5)
    pairs = {(rng.randrange(90), rng.randrange(90)) for _ in range(160)} | {(15 * c + rng.randrange(15), 15 * c + rng.randrange(15)) for c in range(6) for _ in range(40)}
    links = spark.createDataFrame([p for p in sorted(pairs) if p[0] != p[1]], "src bigint, dst bigint")
    one = C.communities(links)
    monkeypatch.setattr(C, "SMALL", 1)
    many = C.communities(links)
    assert rows(one) == rows(many) and C.modularity(many, links).first()[0] > 0.4
    member = {r["node"]: r["community"] for r in many.collect()}
    inside = links.join(many.toDF("src", "a"), "src").join(many.toDF("dst", "b"), "dst").where("a = b").select("src", "dst")
    assert all(member[r["node"]] == r["component"] for r in R.components(inside).collect())


def test_a_graph_that_fits_a_task_needs_no_joins(spark, monkeypatch):
    """300,000 links, in ten groups with one link each to the next: rounds of joins over so few took minutes."""
    monkeypatch.setattr(C, "_settled_by_joins", lambda *_: pytest.fail("joins"))
    size = 3000
    near = spark.range(10 * size).select(F.col("id").alias("src"), F.posexplode(F.array(*[F.lit(d) for d in range(1, 11)])).alias("at", "d"))
    links = near.select("src", (F.floor(F.col("src") / size) * size + (F.col("src") % size + 1 + F.col("d") * F.col("d") * 7) % size).alias("dst"))
    links = links.unionByName(spark.range(9).select((F.col("id") * size).alias("src"), ((F.col("id") + 1) * size).alias("dst")))
    got = materialize(C.communities(links))
    assert links.count() > 300_000 and got.count() == 10 * size and C.modularity(got, links).first()[0] > 0.85


def test_moves_sought_anew_are_those_sought_in_full():
    """Nodes whose surroundings did not change keep their best move."""
    rng = np.random.default_rng(3)
    for n in (12, 60, 300):
        a, b = rng.integers(0, n, 4 * n), rng.integers(0, n, 4 * n)
        a, b, w = C._merged(np.r_[a, b], np.r_[b, a], np.ones(8 * n, np.int64), n)
        k = np.bincount(a, weights=w, minlength=n).astype(np.int64)
        e, ids, total = (a, b, w), np.arange(n), int(w.sum())
        comm, i = np.arange(n), 0
        while True:
            gain, to = np.zeros(n, np.int64), np.zeros(n, np.int64)
            C._sought(e, k, comm, np.bincount(comm, weights=k, minlength=n).astype(np.int64), total, np.ones(n, bool), gain, to)
            if not gain.any():
                break
            va = C._chosen_moves(ids, k, comm, gain, to, n, i)
            comm[va], i = to[va], i + 1
        assert i > 2 and np.array_equal(C._settled(e, ids, k, np.arange(n), n, total), comm)


def test_few_nodes_are_sought_again_when_little_changes(monkeypatch):
    """Rounds in which few nodes move looked at every edge of a hub and of a large community again."""
    rng = np.random.default_rng(8)
    n = 20_000
    a = rng.integers(0, n, 3 * n)
    b = np.where(rng.random(3 * n) < 0.1, rng.integers(0, 4, 3 * n), np.minimum(a + rng.integers(1, 60, 3 * n), n - 1))
    e = C._merged(np.r_[a, b], np.r_[b, a], np.ones(6 * n, np.int64), n)
    k, total, seen = np.bincount(e[0], weights=e[2], minlength=n).astype(np.int64), int(e[2].sum()), []
    seek = C._Votes.seek
    monkeypatch.setattr(C._Votes, "seek", lambda self, nodes, *rest: seen.append(len(nodes)) or seek(self, nodes, *rest))
    comm = C._settled(e, np.arange(n), k, np.arange(n), n, total)
    gain, to = np.zeros(n, np.int64), np.zeros(n, np.int64)
    C._sought(e, k, comm, np.bincount(comm, weights=k, minlength=n).astype(np.int64), total, np.ones(n, bool), gain, to)
    assert not gain.any() and len(seen) > 10 and np.median(seen) < n / 50


def test_moves_are_ordered_by_gain_then_hash_then_node():
    rng = np.random.default_rng(9)
    for most, top in ((3, 4), (10**15, 2147483629), (5, 2147483629)):
        gain, h, va = rng.integers(1, most, 5000), rng.integers(0, top, 5000), rng.permutation(5000)
        assert np.array_equal(C._order(gain, h, va), np.lexsort((-va, -h, -gain)))


def test_parts_of_votes_change_nothing(monkeypatch):
    rng = random.Random(6)
    edges: dict = {}
    for _ in range(900):
        a, b = rng.randrange(200), int(200 * rng.random() ** 3)
        if a != b:
            for x, y in ((a, b), (b, a)):
                edges.setdefault(x, {})[y] = edges.get(x, {}).get(y, 0) + 1
    whole = C.leiden(edges)
    monkeypatch.setattr(C, "CHUNK", 7)
    assert C.leiden(edges) == whole and 2 < len(set(whole.values())) < 100


def test_cluster_report_counts_links_of_members_only(spark):
    """Links to nodes of no community add to a degree, not to what is within or across."""
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)], "node bigint, community bigint")
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 6), (3, 9), (3, 3), (9, 3)], "src bigint, dst bigint")
    names = spark.createDataFrame([(i, f"n{i}", "Function", f"p.m{i % 2}.n{i}") for i in range(1, 7)], "node bigint, name string, label string, qualified_name string")
    got = rows(C.cluster_report(members, links, names).select("community", "n", "within", "across", "cohesion", "top_names"))
    assert got == [(1, 3, 3, 1, 0.75, "n3, n2, n1"), (4, 2, 1, 2, 0.333333, "n4, n5")]


def test_dual_cap_keeps_caps_and_bridges(spark):
    star = [(i, "p", 0, i, "CALLS", None) for i in range(1, 20)] + [(100, "p", 0, 50, "CONTAINS", None), (101, "p", 1, 2, "CALLS", None), (102, "p", 1, 2, "CALLS", None)]
    e = spark.createDataFrame(star, EDGE)
    for small in (10**6, 1):
        kept = C.dual_cap(e, 3, 3, small).collect()
        assert sum(r["source_id"] == 0 for r in kept) == 3 and any(r["id"] == 100 for r in kept) and sum(r["source_id"] == 1 for r in kept) == 1


def test_dual_cap_is_the_same_at_any_size(spark):
    rng = random.Random(4)
    e = spark.createDataFrame([(i, "p", int(40 * rng.random() ** 2), rng.randrange(40), rng.choice(("CALLS", "IMPORTS", "DEFINES"))) for i in range(300)], "id bigint, project string, source_id bigint, target_id bigint, type string")
    assert rows(C.dual_cap(e, 3, 3, 10**6)) == rows(C.dual_cap(e, 3, 3, 1))


# --- similarity and text


def test_similar_sets_against_brute_force(spark):
    rng = random.Random(3)
    base = [rng.sample(range(60), rng.randrange(1, 15)) for _ in range(25)]
    sets = [sorted(set(b) ^ set(rng.sample(range(60), rng.randrange(0, 3)))) for b in base for _ in range(4)] + [[1, 2, 3]] * 5 + [[]]
    df = spark.createDataFrame(list(enumerate(sets)), "id bigint, items array<int>")
    members, classes = S.set_classes(df)
    of = {r["id"]: r["class_id"] for r in members.collect()}
    reps = {c: set(sets[c]) for c in set(of.values())}
    for t in (0.5, 0.8, 1.0):
        got = {(r["a"], r["b"]) for r in S.similar_sets(classes, t).collect()}
        assert got == {(a, b) for a in reps for b in reps if a < b and len(reps[a] & reps[b]) / len(reps[a] | reps[b]) >= t}
    assert all(sets[i] == sets[c] for i, c in of.items())


def test_semantic_links_all_equal_functions(spark):
    g = graph(spark, [(i, "Function", "loadThing", None) for i in range(30)] + [(30, "Function", "other", None), (31, "Function", "else", None)], [])
    assert {(r["a"], r["b"]) for r in s_semantic(g).collect()} == {(a, b) for a in range(30) for b in range(a + 1, 30)}


def test_near_duplicates_of_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(1, text), (2, text), (3, text.replace("w59", "other")), (4, "too short"), (5, None), (6, ""), (7, " ".join(f"z{i}" for i in range(60)))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("items", F.lit(1))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in S.near_duplicates(df, "doc_id", T.words(F.col("text"))).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0)}
    assert S.near_duplicates(df.where("false"), "doc_id", T.words(F.col("text"))).count() == 0


def test_cosine_join_and_minhash(spark):
    rng = random.Random(5)
    docs = [(i, [rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 9))]) for i in range(40)]
    v = S.tfidf(spark.createDataFrame(docs, "id bigint, tokens array<string>"))
    vec = {}
    for r in v.collect():
        vec.setdefault(r["id"], {})[r["token"]] = r["w"]
    for t in (0.4, 0.75):
        want = {(a, b) for a in vec for b in vec if a < b and sum(w * vec[b].get(k, 0) for k, w in vec[a].items()) >= t + 1e-9}
        assert want <= {(r["a"], r["b"]) for r in S.cosine_join(v, t).collect()}
    sets = spark.createDataFrame([(list(range(100)), list(range(20, 120)))], "a array<bigint>, b array<bigint>")
    est = sets.select(S.agreement(S.minhash(F.col("a")), S.minhash(F.col("b")))).first()[0]
    assert abs(est - 80 / 120) < 0.25
    assert len(sets.select(S.signature_hex(S.minhash(F.col("a")))).first()[0]) == 512


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, v array<float>")
    got = {}
    for r in S.nearest(df, df.where("id % 50 = 0"), 5, block=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        assert [i for _, i in sorted(got[q])] == np.argsort(-(u @ u[q]), kind="stable")[:5].tolist()


def test_random_index_and_diffusion(spark):
    ri = S.random_index(spark.createDataFrame([(1, ["a", "b", "c", "a"])], "id bigint, tokens array<string>"), dims=64)
    for r in ri.groupBy("token").agg(F.sum(F.col("x") * F.col("x")).alias("n")).collect():
        assert r["n"] == pytest.approx(1)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id bigint, v array<double>")
    got = {r["id"]: r["v"] for r in S.diffuse(v, spark.createDataFrame([(1, 2)], "src bigint, dst bigint")).collect()}
    assert got[1] == pytest.approx([0.7 / math.hypot(0.7, 0.3), 0.3 / math.hypot(0.7, 0.3)]) and got[2] == [0.0, 1.0] and got[3] == [0.0, 0.0]


def test_wikilinks_and_sections(spark):
    md = "[[12]] [[a-b|x]]\n## Bugs connus\n[[dir/f]]\n```\n# Décision\n```\n[[Odd One]]\n### Décisions\n[[z]]"
    assert T.wikilinks_of(md) == [("12", None, "code", "MENTIONS"), ("a-b", "x", "human", "MENTIONS"), ("dir/f", None, "path", "AFFECTS"), ("Odd One", None, "unknown", "AFFECTS"), ("z", None, "human", "DECIDES")]
    df = spark.createDataFrame([(1, md), (2, None), (3, "none")], "id bigint, t string")
    assert T.wikilinks(df, "id", "t").count() == 5
    doc = spark.createDataFrame([(1, "intro\n## PURPOSE\n\nwhy\n\n## Other\nx\n## STACK\nspark\n"), (2, None)], "id bigint, t string")
    sec = T.doc_sections(doc, "id", "t")
    assert {r["section"]: r["body"] for r in sec.collect()} == {"PURPOSE": "why\n\n## Other\nx", "STACK": "spark"}
    assert T.render_sections(sec).first()["text"].startswith("## PURPOSE\n\nwhy")
    long = spark.createDataFrame([(1, "## STACK\n" + "x\n" * 200_000)], "id bigint, t string")
    assert len(T.doc_sections(long, "id", "t").first()["body"]) == 399_999


# --- sources and sinks


def test_discover_and_vault(spark, tmp_path):
    for p in ("src/a.ts", "src/x.min.ts", "node_modules/m/b.ts", "docs/n.md", "build.log", "gen/c.ts"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("---\ntype: adr\ntitle: 'T'\n---\nbody [[1]]" if p.endswith(".md") else "x")
    got = rows(readers.discover(spark, str(tmp_path), ["*.min.ts", "/gen/", "# no", ""]).select("path", "language"))
    assert got == [("docs/n.md", "Markdown"), ("src/a.ts", "TypeScript")]
    note = readers.vault(spark, str(tmp_path)).first()
    assert note["frontmatter"] == {"type": "adr", "title": "T"} and note["body"] == "body [[1]]"


def test_git_and_traces(spark):
    log = ["COMMIT:ab12:1700000000", "", "src/a.ts", "yarn.lock", "COMMIT:cd34:1700000100", "src/b.ts"]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(log)], "repo string, n int, value string")
    assert [(r["commit"], r["file"]) for r in readers.git_log(df).orderBy("commit").collect()] == [("ab12", "src/a.ts"), ("cd34", "src/b.ts")]
    st = spark.createDataFrame([("M\ta",), ("R100\told\tnew",), ("D\tx",), ("",)], "value string")
    assert rows(readers.git_status(st)) == sorted([("a", "modified", None), ("new", "renamed", "old"), ("x", "deleted", None)], key=str)
    diff = ["+++ b/f.ts", "@@ -1,2 +3,4 @@ fn", "+x", "@@ -9 +11 @@", "+++ b/g.ts", "@@ -0,0 +1,0 @@"]
    hunks = readers.git_hunks(spark.createDataFrame([(1, i, x) for i, x in enumerate(diff)], "diff int, n int, value string"))
    assert rows(hunks) == sorted([(1, "f.ts", 3, 4), (1, "f.ts", 11, 1), (1, "g.ts", 1, 0)], key=str)
    span = {"traceId": "t", "spanId": "s", "startTimeUnixNano": "100", "endTimeUnixNano": "350", "attributes": [{"key": "http.method", "value": {"stringValue": "GET"}}, {"key": "http.url", "value": {"stringValue": "http://h/x"}}]}
    doc = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span, {**span, "attributes": []}]}]}]})
    assert rows(readers.spans(spark.createDataFrame([(doc,), ("{broken",)], "value string"))) == [("t", "s", "GET", "/x", 250)]


def test_tables_round_trip(spark, small, tmp_path):
    path = str(tmp_path / "t")
    both = small.nodes.unionByName(small.nodes.withColumn("project", F.lit("q")).withColumn("id", F.col("id") + 100))
    sinks.write_projects(both, path)
    sinks.write_projects(small.nodes.where("id = 1"), path)
    assert {r["project"]: r["count"] for r in spark.read.parquet(path).groupBy("project").count().collect()} == {"p": 1, "q": 5}
    sinks.drop_project(spark, path, "q")
    assert spark.read.parquet(path).count() == 1
    sinks.export_graph(small, str(tmp_path / "g"))
    back = sinks.import_graph(spark, str(tmp_path / "g"))
    assert rows(back.nodes) == rows(small.nodes) and rows(back.edges) == rows(small.edges)
    assert sinks.backup(small.nodes, str(tmp_path / "b"), dry_run=True) == 5 and not (tmp_path / "b").exists()


def test_upsert_merge_delete(spark, small):
    old = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "id bigint, v string")
    new = spark.createDataFrame([(2, "B"), (None, "N"), (3, "C")], "id bigint, v string")
    assert rows(sinks.upsert(old, new, ["id"])) == sorted([(1, "a"), (None, "N"), (2, "B"), (3, "C")], key=str)
    assert sinks.delete_nodes(small, F.col("id") == 2).edges.count() == 2
    other = graph(spark, [(50, "Function", "main", '{"c":9}'), (51, "Function", "fresh", None)], [(50, 51, "CALLS", '{"k":"1"}')])
    merged = sinks.merge_graphs(small, other)
    assert merged.nodes.count() == 6 and merged.nodes.where("id = 1").first()["properties_json"] == '{"c":9}'
    assert merged.edges.where("source_id = 1 and target_id = 51").count() == 1
    assert {r["check"]: r["n"] for r in sinks.integrity(small, spark.createDataFrame([("p",)], "name string")).collect()}["edge_without_target"] == 0


def test_notes(spark):
    cols = "id bigint, project string, title string, slug string, status string, source string, confidence double, cbm_node_ids array<bigint>"
    old = spark.createDataFrame([(5, "p", "A b", "a-b", "active", "human", 1.0, [1])], cols)
    new = spark.createDataFrame([("p", "A b"), ("p", "A  B!"), ("p", "Other")], "project string, title string")
    got = M.create(old, new)
    assert sorted(r["slug"] for r in got.collect()) == ["a-b", "a-b-2", "a-b-3", "other"] and got.select("id").distinct().count() == 4
    bad = spark.createDataFrame([(1, "p", " ", "s", "active", "human", 1.0, None), (2, "p", "t", "s", "odd", "human", 1.0, None), (3, "p", "t", "s", "active", "human", 2.0, None), (4, "p", "t", "s", "active", "human", None, None)], cols)
    fine, wrong = M.checked(bad)
    assert [r["id"] for r in fine.collect()] == [4] and sorted(r["problem"] for r in wrong.collect()) == ["confidence", "status", "title"]


# --- streams


def test_incremental_states(spark):
    s = "project string, file_path string, mtime_ns string, size bigint, content_hash string"
    old = spark.createDataFrame([("p", "same", "1", 1, "a"), ("p", "touched", "1", 1, "a"), ("p", "edited", "1", 1, "a"), ("p", "gone", "1", 1, "a"), ("p", "nohash", "1", 1, None)], s)
    new = spark.createDataFrame([("p", "same", "1", 1, None), ("p", "touched", "2", 1, " A"), ("p", "edited", "1", 2, "b"), ("p", "new", "1", 1, "a"), ("p", "nohash", "2", 1, None)], s)
    got = {r["file_path"]: r["change"] for r in X.incremental(old, new).collect()}
    assert got == {"same": "unchanged", "touched": "unchanged", "edited": "changed", "gone": "deleted", "new": "new", "nohash": "changed"}


def test_debounce_stream_equals_table(spark, tmp_path):
    schema = "project string, type string, at timestamp, payload string"
    rows_ = [("p", "t", T0 + timedelta(milliseconds=m), f"x{m}") for m in (0, 100, 150, 600, 650, 5000)]
    df = spark.createDataFrame(rows_, schema)
    batch = rows(X.debounce(df).select("payload", "n"))
    assert batch == [("x150", 3), ("x5000", 1), ("x650", 2)]
    for i, part in enumerate((rows_[:3], rows_[3:5], rows_[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = X.debounce(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("payload", "n")) == [("x150", 3), ("x650", 2)]  # the last burst is still open


def test_feed_batches_and_revision(spark, small, tmp_path):
    small.nodes.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(small.nodes.schema).parquet(str(tmp_path / "in"))
    X.apply_batches(stream, str(tmp_path / "out"), sinks.write_projects, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    a, b = X.revision(small.nodes).first(), X.revision(small.nodes.orderBy(F.desc("id"))).first()
    assert a == b != X.revision(small.nodes.where("id <> 5")).first()


def test_p99(spark):
    rng = random.Random(1)
    data = [(k, rng.uniform(-5, 1000)) for k in "aab" for _ in range(333)] + [("c", 1.0), ("d", None)]
    want = {}
    for k in "abc":
        v = sorted(x for kk, x in data if kk == k)
        want[k] = v[math.floor(len(v) * 0.99)]
    got = {r["k"]: r["p99"] for r in X.p99(spark.createDataFrame(data, "k string, v double"), ["k"], "v").collect()}
    assert got == want


def test_literal_hits_are_all_found(spark):
    df = spark.createDataFrame([(1, "a.b a.b\nxa.ba.b"), (2, None), (3, "")], "doc_id bigint, text string")
    assert rows(T.literal_hits(df, ["a.b", "x", "a.b", ""])) == [(1, 1, "a.b", 1), (1, 1, "a.b", 5), (1, 2, "a.b", 2), (1, 2, "a.b", 5), (1, 2, "x", 1)]
    assert T.literal_hits(df, [""]).count() == 0


def test_more_keywords_than_a_question_may_have(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, v array<double>")
    assert [r["id"] for r in S.keyword_search(v, [[1.0, 0.1]]).collect()] == [1, 2]
    with pytest.raises(ValueError):
        S.keyword_search(v, [[1.0, 0.0]] * 33)
    one = v.select("id", S.quantized(F.col("v")).alias("q")).withColumn("c", S.cosine_i8(F.col("q"), F.array(F.lit(127), F.lit(0)).cast("array<tinyint>")))
    assert {r["id"]: r["c"] for r in one.collect()} == {1: 1.0, 2: 0.0}


def test_similar_sets_of_one_frequent_item(spark):
    rng = random.Random(3)
    sets = [(i, sorted({0, *rng.sample(range(1, 12), rng.randrange(0, 8))})) for i in range(60)]
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8}
    got = {(r["a"], r["b"]) for r in S.similar_sets(spark.createDataFrame(sets, "class_id bigint, items array<bigint>"), 0.8).collect()}
    assert got == want


def test_exports_over_many_files(spark):
    chain = [(f"f{i}", None, None, None, f"f{i + 1}", "star_re_export") for i in range(30)] + [("f30", "x", "x", None, None, "local_named"), ("f30", None, None, None, "f0", "star_re_export")]
    ex = spark.createDataFrame(chain, "file_path string, exported_name string, local_name string, imported_name string, source_file string, export_kind string")
    got = rows(D.resolve_exports(ex, spark.createDataFrame([("f0", "x"), ("f0", "y")], "file_path string, name string")))
    assert got == sorted([("f0", "x", "resolved", "f30", "x"), ("f0", "y", "missing", None, None)], key=str)


def test_ignore_rules(spark):
    names = ["a.py", "src/b.py", "src/gen/c.ts", "src/keep/gen/d.ts", "docs/e.md", "build/f.ts", "src/x/deep/y/g.ts", "src/h[1].ts", "node_modules/i.ts", "lib/tests/j.py"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    kept = lambda *rules, **k: sorted(r["path"] for r in readers.kept_paths(files, spark.createDataFrame(list(rules), "folder string, n int, pattern string"), **k).collect())
    every = [n for n in names if n != "node_modules/i.ts"]
    assert kept(("", 0, "#x")) == sorted(every)
    assert kept(("", 0, "*.py"), ("", 1, "!tests/")) == sorted(set(every) - {"a.py", "src/b.py"})
    assert kept(("src", 0, "/gen/")) == sorted(set(every) - {"src/gen/c.ts"})
    assert kept(("", 0, "gen/"), ("src/keep", 0, "!gen/")) == sorted(set(every) - {"src/gen/c.ts"})
    assert kept(("", 0, "src/**/y"), ("", 1, "h[1].*")) == sorted(set(every) - {"src/x/deep/y/g.ts", "src/h[1].ts"})
    assert kept(("", 0, "nothing"), fast=True) == sorted(set(every) - {"docs/e.md", "build/f.ts", "src/gen/c.ts", "src/keep/gen/d.ts"})


def test_values_are_carried_over_ranges(spark):
    df = spark.createDataFrame([("a", i, f"h{i}" if i % 7 == 0 else None) for i in range(40)] + [("b", 3, None)], "repo string, n int, v string")
    got = {(r["repo"], r["n"]): r["carried"] for r in readers.carried(df, "repo", "n", F.col("v"), span=5).collect()}
    assert got == {("a", i): f"h{i - i % 7}" for i in range(40)} | {("b", 3): None}


def test_notes_made_changed_and_deleted(spark):
    old = spark.createDataFrame([(5, "p", "a", "a"), (6, "p", "b", "b-2")], "id bigint, project string, title string, slug string")
    new = spark.createDataFrame([("p", "A"), ("p", "b"), ("q", "a")] + [("r", f"t{i:03d}") for i in range(50)], "project string, title string")
    made = {(r["project"], r["slug"]): r["id"] for r in M.create(old, new.repartition(7)).collect()}
    assert made[("p", "a-2")] == 7 and made[("q", "a")] == 9 and sorted(made.values()) == list(range(5, 60))
    assert [made[("r", f"t{i:03d}")] for i in range(50)] == list(range(10, 60))
    changed = M.update(old, spark.createDataFrame([(6, "B", None), (9, "x", "x")], "id bigint, title string, slug string"))
    assert rows(changed) == [(5, "p", "a", "a"), (6, "p", "B", "b-2")]
    assert rows(M.delete(changed, old.where("id = 5"))) == [(6, "p", "B", "b-2")]


def test_vault_keeps_what_people_wrote(spark, tmp_path):
    note = lambda body: spark.createDataFrame([(1, "x/n.md", "n", body, "ADR", "active", [])], "id bigint, obsidian_path string, slug string, body_markdown string, label string, status string, tags array<string>")
    sinks.write_vault(note("one\n"), str(tmp_path))
    at = tmp_path / "x" / "n.md"
    at.write_text(at.read_text() + "<!-- HUMAN NOTES -->\nby hand\n<!-- /HUMAN NOTES -->\n")
    for body in ("two\n", "two\n", "three\n"):
        sinks.write_vault(note(body), str(tmp_path), backups=2)
    assert at.read_text().endswith("three\n<!-- HUMAN NOTES -->\nby hand\n<!-- /HUMAN NOTES -->\n")
    assert sorted(p.name for p in at.parent.iterdir() if ".crc" not in p.name) == ["n.md", "n.md.bak-1", "n.md.bak-2"]
    assert "two" in (at.parent / "n.md.bak-1").read_text() and "one" in (at.parent / "n.md.bak-2").read_text()


def test_an_artifact_that_was_changed_is_refused(spark, small, tmp_path):
    sinks.export_graph(small, str(tmp_path / "g"))
    assert sinks.import_graph(spark, str(tmp_path / "g")).edges.count() == small.edges.count()
    small.nodes.where("id > 1").write.mode("overwrite").parquet(str(tmp_path / "g" / "nodes"))
    with pytest.raises(ValueError):
        sinks.import_graph(spark, str(tmp_path / "g"))


def test_watcher_tells_changes_once(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.md").write_text("1")
    w = X.Watcher(spark, str(tmp_path / "v"), str(tmp_path / "state"), "*.md")
    told = lambda df: sorted((r["file_path"].rsplit("/", 1)[1], r["change"]) for r in df.collect())
    assert told(w.look()) == [("a.md", "new")] and told(w.look()) == []
    (tmp_path / "v" / "a.md").write_text("12")
    (tmp_path / "v" / "b.md").write_text("1")
    seen = []
    assert X.Watcher(spark, str(tmp_path / "v"), str(tmp_path / "state"), "*.md").watch(lambda df: seen.append(told(df)), 2, pause=0, quiet=0) == 1
    assert seen == [[("a.md", "changed"), ("b.md", "new")]]
    (tmp_path / "v" / "a.md").unlink()
    assert told(w.look()) == [("a.md", "deleted")]


def test_cache_serves_stale_results_and_forgets(spark):
    now, built = [0.0], []
    c = X.RevisionCache(fresh=10, longest=40, clock=lambda: now[0])
    df = lambda n: (lambda: built.append(n) or spark.createDataFrame([(n,)], "n int"))
    get = lambda n, token="r1": c.get("k", token, df(n)).first()["n"]
    assert get(1) == 1 and get(2) == 1
    now[0] = 15
    assert get(3) == 1 and c.refresh() == 1 and get(4) == 3
    now[0] = 100
    assert get(5) == 5 and get(6, "r2") == 6
    assert built == [1, 3, 5, 6] and c.counts == {"fresh": 2, "stale": 1, "miss": 3}
    small = X.RevisionCache(most_bytes=1)
    small.get("a", "r", df(7))
    small.get("b", "r", df(8))
    assert list(small.kept) == ["b"]
    text = X.cursor("r1", 5, "x")
    assert X.resumed(text, "r1") == [5, "x"]
    with pytest.raises(X.StaleCursor):
        X.resumed(text, "r2")


def test_facade(spark, tmp_path):
    from skein.api import Engine

    e = Engine(spark, "/root/testdata/sf0.001")
    assert e.query_graph("MATCH (f:Function) RETURN count(f) AS n").first()["n"] > 0
    assert e.search_graph(label="Class").count() > 0 and e.get_code_snippet("ts::logEvent", "atlas-core").first()["how"] == "suffix"
    assert e.list_projects().count() > 0 and set(e.get_architecture(["languages"])) == {"languages"}
    note = e.create_human_note("atlas-core", "ADR", "Fresh decision")
    assert note.where("title = 'Fresh decision'").first()["slug"] == "fresh-decision"
    with pytest.raises(ValueError):
        e.create_human_note("atlas-core", "ADR", " ")


def test_caps_are_the_same_by_joins_and_in_one_task(spark):
    rng = random.Random(12)
    kinds = ["CALLS", "CONTAINS", "IMPORTS", "USAGE"]
    edges = [(i, rng.choice("pq"), rng.choice([0, rng.randrange(9)]), rng.choice([1, rng.randrange(9)]), rng.choice(kinds)) for i in range(60)] + [(99, None, 1, 2, None)]
    df = spark.createDataFrame(edges, "id bigint, project string, source_id bigint, target_id bigint, type string")
    one = sorted(r["id"] for r in C.dual_cap(df, 3, 2).collect())
    for small in (0, 20):
        assert sorted(r["id"] for r in C.dual_cap(df, 3, 2, small).collect()) == one
