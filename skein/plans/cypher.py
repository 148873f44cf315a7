"""From the syntax tree of a graph query to a DataFrame plan.

Patterns become joins over the node and edge tables, conditions become column expressions; join
order, pushdown and pruning are Catalyst's. Values are typed and missing ones are null; what a
text like `''` means to IS NULL and COALESCE follows the query language. Variable-length patterns
unroll to one distinct join per hop, from the rows at hand.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans import syntax as S
from skein.plans.graph import EDGE, NODE, PropertyGraph
from skein.session import materialize

MAX_HOPS = 10
_TEXT_LOOKS_REGEX = (".*", ".+", "[", "(", "|", "^", "$")


def _col(var: str, field: str) -> str:
    return f"{var}__{field}"


class Planner:
    def __init__(self, graph: PropertyGraph):
        self.graph = graph
        self.kinds: dict[str, str] = {}
        self.rows: DataFrame | None = None
        self.with_degrees: set[str] = set()

    # --- scans and patterns

    def node(self, p: S.NodePattern) -> DataFrame:
        df = self.graph.nodes
        if p.labels:
            df = df.where(F.col("label").isin(*p.labels))
        df = df.select(*[F.col(c).alias(_col(p.var, c)) for c in NODE])
        if p.var in self.with_degrees:
            d = self.graph.degrees("CALLS").select(F.col("id").alias("__d"), "in_degree", "out_degree")
            df = df.join(d, df[_col(p.var, "id")] == F.col("__d"), "left").drop("__d")
            df = df.withColumn(_col(p.var, "in_degree"), F.coalesce("in_degree", F.lit(0))).withColumn(_col(p.var, "out_degree"), F.coalesce("out_degree", F.lit(0))).drop("in_degree", "out_degree")
        for key, value in p.props:
            have = self.property(p.var, key, "node").cast("string")
            text = value.value
            if isinstance(text, str) and any(x in text for x in _TEXT_LOOKS_REGEX):
                df = df.where(have.rlike(text))
            else:
                df = df.where(self.compare("=", self.property(p.var, key, "node"), value, F.lit(text)))
        return df

    def edge(self, r: S.RelPattern) -> DataFrame:
        """Edges as seen from the left end: `__from`, `__to` and the edge's own columns."""
        df = self.graph.edges
        if r.types:
            df = df.where(F.col("type").isin(*r.types))
        own = [F.col(c).alias(_col(r.var, c)) for c in EDGE]
        ahead = df.select(F.col("source_id").alias("__from"), F.col("target_id").alias("__to"), *own)
        back = df.select(F.col("target_id").alias("__from"), F.col("source_id").alias("__to"), *own)
        return ahead if r.direction == "out" else back if r.direction == "in" else ahead.unionByName(back)

    def reach(self, starts: DataFrame, r: S.RelPattern) -> DataFrame:
        """(__from, __to, __hop): the nodes met in low..high hops from each start, one row per hop
        count, each hop a distinct join."""
        step = self.edge(r).select("__from", "__to").distinct()
        low, high = max(0, r.low), min(MAX_HOPS, r.high)
        at = starts.select(F.col("__s").alias("__from"), F.col("__s").alias("__to"))
        found = [at.withColumn("__hop", F.lit(0))] if low == 0 else []
        for hop in range(1, high + 1):
            at = at.select("__from", F.col("__to").alias("__via")).join(step.select(F.col("__from").alias("__via"), "__to"), "__via").select("__from", "__to").distinct()
            if high > 3:
                at = materialize(at, "hops")
                if at.isEmpty():
                    break
            if hop >= low:
                found.append(at.withColumn("__hop", F.lit(hop)))
        if not found:
            found = [at.where(F.lit(False)).withColumn("__hop", F.lit(0))]
        return reduce(DataFrame.unionByName, found)

    def path(self, p: S.Path, anchors: DataFrame | None = None) -> DataFrame:
        """The matches of one path. `anchors`, rows that bind its first node, keep a
        variable-length expansion to what is asked for."""
        seen = {p.nodes[0].var}
        df = self.node(p.nodes[0])
        if anchors is not None:
            key = _col(p.nodes[0].var, "id")
            df = df.join(anchors.select(key).distinct(), key, "left_semi")
        for before, r, n in zip(p.nodes, p.rels, p.nodes[1:]):
            left = _col(before.var, "id")
            if r.low is not None:
                links = self.reach(df.select(F.col(left).alias("__s")).distinct(), r)
            else:
                links = self.edge(r)
            df = df.join(links, df[left] == F.col("__from")).drop("__from")
            right = _col(n.var, "id")
            if n.var in seen:
                df = df.where(F.col("__to") == F.col(right)).drop("__to")
            else:
                df = df.join(self.node(n), F.col("__to") == F.col(right)).drop("__to")
                seen.add(n.var)
            if r.low is not None:
                df = df.withColumnRenamed("__hop", _col(r.var, "hop"))
        return df

    def vars_of(self, p: S.Path) -> dict[str, str]:
        nodes, rels = {n.var for n in p.nodes}, [r.var for r in p.rels]
        if nodes & set(rels) or len(set(rels)) < len(rels):
            raise S.QueryError("a path names one relationship twice, or as a node too")
        return dict.fromkeys(nodes, "node") | {r.var: "path" if r.low is not None else "edge" for r in p.rels}

    def match(self, m: S.Match) -> None:
        for i, p in enumerate(m.paths):
            new = self.vars_of(p)
            shared = [v for v in new if v in self.kinds]
            if any(self.kinds[v] != new[v] for v in shared):
                raise S.QueryError(f"{shared} are bound to something else")
            if shared and p.nodes[0].var not in shared and p.nodes[-1].var in shared:
                turn = {"out": "in", "in": "out", "any": "any"}
                p = S.Path(p.nodes[::-1], tuple(S.RelPattern(r.var, r.types, turn[r.direction], r.low, r.high, r.named) for r in p.rels[::-1]))
            deep = any(r.low is not None for r in p.rels)
            found = self.path(p, self.rows if deep and p.nodes[0].var in shared else None)
            where = m.where if m.optional and i == len(m.paths) - 1 else None
            if self.rows is None:
                if m.optional:
                    one = self.graph.nodes.sparkSession.range(1).select(F.lit(1).alias("__one"))
                    self.kinds |= new
                    found = one.join(found if where is None else self.filter(found, where), F.lit(True), "left").drop("__one")
                self.rows = found
            else:
                keys = [_col(v, "id") for v in shared]
                rename = {c: f"__r_{c}" for c in found.columns if c in self.rows.columns}
                found = found.withColumnsRenamed(rename)
                on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__r_{k}") for k in keys], F.lit(True)) if keys else F.lit(True)
                how = "left" if m.optional else "inner"
                kinds, self.kinds = self.kinds, self.kinds | new
                if where is not None:
                    on = on & self.expr(where)
                self.kinds = kinds
                joined = self.rows.join(found, on, how) if keys or m.optional else self.rows.crossJoin(found)
                self.rows = joined.drop(*rename.values())
            self.kinds |= new
        if m.where is not None and not m.optional:
            self.rows = self.filter(self.rows, m.where)

    # --- conditions

    def filter(self, df: DataFrame, cond: Any) -> DataFrame:
        """Conjuncts one by one; EXISTS and NOT EXISTS become semi- and anti-joins."""
        if isinstance(cond, S.Op) and cond.op == "AND":
            return self.filter(self.filter(df, cond.args[0]), cond.args[1])
        negated = isinstance(cond, S.Op) and cond.op == "NOT" and isinstance(cond.args[0], S.Exists)
        if isinstance(cond, S.Exists) or negated:
            key, ends = self.exists_ids(cond.args[0] if negated else cond)
            return df.join(ends, df[key] == F.col("__e"), "left_anti" if negated else "left_semi")
        marks: list[str] = []
        for e in _find(cond, S.Exists):
            key, ends = self.exists_ids(e)
            mark = f"__exists{abs(hash(e))}"
            marks.append(mark)
            df = df.join(ends.select(F.col("__e").alias(f"{mark}_id"), F.lit(True).alias(mark)), df[key] == F.col(f"{mark}_id"), "left").drop(f"{mark}_id")
        return df.where(self.expr(cond)).drop(*marks)

    def exists_ids(self, e: S.Exists) -> tuple[str, DataFrame]:
        p = e.path
        first = p.nodes[0]
        if self.kinds.get(first.var) != "node":
            raise S.QueryError(f"EXISTS starts at {first.var}, which is no bound node")
        found = Planner(self.graph).path(S.Path((S.NodePattern("__x"), *p.nodes[1:]), p.rels)) if any(n.labels or n.props for n in p.nodes[1:]) or len(p.rels) > 1 else None
        if found is not None:
            return _col(first.var, "id"), found.select(F.col("__x__id").alias("__e")).distinct()
        return _col(first.var, "id"), self.edge(p.rels[0]).select(F.col("__from").alias("__e")).distinct()

    # --- expressions

    def property(self, var: str, key: str, kind: str | None = None) -> Column:
        kind = kind or self.kinds.get(var)
        if kind is None:
            raise S.QueryError(f"unknown variable: {var}")
        if kind == "scalar":
            raise S.QueryError(f"{var} has no properties")
        if key in (NODE if kind == "node" else EDGE) or (kind == "node" and key in ("in_degree", "out_degree")):
            return F.col(_col(var, key))
        return F.get_json_object(_col(var, "properties_json"), f"$.{key}")

    def compare(self, op: str, left: Column, right_ast: Any, right: Column, left_ast: Any = None) -> Column:
        numbers = [a for a in (left_ast, right_ast) if isinstance(a, S.Literal) and isinstance(a.value, int | float) and not isinstance(a.value, bool)]
        flags = [a for a in (left_ast, right_ast) if isinstance(a, S.Literal) and isinstance(a.value, bool)]
        if numbers or op in ("<", ">", "<=", ">="):
            if numbers or not any(isinstance(a, S.Literal) and isinstance(a.value, str) for a in (left_ast, right_ast)):
                left, right = left.try_cast("double"), right.try_cast("double")
            else:
                left, right = left.cast("string"), right.cast("string")
        elif flags:
            left, right = F.lower(left.cast("string")), F.lower(right.cast("string"))
        else:
            left, right = left.cast("string"), right.cast("string")
        return {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op]

    def expr(self, e: Any) -> Column:
        if isinstance(e, S.Literal):
            return F.lit(e.value)
        if isinstance(e, S.Property):
            return self.property(e.var, e.key)
        if isinstance(e, S.Name):
            kind = self.kinds.get(e.name)
            if kind is None:
                raise S.QueryError(f"unknown variable: {e.name}")
            return F.col(_col(e.name, "name") if kind == "node" else _col(e.name, "properties_json") if kind == "edge" else _col(e.name, "hop") if kind == "path" else f"`{e.name}`")
        if isinstance(e, S.ListOf):
            texts = any(isinstance(x, S.Literal) and isinstance(x.value, str) for x in e.items)
            return F.array(*[self.expr(x).cast("string") if texts else self.expr(x) for x in e.items])
        if isinstance(e, S.HasLabel):
            return F.col(_col(e.var, "label")).isin(*e.labels)
        if isinstance(e, S.Exists):
            return F.coalesce(F.col(f"__exists{abs(hash(e))}"), F.lit(False))
        if isinstance(e, S.Case):
            out = None
            for when, then in e.whens:
                out = F.when(self.expr(when), self.expr(then)) if out is None else out.when(self.expr(when), self.expr(then))
            return out if e.other is None else out.otherwise(self.expr(e.other))
        if isinstance(e, S.Call):
            return self.call(e)
        op, args = e.op, e.args
        if op in ("AND", "OR", "XOR"):
            a, b = self.expr(args[0]), self.expr(args[1])
            return a & b if op == "AND" else a | b if op == "OR" else a != b
        if op == "NOT":
            return ~self.expr(args[0])
        left = self.expr(args[0])
        if op == "IS NULL":
            return left.isNull() | (left.cast("string") == "")
        if op == "IS NOT NULL":
            return left.isNotNull() & (left.cast("string") != "")
        if op == "IN":
            if not isinstance(args[1], S.ListOf):
                raise S.QueryError("IN needs a list")
            return reduce(lambda a, b: a | b, [self.compare("=", left, x, self.expr(x), args[0]) for x in args[1].items], F.lit(False))
        right = self.expr(args[1])
        if op in ("CONTAINS", "STARTS", "ENDS", "=~"):
            text = left.cast("string")
            return {"CONTAINS": text.contains, "STARTS": text.startswith, "ENDS": text.endswith, "=~": lambda p: text.rlike(p)}[op](args[1].value if op == "=~" else right)
        return self.compare(op, left, args[1], right, args[0])

    def call(self, e: S.Call) -> Column:
        name = e.name
        if name in S.AGGREGATES:
            return self.aggregate(e)
        var = e.args[0].name if e.args and isinstance(e.args[0], S.Name) else None
        if name in ("labels", "type", "id", "keys", "properties") and self.kinds.get(var) in ("node", "edge"):
            return {
                "labels": lambda: F.array(F.col(_col(var, "label"))),
                "type": lambda: F.col(_col(var, "type")),
                "id": lambda: F.col(_col(var, "id")),
                "keys": lambda: F.json_object_keys(_col(var, "properties_json")),
                "properties": lambda: F.col(_col(var, "properties_json")),
            }[name]()
        args = [self.expr(a) for a in e.args]
        x = args[0].cast("string")
        blank = F.lit(" \t\n\r")
        whole = lambda c: c.cast("int")
        return {
            "tolower": lambda: F.lower(x),
            "toupper": lambda: F.upper(x),
            "tostring": lambda: x,
            "tointeger": lambda: F.regexp_extract(x, r"^\s*([-+]?\d+)", 1).try_cast("bigint"),
            "tofloat": lambda: F.regexp_extract(x, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double"),
            "toboolean": lambda: F.when(F.lower(x) == "true", True).when(F.lower(x) == "false", False),
            "size": lambda: F.octet_length(x),
            "length": lambda: F.octet_length(x),
            "trim": lambda: F.btrim(x, blank),
            "ltrim": lambda: F.ltrim(x, blank),
            "rtrim": lambda: F.rtrim(x, blank),
            "reverse": lambda: F.reverse(x),
            "coalesce": lambda: F.coalesce(*[F.nullif(a.cast("string"), F.lit("")) for a in args]),
            "substring": lambda: F.substring(x, whole(args[1]) + 1, F.greatest(whole(args[2]), F.lit(0)) if len(args) > 2 else F.length(x)),
            "left": lambda: F.left(x, whole(args[1])),
            "right": lambda: F.right(x, whole(args[1])),
            "replace": lambda: F.when(args[1] == "", x).otherwise(F.replace(x, args[1], args[2])),
            "labels": lambda: F.array(x),
            "type": lambda: x,
            "id": lambda: x,
            "keys": lambda: F.json_object_keys(x),
            "properties": lambda: x,
        }[name]()

    def aggregate(self, e: S.Call) -> Column:
        if not e.args:
            return F.count(F.lit(1))
        arg = e.args[0]
        bound = isinstance(arg, S.Name) and self.kinds.get(arg.name) in ("node", "edge")
        x = F.col(_col(arg.name, "id")) if bound and e.name == "count" else self.expr(arg)
        if e.name == "count":
            return F.countDistinct(x) if e.distinct else F.count(x)
        if e.name == "collect":
            return F.sort_array(F.collect_set(x) if e.distinct else F.collect_list(x))
        number = x.try_cast("double")
        if e.name in ("sum", "avg") and e.distinct:
            return F.sum_distinct(number) if e.name == "sum" else F.expr(f"avg(distinct {number._jc.toString()})")
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[e.name](number)

    # --- projections

    def project(self, p: S.Projection) -> None:
        items = p.items
        if p.star:
            items = []
            for v, kind in self.kinds.items():
                if v.startswith("_anon"):
                    continue
                if kind == "node" and p.final:
                    items += [S.Item(S.Property(v, c), f"{v}.{c}") for c in ("name", "qualified_name", "label", "file_path")]
                elif kind == "edge" and p.final:
                    items.append(S.Item(S.Property(v, "type"), v))
                else:
                    items.append(S.Item(S.Name(v), v))
        if len({i.alias for i in items}) < len(items):
            raise S.QueryError("two items have the same name")
        keep = {i.alias: i.expr.name for i in items if isinstance(i.expr, S.Name) and self.kinds.get(i.expr.name) in ("node", "edge") and not p.final}
        plain = [i for i in items if i.alias not in keep and not _find(i.expr, S.Call, lambda c: c.name in S.AGGREGATES)]
        summed = [i for i in items if i.alias not in keep and i not in plain]
        kinds = {a: self.kinds[v] for a, v in keep.items()} | {i.alias: "scalar" for i in plain + summed}
        carried = [F.col(c).alias(a + c[len(v):]) for a, v in keep.items() for c in self.rows.columns if c.startswith(f"{v}__")]
        cols = [self.expr(i.expr).alias(i.alias) for i in plain]
        source = self.rows
        if summed:
            df = source.groupBy(*carried, *cols).agg(*[self.expr(i.expr).alias(i.alias) for i in summed])
        else:
            extra = []
            for n, (e, down) in enumerate(p.order):
                if not (isinstance(e, S.Name) and e.name in kinds) and not p.distinct:
                    extra.append(self.expr(e).alias(f"__o{n}"))
            df = source.select(*carried, *cols, *extra)
        if p.distinct:
            df = df.distinct()
        order = []
        for n, (e, down) in enumerate(p.order):
            alias = e.name if isinstance(e, S.Name) and e.name in kinds else next((i.alias for i in items if i.expr == e), None)
            key = F.col(f"`{alias}`") if alias and alias in df.columns else F.col(f"__o{n}")
            order.append(key.desc_nulls_last() if down else key.asc_nulls_first())
        if order:
            df = df.orderBy(*order)
        if p.skip:
            df = df.offset(p.skip)
        if p.limit is not None:
            df = df.limit(p.limit)
        self.rows, self.kinds = df.drop(*[c for c in df.columns if c.startswith("__o")]), kinds
        if p.where is not None:
            self.rows = self.filter(self.rows, p.where)
        if p.final:
            self.rows = self.rows.select(*[F.col(f"`{i.alias}`") for i in items])

    def unwind(self, u: S.Unwind) -> None:
        if self.rows is None:
            self.rows = self.graph.nodes.sparkSession.range(1).select(F.lit(1).alias("__one"))
        self.rows = self.rows.select("*", F.explode(self.expr(u.items)).alias(u.alias)).drop("__one")
        self.kinds[u.alias] = "scalar"

    def run(self, clauses: list) -> DataFrame:
        self.with_degrees = {x.var for c in clauses for x in _find(c, S.Property, lambda x: x.key in ("in_degree", "out_degree"))}
        for c in clauses:
            if isinstance(c, S.Match):
                self.match(c)
            elif isinstance(c, S.Unwind):
                self.unwind(c)
            else:
                self.project(c)
        if not (isinstance(clauses[-1], S.Projection) and clauses[-1].final):
            first = [c for c in clauses if isinstance(c, S.Match)][0].paths[0]
            self.project(S.Projection([S.Item(S.Property(n.var, c), f"{n.var}.{c}") for n in first.nodes for c in ("name", "qualified_name", "label")], final=True))
        return self.rows


def _find(e: Any, kind: type, test=lambda _: True) -> list:
    """All parts of kind `kind` within a piece of the tree."""
    out = [e] if isinstance(e, kind) and test(e) else []
    if isinstance(e, list | tuple):
        parts = e
    elif hasattr(e, "__dataclass_fields__"):
        parts = [getattr(e, f) for f in e.__dataclass_fields__]
    else:
        parts = []
    for x in parts:
        out += _find(x, kind, test)
    return out


def query(graph: PropertyGraph, text: str, compat: bool = False, ceiling: int | None = None) -> DataFrame:
    """The result of a graph query. `compat` renders every cell as text, with '' for null and
    whole numbers without a fraction. With a `ceiling` a result of that many rows or more is an
    error: for readers that must not be flooded."""
    branches, every = S.parse(text)
    parts = [Planner(graph).run(b) for b in branches]
    out = parts[0]
    for p in parts[1:]:
        if len(p.columns) != len(out.columns):
            raise S.QueryError("the branches of a UNION differ in width")
        out = out.union(p)
    if len(parts) > 1 and not every:
        out = out.distinct()
    if compat:
        out = out.select(*[_text(out[f"`{c}`"], t).alias(c) for c, t in out.dtypes])
    return out if ceiling is None else guarded(out, ceiling)


def guarded(df: DataFrame, ceiling: int = 100_000) -> DataFrame:
    """`df`, or an error if it has `ceiling` rows or more. Only ceiling rows are looked at."""
    if df.limit(ceiling).count() >= ceiling:
        raise S.QueryError(f"the result has {ceiling} rows or more; narrow the query or set a LIMIT")
    return df


def _text(c: Column, kind: str) -> Column:
    if kind.startswith(("array", "struct", "map")):
        return F.coalesce(F.to_json(c), F.lit(""))
    if kind == "double":
        whole = (c == F.floor(c)) & (F.abs(c) < 1e10)
        return F.coalesce(F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string")), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))
