"""One entrance for readers: the operators by the names of the tools that ask for them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.norm import graph_path, in_scope
from skein.operators import lookup as L
from skein.operators import memory as M
from skein.operators import neighbors as N
from skein.operators import reach as R
from skein.operators import reports as P
from skein.operators import textsearch as T
from skein.plans.cypher import query
from skein.plans.graph import PropertyGraph
from skein.queries.upkeep import architecture
from skein.session import table
from skein.sources import readers, sinks
from skein.streaming import changes as X

#: How many rows a graph query may have at most.
CEILING = 100_000


@dataclass(frozen=True)
class Engine:
    """The tables below one folder. Every method gives DataFrames and changes no table; those that
    write give the table as it would be."""

    spark: SparkSession
    folder: str

    @property
    def graph(self) -> PropertyGraph:
        return PropertyGraph.from_tables(self.spark, self.folder)

    @property
    def notes(self) -> DataFrame:
        return P.note_states(table(self.spark, self.folder, "human_nodes"))

    # --- the graph

    def index_repository(self, root: str, ignore: Sequence[str] = (), fast: bool = False) -> DataFrame:
        """The source files an index would read."""
        return readers.discover(self.spark, root, ignore, fast)

    def search_graph(self, **conditions) -> DataFrame:
        return L.search(self.graph, **conditions)

    def query_graph(self, text: str, compat: bool = False, ceiling: int = CEILING) -> DataFrame:
        return query(self.graph, text, compat, ceiling)

    def trace_path(self, name: str, mode: str = "calls", direction: str = "both", max_hops: int = 3, tests: bool = False) -> DataFrame:
        return R.trace(self.graph, name, mode, direction, max_hops, tests)

    def get_code_snippet(self, name: str, project: str | None = None, neighbors: int = 0) -> DataFrame:
        return P.snippet(self.graph, name, project, neighbors)

    def get_graph_schema(self) -> dict[str, DataFrame]:
        g = self.graph
        return {"keys": N.schema_keys(g.nodes, "label"), "edge_keys": N.schema_keys(g.edges, "type"), "patterns": N.patterns(g), "samples": N.schema_samples(g)}

    def get_architecture(self, aspects: list[str] | None = None) -> dict[str, DataFrame]:
        return architecture(self.graph, aspects or ["overview"])

    def search_code(self, text: str) -> DataFrame:
        return T.search_code(self.graph, text)

    def list_projects(self) -> DataFrame:
        named = table(self.spark, self.folder, "projects").select("name")
        return named.union(table(self.spark, self.folder, "nodes").select("project")).where("name is not null").distinct()

    def delete_project(self, project: str) -> dict[str, DataFrame]:
        return sinks.clear_project({t: table(self.spark, self.folder, t) for t in ("nodes", "edges", "file_hashes")}, project)

    def index_status(self, state: DataFrame) -> DataFrame:
        return P.freshness(state)

    def detect_changes(self, changed: DataFrame, max_hops: int = 4) -> DataFrame:
        """What a set of changed files, `changed(project, file_path)`, reaches."""
        return R.impact(self.graph, changed, max_hops)

    def manage_adr(self, docs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Decision documents `docs(id, text)` with the sections of `new(id, section, body)` put in,
        and what is wrong with them."""
        merged = T.merge_sections(T.doc_sections(docs, "id", "text"), new)
        return T.render_sections(merged), T.section_problems(merged)

    def ingest_traces(self, otlp: DataFrame, width: str = "1 minute") -> DataFrame:
        """Requests per route of trace documents `otlp(at, value)`; a stream gives a stream."""
        spans = readers.spans(otlp.select("value", "at"), "at")
        return X.traffic(spans, width)

    # --- notes and reports

    def get_project_overview(self) -> DataFrame:
        return P.overview(self.graph, P.facts(self.graph, self.notes))

    def get_module_context(self, project: str, name: str) -> tuple[DataFrame, DataFrame]:
        """The module a name means, and the context of its file."""
        found = P.find_module(self.graph, project, name)
        context = P.module_context(self.graph, self.notes, P.facts(self.graph, self.notes))
        return found, context.where(F.col("project") == project).join(found.where("how = 'found'").select("file_path"), "file_path", "left_semi")

    def get_undocumented_hotspots(self, top: int = 50) -> DataFrame:
        return P.undocumented_hotspots(P.facts(self.graph, self.notes), top)

    def create_human_note(self, project: str, label: str, title: str, body: str = "", status: str = "active", source: str = "human") -> DataFrame:
        """All notes with one more; one that may not be stored is an error."""
        now = datetime.now(UTC).replace(tzinfo=None)
        row = [(project, label, title, body, status, source, None, now, now)]
        new = self.spark.createDataFrame(row, "project string, label string, title string, body_markdown string, status string, source string, confidence double, created_at timestamp, updated_at timestamp")
        good, bad = M.checked(new)
        if (problem := bad.first()) is not None:
            raise ValueError(f"a note with a wrong {problem['problem']}")
        return M.create(self.notes, good)

    def link_note_to_code_node(self, note_id: int, node_id: int) -> DataFrame:
        return M.link(self.notes, self.spark.createDataFrame([(note_id, node_id)], "note_id bigint, node_id bigint"))

    def search_code_and_memory(self, text: str, top: int = 40) -> DataFrame:
        return T.interleaved({"note": T.search_notes(self.notes, text).select("id"), "code": T.search_code(self.graph, text).select("id")}, top)

    def lookup_source_text(self, docs: DataFrame, literals: Sequence[str]) -> DataFrame:
        return T.literal_hits(docs, literals)

    def prepare_edit_context(self, nodes: DataFrame) -> DataFrame:
        return P.edit_context(self.graph, self.notes, P.facts(self.graph, self.notes), nodes)

    # --- what the map of a project reads

    def neighborhood(self, node: int, after: int = 0, size: int = 100) -> DataFrame:
        return N.neighborhood_page(self.graph, node, after, size)

    def node_search(self, text: str) -> DataFrame:
        return L.ranked_search(self.graph, text)

    def path(self, source: int, target: int, max_hops: int = 6) -> tuple[DataFrame, DataFrame]:
        return R.shortest_path(self.graph, source, target, max_hops)

    def scope(self, path: str) -> DataFrame:
        return self.graph.nodes.where(self._below(path))

    def dashboard(self) -> dict[str, DataFrame]:
        f = P.facts(self.graph, self.notes)
        return {"overview": P.overview(self.graph, f), "risks": P.top_risks(f), "hotspots": P.hotspots(f), "notes": P.note_counts(self.notes)}

    @staticmethod
    def _below(path: str) -> Column:
        return in_scope(graph_path(F.col("file_path")), path)
