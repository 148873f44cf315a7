"""Deeply nested JSON as flat, related tables.

Every object gets a Merkle identity: the hash of its canonical form, in which child objects stand
by their own hashes. Identical objects are stored once; bridge rows keep each occurrence with its
record, parent, path and ordinal.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.hotkeys import split_join
from skein.session import materialize

BRIDGE = "src_table string, src_id bigint, parent_path string, child_path string, depth int, ordinal int, parent_hash string, object_hash string, fields string"
_ARROW = pa.schema(
    [("src_table", pa.string()), ("src_id", pa.int64()), ("parent_path", pa.string()), ("child_path", pa.string()), ("depth", pa.int32()), ("ordinal", pa.int32()), ("parent_hash", pa.string()), ("object_hash", pa.string()), ("fields", pa.string())]
)
_TOKEN = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))')


def _refuse(_: str) -> None:
    raise ValueError("not JSON")


def _iterative(text: str) -> object:
    """`json.loads` without recursion, for texts nested deeper than the interpreter's stack."""
    at, stack, done = 0, [], []
    # each stack entry: [container, pending key, state]; states: value, next, key, colon
    state: str = "value"
    end = len(text.rstrip(" \t\r\n"))

    def put(v: object) -> str:
        if not stack:
            done.append(v)
            return "end"
        top = stack[-1]
        if isinstance(top[0], list):
            top[0].append(v)
        else:
            top[0][top[1]] = v
        return "next"

    while at < end:
        m = _TOKEN.match(text, at)
        if not m or state == "end":
            raise ValueError("not JSON")
        at = m.end()
        mark, word, scalar = m.groups()
        if state in ("value", "first") and mark in ("{", "["):
            stack.append([{} if mark == "{" else [], None])
            state = "firstkey" if mark == "{" else "first"
        elif state in ("value", "first") and (word is not None or scalar is not None):
            state = put(json.loads(word if word is not None else scalar))
        elif state in ("firstkey", "key") and word is not None:
            stack[-1][1], state = json.loads(word), "colon"
        elif state == "colon" and mark == ":":
            state = "value"
        elif state == "next" and mark == ",":
            state = "key" if isinstance(stack[-1][0], dict) else "value"
        elif (mark == "}" and state in ("next", "firstkey") and isinstance(stack[-1][0], dict)) or (mark == "]" and state in ("next", "first") and isinstance(stack[-1][0], list)):
            state = put(stack.pop()[0])
        else:
            raise ValueError("not JSON")
    if state != "end":
        raise ValueError("not JSON")
    return done[0]


def parse(text: str | None) -> object:
    """The JSON value of `text`, a string that is itself JSON being read as its inner value;
    None where the text is null or no JSON (null has no objects either)."""
    value: object = text
    while isinstance(value, str):
        inner = value
        try:
            value = json.loads(inner, parse_constant=_refuse)
        except RecursionError:
            try:
                value = _iterative(inner)
            except ValueError:
                return None
        except ValueError:
            return None
        if value == inner:
            return None
    return value


def _scalar(v: object) -> object:
    """Numbers of equal value get one form: 1, 1.0 and 1e0 are the same."""
    if isinstance(v, float) and math.isfinite(v) and v == int(v) and abs(v) < 2**53:
        return int(v)
    return v


def digest(form: str) -> str:
    return hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _written(node: dict, hash_of: dict[int, str]) -> str:
    """An object's canonical form as `json.dumps` writes it, without recursion."""
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(True, "}")]
    for i, (k, v) in enumerate(sorted(((str(k), v) for k, v in node.items()), reverse=True)):
        todo += [(False, v), (True, json.dumps(k) + ":")]
        if i < len(node) - 1:
            todo.append((True, ","))
    todo.append((True, "{"))
    while todo:
        text, v = todo.pop()
        if text:
            out.append(v)
        elif isinstance(v, dict):
            out.append('{"#":"' + hash_of[id(v)] + '"}')
        elif isinstance(v, list):
            todo.append((True, "]"))
            for i, x in enumerate(reversed(v)):
                todo.append((False, x))
                if i < len(v) - 1:
                    todo.append((True, ","))
            todo.append((True, "["))
        else:
            out.append(json.dumps(_scalar(v)))
    return "".join(out)


def occurrences(value: object) -> list[tuple[str, str, int, int, str, str, str]]:
    """(parent_path, child_path, depth, ordinal, parent_hash, object_hash, fields) of every object
    in `value`, outermost first; a parent precedes its children. The outermost value, if an
    object, has depth 0 and no parent (empty path and hash). Ordinals count the objects of one
    parent in document order. Iterative, so depth is bounded by memory only."""
    order: list[dict] = []
    stack: list[tuple[object, str, int]] = [(value, "", -1)]
    while stack:  # document order: children are pushed in reverse
        node, path, parent = stack.pop()
        if isinstance(node, dict):
            me = len(order)
            order.append({"node": node, "path": path, "parent": parent})
            stack.extend((v, f"{path}.{k}" if path else str(k), me) for k, v in reversed(node.items()) if isinstance(v, dict | list))
        elif isinstance(node, list):
            stack.extend((v, f"{path}[{i}]", parent) for i, v in reversed(list(enumerate(node))) if isinstance(v, dict | list))
    for entry in order:
        up = entry["parent"]
        entry["depth"] = 0 if up < 0 else order[up]["depth"] + 1
        entry["ordinal"] = 0
        if up >= 0:
            order[up]["n"] = order[up].get("n", 0) + 1
            entry["ordinal"] = order[up]["n"] - 1
    hash_of: dict[int, str] = {}

    def form(v: object) -> object:
        if isinstance(v, dict):
            return {"#": hash_of[id(v)]}
        return [form(x) for x in v] if isinstance(v, list) else _scalar(v)

    for entry in reversed(order):  # children before parents
        try:
            fields = json.dumps({str(k): form(v) for k, v in entry["node"].items()}, sort_keys=True, separators=(",", ":"))
        except RecursionError:  # arrays nested thousands deep inside one field
            fields = _written(entry["node"], hash_of)
        entry["fields"] = fields
        entry["hash"] = hash_of[id(entry["node"])] = digest(fields)
    return [
        (order[e["parent"]]["path"] if e["parent"] >= 0 else "", e["path"], e["depth"] if not isinstance(value, list) else e["depth"] + 1, e["ordinal"], order[e["parent"]]["hash"] if e["parent"] >= 0 else "", e["hash"], e["fields"])
        for e in order
    ]


def _clean(s: str) -> str:
    return s.encode("utf-8", "replace").decode("utf-8")


_NAMES = [f.name for f in _ARROW][2:]
_KINDS = dict(x.strip().split() for x in BRIDGE.split(","))


def _trees(columns: tuple[str, ...]) -> tuple[pa.Schema, str]:
    """The form of parsed records whose trees keep `columns`, for Arrow and for Spark."""
    row = pa.struct([_ARROW.field(c) for c in columns])
    arrow = pa.schema([("src_table", pa.string()), ("src_id", pa.int64()), ("root_hash", pa.string()), ("rows", pa.list_(row))])
    return arrow, "src_table string, src_id bigint, root_hash string, rows array<struct<" + ", ".join(f"{c}: {_KINDS[c]}" for c in columns) + ">>"


def _tree(text: str, places: list[int], least: int) -> tuple[str, list[dict]]:
    """The identity of a text's value, and the wanted columns of its objects from depth `least`
    on; no identity for text that is no JSON or holds no object."""
    value = parse(text)
    rows = occurrences(value)
    if not rows:
        return "", []
    # an outermost array is its objects, with their places
    root = rows[0][5] if isinstance(value, dict) else digest(json.dumps([r[:6] for r in rows]))
    return root, [{_NAMES[i]: _clean(r[i]) if isinstance(r[i], str) else r[i] for i in places} for r in rows if r[2] >= least]


def _grow(columns: tuple[str, ...], least: int):
    schema, _ = _trees(columns)
    places = [_NAMES.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, list[dict]]] = {}
        told: set[str] = set()
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            size = 0
            for src, rid, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                got = known.get(text)
                if got is None:
                    got = _tree(text, places, least)
                    if len(known) > 20_000:
                        known.clear()
                    if len(text) < 4_000:
                        known[text] = got
                root, rows = got
                if not rows:
                    continue
                new = root not in told
                if new:
                    if len(told) > 200_000:
                        told.clear()
                    told.add(root)
                    size += len(rows)
                for col, x in zip(cols, (src, rid, root, rows if new else None), strict=True):
                    col.append(x)
                if size > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                    cols, size = [[] for _ in schema], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _texts(sources: tuple, nested_only: bool) -> DataFrame:
    picked = None
    for name, df, rid, text in sources:
        part = df.select(F.lit(name).alias("src_table"), F.col(f"`{rid}`").cast("bigint").alias("src_id"), F.col(f"`{text}`").alias("text"))
        picked = part if picked is None else picked.unionByName(part)
    opening = r"(\{|\\+u007[bB]).*?(\{|\\+u007[bB])" if nested_only else r"\{|\\+u007[bB]"
    wanted = F.col("text").rlike("(?s)" + opening)
    if nested_only:
        wanted = wanted | F.col("text").rlike(r'^\s*[\["]')
    return picked.where(wanted)


def object_graph(*sources: tuple[str, DataFrame, str, str], columns: Sequence[str] = tuple(_NAMES), nested_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The JSON of `sources`, each a (table name, DataFrame, id column, text column), as records and
    trees: `records(src_table, src_id, root_hash, n_rows)` names for each record the identity of
    its outermost value, with the number of equal rows, and `trees(root_hash, rows)` holds each
    distinct outermost value once, as its objects in document order, with the asked `columns` of:
    `parent_path`, `child_path`, `depth`, `ordinal`, `parent_hash`, `object_hash` and `fields`, the
    canonical form. Columns that aren't asked for are never written or shuffled.

    Null, empty and broken texts, and values without an object, give neither. Of a repeated key
    the last value counts. Objects in an outermost array have depth 1 and the parent path ''. A
    record with several texts has a row for each that differs in value; key order and spacing make
    none. `nested_only` leaves out the outermost objects and values that hold no other, those
    without a second brace, written out or escaped, before parsing, unless they are an array or a
    string, which may hold JSON.
    """
    columns = tuple(columns)
    parsed = materialize(_texts(sources, nested_only).mapInArrow(_grow(columns, int(nested_only)), _trees(columns)[1]), "trees")
    records = parsed.groupBy("src_table", "src_id", "root_hash").agg(F.count(F.lit(1)).alias("n_rows"))
    trees = parsed.where("rows is not null").groupBy("root_hash").agg(F.first("rows").alias("rows"))
    return records, trees


def occurrences_of(records: DataFrame, trees: DataFrame) -> DataFrame:
    """The bridge rows of all records: `src_table`, `src_id`, `root_hash`, and the columns of the
    trees' rows, one for each object of each record. A value that very many records share is
    joined by `split_join`; its tree is stored and sent once."""
    return split_join(records.drop("n_rows"), trees, "root_hash").select("src_table", "src_id", "root_hash", F.explode("rows").alias("r")).select("src_table", "src_id", "root_hash", "r.*")


def object_bridge(*sources: tuple[str, DataFrame, str, str], nested_only: bool = False) -> DataFrame:
    """Every occurrence of an object in the JSON of `sources` (see `object_graph`), one row each:
    `src_table`, `src_id`, `root_hash` and the columns of the trees. `nested_only` leaves out the
    outermost objects."""
    return occurrences_of(*object_graph(*sources, nested_only=nested_only))


def object_store(records: DataFrame, trees: DataFrame) -> DataFrame:
    """Each distinct object once: `object_hash`, `fields`, and `n_occurrences`, how often it occurs
    in the distinct records. Records are counted per outermost value first, so a value that many
    records share is one row."""
    n = records.groupBy("root_hash").agg(F.count(F.lit(1)).alias("n"))
    each = trees.join(n, "root_hash").select("n", F.explode("rows").alias("r"))
    return each.groupBy(F.col("r.object_hash").alias("object_hash")).agg(F.min("r.fields").alias("fields"), F.sum("n").alias("n_occurrences"))
