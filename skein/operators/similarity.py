"""Similar sets and vectors: MinHash, exact set joins, TF-IDF, random indexing, vector search."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.norm import camel_words
from skein.session import evaluated, materialize

#: Short forms in names and what they stand for (fixed values).
ABBREVIATIONS = {
    "err": "error", "exc": "exception", "ex": "exception", "ctx": "context", "cfg": "config", "conf": "configuration", "env": "environment",
    "opt": "option", "opts": "options", "req": "request", "res": "response", "resp": "response", "rsp": "response", "hdr": "header",
    "hdrs": "headers", "str": "string", "fmt": "format", "msg": "message", "txt": "text", "lbl": "label", "desc": "description", "buf": "buffer",
    "arr": "array", "vec": "vector", "lst": "list", "dict": "dictionary", "tbl": "table", "stk": "stack", "que": "queue", "fn": "function",
    "func": "function", "cb": "callback", "proc": "procedure", "ctor": "constructor", "dtor": "destructor", "db": "database", "col": "column",
    "stmt": "statement", "txn": "transaction", "trx": "transaction", "repo": "repository", "auth": "authentication", "authz": "authorization",
    "perm": "permission", "cred": "credential", "tok": "token", "pwd": "password", "val": "value", "num": "number", "int": "integer",
    "bool": "boolean", "flt": "float", "dbl": "double", "idx": "index", "iter": "iterator", "elem": "element", "cnt": "count", "len": "length",
    "sz": "size", "pos": "position", "off": "offset", "cap": "capacity", "init": "initialize", "deinit": "deinitialize", "alloc": "allocate",
    "dealloc": "deallocate", "del": "delete", "rm": "remove", "impl": "implementation", "iface": "interface", "abs": "abstract",
    "decl": "declaration", "param": "parameter", "arg": "argument", "attr": "attribute", "prop": "property", "ret": "return", "src": "source",
    "dst": "destination", "tgt": "target", "orig": "original", "prev": "previous", "cur": "current", "tmp": "temporary", "temp": "temporary",
    "conn": "connection", "sess": "session", "sock": "socket", "addr": "address", "url": "uniform", "srv": "server", "cli": "client",
    "svc": "service", "ep": "endpoint", "mgr": "manager", "ctrl": "controller", "hdlr": "handler", "sched": "scheduler", "disp": "dispatcher",
    "reg": "registry", "chan": "channel", "sem": "semaphore", "mtx": "mutex", "wg": "waitgroup", "sig": "signal", "evt": "event",
    "sub": "subscriber", "pub": "publisher", "spec": "specification", "mock": "mock", "stub": "stub", "assert": "assertion", "log": "logging",
    "lvl": "level", "dbg": "debug", "wrn": "warning", "inf": "info", "ts": "timestamp", "dur": "duration", "ttl": "timetolive", "ver": "version",
    "ns": "namespace", "pkg": "package", "mod": "module", "lib": "library", "dep": "dependency", "ref": "reference", "ptr": "pointer",
    "obj": "object", "doc": "document", "cmd": "command", "ops": "operations", "util": "utility", "hlp": "helper", "ext": "extension",
}


def name_tokens(name: Column) -> Column:
    """The words of a name, with short forms followed by their long ones."""
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    w = camel_words(name)
    return F.concat(w, F.filter(F.transform(w, lambda x: table[x]), lambda x: x.isNotNull()))


def shingles(words: Column, n: int) -> Column:
    """Distinct hashes of n consecutive words; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " "))))).otherwise(F.array().cast("array<bigint>"))


def minhash(hashes: Column, k: int = 64) -> Column:
    """The least of k hash functions over a set."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.array_min(F.transform(hashes, lambda h: F.xxhash64(s, h))))


def signatures(docs: DataFrame, id_col: str, words: Column, shingle: int = 5, k: int = 64, least: int = 30) -> DataFrame:
    """(`id_col`, signature): the MinHash of each text's shingles; null for texts of fewer than
    `least` words."""
    worded = evaluated(docs, "__words", words).where(F.col("__words").isNotNull())
    hashed = evaluated(worded, "__hashes", shingles(F.col("__words"), shingle))
    return hashed.select(id_col, F.when(F.size("__words") >= least, minhash(F.col("__hashes"), k)).alias("signature"))


def agreement(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures, an estimate of their Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def signature_hex(sig: Column) -> Column:
    """64 hashes as 512 hexadecimal digits, the lower 32 bits of each."""
    return F.array_join(F.transform(sig, lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From `sets(id, items)` (sorted, distinct): members (id, class_id) and classes (class_id,
    items): equal sets are one class, named after its least id. Empty sets have no class."""
    keyed = sets.where(F.size("items") > 0).withColumn("key", F.md5(F.to_json("items")))
    least = keyed.groupBy("key").agg(F.min("id").alias("class_id"))
    members = keyed.select("id", "key").join(least, "key").select("id", "class_id")
    return members, keyed.select(F.col("id").alias("class_id"), "items").join(least.select("class_id"), "class_id", "left_semi")


def similar_sets(classes: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b, jaccard), a below b, of `classes(class_id, items)` with a Jaccard
    similarity of at least `threshold`.

    Exact, by prefix filtering: items are put in order from rare to frequent, and sets that are
    similar enough must share one of the first `size - ceil(threshold * size) + 1`; only such
    pairs, of sizes that can agree, are compared. Sets meet within classes of size whose
    neighbours alone can agree, so an item that very many sets share is spread over them. No
    candidate is dropped.
    """
    items = classes.select("class_id", F.size("items").alias("n"), F.explode("items").alias("item"))
    freq = items.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    shared = items.join(freq.where("df > 1"), "item")  # an item of one set joins nothing
    alone = items.join(freq.where("df = 1"), "item", "left_semi").groupBy("class_id").agg(F.count(F.lit(1)).alias("own"))
    by = Window.partitionBy("class_id").orderBy("df", "item")
    ranked = shared.withColumn("r", F.row_number().over(by)).join(alone, "class_id", "left")
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    prefix = ranked.where(F.col("r") + F.coalesce("own", F.lit(0)) <= keep).select("item", "class_id", "n")
    a = prefix.select("item", F.col("class_id").alias("a"), F.col("n").alias("na"))
    b = prefix.select("item", F.col("class_id").alias("b"), F.col("n").alias("nb"))
    step = -math.log(max(threshold, 1e-3)) or 1e-6
    size_class = lambda n: F.floor(F.log(F.col(n).cast("double")) / step + 1e-9).cast("bigint")
    a = a.withColumn("size", size_class("na"))
    b = b.withColumn("size", F.explode(F.array(size_class("nb") - 1, size_class("nb"), size_class("nb") + 1)))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9)
    pairs = a.join(b, ["item", "size"]).where(fits).select("a", "b").distinct()
    full = pairs.join(classes.select(F.col("class_id").alias("a"), F.col("items").alias("x")), "a").join(classes.select(F.col("class_id").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return full.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12)


def near_duplicates(docs: DataFrame, id_col: str, words: Column, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: `class_id` (the least id with the same shingles; its own id for texts
    shorter than a shingle) and `n_links`, how many other classes are similar enough."""
    worded = evaluated(docs, "__words", words).select(F.col(id_col).alias("id"), "__words")
    sets = materialize(worded.select("id", F.sort_array(shingles(F.col("__words"), shingle)).alias("items")), "sets")
    members, classes = set_classes(sets)
    links = similar_sets(materialize(classes, "classes"), threshold)
    both = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    out = sets.select("id").join(members, "id", "left").join(both, "class_id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def idf(docs: DataFrame) -> DataFrame:
    """(token, df, idf) over `docs(id, tokens)`: idf is ln(N / df)."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select("id", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n), F.lit(True)).select("token", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def tfidf(docs: DataFrame) -> DataFrame:
    """(id, token, df, w): unit vectors of tf * idf; tokens that every document has weigh nothing
    and are left out."""
    tf = docs.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(idf(docs).where("idf > 0"), "token").withColumn("x", F.col("tf") * F.col("idf"))
    return raw.withColumn("w", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))).select("id", "token", "df", "w")


def cosine_join(vectors: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b, cosine), a below b, of unit vectors `vectors(id, token, df, w)` with a
    cosine of at least `threshold`. Exact: tokens from rare to frequent, and of each vector only
    the first ones, until the rest is too short to reach the threshold alone, seek partners."""
    by = Window.partitionBy("id").orderBy("df", "token")
    rest = F.lit(1.0) - F.coalesce(F.sum(F.col("w") * F.col("w")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    prefix = vectors.withColumn("rest", rest).where(F.sqrt(F.greatest("rest", F.lit(0.0))) >= threshold - 1e-9).select("token", "id")
    pairs = prefix.withColumnRenamed("id", "a").join(prefix.withColumnRenamed("id", "b"), "token").where("a < b").select("a", "b").distinct()
    whole = vectors.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("v"))
    full = pairs.join(whole.withColumnsRenamed({"id": "a", "v": "x"}), "a").join(whole.withColumnsRenamed({"id": "b", "v": "y"}), "b")
    dot = F.aggregate(F.map_entries("x"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at("y", e["key"]), F.lit(0.0)))
    return full.select("a", "b", dot.alias("cosine")).where(F.col("cosine") >= threshold)


def index_positions(token: Column, dims: int = 768, k: int = 8) -> Column:
    """k signed places of a token's random vector: (position, sign), from its hash."""
    h = lambda i: F.xxhash64(token, i)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(F.pmod(h(i), F.lit(dims)).cast("int").alias("position"), F.when(F.pmod(F.shiftright(h(i), 40), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))


def random_index(docs: DataFrame, window: int = 5, dims: int = 768) -> DataFrame:
    """(token, position, x): token vectors that add up the random vectors of the tokens within
    `window` places, at unit length. Neighbour pairs are counted first, with map-side combine, so
    a token's vector follows its distinct neighbours."""
    at = docs.select(F.posexplode("tokens").alias("i", "token"), "tokens")
    near = at.select("token", F.explode(F.array_except(F.sequence(F.greatest(F.lit(0), F.col("i") - window), F.least(F.size("tokens") - 1, F.col("i") + window)), F.array("i"))).alias("j"), "tokens")
    pairs = near.select("token", F.col("tokens")[F.col("j")].alias("context")).groupBy("token", "context").agg(F.count(F.lit(1)).alias("n"))
    parts = pairs.select("token", "n", F.explode(index_positions(F.col("context"), dims)).alias("p"))
    summed = parts.groupBy("token", F.col("p.position").alias("position")).agg(F.sum(F.col("n") * F.col("p.sign")).alias("x")).where("x <> 0")
    return summed.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("token"))))


def blended_index(docs: DataFrame, window: int = 5, dims: int = 768, alpha: float = 0.3, beta: float = 0.7) -> DataFrame:
    """(token, position, x): `random_index` in two passes. The second adds up the first pass's
    vectors of a token's neighbours, so tokens with like company come near each other; the result
    is `alpha` of the first and `beta` of the second, at unit length."""
    first = materialize(random_index(docs, window, dims), "index")
    at = docs.select(F.posexplode("tokens").alias("i", "token"), "tokens")
    near = at.select("token", F.explode(F.array_except(F.sequence(F.greatest(F.lit(0), F.col("i") - window), F.least(F.size("tokens") - 1, F.col("i") + window)), F.array("i"))).alias("j"), "tokens")
    pairs = near.select("token", F.col("tokens")[F.col("j")].alias("context")).groupBy("token", "context").agg(F.count(F.lit(1)).alias("n"))
    company = pairs.join(first.withColumnRenamed("token", "context"), "context").groupBy("token", "position").agg(F.sum(F.col("n") * F.col("x")).alias("y"))
    unit = company.withColumn("y", F.col("y") / F.sqrt(F.sum(F.col("y") * F.col("y")).over(Window.partitionBy("token"))))
    both = first.join(unit, ["token", "position"], "full_outer").select("token", "position", (F.lit(alpha) * F.coalesce("x", F.lit(0.0)) + F.lit(beta) * F.coalesce("y", F.lit(0.0))).alias("x"))
    return both.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("token")))).where("x <> 0")


def diffuse(vectors: DataFrame, links: DataFrame, alpha: float = 0.3) -> DataFrame:
    """(id, v): (1 - alpha) * own vector + alpha * mean of the neighbours', at unit length; a node
    without neighbours keeps its direction. `vectors(id, v)`, `links(src, dst)`."""
    parts = links.join(vectors.select(F.col("id").alias("dst"), F.posexplode("v").alias("i", "x")), "dst")
    mean = parts.groupBy(F.col("src").alias("id"), "i").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    mixed = vectors.join(mean, "id", "left").select("id", F.when(F.col("m").isNull(), F.col("v")).otherwise(F.zip_with("v", "m", lambda a, b: (1 - alpha) * a + alpha * b)).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return mixed.withColumn("norm", norm).select("id", F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.col("v")).alias("v"))


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, rank, id, cosine): the k rows of `rows(id, v)` nearest to each of `queries(id,
    v)`, ties by id. Queries go out in blocks of `block`, so what is sent is bounded; every
    partition keeps k candidates per query, and the best are merged per query. Vectors without a
    length, or of another dimension, have the cosine 0."""
    n_blocks = max(1, -(-queries.count() // (block // 2)))
    numbered = materialize(queries.select(F.col("id").alias("query_id"), "v", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("b")), "queries")
    found = None
    for b in range(n_blocks):
        got = numbered.where(F.col("b") == b).select("query_id", "v").toPandas().sort_values("query_id")
        if not len(got):
            continue
        ids, mat = got["query_id"].to_numpy(), _unit(np.array(got["v"].tolist(), np.float64))

        def local(batches: Iterator[pd.DataFrame], ids=ids, mat=mat) -> Iterator[pd.DataFrame]:
            best: list[list] = [[] for _ in ids]
            for batch in batches:
                if not len(batch):
                    continue
                sims = np.round(mat @ _unit(np.array(batch["v"].tolist(), np.float64)).T, 9)
                rid = batch["id"].to_numpy()
                for q in range(len(ids)):
                    top = np.argsort(-sims[q], kind="stable")[: 2 * k] if len(rid) > 2 * k else range(len(rid))
                    cut = min(sims[q][i] for i in top)
                    for i in set(top) | set(np.flatnonzero(sims[q] == cut)):
                        heapq.heappush(best[q], (sims[q][i], -int(rid[i])))
                        if len(best[q]) > k:
                            heapq.heappop(best[q])
            yield pd.DataFrame([(int(ids[q]), -i, float(s)) for q, h in enumerate(best) for s, i in h], columns=["query_id", "id", "cosine"])

        part = rows.select("id", "v").mapInPandas(local, "query_id bigint, id bigint, cosine double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("cosine")).where(F.lit(False))
    by = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "cosine")


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


#: How many keywords one question may have.
MOST_KEYWORDS = 32


def keyword_search(rows: DataFrame, keywords: Sequence[Sequence[float]], top: int = 16, labels: Sequence[str] | None = None) -> DataFrame:
    """Rows of `rows(id, v)` by the least cosine to any of the keyword vectors, at most
    `MOST_KEYWORDS`, more being an error: a row must fit all of them. `labels` asks for rows of
    some `label` only. One pass with built-in expressions; only the top is sorted out."""
    if len(keywords) > MOST_KEYWORDS:
        raise ValueError(f"{len(keywords)} keywords; at most {MOST_KEYWORDS} can be asked for at once")
    if labels is not None:
        rows = rows.where(F.col("label").isin(*labels))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    v = F.transform("v", lambda x: x.cast("double"))
    sims = []
    for key in keywords:
        q = F.array(*[F.lit(float(x)) for x in key])
        dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        sims.append(dot / (norm(v) * float(np.linalg.norm(np.array(key, np.float64)))))
    if not sims:
        return rows.select("id", F.lit(None).cast("double").alias("score")).where(F.lit(False))
    return rows.select("id", F.round(F.array_min(F.array(*sims)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(top)


def quantized(v: Column) -> Column:
    """A unit vector as bytes: each part times 127, rounded."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.round(F.when(norm > 0, x.cast("double") / norm * 127).otherwise(0.0)).cast("tinyint"))


def cosine_i8(a: Column, b: Column) -> Column:
    """The cosine of two vectors of bytes; 0 where one has no length or the dimensions differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("bigint") * q.cast("bigint")), F.lit(0).cast("bigint"), lambda s, t: s + t)
    square = dot(a, a).cast("double") * dot(b, b).cast("double")
    return F.when((F.size(a) == F.size(b)) & (square > 0), dot(a, b) / F.sqrt(square)).otherwise(0.0)
