"""Packing, mixing, visual forms and hand-written files on small cases."""

import random
import unicodedata
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import queries as Q
from skein.llm import visual
from skein.llm.handwritten import classify, expansions, features, grammar_ratio, re_pair, shared_rules
from skein.llm.mixing import flight, landing, mix, plan, shares
from skein.llm.packing import best_fit, pack, windows
from skein.llm.tokens import token_counts
from skein.llm.visual import look_classes, same_looking, visual_forms

# --- tokens and packing


def test_token_counts_of_whole_texts(spark):
    import tiktoken  # noqa: F401

    from skein.llm.tokens import VOCABULARY, _encoding

    texts = [None, "", "one two", "naïve façade ²", "a" * 20_000, "word " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("n_tokens", F.lit(9))
    got = {r["id"]: r["n_tokens"] for r in token_counts(df, "id", "text").collect()}
    assert got == {i: len(_encoding(VOCABULARY).encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert token_counts(df.where("false"), "id", "text").count() == 0


def test_best_fit_never_overfills():
    rng = np.random.default_rng(4)
    for cap in (1, 7, 100):
        sizes = rng.integers(1, cap + 1, 400)
        bins = best_fit(sizes, cap)
        loads = np.bincount(bins, sizes)
        assert loads.max() <= cap
        assert len(loads) <= 1.25 * sizes.sum() / cap + 1 or cap < 3 or (sizes > cap / 2).sum() > len(loads) * 0.4


def placed(df):
    rows = {}
    for r in df.collect():
        rows.setdefault(r["window_id"], []).append(r)
    return rows


@pytest.mark.parametrize("block", [7, 50, 100_000])
def test_packing_places_everything_once(spark, block):
    rng = random.Random(block)
    items = [(i, rng.choice([1, 5, 40, 60, 99, 100, 101, 250, 300, rng.randrange(1, 90)])) for i in range(600)]
    df = spark.createDataFrame([*items, (1000, 0), (1001, None), (None, 5)], "doc_id bigint, n_tokens bigint").withColumn("size", F.lit(1))
    out = placed(windows(pack(df, 100, block=block)))
    seen = {}
    for rows in out.values():
        assert sum(r["n_tokens"] for r in rows) == rows[0]["window_tokens"] <= 100
        assert sorted(r["position"] for r in rows) == list(range(len(rows)))
        for r in rows:
            seen.setdefault(r["doc_id"], []).append((r["part"], r["start_token"], r["n_tokens"]))
    for i, n in items:
        parts = sorted(seen.pop(i))
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(k for *_, k in parts) == n
        assert len(parts) == max(1, -(-n // 100)) and [s for _, s, _ in parts] == [100 * p for p in range(len(parts))]
    assert not seen
    total = sum(n for _, n in items)
    assert len(out) <= (1.1 if block > 7 else 1.6) * total / 100 + 1


def test_packing_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert pack(none, 10).count() == 0
    big = spark.createDataFrame([(i, 6) for i in range(300)], "doc_id bigint, n_tokens bigint")  # no two fit together
    assert pack(big, 10, block=16).count() == 300
    same = spark.createDataFrame([(1, 4)] * 5, "doc_id bigint, n_tokens bigint")
    assert pack(same, 8).count() == 3


def test_packing_ends_only_when_nothing_fits_together(spark):
    for seed in range(3):
        rng = random.Random(seed)
        df = spark.createDataFrame([(i, rng.choice([3, 30, 51, 55, 70])) for i in range(500)], "doc_id bigint, n_tokens bigint").repartition(6)
        sizes = sorted(r["size"] for r in pack(df, 100, block=40).collect())
        assert len(sizes) < 2 or sizes[0] + sizes[1] > 100


# --- mixing


def test_flight_keeps_sums_and_landing_is_near():
    rng = random.Random(9)
    units = [[0.37, float(rng.choice([1, 10, 10, 500]))] for _ in range(500)]
    want_n, want_size = sum(u[0] for u in units), sum(u[0] * u[1] for u in units)
    flight(units, rng)
    assert sum(0 < u[0] < 1 for u in units) <= 2
    assert abs(sum(u[0] for u in units) - want_n) < 1e-5 and abs(sum(u[0] * u[1] for u in units) - want_size) < 1e-3
    landing(units)
    assert all(u[0] in (0, 1) for u in units) and abs(sum(u[0] * u[1] for u in units) - want_size) <= 500


def test_flight_is_fair():
    hits = np.zeros(9)
    for s in range(1500):
        units = [[0.4, float(x)] for x in (1, 2, 3, 4, 5, 6, 7, 8, 9)]
        flight(units, random.Random(s))
        hits += [u[0] for u in units]
    assert np.all(np.abs(hits / 1500 - 0.4) < 0.06)


def test_plan_obeys_the_tightest_source():
    assert plan({"a": 100, "b": 50}, [("a", 0.5, 2), ("b", 0.5, 1)]) == {"a": 0.5, "b": 1.0}
    assert plan({"a": 100}, [("a", 0.5, 2), ("b", 0.5, 1)]) == {"a": 2.0}
    assert plan({}, []) == {}


@pytest.mark.parametrize("block", [40, 100_000])
def test_mix_reaches_its_shares(spark, block):
    rng = random.Random(1)
    docs = [(i, rng.choice("aaaaaabbc"), rng.randrange(1, 200)) for i in range(1500)] + [(9000, None, 5), (9001, "z", 5), (9002, "a", 0), (9003, "a", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").withColumn("p", F.lit(3))
    targets = [("a", 0.3, 2), ("b", 0.3, 3), ("c", 0.4, 4)]
    m = mix(df, targets, block=block)
    rows = m.collect()
    caps = {s: c for s, _, c in targets}
    assert all(1 <= r["repeats"] <= caps[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    total = sum(r["n_tokens"] * r["repeats"] for r in rows)
    for s, share, _ in targets:
        got = sum(r["n_tokens"] * r["repeats"] for r in rows if r["source"] == s) / total
        assert abs(got - share) < (0.002 if block > 40 else 0.01)
    t = spark.createDataFrame(targets + [("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    told = {r["source"]: r for r in shares(m, t).collect()}
    assert told["none"]["tokens"] == 0 and abs(sum(r["actual_share"] for r in told.values()) - 1) < 1e-9


def test_mix_without_a_source_is_empty(spark):
    df = spark.createDataFrame([(1, "a", 5)], "doc_id bigint, source string, n_tokens bigint")
    assert [tuple(r) for r in mix(df, [("a", 0.5, 2), ("b", 0.5, 2)]).collect()] == [(1, "a", 5, 2)]
    assert mix(df.where("false"), [("a", 1.0, 2)]).count() == 0
    told = {r["source"]: r["actual_share"] for r in shares(mix(df, [("a", 0.5, 2), ("b", 0.5, 2)]), spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")).collect()}
    assert told == {"a": 1.0, "b": 0.0}


@pytest.mark.parametrize(("n_sources", "each", "block"), [(60, 12, 300), (3000, 3, 200)])
def test_mix_ends_with_very_many_sources(spark, n_sources, each, block):
    """More open units than a block holds, however often they meet."""
    rng = random.Random(5)
    docs = [(s * each + i, f"s{s}", rng.randrange(1, 100)) for s in range(n_sources) for i in range(each)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    rows = mix(df, [(f"s{s}", 1 / n_sources, 2) for s in range(n_sources)], block=block).collect()
    assert 0 < len(rows) <= len(docs) and {r["repeats"] for r in rows} <= {1, 2}
    assert len({r["source"] for r in rows}) > 0.7 * n_sources


# --- visual forms

TABLE = {cp: "".join(map(chr, out)) for cp in range(0x110000) if not 0xD800 <= cp < 0xE000 and (out := visual._simple(cp, visual._SAME)) is not None}


def form(text):
    """Brute force: the mapping character by character, then canonical composition."""
    return unicodedata.normalize("NFC", text.translate(TABLE))


def test_look_alikes_hold_the_public_table(spark):
    """The written list against ICU's letters of other scripts: what it has agrees, and the mapping
    has them all."""
    public = visual._confusable(spark)
    assert len(public) > 200 and all(visual._SAME.get(c, base) == base for c, base in public.items())
    whole = {r["cp"]: "".join(p["ch"] for p in r["parts"]) for r in visual.mapping(spark).collect()}
    assert all(whole[c] == chr(base) for c, base in public.items())
    assert not any(chr(c).isdigit() for c in public)


def test_no_table_of_look_alikes_is_an_error(spark):
    """A mapping with the written list alone would pass for the whole one."""
    checker = SimpleNamespace(getSkeleton=lambda text: "a")
    for icu in (SimpleNamespace(), SimpleNamespace(text=SimpleNamespace(SpoofChecker=SimpleNamespace(Builder=lambda: SimpleNamespace(build=lambda: checker))))):
        jvm = SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=icu)))
        for context in (SimpleNamespace(applicationId="none", _jvm=jvm), SimpleNamespace(applicationId="none")):
            with pytest.raises(RuntimeError):
                visual.mapping(SimpleNamespace(sparkContext=context))
    assert "none" not in visual._ROWS and len(visual._confusable(spark)) > 200


CASES = [
    "plain text\nwith\ttabs", "", "naïve", "naïve", "ｆｕｌｌ　ｗｉｄｔｈ１２", "zero​width⁠﻿", "soft­hyphen", "thin no break space",
    "hy‐phen‑s", "раypal", "ΑΒΕ abc", "ȩ́ ȩ́", "Å Å Å", "x² x2", "ﬁ fi", "Å", "한글", "한", "ガ ｶﾞ", "a\x07b", "́start", "µ μ",
    "👨‍👩", "𝒜 𐐷", "q̣̇", "ḍ̇", "й й", "Ё ё",
]


def test_forms_against_brute_force(spark):
    rng = random.Random(6)
    alphabet = list("ab é\n") + ["́", "̧", "‍", "ｅ", "е", "ᅡ", "ᄀ", "가", "ᆨ", " ", "̈́", "ﾞ", "ｶ"]
    texts = CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(400)]
    texts.append("ａ" * 5000 + "́" * 40 + " plain " * 2000)
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id bigint, text string").withColumn("piece", F.lit(1)).withColumn("form", F.lit("x"))
    got = {r["id"]: r["form"] for r in visual_forms(df, "id", "text", chunk=64).collect()}
    joiner = {i for i, t in enumerate(texts) if "👨" in t}
    for i, t in enumerate(texts):
        assert got[i] == (t if i in joiner else form(t)), (i, t)
    assert got[-1] is None


def test_repeated_rows_and_ids(spark):
    df = spark.createDataFrame([(1, "é x"), (1, "é x"), (1, "ｅ"), (None, "é"), (2, "ab"), (2, "ab")], "id bigint, text string")
    got = sorted(((r["id"], r["form"]) for r in visual_forms(df, "id", "text").collect()), key=str)
    assert got == sorted([(1, "é x"), (1, "é x"), (1, "e"), (None, "é"), (2, "ab"), (2, "ab")], key=str)
    twice = spark.createDataFrame([(1, "abc"), (1, "abc"), (2, "аbc"), (2, "аbc"), (3, "x"), (3, "ｘ")], "id bigint, text string")
    assert [tuple(r) for r in same_looking(twice, "id", "text").collect()] == [(1, 2)]


def test_what_a_reader_sees_stays_apart(spark):
    apart = ["resume", "résumé", "Resume", "x2", "x²", "x₂", "ﬁn", "fin", "a b", "ab", "ß", "ss", "1", "l", "①"]
    forms = [form(t) for t in apart]
    assert len(set(forms)) == len(apart)


def test_same_looking_pairs(spark):
    texts = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, "ａbc"), (5, "Abc"), (6, None), (7, ""), (8, "​"), (9, "abd")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("id", F.lit(1)).withColumn("form", F.lit(1))
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in same_looking(df, "doc_id", "text").collect()}
    assert got == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4), (7, 8)}
    assert same_looking(df.where("false"), "doc_id", "text").count() == 0


def test_a_form_of_very_many_variants_is_linear(spark):
    signs = ["a", "а"]
    texts = ["".join(signs[n >> i & 1] for i in range(12)) for n in range(4096)]
    df = spark.createDataFrame([*enumerate(texts), (9000, texts[5]), (9001, "other"), (9001, "other"), (9002, None)], "id bigint, text string")
    got = {r["id"]: (r["class_id"], r["text_id"], r["n_texts"]) for r in look_classes(df, "id", "text").collect()}
    assert got == {i: (0, i, 4096) for i in range(4096)} | {9000: (0, 5, 4096), 9001: (9001, 9001, 1)}
    assert look_classes(df.where("false"), "id", "text").count() == 0


# --- hand-written files


def expand(seq, rules):
    return [y for x in seq for y in (expand(rules[x], rules) if x in rules else [x])]


def test_re_pair_round_trip():
    rng = random.Random(8)
    for text in ("", "a", "aaaa", "aaaaaaa", "abababab", "mississippi", "".join(rng.choice("ab") for _ in range(300))):
        seq, rules, uses = re_pair(list(text))
        assert "".join(expand(seq, rules)) == text
        assert all(uses[r] >= 1 for r in rules)  # an early rule may end up inside one later rule
        left = [tuple(seq[i : i + 2]) for i in range(len(seq) - 1)]
        assert len(seq) <= 3 or all(left.count(p) == 1 or p[0] == p[1] for p in left)
    for _ in range(300):
        text = "".join(rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(60)))
        seq, rules, _ = re_pair(list(text))
        assert "".join(expand(seq, rules)) == text
        left = [tuple(seq[i : i + 2]) for i in range(len(seq) - 1)]
        assert len(seq) <= 3 or all(left.count(p) == 1 or p[0] == p[1] for p in left)
    assert grammar_ratio(list("ab" * 200)) < 0.1 < 0.8 < grammar_ratio([rng.randrange(10**9) for _ in range(200)])


CODE = "import { a } from './b';\nexport function load(x: number) {\n  if (!x) return;\n"
MINIFIED = "!function(a,b){a.x=b}(this,1);" * 19
FILES = [
    ("src/own.ts", 3000, 100, CODE, None), ("src/generator_tool.ts", 3000, 100, "// Tells whether a file was generated: looks for the words DO NOT EDIT\n" + CODE, None),
    ("src/a.ts", 3000, 100, "// Code generated by protoforge v1.2; DO NOT EDIT.\n" + CODE, "generated"), ("src/b.ts", 3000, 100, "// Generated (toolx 6.1). hand edits get lost.\n" + CODE, "generated"),
    ("src/c.ts", 3000, 100, "// First scaffolded with left-pad, rewritten by hand since; edit freely.\n" + CODE, None), ("src/d.pb.go", 3000, 100, CODE, "generated"),
    ("src/__generated__/e.ts", 3000, 100, CODE, "generated"), ("a\\node_modules\\x\\f.ts", 3000, 100, CODE, "vendored"), ("src/vendors/g.ts", 3000, 100, CODE, None),
    ("src/h.ts", 3000, 100, "/*! Copied unchanged from left-pad@1.2.3; keep in step with upstream */\n" + CODE, "vendored"), ("src/i.ts", 3000, 100, "// Copyright 2025 the atlas team\n" + CODE, None),
    ("src/j.js", 90000, 3, MINIFIED, "minified"), ("src/k.js", 90000, 900, "const d = [\n" + "  0.1234, 0.98765, 0.3456, 0.8712, 0.55341,\n" * 3 + "".join(f"  0.{(i * 7919) % 99991:05d}, 0.{(i * 104729) % 99991:05d},\n" for i in range(20)), "data"),
    ("src/l.ts", 531, 13, "const limits = [99, 13, 87, 37];\n" + CODE, None), ("src/m.ts", 100, 5, None, None), ("src/known.ts", 100, 5, CODE, "vendored"),
    ("src/n.ts", 3000, 100, "// " + "licence " * 120 + "code generated by x; do not edit\n" + CODE, "generated"), ("src/o.ts", 3000, 100, "// wrapper around left-pad; our own code\n" + CODE, None),
    ("src/p.ts", 3000, 100, "// own-thing 1.2.3\n" + CODE, None), (None, None, None, "", None),
]


def test_kinds_of_files(spark):
    rows = [(i, p, s, "ABC " if p == "src/known.ts" else f"h{i}", "pr") for i, (p, s, *_) in enumerate(FILES)]
    files = spark.createDataFrame(rows * 2, "id bigint, file_path string, size bigint, content_hash string, project string").withColumn("kind", F.lit("x"))
    heads = spark.createDataFrame([(i, n, h) for i, (_, _, n, h, _) in enumerate(FILES) if h is not None], "file_id bigint, n_lines bigint, head string")
    known = spark.createDataFrame([("abc", None), (None, "left-pad"), (None, "")], "content_hash string, package string")
    got = {r["file_id"]: r["kind"] for r in classify(files, heads, known).collect()}
    assert got == {i: f[4] for i, f in enumerate(FILES)}
    assert classify(files.where("false"), heads, known).count() == 0


def test_features_of_odd_heads():
    for h in (None, "", "\n\n", "x" * 600, "/* open comment", "0x1f, " * 90):
        assert len(features(h)) == 7


def test_rules_shared_across_projects(spark):
    rules = re_pair(list("abcdefghijk" * 3))[1]
    assert max(map(len, (e.split() for e in expansions(rules, 8)))) >= 8
    read = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"]), (3, ["y"]), (4, []), (5, None)], "file_id bigint, rules array<string>")
    of = spark.createDataFrame([(1, "p"), (2, "q"), (3, "p"), (4, "q"), (5, "q")], "file_id bigint, project string")
    assert sorted(map(tuple, shared_rules(read, of).collect())) == [(1, 2, 1), (2, 1, 1), (3, 1, 0)]


# --- the registered queries on the smallest tables


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_has_rows_and_is_as_its_sql(spark, sf, name):
    from tests.compare import differences

    sql = Q.oracle_sql().get(name)
    if sql is not None:
        assert differences(spark, name, Q.queries()[name], sql, sf) == ""
        return
    rows = Q.queries()[name](spark, sf).collect()
    assert rows or name in ("p8_found", "p10_found", "p5_found")  # nothing to find on the smallest tables is right
