"""Normal forms of paths, names and routes, and small scores, as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def graph_path(path: Column) -> Column:
    """Forward slashes, without a drive letter and outer slashes; null counts as ''."""
    p = F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^[A-Za-z]:(?=/)", ""), r"^/+|/+$", "")


def community_key(path: Column, label: Column, depth: int = 3) -> Column:
    """The first `depth` folders of a path; `(root)` for a file at the top, `(virtual)/<label>`
    for a node without a path. A Directory or Folder is its own folder."""
    p = graph_path(path)
    parts = F.split(p, "/")
    folder = F.when(label.isin("Directory", "Folder"), parts).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.when(p == "", F.concat(F.lit("(virtual)/"), F.coalesce(label, F.lit("")))).when(F.size(folder) == 0, F.lit("(root)")).otherwise(F.array_join(F.slice(folder, 1, depth), "/"))


def domain_key(path: Column, label: Column) -> Column:
    """The first folder of the community."""
    return F.substring_index(community_key(path, label), "/", 1)


def qn_package(qn: Column) -> Column:
    """Third dotted part with three dots or more, second with at least one, else ''."""
    parts = F.split(qn, r"\.")
    return F.when(F.size(parts) > 3, parts[2]).when(F.size(parts) > 1, parts[1]).otherwise("")


def qn_top_package(qn: Column) -> Column:
    parts = F.split(qn, r"\.")
    return F.when(F.size(parts) > 1, parts[1]).otherwise("")


#: Languages and the extensions of their files, and files known by their whole name (fixed values).
LANGUAGES = {
    "Python": "py pyi pyw", "Go": "go", "JavaScript": "js jsx mjs cjs", "TypeScript": "ts tsx mts cts", "Rust": "rs", "Java": "java",
    "C++": "cc ccm cpp cppm cxx hh hpp hxx ixx", "C": "c h", "C#": "cs", "PHP": "php", "Lua": "lua", "Scala": "scala sc", "Kotlin": "kt kts",
    "Ruby": "rb rake gemspec", "Bash": "sh bash", "Zig": "zig", "Elixir": "ex exs", "Haskell": "hs", "OCaml": "ml mli", "HTML": "html htm",
    "CSS": "css", "YAML": "yaml yml", "TOML": "toml", "HCL": "hcl tf", "SQL": "sql", "Erlang": "erl", "Swift": "swift", "Dart": "dart",
    "Groovy": "groovy gradle", "Perl": "pl pm", "R": "r", "SCSS": "scss", "Vue": "vue", "Svelte": "svelte", "Clojure": "clj cljc cljs",
    "CMake": "cmake", "COBOL": "cbl cob", "Common Lisp": "cl lisp lsp", "CUDA": "cu cuh", "Dockerfile": "dockerfile", "DotEnv": "env", "Elm": "elm",
    "Emacs Lisp": "el", "F#": "fs fsi fsx", "FORM": "frm prc", "Fortran": "f03 f08 f90 f95", "GLSL": "frag glsl vert", "GraphQL": "gql graphql",
    "INI": "cfg conf ini", "JSON": "json", "Julia": "jl", "Lean": "lean", "Magma": "mag magma", "Makefile": "mk", "Markdown": "md mdx",
    "MATLAB": "m matlab mlx", "Meson": "meson", "Nix": "nix", "Protobuf": "proto", "Verilog": "sv v", "Vim Script": "vim vimrc",
    "Just": "just justfile", "BitBake": "bb bbappend bbclass inc", "Wolfram": "wl wls", "XML": "xml xsd xsl svg", "Ada": "adb ads", "Agda": "agda",
    "Astro": "astro", "AWK": "awk", "Beancount": "beancount", "BibTeX": "bib", "Bicep": "bicep", "Starlark": "bzl", "Cairo": "cairo",
    "Cap'n Proto": "capnp", "Apex": "cls", "Crystal": "cr", "CSV": "csv", "D": "d", "Diff": "diff", "Pascal": "dpr pas", "DeviceTree": "dts dtsi",
    "FunC": "fc", "Fish": "fish", "Fennel": "fnl", "HLSL": "fx hlsl hlsli", "GDScript": "gd", "Gleam": "gleam", "GN": "gn gni",
    "Go Template": "gotmpl tpl", "Hare": "ha", "Hyprlang": "hl", "ISPC": "ispc", "Jinja2": "j2 jinja jinja2", "Janet": "janet", "JSON5": "json5",
    "Jsonnet": "jsonnet", "KDL": "kdl", "Kconfig": "kconfig", "Linker Script": "ld", "Liquid": "liquid", "LLVM": "ll", "Luau": "luau",
    "Mermaid": "mmd", "Mojo": "mojo", "Move": "move", "NASM": "nasm asm", "Nickel": "ncl", "Odin": "odin", "Pkl": "pkl", "Pony": "pony",
    "PowerShell": "ps1 psm1", "Prisma": "prisma", "PureScript": "purs", "QML": "qml", "Racket": "rkt", "RON": "ron", "ReScript": "res resi",
    "Scheme": "scm ss", "Slang": "slang", "Smali": "smali", "Solidity": "sol", "SOQL": "soql", "Squirrel": "nut", "Tcl": "tcl", "Teal": "tl",
    "Templ": "templ", "Thrift": "thrift", "TLA+": "tla", "Typst": "typ", "VHDL": "vhd vhdl", "WGSL": "wgsl", "WIT": "wit",
}
LANGUAGE_OF_FILE = {
    "dockerfile": "Dockerfile", "makefile": "Makefile", "gnumakefile": "Makefile", "cmakelists.txt": "CMake", "justfile": "Just", "build": "Starlark", "build.bazel": "Starlark",
    "workspace": "Starlark", "workspace.bazel": "Starlark", "kconfig": "Kconfig", "meson.build": "Meson", "gemfile": "Ruby", "rakefile": "Ruby", "go.mod": "Go Module", "hyprland.conf": "Hyprlang",
    "ssh_config": "SSH Config", "sshd_config": "SSH Config",
}


def language(path: Column) -> Column:
    """By the whole name, else by the extension, both in lower case; null if unknown."""
    name = F.lower(F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)$", 1))
    ext = F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)
    by_name = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF_FILE.items() for x in kv])
    by_ext = F.create_map(*[F.lit(x) for lang, exts in LANGUAGES.items() for e in exts.split() for x in (e, lang)])
    return F.coalesce(by_name[name], by_ext[ext])


def is_test_path(path: Column) -> Column:
    """Below a test folder, or named as a test or a specification; case apart."""
    return F.coalesce(F.lower(graph_path(path)).rlike(r"(^|/)(test|tests|__tests__)/|\.(test|spec)\."), F.lit(False))


def is_test_file(path: Column) -> Column:
    """By the naming habits of many languages: test folders, prefixes and endings."""
    p = F.coalesce(path, F.lit(""))
    return p.rlike(r"(^|/)(__tests__|tests|test|spec)/|(^|/)test_[^/]*$|_test\.(go|py|rs|cpp|lua)$|\.(test|spec)\.(ts|js|tsx)|Test\.(java|kt|cs|php)$|Spec\.scala$|_spec\.rb$")


def sounds_like_test(qn: Column) -> Column:
    """Whether a qualified name speaks of tests or of what stands in for the real thing."""
    return F.coalesce(qn.rlike(r"Test|test|Mock|mock|Stub|stub|Fake|fake|Fixture|spec"), F.lit(False))


def is_test_name(name: Column) -> Column:
    """A function's name that test runners look for."""
    hooks = ("test", "it", "describe", "beforeAll", "afterAll", "beforeEach", "afterEach", "@testset", "@test")
    return F.coalesce(name.rlike(r"^(Test|Benchmark|Example)([A-Z]|$)|^test_|^test[A-Z]") | name.isin(*hooks), F.lit(False))


def owner_qn(qn: Column) -> Column:
    """The named owner of an anonymous function."""
    return F.regexp_replace(qn, r"(::(anonymous#\d+|<anonymous>))+$", "")


def path_scope(scope: str) -> str:
    """A scope as it compares with paths: trimmed, without `./`, outer and doubled slashes."""
    s = re.sub(r"/{2,}", "/", scope.strip(" \t\r\n"))
    while s.startswith(("./", "/")):
        s = s[2:] if s.startswith("./") else s[1:]
    return s.rstrip("/")


def in_scope(path: Column, scope: str) -> Column:
    s = path_scope(scope)
    return F.lit(True) if not s else (path == s) | path.startswith(s + "/")


def glob_to_like(glob: str) -> str:
    """`**` and `*` match any text, `?` one character; a text without them matches as a part."""
    if not re.search(r"[*?]", glob):
        return "%" + re.sub(r"([\\%_])", r"\\\1", glob) + "%"
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out.rstrip("/") + "%", i + 2
            i += glob.startswith("/", i)
        elif glob[i] == "*":
            out, i = out + "%", i + 1
        elif glob[i] == "?":
            out, i = out + "_", i + 1
        else:
            out, i = out + (("\\" + glob[i]) if glob[i] in "\\%_" else glob[i]), i + 1
    return out


def camel_words(name: Column) -> Column:
    """The words of a camel-case or separated name, in lower case."""
    s = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def route_path(path: Column) -> Column:
    """A route with every parameter written `{}`."""
    out = path
    for p in (r"\$\{[^}]*\}", r"\{[^}]*\}", r"<[^>]*>", r":[A-Za-z_]\w*"):
        out = F.regexp_replace(out, p, "{}")
    return out


def _accented() -> tuple[str, str]:
    """Letters that decompose to one ASCII letter with marks, and those letters."""
    pairs = []
    for cp in range(0xC0, 0x1F00):
        base = unicodedata.normalize("NFD", chr(cp))
        if len(base) > 1 and base[0].isascii() and base[0].islower() and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((chr(cp), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def slug(title: Column, limit: int = 200) -> Column:
    """Lower case, accents off, anything else than letters and digits a single dash."""
    plain = F.regexp_replace(F.translate(F.lower(title), *_accented()), r"[\u0300-\u036f]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, limit)


def risk_score(degree: Column, complexity: Column, notes: Column) -> Column:
    bare = F.when((degree > 0) & (notes == 0), 0.2).otherwise(0.0)
    return F.least(F.least(degree / 100.0, F.lit(1.0)) * 0.5 + F.least(complexity / 20.0, F.lit(1.0)) * 0.3 + bare, F.lit(1.0))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.7, "high").when(c >= 0.45, "medium").when(c >= 0.25, "speculative").otherwise("")


def hop_risk(hop: Column) -> Column:
    return F.when(hop == 1, "CRITICAL").when(hop == 2, "HIGH").when(hop == 3, "MEDIUM").otherwise("LOW")


def truthy(text: Column) -> Column:
    """The three ways in which JSON properties hold a true flag."""
    return F.coalesce(text.isin("true", "1"), F.lit(False))


def url_path(url: Column) -> Column:
    """What follows the host, from the third slash on; '/' if nothing does."""
    rest = F.regexp_extract(url, r"^[^/]*//[^/]*(/.*)$", 1)
    return F.when(rest == "", F.when(url.startswith("/"), url).otherwise("/")).otherwise(rest)


def duration_ns(start: Column, end: Column) -> Column:
    """Nanoseconds between two times written as text; null if either is no number."""
    return end.try_cast("bigint") - start.try_cast("bigint")


def proximity(a: Column, b: Column) -> Column:
    """1 to 1.1 by the share of leading folders two paths have in common."""
    fa, fb = (F.slice(F.split(graph_path(x), "/"), 1, F.greatest(F.size(F.split(graph_path(x), "/")) - 1, F.lit(0))) for x in (a, b))
    same = F.aggregate(
        F.arrays_zip(fa.alias("a"), fb.alias("b")),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda acc, x: F.struct((acc["n"] + F.when(acc["go"] & F.coalesce(x["a"] == x["b"], F.lit(False)), 1).otherwise(0)).alias("n"), (acc["go"] & F.coalesce(x["a"] == x["b"], F.lit(False))).alias("go")),
        lambda acc: acc["n"],
    )
    most = F.greatest(F.size(fa), F.size(fb))
    return F.when(most > 0, 1.0 + 0.1 * same / most).otherwise(1.0)
