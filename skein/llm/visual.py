"""One consistent form for texts that look the same."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skein.operators.hotkeys import split_join
from skein.session import materialize

#: Letters and signs drawn like another (fixed values): each string's characters look like its key.
#: `_confusable` adds the letters of Unicode's own table.
LOOK_ALIKES = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟⅭ", "D": "ᎠⅮ", "E": "ΕЕᎬ", "G": "ԌᏀ", "H": "ΗНᎻ", "I": "ΙІӀⅠ", "J": "ЈᎫͿ", "K": "ΚКᏦ", "L": "ᏞⅬ",
    "M": "ΜМϺᎷⅯ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ΤТᎢ", "U": "Ս", "V": "ѴᏙⅤ", "W": "ԜᎳ", "X": "ΧХⅩ",
    "Y": "ΥҮ", "Z": "ΖᏃ", "a": "аɑ", "c": "сϲⅽ", "d": "ԁⅾ", "e": "е", "g": "ɡ", "h": "һ", "i": "іⅰ", "j": "јϳ", "l": "ⅼ", "m": "ⅿ", "n": "ո",
    "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "ѵνⅴ", "w": "ԝ", "x": "хⅹ", "y": "уү", "z": "ᴢ", "!": "ǃ", "/": "⁄∕", ":": "꞉∶",
    ".": "․", "*": "∗", "|": "ǀ∣", "\\": "∖", "-": "‐‑﹣", "'": "ʼ", "μ": "µ",
}
#: Spaces with a width but no ink; the ogham space mark is drawn with a stroke.
_DRAWN_SPACE = " "
#: Format characters that are drawn.
_DRAWN_FORMAT = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Letters and marks without a glyph, by Unicode's default-ignorable property (fixed values).
_BLANK = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

#: Characters that are their own form: written ASCII, tab and line ends.
_PLAIN = r"\t\n\r -~"
#: A text's pieces: a run of plain characters up to one that something may combine with, or one
#: character with the marks and invisible signs behind it.
PIECES = rf"[{_PLAIN}]+(?=[{_PLAIN}])|[\s\S][\p{{M}}\p{{Cf}}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9fﾞﾟᅟ-ᇿㅤﾠ]*"


def _simple(cp: int, same: dict[int, int]) -> list[int] | None:
    """What one code point stands for, before marks are ordered and recomposed; None if itself.
    `same` tells which signs look like another."""
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if (kind == "Cf" and cp not in _DRAWN_FORMAT) or cp in _BLANK or (kind == "Cc" and ch not in "\t\n\r\x85"):
        return []
    if kind == "Zs" and ch != _DRAWN_SPACE:
        return [0x20]
    width = unicodedata.decomposition(ch)
    if width.startswith(("<wide>", "<narrow>")):
        ch = "".join(chr(int(x, 16)) for x in width.split()[1:])
    out = [ord(c) for c in unicodedata.normalize("NFD", ch)]
    out = [same.get(c, c) for c in out]
    return None if out == [cp] else out


_SAME = {ord(c): ord(base) for base, signs in LOOK_ALIKES.items() for c in signs}


def _confusable(spark: SparkSession) -> dict[int, int]:
    """Letters of other scripts that Unicode's public table of confusable characters, as the ICU
    library beside Spark holds it, draws like a Latin letter of the same case; letters without case
    count as capitals. Without the library, or without an answer for each letter, this is an error:
    fewer letters would pass for a result. Digits, and pairs of Latin letters, are left apart: a
    reader tells them from each other."""
    try:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except Exception as missing:
        raise RuntimeError("look-alike letters need a session with a JVM of its own and the ICU library (com.ibm.icu) beside Spark") from missing
    kind = unicodedata.category
    other = [c for c in map(chr, range(0x80, 0x20000)) if kind(c) in ("Lu", "Ll", "Lo") and not unicodedata.name(c, "").startswith(("LATIN", "CJK", "HANGUL")) and unicodedata.normalize("NFKC", c) == c]
    latin = [c for c in map(chr, range(0x41, 0x7B)) if c.isalpha()]
    like = checker.getSkeleton("\n".join([*latin, *other])).split("\n")
    if len(like) != len(latin) + len(other):
        raise RuntimeError(f"the ICU library drew {len(like)} letters for {len(latin) + len(other)}")
    of: dict[tuple[str, str], str] = {(s, kind(c)): c for c, s in zip(latin, like, strict=False)}
    found = {}
    for c, s in zip(other, like[len(latin) :], strict=True):
        base = of.get((s, "Lu" if kind(c) == "Lo" else kind(c)))
        if base is not None:
            found[ord(c)] = ord(base)
    return found


_ROWS: dict[str, list[tuple]] = {}


def mapping(spark: SparkSession) -> DataFrame:
    """(cp, parts): what each code point that isn't its own form stands for; `parts` are (ch,
    class), the class being the combining class. At most one row per code point of Unicode,
    whatever the data; worked out once per application."""
    app = spark.sparkContext.applicationId
    if app not in _ROWS:
        _ROWS[app] = _mapped(_confusable(spark))
    return spark.createDataFrame(_ROWS[app], "cp int, parts array<struct<ch string, class int>>")


def _mapped(confusable: dict[int, int]) -> list[tuple]:
    rows = []
    same = confusable | _SAME
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co", "Cs"):
            continue
        out = _simple(cp, same)
        if out is not None or (kind[0] == "M" and unicodedata.combining(ch)):
            rows.append((cp, [(chr(c), unicodedata.combining(chr(c))) for c in (out if out is not None else [cp])]))
    return rows + [(cp, [(chr(c), 0) for c in out]) for cp in range(0x80) if (out := _simple(cp, same)) is not None]


@F.pandas_udf(StringType())
def _recomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t))


def cluster_forms(clusters: DataFrame) -> DataFrame:
    """(piece, form) for each distinct `piece` that isn't its own form.

    The piece is exploded to positioned code points, joined to the broadcast mapping, its marks
    are put in order of their class behind their base, and bases are recomposed with their marks.
    A joiner behind a pictograph is kept, since it changes what is drawn. Only distinct pieces are
    worked on, so the work follows the inventory of characters, not the size of the texts.
    """
    points = clusters.select("piece", F.posexplode(F.split("piece", "")).alias("pos", "ch")).where("ch <> ''").withColumn("cp", F.ascii("ch"))
    first = F.ascii(F.substring("piece", 1, 1))
    itself = F.array(F.struct("ch", F.lit(0).alias("class")))
    drawn = (F.col("cp") == 0x200D) & ((first >= 0x1F000) | first.between(0x2600, 0x27BF))
    parts = F.when(drawn | F.col("parts").isNull(), itself).otherwise(F.col("parts"))
    joined = points.join(F.broadcast(mapping(clusters.sparkSession)), "cp", "left").select("piece", "pos", parts.alias("parts"))
    every = joined.select("piece", "pos", F.posexplode("parts").alias("sub", "part")).select("piece", "pos", "sub", "part.ch", "part.class")
    upto = Window.partitionBy("piece").orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, 0)
    blocks = every.withColumn("block", F.sum((F.col("class") == 0).cast("int")).over(upto))
    ordered = blocks.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("block", "class", "pos", "sub", "ch"))).alias("seq"))
    written = clusters.join(ordered, "piece", "left").select("piece", F.coalesce(F.array_join("seq.ch", ""), F.lit("")).alias("form"))
    return written.select("piece", _recomposed("form").alias("form")).where("piece <> form")


def _forms(docs: DataFrame, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """(id, raw, form) of each row: `raw` is the MD5 of the text as it came."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("raw", F.md5("text"))
    plain = F.col("text").isNull() | F.col("text").rlike(rf"\A[{_PLAIN}]*\z")
    # rows are told apart by a number of their own, as ids may repeat
    numbered = texts.where(~plain).withColumn("row", F.monotonically_increasing_id())
    pieces = numbered.select("row", "id", "raw", F.posexplode(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))).alias("pos", "piece"))
    odd = ~F.col("piece").rlike(rf"\A[{_PLAIN}]*\z")
    forms = materialize(cluster_forms(pieces.where(odd).select("piece").distinct()), "forms")
    joined = pieces.join(forms, "piece", "left").select("row", "id", "raw", "pos", F.coalesce("form", "piece").alias("piece"))
    put = lambda order, what: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, what))), lambda s: s[what]), "")
    chunks = joined.groupBy("row", "id", "raw", F.floor(F.col("pos") / chunk).alias("n")).agg(put("pos", "piece").alias("part"))
    whole = chunks.groupBy("row", "id", "raw").agg(put("n", "part").alias("form")).select("id", "raw", "form")
    return texts.where(plain).select("id", "raw", F.col("text").alias("form")).unionByName(whole)


def visual_forms(docs: DataFrame, id_col: str, text_col: str, chunk: int = 512) -> DataFrame:
    """(`id_col`, form): each whole text in its consistent form.

    The form is the canonical composition of the text after width variants, spaces, hyphens and
    look-alike letters are mapped to their plain kind and invisible signs are removed. Case,
    digits, raised and circled forms, ligatures, accents, tabs and line ends stay. A null text has
    a null form, an empty text an empty one; repeated rows repeat. The form of a form is itself.

    Texts of plain characters are done where they are read. The others are exploded to positioned
    pieces; the pieces' forms, found once per distinct piece, come in by a join, and the pieces
    are put together in two steps, first `chunk` at a time, so no group grows with a text.
    """
    return _forms(docs, id_col, text_col, chunk).select(F.col("id").alias(id_col), "form")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents (id, raw, form) by the hashes of text and form, and the different texts (raw,
    text_id, class_id, n_texts), named after their least documents. Counts merge before each
    shuffle; the join by form is of distinct texts, and what is skewed in it AQE splits."""
    forms = _forms(docs, id_col, text_col, 512).where("form is not null and id is not null")
    both = materialize(forms.select("id", "raw", F.md5("form").alias("form")), "classes")
    texts = both.groupBy("form", "raw").agg(F.min("id").alias("text_id"))
    classes = texts.groupBy("form").agg(F.min("text_id").alias("class_id"), F.count(F.lit(1)).alias("n_texts"))
    return both, texts.join(classes, "form").select("raw", "text_id", "class_id", "n_texts")


def look_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, text_id, n_texts), one row per distinct id and text that isn't null:
    documents of one `class_id` look the same, those of one `text_id` are equal character by
    character, and `n_texts` is how many different texts the class has. Both ids are the least of
    their documents'. The work is linear in the documents, however many variants a form or copies
    a text has."""
    both, texts = _classes(docs, id_col, text_col)
    return split_join(both.select("id", "raw").distinct(), materialize(texts, "texts"), "raw").select("id", "class_id", "text_id", "n_texts")


def same_looking(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id_a, doc_id_b), a below b: documents whose texts differ though their forms agree, as
    pairs, for those who ask for them; `look_classes` says the same in one row per document.

    Only classes of at least two different texts are followed; equal copies of a text meet each
    other nowhere, only in the pairs that are asked for. Null texts look like nothing; repeated
    rows count once.
    """
    both, texts = _classes(docs, id_col, text_col)
    odd = materialize(texts.where("n_texts > 1"), "variants")
    links = odd.select("class_id", F.col("raw").alias("a")).join(odd.select("class_id", F.col("raw").alias("b")), "class_id").where("a < b").select("a", "b")
    members = materialize(both.join(odd.select("raw"), "raw", "left_semi").select("id", "raw").distinct(), "members")
    out = links.join(members.toDF("x", "a"), "a").join(members.toDF("y", "b"), "b")
    return out.where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
