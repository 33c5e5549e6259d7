"""Text expressions that hold for CJK and Latin text: trimming, ids, tokens, JSON blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals, and how articles and headings are written.
NUMERALS = "一二三四五六七八九十百千零〇0-9"
ARTICLE = f"第[{NUMERALS}]+条(?:第[{NUMERALS}]+款)?"
HEADING = f"第[{NUMERALS}]+(?:章|编|分编|节)"
#: An article's beginning, and a heading line with a title of at most 40 characters.
ARTICLE_MARK = f"({ARTICLE})"
HEADING_MARK = rf"(?mU)(^[\s　]*{HEADING})"
MARK = "\u0001"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s　]+|[\s　]+$", "")


def normalize_space(c: Column) -> Column:
    """CRLF to LF, then runs of blanks and tabs to one blank."""
    return F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "[ \t]+", " ")


def short_md5(c: Column, n: int) -> Column:
    return F.left(F.md5(c), F.lit(n))


def chunk_id(doc: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("chunk_"), short_md5(F.concat_ws("::", doc, start.cast("string"), end.cast("string")), 12))


def cache_key(text: Column) -> Column:
    return F.concat(F.lit("emb_"), short_md5(text, 16))


def safe_name(c: Column) -> Column:
    return F.left(F.regexp_replace(c, r"(?U)[^\w一-龥]", "_"), F.lit(30))


def node_id(label: str | Column, first: Column, *more: Column) -> Column:
    """label_name_hash; empty or null further parts do not count."""
    label = F.lit(label) if isinstance(label, str) else label
    raw = F.concat_ws("::", label, *[F.nullif(p.cast("string"), F.lit("")) for p in (first, *more)])
    return F.concat(label, F.lit("_"), safe_name(F.coalesce(first, F.lit(""))), F.lit("_"), short_md5(raw, 8))


def importer_node_id(label: str | Column, first: Column, extra: Column | None = None) -> Column:
    """As node_id, with colons trimmed from both ends of what is hashed."""
    label_c = F.lit(label) if isinstance(label, str) else label
    raw = F.btrim(F.concat(label_c, F.lit("::"), first, F.lit("::"), extra if extra is not None else F.lit("")), F.lit(":"))
    return F.concat(label_c, F.lit("_"), safe_name(first), F.lit("_"), short_md5(raw, 8))


def standard_id(c: Column, compat: bool = False) -> Column:
    """std_ and the name with other than word characters as `_`; compat: all characters."""
    return F.concat(F.lit("std_"), F.left(F.regexp_replace(c, r"(?s)." if compat else r"(?U)[^\w]", "_"), F.lit(50)))


def tokens(c: Column) -> Column:
    """Lower-case words of a-z and 0-9, and single CJK characters."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+|[一-龥])"), F.lit(1))


def search_tokens(c: Column) -> Column:
    """Lower-case words of a-z and 0-9, and of each run of CJK characters every two
    neighbours: a stand-in for a word segmenter, which any tokenizer can replace."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+|[一-龥]+)"), F.lit(1))
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda x: F.when(x.rlike("^[一-龥]{2,}$"), pairs(x)).otherwise(F.array(x))))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def any_contains(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words], F.lit(False))


def json_block(raw: Column) -> Column:
    """The JSON object in a model's answer: in a json fence, in any fence, the whole
    answer if it begins with a brace, or from the first brace to the last."""
    raw = strip(raw)
    fenced = F.when(raw.contains("```json"), F.nullif(F.regexp_extract(raw, r"(?sU)```json\s*(\{.*?\})\s*```", 1), F.lit("")))
    plain = F.when(raw.contains("```"), F.nullif(F.regexp_extract(raw, r"(?sU)```\s*(\{.*?\})\s*```", 1), F.lit("")))
    whole = F.when(raw.startswith("{"), raw)
    return F.coalesce(fenced, plain, whole, F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit("")))
