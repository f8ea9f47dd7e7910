"""Text columns. Character classes are spelt out, so results don't hang on an engine's idea of ``\\w`` and ``\\s``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's strip() takes for white space.
EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
TOKEN = r"[\p{L}\p{N}_]{2,}"
PIECE = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def python_strip(x: Column) -> Column:
    return F.regexp_replace(x, EDGE, "")


def collapse_space(x: Column) -> Column:
    return F.regexp_replace(python_strip(x), r"(?U)[\s\x1c-\x1f]+", " ")


def name_key(x: Column) -> Column:
    """Names that differ in case or outer white space are one."""
    return F.lower(python_strip(x))


def doc_id_format(dataset: str, split: Column, row: Column) -> Column:
    return F.format_string("%s-%s-%06d", F.lit(dataset), split, row)


def preview(x: Column, length: int = 300, keep: int | None = None) -> Column:
    """Texts longer than ``length`` cut to ``keep`` code points (default ``length``) and dots."""
    return F.when(F.length(x) > length, F.concat(F.substring(x, 1, keep or length), F.lit("..."))).otherwise(x)


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0))


def token_cap(x: Column, limit: int) -> tuple[Column, Column]:
    """(first ``limit`` pieces joined by a space if there are more, else the text; whether it was cut)."""
    pieces = F.regexp_extract_all(x, F.lit(PIECE), F.lit(0))
    cut = F.size(pieces) > limit
    return F.when(cut, F.array_join(F.slice(pieces, 1, limit), " ")).otherwise(x), cut


def topic_names(x: Column) -> Column:
    """Names in lines such as ``[1] Name: text``."""
    return F.regexp_extract_all(x, F.lit(r"(?mU)^\[\d+\] ([\w\s\-'&]+):"), F.lit(1))


def first_json_block(x: Column) -> Column:
    """From the first brace to the last, or null."""
    found = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def confidence_label(mean: Column) -> Column:
    return F.when(mean.isNull(), "unaudited").when(mean >= 4, "high").when(mean >= 3, "medium").otherwise("low")


def agreement_label(ari: Column) -> Column:
    return F.when(ari > 0.65, "strong").when(ari > 0.25, "moderate").otherwise("weak")
