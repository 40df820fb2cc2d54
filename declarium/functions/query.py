"""Query text ``<signature>`` or ``<name> :: <signature>`` as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declarium.functions.text import drop_placeholder, normalise, strip


def query_name(text: Column) -> Column:
    """Part before the first ``::``, or null."""
    cut = F.instr(text, "::")
    return F.when(cut > 0, F.nullif(strip(F.substring(text, F.lit(1), cut - 1)), F.lit("")))


def query_signature_text(text: Column) -> Column:
    """Part after the first ``::``, or the whole text."""
    cut = F.instr(text, "::")
    return strip(F.when(cut > 0, F.substring(text, cut + 2, F.length(text))).otherwise(text))


def placeholder_declaration(part: Column) -> Column:
    """Signature text as a declaration, with a stand-in name where it has none."""
    closed = F.when(F.endswith(part, F.lit(";")), part).otherwise(F.concat(part, F.lit(";")))
    paren = F.instr(part, "(")
    named = part.rlike(r"(?U)\w+\s*\(") & ~F.contains(part, F.lit(" ("))
    return (
        F.when((paren == 0) | (F.instr(part, ")") == 0), closed)
        .when(F.contains(part, F.lit("__q__")), closed)
        .when(named, closed)
        .otherwise(
            F.concat(
                strip(F.substring(part, F.lit(1), paren - 1)),
                F.lit(" __q__ "),
                strip(F.substring(part, paren, F.length(part))),
                F.lit(";"),
            )
        )
    )


def query_signature(text: Column) -> Column:
    """Normalised signature of a query, or null."""
    part = query_signature_text(text)
    declaration = F.when(part != "", placeholder_declaration(part))
    return F.nullif(drop_placeholder(normalise(declaration), "__q__"), F.lit(""))


def query_status(queries: DataFrame) -> DataFrame:
    """``query_id, error`` of each query of a batch; the error is null where it can be searched."""
    return parse_queries(queries).select("query_id", "error")


def parse_queries(queries: DataFrame) -> DataFrame:
    """``query_id, query_text`` to ``query_id, query_text, name, signature_norm, error``."""
    text = F.col("query_text")
    return queries.select(
        "query_id",
        "query_text",
        query_name(text).alias("name"),
        query_signature(text).alias("signature_norm"),
        F.when(text.isNull(), F.lit("query text is null")).alias("error"),
    )
