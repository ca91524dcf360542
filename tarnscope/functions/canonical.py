"""Digests of JSON texts that depend on what they say, not on how it is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings, numbers, and what stands between them.
TOKEN = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'


def plain_number(token: Column) -> Column:
    """A number without exponent and trailing zeros where a decimal can hold it exactly, else as a double."""
    short = F.regexp_replace(token.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    small = F.when(F.regexp_like(short, F.lit("^-?0?$")), "0").otherwise(short)
    exact = F.abs(token.try_cast("decimal(38,18)").cast("double") - token.try_cast("double")) <= F.abs(token.try_cast("double")) * 1e-15
    whole = F.when(F.abs(token.try_cast("double")) >= 1e15, token.try_cast("decimal(38,0)").cast("string"))
    return F.when(exact, small).otherwise(F.coalesce(whole, token.try_cast("double").cast("string")))


def canonical_json(text: Column) -> Column:
    """The value in one form: keys sorted at every depth, no blanks, one way to write a number and a string.

    A VARIANT keeps its keys sorted and its strings decoded, at any depth; only numbers keep their kind
    (1.0 and 1e0 are a decimal and a double) and are written anew. Null and malformed texts give null; of a
    repeated key a malformed text is made.
    """
    sorted_text = F.to_json(F.try_parse_json(text))
    tokens = F.regexp_extract_all(sorted_text, F.lit(TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(F.regexp_like(t, F.lit("^-?[0-9]")), plain_number(t)).otherwise(t)), "")


def json_digest(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)
