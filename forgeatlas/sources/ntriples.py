"""Line-based RDF scan (A20): N-Triples, one statement per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NODE = r"<[^>]*>|_:[^\s]+"
_LITERAL = r'"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9\-]+)?'
_LINE = rf"^\s*({_NODE})\s+(<[^>]*>)\s+({_NODE}|{_LITERAL})\s*\.\s*(?:#.*)?$"
# Nodes of a line that is known to be a statement, in their order.
_PART = rf"{_LITERAL}|{_NODE}"
_LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
_XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(?:#.*)?$"))


def _decoded(quoted):
    """Text of a quoted literal. Escapes are taken apart first, so that an escaped backslash
    before a U is no escape of a code point; eight-digit escapes become the pair of
    four-digit ones that JSON knows, the others are those of JSON."""
    tokens = F.regexp_extract_all(quoted, F.lit(r"\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))
    unit = lambda code: F.concat(F.lit("\\u"), F.lpad(F.hex(code), 4, "0"))

    def plain(token):
        code = F.conv(F.substr(token, F.lit(3)), 16, 10).cast("long")
        above = code - 0x10000
        pair = F.concat(
            unit(F.lit(0xD800) + F.shiftright(above, 10)), unit(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF)))
        )
        return F.when(~token.startswith("\\U"), token).when(code < 0x10000, unit(code)).otherwise(pair)

    as_json = F.concat(F.lit('["'), F.array_join(F.transform(tokens, plain), ""), F.lit('"]'))
    options = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"}
    return F.get(F.from_json(as_json, "array<string>", options), F.lit(0))


def read_ntriples(spark: SparkSession, path: str, *, skip_malformed: bool = False) -> DataFrame:
    """Triples of all lines: ``s, p, o, o_kind, o_datatype, o_lang``.

    A literal without datatype is a string, one with a language tag has the datatype of
    tagged strings. A line that is no statement is an error, unless ``skip_malformed`` asks
    for the rest; :func:`malformed_lines` has the lines that are left out.
    """
    parts = F.regexp_extract_all("value", F.lit(_PART), F.lit(0))
    good = F.col("value").rlike(_LINE)
    if skip_malformed:
        lines = _lines(spark, path).select(F.when(good, parts).alias("_cut")).filter(F.col("_cut").isNotNull())
    else:
        message = F.concat(F.lit("not a statement: "), F.substring("value", 1, 200))
        lines = _lines(spark, path).select(F.when(good, parts).otherwise(F.raise_error(message)).alias("_cut"))
    cut = lines.select(*(F.get("_cut", F.lit(k)).alias(c) for k, c in enumerate("spo")))
    literal = F.col("o").startswith('"')
    quoted = F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1)
    datatype = F.nullif(F.regexp_extract("o", r'"\^\^<([^>]*)>$', 1), F.lit(""))
    tag = F.nullif(F.regexp_extract("o", r'"@([A-Za-z0-9\-]+)$', 1), F.lit(""))
    bare = lambda c: F.regexp_replace(c, r"^<|>$", "")
    kind = F.when(tag.isNotNull(), _LANG_STRING).otherwise(F.coalesce(datatype, F.lit(_XSD_STRING)))
    return cut.select(
        bare("s").alias("s"),
        bare("p").alias("p"),
        F.when(literal, _decoded(quoted)).otherwise(bare("o")).alias("o"),
        F.when(literal, "literal").otherwise("uri").alias("o_kind"),
        F.when(literal, kind).alias("o_datatype"),
        F.when(literal, tag).alias("o_lang"),
    )


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither a statement, a comment nor blank."""
    return _lines(spark, path).filter(~F.col("value").rlike(_LINE))
