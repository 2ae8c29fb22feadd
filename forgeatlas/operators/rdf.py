"""Rows and observations as RDF triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeatlas.schemas import require_columns

# Columns that become statements, in statement order, the number that
# stands for "not counted", and the vocabularies.
ROW_COLUMNS = [
    "projectref",
    "projectpage",
    "repourl",
    "duplicate_flag",
    "null_value_flag",
    "repodomain",
    "unsupported_url_scheme",
    "incomplete_url_flag",
    "base_repo_url",
    "base_repo_url_flag",
    "testfilecountlocal",
    "clone_status",
    "last_commit_hash",
    "explanation",
]
OBSERVATION_VOCABULARY = "http://example.org/myvocab/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"
XSD_INTEGER = "http://www.w3.org/2001/XMLSchema#integer"
MISSING_REFERENCE = "nan"
NOT_COUNTED = {"testfilecountlocal": -1}
# End of fixed values.

# Flags and the count never look like a URI.
_TEXT_COLUMNS = [c for c in ROW_COLUMNS if not c.endswith(("_flag", "_scheme", "local"))]
# Characters that cannot be written inside <...>.
BAD_URI = r'[<>" {}|\\^`]'


def _stated(column: str) -> Column:
    """Whether a column makes a statement: missing values do not, nor does the number that
    stands for "not counted". A text "-1" is a text like any other."""
    value = F.col(column)
    if column in NOT_COUNTED:
        return value.isNotNull() & (value != NOT_COUNTED[column])
    return value.isNotNull()


def _statement(
    subject: Column, predicate: Column, value: Column, kind: Column, datatype: Column
) -> Column:
    return F.struct(
        subject.alias("s"),
        predicate.alias("p"),
        value.alias("o"),
        kind.alias("o_kind"),
        datatype.alias("o_datatype"),
    )


def _uri(subject: Column, predicate: str, value: Column) -> Column:
    return _statement(
        subject, F.lit(predicate), value, F.lit("uri"), F.lit(None).cast("string")
    )


def _accepted() -> Column:
    """No URI of the row holds a character that cannot be written."""
    bad = F.coalesce(F.col("projectref").rlike(BAD_URI), F.lit(False))
    for column in ROW_COLUMNS:
        if column in _TEXT_COLUMNS:
            bad = bad | F.coalesce(F.col(column).rlike(f"(?s)^http.*{BAD_URI}"), F.lit(False))
    return ~bad


def _subject(base: str) -> Column:
    return F.concat(F.lit(base), F.coalesce("projectref", F.lit(MISSING_REFERENCE)))


def _row_statements(base: str) -> list[Column]:
    """The statement of each column; null if there is none and in rejected rows."""
    subject = _subject(base)

    def statement(column: str) -> Column:
        value = F.col(column).cast("string")
        linked = value.startswith("http") if column in _TEXT_COLUMNS else F.lit(False)
        return F.when(
            F.col("accepted") & _stated(column),
            _statement(
                subject,
                F.lit(base + column),
                value,
                F.when(linked, "uri").otherwise("literal"),
                F.when(~linked, XSD_STRING),
            ),
        )

    return [statement(column) for column in ROW_COLUMNS]


def _with_accepted(df: DataFrame) -> DataFrame:
    require_columns(df, ROW_COLUMNS)
    return df.select("row_id", *ROW_COLUMNS, _accepted().alias("accepted"))


def row_triples(df: DataFrame, base: str) -> DataFrame:
    """``(row_id, s, p, o, o_kind, o_datatype)``; rows with a bad URI are skipped.

    Skipping happens after the array is taken apart. A condition on the row
    would be pushed below the projections and evaluate all of them twice.
    """
    statements = F.array(*_row_statements(base))
    opened = _with_accepted(df).select("row_id", F.inline(statements))
    return opened.filter(F.col("p").isNotNull())


def rejected_rows(df: DataFrame) -> DataFrame:
    """Rows that :func:`row_triples` skips."""
    return _with_accepted(df).filter(~F.col("accepted")).select("row_id")


def observation_triples(df: DataFrame, repo_uri: str) -> DataFrame:
    """Four statements per observation (CommitHash, MethodUsed, TestFileCount)."""
    word = OBSERVATION_VOCABULARY
    subject = F.concat(F.lit(repo_uri), "CommitHash", F.lit("/"), "MethodUsed")
    four = F.array(
        _uri(subject, RDF_TYPE, F.lit(word + "Observation")),
        _uri(subject, word + "commit", F.concat(F.lit(repo_uri + "commit/"), "CommitHash")),
        _uri(subject, word + "methodUsed", F.concat(F.lit(word), "MethodUsed")),
        _statement(
            subject,
            F.lit(word + "testFileCount"),
            F.col("TestFileCount").cast("string"),
            F.lit("literal"),
            F.lit(XSD_INTEGER),
        ),
    )
    return df.select(F.inline(four))


def as_graph(triples: DataFrame) -> DataFrame:
    """H4: set semantics. Repeats are dropped on the map side first."""
    return triples.select("s", "p", "o", "o_kind", "o_datatype").distinct()


def statement_count(triples: DataFrame) -> DataFrame:
    """E16."""
    return as_graph(triples).agg(F.count("*").alias("statements"))


def _escaped(text: Column) -> Column:
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _line(subject: Column, predicate: Column, node: Column) -> Column:
    return F.concat(F.lit("<"), subject, F.lit("> <"), predicate, F.lit("> "), node, F.lit(" ."))


def _uri_node(value: Column) -> Column:
    return F.concat(F.lit("<"), value, F.lit(">"))


def _text_node(value: Column) -> Column:
    return F.concat(F.lit('"'), _escaped(value), F.lit('"'))


def ntriples(triples: DataFrame) -> DataFrame:
    """One N-Triples line per statement (also valid Turtle)."""
    typed = F.concat(_text_node(F.col("o")), F.lit("^^"), _uri_node(F.col("o_datatype")))
    node = (
        F.when(F.col("o_kind") == "uri", _uri_node(F.col("o")))
        .when(F.col("o_datatype") == XSD_STRING, _text_node(F.col("o")))
        .otherwise(F.coalesce(typed, _text_node(F.col("o"))))
    )
    return triples.select(_line(F.col("s"), F.col("p"), node).alias("value"))


def turtle_documents(df: DataFrame, base: str) -> DataFrame:
    """One Turtle document per row over many lines: a prefix for the predicates, then the
    statements of the row under one subject, texts in long quotes.

    The document is built inside the row, so no grouping is needed.
    """

    def pair(column: str) -> Column:
        value = F.col(column).cast("string")
        safe = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        # Carriage returns are written as escapes: readers may change them at line ends.
        node = F.concat(F.lit('"""'), F.replace(safe, F.lit("\r"), F.lit("\\r")), F.lit('"""'))
        if column in _TEXT_COLUMNS:
            node = F.when(value.startswith("http"), _uri_node(value)).otherwise(node)
        return F.when(_stated(column), F.concat(F.lit(f"  p:{column}\n    "), node))

    rows = _with_accepted(df).withColumn("subject", _subject(base))
    head = F.concat(F.lit(f"@prefix p:\n  <{base}> .\n<"), "subject", F.lit(">\n"))
    body = F.concat_ws(" ;\n", *map(pair, ROW_COLUMNS))
    text = F.when(body != "", F.concat(head, body, F.lit("\n  .")))
    opened = rows.select("row_id", F.explode(F.array(F.when(F.col("accepted"), text))).alias("value"))
    return opened.filter(F.col("value").isNotNull())


def row_documents(df: DataFrame, base: str) -> DataFrame:
    """One document per row, its statements on one line each, then an empty line.

    The document is built inside the row, so no grouping is needed.
    """

    def line(column: str) -> Column:
        value = F.col(column).cast("string")
        node = _text_node(value)
        if column in _TEXT_COLUMNS:
            node = F.when(value.startswith("http"), _uri_node(value)).otherwise(node)
        else:
            node = F.concat(F.lit('"'), value, F.lit('"'))
        return F.when(_stated(column), _line(F.col("subject"), F.lit(base + column), node))

    rows = _with_accepted(df).withColumn("subject", _subject(base))
    text = F.concat(F.concat_ws("\n", *map(line, ROW_COLUMNS)), F.lit("\n"))
    opened = rows.select(
        "row_id", F.explode(F.array(F.when(F.col("accepted"), text))).alias("value")
    )
    return opened.filter(F.col("value").isNotNull())
