"""The Turtle scan: chunks and splits of any size give the statements of the whole text."""

import random

import pytest

from forgeatlas.sources import turtle
from forgeatlas.sources.ntriples import read_ntriples

CARD = '''
# A description of somebody, in the way such files are written.
@prefix f:   <http://people.example/terms/> .
@prefix :    <http://contact.example/#>.
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@base <http://site.example/card> .

   <> a f:Document ;   # this document
      f:title "Someone's \\"file\\"" , 'another; title'@en-GB ;
      f:about <#me> .

<#me> f:knows [ a f:Person; f:name "B. C." ; f:mail <mailto:b@site.example>, <mailto:c@site.example> ] ,
        [] , _:d.1 ;
   f:note """first line; with a . stop
second "quoted" line, and an end\\u00e9""" ;
   f:age 42 , -1.5, 2.0e3 , true ;
   f:list ( 1 "two" ( :three ) ) , () ;
   f:seen "2020-01-01"^^xsd:date ;;
   .
PREFIX q: <http://q.example/>
BASE <http://other.example/>
q:a.b q:c <x> . [ q:p q:o ] . ( 1 ) q:p \'\'\'long ' '' one\'\'\' .
@prefix q: <http://q2.example/> . _:d.1 q:c q:x\\-y , q:z%20 .
'''


def wanted():
    """Read as one piece of text, statement by statement."""
    reader = turtle.Reader(turtle.Context())
    mark = "."
    for k, (before, text) in enumerate(turtle.cut(CARD, turtle.PLAIN, 0)):
        mark = before or "."
        if text.strip():
            reader.read(mark, text, f"w{k}")
    return reader.triples


def plain_nodes(triples):
    """Statements with nameless nodes told by what is said of them."""
    out = {}
    for s, p, o, *rest in triples:
        out.setdefault(s, []).append((p, o, *rest))

    def shown(term, seen=()):
        if not term.startswith("_:") or term == "_:d.1":
            return term
        if term in seen:
            return "loop"
        return str(sorted((p, shown(o, (*seen, term)), *map(str, r)) for p, o, *r in out.get(term, [])))

    return sorted((shown(s), p, shown(o), str(r)) for s, p, o, *r in triples)


def test_reading_of_one_text():
    got = wanted()
    t, c = "http://people.example/terms/", "http://site.example/card"
    assert (c, turtle.RDF + "type", t + "Document", "uri", None, None) in got
    assert (c, t + "title", "another; title", "literal", turtle.RDF + "langString", "en-GB") in got
    assert (c, t + "title", 'Someone\'s "file"', "literal", turtle.XSD + "string", None) in got
    assert (c + "#me", t + "note", 'first line; with a . stop\nsecond "quoted" line, and an end\u00e9',
            "literal", turtle.XSD + "string", None) in got
    assert {o: d for s, p, o, k, d, _ in got if p == t + "age"} == {
        "42": turtle.XSD + "integer", "-1.5": turtle.XSD + "decimal", "2.0e3": turtle.XSD + "double", "true": turtle.XSD + "boolean"}
    assert (c + "#me", t + "seen", "2020-01-01", "literal", turtle.XSD + "date", None) in got
    assert (c + "#me", t + "list", turtle.RDF + "nil", "uri", None, None) in got
    assert ("http://q.example/a.b", "http://q.example/c", "http://other.example/x", "uri", None, None) in got
    assert ("_:d.1", "http://q2.example/c", "http://q2.example/x-y", "uri", None, None) in got
    assert len(got) == 34
    assert len({s for s, *_ in got if s.startswith("_:")} - {"_:d.1"}) == 7


@pytest.mark.parametrize("chunk_chars", [1, 60, 400, 1 << 20])
def test_chunks_of_any_size(spark, tmp_path, chunk_chars):
    for k in range(3):
        (tmp_path / f"card{k}.ttl").write_text(CARD)
    (tmp_path / "empty.ttl").write_text("")
    (tmp_path / "words.ttl").write_text("# no statement at all\n\n")
    rows = [tuple(r) for r in turtle.read_turtle(spark, str(tmp_path), chunk_chars=chunk_chars).collect()]
    names = {s for s, *_ in rows if s.startswith("_:")} - {"_:d.1"}
    assert len(names) == 3 * 7  # nameless nodes of equal files are not mixed up
    assert plain_nodes(rows) == sorted(3 * plain_nodes(wanted()))


def test_splits_of_a_file(spark, tmp_path):
    rng = random.Random(1)
    lines, expected = ["@prefix p: <http://p.example/> ."], set()
    for k in range(400):
        many = rng.randrange(1, 4)
        lines.append(f"p:s{k}")
        for n in range(many):
            text = f"line {n}\n. ; , [ ( # \" '' end {k}" if rng.random() < 0.4 else f"t{n}"
            lines.append(f'  p:q{n} """{text}""" ,\n    p:o{n} {";" if n + 1 < many else "."}')
            expected |= {(f"http://p.example/s{k}", f"http://p.example/q{n}", o) for o in (text, f"http://p.example/o{n}")}
        if k % 50 == 20:
            lines.append(f"@prefix p: <http://p.example/> .  # again {k}")
    (tmp_path / "big.ttl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(tmp_path / "big.ttl")).rdd.getNumPartitions() > 30
        found = turtle.read_turtle(spark, str(tmp_path / "big.ttl"), chunk_chars=300)
        assert {tuple(r)[:3] for r in found.collect()} == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)


def test_lines_of_statements_read_alike(spark, tmp_path):
    lines = ['<http://a> <http://b> "x\\ty \\u00e9 \\\\u0041"@en .', "_:n <http://b> <http://c> . # end",
             '<http://a> <http://b> "1"^^<http://t> .', '<http://a> <http://b> "" .']
    (tmp_path / "a.nt").write_text("\n".join(lines))
    one = read_ntriples(spark, str(tmp_path)).collect()
    two = turtle.read_turtle(spark, str(tmp_path)).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))


@pytest.mark.parametrize("text", [
    "<http://a> <http://b>", "<http://a> <http://b> <http://c> . ]", "x:a <http://b> 1 .", "<http://a> 'b' 1 .",
    "; <http://b> 1 .", '<http://a> <http://b> """never closed', "<http://a> <http://b> ( 1 .", "<http://a> <http://b> 1 2 .",
])
def test_what_is_not_turtle_is_an_error(spark, tmp_path, text):
    (tmp_path / "bad.ttl").write_text("<http://x> <http://y> 1 .\n" + text + "\n")
    with pytest.raises(Exception, match="Turtle|statement|bracket"):
        turtle.read_turtle(spark, str(tmp_path), chunk_chars=20).collect()
