"""The whole pipeline over a whole table, against a plain version of every stage."""

import hashlib
import re

import duckdb
import numpy as np
from test_rules_secrets import plain_random_spans
from tokenizers import Tokenizer

import corpus_pipeline
from forgeatlas.llm import op1_bpe, op3_secrets, op4_simhash, op10_decontaminate

FOLDER = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def one_of_each_class(rows):
    """All pairs of fingerprints; the smallest key of each connected class."""
    prints = {key: op4_simhash.fingerprint(text) for key, text in rows}
    left, kept = set(prints), set()
    while left:
        todo, group = [min(left)], set()
        left.remove(todo[0])
        while todo:
            at = todo.pop()
            group.add(at)
            near = {k for k in left if (prints[k] ^ prints[at]).bit_count() <= 4}
            left -= near
            todo += near
        kept.add(min(group))
    return [(k, t) for k, t in rows if k in kept]


def without_items(rows, items):
    """Every text against every item, without pieces: Myers' distance over the whole text."""
    wanted = [op10_decontaminate.normalise(t) for t in items]
    patterns = [(op10_decontaminate.Pattern(t), op10_decontaminate.budget(len(t))) for t in wanted if len(t) >= 20]
    assert len(patterns) == len([t for t in wanted if t])
    return [
        (k, t) for k, t in rows
        if not any(p.best(op10_decontaminate.normalise(t))[0] <= errors for p, errors in patterns)
    ]


def masked(rows):
    added = plain_random_spans(rows)
    out = []
    for key, text in rows:
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]{14,}", text)]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]
        spans += [(a, 3, b) for a, b in added[key]]
        clean, reach = "", 0
        for start, _, stop in sorted(spans):
            if start >= reach:
                clean += text[reach:start] + op3_secrets.MASK
            reach = max(reach, stop)
        out.append((key, clean + text[reach:]))
    return out


def test_run_is_a_plain_version_of_its_stages(spark):
    docs = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet' order by 1").fetchall()
    items = [t for (t,) in duckdb.sql(f"select text from '{FOLDER}/benchmark.parquet'").fetchall()]
    # Every text of this table that has a letter is in a learned language.
    rows = [(k, t) for k, t in docs if t and any(c.isalpha() for c in t)]
    rows = one_of_each_class(rows)
    assert len(rows) < len(docs)
    rows = masked(without_items(rows, items))
    library = Tokenizer.from_file(op1_bpe.tokenizer_path())
    wanted = {}
    for key, text in rows:
        ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
        wanted[key] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert len(found) == len(wanted) and any(op3_secrets.MASK in t for _, t in rows)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found} == wanted
