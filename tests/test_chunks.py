"""Files in chunks: the same bytes, lines and matches as whole files."""

import random

from pyspark.sql import functions as F

from forgeatlas.sources.tree import chunk_facts, list_tree, read_chunks, read_contents


def test_chunks_of_any_size_are_the_file(spark, tmp_path):
    rng = random.Random(1)
    texts = {
        "a.txt": "".join("x" * rng.randrange(30) + "\n" for _ in range(300)),
        "b.txt": "one line without an end " * 40, "c.txt": "", "d.txt": "\n\n\nimport os", "e.bin": "é\n" * 100,
    }
    (tmp_path / "h" / "r").mkdir(parents=True)
    for name, text in texts.items():
        (tmp_path / "h" / "r" / name).write_bytes(text.encode())
    listing = list_tree(spark, str(tmp_path))
    for size in (7, 64, 1000, 1 << 20):
        chunks = read_chunks(listing, str(tmp_path), chunk_bytes=size)
        rows = chunks.collect()
        assert all(0 < len(r["data"]) <= size for r in rows)
        # A cut inside a line means that the line is longer than a chunk.
        assert all(r["data"].endswith(b"\n") or b"\n" not in r["data"] or r["offset"] + len(r["data"]) == len(texts[r["rel_path"]].encode()) for r in rows)
        for name, text in texts.items():
            mine = sorted((r["offset"], bytes(r["data"])) for r in rows if r["rel_path"] == name)
            assert b"".join(d for _, d in mine) == text.encode()
    facts = {r["file_path"]: r for r in chunk_facts(read_chunks(listing, str(tmp_path), chunk_bytes=64), {"imports": "^import"}).collect()}
    for name, text in texts.items():
        if text:
            row = facts[f"h/r/{name}"]
            assert (row["size"], row["lines"], row["imports"]) == (len(text.encode()), len(text.splitlines()), name == "d.txt")
    assert "h/r/c.txt" not in facts


def test_a_file_that_is_too_long_for_a_value_says_so(spark, tmp_path):
    (tmp_path / "h" / "r").mkdir(parents=True)
    (tmp_path / "h" / "r" / "long").write_text("x" * 100)
    (tmp_path / "h" / "r" / "fits").write_text("y" * 99)
    listing = list_tree(spark, str(tmp_path))
    rows = {r["name"]: r for r in read_contents(listing, str(tmp_path), max_bytes=99).collect()}
    assert rows["fits"]["content"] == "y" * 99
    assert rows["long"]["content"] is None and rows["long"]["read_error"].startswith("OverflowError")
    gone = listing.withColumn("rel_path", F.concat("rel_path", F.lit("x")))
    assert {r["read_error"][:17] for r in read_chunks(gone, str(tmp_path)).collect()} == {"FileNotFoundError"}
    assert chunk_facts(read_chunks(gone, str(tmp_path))).count() == 0
