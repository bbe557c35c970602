import random
from collections import defaultdict

from pyspark.sql import functions as F

from strandline.llm import chunk_dedup
from strandline.llm.chunk_dedup import chunk_ends
from tests.llm.samples import SCHEMA, awkward, frame


def pieces(data):
    ends = chunk_ends(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def brute(rows, min_run):
    """Chunks compared as bytes, documents in order of id."""
    where = defaultdict(list)
    for doc_id, text, *_ in rows:
        for k, c in enumerate(pieces((text or "").encode())):
            where[c].append((doc_id, k))
    out = []
    for doc_id, text, *_ in rows:
        kept, removed, spans, run, repeated, again = [], 0, 0, [], 0, 0
        for k, c in enumerate([*pieces((text or "").encode()), None]):
            gone = c is not None and (min(where[c])[0] != doc_id or (doc_id, k) != min(w for w in where[c] if w[0] == doc_id))
            if gone:
                run.append(c)
            else:
                n = sum(map(len, run))
                if n >= min_run:
                    removed, spans = removed + n, spans + 1
                else:
                    kept += run
                run = []
                kept += [c] if c is not None else []
            if c is not None and len(where[c]) > 1:
                again += len(c)
            else:
                repeated, again = repeated + (again if again >= min_run else 0), 0
        out.append((doc_id, b"".join(kept).decode(), len((text or "").encode()), len(pieces((text or "").encode())), repeated, removed, spans))
    return sorted(out)


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert sorted(map(tuple, chunk_dedup.deduplicated(docs).collect())) == brute(rows, chunk_dedup.MIN_RUN)


def test_awkward_rows(spark):
    for run in (1, 60):
        assert sorted(map(tuple, chunk_dedup.deduplicated(frame(spark), min_run=run).collect())) == brute(awkward(), run)


def test_chunks_resist_insertions():
    rng = random.Random(1)
    data = "".join(rng.choice("abcdefgh é") for _ in range(20000)).encode()
    shifted = data[:5000] + b"inserted" + data[5000:]
    before, after = pieces(data), pieces(shifted)
    assert b"".join(before) == data and b"".join(after) == shifted
    assert all(len(c) <= chunk_dedup.MAX_CHUNK + 3 for c in before) and len(set(before) - set(after)) < 12
    assert all(c.decode() is not None for c in before)


def test_null_and_equal_ids_and_empty(spark):
    text = " ".join(f"word{k}" for k in range(100))
    rows = [(None, text, None, None, 0), (4, text, None, None, 0), (4, text, None, None, 0), (4, "x " + text, None, None, 0), (2, "y", None, None, 0)]
    got = {(r.doc_id, r.n_bytes): r for r in chunk_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    n = len(text)
    assert got[None, n].n_removed == 0 and got[4, n].n_removed == n and got[4, n].text == "" and got[2, 1].text == "y"
    alone = chunk_dedup.deduplicated(spark.createDataFrame(rows[1:3], SCHEMA)).collect()
    assert sorted(r.n_removed for r in alone) == [0, n]  # equal ids are two documents, one keeps the text
    assert chunk_dedup.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_ids_share_no_identity(spark, tmp_path):
    """Three equal rows without id and one that shares nothing, from rows and
    from files, beside columns with the names of working columns."""
    rng = random.Random(6)
    one, other = (" ".join(rng.choice("abcdefgh") * 5 + str(rng.random()) for _ in range(30)) for _ in range(2))
    rows = [(None, one, "n", "l", 0)] * 3 + [(None, other, None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"lang": "__row", "source": "__data"})
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    for table in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        found = chunk_dedup.deduplicated(table).collect()
        assert sorted(r.n_removed for r in found) == [0, 0, len(one), len(one)]
        assert [r.text for r in found if r.n_bytes == len(other) and r.n_repeated == 0] == [other]


def test_text_of_megabytes(spark):
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefghij ", k=3_000_000))
    rows = [(1, text, None, None, 0), (2, "head " + text, None, None, 0)]
    found = {r.doc_id: r for r in chunk_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1].n_removed == 0 and found[1].text == text
    assert len(text) - 1000 < found[2].n_removed <= len(text)
