"""The registered corpus queries on a small set of the given tables, and the pipeline by stages."""

import zlib

import duckdb
import numpy as np
import pytest
from brute import exact, joined, near, personal, secrets, sha, vectors
from tests.conftest import SF_DIR

import __spark_entry__ as entry_points
import corpus_pipeline
from parley.llm import minhash, mixing, packing, toxicity
from parley.llm.common import read_table, stash
from parley.llm.oracle import ORACLE
from parley.llm.queries import QUERIES

TABLES = "documents embeddings pages conversations labels".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


def test_all_queries_are_registered():
    names = entry_points.queries()
    assert sorted(QUERIES) == sorted(n for n in names if n.startswith("op"))
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert "pipeline" in names and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == want


def test_secrets(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op3_secret_scan"](spark, SF_DIR).collect()}
    for doc_id, text in texts:
        base = secrets(text or "")
        row = got[doc_id]
        assert row.base_sha256 == sha(joined(base))
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(
            sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")
        )
        assert set(joined(base).split(",")) <= set(row.spans.split(","))


def test_mixing(spark):
    rows = QUERIES["op4_mixing"](spark, SF_DIR).collect()
    low, high = (sum(r.tokens * r[p] * r.rate for r in rows) for p in ("p_low", "p_high"))
    assert abs(low / (low + high) - mixing.TARGETS["0"]) < 0.005


def test_near_duplicates(spark, texts):
    got = QUERIES["op5_minhash_dedup"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == near(texts, 3, 85)


def test_personal_data(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op6_pii"](spark, SF_DIR).collect()}
    for doc_id, text in texts:
        base = personal(text or "")
        assert got[doc_id].base_sha256 == sha(joined(base))
        assert got[doc_id].n_email == sum(k == "email" for k, _, _ in base)
        assert set(joined(base).split(",")) <= set(got[doc_id].spans.split(","))


def held_to_tokens(rows, texts):
    """Every id of every text lies in one piece, and sequences have no gaps."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {i for i, _ in texts}
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            part = np.asarray(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(part), len(ids))
            at += r.length
        assert at == len(ids)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= packing.WINDOW
    return 1 - sum(filled.values()) / (packing.WINDOW * len(filled))


def test_packing(spark, texts):
    assert held_to_tokens(QUERIES["op7_packing"](spark, SF_DIR).collect(), texts) < 0.05


def test_vectors(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    got = QUERIES["op8_embedding_dedup"](spark, SF_DIR).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == vectors(rows, 0.98)


def test_toxicity_on_held_out_rows(spark):
    """At a larger set, as a fold of this one holds only a few toxic texts."""
    folder = SF_DIR.replace("sf0.001", "sf0.1")
    scores = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, folder).collect()}
    pairs = [
        (scores[i], toxic)
        for i, toxic in duckdb.sql(
            f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'"
        ).fetchall()
        if scores[i].held_out
    ]
    hits = sum(r.predicted for r, toxic in pairs if toxic)
    assert hits >= 0.85 * sum(toxic for _, toxic in pairs)
    assert sum(r.predicted for r, toxic in pairs if not toxic) <= 0.03 * len(pairs)


def test_stages_of_the_pipeline(spark, texts):
    """Each stage against a plain form, on what the stage before it kept."""
    rows = read_table(spark, SF_DIR, "documents")
    columns, labels = rows.columns, read_table(spark, SF_DIR, "labels")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "MinHash near-dedup", "mixing", "packing"]

    def of(frame):
        return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}

    model = toxicity.learn(rows, labels)
    before = of(rows)
    scores = model.scores(toxicity.features([t or "" for t in before.values()], model.landmarks))
    rows = stash(stages["toxicity"](spark, rows, SF_DIR), "one")
    assert set(of(rows)) == {
        i for i, s in zip(before, scores, strict=True) if s < toxicity.THRESHOLD
    }
    before = of(rows)
    rows = stash(stages["exact dedup"](spark, rows, SF_DIR), "two")
    assert set(of(rows)) == {i for i, r in exact(before.items()).items() if r[2]}
    before = of(rows)
    rows = stash(stages["MinHash near-dedup"](spark, rows, SF_DIR), "three")
    want = near(before.items(), minhash.SHINGLE_WORDS, minhash.PERCENT)
    assert set(of(rows)) == {i for i, r in want.items() if r[2]}
    rates = {r.doc_id: r.copies for r in mixing.mixing_rates(rows, labels).collect()}
    rows = stash(stages["mixing"](spark, rows, SF_DIR), "four")
    assert rows.columns == columns
    assert set(of(rows)) == {i for i, n in rates.items() if n}
    packed = stages["packing"](spark, rows, SF_DIR).collect()
    held_to_tokens(packed, list(of(rows).items()))
