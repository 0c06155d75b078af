"""The registered queries against plain versions, over a whole small table."""

import struct
import zlib
from collections import defaultdict

import brute
import pytest

from pulsegrid.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_token_counts(spark, rows):
    ids = brute.encode([t for _, t in rows])
    expected = sorted(((i, len((t or "").encode()), len(x), len(x) > 2048) for (i, t), x in zip(rows, ids, strict=True)), key=repr)
    assert got(queries.op1_token_counts(spark, DIR), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected


def test_exact_dedup(spark, rows):
    assert got(queries.op3_exact_dedup(spark, DIR), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact(rows)


def test_decontamination(spark, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    found = got(queries.op4_decontamination(spark, DIR), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == brute.contamination(rows, items)
    assert any(r[5] for r in found)


def test_curve_packing(spark, rows):
    ids = dict(zip([i for i, _ in rows], brute.encode([t for _, t in rows]), strict=True))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op5_curve_packing(spark, DIR).collect():
        whole = ids[r.doc_id] + [2]
        assert r.doc_tokens == len(whole)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *whole[r.start : r.start + r.length]))
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == len(ids[i]) + 1
    assert pieces.keys() == ids.keys()
    totals = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        totals.append(at)
    assert max(totals) <= 4096 and sum(t < 4096 for t in totals) <= 1


def test_secret_scan(spark, rows):
    assert got(queries.op6_secret_scan(spark, DIR), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == brute.secrets(rows)


def test_simhash(spark, rows):
    assert got(queries.op7_simhash(spark, DIR), "doc_id", "fingerprint", "component_id") == brute.simhash(rows)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    found = queries.op8_toxicity(spark, d).select("doc_id", "held_out", "score", "predicted").collect()
    assert len(found) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    y = [(r.score, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    ones, zeros = [s for s, t in y if t], [s for s, t in y if not t]
    auc = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / len(ones) / len(zeros)
    accuracy = sum((s >= 0.5) == bool(t) for s, t in y) / len(y)
    print("auc", auc, "accuracy", accuracy, len(y))
    assert auc > 0.85 and accuracy > 0.9


def test_lm_scoring(spark, rows):
    expected = brute.base_scores(rows)
    for r in queries.op9_lm_scoring(spark, DIR).collect():
        held, n, known, total, base = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_bfd_packing(spark, rows):
    ids = dict(zip([i for i, _ in rows], brute.encode([t for _, t in rows]), strict=True))
    rebuilt, fill, n = defaultdict(dict), 0, 0
    for r in queries.op10_bfd_packing(spark, DIR).collect():
        row, spots = struct.unpack("<4096H", r.input_ids), struct.unpack("<4096H", r.position_ids)
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            a, b = r.cu_seqlens[k : k + 2]
            assert spots[a:b] == tuple(range(b - a))
            rebuilt[doc][start] = row[a:b]
        fill, n = fill + r.n_tokens, n + 1
    for doc, parts in rebuilt.items():
        assert sum((parts[s] for s in sorted(parts)), ()) == (*ids[doc], 2)
    assert rebuilt.keys() == ids.keys() and fill / n / 4096 > 0.8


def test_warc_derivatives(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet").count()
    found = queries.op2_warc_derivatives(spark, DIR).collect()
    assert len(found) == 2 * pages
    assert all(r.refers_to.startswith("<urn:uuid:") and "<p>" not in r.block and r.block_digest.startswith("sha1:") for r in found)
