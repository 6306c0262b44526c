"""Token files: an exact round trip, with documents over block and file ends."""
import numpy as np

from logweir.llm import token_files

from conftest import SF_DIR


def test_counts_equal_the_encoder(spark, documents, odd_rows):
    encoder = token_files._encoder(token_files.TOKENIZER)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = sorted(map(tuple, token_files.token_counts(docs, block_tokens=500).collect()))
    assert found == sorted((r.doc_id, len(encoder.encode_ordinary(r.text))) for r in docs.collect())
    odd = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in token_files.token_counts(documents(odd_rows)).collect())
    assert odd == sorted((-1 if i is None else i, len(encoder.encode_ordinary(t or ""))) for i, t in odd_rows)
    assert token_files.token_counts(documents([])).count() == 0


def test_streams_cut_anywhere(spark, tmp_path):
    rng = np.random.default_rng(0)
    lengths = rng.integers(0, 40, 60).tolist()
    ids = np.concatenate([np.append(rng.integers(0, 9, n), 50256) for n in lengths] + [np.array([3, 3, 3])]).astype("<u2")
    folder = tmp_path / "stream"
    folder.mkdir()
    for k, piece in enumerate(np.split(ids, [100, 101, 400, 700])):
        (folder / f"part-{k}").write_bytes(piece.tobytes())
    (folder / "part-9").write_bytes(b"")
    rows = sorted((r.place, r.n_tokens) for r in token_files.scan_token_files(spark, f"file://{folder}", block_tokens=7).collect())
    assert rows == list(enumerate([*lengths, 3]))


def test_tokens_are_written_without_a_shuffle_in_files_of_any_size(spark, documents, tmp_path):
    encoder = token_files._encoder(token_files.TOKENIZER)
    rows = [(None if k % 50 == 7 else k, None if k % 60 == 9 else f"text {k} " * (k % 40)) for k in range(3000)]
    docs = documents(rows).repartition(3)
    want = sorted((-1 if i is None else i, len(encoder.encode_ordinary(t or ""))) for i, t in rows)
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in token_files.token_counts(docs, file_bytes=60).collect())
    assert found == want
    folder = f"file://{tmp_path}/files"
    places = token_files.write_token_files(docs, folder, file_bytes=20_000)
    assert "Exchange" not in places._jdf.queryExecution().executedPlan().toString()
    assert places.count() == len(rows) and places.select("shard", "place").distinct().count() == len(rows)
    assert len(list((tmp_path / "files" / "part=tokens").glob("part-*"))) > 3
