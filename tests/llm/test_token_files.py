import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohortscope.llm import common, token_files
from cohortscope.llm.catalog import tokenizer_file
from helpers import no_docs, odd_docs, shipped  # noqa: F401

FILE = tokenizer_file()
ODD = ["", "  \n ", "Σας ΣΑΣ, ÉTÉ. a.b c.,d e. f, it's I'M don't <|endoftext|> x", "<|ENDOFTEXT|>", "é á. ̸. X̸. İst.",
       "ǅ, ﬁne. ½ ²x", "日本語。テスト, ok", "q \u0085  r. s", "a\x00b. c", "'s 'S l'eau. 12,3. 1.", "the the, The."]


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE).encode(text or "", add_special_tokens=False).ids + [token_files.END_ID]


def test_chunks_encode_like_whole_texts():
    encoder = token_files.ChunkEncoder(FILE)
    assert encoder.by_chunk
    for _ in range(2):  # the second time from the store of known chunks
        sizes, ids = encoder.encode(pa.array(ODD))
        assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [whole(t) for t in ODD]


def test_other_tokenizers_get_whole_texts():
    encoder = token_files.ChunkEncoder(tokenizer_file("byte_bpe_50k.json"))
    assert not encoder.by_chunk
    sizes, ids = encoder.encode(pa.array(["Hello  World", ""]))
    want = encoder.tokenizer.encode("Hello  World", add_special_tokens=False).ids + [2, 2]
    assert ids.tolist() == want and sizes.tolist() == [len(want) - 1, 1]


def test_store_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_CHUNKS", 3)
    encoder = token_files.ChunkEncoder(FILE)
    for t in ODD:
        assert encoder.encode(pa.array([t]))[1].tolist() == whole(t)


@pytest.mark.parametrize("order", [None, ["n", "doc_id"]])
def test_files_against_brute_force(spark, order):
    docs = odd_docs(spark)
    path = f"{common.shared_dir(spark)}/tables/test-{order is None}-{id(docs)}"
    tokens = token_files.write_tokens(docs, path, FILE, order=order)
    got = token_files.token_digest(tokens).orderBy("start").collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or ""), r.doc_id, r.text) for r in docs.collect())
    start = 0
    assert len(got) == len(rows)
    for r, (_, doc_id, text) in zip(got, rows):
        ids = whole(text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (
            doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_metadata_reads_leave_the_ids(spark):
    path = f"{common.shared_dir(spark)}/tables/test-meta-{id(spark)}"
    tokens = token_files.write_tokens(odd_docs(spark), path, FILE)
    from cohortscope.plans.guards import physical_plan

    assert "ids" not in physical_plan(token_files.part_starts(tokens))


def test_empty_table(spark):
    path = f"{common.shared_dir(spark)}/tables/test-empty-{id(spark)}"
    assert token_files.token_digest(token_files.write_tokens(no_docs(spark), path, FILE)).collect() == []


def test_a_third_without_an_id_and_a_third_with_one_id(spark):
    """Equal ids stand together, in the order of their texts; starts have no gap."""
    docs = spark.range(900).selectExpr(
        "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN -5 ELSE id END AS doc_id", "concat('word ', id % 40) AS text").repartition(7)
    path = common.run_path(spark, "test-ids")
    got = token_files.token_digest(token_files.write_tokens(docs, path, FILE)).orderBy("start").collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in docs.collect())
    assert [r.doc_id for r in got] == [i if has else None for has, i, _ in want]
    start = 0
    for r, (_, _, text) in zip(got, want):
        ids = whole(text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_cleanup_deletes_the_tables_of_a_run(spark, monkeypatch):
    monkeypatch.setattr(common, "RUN", "test-run-of-cleanup")
    kept = common.stored(spark.range(5), "five")
    assert kept.count() == 5 and common.cleanup(spark, "test-run-of-cleanup")
    assert not common.cleanup(spark, "test-run-of-cleanup")
