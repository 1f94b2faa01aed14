"""Token files: long documents cut into chains of blocks, vocabularies of any size, decoding in several tasks."""

import public_tokenizers
import pytest

from tests.llm.conftest import awkward_rows, rows_of
from tests.llm.test_operators import brute_ids
from vacancia.llm import token_files, tokenizing
from vacancia.llm.common import stored
from vacancia.session import scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("block_ids", [1, 7, 1000])
def test_long_documents_are_cut(spark, block_ids):
    rows = [(r[0], r[1] or "") for r in awkward_rows() if r[0] is not None and r[0] not in (7, 10, 11)]
    docs = spark.createDataFrame([(i, t[:3000] if block_ids < 1000 else t) for i, t in rows], "doc_id long, text string")
    expected = sorted(brute_ids([(r["doc_id"], r["text"]) for r in docs.collect()]), key=repr)
    got = token_files.token_files(docs, WORDS, scratch_path(spark, "t"), block_ids=block_ids)
    assert rows_of(got) == expected


def test_blocks_are_decoded_by_many_tasks(spark):
    docs = spark.createDataFrame([(i, f"some words of number {i} " * 50) for i in range(400)], "doc_id long, text string")
    encodings = token_files.encoded(docs, WORDS, 2, tokenizing.vocabulary_size(WORDS))
    counts = token_files.id_counts(encodings, tokenizing.vocabulary_size(WORDS))
    assert counts.sum() == sum(r[2] for r in brute_ids([(r["doc_id"], r["text"]) for r in docs.collect()])) and counts[2] == 400
    blocks = token_files.write_files(encodings.filter("place IS NOT NULL"), token_files.huffman.code_lengths(counts), scratch_path(spark, "t"), 500)
    index = stored(token_files.with_starts(blocks), "token-index")
    read = token_files.read_documents(index, decode_bytes=1000)
    size = sum(r["length"] for r in blocks.collect())
    assert read.rdd.getNumPartitions() == -(-size // 1000) > 4
    assert rows_of(read) == sorted(brute_ids([(r["doc_id"], r["text"]) for r in docs.collect()]), key=repr)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_vocabulary_is_that_of_the_file(spark, name):
    path = public_tokenizers.path(name)
    docs = spark.createDataFrame([(1, "plain words"), (2, None)], "doc_id long, text string")
    got = rows_of(token_files.token_files(docs, path, scratch_path(spark, "t"), end_id=70_000))
    assert [r[0] for r in got] == [1, 2] and got[1][2] == 1 and tokenizing.vocabulary_size(path) in (50257, 32000)
