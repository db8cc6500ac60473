"""Token files against the tokenizer itself, and round trips through the files."""

import os
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillmesh.llm import queries, token_files
from quillmesh.llm._tokens import default_vocabulary

VOCABULARY = default_vocabulary("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start long, ids string"
ROWS = [(7, "first words", 1, "x"), (None, "no id", 2, "x"), (3, None, 3, "x"), (3, "", 4, "x"), (5, "again", 5, "x"), (5, "again", 6, "x"), (5, "other", 7, "x"),
        (1, "long " * 30_000 + "\x1c odd space <|endoftext|>", 8, "x"), (9, "東京 😀 ñandú", 9, "x"), (-4, " ", 10, "x")]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(tokenizer, text):
    return np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


@pytest.mark.parametrize(("file_bytes", "small"), [(token_files.FILE, token_files.SMALL), (100, 1)])
def test_round_trip(spark, tokenizer, monkeypatch, file_bytes, small):
    monkeypatch.setattr(token_files, "SMALL", small)
    store = token_files.write(spark.createDataFrame(ROWS, SCHEMA).repartition(3), VOCABULARY, file_bytes=file_bytes)
    got = sorted(store.documents(with_ids=True).collect(), key=lambda r: r.start)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(i), ids_of(tokenizer, t)) for i, t, *_ in ROWS)
    assert [r.doc_id for r in got] == [None, -4, 1, 3, 3, 5, 5, 5, 7, 9]
    place = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (place, len(r.ids) // 4, zlib.crc32(r.ids))
        place += r.n_tokens
    if small == 1:
        assert store.files().count() > 1


def test_query_equals_the_tokenizer(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want, place = [], 0
    for r in sorted(docs):
        ids = ids_of(tokenizer, r.text)
        want.append((r.doc_id, place, len(ids) // 4, zlib.crc32(ids)))
        place += len(ids) // 4
    assert sorted(map(tuple, queries.op11_token_files(spark, data).collect())) == want


def test_fetch_reads_single_documents(spark, tokenizer):
    store = token_files.write(spark.createDataFrame(ROWS, SCHEMA), VOCABULARY)
    again = token_files.TokenFiles(spark, store.root)  # from the folder alone
    got = again.fetch(spark.createDataFrame([(9,), (5,), (77,), (None,)], "wanted long"), "wanted").collect()
    whole = {(r.doc_id, r.start): r for r in store.documents(with_ids=True).collect()}
    assert sorted(r.doc_id for r in got) == [5, 5, 5, 9]
    assert all(whole[r.doc_id, r.start] == r for r in got)


def test_nothing(spark):
    store = token_files.write(spark.createDataFrame([], SCHEMA), VOCABULARY)
    assert store.documents().count() == 0 and store.files().count() == 0 and store.fetch(spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_another_dictionary_is_refused(spark):
    store = token_files.write(spark.createDataFrame(ROWS, SCHEMA), VOCABULARY)
    with open(f"{store.root}/dictionary.bin", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="another dictionary"):
        token_files.TokenFiles(spark, store.root).documents().collect()


def test_files_that_no_index_names_do_not_count(spark):
    """What a lost task left behind."""
    store = token_files.write(spark.createDataFrame(ROWS, SCHEMA), VOCABULARY)
    with open(f"{store.root}/files/00000000-lost.bin", "wb") as f:
        f.write(b"half a file")
    assert store.documents().count() == len(ROWS) and len(os.listdir(f"{store.root}/files")) == store.files().count() + 1


def test_large_ids_take_four_bytes(spark, tokenizer):
    store = token_files.write(spark.createDataFrame([(1, "words")], "doc_id long, text string"), VOCABULARY, end_id=1 << 20)
    (r,) = store.documents(with_ids=True).collect()
    assert np.frombuffer(r.ids, "<u4").tolist() == [*tokenizer.encode("words", add_special_tokens=False).ids, 1 << 20]


def test_shared_dictionary_helps_short_documents():
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.5, 60).clip(0, 50_000).astype("<u2").tobytes() for _ in range(4000)]
    dictionary = token_files.train_dictionary(docs[:2000])
    import zstandard

    size = lambda d: sum(len(zstandard.ZstdCompressor(level=3, dict_data=d).compress(x)) for x in docs[2000:])
    assert size(token_files._codec(dictionary)) < size(None)
