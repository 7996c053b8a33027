import json
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hushframe.llm import token_ids
from hushframe.llm.common import new_path
from hushframe.llm.tokenization import ChunkEncoder

ODD = ["", " ", "a  b", "a\n\nb", " lead", "trail \n", "it's don't", "\x1c x\x85y\xa0z", "naïve é́ ß İ Σς", "日本 語", "\0a b", "x" * 5000, "12 345,67!!\t\tq", "<|endoftext|> a", "a  b ​ c"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_equal_whole_texts(name):
    enc, ref = ChunkEncoder(P.path(name), limit=50), Tokenizer.from_file(P.path(name))
    ref.encode_special_tokens = True
    assert enc.kind == name.split("_")[0]

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,a1é\x85\x1c\xa0　́\0"), st.characters(exclude_categories=["Cs"])), max_size=40))
    def check(text):
        got = np.frombuffer(enc.encode([text])[0], dtype=f"<u{enc.width}")
        assert list(got) == ref.encode(text, add_special_tokens=False).ids

    check()
    for t in ODD:
        assert list(np.frombuffer(enc.encode([t])[0], dtype=f"<u{enc.width}")) == ref.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=60))
def test_values_round_trip(values):
    v = np.array(values, dtype=np.uint32)
    assert (token_ids.decode_values(*token_ids.encode_values(v), len(v)) == v).all()


def test_files_round_trip(spark):
    rows = [(i * 3 % 17, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no id"), (5, "tie"), (5, "tie")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as ids")
    path, at = new_path(spark, "t"), P.path("byte_bpe_50k.json")
    token_ids.write_ids(docs, path, at, block_ids=40)
    ref = Tokenizer.from_file(at)
    ref.encode_special_tokens = True
    want = sorted((-1 if d is None else d, tuple(ref.encode(t or "", add_special_tokens=False).ids) + (2,)) for d, t in rows)
    got = token_ids.read_ids(spark, path).orderBy("part", "row").collect()
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == [w[0] for w in want]
    assert sorted((-1 if r.doc_id is None else r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    dig = sorted(token_ids.digest_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in dig] == [0, *np.cumsum([r.n_tokens for r in dig])[:-1].tolist()]
    by = {(r.doc_id, r.ids_crc32) for r in dig}
    assert by == {(None if d < 0 else d, zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want}


def test_empty_table(spark):
    path = new_path(spark, "t")
    token_ids.write_ids(spark.createDataFrame([], "doc_id long, text string"), path, P.path("byte_bpe_50k.json"))
    assert token_ids.digest_ids(spark, path).count() == 0 and token_ids.read_ids(spark, path).count() == 0


def test_common_ids_take_one_byte(spark):
    docs = spark.createDataFrame([(i, "the of and " * 50) for i in range(8)], "doc_id long, text string")
    path = new_path(spark, "t")
    token_ids.write_ids(docs, path, P.path("byte_bpe_50k.json"))
    for r in spark.read.parquet(f"{path}/blocks").collect():
        assert len(r.data) == sum(r.lengths) and len(r.control) == -(-sum(r.lengths) // 4)


LITERAL = ["ab <|endoftext|> cd", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|startoftext|> É a", "<|ENDOFTEXT|> <|endoftext", *ODD]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_literals_of_added_tokens_equal_the_library(name):
    enc, ref = ChunkEncoder(P.path(name), limit=50, added=True), Tokenizer.from_file(P.path(name))
    assert enc.kind == name.split("_")[0]
    for t, got in zip(LITERAL, enc.encode(LITERAL), strict=True):
        assert list(np.frombuffer(got, dtype=f"<u{enc.width}")) == ref.encode(t, add_special_tokens=False).ids


def test_queries_keep_the_library_defaults(spark, tmp_path):
    from hushframe.llm import packing

    docs = list(enumerate(LITERAL))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ref = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: np.array([*ref.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in docs}
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_ids.op2_token_ids(spark, str(tmp_path)).collect()}
    start = np.cumsum([0, *map(len, ids.values())]).tolist()
    assert got == {d: (start[d], len(i), zlib.crc32(i.tobytes())) for d, i in ids.items()}
    ref = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r.doc_tokens for r in packing.op7_packing(spark, str(tmp_path)).collect()}
    assert got == {d: len(ref.encode(t, add_special_tokens=False).ids) + 1 for d, t in docs}
