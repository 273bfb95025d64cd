import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from waymark.llm import planes, tokens
from waymark.llm.queries import QUERIES

ODD = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "a\n\nb", "\t \t b", "<|endoftext|>", "x <|endoftext|> y", "a<|endoftext|>b", "<|startoftext|> Hi", "it's 's  's", "Ünïcode é ́x", "中文 字", "a\x1cb \x1c c", "a b", "a  b", "a\x0b\x0cb", "1 22 333", "ΣΑΣ ΑΣ", "İ i̇", "﻿x", "don't  stop"]


def odd_texts():
    rng = random.Random(2)
    return ODD + ["".join(rng.choices([*ODD, "word", " ", "\n", "é"], k=rng.randint(1, 12))) for _ in range(300)]


@pytest.fixture(scope="module")
def byte_level():
    return tokens.load(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_level():
    return tokens.load(public_tokenizers.path("word_bpe_49k.json"))


def test_cuts_keep_counts_and_ids(byte_level, word_level):
    counts, ids = tokens.Pieces(byte_level, len), tokens.Pieces(word_level, tokens.id_bytes)
    texts = odd_texts()
    got_counts = map(sum, counts.of(map(tokens.byte_level_pieces, texts)))
    got_ids = tokens.word_ids(ids, [t.encode() for t in texts])
    for text, n, found in zip(texts, got_counts, got_ids, strict=True):
        assert n == len(byte_level.encode(text, add_special_tokens=False)), repr(text)
        assert found.tolist() == word_level.encode(text, add_special_tokens=False).ids, repr(text)


def test_plain_pieces_are_encoded_without_a_normalizer_that_leaves_them(word_level):
    from tokenizers import Tokenizer, normalizers

    ids = tokens.Pieces(word_level, tokens.id_bytes)
    rng = random.Random(4)
    marks = "abcz019'.,-<>|`~@[^"
    words = {"".join(rng.choices(marks, k=rng.randint(1, 9))).encode() for _ in range(3000)} | {w.encode() for t in odd_texts() for w in t.split()}
    words |= {b"<|endoftext|>", b"a<|endoftext|>b", b"it's", "\u0130x".encode(), "caf\u0065\u0301".encode(), b"Upper"}
    assert ids.bare is not None and any(map(tokens.PLAIN.fullmatch, words)) and not all(map(tokens.PLAIN.fullmatch, words))
    ids.learn(words)
    for word in words:
        assert ids.known[word] == tokens.id_bytes(word_level.encode(word.decode(), add_special_tokens=False)), word
    other = Tokenizer.from_str(word_level.to_str())
    other.normalizer = normalizers.Sequence([normalizers.Lowercase(), normalizers.Replace("a", "b")])
    assert tokens.unnormalized(other) is None


def test_case_is_folded_where_it_does_not_matter(byte_level, word_level):
    ids = tokens.Pieces(word_level, tokens.id_bytes)
    assert ids.folds and not tokens.Pieces(byte_level, len).folds
    texts = ["THE The the", "ÉCOLE École", "<|ENDOFTEXT|> X", "a<|EndOfText|>B", "<|endoftext|> The", "ΑΣ ΣΑΣ.", "İI ıK", "A" * 3000 + " b"]
    for text, found in zip(texts, tokens.word_ids(ids, [t.encode() for t in texts]), strict=True):
        assert found.tolist() == word_level.encode(text, add_special_tokens=False).ids, repr(text)


def test_groups_and_blocks_do_not_matter(monkeypatch, word_level):
    from waymark.llm import common

    monkeypatch.setattr(tokens, "GROUP_PIECES", 5)
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 7)
    blocks = common.word_blocks
    monkeypatch.setattr(tokens, "word_blocks", lambda data: blocks(data, 8))
    texts = odd_texts()
    ids = tokens.Pieces(word_level, tokens.id_bytes)
    for text, found in zip(texts, tokens.word_ids(ids, [t.encode() for t in texts]), strict=True):
        assert found.tolist() == word_level.encode(text, add_special_tokens=False).ids, repr(text)


def test_counts_of_the_whole_table(spark, sf, byte_level):
    want = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op4_token_counts"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        n = len(byte_level.encode(want[r["doc_id"]], add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(want[r["doc_id"]].encode()), n, n > 512)


def expected(docs, tokenizer):
    start, out = 0, []
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_of_the_whole_table(spark, sf, word_level):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in QUERIES["op10_token_files"](spark, sf).collect())
    assert got == expected(docs, word_level)


def test_file_edges(spark, tmp_path, word_level):
    docs = [(None, "null id"), (1, None), (2, ""), (3, "a"), (3, "a"), (4, "b " * 70_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "7 as start", "'x' as path").repartition(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    for bits in (False, True):
        files = planes.write_ids(df, path, f"{tmp_path}/{bits}", bits=bits)
        got = planes.read_ids(files, with_ids=True).collect()
        assert sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == expected(docs, word_level)
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    assert planes.token_files(df.where("doc_id > 9"), path).collect() == []
    assert tokens.count_tokens(df.where("doc_id > 9"), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_ids_of_any_type(spark, word_level):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, f"text {i}") for i in (12, 3, 101)], "n bigint, text string")
    for kind, shown in (("decimal(20,2)", lambda n: f"{n}.00"), ("date", lambda n: f"2024-01-{n % 28 + 1:02}"), ("string", str), ("int", str), ("double", lambda n: f"{n}.0")):
        of = "date_add(date'2024-01-01', int(n % 28))" if kind == "date" else f"cast(n as {kind})"
        typed = docs.selectExpr(f"{of} as doc_id", "text")
        rows = typed.orderBy("doc_id").collect()
        got = planes.token_files(typed, path)
        assert dict(got.dtypes)["doc_id"] == kind
        want = expected([(r["doc_id"], r["text"]) for r in rows], word_level)
        assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == want


def test_planes_round_trip():
    for n in (0, 1, 7, 65_536):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
        for bits in (False, True):
            assert planes.restored(planes.transposed(ids, bits), n).tolist() == ids.tolist()
