"""Tokens, archives and codes: exact round trips against the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latticework.llm import warc
from latticework.llm.bpe import decode_documents, encode_documents
from latticework.llm.token_binary import Codes, encode, read_tokens, tokenizer, write_tokens
from tests.llm.helpers import documents, fuller

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1200), st.sampled_from([4, 8, 16]))
def test_codes(ids, bits):
    codes = Codes(encode(np.array(ids, np.uint32), bits))
    assert len(codes) == len(ids)
    assert codes.slice(0, len(ids)).tolist() == ids
    for i in range(0, len(ids), 37):
        assert codes[i] == ids[i]
        assert codes.slice(i, min(len(ids), i + 50)).tolist() == ids[i : i + 50]


def test_damaged_codes():
    data = encode(np.arange(1000))
    with pytest.raises(ValueError):
        Codes(data + b"x")
    with pytest.raises(ValueError):
        Codes(b"y" + data)
    with pytest.raises(IndexError):
        Codes(data)[1000]


@pytest.mark.parametrize("file_ids", [1 << 22, 500])
def test_token_files(spark, file_ids):
    rows = fuller(60)
    tok = Tokenizer.from_file(WORD)
    at, want = 0, {}
    for r in sorted(rows, key=lambda r: r[0]):
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want[r[0]] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    manifest = write_tokens(documents(spark, rows=rows).withColumn("start", F.lit("x")), WORD, file_ids=file_ids)
    assert (manifest.count() > 8) == (file_ids == 500)
    assert {r.doc_id: tuple(r)[1:] for r in read_tokens(manifest).collect()} == want
    assert read_tokens(write_tokens(documents(spark, rows=[]), WORD)).count() == 0


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_bpe(spark, block, monkeypatch):
    import latticework.llm.bpe as bpe

    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    monkeypatch.setattr(bpe, "GATHER", 50)
    rows = fuller(60) + [(4, "one", "en", "repeated id", 3), (None, "no id", "en", "a", 5)]
    tok = Tokenizer.from_file(BYTE)
    want = sorted((r[0], np.array(tok.encode(r[1] or "", add_special_tokens=False).ids, "<u4").tobytes(), tok.decode(tok.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in rows if r[0] is not None)
    docs = documents(spark, rows=rows).withColumn("key", F.lit(1)).withColumn("ids", F.lit("x"))
    got = encode_documents(docs, BYTE, decode=True).collect()
    assert sorted((r.doc_id, bytes(r.ids), r.decoded) for r in got) == want
    apart = decode_documents(encode_documents(docs, BYTE), BYTE).collect()
    assert sorted((r.doc_id, bytes(r.ids), r.decoded) for r in apart) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert encode_documents(documents(spark, rows=[]), BYTE, decode=True).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab'stre12 .,!\n\t\r\x0b\x1c\x1f\x7f\x85\xa0é 　́北🙂<|>")), max_size=40))
def test_pieces_encode_independently(text):
    import pyarrow as pa

    from latticework.llm import words

    tok, low = tokenizer(BYTE), tokenizer(WORD)
    raw = text.encode()
    for _, data, offsets in words.text_slices(pa.array([text])):
        a, b = words.pieces(data, offsets)
        parts = [raw[x:y].decode() for x, y in zip(a, b)]
        assert "".join(parts) == text
        assert [i for p in parts for i in tok.encode(p, add_special_tokens=False).ids] == tok.encode(text, add_special_tokens=False).ids
        a, b = words.bounds(data, offsets)
        assert [i for x, y in zip(a, b) for i in low.encode(raw[x:y].decode(), add_special_tokens=False).ids] == low.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aB'sTre12 .,!\n\t\r\x0b\x1c\x1f\x7f\x85\xa0éÉ\u030c 　́北🙂<|>_", "<|endoftext|>", "<|startoftext|>", "<|STARTOFTEXT|>"]), max_size=30).map("".join), max_size=4))
def test_word_encoder(texts):
    import pyarrow as pa

    from latticework.llm import words
    from latticework.llm.token_binary import WordEncoder, encode_words

    for path in (WORD, BYTE):
        tok = tokenizer(path)
        flat, lengths = encode_words(path, texts)
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert lengths.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
    encoder = WordEncoder(WORD, most=5)
    assert encoder.fine
    for _, data, offsets in words.text_slices(pa.array(texts, pa.string())):
        ids, at = encoder(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [tokenizer(WORD).encode(t, add_special_tokens=False).ids for t in texts]


def test_patterned_words(spark):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x {one} y"), (2, f"x {other} y"), (3, other), (4, f"{one} {other} {one}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    low, tok = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    want = {i: zlib.crc32(np.array(low.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows}
    assert {r.doc_id: r.ids_crc32 for r in read_tokens(write_tokens(docs, WORD)).collect()} == want
    got = {r.doc_id: (bytes(r.ids), r.decoded) for r in encode_documents(docs, BYTE, decode=True).collect()}
    assert got == {i: (np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t) for i, t in rows}


def pages(spark):
    html = "<html>" + "copy " * 40
    rows = [(1, "http://a", "<p>x</p>"), (2, None, None), (3, "u\r\nX: y", html), (4, "v", html), (5, "w", html), (6, "é", ""), (7, "", "<p>x</p>"), (8, "z", "ü" * 60), (9, "z", "ü" * 60), (3, "again", html), (None, "no id", "x"), (10, "long", "y" * 300_000), (11, "crlf", "a\r\n\r\nb\r\n\r\n" * 20)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_archives(spark):
    table, rows = pages(spark)
    got = sorted(tuple(r) for r in warc.read_archives(warc.write_archives(table.withColumn("first", F.lit(1)))).drop("url").collect())
    rows = [r for r in rows if r[0] is not None]
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "").encode() == data)
        again = len(data) >= 100 and first < i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert [x[:4] for x in got] == [x[:4] for x in sorted(want, key=lambda x: x[:4])]
    assert sorted((x[0], x[4]) for x in got if x[4]) == sorted((x[0], x[4]) for x in want if x[4])
    assert warc.read_archives(warc.write_archives(table.limit(0))).count() == 0


def test_archive_validation():
    payload = b"<p>" + b"x" * 500
    one = warc.build_record(1, "http://a", payload, len(payload), hashlib.sha256(payload).hexdigest(), None)
    assert warc.parse_record(one).payload == payload
    archive = warc.frame_archive([one] * 30, [payload[:i] + bytes([i % 251]) * i for i in range(50, 450, 4)])
    assert list(warc.read_frames(archive)) == [one] * 30
    for bad in (archive[:-1], archive[4:], b"", archive + b"x"):
        with pytest.raises(warc.WarcError):
            list(warc.read_frames(bad))
    for bad in (one[:-1], one.replace(b"xxxx", b"yyyy", 1), one.replace(b"WARC/1.1", b"WARC/9"), one.replace(b"WARC-Date", b"WARC-Dote"), one + b"z"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
