import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rowsmith.llm import token_records as R
from rowsmith.llm.common import Scratch
from rowsmith.llm.queries import END_ID, op7_token_records, tokenizer_path

from .helpers import SMALL, docs, odd_rows


def plain(rows):
    tok = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, END_ID], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def got(df):
    return [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.orderBy("start").collect()]


def test_whole_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    assert got(op7_token_records(spark, SMALL)) == plain(rows)


def test_odd_rows(spark):
    rows = sorted(((r[0], r[1]) for r in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got(R.encode_and_read(docs(spark, rows), tokenizer_path(), END_ID)) == plain(rows)
    assert got(R.encode_and_read(docs(spark, []), tokenizer_path(), END_ID)) == []


def test_added_tokens_are_those_of_the_library(spark):
    rows = [(1, "hello <|endoftext|> world<|endoftext|>"), (2, "<|endoftext|>"), (3, "<|endoftext"), (4, "plain")]
    assert got(R.encode_and_read(docs(spark, rows), tokenizer_path(), END_ID)) == plain(rows)
    assert 50256 in Tokenizer.from_file(tokenizer_path()).encode(rows[0][1], add_special_tokens=False).ids


def test_pieces_of_white_space_and_marks_in_any_order():
    rng, tok, enc = random.Random(2), Tokenizer.from_file(tokenizer_path()), R.WordEncoder(tokenizer_path(), remember=50)
    bits = ["a", "the", "é", " ", "  ", "\n", "\t", ",", ".", " x", "12", " 7", "'s", "don't", "日本", "😀", "<|endoftext|>", "\x01", "\r\n", "\x0b", "\x85", "\x1c", "!?", "_", "ª", "\xa0", "\u3000"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(5000)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(pa.array([*texts, None]))] == [*want, []]


@pytest.mark.parametrize("text", ["a  b", "a \n b", "x\n\n  y z", " lead", "trail ", "  b", "a　 b　c", "it's 'll do", "  ", "tab\t tab", "\x1c x \x85 y", "é è  ñ"])
def test_cut_encoding_equals_whole_encoding(text):
    tok = Tokenizer.from_file(tokenizer_path())
    enc = R.WordEncoder(tokenizer_path(), remember=4)
    for _ in range(2):
        assert np.frombuffer(enc.encode(pa.array([text]))[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_index_finds_records_and_damage_is_seen(spark):
    scratch = Scratch(spark, "t")
    rows = [(i, f"text number {i} " * (i + 1)) for i in range(20)]
    index = R.write_records(docs(spark, rows), tokenizer_path(), END_ID, scratch.base, vocabulary=100_000).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    for r in index:
        with open(f"{scratch.base.removeprefix('file://')}/data/{R.file_name(r.file)}", "rb") as f:
            f.seek(r.offset)
            data = f.read(r.length)
        ((doc_id, ids),) = R.read_frames(io.BytesIO(data))
        assert doc_id == r.doc_id and ids.tolist() == [*tok.encode(rows[doc_id][1], add_special_tokens=False).ids, END_ID]
        with pytest.raises(ValueError, match="damaged"):
            list(R.read_frames(io.BytesIO(data[:20] + bytes([data[20] ^ 1]) + data[21:])))
        with pytest.raises(ValueError, match="damaged"):
            list(R.read_frames(io.BytesIO(data[:-1])))


def test_no_more_than_some_mb_of_text_are_encoded_at_a_time(tmp_path, monkeypatch):
    sizes, text = [], "some words " * 45_000
    enc = type("Encoder", (), {"encode": lambda self, texts: sizes.append(sum(map(len, texts.to_pylist()))) or [b""] * len(texts)})()
    monkeypatch.setattr(R, "encoder", lambda path: enc)
    monkeypatch.setattr(R, "TaskContext", type("Context", (), {"get": lambda: type("Task", (), {"partitionId": lambda self: 0, "taskAttemptId": lambda self: 0})()}))
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array([text] * 20)], ["doc_id", "text"])
    out = list(R._writer(f"file://{tmp_path}", END_ID, "", True)(iter([batch])))
    assert sum(b.num_rows for b in out) == 20 and sum(sizes) == 20 * len(text)  # all of it
    assert max(sizes) < 3_000_000  # two workers an executor, beside 1.8 GB of heap


def test_pieces_leave_arrow_as_one_string(monkeypatch):
    odd = pa.array(["", "a", " the", "é", "日本 ", "\n", "\x00", "😀", ""])
    for some in (odd, odd.slice(2, 5), odd.slice(0, 1), odd.slice(3, 0)):
        assert R.strings(some) == some.to_pylist()
    enc, seen = R.WordEncoder(tokenizer_path()), []
    monkeypatch.setattr(R, "strings", lambda pieces: seen.append(len(pieces)) or pieces.to_pylist())
    texts = ["one two two", "two three\n four"]
    want = [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(pa.array(texts))] == want and sum(seen) == 5
