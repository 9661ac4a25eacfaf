import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from fathomgrid.llm.token_blocks import Tokens, _groups, decode_ids, encode_ids, pack_block, read_blocks, unpack_block, write_blocks

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 5, 128, 1000, 40_000, 700_000])
@pytest.mark.parametrize("kind", ["flat", "same", "text"])
def test_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"flat": rng.integers(0, 50257, n), "same": np.full(n, 50256),
           "text": np.minimum(rng.zipf(1.3, n), 50256)}[kind].astype(np.int64)
    lanes, data = encode_ids(ids, 50257)
    assert (decode_ids(data, n, lanes, 50257) == ids).all()
    if kind == "text" and n > 500_000:
        assert len(data) < 1.5 * n


def test_damage_is_found():
    block = bytearray(pack_block(np.arange(1000), [400, 600], 7, 50257))
    ids, lengths, before = unpack_block(bytes(block))
    assert list(lengths) == [400, 600] and before == 7 and (ids == np.arange(1000)).all()
    block[-3] ^= 1
    with pytest.raises(ValueError):
        unpack_block(bytes(block))


def test_pieces_equal_whole_text():
    whole, pieces = Tokenizer.from_file(PATH), Tokens(PATH)
    for text in ["", " ", "a  b", "\n\n x\ty  ", "it's we'll 's  ' s", "x\x1c!y", "a<|endoftext|>b", "\xa0é　  z",
                 "tab\t\tend\t", "12 34\n56", "!? ..\r\n\r\n-", "日本 語", "🙂 🙂🙂", "\x85a\x85 b"]:
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(pieces.encode([text, "a"])[0], "<u4").tolist() == want


class Counting:
    """A tokenizer that counts the pieces the library gets."""

    def __init__(self, inner, seen):
        self.inner, self.seen = inner, seen

    def __getattr__(self, name):
        return getattr(self.inner, name)

    @property
    def model(self):
        return Counting(self.inner.model, self.seen)

    def tokenize(self, piece):
        self.seen.append(piece)
        return self.inner.tokenize(piece)

    def encode_batch_fast(self, pieces, **options):
        self.seen.extend(pieces)
        return self.inner.encode_batch_fast(pieces, **options)


def test_a_word_is_encoded_once_whatever_stands_beside_it():
    whole, pieces, seen = Tokenizer.from_file(PATH), Tokens(PATH), []
    pieces.tokenizer = Counting(pieces.tokenizer, seen)
    words = [f"{a}{b}ré" for a in "bcdfg" for b in "aeiou"]
    texts = [f"so {w}{sign} {w}\n" for w in words for sign in [",", ".", "!", "?", "'s", ")", " 7", "$$$", "\t"]]
    got = pieces.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(seen) <= len(words) + 15


@pytest.mark.parametrize("slice_bytes", [1, 60, 1 << 20])
def test_pieces_of_odd_texts(monkeypatch, slice_bytes):
    monkeypatch.setattr("fathomgrid.llm.token_blocks.SLICE_BYTES", slice_bytes)
    parts = ["a", "bc", " the", "É", "ß", "×", "÷", "ɏ", "ɐ", "日", "Ж", "я", "…", "—", "«", "\xa0", "\u2009", "\u3000", "\u200b",
             "\ufeff", "\u180e", "\u2028", "\x85", "\x1c", "\x00", "\x7f", "\x0b", "\r", "\n", "\t", " ", "  ", "'", "'s", "'ve", "’", "5",
             "٣", "²", ".", "!!", "_", "-", "<|", "🙂", "\u0301", "\x80", "<|endoftext|>"]
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(parts[:-1], n)) for n in rng.integers(0, 14, 3000)] + [""] + ["".join(rng.choice(parts, 9)) for _ in range(300)]
    want = Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in Tokens(PATH).encode(texts)] == [x.ids for x in want]
    assert Tokens(PATH).encode([""]) == [b""] and Tokens(PATH).encode([]) == []


def test_other_splitting_is_left_to_the_library(tmp_path):
    other = Tokenizer.from_file(PATH)
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Punctuation(), pre_tokenizers.ByteLevel(add_prefix_space=True)])
    other.save(str(tmp_path / "other.json"))
    texts = ["a word, a  sign!", "", "\n x"]
    assert Tokens(PATH).cut and not Tokens(str(tmp_path / "other.json")).cut
    got = Tokens(str(tmp_path / "other.json")).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_groups_hold_all_rows(monkeypatch):
    monkeypatch.setattr("fathomgrid.llm.token_blocks.GROUP_BYTES", 10)
    texts = ["", "abc", "é" * 4, "x" * 25, "", "ab", "y" * 10, "z", "", "w" * 9]
    batches = [pa.record_batch({"doc_id": list(range(a, b)), "text": texts[a:b]}) for a, b in [(0, 4), (4, 4), (4, 9), (9, 10)]]
    batches[1] = batches[0].slice(0, 0)
    groups = list(_groups(iter(batches)))
    assert [x for g in groups for x in zip(g["doc_id"].to_pylist(), g["text"].to_pylist())] == list(enumerate(texts))
    assert all(g.num_rows == 1 or sum(len(x.encode()) for x in g["text"].to_pylist()[:-1]) <= 10 for g in groups)
    assert len(groups) > 3


def test_blocks_of_a_table(spark):
    rows = [(3, "one two", "x"), (None, "no id", "y"), (1, None, "z"), (2, "", "a"), (3, "one two", "x"),
            (3, "other", "b"), (9, "long " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string").repartition(3)
    got = read_blocks(write_blocks(docs, None, PATH, block_ids=100)).toPandas().sort_values("start")
    assert len(got) == len(rows)
    assert got.doc_id.isna().iloc[0] and got.doc_id.iloc[1:].astype(int).tolist() == [1, 2, 3, 3, 3, 9]
    assert got.start.tolist() == (got.n_tokens.cumsum() - got.n_tokens).tolist()
    whole = Tokenizer.from_file(PATH)
    last = got.iloc[-1]
    ids = whole.encode("long " * 5000, add_special_tokens=False).ids + [2]
    assert list(last.ids) == ids
    assert last.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert got[got.doc_id == 1].n_tokens.tolist() == [1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert read_blocks(write_blocks(docs, None, PATH)).count() == 0
