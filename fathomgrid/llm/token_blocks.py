"""Token ids as compressed binary blocks: an adaptive context-mixing range coder.

Each id is predicted by three models. Order 2 and order 1 remember which id last followed the two
or one ids before, with a confidence; order 0 counts ids. One interval of the range coder's
probability line goes to the order-2 guess, one to the order-1 guess, the rest to the order-0
counts, in proportions learned per pair of confidences while coding.

A block is coded on its own: all models start afresh, and a crc32 guards the payload. Inside a
block the ids are cut into parallel lanes that step together and share the models, so numpy works
on all lanes at once; each lane has its own range coder and its own bytes.

Blocks are rows of a table that Spark writes and reads (no local files), in ascending document
order: documents are range-partitioned, every task codes its range, and only one total per
partition passes through the driver to turn local positions into positions of the whole corpus.

The tokenizers library makes the ids. Texts are cut, as arrays of bytes, where its splitting pattern
surely cuts; it gets each distinct piece of a group of texts once.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, rows_in, small_table, stage, text_hash, to_arrow

MAGIC = b"FGT1"
HEADER = "<4sIIIIqI"  # magic, ids, lanes, vocabulary, documents, ids before in the partition, crc32
MAX_LANES = 4096
BLOCK_IDS = 1 << 20
TOTAL = 1 << 30        # probability line
LEAST = 1 << 23        # share that the order-0 model keeps
GAIN = 24              # count for a seen id
ORDER0_LIMIT = 1 << 22
EVERY = 4              # steps between new order-0 tables
TWO_BITS = 18


class Model:
    """Shared adaptive state of one block; encoder and decoder drive it with the same ids."""

    def __init__(self, lanes: int, vocab: int):
        self.prev1, self.prev2 = np.full(lanes, vocab, np.int64), np.full(lanes, vocab, np.int64)
        # guess and confidence (two bits) of every context
        self.cell1, self.cell2 = np.zeros(vocab + 1, np.int32), np.zeros(1 << TWO_BITS, np.int32)
        self.votes = np.tile(np.array([1, 1, 6], np.int64), (16, 1))
        self.counts, self.cum, self.steps = np.ones(vocab, np.int64), np.zeros(vocab + 1, np.uint64), 0
        self.table()

    def table(self):
        np.cumsum(self.counts, out=self.cum[1:].view(np.int64))
        if self.cum[-1] > ORDER0_LIMIT:
            self.counts = (self.counts >> 1) + 1
            np.cumsum(self.counts, out=self.cum[1:].view(np.int64))
        self.sum = self.cum[-1]

    def find(self, counts: np.ndarray) -> np.ndarray:
        """Ids whose share of the counts holds the given ones."""
        # sorted, so that one search goes over what the last one left in the cache
        bits = np.uint64(len(counts).bit_length())
        keys = np.sort(counts << bits | np.arange(len(counts), dtype=np.uint64))
        ids = np.empty(len(counts), np.int64)
        ids[(keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = np.searchsorted(self.cum, keys >> bits, "right") - 1
        return np.minimum(ids, len(self.counts) - 1)

    def predict(self):
        """Guesses and interval widths of every lane: order 2, order 1, order 0."""
        self.at2 = ((self.prev2 * 0x9E3779B1 + self.prev1 * 0x85EBCA77) >> 7) & ((1 << TWO_BITS) - 1)
        self.c2, self.c1 = self.cell2.take(self.at2), self.cell1.take(self.prev1)
        self.g2, self.g1 = self.c2 >> 2, self.c1 >> 2
        self.s2, self.s1 = self.c2 & 3, self.c1 & 3
        self.state = self.s2 * 4 + self.s1
        widths = (self.votes * (TOTAL - LEAST) // self.votes.sum(1, keepdims=True)).astype(np.uint64)
        w2, w1 = widths[:, 0].take(self.state), widths[:, 1].take(self.state)
        w1 *= self.g1 != self.g2
        return w2, w1

    def update(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray):
        """hit2, hit1: lanes whose order-2 and order-1 guess is the id."""
        # 0: order 2, 1: order 1, 2: order 0
        kind = self.state * 3 + 2
        kind -= hit1
        kind -= hit2
        kind -= hit2 & ~hit1
        self.votes += np.bincount(kind, minlength=48).reshape(16, 3)
        if self.votes.max() > 1 << 20:
            self.votes = (self.votes >> 1) + 1
        fresh = (ids << 2).astype(np.int32)
        for cell, at, old, conf, hit in ((self.cell2, self.at2, self.c2, self.s2, hit2),
                                         (self.cell1, self.prev1, self.c1, self.s1, hit1)):
            # one surer up to 3, one less sure down to 0, and then another guess
            cell[at] = np.where(hit, old + (conf < 3), np.where(conf > 0, old - 1, fresh))
        np.add.at(self.counts, ids, GAIN)
        self.prev2, self.prev1 = self.prev1, ids
        self.steps += 1
        if self.steps % EVERY == 0:
            self.table()


class Coder:
    """One 64-bit carryless range coder per lane, shifting 16 bits at a time."""

    TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)

    def narrow(self, start, width):
        self.range >>= np.uint64(30)
        self.low += start * self.range
        self.range *= width

    def ready(self):
        """Lanes whose top 16 bits are settled, after cutting ranges that are too short to use."""
        settled = (self.low ^ (self.low + self.range)) < self.TOP
        short = self.range < self.BOTTOM
        if short.any() and (short := short & ~settled).any():
            self.range[short] = (np.uint64(0) - self.low[short]) & (self.BOTTOM - np.uint64(1))
            settled |= short
        return np.flatnonzero(settled)

    def shift(self, at):
        self.low[at] = self.low.take(at) << np.uint64(16)
        self.range[at] = self.range.take(at) << np.uint64(16)


def lanes_for(n: int) -> int:
    return int(min(MAX_LANES, max(1, 1 << max(0, (n // 128).bit_length() - 1))))


def _turned(grid: np.ndarray) -> np.ndarray:
    """The transposed array, copied in strips that fit the cache."""
    out = np.empty(grid.shape[::-1], grid.dtype)
    for at in range(0, len(grid), 64):
        out[:, at:at + 64] = grid[at:at + 64].T
    return out


def _in_lanes(ids: np.ndarray, lanes: int) -> np.ndarray:
    """Lane-major ids as a (steps, lanes) array, padded with 0."""
    steps = -(-len(ids) // lanes)
    out = np.zeros(steps * lanes, np.int64)
    out[:len(ids)] = ids
    return _turned(out.reshape(lanes, steps))


def encode_ids(ids: np.ndarray, vocab: int) -> tuple[int, bytes]:
    """Lanes and payload: byte length of every lane, then the lanes' bytes."""
    lanes = lanes_for(len(ids))
    grid = _in_lanes(ids, lanes)
    model, coder = Model(lanes, vocab), Coder(lanes)
    words, used, one = np.zeros((lanes, 64), np.uint16), np.zeros(lanes, np.int64), np.uint64(1)
    for now in grid:
        w2, w1 = model.predict()
        base = w2 + w1
        rest = np.uint64(TOTAL) - base
        lo, hi = model.cum.take(now) * rest // model.sum, model.cum.take(now + 1) * rest // model.sum
        hit2, hit1 = now == model.g2, now == model.g1
        # a guess with no width of its own is coded by order 0
        is2 = hit2 & (w2 > 0)
        is1 = hit1 & (w1 > 0)
        coder.narrow(np.where(is2, 0, np.where(is1, w2, base + lo)), np.where(is2, w2, np.where(is1, w1, hi - lo)))
        while len(at := coder.ready()):
            if used.max() + 8 > words.shape[1]:
                words = np.concatenate([words, np.zeros_like(words)], 1)
            next_at = used.take(at)
            words.reshape(-1)[at * words.shape[1] + next_at] = (coder.low.take(at) >> np.uint64(48)).astype(np.uint16)
            used[at] = next_at + 1
            coder.shift(at)
        model.update(now, hit2, hit1)
    tail = coder.low + (coder.range >> one)
    for k in range(4):
        words[np.arange(lanes), used] = ((tail >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)).astype(np.uint16)
        used += 1
        if used.max() + 8 > words.shape[1]:
            words = np.concatenate([words, np.zeros_like(words)], 1)
    mask = np.arange(words.shape[1]) < used[:, None]
    return lanes, used.astype("<u4").tobytes() + words[mask].astype("<u2").tobytes()


def decode_ids(payload: bytes, n: int, lanes: int, vocab: int) -> np.ndarray:
    used = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
    data = np.concatenate([np.frombuffer(payload, "<u2", offset=4 * lanes), np.zeros(4, np.uint16)]).astype(np.uint64)
    at = np.concatenate(([0], np.cumsum(used)[:-1]))
    model, coder = Model(lanes, vocab), Coder(lanes)
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << np.uint64(16)) | data[at]
        at += 1
    steps, out = -(-n // lanes), []
    one = np.uint64(1)
    for _ in range(steps):
        w2, w1 = model.predict()
        base = w2 + w1
        rest = np.uint64(TOTAL) - base
        unit = coder.range >> np.uint64(30)
        target = np.minimum((code - coder.low) // unit, np.uint64(TOTAL - 1))
        is2, by0 = target < w2, np.flatnonzero(target >= base)
        now = np.where(is2, model.g2, model.g1).astype(np.int64)
        start, width = np.where(is2, 0, w2), np.where(is2, w2, w1)
        if len(by0):
            before, rest = base[by0], rest[by0]
            found = model.find(((target[by0] - before + one) * model.sum - one) // rest)
            lo, hi = model.cum.take(found) * rest // model.sum, model.cum.take(found + 1) * rest // model.sum
            now[by0], start[by0], width[by0] = found, before + lo, hi - lo
        coder.narrow(start, width)
        while len(ready := coder.ready()):
            next_at = at.take(ready)
            code[ready] = (code.take(ready) << np.uint64(16)) | data.take(next_at, mode="clip")
            at[ready] = next_at + 1
            coder.shift(ready)
        model.update(now, now == model.g2, now == model.g1)
        out.append(now)
    return _turned(np.array(out, np.int64).reshape(steps, lanes)).reshape(-1)[:n]


def pack_block(ids: np.ndarray, lengths: list[int], before: int, vocab: int) -> bytes:
    lanes, payload = encode_ids(ids, vocab)
    body = np.array(lengths, "<u4").tobytes() + payload
    return struct.pack(HEADER, MAGIC, len(ids), lanes, vocab, len(lengths), before, zlib.crc32(body)) + body


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """ids, lengths of the documents, ids before the block in its partition."""
    magic, n, lanes, vocab, docs, before, crc = struct.unpack_from(HEADER, block)
    body = block[struct.calcsize(HEADER):]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("damaged token block")
    lengths = np.frombuffer(body, "<u4", docs)
    return decode_ids(body[4 * docs:], n, lanes, vocab), lengths, before


# Classes of bytes; the rest (other scripts, control characters) has class 0 and is cut from nothing but white space.
SPACE, BLANK, LETTER, DIGIT, SIGN, APOSTROPHE = 1, 2, 3, 4, 5, 6
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[33:127] = SIGN
for _class, _bytes in ((SPACE, b" "), (BLANK, b"\t\n\v\f\r"), (DIGIT, b"0123456789"), (APOSTROPHE, b"'"),
                       (LETTER, bytes(range(65, 91)) + bytes(range(97, 123)))):
    _CLASSES[list(_bytes)] = _class
_CLASSES[0xC3:0xC9] = LETTER  # first bytes of U+00C0 to U+023F, all letters but the two signs
_SIGNS = (0xC397, 0xC3B7)
# Last bytes of what is or once was white space beyond ASCII.
_WIDE_SPACE2 = np.array([0xC285, 0xC2A0], np.uint32)
_WIDE_SPACE3 = np.array([0xE19A80, 0xE1A08E, *range(0xE28080, 0xE2808C), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080,
                         0xEFBBBF], np.uint32)
# What the pattern takes as one word; the bytes of its characters all have class LETTER or SPACE.
_WORD = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u023f]+$"
SLICE_BYTES = 1 << 20   # of text that is cut at a time
GROUP_BYTES = 1 << 24   # of text whose distinct pieces are encoded together


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions in UTF-8 bytes between which the byte-level splitting pattern surely cuts, whatever stands around.

    starts: first bytes of the texts. Cut are words, numbers and signs from each other (nothing after an
    apostrophe, which may begin a contraction), white space from what stands before it, and the last
    character of white space, which alone may join what follows, from the rest.
    """
    kind = _CLASSES[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
    kind[lead + 1] = LETTER
    signs = lead[(data[lead] == 0xC3) & np.isin(data[lead + 1], [x & 0xFF for x in _SIGNS])]
    kind[signs] = kind[signs + 1] = 0
    before, after = kind[:-1], kind[1:]
    blank = (kind == SPACE) | (kind == BLANK)
    plain = kind >= LETTER
    first = np.zeros(len(data), bool)
    first[starts] = True
    cut = first.copy()
    cut[1:] |= (before != after) & plain[:-1] & plain[1:] & (before != APOSTROPHE) & ((before != SIGN) | (after != APOSTROPHE))
    cut[1:] |= plain[:-1] & blank[1:]
    wide = np.flatnonzero(blank[1:] & (data[:-1] >= 0x80) & ~plain[:-1]) + 1
    if len(wide):
        two = data[wide - 2].astype(np.uint32) << 8 | data[wide - 1]
        three = data[np.maximum(wide - 3, 0)].astype(np.uint32) << 16 | two
        cut[wide[~(np.isin(two, _WIDE_SPACE2) | np.isin(three, _WIDE_SPACE3))]] = True
    last = blank[:-1] & plain[1:] & ~first[1:]
    cut[:-1] |= last
    cut[1:] |= last & (before == BLANK)
    return np.flatnonzero(cut)


class Tokens:
    """Ids of texts by the tokenizers library; each distinct piece of a group of texts is encoded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        splitter = self.tokenizer.pre_tokenizer
        self.cut = (isinstance(splitter, ByteLevel) and splitter.use_regex and not splitter.add_prefix_space
                    and self.tokenizer.normalizer is None and self.tokenizer.truncation is None)
        # UTF-16 of the library's character of every byte that words hold
        shown, self.shown = ByteLevel(add_prefix_space=False, use_regex=False), np.zeros(256, np.uint16)
        for c in map(chr, [*range(128), *range(0xC0, 0x240)]):
            self.shown[list(c.encode())] = [ord(x) for x in shown.pre_tokenize_str(c)[0][0]]

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all pieces, and where those of each piece begin and how many they are.

        Single words need no splitting: they go to the library's model as they are.
        """
        pieces = pieces.cast(pa.large_string())
        word = pc.match_substring_regex(pieces, _WORD)
        words, others = pieces.filter(word), pieces.filter(pc.invert(word)).to_pylist()
        ids, lengths, tokenize = array("I"), [], self.tokenizer.model.tokenize
        if len(words):
            _, ends, data = words.buffers()
            ends = np.frombuffer(ends, np.int64)[words.offset:words.offset + len(words) + 1]
            shown = self.shown[np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]].astype("<u2").tobytes().decode("utf-16-le")
            ends = (ends - ends[0]).tolist()
            for a, b in zip(ends[:-1], ends[1:]):
                one = [t.id for t in tokenize(shown[a:b])]
                ids.extend(one)
                lengths.append(len(one))
        for at in range(0, len(others), 1024):
            for one in self._raw(others[at:at + 1024]):
                ids.extend(one)
                lengths.append(len(one))
        word = word.to_numpy(zero_copy_only=False)
        order, lengths = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)]), np.array(lengths, np.int64)
        starts, counts = np.zeros((2, len(pieces)), np.int64)
        starts[order], counts[order] = np.cumsum(lengths) - lengths, lengths
        return np.array(ids, np.uint32), starts, counts

    def encode_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """ids of each text of an Arrow column without nulls.

        Texts with a special token, and all texts if the tokenizer splits otherwise, are encoded whole.
        """
        texts = texts.cast(pa.large_string())
        special = np.full(len(texts), not self.cut)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if special.any():
            whole = (self._raw([t.as_py()])[0] for t in texts.filter(pa.array(special)))
            texts = pc.if_else(pa.array(special), "", texts)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        chunks, counts, a = [], [], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
            part, own = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            at = cuts(part, own[:-1][own[:-1] < own[1:]])
            counts.append(np.searchsorted(at, own))
            at = np.append(at, len(part)).astype(np.int64)
            chunks.append(pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(part)]))
            a = b
        coded = pa.chunked_array(chunks, pa.large_binary()).dictionary_encode().chunks
        # all chunks share one dictionary; there is none without a piece
        ids, starts, lengths = self._distinct(coded[0].dictionary if coded else pa.array([], pa.large_binary()))
        pieces, at, text = np.concatenate([c.indices.to_numpy() for c in coded] or [np.zeros(0, np.int32)]), 0, 0
        for count in counts:
            piece = pieces[at:at + count[-1]]
            n = lengths[piece]
            ends = np.concatenate(([0], np.cumsum(n)))
            flat = ids[np.repeat(starts[piece] - ends[:-1], n) + np.arange(ends[-1])]
            ends, at = ends[count].tolist(), at + count[-1]
            for lo, hi in zip(ends[:-1], ends[1:]):
                yield np.array(next(whole), np.uint32) if special[text] else flat[lo:hi]
                text += 1

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian 32-bit numbers."""
        return [x.astype("<u4").tobytes() for x in self.encode_column(pa.array(texts, pa.large_string()))]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables with about GROUP_BYTES of text, or a single larger row."""
    group, n = [], 0
    for batch in batches:
        at, ends = 0, np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + GROUP_BYTES - n, "right")))
            group.append(batch.slice(at, to - at))
            n, at = n + int(ends[to - 1] - before), to
            if n >= GROUP_BYTES or at < batch.num_rows:
                yield pa.Table.from_batches(group)
                group, n = [], 0
    if group:
        yield pa.Table.from_batches(group)


BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())])


def write_blocks(docs: DataFrame, path: str | None, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode all documents, append end_id to each, and write the blocks; returns the table read back.

    path None: a folder below spark.checkpoint.dir. Documents never span blocks. A null or empty
    text is just the end id. Null ids come first; equal ids are ordered by a hash of the text.
    """

    def code(batches):
        tokens, part, end = Tokens(tokenizer), TaskContext.get().partitionId(), np.array([end_id], np.uint32)
        ids, names, lengths, size, block, before = [], [], [], 0, 0, 0

        def close():
            nonlocal ids, names, lengths, size, block, before
            data = pack_block(np.concatenate(ids).astype(np.int64), lengths, before, tokens.vocab)
            row = to_arrow(BLOCKS, [[part], [block], [size], [names], [data]])
            before, block = before + size, block + 1
            ids, names, lengths, size = [], [], [], 0
            return row

        for group in _groups(batches):
            texts = group.column("text").combine_chunks()
            for doc_id, one in zip(group.column("doc_id").to_pylist(), tokens.encode_column(texts)):
                ids += [one, end]
                names.append(doc_id)
                lengths.append(len(one) + 1)
                size += len(one) + 1
                if size >= block_ids:
                    yield close()
        if size:
            yield close()

    ordered = (documents(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
               .withColumn("h", text_hash(F.col("text")))
               .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text"))
    blocks = ordered.mapInArrow(code, "part int, block int, n_ids bigint, doc_ids array<bigint>, data binary")
    if path is None:
        return stage(blocks, "token-blocks")
    blocks.write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(blocks.schema).parquet(path)


READ = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()),
                  ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64())])


def read_blocks(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of a block table: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""

    def decode(batches):
        for part, doc_ids, data in rows_in(batches, "part", "doc_ids", "data"):
            ids, lengths, before = unpack_block(data)
            ends = np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)]
            lists = [ids[a:b] for a, b in zip(starts, ends)] if with_ids else [None] * len(ends)
            yield to_arrow(READ, [[part] * len(ends), doc_ids, before + starts, lengths, lists, crc])

    rows = blocks.select("part", "doc_ids", "data").mapInArrow(
        decode, "part int, doc_id bigint, before bigint, n_tokens bigint, ids array<int>, ids_crc32 bigint")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).toPandas().sort_values("part")
    first = small_table(blocks.sparkSession, part=pa.array(totals.part, pa.int32()),
                        first=pa.array(totals.n.cumsum() - totals.n, pa.int64()))
    out = rows.join(F.broadcast(first), "part").withColumn("start", F.col("first") + F.col("before"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
