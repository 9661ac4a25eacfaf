"""Words of many texts at once, by Arrow kernels.

Texts are lower-cased (A-Z only), split and flattened; the flat words become dictionary indices, so
later steps work on integer arrays and touch each distinct word of a batch once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text bytes handled at once: bounds the arrays of a task however many long texts a batch holds.
SLICE_BYTES = 8 << 20


@dataclass(frozen=True)
class Words:
    """doc: row number of each word, never falling; code: its index in names; rows: number of texts."""

    doc: np.ndarray
    code: np.ndarray
    names: pa.Array
    rows: int


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about this many bytes; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // limit
    ends = np.append(np.flatnonzero(np.diff(part)) + 1, batch.num_rows)
    at = 0
    for end in ends:
        yield batch.slice(at, int(end) - at)
        at = int(end)


def words_of(texts: pa.Array, separators: str) -> Words:
    """Words between runs of separators (a regular expression); null and empty texts have none."""
    lower = pc.ascii_lower(pc.fill_null(texts, ""))
    parts = pc.split_pattern_regex(lower, separators)
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    encoded = pc.dictionary_encode(pc.list_flatten(parts))
    code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), lengths)
    empty = pc.index(encoded.dictionary, "").as_py()  # beside a separator at either end of a text
    if empty >= 0:
        kept = code != empty
        doc, code = doc[kept], code[kept]
    return Words(doc, code, encoded.dictionary, len(texts))
