"""Words of many texts at once, in Arrow's own memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text that is held at a time.
SLICE_BYTES = 1 << 22


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``most`` bytes of text; a longer text is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at] - sizes[at]
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of a piece of texts one after another, and where each text's begin (with the end of the last).

    Words are stretches without space, tab, line feed, vertical tab, form feed and carriage return. Null texts have none.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat, borders = parts.flatten(), parts.offsets.to_numpy()
    borders = borders - borders[0]
    full = pc.not_equal(pc.binary_length(flat), 0)
    before = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
    return flat.filter(full), before[borders]


def joined(words: pa.Array, borders: np.ndarray) -> pa.Array:
    """Texts of words with one space between them."""
    lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), words)
    return pc.binary_join(lists, " ")
