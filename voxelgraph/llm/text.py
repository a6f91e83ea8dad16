"""Vectorised text kernels that run on Arrow batches inside tasks: words, lines and n-grams as numpy arrays.

Texts are UTF-8 bytes laid end to end, as Arrow keeps them. A null text counts as empty. Hashes have 64 bits, of two kinds:
item_hashes() and what grams() makes of them tell items apart (no structured collisions, at most 8 bytes are hashed without any);
Texts.hashes(), a polynomial modulo 2**64 from prefix sums, collides on long texts built for that and only picks features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text handled at a time inside a batch; a longer text is handled alone.
PIECE = 1 << 20

U = np.uint64


def table_of(chars: bytes) -> np.ndarray:
    """256 booleans: which byte values are in chars."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def space_table() -> np.ndarray:
    """Separators of words [^\\x20\\x09-\\x0D]+."""
    return table_of(b"\x20\x09\x0a\x0b\x0c\x0d")


def not_alnum_table() -> np.ndarray:
    """Every ASCII byte that is no letter or digit."""
    return table_of(bytes(c for c in range(128) if not chr(c).isalnum()))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Powers:
    """Powers of an odd base and of its inverse, grown as needed."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse, self.n = U(base), U(pow(base, -1, 1 << 64)), 0
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= self.n:
            self.n = max(n + 1, 2 * PIECE)
            ones = np.full(self.n, 1, U)
            with np.errstate(over="ignore"):
                a, b = ones.copy(), ones
                a[1:], b[1:] = self.base, self.inverse
                self.up, self.down = np.cumprod(a), np.cumprod(b)
        return self.up, self.down


class Texts:
    """A run of texts: data (bytes), off (where each begins, and the end)."""

    def __init__(self, col: pa.Array, powers: Powers):
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        col = pc.fill_null(col.cast(pa.large_string()), "")
        _, offsets, data = col.buffers()
        self.n = len(col)
        off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data, self.off, self.powers = whole[off[0] : off[-1]], off - off[0], powers

    def lower(self) -> Texts:
        self.data = lower_table()[self.data]
        return self

    def prefix(self) -> np.ndarray:
        up, _ = self.powers.upto(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * up[: len(self.data)], out=out[1:])
        return out

    def hashes(self, start: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        prefix = self.prefix() if prefix is None else prefix
        _, down = self.powers.upto(len(self.data) + 1)
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def words(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end of every maximal run without separators inside one text; first: index of each text's first word."""
        solid = ~separators[self.data]
        n = len(solid)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        cuts = self.off[1:-1]
        before[cuts[cuts < n]] = False
        after[cuts[cuts > 0] - 1] = False
        start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        return start, end, np.searchsorted(start, self.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end of every \\n-split line (an empty text has one empty line); first: index of each text's first line."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.off[:-1], breaks + 1]), kind="stable")
        end = np.sort(np.concatenate([self.off[1:], breaks]), kind="stable")
        per = np.searchsorted(breaks, self.off[1:]) - np.searchsorted(breaks, self.off[:-1]) + 1
        return start, end, np.concatenate([[0], np.cumsum(per)])


#: What keeps the lowest 0 to 8 bytes of a word.
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)


def item_hashes(t: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes that tell items apart: of up to 8 bytes by a bijection of the bytes, of more by XXH3."""
    import xxhash

    size, out = end - start, np.zeros(len(start), U)
    eight = np.ndarray((len(t.data) + 1,), "<u8", np.concatenate([t.data, np.zeros(8, np.uint8)]), 0, (1,))
    few = size <= 8
    n = size[few]
    out[few] = mix(mix((eight[start[few]] & _LOW[n]) ^ (n.astype(U) * U(0x9E3779B97F4A7C15))) + U(1))
    many = np.flatnonzero(~few)
    if len(many):
        raw, digest = t.data.tobytes(), xxhash.xxh3_64_intdigest
        out[many] = np.fromiter((digest(raw[a:b]) for a, b in zip(start[many].tolist(), end[many].tolist())), U, len(many))
    return out


def owners(first: np.ndarray) -> np.ndarray:
    """For each item, the index of the text that holds it."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def multipliers(k: int, seed: int) -> np.ndarray:
    """Odd multipliers, one for each place in an n-gram of items."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, k + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


def grams(h: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Hashes of every k consecutive items, across texts too: see inside()."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j, m in enumerate(multipliers(k, seed)):
        out += h[j : j + n] * m
    return mix(out)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """For each k-gram of grams(): whether its items are of one text."""
    own = owners(first)
    n = len(own) - k + 1
    return own[:n] == own[k - 1 :] if n > 0 else np.zeros(0, bool)


def kept_texts(t: Texts, start: np.ndarray, end: np.ndarray, first: np.ndarray, keep: np.ndarray, glue: str) -> pa.Array:
    """Of each text the items kept, joined by glue (one byte). At least one byte lies between two items of a text."""
    at, own = np.flatnonzero(keep), owners(first)[keep]
    last = np.ones(len(at), bool)
    last[:-1] = own[1:] != own[:-1]
    data, edge = t.data.copy(), np.zeros(len(t.data) + 2, np.int8)
    data[end[at[~last]]] = ord(glue)
    np.add.at(edge, start[at], 1)
    np.add.at(edge, end[at] + ~last, -1)
    stay = np.cumsum(edge[: len(data)], dtype=np.int8) > 0
    off = np.concatenate([[0], np.cumsum(stay)])[t.off]
    return pa.Array.from_buffers(pa.large_string(), t.n, [None, pa.py_buffer(off.astype("<i8")), pa.py_buffer(data[stay])])


def slices(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about limit bytes of text."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def scan(df: DataFrame, make: Callable, schema: str, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow over df, a bounded run of rows at a time. make() is called in each task and gives the function that
    turns a record batch and its Texts into columns in the schema's order. Columns named in carry follow unchanged, where there
    is one output row for each input row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    fields = StructType([*_parse_datatype_string(schema).fields, *[df.schema[c] for c in carry]])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, powers = make(), Powers()
        for batch in batches:
            for part in slices(batch, text):
                columns = [*work(part, Texts(part.column(text), powers)), *[part.column(c) for c in carry]]
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, fields)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
