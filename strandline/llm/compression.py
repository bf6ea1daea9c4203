"""Quality rules by compression bands: zstandard ratios of whole texts and of fixed chunks against limits by length.

Short texts carry the frame and an empty dictionary, so their ratio lies higher: every length has a band of its own.
Below its band a text is repetitive, above it is incompressible (keys, encoded bytes, random characters).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import free

#: (bytes below which a band holds, least ratio, greatest ratio); the last holds for all longer texts. Under 128 bytes the frame outweighs the text, so nothing is called incompressible.
BANDS = (
    (128, 0.55, float("inf")), (256, 0.48, 1.05), (512, 0.47, 0.95), (1024, 0.44, 0.85), (2048, 0.41, 0.80),
    (4096, 0.39, 0.75), (8192, 0.37, 0.72), (16384, 0.36, 0.70), (float("inf"), 0.30, 0.70),
)
#: Bytes of a chunk; a rest of under half a chunk stays with the chunk before it.
CHUNK = 2048
#: Part of the bytes in chunks out of band from which a text is rejected.
SHARE = 0.25

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FIELDS = [*(pa.field(n, pa.int64()) for n in _MEASURES), pa.field("ratio", pa.float64()), pa.field("bad_share", pa.float64()), pa.field("in_band", pa.bool_())]
SCHEMA = "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, ratio: double, bad_share: double, in_band: boolean>"


def repeat_words(words: list[bytes], n: int = 3) -> int:
    """Words that stand in a window of n words which the text has twice or more, the first included."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    windows, many = codes[: len(codes) - n + 1], len(ids)
    for k in range(1, n):
        windows = np.unique(windows, return_inverse=True)[1] * many + codes[k : len(codes) - n + 1 + k]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[which] > 1)
    covered = np.zeros(len(codes), bool)
    for k in range(n):
        covered[starts + k] = True
    return int(covered.sum())


def in_band(size: int, ratio: float, bands: tuple = BANDS) -> bool:
    """Whether a ratio lies within the limits for texts of that many bytes."""
    low, high = next((a, b) for below, a, b in bands if size < below)
    return low <= ratio <= high


def verdict(data: bytes, pack: zstandard.ZstdCompressor, bands: tuple = BANDS, chunk: int = CHUNK, share: float = SHARE) -> tuple[float, float, bool]:
    """Ratio of the whole text, part of its bytes in chunks out of band, and whether it passes. An empty text passes with ratio 1."""
    if not data:
        return 1.0, 0.0, True
    ratio = len(pack.compress(data)) / len(data)
    starts = list(range(0, max(1, len(data) - chunk // 2), chunk))
    bad = 0
    if len(starts) > 1:
        for lo, hi in zip(starts, [*starts[1:], len(data)], strict=True):
            if not in_band(hi - lo, len(pack.compress(data[lo:hi])) / (hi - lo), bands):
                bad += hi - lo
    return ratio, bad / len(data), in_band(len(data), ratio, bands) and bad < share * len(data)


def _measured(name: str, text: str, bands: tuple, chunk: int, share: float, level: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=level, write_content_size=False)
        for batch in batches:
            out: list[list] = [[] for _ in _FIELDS]
            for value in batch.column(text):
                whole = value.as_py() or ""
                data = whole.encode()
                words, seen, copies = data.split(), set(), 0
                for line in data.split(b"\n"):
                    if line.strip(_SPACE):
                        copies += line in seen
                        seen.add(line)
                row = (
                    len(words), len(whole) - len(data) + len(data.translate(None, _SPACE)), len(data) - len(data.translate(None, _SYMBOLS)), copies, repeat_words(words),
                    *verdict(data, pack, bands, chunk, share),
                )
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FIELDS, strict=True)], fields=_FIELDS)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, name])

    return measure


def measured(docs: DataFrame, name: str = "bands", text: str = "text", bands: tuple = BANDS, chunk: int = CHUNK, share: float = SHARE, level: int = 3) -> DataFrame:
    """docs with a struct `name`: counts of words and repeats, ratio, bad_share and in_band, the method's verdict.

    Words are runs of anything but 0x20 and 0x09-0x0D, as written. A null text counts as empty: counts 0, in band.
    Texts are taken whole, one at a time; equal rows give equal results; other columns come through unchanged.
    """
    (column,) = free(docs, name)
    found = docs.mapInArrow(_measured(column, text, bands, chunk, share, level), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `{column}` {SCHEMA}")
    return found if column == name else found.withColumnRenamed(column, name)


def base_failed(measures: str) -> F.Column:
    """The plain rules: under 50 words, or more than half of the words in repeated windows."""
    of = lambda c: F.col(f"{measures}.{c}")
    return (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words"))


def kept(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows that pass the plain rules and the compression bands."""
    (name,) = free(docs, "_bands")
    return measured(docs, name, text).where(~base_failed(name) & F.col(f"{name}.in_band")).select(*docs.columns)
