"""Quality bit-fields as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATE_ALGORITHMS = ("strict", "cloud_state", "cloud_only", "binned", "internal")
FILL_LEVEL = 99


def bit_field(value: Column, start: int, width: int) -> Column:
    """The unsigned number in bits start .. start + width - 1."""
    return F.shiftright(value, start).bitwiseAND((1 << width) - 1)


def range_mask(start: int, end: int) -> int:
    return (1 << (end + 1)) - (1 << start)


def reflectance_bad(qc: Column) -> Column:
    """True unless overall quality (bits 0-1) and both band qualities (2-3, 4-5) are ideal."""
    return qc.bitwiseAND(range_mask(0, 5)) != 0


def state_cloud(state: Column, algorithm: str = "strict") -> Column:
    """Cloud by the 1 km state word under one of STATE_ALGORITHMS."""
    cloud, internal = bit_field(state, 0, 2), bit_field(state, 10, 1) == 1
    by = {
        "cloud_state": cloud.isin(1, 2),
        "cloud_only": cloud == 1,
        "binned": cloud.isin(2, 3),
        "internal": internal,
        "strict": cloud.isin(1, 2) | (bit_field(state, 2, 1) == 1) | (bit_field(state, 6, 2) >= 2) | (bit_field(state, 8, 1) == 1) | internal,
    }
    if algorithm not in by:
        raise ValueError(f"algorithm must be one of {STATE_ALGORITHMS}")
    return by[algorithm]


def level_cloud(level: Column) -> Column:
    """Cloud by a four-level flag (0 cloudy .. 3 clear); fill counts as clear."""
    return (level != FILL_LEVEL) & (level < 2)


def level_cloud_or_fill(level: Column) -> Column:
    """The same with fill as cloud, as the smoother wants it."""
    return (level == FILL_LEVEL) | (level < 2)


def swath_level(first_byte: Column) -> Column:
    """The four-level flag in bits 1-2 of a swath's first byte."""
    return bit_field(first_byte, 1, 2)


def keep_reflectance(qc: Column) -> Column:
    """The word itself where quality is ideal, else null."""
    return F.when(qc.bitwiseAND(range_mask(0, 5)) == 0, qc)


def keep_state(state: Column) -> Column:
    """The word itself for clear land with low aerosol and without shadow, cirrus, internal cloud or snow, else null."""
    mask = range_mask(0, 8) | 1 << 10 | 1 << 12
    return F.when(state.bitwiseAND(mask) == (0b001 << 3 | 0b01 << 6), state)


def leaf_bad(qc: Column) -> Column:
    """Leaf-area quality: main algorithm not used (bit 0) or cloud state not clear (bits 4-5)."""
    return (bit_field(qc, 0, 1) != 0) | (bit_field(qc, 4, 2) != 0)


def decoded(band: Column, word: Column) -> Column:
    """Bad or cloudy, by kind of band: qc, state, cloud_mask; null for other bands."""
    return F.when(band == "qc", reflectance_bad(word)).when(band == "state", state_cloud(word)).when(band == "cloud_mask", level_cloud(word))
