"""Column functions on sequences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_seq(c: Column) -> Column:
    """Upper case, trimmed, T as U."""
    return F.translate(F.upper(F.trim(c)), "T", "U")


def t2u(c: Column) -> Column:
    """T as U, t as u."""
    return F.translate(c, "Tt", "Uu")


def clean_aligned(c: Column) -> Column:
    """An aligned row over A, C, G, U and '-'; every other symbol is a gap."""
    return F.regexp_replace(F.translate(F.upper(c), "T", "U"), "[^ACGU-]", "-")


def record_id(header: Column) -> Column:
    """First word of a header."""
    return F.element_at(F.split(F.ltrim(header), r"\s+"), 1)


def symbol_count(c: Column, symbol: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(symbol), F.lit("")))


def base_counts(c: Column, symbols: str = "ACGUN") -> dict[str, Column]:
    return {s: symbol_count(c, s) for s in symbols}


def gc_count(c: Column) -> Column:
    return symbol_count(c, "G") + symbol_count(c, "C")


def length_band(length: Column, bounds: Sequence[int]) -> Column:
    """Label of the half-open band [lo, hi) that holds `length`; the last band is open."""
    out = F.lit(f"{bounds[-1]}+")
    for lo, hi in reversed(list(zip([0, *bounds[:-1]], bounds, strict=True))):
        out = F.when(length < hi, F.lit(f"{lo}-{hi}")).otherwise(out)
    return out


def valid_alphabet(c: Column, symbols: str = "ACGUN") -> Column:
    return c.rlike(f"^[{symbols}]*$")


def is_deoxy(token: Column, first: int = 5, last: int = 8) -> Column:
    """True for the deoxy tokens, which stand between `first` and `last` in the vocabulary."""
    return token.between(first, last)


def quantized_length(length: Column, q: int) -> Column:
    """Length rounded up to a multiple of q."""
    return (F.ceil(length / F.lit(q)) * q).cast("long")


def kmers(c: Column, k: int) -> Column:
    """Distinct k-mers; shorter sequences have none."""
    places = F.when(F.length(c) >= k, F.sequence(F.lit(1), F.length(c) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(c, i, F.lit(k))))


def span_mask(sequence: Column, key: Column, fraction: float = 0.15, mean_span: float = 3.0, longest: int = 10, least: int = 8, seed: int = 0, symbols: str = "ACGU", mask: str = "#") -> Column:
    """The sequence with spans corrupted: max(1, fraction n) places in geometric spans of up to `longest`, of which
    80 % are masked, 10 % replaced and 10 % left. Draws follow from key and seed alone; sequences under `least`
    symbols come back as they are."""

    @F.pandas_udf("string")
    def corrupt(text: pd.Series, number: pd.Series) -> pd.Series:
        bases = np.frombuffer(symbols.encode(), dtype=np.uint8)

        def one(s: str | None, h: int) -> str | None:
            if s is None or len(s) < least:
                return s
            rnd = np.random.Generator(np.random.PCG64(h & ((1 << 64) - 1)))
            n, want = len(s), max(1, int(fraction * len(s)))
            out, hit = np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8).copy(), np.zeros(len(s), dtype=bool)
            while (lack := want - int(hit.sum())) > 0:
                starts = rnd.integers(0, n, max(1, int(lack / mean_span)))
                spans = np.minimum(rnd.geometric(1 / mean_span, len(starts)), longest)
                places = np.repeat(starts, spans) + np.concatenate([np.arange(x) for x in spans])
                places = places[places < n]
                hit[places[~hit[places]][:lack]] = True
            at = np.flatnonzero(hit)
            what = rnd.random(len(at))
            out[at[what < 0.8]] = ord(mask)
            swap = at[(what >= 0.8) & (what < 0.9)]
            out[swap] = bases[rnd.integers(0, len(bases), len(swap))]
            return out.tobytes().decode()

        return pd.Series([one(s, h) for s, h in zip(text, number, strict=True)])

    return corrupt(sequence, F.xxhash64(key, F.lit(seed)))
