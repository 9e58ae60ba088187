"""Figures printed near keywords.

The share values of a label claim numbers one after the other (a number taken for one share is not
offered to the next), which is a sequential rule; it runs as an Arrow-batched function on the already
isolated and lower-cased section of each document.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from labelspark import constants as C
from labelspark.functions.batches import in_slices

FIELDS = [*C.SHARE_KEYWORDS, "co2", "waste", "eeg_percentage"]
SCHEMA = T.StructType([T.StructField(f, T.DoubleType()) for f in FIELDS])
_NUMBER = {
    unit: re.compile(r"([0-9]+[.,]?[0-9]*)\s*" + re.escape(unit)) for unit in ("%", "g/kwh", "g / kwh", "mg/kwh", "mg / kwh")
}


def nearest_value(text: str, keywords: list[str], unit: str, claimed: set[int]) -> float | None:
    """The free number with this unit that stands closest to the first keyword offering one.

    Looked at: up to 100 characters behind the keyword (the first free number), and up to 20 before
    it (only the last number).  The nearer one wins, the one behind on equal distance.
    """
    pattern, percent = _NUMBER[unit], unit == "%"

    def usable(position: int, digits: str) -> bool:
        return position not in claimed and not (percent and float(digits) > 100)

    for keyword in keywords:
        at = text.find(keyword)
        if at < 0:
            continue
        end = at + len(keyword)
        offers = []
        for m in pattern.finditer(text[end:end + C.FORWARD_REACH]):
            digits = m.group(1).replace(",", ".")
            if usable(end + m.start(), digits):
                offers.append((m.start(), 0, end + m.start(), float(digits)))
                break
        begin = max(0, at - C.BACKWARD_REACH)
        before = list(pattern.finditer(text[begin:at]))
        if before:
            digits = before[-1].group(1).replace(",", ".")
            if usable(begin + before[-1].start(), digits):
                offers.append((at - begin - before[-1].end(), 1, begin + before[-1].start(), float(digits)))
        if offers:
            _, _, position, value = min(offers)
            claimed.add(position)
            return value
    return None


def _first_nonzero(text: str, attempts: list[tuple[str, list[str]]]) -> float | None:
    claimed: set[int] = set()
    value = None
    for unit, keywords in attempts:
        value = nearest_value(text, keywords, unit, claimed)
        if value:
            break
    return value


def _values(section: str) -> tuple:
    claimed: set[int] = set()
    shares = [nearest_value(section, words, "%", claimed) for words in C.SHARE_KEYWORDS.values()]
    return (*shares, _first_nonzero(section, C.CO2_ATTEMPTS), _first_nonzero(section, C.WASTE_ATTEMPTS),
            _first_nonzero(section, C.EEG_ATTEMPTS))


_ARROW = pa.struct([(f, pa.float64()) for f in FIELDS])


@F.arrow_udf(SCHEMA)
def label_values(section: pa.Array) -> pa.Array:
    return in_slices(section, lambda s: dict(zip(FIELDS, _values(s), strict=True)), _ARROW)
