"""Trigger-word predicates, names and clock arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def word(trigger: Column) -> Column:
    """Unsigned 32-bit view of a (possibly negative) trigger word."""
    return trigger.cast("long").bitwiseAND(F.lit(K.WORD_MASK))


def acquisition(trigger: Column) -> Column:
    return word(trigger).bitwiseAND(F.lit(K.ACQ_MASK))


def is_pedestal(trigger: Column) -> Column:
    return acquisition(trigger).isin(112, 128)


def is_forced(trigger: Column) -> Column:
    return acquisition(trigger).isin(16, 32)


def is_clock(trigger: Column) -> Column:
    return acquisition(trigger).isin(48, 64)


def is_test_pulse(trigger: Column) -> Column:
    return acquisition(trigger).isin(80, 96, 144, 160, 176)


def is_physics(trigger: Column) -> Column:
    return (acquisition(trigger) == 0) & (word(trigger).bitwiseAND(F.lit(K.PHYSICS_BITS)) != 0)


def describe(trigger: Column) -> Column:
    """Names of the set bits joined by ``|``; ``none`` when nothing is set."""
    w = word(trigger)
    acq = w.bitwiseAND(F.lit(K.ACQ_MASK))
    src = w.bitwiseAND(F.lit(K.CALIB_SOURCE_MASK))
    known = K.ACQ_MASK + K.CALIB_SOURCE_MASK + sum(b for b, _ in K.FLAG_NAMES)
    rest = w.bitwiseAND(F.lit(K.WORD_MASK - known))
    names = F.create_map(*[F.lit(v) for kv in K.ACQ_NAMES.items() for v in kv])
    parts = [F.when(w.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in K.FLAG_NAMES]
    parts.append(F.when(acq != 0, F.coalesce(names[acq.cast("int")], F.concat(F.lit("Acq0x"), F.lower(F.hex(acq))))))
    parts.append(F.when(src != 0, F.concat(F.lit("CalibSource0x"), F.lower(F.hex(src)))))
    parts.append(F.when(rest != 0, F.concat(F.lit("0x"), F.lower(F.hex(rest)))))
    text = F.concat_ws("|", *parts)          # concat_ws leaves nulls out
    return F.when(text == "", F.lit("none")).otherwise(text)


def wall_seconds(unix: Column, micros: Column, nanos: Column) -> Column:
    return unix + micros * 1e-6 + nanos * 1e-9


def ticks_to_us(ticks: Column) -> Column:
    return ticks * K.TICK_US


def ticks_to_ns(ticks: Column) -> Column:
    return ticks * 25


def unpack_cable(w: Column) -> Column:
    """Cable number of a packed hit word."""
    return w.bitwiseAND(F.lit(4095))


def unpack_n_waveforms(w: Column) -> Column:
    """Number of waveforms of a packed hit word."""
    return F.shiftright(w, 12).bitwiseAND(F.lit(7))
