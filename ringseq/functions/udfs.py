"""The kernels as UDFs on Arrow arrays. Each is marked nondeterministic, so a filter on its output doesn't run it twice;
filters on its input have to stand before it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from . import frames, kernels


def _each(s: pa.Array, f: Callable[[bytes], object], kind: pa.DataType) -> pa.Array:
    return pa.array([None if x is None else f(x) for x in s.cast(pa.binary()).to_pylist()], kind)


@F.arrow_udf(StringType())
def _lmsr(s: pa.Array) -> pa.Array:
    return _each(s, kernels.lmsr, pa.binary()).cast(pa.string())


@F.arrow_udf(IntegerType())
def _lmsr_index(s: pa.Array) -> pa.Array:
    return _each(s, kernels.lmsr_index, pa.int32())


@F.arrow_udf(StringType())
def _canonical(s: pa.Array) -> pa.Array:
    return _each(s, kernels.canonicalize, pa.binary()).cast(pa.string())


lmsr, lmsr_index, canonical = (f.asNondeterministic() for f in (_lmsr, _lmsr_index, _canonical))


def monomer_end(config: kernels.Monomerizer, sensitive: bool = False):
    """A UDF from a normalized sequence to its monomer's end; null where there is no overlap, and for null."""

    @F.arrow_udf("int")
    def f(s: pa.Array) -> pa.Array:
        return _each(s, config.end_sensitive if sensitive else config.end, pa.int32())

    return f.asNondeterministic()


def codon_positions(start_codons: tuple[str, ...], stop_codons: tuple[str, ...]):
    """A UDF from a normalized sequence to the places of both kinds of codons on the circle."""

    @F.arrow_udf("starts array<int>, stops array<int>")
    def f(s: pa.Array) -> pa.Array:
        return frames.places(s, start_codons, stop_codons)

    return f.asNondeterministic()


def reading_frames(start_codons: tuple[str, ...], stop_codons: tuple[str, ...], strands: str | None = None, **limits):
    """A UDF from a normalized sequence to its frames after the limits of frames.frames, with the field reverse where strands are chosen.

    All of a sequence's frames stay in its row: no shuffle, and no more than one frame for each of its bases and strands.
    """
    own = "start:int,stop:int,wraps:int,length:int"

    @F.arrow_udf(f"array<struct<{'reverse:boolean,' * bool(strands)}{own}>>")
    def f(s: pa.Array) -> pa.Array:
        found = frames.frames(s, start_codons, stop_codons, strands or "+", **limits)
        if strands:
            return found
        rows = found.values
        names = ["start", "stop", "wraps", "length"]
        return pa.ListArray.from_arrays(found.offsets, pa.StructArray.from_arrays([pc.struct_field(rows, n) for n in names], names))

    return f.asNondeterministic()
