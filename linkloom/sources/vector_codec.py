"""Stored form of legacy vectors: little-endian float32 bytes. Native tables hold ``array<float>``.

Both ways work on the buffers of whole Arrow batches; no vector becomes a Python object.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.ArrayType(T.FloatType()))
def decode_vector(blobs: pa.Array) -> pa.Array:
    """Bytes to floats; a length that is no multiple of four gives NULL."""
    whole = pc.fill_null(pc.equal(pc.bit_wise_and(pc.binary_length(blobs), 3), 0), False)
    sizes = pc.if_else(whole, pc.binary_length(blobs), 0).to_numpy(zero_copy_only=False)
    data = b"".join(blobs.filter(whole).to_pylist()) if not pc.all(whole).as_py() else _bytes(blobs)
    offsets = np.concatenate([[0], np.cumsum(sizes)]) // 4
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(data, "<f4")), mask=pc.invert(whole))


def _bytes(blobs: pa.Array) -> bytes:
    """All bytes of an array without nulls, one value behind the other."""
    offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    return bytes(blobs.buffers()[2] or b"")[offsets[0] : offsets[-1]]


@F.arrow_udf(T.BinaryType())
def encode_vector(vectors: pa.Array) -> pa.Array:
    """Floats to bytes; a missing element becomes NaN."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    values = pc.fill_null(vectors.flatten().cast(pa.float32()), float("nan")).to_numpy(zero_copy_only=False)
    offsets = (np.concatenate([[0], np.cumsum(sizes)]) * 4).astype(np.int32)
    valid = pa.array(vectors.is_valid().to_numpy(zero_copy_only=False)) if vectors.null_count else None
    buffers = [valid.buffers()[1] if valid is not None else None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, "<f4"))]
    return pa.Array.from_buffers(pa.binary(), len(vectors), buffers)
