"""WAV files as columns: `decoded` turns a binary column into format and samples; what follows is expressions (`signal.canonical`)."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format: tags of floats and of extended headers.
FLOAT, EXTENDED = 3, 0xFFFE
DECODED = T.StructType().add("tag", "integer").add("channels", "integer").add("rate", "long").add("bits", "integer").add("pcm", T.ArrayType(T.DoubleType())).add("reject", "string")


def _chunks(raw: bytes) -> tuple[bytes | None, bytes]:
    """Bodies of the last format and data chunks; chunks of other names are passed over. Raises ValueError for a chunk that ends behind the file."""
    form, data, at = None, b"", 12
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        end = at + 8 + size
        if end + (size % 2 if name != b"data" else 0) > len(raw):
            raise ValueError(f"chunk {name.decode('latin-1')!r} ends behind the file")
        if name == b"fmt ":
            form = raw[at + 8 : end]
        elif name == b"data":
            data = raw[at + 8 : end]
        at = end + size % 2
    return form, data


def _samples(data: bytes, floats: bool, bits: int) -> np.ndarray:
    """Interleaved samples in [-1, 1); floats as they are."""
    width = (bits + 7) // 8
    data = data[: len(data) // width * width]
    if floats and bits in (32, 64):
        return np.frombuffer(data, f"<f{width}").astype(float)
    if floats or not (bits == 8 or 2 <= width <= 4):
        raise ValueError(f"{'floats' if floats else 'integers'} of {bits} bits")
    if width == 1:
        return (np.frombuffer(data, np.uint8) - 128.0) / 128
    padded = np.zeros((len(data) // width, 4), np.uint8)
    padded[:, 4 - width :] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return (padded.view("<i4")[:, 0] >> 8 * (4 - width)) / 2.0 ** (8 * width - 1)


def _one(raw: bytes | None) -> tuple:
    tag = channels = rate = bits = pcm = None
    try:
        if not raw:
            raise ValueError("empty file")
        if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
            raise ValueError("no RIFF/WAVE file")
        form, data = _chunks(raw)
        if form is None:
            raise ValueError("no format chunk")
        if len(form) < 16:
            raise ValueError("format chunk of under 16 bytes")
        tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", form)
        if tag == EXTENDED and len(form) < 40:
            raise ValueError("extended format chunk of under 40 bytes")
        kind = int.from_bytes(form[24:26], "little") if tag == EXTENDED else tag
        if not channels or not bits or not rate:
            raise ValueError("no channels, bits or rate")
        pcm = _samples(data, kind == FLOAT, bits)
    except ValueError as e:
        return tag, channels, rate, bits, None, str(e)
    return tag, channels, rate, bits, pcm, None


@F.pandas_udf(DECODED)
def _decoded(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_one(raw) for raw in content], columns=["tag", "channels", "rate", "bits", "pcm", "reject"]).astype(object)


def decoded(content: Column) -> Column:
    """struct(tag, channels, rate, bits, pcm, reject) of a file's bytes: pcm holds interleaved samples, or reject says why there are none. A file without a data chunk has no samples and is no reject."""
    return _decoded(content)
