"""LZ4 blocks in their platform container: a header per block, compressed or as it is, and an end mark."""

from __future__ import annotations

import struct

import pyarrow as pa

# Marks of a compressed block, a stored block and the end.
_BLOCK, _STORED, _END = b"bv41", b"bv4-", b"bv4$"
_CODEC = pa.Codec("lz4_raw")


def compress(data: bytes) -> bytes:
    raw = _CODEC.compress(data, asbytes=True)
    if len(raw) < len(data):
        return _BLOCK + struct.pack("<II", len(data), len(raw)) + raw + _END
    return _STORED + struct.pack("<I", len(data)) + data + _END


def decompress(data: bytes, size: int) -> bytes | None:
    """The `size` bytes that were compressed; None for anything else."""
    out, at = b"", 0
    try:
        while data[at : at + 4] in (_BLOCK, _STORED):
            if data[at : at + 4] == _BLOCK:
                whole, n = struct.unpack_from("<II", data, at + 4)
                out += _CODEC.decompress(data[at + 12 : at + 12 + n], whole, asbytes=True)
                at += 12 + n
            else:
                n = struct.unpack_from("<I", data, at + 4)[0]
                out += data[at + 8 : at + 8 + n]
                at += 8 + n
    except (OSError, struct.error, ValueError):
        return None
    return out if at and len(out) == size else None
