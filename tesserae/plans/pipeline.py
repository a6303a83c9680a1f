"""Chains of codecs as one expression.

A chain is a list of (name, options). Neighbours that undo each other are dropped and the rest is fused, so a chain
crosses to Python once, whatever its length. Its configuration goes to and from JSON.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column

from tesserae.registry import BYTES, CODECS, FILTER, SERIALIZER, _expression, _wanted
from tesserae.schema import from_array, to_array

#: Codecs that undo themselves.
OWN_INVERSE = {"bitorder"}


class Chain:
    def __init__(self, steps: list[tuple[str, dict]]):
        for name, _ in steps:
            if name not in CODECS:
                raise KeyError(name)
        self.steps = [(n, dict(o)) for n, o in steps]

    def to_json(self) -> str:
        return json.dumps([{"name": n, "configuration": o} for n, o in self.steps])

    @classmethod
    def from_json(cls, text: str) -> Chain:
        return cls([(x["name"], x.get("configuration", {})) for x in json.loads(text)])

    def simplified(self) -> Chain:
        out: list = []
        for step in self.steps:
            if step[0] == "none":
                continue
            if out and out[-1] == step and step[0] in OWN_INVERSE:
                out.pop()
            else:
                out.append(step)
        return Chain(out)

    def encode(self, column: Column, on_error: str = "raise") -> Column:
        """From chunks to binary (with their type and shape in front, unless a step writes them)."""
        steps = [(*_wanted(n, "encode"), o) for n, o in self.simplified().steps]

        def run(x):
            head = None
            for codec, f, options in steps:
                if codec.kind == BYTES and not isinstance(x, bytes):
                    x, head = _framed(x)
                x = f(x, **options)
                if codec.kind == SERIALIZER:
                    head = b"\0\0\0\0"
            if not isinstance(x, bytes):
                x, head = _framed(x)
            return (head or b"\0\0\0\0") + x

        return _expression(run, True, False, on_error)(column)

    def decode(self, column: Column, on_error: str = "raise") -> Column:
        """Back to chunks."""
        steps = [(*_wanted(n, "decode"), o) for n, o in reversed(self.simplified().steps)]

        def run(data: bytes):
            n = int.from_bytes(data[:4], "little")
            head, x = json.loads(data[4 : 4 + n]) if n else None, data[4 + n :]
            for codec, f, options in steps:
                if codec.kind == FILTER and isinstance(x, bytes):
                    x = to_array({**head, "data": x})
                x = f(x, **_for_decode(codec.name, options))
            # a codec of whole blocks may fill up the last one
            return to_array({**head, "data": x[: np.dtype(head["dtype"]).itemsize * math.prod(head["shape"])]}) if isinstance(x, bytes) else x

        return _expression(run, False, True, on_error)(column)


def _for_decode(name: str, options: dict) -> dict:
    """Options that a decoder takes too."""
    keep = {"axis", "dist", "delta", "reorder", "itemsize", "blocksize", "header", "raw", "kind", "value", "prepend", "byteorder", "nblock", "shape", "dtype", "bitspersample", "runlen"}
    own = {"aec": {"flags", "rsi"}, "szip": {"options_mask", "pixels_per_block", "bits_per_pixel", "pixels_per_scanline"}, "cms": set(options)}
    return {k: v for k, v in options.items() if k in keep | own.get(name, set()) and not (name in ("lz4h5", "blosc", "blosc2") and k == "blocksize")}


def _framed(x) -> tuple[bytes, bytes]:
    made = from_array(x)
    head = json.dumps({"dtype": made["dtype"], "shape": made["shape"]}).encode()
    return made["data"], len(head).to_bytes(4, "little") + head
