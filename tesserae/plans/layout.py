"""Image layouts from shapes: which axes are frames, depth, rows, columns and samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Capability flags by name.
CAPS = {n: 1 << i for i, n in enumerate("uint sint float complex bool sz1 sz2 sz4 sz8 sz16 gray rgb palette cmyk ycbcr alpha extra frames depth planar bps".split())}
SAMPLES = {"gray": 1, "palette": 1, "rgb": 3, "ycbcr": 3, "cielab": 3, "cmyk": 4}


@dataclass(frozen=True)
class Layout:
    frames: int
    depth: int
    height: int
    width: int
    samples: int
    sampleformat: str
    bitspersample: int
    itemsize: int
    photometric: str
    planar: bool
    extraindex: int
    extratype: str
    extracount: int


def image_layout(shape: tuple[int, ...], dtype: str, caps: int = 0, photometric: str | None = None, bitspersample: int | None = None, planar: bool = False, frames: bool | None = None, volumetric: bool = False, extrasample: str | None = None) -> Layout:
    dt = np.dtype(dtype)
    form = {"u": "uint", "i": "sint", "f": "float", "c": "complex", "b": "bool"}[dt.kind]
    n, least = len(shape), 4 if volumetric else 3
    if n == 0:
        raise ValueError("no dimensions")
    if planar and n < 3 or volumetric and n < 3:
        raise ValueError("planar and volumetric images have three dimensions at least")
    hint = SAMPLES.get(photometric) if photometric else None
    if n < 3:
        channels = False
    elif planar:
        channels = True
    elif n > least:
        channels = not (hint == 1 and not extrasample and shape[-1] != 1)
    elif n < least:
        channels = False
    elif hint == 1 and not extrasample or frames is True:
        channels = False
    elif frames is False or hint or extrasample:
        channels = True
    elif caps and not caps & CAPS["frames"]:
        channels = True
    else:
        channels = shape[-1] <= 4
    samples, depth, rest = 1, 1, list(shape)
    if n == 1:
        height, width, rest = 0, shape[0], []
    else:
        if channels and not planar:
            samples = rest.pop()
        height, width = rest[-2:]
        rest = rest[:-2]
        if volumetric:
            depth = rest.pop()
        if channels and planar:
            samples = rest.pop()
    photo = photometric
    if photo is None:
        color = form == "uint" and dt.itemsize <= 2 or form == "float" and dt.itemsize <= 8
        photo = "rgb" if not planar and color and (samples in (3, 4) or samples > 4 and extrasample) else "gray"
    extra = samples - SAMPLES[photo]
    if extra < 0:
        raise ValueError("fewer samples than the photometric interpretation has")
    kind = extrasample or ("unassalpha" if extra == 1 else "unspecified" if extra else "none")
    bits = bitspersample or (1 if form == "bool" else dt.itemsize * 8)
    if caps:
        size = f"sz{dt.itemsize}"
        alpha = extra and kind in ("unassalpha", "assocalpha")
        needed = [form, size, photo, *(["frames"] if int(np.prod(rest)) > 1 else []), *(["alpha"] if alpha else []), *(["extra"] if extra > bool(alpha) else []), *(["planar"] if planar else []), *(["depth"] if volumetric else []), *(["bps"] if bits != dt.itemsize * 8 and form != "bool" else [])]
        for name in needed:
            if not caps & CAPS.get(name, 0):
                raise ValueError(f"{name} is not supported")
    return Layout(int(np.prod(rest)) if rest else 1, depth, height, width, samples, form, bits, dt.itemsize, photo, planar, SAMPLES[photo] if extra else 0, kind, extra)
