"""ICC profiles by matrices and curves, and colour transforms between them. Profiles by tables of many dimensions are not
read."""

from __future__ import annotations

import struct

import numpy as np

from tesserae.operators.compressors import CodecError

# The connection white, the white of daylight (x, y), and primaries of two colour spaces (x, y of each).
D50 = np.array([0.9642, 1.0, 0.8249])
D65 = (0.3127, 0.3290)
SRGB = (0.64, 0.33, 0.30, 0.60, 0.15, 0.06)
ADOBE = (0.64, 0.33, 0.21, 0.71, 0.15, 0.06)
#: Exponent, and a, b, c, d of the curve of sRGB.
SRGB_CURVE = (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])
SPACES = {"gray": b"GRAY", "rgb": b"RGB ", "xyz": b"XYZ ", "lab": b"Lab "}
SAMPLES = {"gray": 1, "graya": 2, "rgb": 3, "rgba": 4, "xyz": 3, "lab": 3}


def _pairs(values, n: int) -> list[tuple[float, float, float]]:
    """Chromaticities given as x, y, Y; as x, y; or as numerators and denominators of x and y."""
    values, per = [float(v) for v in values], len(values) // n
    if len(values) != per * n or per not in (2, 3, 4):
        raise ValueError(f"{len(values)} values for {n} chromaticities")
    rows = [values[i : i + per] for i in range(0, len(values), per)]
    return [(r[0] / r[1], r[2] / r[3], 1.0) if per == 4 else (r[0], r[1], r[2] if per == 3 else 1.0) for r in rows]


def _xyz(x: float, y: float, luminance: float = 1.0) -> np.ndarray:
    return np.array([x / y, 1.0, (1 - x - y) / y]) * luminance


def _adapted(white: np.ndarray) -> np.ndarray:
    """Bradford's matrix from a white to the connection white."""
    return np.linalg.inv(BRADFORD) @ np.diag((BRADFORD @ D50) / (BRADFORD @ white)) @ BRADFORD


def _fixed(*values: float) -> bytes:
    return struct.pack(f">{len(values)}i", *[round(v * 65536) for v in values])


def _curve(transfer, gamma: float | None) -> bytes:
    if gamma is not None:
        return b"para" + bytes(4) + struct.pack(">HH", 0, 0) + _fixed(gamma)
    if transfer is None:
        return b"curv" + bytes(4) + struct.pack(">I", 0)
    table = np.asarray(transfer)
    if table.dtype not in (np.uint16, np.float32) or table.ndim != 1:
        raise ValueError("a transfer function is a row of 16-bit integers or 32-bit floats")
    table = np.rint(np.clip(table, 0, 1) * 65535).astype(">u2") if table.dtype == np.float32 else table.astype(">u2")
    return b"curv" + bytes(4) + struct.pack(">I", len(table)) + table.tobytes()


def cms_profile(profile: str | None, whitepoint=None, primaries=None, transferfunction=None, gamma: float | None = None) -> bytes:
    """gray, rgb, srgb, adobergb, linearrgb, xyz, lab2, lab4 or null (None). rgb without primaries has those of sRGB; white
    is daylight, or the connection white of gray."""
    name = (profile or "null").lower()
    if name not in ("gray", "rgb", "srgb", "adobergb", "linearrgb", "xyz", "lab2", "lab4", "null"):
        raise ValueError(f"no profile {profile!r}")
    if gamma is not None and transferfunction is not None:
        raise ValueError("a gamma or a transfer function")
    if name not in ("gray", "rgb") and (gamma is not None or transferfunction is not None):
        raise ValueError("only gray and rgb take a curve")
    tags: dict[bytes, bytes] = {b"desc": b"desc" + bytes(4) + struct.pack(">I", len(name) + 1) + name.encode() + bytes(79), b"cprt": b"text" + bytes(4) + b"none\0"}
    place = lambda v: b"XYZ " + bytes(4) + _fixed(*v)
    tags[b"wtpt"] = place(D50)
    if name in ("rgb", "srgb", "adobergb", "linearrgb"):
        white = _pairs(whitepoint, 1)[0] if whitepoint is not None else (*D65, 1.0)
        three = _pairs(primaries if primaries is not None else ADOBE if name == "adobergb" else SRGB, 3)
        columns = np.stack([_xyz(x, y) for x, y, _ in three], 1)
        adapt = _adapted(_xyz(*white[:2]))
        colors = adapt @ (columns * np.linalg.solve(columns, _xyz(*white[:2])))
        tags[b"chad"] = b"sf32" + bytes(4) + _fixed(*adapt.ravel())
        for i, c in enumerate(b"rgb"):
            tags[bytes([c]) + b"XYZ"] = place(colors[:, i])
            if name == "srgb":
                curve = b"para" + bytes(4) + struct.pack(">HH", 3, 0) + _fixed(*SRGB_CURVE)
            elif name == "adobergb":
                curve = _curve(None, 2.19921875)
            elif name == "linearrgb":
                curve = _curve(None, 1.0)
            else:
                own = None if transferfunction is None else np.asarray(transferfunction)
                if own is not None and (own.ndim not in (1, 2) or own.ndim == 2 and len(own) != 3):
                    raise ValueError("one transfer function, or three")
                curve = _curve(own if own is None or own.ndim == 1 else own[i], gamma)
            tags[bytes([c]) + b"TRC"] = curve
    elif name == "gray":
        tags[b"kTRC"] = _curve(transferfunction, gamma)
        if whitepoint is not None:
            tags[b"wtpt"] = place(_xyz(*_pairs(whitepoint, 1)[0][:2]))
    space = SPACES["rgb" if name.endswith("rgb") else "lab" if name.startswith("lab") else name if name in SPACES else "gray"]
    kind = b"mntr" if name.endswith("rgb") or name == "gray" else b"abst"
    table, body, places = [], bytearray(), {}
    begin = 132 + 12 * len(tags)
    for tag, data in tags.items():
        if data not in places:
            places[data] = begin + len(body)
            body += data + bytes(-len(data) % 4)
        table.append(tag + struct.pack(">II", places[data], len(data)))
    size = begin + len(body)
    pcs = b"Lab " if name.startswith("lab") else b"XYZ "
    version = 0x02100000 if name == "lab2" else 0x04400000
    head = struct.pack(">I4sI4s4s4s12s4s", size, b"\0\0\0\0", version, kind, space, pcs, bytes(12), b"acsp") + bytes(28) + _fixed(*D50)
    return head.ljust(128, b"\0") + struct.pack(">I", len(tags)) + b"".join(table) + bytes(body)


class Profile:
    """space, matrix (to connection XYZ), and curves of a profile."""

    def __init__(self, data: bytes):
        if len(data) < 132 or data[36:40] != b"acsp" or int.from_bytes(data[:4], "big") > len(data):
            raise CodecError("not an ICC profile")
        self.space = {v: k for k, v in SPACES.items()}.get(data[16:20])
        tags = {}
        for i in range(int.from_bytes(data[128:132], "big")):
            row = data[132 + 12 * i : 144 + 12 * i]
            if len(row) < 12:
                raise CodecError("a damaged table of tags")
            at, n = struct.unpack(">II", row[4:])
            if at + n > len(data):
                raise CodecError("a tag beyond the end")
            tags[row[:4]] = data[at : at + n]
        self.tags = tags
        self.curves, self.matrix = [], np.eye(3)
        if self.space == "rgb" and b"rXYZ" in tags:
            self.matrix = np.array([struct.unpack_from(">3i", tags[c + b"XYZ"], 8) for c in (b"r", b"g", b"b")]).T / 65536
            self.curves = [_read_curve(tags[c + b"TRC"]) for c in (b"r", b"g", b"b")]
        elif self.space == "gray":
            self.curves = [_read_curve(tags[b"kTRC"]) if b"kTRC" in tags else (lambda v: v, lambda v: v)]
        elif self.space not in ("xyz", "lab"):
            raise NotImplementedError("profiles without matrix and curves")


def _read_curve(tag: bytes):
    """The curve to light and back."""
    if tag[:4] == b"para":
        kind = struct.unpack_from(">H", tag, 8)[0]
        p = [v / 65536 for v in struct.unpack_from(f">{(len(tag) - 12) // 4}i", tag, 12)]
        g, a, b, c, d, e, f = {0: lambda: (p[0], 1, 0, 0, 0, 0, 0), 1: lambda: (p[0], p[1], p[2], 0, -p[2] / p[1], 0, 0), 2: lambda: (p[0], p[1], p[2], 0, -p[2] / p[1], p[3], p[3]), 3: lambda: (*p[:5], 0, 0), 4: lambda: tuple(p[:7])}[kind]()
        bend = max(a * d + b, 0) ** g + e
        there = lambda v: np.where(v >= d, np.maximum(a * v + b, 0) ** g + e, c * v + f)
        return there, lambda y: np.where(y >= bend, (np.maximum(y - e, 0) ** (1 / g) - b) / a, (y - f) / (c or 1))
    n = struct.unpack_from(">I", tag, 8)[0]
    if n == 0:
        return (lambda v: v), (lambda v: v)
    if n == 1:
        g = struct.unpack_from(">H", tag, 12)[0] / 256
        return (lambda v: np.maximum(v, 0) ** g), (lambda y: np.maximum(y, 0) ** (1 / g))
    table = np.frombuffer(tag, ">u2", n, 12) / 65535
    x = np.linspace(0, 1, n)
    rising = np.maximum.accumulate(table)
    return (lambda v: np.interp(v, x, table)), (lambda y: np.interp(y, rising, x))


def _profile(p) -> Profile:
    return Profile(cms_profile(p) if isinstance(p, str) else bytes(p))


def cms_profile_validate(profile: bytes) -> None:
    """Raises CodecError if the profile can't be read."""
    data = bytes(profile)
    try:
        Profile(data)
    except NotImplementedError:
        pass


def _to_xyz(p: Profile, v: np.ndarray) -> np.ndarray:
    if p.space == "gray":
        return p.curves[0][0](v) * D50
    if p.space == "rgb":
        return np.stack([c[0](v[..., i]) for i, c in enumerate(p.curves)], -1) @ p.matrix.T if p.curves else v @ p.matrix.T
    if p.space == "lab":
        fy = (v[..., 0] + 16) / 116
        f = np.stack([fy + v[..., 1] / 500, fy, fy - v[..., 2] / 200], -1)
        return np.where(f > 6 / 29, f**3, (f - 4 / 29) * 108 / 841) * D50
    return v


def _from_xyz(p: Profile, xyz: np.ndarray) -> np.ndarray:
    if p.space == "gray":
        return p.curves[0][1](xyz[..., 1:2])
    if p.space == "rgb":
        light = xyz @ np.linalg.inv(p.matrix).T
        return np.stack([c[1](light[..., i]) for i, c in enumerate(p.curves)], -1) if p.curves else light
    if p.space == "lab":
        t = xyz / D50
        f = np.where(t > 216 / 24389, np.cbrt(t), t * 841 / 108 + 4 / 29)
        return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)
    return xyz


def cms_transform(x: np.ndarray, profile, outprofile, colorspace: str | None = None, planar: bool = False, outcolorspace: str | None = None, outplanar: bool = False, outdtype: str | None = None) -> np.ndarray:
    """An array from one profile to another (bytes, or the name of one that cms_profile makes). Integers cover 0 to 1;
    floats of xyz and lab are as they are. Alpha is copied; where there is none, it is full. Light outside the range of
    integers is cut."""
    source, target = _profile(profile), _profile(outprofile)
    space = colorspace or source.space
    out_space = outcolorspace or target.space
    for p, s in ((source, space), (target, out_space)):
        if s not in SAMPLES or s.removesuffix("a") != p.space:
            raise ValueError(f"{s} with a profile of {p.space}")
    kind, out_kind = x.dtype, np.dtype(outdtype or x.dtype)
    if kind.kind not in "uf" or out_kind.kind not in "uf" or {"xyz", "lab"} & {space if kind.kind == "u" else "", out_space if out_kind.kind == "u" else ""}:
        raise ValueError("samples are unsigned integers or floats; xyz and lab are floats")
    v = x.astype(np.float64) / (np.iinfo(kind).max if kind.kind == "u" else 1)
    n = SAMPLES[space]
    v = v[..., None] if n == 1 else np.moveaxis(v, -3, -1) if planar else v
    if v.shape[-1] != n:
        raise ValueError(f"{space} takes {n} samples")
    bare = n - space.endswith("a")
    alpha = v[..., bare:] if space.endswith("a") else np.ones((*v.shape[:-1], 1))
    out = _from_xyz(target, _to_xyz(source, v[..., :bare]))
    if out_space.endswith("a"):
        out = np.concatenate([out, alpha], -1)
    if out_kind.kind == "u":
        top = np.iinfo(out_kind).max
        out = np.rint(np.clip(out, 0, 1) * top)
    out = out.astype(out_kind)
    return out[..., 0] if SAMPLES[out_space] == 1 else np.ascontiguousarray(np.moveaxis(out, -1, -3)) if outplanar else out


def cms_decode(x: np.ndarray, profile, outprofile, colorspace: str | None = None, planar: bool = False, outcolorspace: str | None = None, outplanar: bool = False, outdtype: str | None = None, indtype: str | None = None) -> np.ndarray:
    """Back from the second profile to the first."""
    return cms_transform(x, outprofile, profile, outcolorspace, outplanar, colorspace, planar, indtype or outdtype)
