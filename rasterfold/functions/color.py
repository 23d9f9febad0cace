"""Colour mathematics as expressions over columns r, g, b, a (bytes)."""

from __future__ import annotations

import math

from rasterfold.functions.numbers import byte, clamp, from_unit, luma, num, unit

# Colour matrices, five rows of four, for unit channels r, g, b, a and a constant.
MATRICES = {
    "achromatomaly": ((0.618, 0.163, 0.163, 0), (0.320, 0.775, 0.320, 0), (0.062, 0.062, 0.516, 0), (0, 0, 0, 1), (0, 0, 0, 0)),
    "achromatopsia": ((0.299, 0.299, 0.299, 0), (0.587, 0.587, 0.587, 0), (0.114, 0.114, 0.114, 0), (0, 0, 0, 1), (0, 0, 0, 0)),
    "deuteranomaly": ((0.8, 0.258, 0, 0), (0.2, 0.742, 0.142, 0), (0, 0, 0.858, 0), (0, 0, 0, 1), (0, 0, 0, 0)),
    "deuteranopia": ((0.625, 0.7, 0, 0), (0.375, 0.3, 0.3, 0), (0, 0, 0.7, 0), (0, 0, 0, 1), (0, 0, 0, 0)),
    "protanomaly": ((0.817, 0.333, 0, 0), (0.183, 0.667, 0.125, 0), (0, 0, 0.875, 0), (0, 0, 0, 1), (0, 0, 0, 0)),
    "protanopia": ((0.567, 0.558, 0, 0), (0.433, 0.442, 0.242, 0), (0, 0, 0.758, 0), (0, 0, 0, 1), (0, 0, 0, 0)),
    "tritanomaly": ((0.967, 0, 0, 0), (0.033, 0.733, 0.183, 0), (0, 0.267, 0.817, 0), (0, 0, 0, 1), (0, 0, 0, 0)),
    "tritanopia": ((0.95, 0, 0, 0), (0.05, 0.433, 0.475, 0), (0, 0.567, 0.525, 0), (0, 0, 0, 1), (0, 0, 0, 0)),
    "black_white": ((1.5, 1.5, 1.5, 0), (1.5, 1.5, 1.5, 0), (1.5, 1.5, 1.5, 0), (0, 0, 0, 1), (-1, -1, -1, 0)),
    "kodachrome": ((0.7297023, 0, 0, 0), (0, 0.6109577, 0, 0), (0, 0, 0.597218, 0), (0, 0, 0, 1), (0.105, -0.104, -0.02, 0)),
    "lomograph": ((1.5, 0, 0, 0), (0, 1.45, 0, 0), (0, 0, 1.11, 0), (0, 0, 0, 1), (-0.1, 0.05, -0.08, 0)),
    "polaroid": ((1.538, -0.062, -0.262, 0), (-0.022, 1.578, -0.022, 0), (0.216, -0.16, 1.5831, 0), (0, 0, 0, 1), (0.02, -0.05, -0.05, 0)),
}


def _weighted(red: tuple, green: tuple, blue: tuple, alpha: float = 1, offset: float = 0) -> tuple:
    return ((*red, 0), (*green, 0), (*blue, 0), (0, 0, 0, alpha), (offset, offset, offset, 0))


def scale_matrix(amount: float, offset: float = 0, alpha: float = 1) -> tuple:
    return _weighted((amount, 0, 0), (0, amount, 0), (0, 0, amount), alpha, offset)


def contrast_matrix(amount: float) -> tuple:
    return scale_matrix(amount, 0.5 - 0.5 * amount)


def lightness_matrix(amount: float) -> tuple:
    return scale_matrix(1, amount - 1)


def opacity_matrix(amount: float) -> tuple:
    return scale_matrix(1, 0, amount)


def invert_matrix(amount: float) -> tuple:
    return scale_matrix(1 - 2 * amount, amount)


def _toward_identity(rows: tuple, amount: float) -> tuple:
    """The matrix at amount 1, the identity at amount 0."""
    mixed = [tuple(w * amount + (i == j) * (1 - amount) for j, w in enumerate(row)) for i, row in enumerate(rows)]
    return _weighted(*mixed)


def grayscale_matrix(amount: float = 1, mode: str = "bt709") -> tuple:
    weights = {"bt709": (0.2126, 0.7152, 0.0722), "bt601": (0.299, 0.587, 0.114)}[mode]
    return _toward_identity(tuple((w, w, w) for w in weights), amount)


def sepia_matrix(amount: float = 1) -> tuple:
    return _toward_identity(((0.393, 0.349, 0.272), (0.769, 0.686, 0.534), (0.189, 0.168, 0.131)), amount)


def saturate_matrix(amount: float) -> tuple:
    return _toward_identity(tuple((w, w, w) for w in (0.213, 0.715, 0.072)), 1 - amount)


def hue_matrix(degrees: float) -> tuple:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    base, turned = (0.213, 0.715, 0.072), ((-0.213, 0.143, -0.787), (-0.715, 0.140, 0.715), (0.928, -0.283, 0.072))
    rows = [tuple(base[i] + c * ((i == j) - base[i]) + s * turned[i][j] for j in range(3)) for i in range(3)]
    return _weighted(*rows)


def apply_matrix(matrix: tuple) -> dict[str, str]:
    def channel(j: int) -> str:
        terms = [f"{num(matrix[i][j])} * {unit(c)}" for i, c in enumerate("rgba") if matrix[i][j]] + [num(matrix[4][j])]
        return from_unit(" + ".join(terms))

    return {c: channel(j) for j, c in enumerate("rgba")}


def srgb_to_linear(v: str) -> str:
    return f"(CASE WHEN {v} <= 0.04045e0 THEN {v} / 12.92e0 ELSE power(({v} + 0.055e0) / 1.055e0, 2.4e0) END)"


def linear_to_srgb(v: str) -> str:
    return f"(CASE WHEN {v} <= 0.0031308e0 THEN {v} * 12.92e0 ELSE 1.055e0 * power({v}, 1e0 / 2.4e0) - 0.055e0 END)"


def linear(c: str) -> str:
    return srgb_to_linear(unit(c))


# sRGB primaries to XYZ at D65, and the D65 white.
_XYZ = {"X": (0.4124564, 0.3575761, 0.1804375), "Y": (0.2126729, 0.7151522, 0.0721750), "Z": (0.0193339, 0.1191920, 0.9503041)}
_WHITE = {"X": 0.95047, "Y": 1.0, "Z": 1.08883}
# The two matrices of OKLab.
_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
_OK = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def _dot(weights: tuple, terms: tuple) -> str:
    return "(" + " + ".join(f"{num(w)} * {t}" for w, t in zip(weights, terms, strict=True)) + ")"


def xyz() -> dict[str, str]:
    return {k: _dot(w, tuple(map(linear, "rgb"))) for k, w in _XYZ.items()}


def lab() -> dict[str, str]:
    def f(k: str) -> str:
        t = f"({xyz()[k]} / {num(_WHITE[k])})"
        return f"(CASE WHEN {t} > {num(216 / 24389)} THEN power({t}, {num(1 / 3)}) ELSE ({num(24389 / 27)} * {t} + 16) / 116e0 END)"

    return {"lab_l": f"(116e0 * {f('Y')} - 16e0)", "lab_a": f"(500e0 * ({f('X')} - {f('Y')}))", "lab_b": f"(200e0 * ({f('Y')} - {f('Z')}))"}


def lch() -> dict[str, str]:
    x = lab()
    hue = f"degrees(atan2({x['lab_b']}, {x['lab_a']}))"
    return {"lch_l": x["lab_l"], "lch_c": f"sqrt({x['lab_a']} * {x['lab_a']} + {x['lab_b']} * {x['lab_b']})", "lch_h": f"(CASE WHEN {hue} < 0 THEN {hue} + 360 ELSE {hue} END)"}


def oklab() -> dict[str, str]:
    lms = tuple(f"power({_dot(w, tuple(map(linear, 'rgb')))}, {num(1 / 3)})" for w in _LMS)
    return {k: _dot(w, lms) for k, w in zip(("ok_l", "ok_a", "ok_b"), _OK, strict=True)}


def inverted(matrix: tuple) -> tuple:
    (a, b, c), (d, e, f), (g, h, i) = matrix
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return tuple(tuple(v / det for v in row) for row in ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d)))


def from_linear(r: str, g: str, b: str) -> dict[str, str]:
    """Bytes of linear light (shares of one; what lies outside is cut off)."""
    return {c: from_unit(linear_to_srgb(clamp(f"({e})", "0e0", "1e0"))) for c, e in zip("rgb", (r, g, b), strict=True)}


def from_xyz(x: str = "cie_x", y: str = "cie_y", z: str = "cie_z") -> dict[str, str]:
    return from_linear(*(_dot(w, (x, y, z)) for w in inverted(tuple(_XYZ.values()))))


def lab_to_xyz(lightness: str = "lab_l", a: str = "lab_a", b: str = "lab_b") -> dict[str, str]:
    middle = f"(({lightness} + 16) / 116e0)"
    places = {"cie_x": f"({middle} + {a} / 500e0)", "cie_y": middle, "cie_z": f"({middle} - {b} / 200e0)"}
    return {k: f"({num(_WHITE[k[-1].upper()])} * (CASE WHEN power({f}, 3) > {num(216 / 24389)} THEN power({f}, 3) ELSE (116e0 * {f} - 16) / {num(24389 / 27)} END))" for k, f in places.items()}


def lch_to_lab(lightness: str = "lch_l", chroma: str = "lch_c", hue: str = "lch_h") -> dict[str, str]:
    """Of hue in degrees."""
    return {"lab_l": lightness, "lab_a": f"({chroma} * cos(radians({hue})))", "lab_b": f"({chroma} * sin(radians({hue})))"}


def from_oklab(lightness: str = "ok_l", a: str = "ok_a", b: str = "ok_b") -> dict[str, str]:
    cubes = tuple(f"power({_dot(w, (lightness, a, b))}, 3)" for w in inverted(_OK))
    return from_linear(*(_dot(w, cubes) for w in inverted(_LMS)))


def from_hsv(h: str = "h", s: str = "s", v: str = "v") -> dict[str, str]:
    """Of hue in degrees, saturation and value as shares."""
    part = lambda n: f"(({n} + {h} / 60e0) - 6 * floor(({n} + {h} / 60e0) / 6))"
    return {c: from_unit(f"{v} - {v} * {s} * greatest(0e0, least({part(n)}, 4 - {part(n)}, 1e0))") for c, n in zip("rgb", (5, 3, 1), strict=True)}


def from_hsl(h: str = "h", s: str = "s", lightness: str = "l") -> dict[str, str]:
    part = lambda n: f"(({n} + {h} / 30e0) - 12 * floor(({n} + {h} / 30e0) / 12))"
    return {c: from_unit(f"{lightness} - {s} * least({lightness}, 1 - {lightness}) * greatest(-1e0, least({part(n)} - 3, 9 - {part(n)}, 1e0))") for c, n in zip("rgb", (0, 8, 4), strict=True)}


# Bradford's cone responses, and the D50 white.
_BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
_WHITE_D50 = {"X": 0.96422, "Y": 1.0, "Z": 0.82521}


def adapted(to_d50: bool = True, x: str = "cie_x", y: str = "cie_y", z: str = "cie_z") -> dict[str, str]:
    """cie_x, cie_y, cie_z under the other white, by scaling Bradford's cone responses."""
    cones = lambda white: [sum(w * v for w, v in zip(row, white.values(), strict=True)) for row in _BRADFORD]
    old, new = (_WHITE, _WHITE_D50) if to_d50 else (_WHITE_D50, _WHITE)
    gain = [n / o for n, o in zip(cones(new), cones(old), strict=True)]
    back = inverted(_BRADFORD)
    matrix = tuple(tuple(sum(back[i][k] * gain[k] * _BRADFORD[k][j] for k in range(3)) for j in range(3)) for i in range(3))
    return {name: _dot(w, (x, y, z)) for name, w in zip(("cie_x", "cie_y", "cie_z"), matrix, strict=True)}


_MOST, _LEAST = "greatest(r, g, b)", "least(r, g, b)"
_HUE = f"(CASE WHEN {_MOST} = {_LEAST} THEN 0e0 WHEN {_MOST} = r THEN (CASE WHEN g < b THEN 360e0 ELSE 0e0 END) + 60e0 * (g - b) / ({_MOST} - {_LEAST}) WHEN {_MOST} = g THEN 120e0 + 60e0 * (b - r) / ({_MOST} - {_LEAST}) ELSE 240e0 + 60e0 * (r - g) / ({_MOST} - {_LEAST}) END)"


def hsv() -> dict[str, str]:
    return {"h": _HUE, "s": f"(CASE WHEN {_MOST} = 0 THEN 0e0 ELSE ({_MOST} - {_LEAST}) * 1e0 / {_MOST} END)", "v": unit(_MOST)}


def hsl() -> dict[str, str]:
    spread = f"(CASE WHEN {_MOST} + {_LEAST} <= 255 THEN {_MOST} + {_LEAST} ELSE 510 - {_MOST} - {_LEAST} END)"
    return {"h": _HUE, "s": f"(CASE WHEN {_MOST} = {_LEAST} THEN 0e0 ELSE ({_MOST} - {_LEAST}) * 1e0 / {spread} END)", "l": f"(({_MOST} + {_LEAST}) / 510e0)"}


def gamma(g: float) -> dict[str, str]:
    return {c: byte(f"255e0 * power({unit(c)}, {num(1 / g)})") for c in "rgb"}


def invert() -> dict[str, str]:
    return {c: f"255 - {c}" for c in "rgb"}


def grayscale() -> dict[str, str]:
    return dict.fromkeys("rgb", luma())


def background(r: int, g: int, b: int) -> dict[str, str]:
    """Over an opaque colour."""
    return {c: byte(f"({c} * a + {v} * (255 - a)) / 255e0") for c, v in zip("rgb", (r, g, b), strict=True)} | {"a": "255"}


def _hable(x: str) -> str:
    return f"((({x}) * (0.15e0 * ({x}) + 0.05e0) + 0.004e0) / (({x}) * (0.15e0 * ({x}) + 0.50e0) + 0.06e0) - {num(0.02 / 0.30)})"


def tone_map(curve: str, exposure: float = 0, white: float = 2) -> dict[str, str]:
    """Linear light times 2 ** exposure, then a curve, then sRGB."""
    lit = {c: f"({linear(c)} * {num(2.0**exposure)})" for c in "rgb"}
    bright = _dot((0.2126, 0.7152, 0.0722), tuple(lit.values()))

    def mapped(v: str) -> str:
        if curve == "clip":
            return v
        if curve == "aces":
            return f"({v} * (2.51e0 * {v} + 0.03e0) / ({v} * (2.43e0 * {v} + 0.59e0) + 0.14e0))"
        if curve == "hable":
            w = 11.2
            at_white = (w * (0.15 * w + 0.05) + 0.004) / (w * (0.15 * w + 0.50) + 0.06) - 0.02 / 0.30
            return f"({_hable(v)} / {num(at_white)})"
        if curve == "reinhard":
            return f"({v} / (1e0 + {bright}))"
        return f"({v} * (1e0 + {bright} / {num(white * white)}) / (1e0 + {bright}))"

    return {c: from_unit(linear_to_srgb(clamp(mapped(v), "0e0", "1e0"))) for c, v in lit.items()}


def _mix(color: tuple[int, int, int], weight: str) -> dict[str, str]:
    return {c: byte(f"{c} + ({v} - {c}) * {weight}") for c, v in zip("rgb", color, strict=True)}


def vignette(color: tuple[int, int, int], width: str, height: str) -> dict[str, str]:
    dx, dy = f"((x + 0.5e0 - {width} / 2e0) / ({width} / 2e0))", f"((y + 0.5e0 - {height} / 2e0) / ({height} / 2e0))"
    return _mix(color, clamp(f"({dx} * {dx} + {dy} * {dy}) / 2e0", "0e0", "1e0"))


def glow(color: tuple[int, int, int], width: str, height: str) -> dict[str, str]:
    dx, dy = f"(x + 0.5e0 - {width} / 2e0)", f"(y + 0.5e0 - {height} / 2e0)"
    radius = f"(greatest({width}, {height}) / 2e0)"
    return _mix(color, clamp(f"1e0 - sqrt({dx} * {dx} + {dy} * {dy}) / {radius}", "0e0", "1e0"))


def _screen(b: str, s: str) -> str:
    return f"({b} + {s} - {b} * {s})"


def _hard(b: str, s: str) -> str:
    return f"(CASE WHEN {s} <= 0.5e0 THEN 2 * {b} * {s} ELSE {_screen(b, f'(2 * {s} - 1)')} END)"


#: Separable blends of a backdrop b and a source s, both shares of one.
BLENDS = {
    "normal": lambda b, s: s,
    "multiply": lambda b, s: f"({b} * {s})",
    "add": lambda b, s: f"least(1e0, {b} + {s})",
    "subtract": lambda b, s: f"greatest(0e0, {b} - {s})",
    "screen": _screen,
    "darken": lambda b, s: f"least({b}, {s})",
    "lighten": lambda b, s: f"greatest({b}, {s})",
    "overlay": lambda b, s: _hard(s, b),
    "hard_light": _hard,
    "soft_light": lambda b, s: f"(CASE WHEN {s} <= 0.5e0 THEN {b} - (1 - 2 * {s}) * {b} * (1 - {b}) ELSE {b} + (2 * {s} - 1) * ((CASE WHEN {b} <= 0.25e0 THEN ((16 * {b} - 12) * {b} + 4) * {b} ELSE sqrt({b}) END) - {b}) END)",
    "color_dodge": lambda b, s: f"(CASE WHEN {b} <= 0 THEN 0e0 WHEN {s} >= 1 THEN 1e0 ELSE least(1e0, {b} / (1 - {s})) END)",
    "color_burn": lambda b, s: f"(CASE WHEN {b} >= 1 THEN 1e0 WHEN {s} <= 0 THEN 0e0 ELSE 1 - least(1e0, (1 - {b}) / {s}) END)",
    "difference": lambda b, s: f"abs({b} - {s})",
    "exclusion": lambda b, s: f"({b} + {s} - 2 * {b} * {s})",
}
#: Porter-Duff shares of source and backdrop.
COMPOSITIONS = {
    "src_over": ("1", "(1 - sa)"), "src": ("1", "0"), "src_atop": ("ba", "(1 - sa)"), "src_in": ("ba", "0"), "src_out": ("(1 - ba)", "0"), "dest": ("0", "1"),
    "dest_over": ("(1 - ba)", "1"), "dest_atop": ("(1 - ba)", "sa"), "dest_in": ("0", "sa"), "dest_out": ("0", "(1 - sa)"), "clear": ("0", "0"), "xor": ("(1 - ba)", "(1 - sa)"),
}


def composed(blend: str, composition: str) -> dict[str, str]:
    """r, g, b, a of unit columns br, bg, bb, ba (backdrop) and sr, sg, sb, sa (source)."""
    fa, fb = COMPOSITIONS[composition]
    alpha = f"(sa * {fa} + ba * {fb})"
    out = {}
    for c in "rgb":
        mixed = f"((1 - ba) * s{c} + ba * {BLENDS[blend](f'b{c}', f's{c}')})"
        out[c] = f"CASE WHEN {alpha} <= 0 THEN 0 ELSE {from_unit(f'({mixed} * sa * {fa} + b{c} * ba * {fb}) / {alpha}')} END"
    return out | {"a": from_unit(alpha)}
