"""Convolution kernels and resampling filters, small tables made on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

# Edge kernels; one, a pair (gradients) or the first of eight directions.
EDGES_SINGLE = {
    "laplacian_3x3": ((-1, -1, -1), (-1, 8, -1), (-1, -1, -1)),
    "laplacian_5x5": tuple(tuple(24 if (i, j) == (2, 2) else -1 for j in range(5)) for i in range(5)),
    "laplacian_of_gaussian": ((0, 0, -1, 0, 0), (0, -1, -2, -1, 0), (-1, -2, 16, -2, -1), (0, -1, -2, -1, 0), (0, 0, -1, 0, 0)),
}
EDGES_PAIR = {
    "kayyali": (((6, 0, -6), (0, 0, 0), (-6, 0, 6)), ((-6, 0, 6), (0, 0, 0), (6, 0, -6))),
    "prewitt": (((-1, 0, 1), (-1, 0, 1), (-1, 0, 1)), ((1, 1, 1), (0, 0, 0), (-1, -1, -1))),
    "roberts_cross": (((1, 0), (0, -1)), ((0, 1), (-1, 0))),
    "scharr": (((-3, 0, 3), (-10, 0, 10), (-3, 0, 3)), ((3, 10, 3), (0, 0, 0), (-3, -10, -3))),
    "sobel": (((-1, 0, 1), (-2, 0, 2), (-1, 0, 1)), ((-1, -2, -1), (0, 0, 0), (1, 2, 1))),
}
EDGES_COMPASS = {"kirsch": ((5, 5, 5), (-3, 0, -3), (-3, -3, -3)), "robinson": ((1, 2, 1), (0, 0, 0), (-1, -2, -1))}


def compass(north: tuple) -> list[tuple]:
    """The eight turns of a 3 x 3 kernel: its outer ring shifted by one place each."""
    ring = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]
    out = []
    for turn in range(8):
        k = [[0, 0, 0], [0, north[1][1], 0], [0, 0, 0]]
        for i, (y, x) in enumerate(ring):
            sy, sx = ring[(i + turn) % 8]
            k[y][x] = north[sy][sx]
        out.append(tuple(map(tuple, k)))
    return out


def taps(kernel: tuple) -> list[tuple[int, int, float]]:
    """(dy, dx, weight) around the anchor ((w - 1) / 2, (h - 1) / 2), without zeros."""
    h, w = len(kernel), len(kernel[0])
    return [(i - (h - 1) // 2, j - (w - 1) // 2, float(kernel[i][j])) for i in range(h) for j in range(w) if kernel[i][j]]


def gaussian(sigma: float) -> tuple:
    radius = math.ceil(3 * sigma)
    weights = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return tuple(w / sum(weights) for w in weights)


def box(radius: int) -> tuple:
    return (1 / (2 * radius + 1),) * (2 * radius + 1)


def _cubic(b: float, c: float) -> Callable[[float], float]:
    def at(x: float) -> float:
        x = abs(x)
        if x < 1:
            return ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + 6 - 2 * b) / 6
        return ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + 8 * b + 24 * c) / 6 if x < 2 else 0.0

    return at


def _sinc(x: float) -> float:
    return 1.0 if abs(x) < 1e-6 else math.sin(math.pi * x) / (math.pi * x)


def _lanczos(n: float) -> Callable[[float], float]:
    return lambda x: _sinc(x) * _sinc(x / n) if abs(x) < n else 0.0


#: Radius and weight of each resampling filter.
SAMPLERS: dict[str, tuple[float, Callable[[float], float]]] = {
    "box": (0.5, lambda x: 1.0 if -0.5 < x <= 0.5 else 0.0),
    "triangle": (1, lambda x: max(0.0, 1 - abs(x))),
    "bilinear": (1, lambda x: max(0.0, 1 - abs(x))),
    "hermite": (1, lambda x: (2 * abs(x) - 3) * x * x + 1 if abs(x) < 1 else 0.0),
    "bicubic": (2, _cubic(0, 0.5)),
    "catmull_rom": (2, _cubic(0, 0.5)),
    "mitchell_netravali": (2, _cubic(1 / 3, 1 / 3)),
    "robidoux": (2, _cubic(0.37821575509399867, 0.31089212245300067)),
    "robidoux_sharp": (2, _cubic(0.2620145123990142, 0.3689927438004929)),
    "spline": (2, _cubic(1, 0)),
    "lanczos2": (2, _lanczos(2)),
    "lanczos3": (3, _lanczos(3)),
    "lanczos5": (5, _lanczos(5)),
    "lanczos8": (8, _lanczos(8)),
    "welch": (3, lambda x: _sinc(x) * (1 - x * x / 9) if abs(x) < 3 else 0.0),
}


def axis_taps(source: int, target: int, sampler: str) -> list[tuple[int, int, float]]:
    """(target place, source place, weight) along one axis: weights clamped to the edge and adding up to one."""
    radius, weight = SAMPLERS[sampler]
    ratio = source / target
    scale = max(ratio, 1.0)
    out = []
    for t in range(target):
        center = (t + 0.5) * ratio - 0.5
        found: dict[int, float] = {}
        for s in range(math.ceil(center - radius * scale), math.floor(center + radius * scale) + 1):
            if w := weight((s - center) / scale):
                place = min(source - 1, max(0, s))
                found[place] = found.get(place, 0.0) + w
        total = sum(found.values())
        out += [(t, s, w / total) for s, w in sorted(found.items())]
    return out


def bayer(n: int) -> list[list[int]]:
    """The n x n ordered dither matrix, n a power of two."""
    m = [[0]]
    while len(m) < n:
        k = len(m)
        m = [[4 * m[y % k][x % k] + ((0, 2), (3, 1))[y // k][x // k] for x in range(2 * k)] for y in range(2 * k)]
    return m


# The dispersed 3 x 3 matrix, and error diffusion as (dx, dy, share) with a divisor.
ORDERED_3 = [[0, 5, 2], [3, 8, 7], [6, 1, 4]]
DIFFUSIONS = {
    "floyd_steinberg": (16, ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1))),
    "atkinson": (8, ((1, 0, 1), (2, 0, 1), (-1, 1, 1), (0, 1, 1), (1, 1, 1), (0, 2, 1))),
    "burks": (32, ((1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2))),
    "jarvis_judice_ninke": (48, ((1, 0, 7), (2, 0, 5), (-2, 1, 3), (-1, 1, 5), (0, 1, 7), (1, 1, 5), (2, 1, 3), (-2, 2, 1), (-1, 2, 3), (0, 2, 5), (1, 2, 3), (2, 2, 1))),
    "sierra2": (16, ((1, 0, 4), (2, 0, 3), (-2, 1, 1), (-1, 1, 2), (0, 1, 3), (1, 1, 2), (2, 1, 1))),
    "sierra3": (32, ((1, 0, 5), (2, 0, 3), (-2, 1, 2), (-1, 1, 4), (0, 1, 5), (1, 1, 4), (2, 1, 2), (-1, 2, 2), (0, 2, 3), (1, 2, 2))),
    "sierra_lite": (4, ((1, 0, 2), (-1, 1, 1), (0, 1, 1))),
    "stucki": (42, ((1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2), (-2, 2, 1), (-1, 2, 2), (0, 2, 4), (1, 2, 2), (2, 2, 1))),
    "stevenson_arce": (200, ((2, 0, 32), (-3, 1, 12), (-1, 1, 26), (1, 1, 30), (3, 1, 16), (-2, 2, 12), (0, 2, 26), (2, 2, 12), (-3, 3, 5), (-1, 3, 12), (1, 3, 12), (3, 3, 5))),
}


#: Decay, frequency, and weights of the real and imaginary part of each complex kernel, by how many make up a disk.
BOKEH = (
    ((0.862325, 1.624835, 0.767583, 1.862321),),
    ((0.886528, 5.268909, 0.411259, -0.548794), (1.960518, 1.558213, 0.513282, 4.561110)),
    ((2.176490, 5.043495, 1.621035, -2.105439), (1.019306, 9.027613, -0.280860, -0.162882), (2.815110, 1.597273, -0.366471, 10.300301)),
    ((4.338459, 1.553635, -5.767909, 46.164397), (3.839993, 4.693183, 9.795391, -15.227561), (2.791880, 8.178137, -3.048324, 0.302959), (1.342190, 12.328289, 0.010001, 0.244650)),
    ((4.892608, 1.685979, -22.356787, 85.912460), (4.711870, 4.998496, 35.918936, -28.875618), (4.052795, 8.244168, -13.212253, -1.578428), (2.929212, 11.900859, 0.507991, 1.816328), (1.512961, 16.116382, 0.138051, -0.010000)),
    ((5.143778, 2.079813, -82.326596, 111.231024), (5.612426, 6.153387, 113.878661, 58.004879), (5.982921, 9.802895, 39.479083, -162.028887), (6.505167, 11.059237, -71.286026, 95.027069), (3.869579, 14.810520, 1.405746, -3.704914), (2.201904, 19.032909, -0.152784, -0.107988)),
)


def bokeh(radius: int, components: int) -> list[tuple[list[complex], complex]]:
    """Complex taps along an axis, and the number w whose product with a sum over both axes has the weighted sum as its real part.

    The weights are such that all components together leave an even image as it is.
    """
    found = []
    for decay, frequency, real, imaginary in BOKEH[components - 1]:
        squares = [((i - radius) / radius) ** 2 for i in range(2 * radius + 1)]
        found.append(([math.e ** complex(-decay * q, frequency * q) for q in squares], complex(real, -imaginary)))
    total = sum((w * sum(taps) ** 2).real for taps, w in found)
    return [(taps, w / total) for taps, w in found]
