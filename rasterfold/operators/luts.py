"""Tables of colours: files of the .cube format, and their use by interpolation between entries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries a side that a table of three dimensions may have: it goes into the plan as a literal.
MOST_SIDE = 65


def parse_cube(text: str) -> dict:
    """title, size, dimensions (1 or 3), low and high (the domain) and entries (red varies fastest) of a .cube file."""
    out = {"title": "", "size": 0, "dimensions": 0, "low": (0.0, 0.0, 0.0), "high": (1.0, 1.0, 1.0), "entries": []}
    for line in text.splitlines():
        words = line.split("#")[0].split()
        if not words:
            continue
        key = words[0].upper()
        if key == "TITLE":
            out["title"] = line.split(None, 1)[1].strip().strip('"')
        elif key in ("LUT_1D_SIZE", "LUT_3D_SIZE"):
            out["dimensions"], out["size"] = int(key[4]), int(words[1])
        elif key in ("DOMAIN_MIN", "DOMAIN_MAX"):
            out["low" if key.endswith("MIN") else "high"] = tuple(map(float, words[1:4]))
        elif len(words) == 3:
            out["entries"].append(tuple(map(float, words)))
    wanted = out["size"] ** max(1, out["dimensions"])
    if not out["dimensions"] or len(out["entries"]) != wanted:
        raise ValueError(f"a table of {wanted} entries has {len(out['entries'])}")
    if out["dimensions"] == 3 and out["size"] > MOST_SIDE:
        raise ValueError(f"more than {MOST_SIDE} entries a side")
    return out


def identity_cube(size: int) -> str:
    """A .cube file that changes nothing."""
    at = [i / (size - 1) for i in range(size)]
    return "\n".join([f"LUT_3D_SIZE {size}", *(f"{r!r} {g!r} {b!r}" for b, g, r in product(at, at, at))])


def _place(c: str, lut: dict, k: int) -> Column:
    share = (F.col(c) / 255 - lut["low"][k]) / (lut["high"][k] - lut["low"][k])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * (lut["size"] - 1)


def _byte(share: Column) -> Column:
    return F.floor(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * 255, 6) + 0.5).cast("int")


def apply(px: DataFrame, lut: dict, interpolation: str = "trilinear") -> DataFrame:
    """px with r, g, b looked up in a parsed table, between its entries: trilinear, or tetrahedral over the six wedges of a cell."""
    size, table = lut["size"], F.lit([float(v) for entry in lut["entries"] for v in entry])
    last = F.lit(max(0, size - 2))
    places = {c: _place(c, lut, k) for k, c in enumerate("rgb")}
    cells = px.withColumns({f"_i{c}": F.least(last, F.floor(p)).cast("int") for c, p in places.items()} | {f"_p{c}": p for c, p in places.items()})
    cells = cells.withColumns({f"_f{c}": F.col(f"_p{c}") - F.col(f"_i{c}") for c in "rgb"})

    def entry(k: int, r: int, g: int, b: int) -> Column:
        at = (F.col("_ir") + r) + size * ((F.col("_ig") + g) + size * (F.col("_ib") + b))
        return F.element_at(table, (at * 3 + k + 1).cast("int"))

    def value(k: int) -> Column:
        r, g, b = (F.col(f"_f{c}") for c in "rgb")
        if lut["dimensions"] == 1:
            i, f = (F.col(f"_{x}{'rgb'[k]}") for x in "if")
            one = lambda d: F.element_at(table, ((i + d) * 3 + k + 1).cast("int"))
            return one(0) + (one(1) - one(0)) * f if size > 1 else one(0)
        if interpolation == "tetrahedral":
            def path(first: str, second: str, third: str) -> Column:
                """From the low corner to the high one along the axes in order of their shares."""
                f, at, total = {"r": r, "g": g, "b": b}, {"r": 0, "g": 0, "b": 0}, None
                before, shares = F.lit(1.0), [f[first], f[second], f[third], F.lit(0.0)]
                for share, axis in zip(shares, (None, first, second, third), strict=True):
                    if axis:
                        at[axis] = 1
                    step = entry(k, at["r"], at["g"], at["b"]) * (before - share)
                    total, before = step if total is None else total + step, share
                return total

            orders = [(r >= g) & (g >= b), (r >= b) & (b >= g), (b >= r) & (r >= g), (g >= r) & (r >= b), (g >= b) & (b >= r)]
            paths = [path(*p) for p in ("rgb", "rbg", "brg", "grb", "gbr", "bgr")]
            out = F.when(orders[0], paths[0])
            for test, p in zip(orders[1:], paths[1:-1], strict=True):
                out = out.when(test, p)
            return out.otherwise(paths[-1])
        weight = lambda c, i: F.col(f"_f{c}") if i else 1 - F.col(f"_f{c}")
        return sum((entry(k, i, j, m) * weight("r", i) * weight("g", j) * weight("b", m) for i, j, m in product((0, 1), repeat=3)), F.lit(0.0))

    looked_up = cells.withColumns({f"_o{c}": _byte(value(k)) for k, c in enumerate("rgb")})
    return looked_up.select(*(F.col(f"_o{c}").alias(c) if c in "rgb" else F.col(c) for c in px.columns))
