"""Colours: tables, conversion, a colour map by polynomial, colours for factors."""

from __future__ import annotations

import numpy as np

from tessera.functions.special import circle_layout, line_layout

#: Coefficients of a published polynomial approximation of the turbo colour map, by channel: fixed values.
TURBO = [
    [0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943],
    [0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604],
    [0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973],
]
TOP = "#fcd217"


def turbo(t: np.ndarray) -> np.ndarray:
    """RGB in [0, 1] of places in [0, 1]."""
    t = np.asarray(t, float)[..., None] ** np.arange(6)
    return np.clip(np.stack([t @ np.array(c) for c in TURBO], axis=-1), 0, 1)


def from_hex(text: str) -> tuple[float, float, float]:
    h = text.lstrip("#")
    h = "".join(c * 2 for c in h) if len(h) == 3 else h
    if len(h) != 6:
        raise ValueError(f"no colour: {text}")
    return tuple(int(h[i : i + 2], 16) / 255 for i in (0, 2, 4))


def to_hex(rgb) -> str:
    return "#" + "".join(f"{min(255, max(0, round(c * 255))):02x}" for c in rgb)


def to_bytes(rgb: np.ndarray) -> np.ndarray:
    return np.clip((np.asarray(rgb, float) * 255).astype(int), 0, 255)


def similarity(w: np.ndarray) -> np.ndarray:
    """A symmetric likeness from neighbour sums: without the diagonal, each column over its row's total, plus the transpose."""
    m = np.asarray(w, float).copy()
    np.fill_diagonal(m, 0)
    total = m.sum(1)
    m = m / np.where(total == 0, 1, total)
    return m + m.T


def abundance(weight: np.ndarray) -> np.ndarray:
    """Square roots of factors' weights, none below a fifth of an equal share, summing to one."""
    w = np.sqrt(np.asarray(weight, float))
    w = np.clip(w / w.sum(), 0.2 / len(w), 1)
    return w / w.sum()


def place_of(colour: str, steps: int = 1000) -> float:
    """The place in [0, 1] whose colour on the map is nearest to a colour; what is no colour counts as :data:`TOP`."""
    try:
        wanted = from_hex(colour)
    except ValueError:
        wanted = from_hex(TOP)
    far = ((turbo(np.arange(steps + 1) / steps) - wanted) ** 2).sum(1)
    return float(far.argmin() / steps)


def places(near: np.ndarray, weight: np.ndarray | None = None, top: str = TOP, circle: bool = False, seed: int = 0) -> np.ndarray:
    """Places in [0, 1) on the colour map: neighbours far apart, and the heaviest factor at the wanted colour.

    Factors in the order of their layout take shares of the map by weight; a
    factor's place is the middle of its share, and all are turned together.
    """
    w = np.full(len(near), 1.0) if weight is None else np.asarray(weight, float)
    order = np.argsort(circle_layout(near, seed=seed) if circle else line_layout(near, seed=seed), kind="stable")
    middle = np.empty(len(w))
    middle[order] = (np.cumsum(w[order]) - w[order] / 2) / w.sum()
    return (middle + place_of(top) - middle[w.argmax()]) % 1


#: Places are stretched to the map from here on, as its first colours are very dark.
DARK = 0.05


def stretched(at: np.ndarray) -> np.ndarray:
    """Places from their least and greatest to [:data:`DARK`, 1]."""
    at = np.asarray(at, float)
    span = np.ptp(at)
    return DARK + (1 - DARK) * ((at - at.min()) / span if span else np.zeros(len(at)))


def table(at: np.ndarray, names: list[str] | None = None) -> list[tuple]:
    """(Name, Color_index, R, G, B) of places, which are stretched over the map."""
    rgb = turbo(stretched(at))
    rank = np.argsort(np.argsort(at, kind="stable"), kind="stable")
    return [(n, int(r), *map(float, c)) for n, r, c in zip(names or map(str, range(len(at))), rank, rgb)]


def bar(n: int = 256, height: int = 16) -> np.ndarray:
    """A colour bar as an image."""
    return np.repeat(to_bytes(turbo(np.arange(n) / n))[None], height, axis=0).astype(np.uint8)
