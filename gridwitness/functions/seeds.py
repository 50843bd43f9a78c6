"""Structure placement draws: the 48-bit generator, vectorised over candidate seeds."""

from __future__ import annotations

import numpy as np

#: The generator and the salts of a region.
MULTIPLIER, INCREMENT, MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1
REGION_X, REGION_Z = 341873128712, 132897987541


def start(seeds: np.ndarray, region_x: int, region_z: int, salt: int) -> np.ndarray:
    """The generators' states, as uint64, for one region."""
    shift = (region_x * REGION_X + region_z * REGION_Z + salt) & MASK
    return ((seeds.astype(np.uint64) + np.uint64(shift)) ^ np.uint64(MULTIPLIER)) & np.uint64(MASK)


def _step(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    state = (state * np.uint64(MULTIPLIER) + np.uint64(INCREMENT)) & np.uint64(MASK)
    return state, (state >> np.uint64(17)).astype(np.int64)


def next_int(state: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(state, value in 0..bound - 1); draws that would bias the result are drawn again, each seed for itself."""
    state, value = _step(state)
    if bound & (bound - 1) == 0:
        return state, (value * bound) >> 31
    out = value % bound
    again = value - out + (bound - 1) >= 1 << 31
    while again.any():
        state[again], value[again] = _step(state[again])
        out[again] = value[again] % bound
        again[again] = value[again] - out[again] + (bound - 1) >= 1 << 31
    return state, out


def floor_div(a: int, b: int) -> int:
    return a // b


def consistent(seeds: np.ndarray, evidence: list[dict]) -> np.ndarray:
    """Which seeds place a structure of each evidence (spacing, separation, salt, spread_type, x, z) at its chunk."""
    ok = np.ones(len(seeds), bool)
    for e in evidence:
        at = np.flatnonzero(ok)
        if not len(at):
            break
        rx, rz, bound = floor_div(e["x"], e["spacing"]), floor_div(e["z"], e["spacing"]), e["spacing"] - e["separation"]
        state = start(seeds[at], rx, rz, e["salt"])
        place = []
        for _ in range(2):
            state, value = next_int(state, bound)
            if e["spread_type"] == "triangular":
                state, second = next_int(state, bound)
                value = (value + second) // 2
            place.append(value)
        ok[at] = (rx * e["spacing"] + place[0] == e["x"]) & (rz * e["spacing"] + place[1] == e["z"])
    return ok
