"""Token shingles and SuperMinHash signatures of many texts at once."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

TOKEN = re.compile(r"[a-z0-9_]+")
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def shingles(texts: list[str], width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed runs of `width` tokens: (text number, hash), sorted by both.

    A text with fewer than `least` tokens has none. Hashes of tokens don't
    depend on the process, so that equal runs meet across executors.
    """
    lists = [TOKEN.findall(t.lower()) for t in texts]
    lists = [x if len(x) >= max(least, width) else [] for x in lists]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.array([t for x in lists for t in x], dtype=object)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, U)
    codes, words = pd.factorize(flat)
    h = mix(pd.util.hash_array(words, categorize=False).astype(U))[codes]
    run = h[: len(h) - width + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            run = mix(run * U(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    owner = np.repeat(np.arange(len(lists)), lengths)
    same = owner[: len(run)] == owner[width - 1 :]
    run, owner = run[same], owner[: len(same)][same]
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], run[new]


def signatures(owner: np.ndarray, elements: np.ndarray, count: int, slots: int, block: int = 200_000) -> np.ndarray:
    """SuperMinHash signature (count x slots, uint64) of the element sets.

    Each element walks through a random permutation of the slots (a
    Fisher-Yates shuffle drawn step by step from its hash) and offers slot
    p[j] the value j + r, j in the high bits and the random r in the low ones.
    As all values of step j are below those of step j + 1, a set whose slots
    are all taken by earlier steps has ended: large sets after a step or two.
    A set without elements keeps the largest value in each slot.
    """
    full = U(0xFFFFFFFFFFFFFFFF)
    out = np.full((count, slots), full, U)
    flat = out.reshape(-1)
    bounds = np.searchsorted(owner, np.arange(count + 1))
    first = 0
    while first < count:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + block, side="right")) - 1)
        low, high = bounds[first], bounds[last]
        live = np.arange(high - low)
        mine, seed = owner[low:high], elements[low:high]
        p = np.tile(np.arange(slots, dtype=np.uint8), (len(live), 1))
        for j in range(slots):
            if not len(live):
                break
            with np.errstate(over="ignore"):
                draw = mix(seed[live] + U(j + 1) * U(0x9E3779B97F4A7C15))
            k = j + ((draw >> U(32)) % U(slots - j)).astype(np.int64)
            chosen = p[live, k]
            p[live, k] = p[live, j]
            value = (U(j) << U(56)) | (mix(draw) >> U(8))
            np.minimum.at(flat, mine[live] * slots + chosen, value)
            worst = out[first:last].max(axis=1) >> U(56)
            live = live[worst[mine[live] - first] > j]
        first = last
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key (as int64) for each band of `rows` slots; the band's number is part of it."""
    n, slots = signature.shape
    grouped = signature[:, : slots // rows * rows].reshape(n, -1, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, grouped.shape[1] + 1, dtype=U) * U(0xD1B54A32D192ED03), grouped.shape[:2]).copy()
        for k in range(rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + grouped[:, :, k])
    return key.view(np.int64)
