"""Re-Pair grammars of many token sequences at once."""

from __future__ import annotations

import numpy as np

from intentlake.llm.superminhash import U, mix

PHI = U(0x9E3779B97F4A7C15)


def digrams(symbols: np.ndarray) -> np.ndarray:
    """A hash for each two neighbours, which also names the rule that they would make."""
    with np.errstate(over="ignore"):
        return mix(symbols[:-1] * PHI + mix(symbols[1:] + U(1)))


def apart(chosen: np.ndarray) -> np.ndarray:
    """Of neighbouring chosen places every second one, from the first of each run."""
    if not len(chosen):
        return chosen
    at = np.arange(len(chosen))
    starts = chosen.copy()
    starts[1:] &= ~chosen[:-1]
    return chosen & ((at - np.maximum.accumulate(np.where(starts, at, 0))) % 2 == 0)


class Grammar:
    """Recursive pairing of sequences: digram by digram, all sequences in step.

    Each round counts the digrams of every sequence. A digram that occurs at
    least twice and is no less frequent than the digrams it overlaps becomes a
    rule, and its occurrences become the rule's symbol. (The textbook replaces
    the single most frequent digram of one text at a time; digrams that are
    locally most frequent don't disturb each other, so they may be replaced
    together.) A sequence is done when none of its digrams can be replaced. A
    rule's symbol is a hash of its two sides, hence equal phrases have equal
    symbols everywhere.
    """

    def __init__(self, owner: np.ndarray, symbols: np.ndarray, count: int) -> None:
        self.length = np.bincount(owner, minlength=count)
        self.rules = np.zeros(count, np.int64)
        #: Symbols of the last sequence, and the tokens that rules stand for in it.
        self.left = np.zeros(count, np.int64)
        self.covered = np.zeros(count, np.int64)
        weight = np.ones(len(owner), np.int32)
        symbols = symbols.astype(U)
        while len(symbols):
            owner, symbols, weight = self._round(owner, symbols, weight, count)

    def _round(self, owner: np.ndarray, symbols: np.ndarray, weight: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair = digrams(symbols)
        with np.errstate(over="ignore"):
            here = mix(pair + owner[:-1].astype(U) * U(0xD1B54A32D192ED03))
        inside = owner[:-1] == owner[1:]
        order = np.argsort(here)
        ordered = here[order]
        group = np.zeros(len(here), np.int64)
        if len(here):
            group[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        # aaa has one aa: of a run of one symbol every second place counts
        same = inside & (symbols[:-1] == symbols[1:])
        frequency = np.bincount(group[inside & (~same | apart(same))], minlength=len(here) + 1)[group]
        frequency[~inside] = 0
        # by frequency, then by the hash, so that of two overlapping digrams one wins
        strength = frequency + (pair >> U(12)).astype(np.float64) / 2.0**52
        padded = np.concatenate(([0.0], strength, [0.0]))
        chosen = apart((frequency >= 2) & (strength >= padded[:-2]) & (strength >= padded[2:]))
        used = np.bincount(group[chosen], minlength=len(here) + 1)
        chosen &= used[group] >= 2
        at = np.flatnonzero(chosen)
        working = np.zeros(count, bool)
        working[owner[at]] = True
        done = ~working[owner]
        self.left += np.bincount(owner[done], minlength=count)
        rules = done & (weight > 1)
        self.covered += np.bincount(owner[rules], weights=weight[rules], minlength=count).astype(np.int64)
        fresh = np.unique(group[at], return_index=True)[1]
        self.rules += np.bincount(owner[at[fresh]], minlength=count)
        weight, symbols = weight.copy(), symbols.copy()
        weight[at] += weight[at + 1]
        symbols[at] = pair[at]
        keep = ~done
        keep[at + 1] = False
        return owner[keep], symbols[keep], weight[keep]

    def compression(self) -> np.ndarray:
        """Size of the grammar (the last sequence, and two symbols a rule) over the length; 1 if nothing repeats."""
        return np.where(self.length > 0, (self.left + 2 * self.rules) / np.maximum(1, self.length), 1.0)

    def reuse(self) -> np.ndarray:
        """Share of the tokens that rules stand for."""
        return self.covered / np.maximum(1, self.length)


def phrases(owner: np.ndarray, symbols: np.ndarray, rounds: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules that name the same phrase in every sequence: (owner, symbol, tokens).

    As in Grammar, but a digram is paired where its hash is greatest among its
    neighbours, whether or not it repeats within the sequence; so equal
    stretches of any two sequences get equal symbols but for their ends.
    """
    symbols = symbols.astype(U)
    weight = np.ones(len(owner), np.int32)
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        pair = digrams(symbols)
        strength = np.where(owner[:-1] == owner[1:], pair >> U(1), U(0))
        padded = np.concatenate(([U(0)], strength, [U(0)]))
        at = np.flatnonzero(apart((strength > 0) & (strength >= padded[:-2]) & (strength >= padded[2:])))
        weight[at] += weight[at + 1]
        symbols[at] = pair[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        owner, symbols, weight = owner[keep], symbols[keep], weight[keep]
    return owner, symbols, weight
