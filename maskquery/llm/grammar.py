"""Re-Pair on many short sequences at once: frequent neighbours become rules, in batched rounds of numpy.

A rule stands for two symbols side by side. Rules of one round use symbols of earlier rounds only, so whatever is computed per
symbol (a sum, a transfer matrix) is computed bottom-up, a round at a time, and once for all sequences that share the symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Pairs looked at in one round, by falling count; the rest waits for the next round.
BATCH = 4096


@dataclass
class Grammar:
    """``terminals`` symbols 0, 1, ..., then the rules; ``rounds`` are the ends of each round's rules; sequences are ``seq[first[i]:first[i + 1]]``."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    rounds: list[int]
    seq: np.ndarray
    first: np.ndarray

    def spans(self):
        """The bounds of each round's rules, counted from the first rule."""
        return zip([0, *self.rounds[:-1]], self.rounds)


def _chosen(pairs: np.ndarray, counts: np.ndarray, total: int) -> np.ndarray:
    """Frequent pairs of which no two can overlap: no symbol is a left one here and a right one there."""
    order = np.lexsort((pairs, -counts))[:BATCH]
    order = order[counts[order] * 4 >= counts[order[0]]]
    lefts: set[int] = set()
    rights: set[int] = set()
    took = []
    for k in order.tolist():
        a, b = divmod(int(pairs[k]), total)
        if a in rights or b in lefts or (a == b and (a in lefts or b in rights)):
            continue
        lefts.add(a)
        rights.add(b)
        took.append(k)
    return np.sort(pairs[took])


def _replace(seq: np.ndarray, first: np.ndarray, code: np.ndarray, chosen: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of the chosen pairs, left to right, as symbols ``base + place of the pair``; ``code`` is -1 across sequences."""
    place = np.minimum(np.searchsorted(chosen, code), len(chosen) - 1)
    at = np.flatnonzero(chosen[place] == code)
    # a symbol paired with itself overlaps its own next occurrence: every second one of a chain counts
    chained = np.zeros(len(at), bool)
    chained[1:] = (np.diff(at) == 1) & (code[at[1:]] == code[at[:-1]])
    start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
    at = at[(np.arange(len(at)) - start) % 2 == 0]
    seq = seq.copy()
    seq[at] = base + place[at]
    gone = at + 1
    stay = np.ones(len(seq), bool)
    stay[gone] = False
    return seq[stay], first - np.searchsorted(gone, first)


def _codes(seq: np.ndarray, first: np.ndarray, total: int) -> np.ndarray:
    code = seq[:-1] * total + seq[1:]
    inner = first[(first > 0) & (first < len(seq))]
    code[inner - 1] = -1
    return code


def compress(seq: np.ndarray, first: np.ndarray, terminals: int, least: int = 2) -> Grammar:
    """Rules for all neighbours that occur ``least`` times; sequences may be empty."""
    seq, first = seq.astype(np.int64), first.astype(np.int64)
    left, right, rounds, total = [], [], [], terminals
    while len(seq) > 1:
        code = _codes(seq, first, total)
        pairs, counts = np.unique(code[code >= 0], return_counts=True)
        often = counts >= least
        if not often.any():
            break
        chosen = _chosen(pairs[often], counts[often], total)
        left.append(chosen // total)
        right.append(chosen % total)
        seq, first = _replace(seq, first, code, chosen, total)
        total += len(chosen)
        rounds.append(total - terminals)
    none = [np.zeros(0, np.int64)]
    return Grammar(terminals, np.concatenate(left or none), np.concatenate(right or none), rounds, seq, first)


def fold(g: Grammar) -> Grammar:
    """Further rules, the sequences' own, until every sequence is one symbol or none: neighbours are joined two by two."""
    seq, first = g.seq, g.first
    left, right, rounds, total = [g.left], [g.right], list(g.rounds), g.terminals + len(g.left)
    while (np.diff(first) > 1).any():
        n = np.diff(first)
        at = np.arange(len(seq)) - np.repeat(first[:-1], n)
        heads = np.flatnonzero((at % 2 == 0) & (at + 1 < np.repeat(n, n)))
        pairs, place = np.unique(seq[heads] * total + seq[heads + 1], return_inverse=True)
        left.append(pairs // total)
        right.append(pairs % total)
        seq = seq.copy()
        seq[heads] = total + place
        stay = np.ones(len(seq), bool)
        stay[heads + 1] = False
        first = first - np.searchsorted(heads + 1, first)
        seq = seq[stay]
        total += len(pairs)
        rounds.append(total - g.terminals)
    return Grammar(g.terminals, np.concatenate(left), np.concatenate(right), rounds, seq, first)
