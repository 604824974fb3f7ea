"""Hashes of word shingles for whole batches of texts, with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_STEPS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xC2B2AE3D27D4EB4F]
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n, base, _U)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, A-Z in lower case, and the number of words of each text."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    space = _SPACE[raw]
    before = np.concatenate([[True], space[:-1]])[: len(space)]
    start = np.nonzero(~space & before)[0]
    end = np.nonzero(space & ~before)[0]  # every word is followed by space: a line feed ends each text
    power, inverse = _powers_upto(len(raw) + 1)
    sums = np.cumsum((_LOW[raw].astype(_U) + _U(1)) * power[: len(raw)], dtype=_U)
    at = np.concatenate([np.zeros(1, _U), sums])
    hashes = _mixed((at[end] - at[start]) * inverse[start])
    ends = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    return hashes, counts


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles: all runs of width words, or the whole text if it has fewer."""
    hashes, counts = word_hashes(texts)
    n = len(hashes) - width + 1
    runs = np.zeros(max(n, 0), _U)
    for j in range(width):
        runs += hashes[j : j + len(runs)] * _U(_STEPS[j % 8] * (2 * (j // 8) + 1) & (1 << 64) - 1)
    runs = _mixed(runs)
    out, at = [], 0
    for m in counts.tolist():
        if m >= width:
            out.append(np.unique(runs[at : at + m - width + 1]))
        elif m:
            few = hashes[at : at + m]
            out.append(_mixed(np.array([sum(int(h) * _STEPS[j % 8] for j, h in enumerate(few)) + m & (1 << 64) - 1], _U)))
        else:
            out.append(np.zeros(0, _U))
        at += m
    return out


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


mixed = _mixed


def steps(j: int) -> np.uint64:
    """The factor of word j of a shingle."""
    return _U(_STEPS[j % 8] * (2 * (j // 8) + 1) & (1 << 64) - 1)


def hashed_runs(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the maximal runs of bytes that `inside` marks, A-Z in lower case, and where they begin and end."""
    edge = np.diff(np.concatenate([[False], inside[raw], [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers_upto(len(raw) + 1)
    at = np.concatenate([np.zeros(1, _U), np.cumsum((_LOW[raw].astype(_U) + _U(1)) * power[: len(raw)], dtype=_U)])
    return _mixed((at[end] - at[start]) * inverse[start]), start, end
