"""Least squares over sparse columns by orthogonal elimination, piece of rows by piece and then pairs of pieces.

A front is what is left of some rows: columns (ascending numbers) and a matrix with no more rows than columns.  Columns that no
other front has are local; they are taken off by the singular vectors of their part, and their directions shorter than ``RANK``
(columns have length 1 over all rows) are left out there, where they do no harm to the others: orthogonal steps change the columns by
rounding alone, so what is left out is as if it had never been asked for.  A direction's own fit is wrong by rounding over ``RANK`` at most.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

RANK = 1e-9
#: Rows of a first piece; pieces that one step puts together.
PIECE, PAIRS = 512, 4


@dataclass
class Factor:
    """The local columns of a front in terms of their directions y: ``local`` = solve (y - r ``rest``)."""

    local: np.ndarray
    rest: np.ndarray
    solve: np.ndarray  # local columns x directions
    r: np.ndarray  # directions x rest columns


@dataclass
class Front:
    columns: np.ndarray
    m: np.ndarray


def eliminated(front: Front, local: np.ndarray) -> tuple[Factor | None, Front]:
    """Takes off the columns that ``local`` tells."""
    m = front.m
    if m.shape[0] > m.shape[1]:
        m = np.linalg.qr(m, mode="r")
    if not local.any():
        return None, Front(front.columns, m)
    u, s, vt = np.linalg.svd(m[:, local], full_matrices=False)
    kept = s > RANK
    q, rest = u[:, kept], m[:, ~local]
    r = q.T @ rest
    left = rest - q @ r
    again = q.T @ left
    left, r = left - q @ again, r + again
    if left.shape[0] > left.shape[1]:
        left = np.linalg.qr(left, mode="r")
    names = front.columns[~local]
    return Factor(front.columns[local], names, vt[kept].T / s[kept], r), Front(names, left)


def together(fronts: list[Front]) -> Front:
    columns = np.unique(np.concatenate([f.columns for f in fronts]))
    m = np.zeros((sum(f.m.shape[0] for f in fronts), len(columns)))
    at = 0
    for f in fronts:
        m[at : at + len(f.m), np.searchsorted(columns, f.columns)] = f.m
        at += len(f.m)
    return Front(columns, m)


def piecewise(row: np.ndarray, column: np.ndarray, value: np.ndarray, names: np.ndarray, own: np.ndarray) -> tuple[list[Factor], Front]:
    """Factors of the columns that ``own`` tells of (among ``names``, ascending) and the front of the others, from entries (row, column,
    value); row numbers begin at 0."""
    at, piece = np.searchsorted(names, column), row // PIECE
    low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), -1)
    np.minimum.at(low, at, piece)
    np.maximum.at(high, at, piece)
    order = np.argsort(piece, kind="stable")
    cuts = np.searchsorted(piece[order], np.arange(int(piece.max(initial=0)) + 2))
    factors: list[Factor] = []
    fronts: list[Front] = []

    def put(front: Front, span: int) -> None:
        i = np.searchsorted(names, front.columns)
        factor, left = eliminated(front, own[i] & (low[i] // span == high[i] // span))
        if factor is not None:
            factors.append(factor)
        fronts.append(left)

    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
        e = order[a:z]
        columns = np.unique(column[e])
        m = np.zeros((PIECE, len(columns)))
        np.add.at(m, (row[e] - k * PIECE, np.searchsorted(columns, column[e])), value[e])
        put(Front(columns, m), 1)
    span = 1
    while len(fronts) > 1:
        span *= PAIRS
        before, fronts = fronts, []
        for k in range(0, len(before), PAIRS):
            put(together(before[k : k + PAIRS]), span)
    return factors, fronts[0]


def forward(factors: Iterable[Factor], a: np.ndarray) -> list[np.ndarray]:
    """Directions' parts of a right-hand side by columns; takes from ``a`` what they have of the columns that stay."""
    out = []
    for f in factors:
        y = f.solve.T @ a[f.local]
        a[f.rest] -= f.r.T @ y
        out.append(y)
    return out


def backward(factors: list[Factor], parts: list[np.ndarray], x: np.ndarray) -> None:
    """Columns' values in ``x``, which has those of the columns that stayed."""
    for f, y in zip(reversed(factors), reversed(parts)):
        x[f.local] = f.solve @ (y - f.r @ x[f.rest])
