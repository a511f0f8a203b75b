"""Check digits as array expressions: the 7-3-1 scheme of code lines and Verhoeff's scheme."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioworks import vocab


def _characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda ch: ch != "")


def weighted_check_digit(c: Column) -> Column:
    """Digits count as themselves, letters from A=10, the filler as 0; weights 7, 3, 1 repeat; modulo 10."""
    w = F.array(*[F.lit(x) for x in vocab.CHECK_WEIGHTS])
    alphabet = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    value = lambda ch: F.greatest(F.instr(alphabet, ch) - 1, F.lit(0))
    terms = F.transform(_characters(c), lambda ch, i: value(ch) * F.element_at(w, i % 3 + 1))
    return (F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10).cast("string")


def _dihedral() -> list[int]:
    """Multiplication of the symmetries of a pentagon, row by row."""
    table = []
    for j in range(10):
        for k in range(10):
            turn = (j + k) % 5 if j < 5 else (j - k) % 5
            table.append(turn if (j < 5) == (k < 5) else turn + 5)
    return table


def _permutations() -> list[int]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([vocab.VERHOEFF_STEP[d] for d in rows[-1]])
    return [d for r in rows for d in r]


def _verhoeff_state(c: Column) -> Column:
    mult = F.array(*[F.lit(x) for x in _dihedral()])
    perm = F.array(*[F.lit(x) for x in _permutations()])
    moved = F.transform(
        F.reverse(_characters(c)), lambda d, i: F.element_at(perm, (i % 8) * 10 + d.cast("int") + 1)
    )
    return F.aggregate(moved, F.lit(0), lambda a, x: F.element_at(mult, a * 10 + x + 1))


def verhoeff_ok(c: Column) -> Column:
    return F.coalesce(F.when(c.rlike("^[0-9]{12}$"), _verhoeff_state(c) == 0), F.lit(False))


def verhoeff_digit(first: Column) -> Column:
    """The digit that makes `first` || digit valid (for tests and generated inputs)."""
    state = _verhoeff_state(F.concat(first, F.lit("0")))
    # the group inverse: rotations pair up with their complement, reflections with themselves
    return F.when(state.between(1, 4), 5 - state).otherwise(state).cast("string")
