"""Pieces of SQL that several queries' SQL is made of."""

from __future__ import annotations


def lcs_length(x: str, y: str) -> str:
    """SQL: length of the longest common subsequence, a row of the table per letter of x."""
    letters = f"list_transform(string_split({x}, ''), lambda c: [ord(c)])"
    row = f"""list_reduce(list_transform(range(1, length({y}) + 1), lambda j: [j]), lambda made, j: list_append(made,
              CASE WHEN ord(({y})[j[1]]) = e[1] THEN old[j[1]] + 1 ELSE greatest(old[j[1] + 1], made[-1]) END), [0::BIGINT])"""
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0 ELSE list_reduce({letters}, lambda old, e: {row}, list_transform(range(length({y}) + 1), lambda i: 0::BIGINT))[-1] END"
