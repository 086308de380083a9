"""Generator of the frozen Unicode tables from the Unicode character database.

    python -m corpusloom.functions.gentables UnicodeData.txt

prints the two tables of :mod:`corpusloom.functions.unicode15`: ranges of letters
and numbers, and runs of simple lower-case mappings, both without ASCII.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from pathlib import Path


def read(lines: Iterable[str]) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """(ranges of token code points, lower case) from lines of UnicodeData.txt."""
    codes: list[tuple[int, int]] = []
    lower: dict[int, int] = {}
    first = 0
    for line in lines:
        f = line.rstrip("\n").split(";")
        if len(f) < 14:
            continue
        code = int(f[0], 16)
        if f[1].endswith(", First>"):
            first = code
            continue
        start = first if f[1].endswith(", Last>") else code
        if f[2][0] in "LN" and code >= 0x80:
            if codes and codes[-1][1] + 1 == start:
                codes[-1] = codes[-1][0], code
            else:
                codes.append((start, code))
        if f[13] and code >= 0x80:
            lower[code] = int(f[13], 16)
    return codes, lower


def packed_ranges(ranges: list[tuple[int, int]]) -> str:
    """Each range as its distance from the end of the one before and, after a dot, its length less one."""
    out, end = [], 0
    for a, b in ranges:
        out.append(f"{a - end:x}" + (f".{b - a:x}" if b > a else ""))
        end = b
    return " ".join(out)


def packed_lower(lower: dict[int, int]) -> str:
    """Runs of capitals: first, how many, step, distance to the small letter."""
    codes, out, i = sorted(lower), [], 0
    while i < len(codes):
        a, d = codes[i], lower[codes[i]] - codes[i]
        run = {}
        for step in (1, 2):
            n = 1
            while lower.get(a + n * step, -1) - (a + n * step) == d and (step == 1 or a + n * step - 1 not in lower):
                n += 1
            run[step] = n
        step = 1 if run[1] >= run[2] else 2
        out.append(f"{a:x},{run[step]},{step},{d}")
        i += run[step]
    return " ".join(out)


def main(path: str) -> None:
    ranges, lower = read(Path(path).read_text(encoding="ascii").splitlines())
    print("_RANGES:", packed_ranges(ranges), "", "_LOWER:", packed_lower(lower), sep="\n")


if __name__ == "__main__":
    main(sys.argv[1])
