"""Frozen Unicode 15.0.0: which code points make tokens, and their simple lower case.

Derived from the Unicode character database.  Tokens are runs of letters and
numbers; marks, joiners and underscores part them.  ASCII is not listed.
"""

from __future__ import annotations

import re
import unicodedata

UNICODE_VERSION = "15.0.0"

#: Ranges in hexadecimal, each as its distance from the end of the one before and, after a dot, its length less one.
_RANGES = """
aa 8.1 2 4.1 2.2 2.16 2.1e 2.1c9 5.b f.4 8 2 82.4 2.1 3.3 2 7 2.2 2 2.13 2.52 2.8a 9.a5 2.25 3 7.28 48.1a 5.3
2e.2a 16.9 5.1 2.62 2 10.1 8.e 3 11 2.1d 1e.58 c f.2a a.1 5 6.15 5 a 4 18.18 8.a 6.17 2.5 12.29 3b.35 4 13 8.9
5.9 2.f 5.7 3.1 3.15 2.6 2 4.3 4 11 e.1 2.2 5.b 3.5 3 9.5 5.1 3.15 2.6 2.1 2.1 2.1 20.3 2 8.9 3.2 11.8 2.2
2.15 2.6 2.1 2.4 4 13 10.1 5.9 a c.7 3.1 3.15 2.6 2.1 2.4 4 1f.1 2.2 5.9 2.6 c 2.5 4.2 2.3 4.1 2 2.1 4.1 4.2
4.b 17 16.c 13.7 2.2 2.16 2.f 4 1b.2 3 3.1 5.9 9.6 2 5.7 2.2 2.16 2.9 2.4 4 20.1 2.1 5.9 2.1 12.8 2.2 2.28 3
11 6.2 2.9 5.12 2.5 6.11 4.17 2.8 2 3.6 20.9 12.2f 2.1 d.6 a.9 28.1 2 2.4 2.17 2 2.9 2.1 a 3.4 2 a.9 3.3 21
20.13 d.7 2.23 1c.4 74.2a 15.a 7.5 5.3 4 4.1 8.2 5.c d 2.9 7.25 2 6 3.2a 2.14c 2.3 3.6 2 2.3 3.28 2.3 3.20 2.3
3.6 2 2.3 3.e 2.38 2.3 3.42 f.13 4.f 11.55 3.5 4.26b 3.10 2.19 6.4a 4.a 8.11 e.12 f.11 f.c 2.2 10.33 24 5 4.9
7.9 17.9 7.58 8.4 3.21 2 6.45 b.1e 28.27 3.4 c.2b 5.19 7.a 26.16 a.34 2c.9 7.9 e 5e.2e 12.7 4.9 2a.1d e.37
1b.23 1d.9 4.30 3.8 8.2a 3.2 2a.3 2.5 2.1 4 6.bf 41.115 3.5 3.25 3.5 3.7 2 2 2 2.1e 3.34 2.6 2 4.2 2.6 4.3 3.5
5.c 6.2 2.6 74.1 3.5 6.a 7.c 66 5 3.9 2 4.4 7 2 2 2.3 2.a 3.3 6.4 5 2.39 2d7.3b 4f.15 277.1d 46d.e4 7.3 4.1 a
3.25 2 6 3.37 8 11.16 a.6 2.6 2.6 2.6 2.6 2.6 2.6 2.6 51 1d6.2 1a.8 8.4 3.4 5.55 7.2 2.59 2.3 6.2a 2.5d 4.3
b.1f 31.f 21.9 1f.7 2.e 21.9 28.e 141.19bf 41.568c 44.2d 3.10c 4.1b 15.2e 11.1e 3.4f 28.8 3.66 3.3f 6.1 2 2.4
19.f 2.2 2.3 2.16 e.5 b.33 f.31 1d.9 19.5 4 2.1 2.25 b.16 1a.1c 8.2e 1d.a 7.4 2.18 2.28 18.2 2.7 5.9 7.16 4
4.31 2 4.1 3.4 3 2 19.2 3.a 8.2 d.5 3.5 3.5 a.6 2.6 2.2a 2.d 7.72 e.9 7.2ba3 d.16 5.30 2105.16d 3.69 27.6 d.4
6 2.9 2.c 2.4 2 2.1 2.1 2.6b 22.16a 13.3f 3.35 29.b 75.4 2.86 14.9 8.19 7.19 c.58 4.5 3.5 3.5 3.2 24.b 2.19
2.12 2.1 2.e 3.d 23.7a d.2c d.38 12.1 f5.1c 4.30 11.1a 5.23 a.1d 6.25 b.1d 3.23 5.7 2.4 2b.9d 3.9 7.23 5.23
5.27 9.33 d.a 2.e 2.6 2.1 2.a 2.e 2.6 2.1 44.136 a.15 b.7 19.5 2.29 2.8 46.5 3 2.2b 2.1 4 3.16 3.1e 3.25 9.8
31.12 2.1 6.20 5.19 47.37 5.13 3.2e 10.3 2.2 2.1c b.8 18.1e 2.1f 21.7 2.1b 7.4 11.35 b.15 3.1a 6.19 18.6 51.48
38.32 e.32 8.29 d.9 127.1e 2.29 7.1 4f.27 9.15 c.3 1c.11 2f.1b 15.16 d.34 1b.1d 2.1 3 e.2c 21.18 8.9 a.23 10.9
5 3 9.22 4 d.2f f.3 c.a 2 5.13 c.11 2.18 14.1 40.6 2 2.3 2.e 2.9 8.2e 12.9 c.7 3.1 3.15 2.6 2.1 2.4 4 13 d.4
9f.34 13.3 6.9 6.2 1f.2f 15.1 2 9.9 a7.2e 2a.3 25.2f 15 c.9 27.2a e 8.9 37.1a 16.b 5.6 ba.2b 75.52 d.7 3 3.7
2.1 2.17 10 2 f.9 47.7 3.26 11 2 1d b.27 8 16 c.2d 14 13.48 108.8 2.24 12 10.1c 6.1d 71.6 2.1 2.25 16 a.9 7.5
2.1 2.1f f 8.9 137.12 10 2.c 2.21 1d.9 57 10.14 2c.399 67.6e 12.c3 a4d.60 10.42f 12.5 fba.246 21ba.238 8.1e
2.9 7.4e 2.9 7.1d 13.2f 11.3 d.9 2.6 2.14 6.12 2b1.56 6a.4a 6 43.c 41.1 2 1d.17f7 9.4d5 2b.8 22e8.3 2.6 2.1
2.122 10 1e.2 3 f.3 9.18b 905.6a 6.c 4.8 8.9 1627.13 d.13 6d.18 88.54 2.46 2.1 3 3.1 3.3 2.b 2 2.6 2.40 2.3
3.7 2.6 2.1b 2.3 2.4 2 4.6 2.153 3.18 2.18 2.1e 2.18 2.1e 2.18 2.1e 2.18 2.1e 2.18 2.7 3.31 701.1e 7.5 106.3d
93.2c b.6 3.9 5 142.1d 13.2b 5.9 1d7.1b 5.9 2e7.6 2.3 2.1 2.e 2.c4 3.8 31.43 8 5.9 318.3a 2.2 2.3 4d.2c 2.e
c3.3 2.1a 2.1 2 3 2.9 2.3 2 2 7 5 2 2 2.2 2.1 2 3 2 2 2 2 2.1 2 3.3 2.6 2.3 2.3 2 2.9 2.10 6.2 2.4 2.10 245.c
ae4.9 407.a6df 21.1039 7.dd 3.1681 f.1d30 c20.21d 5e3.134a 6.105f
"""

#: Runs of capitals: first, how many, step, distance to the small letter.
_LOWER = """
c0,23,1,32 d8,7,1,32 100,24,2,1 130,1,1,-199 132,3,2,1 139,8,2,1 14a,23,2,1 178,1,1,-121 179,3,2,1 181,1,1,210
182,2,2,1 186,1,1,206 187,1,1,1 189,2,1,205 18b,1,1,1 18e,1,1,79 18f,1,1,202 190,1,1,203 191,1,1,1 193,1,1,205
194,1,1,207 196,1,1,211 197,1,1,209 198,1,1,1 19c,1,1,211 19d,1,1,213 19f,1,1,214 1a0,3,2,1 1a6,1,1,218
1a7,1,1,1 1a9,1,1,218 1ac,1,1,1 1ae,1,1,218 1af,1,1,1 1b1,2,1,217 1b3,2,2,1 1b7,1,1,219 1b8,1,1,1 1bc,1,1,1
1c4,1,1,2 1c5,1,1,1 1c7,1,1,2 1c8,1,1,1 1ca,1,1,2 1cb,9,2,1 1de,9,2,1 1f1,1,1,2 1f2,2,2,1 1f6,1,1,-97
1f7,1,1,-56 1f8,20,2,1 220,1,1,-130 222,9,2,1 23a,1,1,10795 23b,1,1,1 23d,1,1,-163 23e,1,1,10792 241,1,1,1
243,1,1,-195 244,1,1,69 245,1,1,71 246,5,2,1 370,2,2,1 376,1,1,1 37f,1,1,116 386,1,1,38 388,3,1,37 38c,1,1,64
38e,2,1,63 391,17,1,32 3a3,9,1,32 3cf,1,1,8 3d8,12,2,1 3f4,1,1,-60 3f7,1,1,1 3f9,1,1,-7 3fa,1,1,1 3fd,3,1,-130
400,16,1,80 410,32,1,32 460,17,2,1 48a,27,2,1 4c0,1,1,15 4c1,7,2,1 4d0,48,2,1 531,38,1,48 10a0,38,1,7264
10c7,1,1,7264 10cd,1,1,7264 13a0,80,1,38864 13f0,6,1,8 1c90,43,1,-3008 1cbd,3,1,-3008 1e00,75,2,1
1e9e,1,1,-7615 1ea0,48,2,1 1f08,8,1,-8 1f18,6,1,-8 1f28,8,1,-8 1f38,8,1,-8 1f48,6,1,-8 1f59,4,2,-8 1f68,8,1,-8
1f88,8,1,-8 1f98,8,1,-8 1fa8,8,1,-8 1fb8,2,1,-8 1fba,2,1,-74 1fbc,1,1,-9 1fc8,4,1,-86 1fcc,1,1,-9 1fd8,2,1,-8
1fda,2,1,-100 1fe8,2,1,-8 1fea,2,1,-112 1fec,1,1,-7 1ff8,2,1,-128 1ffa,2,1,-126 1ffc,1,1,-9 2126,1,1,-7517
212a,1,1,-8383 212b,1,1,-8262 2132,1,1,28 2160,16,1,16 2183,1,1,1 24b6,26,1,26 2c00,48,1,48 2c60,1,1,1
2c62,1,1,-10743 2c63,1,1,-3814 2c64,1,1,-10727 2c67,3,2,1 2c6d,1,1,-10780 2c6e,1,1,-10749 2c6f,1,1,-10783
2c70,1,1,-10782 2c72,1,1,1 2c75,1,1,1 2c7e,2,1,-10815 2c80,50,2,1 2ceb,2,2,1 2cf2,1,1,1 a640,23,2,1
a680,14,2,1 a722,7,2,1 a732,31,2,1 a779,2,2,1 a77d,1,1,-35332 a77e,5,2,1 a78b,1,1,1 a78d,1,1,-42280 a790,2,2,1
a796,10,2,1 a7aa,1,1,-42308 a7ab,1,1,-42319 a7ac,1,1,-42315 a7ad,1,1,-42305 a7ae,1,1,-42308 a7b0,1,1,-42258
a7b1,1,1,-42282 a7b2,1,1,-42261 a7b3,1,1,928 a7b4,8,2,1 a7c4,1,1,-48 a7c5,1,1,-42307 a7c6,1,1,-35384
a7c7,2,2,1 a7d0,1,1,1 a7d6,2,2,1 a7f5,1,1,1 ff21,26,1,32 10400,40,1,40 104b0,36,1,40 10570,11,1,39
1057c,15,1,39 1058c,7,1,39 10594,2,1,39 10c80,51,1,64 118a0,32,1,32 16e40,32,1,32 1e900,34,1,34
"""


def _ranges() -> tuple[tuple[int, int], ...]:
    out, last = [], 0
    for item in _RANGES.split():
        gap, _, more = item.partition(".")
        first = last + int(gap, 16)
        last = first + int(more or "0", 16)
        out.append((first, last))
    return tuple(out)


def _lower() -> dict[int, int]:
    out = {}
    for item in _LOWER.split():
        first, n, step, d = item.split(",")
        for i in range(int(n)):
            c = int(first, 16) + i * int(step)
            out[c] = c + int(d)
    return out


RANGES = _ranges()
LOWER = _lower()
_ALL_LOWER = LOWER | {c: c + 32 for c in range(65, 91)}
#: A class for Python's re that holds exactly the token code points.
TOKEN_CLASS = "[0-9A-Za-z" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in RANGES) + "]"
TOKEN = re.compile(TOKEN_CLASS + "+")
ASCII_TOKEN = re.compile("[0-9A-Za-z]+")
#: For texts within the first plane, where a class is one table lookup.
BMP_TOKEN = re.compile("[0-9A-Za-z" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in RANGES if b <= 0xFFFF) + "]+")
#: str.lower agrees with the frozen table under these versions, but for two letters.
_SAME = unicodedata.unidata_version in {"15.0.0", "15.1.0"}
_ODD = re.compile("[\u0130\u03a3]")


def is_token(code: int) -> bool:
    return bool(TOKEN.match(chr(code)))


def lower(text: str) -> str:
    """Simple lower case, code point by code point."""
    if text.isascii() or (_SAME and not _ODD.search(text)):
        return text.lower()
    return text.translate(_ALL_LOWER)


def tokens(text: str) -> list[str]:
    """Lower-cased token runs, in order."""
    if text.isascii():
        return ASCII_TOKEN.findall(text.lower())
    first_plane = len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
    return (BMP_TOKEN if first_plane else TOKEN).findall(lower(text))
