"""Fill-in-the-middle transformation of texts, with units found by big-integer bit-parallelism.

A text's bytes are one big integer a class: ``bytes.translate`` turns each byte into a digit of a class mask, so that
bit i says whether byte i is in the class. Shifted boolean operations on masks leave one bit where each unit ends, for
all units at once; ``bit_count`` of that mask is the number of units n, and the byte at which the r-th unit ends is
found by halving: the lower half's count says in which half the r-th bit is, so a text costs a few passes over an
eighth of its bytes, whatever its units.

Four numbers of a row's id decide how it is cut: the first two pick the ends of prefix and middle among the n + 1
places, the third whether it is cut at all, the fourth whether the suffix comes first (spm) or the prefix (psm).

Defined cases: a null text is an empty one; an empty text, and one that holds a marker, stays plain; a null id is cut
as the id ``null``; rows of equal id are cut by the same numbers; a text of any length is handled whole, a long one
alone in its batch; a text without words is one word unit; an empty table gives an empty result; other columns of the
input are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage, vectors

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, those that are cut, and of 100 cut ones those with the suffix first.
CUT, SUFFIX_FIRST = 90, 20
UNITS = ("code_point", "word", "line")


def _digits(members: Iterable[int]) -> bytes:
    inside = set(members)
    return bytes(49 if b in inside else 48 for b in range(256))


_CONTINUATION = _digits(range(0x80, 0xC0))
_SPACE = _digits([0x20, *range(0x09, 0x0E)])
_NEWLINE = _digits([0x0A])


def _mask(backwards: bytes, table: bytes) -> int:
    """Bit i tells whether byte i of the text, given last byte first, is in the table's class."""
    return int(backwards.translate(table), 2)


def ends(text: bytes, unit: str = "code_point") -> int:
    """The mask of the bytes that are the last of a unit.

    A unit is a code point, a word with the white space after it (and before it, if it is the first), or a line with
    its line feed.
    """
    if not text:
        return 0
    backwards, top = text[::-1], 1 << (len(text) - 1)
    if unit == "line":
        return _mask(backwards, _NEWLINE) | top
    every = (top << 1) - 1
    if unit == "word":
        inside = every ^ _mask(backwards, _SPACE)
        starts = inside & ~(inside << 1)
        starts &= starts - 1  # the first word's unit begins with the text
    else:
        starts = every ^ _mask(backwards, _CONTINUATION)
    return (starts >> 1) | top


def select(mask: int, width: int, rank: int) -> int:
    """The place of the rank-th set bit, from 1, of a mask of so many bits."""
    at = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        n = low.bit_count()
        if rank <= n:
            mask, width = low, half
        else:
            mask, width, rank, at = mask >> half, width - half, rank - n, at + half
    return at


def cut(text: bytes, numbers: tuple[int, int, int, int], unit: str = "code_point") -> tuple[int, str, int, int, bytes]:
    """(n, form, bytes of the prefix, bytes of prefix and middle, output) of a text."""
    found = ends(text, unit)
    n = found.bit_count()
    if not text or numbers[2] % 100 >= CUT or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", 0, 0, text
    a, b = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
    a, b = (select(found, len(text), r) + 1 if r else 0 for r in (a, b))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if numbers[3] % 100 < SUFFIX_FIRST:
        return n, "spm", a, b, b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])
    return n, "psm", a, b, b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])


def _transform(unit: str):
    def transform(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vectors.slices(batches):
            out = []
            for h, text in zip(b.column("hash").to_pylist(), b.column("text").to_pylist(), strict=True):
                n, form, p, m, output = cut(text, tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24)), unit)
                plain = form == "plain"
                # lead bytes of a part are its code points
                points = [None if plain else len(x.translate(None, bytes(range(0x80, 0xC0)))) for x in (text[:p], text[p:m])]
                out.append((n, form, *points, output))
            columns = zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, t) for c, t in columns]], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return transform


def transformed(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "code_point", seed: str = "1") -> DataFrame:
    """key, n (units), form (psm, spm or plain), prefix_chars, middle_chars (code points, null if plain), output of each row."""
    if unit not in UNITS:
        raise ValueError(f"no unit {unit!r}")
    storage.ship(df.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))), 256)
    rows = df.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"), digest.alias("hash"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_transform(unit), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string")).withColumnRenamed("id", key)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of some form was made of: a text with markers stays plain, so the first of each marker is the one put in."""
    p, s, m = (m.decode() for m in (PREFIX, SUFFIX, MIDDLE))
    first, size = {"psm": s, "spm": p}, len(p)
    parts = {}
    for k, second in first.items():
        a, b = f"locate('{second}', {output})", f"locate('{m}', {output})"
        parts[k] = (f"substring({output}, {size + 1}, {a} - {size + 1})", f"substring({output}, {a} + {size}, {b} - {a} - {size})", f"substring({output}, {b} + {size})")
    prefix, suffix, middle = parts["psm"]
    after, before, between = parts["spm"]
    return F.expr(f"case {form} when 'psm' then concat({prefix}, {middle}, {suffix}) when 'spm' then concat({before}, {between}, {after}) else {output} end")
