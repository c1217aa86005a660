"""Byte-level BPE encoding and decoding with a local rank file.

Texts are cut at safe boundaries, so that a very long one is encoded piece by piece; decoding works on raw bytes,
so a cut inside a character never matters. A boundary is safe before a space that follows an ASCII letter or
digit: the split pattern lets no match go from a non-space on to a space, and looks ahead only from spaces to what
follows them, so matches on both sides are the same with and without the cut. A long run of white space is one match
of all of it, or of all but the last character if something follows; it is encoded as that one match, as the pattern's
backtracking would overflow on it. (Both hold for patterns like that of the rank files here.)

Defined cases: a null text is an empty one, with no ids; special tokens' strings are ordinary text; other columns
of the input are left out; repeated rows are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import storage

#: Characters a piece has at least before it is cut.
PIECE_CHARS = 1 << 16
#: A run of at least so many white-space characters (Unicode's White_Space) is encoded by itself.
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
#: Texts of one batch that are kept to be found again (copies), by characters.
COPY_CHARS = 1 << 20


@functools.lru_cache(maxsize=4)
def tokenizer(ranks: str, pattern: str):
    """(tiktoken encoding, decimal string of each id); built once a worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return encoding, [str(i) for i in range(max(table.values()) + 1)]


def pieces(text: str, least: int = PIECE_CHARS) -> Iterator[str]:
    """text cut at safe boundaries into pieces of least characters or somewhat more."""
    at = 0
    while len(text) - at > least:
        cut = at + least
        while (cut := text.find(" ", cut)) > 0 and not (text[cut - 1].isascii() and text[cut - 1].isalnum()):
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(text: str | None, ranks: str, pattern: str) -> list[int]:
    encoding, _ = tokenizer(ranks, pattern)
    found: list[int] = []
    text, at = text or "", 0

    def ordinary(part: str) -> None:
        for piece in pieces(part):
            found.extend(encoding.encode_ordinary(piece))

    for run in RUN.finditer(text):
        ordinary(text[at : run.start()])
        at = run.end() - (run.end() < len(text))
        found += encoding._encode_single_piece(text[run.start() : at])
    ordinary(text[at:])
    return found


def decode(ids: list[int], ranks: str, pattern: str) -> bytes:
    return tokenizer(ranks, pattern)[0].decode_bytes(ids)


def _by_batch(fields: pa.Schema, row):
    """For mapInArrow: row(text) for each text, and the batch's other columns as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part, seen = batch.slice(start, 512), {}
                found = []
                for x in part.column("text").to_pylist():
                    got = seen.get(x)
                    if got is None:
                        got = row(x)
                        if len(x or "") < COPY_CHARS:
                            seen[x] = got
                    found.append(got)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), list(fields)[1:], strict=True)]], schema=fields)

    return run


def _run(df: DataFrame, key: str, text: str, row, columns: dict[str, tuple[pa.DataType, str]]) -> DataFrame:
    storage.ship(df.sparkSession)
    kind = df.select(f"`{key}`").schema[0].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    fields = pa.schema([pa.field("id", to_arrow_type(kind)), *[pa.field(n, t) for n, (t, _) in columns.items()]])
    schema = f"id {kind.simpleString()}, " + ", ".join(f"{n} {s}" for n, (_, s) in columns.items())
    two = df.selectExpr(f"`{key}` as id", f"`{text}` as text")
    return two.mapInArrow(_by_batch(fields, row), schema).withColumnRenamed("id", key)


def ids(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) of each row."""
    return _run(df, key, text, lambda t: (encode(t, ranks, pattern),), {"ids": (pa.list_(pa.int32()), "array<int>")})


def digests(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, and decoded again from the ids."""

    def row(t: str | None) -> tuple[int, str, str]:
        found, (encoding, names) = encode(t, ranks, pattern), tokenizer(ranks, pattern)
        joined = ",".join([names[i] for i in found])
        return len(found), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(encoding.decode_bytes(found)).hexdigest()

    return _run(df, key, text, row, {"n_tokens": (pa.int64(), "bigint"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")})


def lengths(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens of each row."""
    return _run(df, key, text, lambda t: (len(encode(t, ranks, pattern)),), {"n_tokens": (pa.int64(), "bigint")})
