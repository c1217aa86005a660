"""Fill-in-the-middle: big-integer boundaries against plain Python, outputs against string slices, the SQL, restored texts."""

import hashlib
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from small_rows import ROWS

from tidemark.llm import fill_in_middle, queries

MARKED = [(20, "has a <M> in it", "en", "a"), (21, "ends in <", "en", "a"), (22, "<S", "en", "a"), (23, "P>x<", "en", "b"), (24, "\U0001f600é́ \U0001f1e9\U0001f1ea", "de", "b")]


def units(text, unit):
    if unit == "code_point":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    lead = re.match(r"[\x20\x09-\x0D]*", text)[0]
    found = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    return [lead + found[0], *found[1:]] if found else [lead] if lead else []


def expected(i, text, unit="code_point"):
    t, h = text or "", hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = units(t, unit)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(u), "plain", None, None, t
    if h[3] % 100 < 20:
        return i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", fill_in_middle.UNITS)
def test_units(unit):
    rng = random.Random(3)
    for n in [*range(40), 1000, 4097]:
        t = "".join(rng.choice("ab é\n\t€\U0001f600 ") for _ in range(n))
        found, want = fill_in_middle.ends(t.encode(), unit), units(t, unit)
        places, at = [], 0
        for u in want:
            at += len(u.encode())
            places.append(at - 1)
        assert found.bit_count() == len(want) and found == sum(1 << p for p in places)
        assert [fill_in_middle.select(found, max(len(t.encode()), 1), r + 1) for r in range(len(want))] == places


@pytest.mark.parametrize("unit", fill_in_middle.UNITS)
def test_transformed(spark, docs, unit):
    rows = [*ROWS, *MARKED, *[(100 + i, f"text {i} of é words\nand a line", "en", "a") for i in range(60)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n", F.lit("other")).withColumn("form", F.lit("other")).repartition(3)
    got = fill_in_middle.transformed(df, unit=unit).withColumn("restored", fill_in_middle.restored()).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted((expected(r[0], r[1], unit) for r in rows), key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    texts = {r[0]: r[1] or "" for r in rows}
    assert all(r["restored"] == texts[r["doc_id"]] for r in got)


def test_long_text_and_empty_table(spark, none):
    text = "wörter und mehr, " * 200_000
    r = fill_in_middle.transformed(spark.createDataFrame([(5, text)], "doc_id long, text string")).withColumn("restored", fill_in_middle.restored()).first()
    assert tuple(r)[:-1] == expected(5, text) and r["restored"] == text
    assert fill_in_middle.transformed(none).count() == 0
    with pytest.raises(ValueError, match="no unit"):
        fill_in_middle.transformed(none, unit="sentence")


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no tables here")
def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = c.execute(queries.OP11)
    names = [x[0] for x in cur.description]
    got = queries.op11_fill_in_middle(spark, sf)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
