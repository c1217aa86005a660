"""The corpus pipeline as a whole against a brute-force version on a small table."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline

from tidemark.llm import mixing, storage

SPACE_FREE = r"[^\x20\x09-\x0D]+"


def words(t):
    return re.findall(SPACE_FREE, t or "")


def documents():
    """(doc_id, text, lang, source, n_chars): clean texts, copies, near copies, junk, short, empty and null texts, a hot source, a null source."""
    rng, rows = random.Random(5), []
    clean = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(rng.randrange(60, 160))) for _ in range(60)]
    rows += [(i, t) for i, t in enumerate(clean)]
    rows += [(100 + i, t.replace(" ", "  ", 3)) for i, t in enumerate(clean[:10])]
    rows += [(200 + i, t) for i, t in enumerate(clean[5:15])]
    rows += [(300 + i, t + " tail") for i, t in enumerate(clean[20:30])]
    rows += [(400 + i, " ".join(words(t)[1:] + ["end", "more"])) for i, t in enumerate(clean[20:26])]
    rows += [(500, None), (501, ""), (502, "too short"), (503, "the same again " * 40), (504, clean[0] + " #" * 40), (505, "x!! y!! z " * 30), (506, "one line of words\n" * 20), (507, " ".join("ab" * 15 for _ in range(70)))]
    return [(i, t, "en", "hot" if i % 3 else [None, "a", "b", "c"][i % 4], len(t or "")) for i, t in rows]


def passes(t):
    w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = {k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
    n, chars, copies = len(w), sum(map(len, w)), len(lines) - len(set(lines))
    bad = n < 50 or 100 * len(inside) > 50 * n or 100 * len(re.findall(r"[#*$%&|<>]", t)) > 10 * n or (copies > 2 and 100 * copies > 30 * len(lines))
    return not (bad or chars < 2 * n or chars > 20 * n or 100 * sum(x.endswith("!!") for x in w) > 30 * n)


def one_of_equal(rows):
    best = {}
    for r in rows:
        t = "".join(words(r[1]))
        if t not in best or (-len(r[1]), r[0]) < (-len(best[t][1]), best[t][0]):
            best[t] = r
    return list(best.values())


def one_of_near(rows):
    def shingles(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    sets, of = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[0] for r in rows}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and of[a] != of[b]:
                low, high = sorted((of[a], of[b]))
                of = {k: low if c == high else c for k, c in of.items()}
    return [r for r in rows if of[r[0]] == r[0]]


def mix(rows):
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level >= 2 * size[s]]
        for s in full or open_:
            target[s] = min(2 * size[s], weight[s] * level)
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    out = []
    for s in names:
        epochs, rest = divmod(math.floor(target[s]), size[s])
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
            out += [r] * (epochs + (rest > 0))
            rest -= len(words(r[1]))
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_run_against_brute_force(spark, sf_dir):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kept = [r for r in documents() if passes(r[1])]
    single = one_of_equal(kept)
    apart = one_of_near(single)
    mixed = mix(apart)
    assert len(documents()) > len(kept) > len(single) > len(apart) and len({r[0] for r in mixed}) < len(mixed)

    def encoded(r):
        ids = encoding.encode_ordinary(r[1])
        return r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()

    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(map(encoded, mixed))


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name


def test_no_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name


def test_null_and_repeated_ids(spark, tmp_path):
    """Rows without an id, and several of one id, go through every stage; each source gives its budget up to one row."""
    text = lambda i: " ".join(f"word{i}x{j}" for j in range(60 + i % 7))
    rows = [(None, text(i), "en", "a", 0) for i in range(30)] + [(5, text(100 + i), "en", "a", 0) for i in range(10)] + [(200 + i, text(200 + i), "de", None, 0) for i in range(20)]
    rows += [(None, text(3), "en", "a", 0), (5, text(104), "en", "a", 0), (300, None, "en", "a", 0), (None, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = storage.materialise(stage(spark, docs, str(tmp_path)), "test")
    assert docs.count() == 60 and docs.where("text is null or text = ''").count() == 0
    goal = {r["source"]: math.floor(r["target"]) for r in mixing.mix(docs).collect()}
    taken = Counter()
    for r in corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect():
        taken[r["source"]] += len(words(r["text"]))
    assert set(taken) == set(goal) == {"a", None}
    assert all(goal[s] <= n < goal[s] + 67 for s, n in taken.items())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 60
