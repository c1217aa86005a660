"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from small_rows import ROWS

from tidemark.llm import byte_bpe, exact_dedup, language_id, maxent_lm, mixing, ngram_join, quality_classifier, quality_rules, substring_dedup, token_histogram

MULTI = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI[0], "rb"))}
    return tiktoken.Encoding("own", pat_str=MULTI[1], mergeable_ranks=ranks, special_tokens={})


def test_quality_rules(docs, none):
    def expect(i, t):
        w, t = words(t), t or ""
        grams = Counter(zip(w, w[1:], w[2:]))
        inside = {k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        return i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)

    got = quality_rules.verdicts(docs)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted((expect(i, t) for i, t, *_ in ROWS), key=repr)
    order = list(quality_rules.RULES)
    kept = rows(quality_rules.verdicts(docs, order=order).where("kept"), "doc_id")
    for o in (order, order[::-1]):
        assert rows(quality_rules.keep(docs, order=o), "doc_id") == kept
    assert quality_rules.keep(docs, order=order).columns == docs.columns
    assert quality_rules.verdicts(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    size = Counter()
    for r in ROWS:
        size[r[3]] += len(words(r[1]))
    taken, targets = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
    assert taken == {s: math.floor(t) for s, t in targets.items()}
    assert math.isclose(sum(targets.values()), 1.5 * sum(size.values()))
    assert all(t <= 2 * size[s] + 1e-6 for s, t in targets.items())
    again = mixing.mix(docs.repartition(5))
    assert rows(again, "doc_id", "size", "taken") == sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=repr)
    assert mixing.mix(none).count() == 0
    copies, want = Counter(r["doc_id"] for r in mixing.mixed_rows(docs).collect()), Counter()
    for r in got:
        if r["size"]:
            want[r["doc_id"]] += math.ceil(r["taken"] / r["size"])
    assert all(copies[i] == n for i, n in want.items())
    assert mixing.mixed_rows(docs).columns == docs.columns


@pytest.mark.parametrize("i", [None, 7])
def test_mixing_rows_of_one_id(spark, i):
    """Rows of equal id and size are cut at the budget, too, and lie in many ranges; which partitions they are in does not matter."""
    rows = [(i, "w " * 100, "a", n) for n in range(1000)] + [(1000 + k, "v " * 10, "a", k) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(5)
    got = mixing.mix(df)
    budget = got.first()["target"]
    assert got.agg({"taken": "sum"}).first()[0] == math.floor(budget) == 150750
    kept = Counter(r["doc_id"] for r in mixing.mixed_rows(df).collect())
    words = 100 * kept[i] + 10 * sum(n for k, n in kept.items() if k != i)
    assert 150750 <= words < 150850
    assert got.select("r").distinct().count() == 1050
    assert got.groupBy(got["r"].substr(1, 2)).count().agg({"count": "max"}).first()[0] < 20
    assert rows_of(mixing.mix(df.repartition(2))) == rows_of(got)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(df["doc_id"].cast("string"), "size", "taken", "r").fillna("none").collect())


def test_byte_bpe_round_trip(docs, none, encoding):
    def expect(i, t):
        ids = encoding.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert rows(byte_bpe.digests(docs, *MULTI), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted((expect(i, t) for i, t, *_ in ROWS), key=repr)
    assert byte_bpe.digests(none, *MULTI).count() == 0


@pytest.mark.parametrize("text", ["a b  c\n d" * 50, "x" * 300, "é  ö " * 40, "1 2,3 . 'll don't" * 30, "a \n b" * 60])
def test_byte_bpe_cuts(text, encoding):
    cut = list(byte_bpe.pieces(text, 7))
    assert "".join(cut) == text
    assert [i for p in cut for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_token_histogram(docs, none, encoding):
    n = np.array([len(encoding.encode_ordinary(t or "")) for _, t, *_ in ROWS])
    limits = token_histogram.token_limits(docs, *MULTI).persist()
    for r in limits.collect():
        x = r["n_tokens"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"], r["tokens_if_cut"], r["docs_whole"]) == ((n == x).sum(), (n >= x).sum(), n[n >= x].sum(), np.minimum(n, x).sum(), (n <= x).sum())
    for limit in (0, 3, 50, 10**9):
        assert token_histogram.tokens_if_cut(limits, limit) == np.minimum(n, limit).sum()
    assert token_histogram.quantile(limits, 0.5) == sorted(n)[math.ceil(len(n) / 2) - 1]
    assert token_histogram.token_limits(none, *MULTI).count() == 0


def test_exact_dedup(docs, none):
    norm = lambda t: "".join(words(t))
    by = {}
    for i, t, *_ in ROWS:
        by.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0))
    got = exact_dedup.groups(docs)
    expect = []
    for i, t, *_ in ROWS:
        best = min(by[norm(t)])
        expect.append((i, None if best[1] else best[2], len(by[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()))
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(expect, key=repr)
    assert got.where("kept").count() == len(by) and exact_dedup.groups(none).count() == 0
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns and left.count() == len(by)


def test_substring_dedup(docs, none):
    seen, expect = {}, []
    texts = [(i if i is not None else 1 << 63, i, words(t)) for i, t, *_ in ROWS]
    for k, _, w in texts:
        for j in range(len(w) - 19):
            x = tuple(w[j : j + 20])
            seen[x] = min(seen.get(x, (k, j)), (k, j))
    for k, i, w in texts:
        gone = {p for j in range(len(w) - 19) if seen[tuple(w[j : j + 20])] < (k, j) for p in range(j, j + 20)}
        expect.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    assert rows(substring_dedup.without_repeats(docs), "doc_id", "n_words", "n_removed", "kept_text") == sorted(expect, key=repr)
    assert substring_dedup.without_repeats(none).count() == 0


def test_ngram_join(docs, none):
    def shingles(t):
        w = words(lower(t))
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())

    s = [(i, shingles(t)) for i, t, *_ in ROWS]
    of = list(range(len(s)))
    for a in range(len(s)):
        for b in range(a):
            if s[a][1] and 100 * len(s[a][1] & s[b][1]) >= 80 * len(s[a][1] | s[b][1]):
                of = [of[b] if x == of[a] else x for x in of]
    name = {c: min((s[j][0] for j in range(len(s)) if of[j] == c and s[j][0] is not None), default=None) for c in set(of)}
    assert rows(ngram_join.classes(docs), "doc_id", "n_shingles", "component_id") == sorted(((i, len(x), name[c]) for (i, x), c in zip(s, of, strict=True)), key=repr)
    assert ngram_join.classes(none).count() == 0
    assert ngram_join.one_of_each(docs).columns == docs.columns


def test_ngram_join_chain_and_group(spark):
    """A chain of near copies joins end to end, and a large group of copies of them too."""
    base = [f"w{i}" for i in range(200)]
    texts = [(i, " ".join([f"v{j}" for j in range(3 * i)] + base[3 * i :])) for i in range(8)]
    texts += [(100 + i, texts[3][1].replace("w150", f"z{i}")) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert {r["component_id"] for r in ngram_join.classes(df).collect()} == {0}


def test_language_id(docs, none, spark):
    many = spark.createDataFrame([(i, ("the and of with that " if i % 2 else "der und die nicht ist ") * 8, "en" if i % 2 else "de", "s") for i in range(200)], "doc_id long, text string, lang string, source string")
    got = language_id.predictions(many).collect()
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") and 0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    small = {(r["doc_id"], r["lang_pred"] == "und") for r in language_id.predictions(docs).collect()}
    assert {(1, True), (2, True), (3, True), (4, False), (9, False)} <= small
    assert language_id.predictions(none).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    scores, steps, lengths = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([4, 2, 3])
    got, at = language_id.forward_backward(scores, steps, lengths), 0
    for n in lengths:
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        p = np.exp([sum(scores[at + i, y[i]] for i in range(n)) + sum(steps[a, b] for a, b in zip(y, y[1:])) for y in paths])
        for i in range(n):
            assert np.allclose(got[at + i], [p[paths[:, i] == y].sum() / p.sum() for y in range(3)])
        at += n


def test_maxent_lm(docs, none):
    c, rows_ = Counter(), [(i, words(lower(t)) + [None]) for i, t, *_ in ROWS]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, w in rows_:
        if not held(i):
            c.update(w)
    n, v = sum(c.values()), len(c)
    base = lambda w: sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
    got = maxent_lm.scores(docs).collect()
    expect = sorted(((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(base(w), 4)) for i, w in rows_), key=repr)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=repr) == expect
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert maxent_lm.scores(none).count() == 0
    untrained = maxent_lm.scores(docs.where(maxent_lm.held_out("doc_id"))).collect()
    assert untrained and all(abs(r["base_score"]) < 1e-9 and r["n_known"] == r["train_tokens"] == 0 for r in untrained)  # the unknown word alone is left
    assert all(r["score"] == pytest.approx(-r["n_tokens"] * math.log10(maxent_lm.TAILS)) for r in untrained)


def small_model(monkeypatch, rng, n=300):
    """A model of n words with random counts, clusters and weights, few of them in the head; and the tails' words with counts."""
    monkeypatch.setattr(maxent_lm, "WIDTH", 4)
    monkeypatch.setattr(maxent_lm, "CLUSTERS", 2)
    monkeypatch.setattr(maxent_lm, "TAILS", 2)
    hashes = (rng.integers(1, 1 << 60, n).astype(np.uint64) << np.uint64(3)) | rng.integers(0, 2, n).astype(np.uint64)
    counts = np.sort(rng.integers(1, 50, n))[::-1]
    head, tail = slice(0, n - 60), slice(n - 60, n)
    tails = np.bincount((hashes[tail] & np.uint64(7)).astype(int), counts[tail] + 0.5, minlength=2) + 0.5
    m = maxent_lm.Model(hashes[head], counts[head], int(counts.sum()), n, tails)
    m.set_clusters(rng.random((n - 60, maxent_lm.SEEDS)))
    return m, hashes, counts, tail


def test_maxent_lm_sums_to_one(monkeypatch):
    rng = np.random.default_rng(2)
    m, hashes, counts, tail = small_model(monkeypatch, rng)
    text = lambda x: (np.array([hashes[3], hashes[5], x]), np.array([0, 3]))
    for weights in (0.0, 1.0):
        m.weights[:] = weights * rng.normal(size=m.weights.shape)
        heads = sum(math.exp(m.logs(*text(x))[2]) for x in hashes[: tail.start])
        tails = sum(math.exp(m.logs(*text(x))[2]) * (c + 0.5) for x, c in zip(hashes[tail], counts[tail], strict=True))
        unknown = sum(math.exp(m.logs(*text(np.uint64(8 * 12345 + t)))[2]) * 0.5 for t in (0, 1))
        assert math.isclose(heads + tails + unknown, 1.0, rel_tol=1e-4)
        if not weights:  # without weights, a word's probability is its share of the counts
            mass = counts.sum() + 0.5 * len(counts) + 1.0
            assert all(math.isclose(math.exp(m.logs(*text(x))[2]), (c + 0.5) / mass, rel_tol=1e-3) for x, c in zip(hashes[: tail.start], counts, strict=False))


def test_maxent_lm_step_follows_the_gradient(monkeypatch):
    """One small step over a text changes the weights along the finite differences of its log-probability."""
    rng = np.random.default_rng(4)
    m, hashes, *_ = small_model(monkeypatch, rng)
    m.weights[:] = 0.3 * rng.normal(size=m.weights.shape)
    found, at = rng.choice(hashes, 40), np.array([0, 40])
    one, two = maxent_lm._before(found, at)
    grads = np.zeros(m.weights.shape)
    for _, node, taken, rows in m.levels(found, maxent_lm._features(one, two)):
        x = maxent_lm._scores(m.weights, m.bias, node, rows)
        x = np.exp(x) / np.exp(x).sum(1, keepdims=True)
        x[np.arange(len(taken)), taken] -= 1
        ids, _, g = maxent_lm._by_row(x, rows)
        np.add.at(grads, ids, g)
    m.weights = m.weights.astype(float)
    for r, c in zip(*np.nonzero(np.abs(grads) > 0.05), strict=True):
        ends = []
        for e in (1e-3, -1e-3):
            m.weights[r, c] += e
            ends.append(m.logs(found, at).sum())
            m.weights[r, c] -= e
        assert math.isclose(-grads[r, c], (ends[0] - ends[1]) / 2e-3, abs_tol=2e-2)


def test_maxent_lm_learns_what_follows(spark):
    """Words that always follow one another are likelier than their counts say, in texts not learned from, too."""
    rng = np.random.default_rng(6)
    pairs = [(f"a{i}", f"b{i}") for i in range(12)]
    texts = [(i, " ".join(f"{a} {b}" for a, b in (pairs[j] for j in rng.integers(0, 12, 60)))) for i in range(400)]
    got = maxent_lm.scores(spark.createDataFrame(texts, "doc_id long, text string")).where("held_out")
    r = got.selectExpr("sum(score) / sum(n_tokens) as m", "sum(base_score) / sum(n_tokens) as b").first()
    assert r["m"] > r["b"] + 0.3


def test_maxent_lm_table_changes_no_score(docs, monkeypatch):
    every = {(r["doc_id"], r["n_tokens"]): (r["base_score"], r["n_known"], r["score"]) for r in maxent_lm.scores(docs.coalesce(1)).collect()}
    monkeypatch.setattr(maxent_lm, "TABLE", 3)
    few = {(r["doc_id"], r["n_tokens"]): (r["base_score"], r["n_known"], r["score"]) for r in maxent_lm.scores(docs.coalesce(1)).collect()}
    assert few.keys() == every.keys() and all(few[k] == pytest.approx(every[k], rel=1e-6, abs=1e-6) for k in few)


def test_commonest_words_are_all_that_reach_a_count(spark):
    rng = np.random.default_rng(9)
    n = np.concatenate([np.ones(500, int), rng.integers(1, 9, 300), rng.integers(1, 100_000, 50), [1 << 40]])
    counts = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(n)], "key long, n long")
    bins = Counter(int(math.log2(x)) for x in n)
    for most in (0, 1, 3, 40, 60, 200, 400, len(n) - 1, len(n), 10**6):
        least = maxent_lm._least(counts, bins, most)
        assert (n >= least).sum() <= most or least == 1
        low = max((x for x in n if x < least), default=0)
        assert low == 0 or (n >= low * (1 - 1 / 512)).sum() > most


def test_quality_classifier(docs, none, spark):
    ratings = spark.createDataFrame([(i, i % 3) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, grade int")
    texts = spark.createDataFrame([(i, ("bad worse " if i % 3 == 0 else "dull plain " if i % 3 == 1 else "fine clear ") * 5 + f"x{i}") for i in range(300)] + [(900, None), (901, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_classifier.selection(texts, ratings).collect()}
    assert all(got[i]["selected"] == (i % 3 == 2) for i in range(300)) and 0 <= got[900]["tail_probability"] <= 1
    assert got[0]["expected_grade"] < got[1]["expected_grade"] < got[2]["expected_grade"]
    empty = quality_classifier.selection(docs, ratings.where("false")).collect()
    assert len(empty) == len(ROWS) and not any(r["selected"] for r in empty)
    assert quality_classifier.selection(none, ratings).count() == 0


def test_quality_classifier_learns_from_all_ids_beside_a_repeated_one(spark, monkeypatch):
    """Rows alike in id and text take no room of others in the sample."""
    texts = [(i, f"{'good' if i % 3 == 2 else 'poor' if i % 3 else 'bad'} text x{i}") for i in range(60)]
    df = spark.createDataFrame(texts + [texts[0]] * 1940, "doc_id long, text string").repartition(4)
    seen = []
    monkeypatch.setattr(quality_classifier, "TRAIN_ROWS", 80)
    monkeypatch.setattr(quality_classifier, "train", lambda t, g, n, f=quality_classifier.train: seen.append(len(t)) or f(t, g, n))
    got = quality_classifier.selection(df, spark.createDataFrame([(i, i % 3) for i in range(60)], "doc_id long, grade int")).collect()
    assert seen == [60] and len(got) == 2000
    assert len({r["expected_grade"] for r in got if r["doc_id"] == 0}) == 1


def test_substring_dedup_copies_without_ids(spark):
    """Copies without ids are one document to each other, and later than any row with an id."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text)] * 500 + [(3, "a b c " + text), (None, text + " more words")] * 1
    got = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in got) == sorted([("3", 63, 0), ("None", 62, 60), *[("None", 60, 60)] * 500])
    alone = substring_dedup.without_repeats(spark.createDataFrame([(None, text)] * 300, "doc_id long, text string")).collect()
    assert {r["n_removed"] for r in alone} == {0}
