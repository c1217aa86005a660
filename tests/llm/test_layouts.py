"""Operators on rows in other partitions, texts of a million characters and more, rows hard to tell apart."""

import base64
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from small_rows import ROWS

from tidemark.llm import byte_bpe, exact_dedup, language_id, mixing, ngram_join, quality_classifier, quality_rules, storage, substring_dedup, token_histogram, vectors

MULTI = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
RATINGS = [(i, i % 3) for i in range(14)] + [(4, 7), (5, -1), (6, None), (7, 1), (7, 1)]


def whole(df):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def layouts(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return [df.coalesce(1), df.repartition(2), df.repartition(64)]


def rated(df):
    ratings = df.sparkSession.createDataFrame(RATINGS, "doc_id long, grade int")
    return quality_classifier.selection(df, ratings)


@pytest.mark.parametrize(
    "run",
    [
        lambda df: quality_rules.verdicts(df, order=list(quality_rules.RULES)), lambda df: mixing.mix(df), lambda df: exact_dedup.groups(df), lambda df: byte_bpe.digests(df, *MULTI),
        lambda df: token_histogram.token_limits(df, *MULTI), lambda df: substring_dedup.without_repeats(df), lambda df: ngram_join.classes(df), lambda df: language_id.predictions(df), rated,
    ],
    ids=["quality_rules", "mixing", "exact_dedup", "byte_bpe", "token_histogram", "substring_dedup", "ngram_join", "language_id", "quality_classifier"],
)
def test_partitions_do_not_matter(layouts, run):
    first, *others = [whole(run(df)) for df in layouts]
    assert all(x == first for x in others)


def brute_substrings(rows):
    seen, out = {}, []
    texts = [(1 << 63 if i is None else i, i, (t or "").split()) for i, t in rows]
    for k, _, w in texts:
        for j in range(len(w) - 19):
            x = tuple(w[j : j + 20])
            seen[x] = min(seen.get(x, (k, j)), (k, j))
    for k, i, w in texts:
        gone = {p for j in range(len(w) - 19) if seen[tuple(w[j : j + 20])] < (k, j) for p in range(j, j + 20)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def test_passage_in_two_partitions(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, "a b c " + passage), (2, passage + " d e f")]
    for n in (1, 2, 8):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        assert whole(substring_dedup.without_repeats(df)) == brute_substrings(rows)


def test_substrings_of_rows_with_equal_short_hashes(spark):
    """Null ids, one 32-bit hash: the rows' spans stay apart."""
    r, by = random.Random(3), {}
    passage = [f"p{i}" for i in range(30)]
    pairs = spark.range(200_000).selectExpr("id", "hash(concat('u', id)) as h").toPandas()
    twice = pairs[pairs.h.duplicated(keep=False)].sort_values("h").id.tolist()[:2]
    rows = [(None, f"u{x}") for x in twice] or [(None, "x")]
    own = [" ".join(f"q{r.randrange(10**9)}" for _ in range(40)) for _ in range(30)]
    rows += [(None, x) for x in own] + [(None, own[0] + " " + " ".join(passage)), (3, " ".join(passage)), (3, own[4]), (3, own[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 5):
        assert whole(substring_dedup.without_repeats(df.repartition(n))) == brute_substrings(rows)


def test_sides_too_large_to_broadcast(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"a{i} b{i} " + passage + f" c{i}") for i in range(20)] + [(20 + i, f"{i} only") for i in range(5)]
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    assert whole(substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_substrings(rows)


@pytest.mark.parametrize("run", [" ", "\n", "\t", "\r\n", "　", "x", "é", "!", "7"])
@pytest.mark.parametrize("tail", ["", "end"])
def test_two_million_alike(run, tail):
    """White space is one match but for its last character; of the others, the library's own ids are right."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI[0], "rb"))}
    own = tiktoken.Encoding("own", pat_str=MULTI[1], mergeable_ranks=ranks, special_tokens={})
    text = "word" + run * (2_000_000 // len(run)) + tail
    got = byte_bpe.encode(text, *MULTI)
    assert byte_bpe.decode(got, *MULTI).decode() == text
    space = text[4 : len(text) - len(tail) - bool(tail)]
    if run.isspace():
        assert got == own.encode_ordinary("word") + own._encode_single_piece(space) + own.encode_ordinary(text[4 + len(space) :])
    else:
        assert got == own.encode_ordinary(text)


def test_runs_of_white_space_as_the_library_has_them():
    r = random.Random(1)
    encoding, _ = byte_bpe.tokenizer(*MULTI)
    for _ in range(60):
        text = "".join(r.choice(["word", "é", "'s", "12", "!!", "日本", "\x1c", ""]) + r.choice([" ", "\n", "\t", "　", "\xa0", " \n", "\r\n"]) * r.choice([0, 1, 2, 3000, 4096, 5000]) for _ in range(5))
        assert byte_bpe.encode(text, *MULTI) == encoding.encode_ordinary(text)


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    r = random.Random(2)
    texts = pa.array([" ".join("".join(r.choice("abcé") for _ in range(r.choice([1, 3, 9, 200]))) for _ in range(300)), None, "", " x ", "y" * 5000])
    want = vectors.words(texts)
    for n in (1, 7, 64):
        monkeypatch.setattr(vectors, "CHUNK", n)
        assert all((a == b).all() for a, b in zip(vectors.words(texts), want, strict=True))
    words = [w for t in texts.to_pylist() for w in (t or "").split()]
    assert len(set(words)) == len(set(want[0].tolist())) and len(words) == len(want[0])


def test_long_text_in_pieces():
    r = random.Random(4)
    text = " ".join("w" * r.randrange(1, 9) for _ in range(5000)) + "z" * 3000
    cut, owner = vectors.pieces(pa.array(["a", text, None]), 1000)
    assert "".join(x for x, o in zip(cut.to_pylist(), owner, strict=True) if o == 1) == text and max(map(len, cut.drop_null().to_pylist())) <= 1000
    assert owner[0] == 0 and owner[-1] == 2


def test_repeated_windows_of_a_long_text(spark):
    """Above 65,536 words, too."""
    r = random.Random(5)
    words = [f"w{r.randrange(60)}" for _ in range(70_000)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    inside = {j for x in seen.values() if len(x) > 1 for i in x for j in (i, i + 1, i + 2)}
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    assert quality_rules.verdicts(df, order=["symbols"]).first()["n_repeat_words"] == len(inside)


def test_cascade_is_planned_on_any_table(layouts):
    for df in (*layouts[:2], layouts[0].where("false")):
        plan = quality_rules.plan_cascade(df)
        assert {x[0] for x in plan} == set(quality_rules.RULES) and all(x[1] > 0 and 0 <= x[2] <= 1 for x in plan)


def test_language_of_text_without_spaces(spark):
    """What sets the languages apart comes after the first hundred bytes of one long word."""
    r = random.Random(6)
    same = lambda: "".join(r.choice("一二三四五六七八") for _ in range(60))
    rows = [(i, same() + "".join(r.choice("あいうえお" if i % 2 else "가나다라마") for _ in range(90)), "ja" if i % 2 else "ko") for i in range(400)]
    got = language_id.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    right = [r["lang_pred"] == ("ja" if r["doc_id"] % 2 else "ko") for r in got if r["held_out"]]
    assert sum(right) / len(right) > 0.95


def test_language_of_a_very_long_text(spark):
    rows = [(i, ("the and of with that " if i % 2 else "der und die nicht ist ") * (40_000 if i == 4 else 60), "en" if i % 2 else "de") for i in range(60)]
    got = {r["doc_id"]: r for r in language_id.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(x["lang_pred"] == ("en" if i % 2 else "de") and x["score"] > 0.6 for i, x in got.items())


def test_gradient_of_the_grades():
    rng = np.random.default_rng(3)
    s, grade, t, e = rng.normal(size=20), rng.integers(0, 4, 20), np.array([-1.0, 0.2, 0.9]), 1e-6
    _, by_s, by_t = quality_classifier.losses(s, grade, t)
    for i in range(len(s)):
        d = np.eye(len(s))[i] * e
        assert np.isclose(by_s[i], (quality_classifier.losses(s + d, grade, t)[0] - quality_classifier.losses(s - d, grade, t)[0]) / 2 / e, atol=1e-4)
    for j in range(len(t)):
        d = np.eye(len(t))[j] * e
        assert np.isclose(by_t[:, j].sum(), (quality_classifier.losses(s, grade, t + d)[0] - quality_classifier.losses(s, grade, t - d)[0]) / 2 / e, atol=1e-4)


def test_grades_are_as_likely_as_a_fit_over_all_finds(spark):
    """Two words and grades at random around them: tails near those of the best cumulative-link model, found by search."""
    r = random.Random(8)
    rows = [(i, ["aaa", "bbb"][i % 2], min(2, max(0, round(r.gauss(0.6 + 0.8 * (i % 2), 0.7))))) for i in range(1500)]
    model = quality_classifier.train([t for _, t, _ in rows], [g for *_, g in rows])
    got = model.tails(pa.array(["aaa", "bbb"]))
    grade = np.array([g for *_, g in rows])
    side = np.array([i % 2 for i, *_ in rows])
    best, at = np.inf, (0.0, 0.0, 1.0)
    for width in (2.0, 0.5, 0.1, 0.03):
        centre = at
        for a in np.linspace(centre[0] - width, centre[0] + width, 9):
            for b in np.linspace(centre[1] - width, centre[1] + width, 9):
                for gap in np.linspace(max(0.05, centre[2] - width), centre[2] + width, 9):
                    loss = quality_classifier.losses(np.where(side == 1, b, a), grade, np.array([0.0, gap]))[0]
                    if loss < best:
                        best, at = loss, (a, b, gap)
    want = 1 / (1 + np.exp(np.array([[0.0, at[2]]]) - np.array([[at[0]], [at[1]]])))
    assert np.abs(got - want).max() < 0.05


def test_grades_out_of_range_are_not_learned_from(spark):
    texts = spark.createDataFrame([(i, f"t{i % 3} " * 5) for i in range(60)], "doc_id long, text string")
    good = [(i, i % 3) for i in range(60)]
    tell = lambda rows: whole(quality_classifier.selection(texts, spark.createDataFrame(rows, "doc_id long, grade int")))
    assert tell(good) == tell(good + [(1, 3), (2, -1), (3, None), (None, 1), (4, 1)] + good)


def test_words_as_the_contract_has_them():
    text = "a\x0bb\x0cc\x1cd\x85e\xa0f g"
    assert len(vectors.words(pa.array([text]))[0]) == len(re.findall(r"[^\x20\x09-\x0D]+", text))
