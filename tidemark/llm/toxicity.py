"""Toxicity by weak supervision: many voters, a generative model of their votes, a linear classifier on its labels.

Voters. Four lexicons hold hashes of words, and of words' beginnings of 4 to 8 bytes, that labelled rows show far more often
where the label is 1 than where it is 0: almost only there (pure), or much more often than chance (loose). A voter
votes if a text has so many different words of a lexicon. Pattern voters look for shouting, masked letters, runs of
marks and a sentence that goes on in lower case. Counts for the lexicons are of all labelled rows that may be learned
from.

Label model. P(y) and, for each class, the voters' accuracies and their correlations: a voter's chance depends on y and on
one other voter, along the tree that joins the voters with the most mutual information given y (a voter that says
nothing beyond y stands alone). It is fitted by EM to the counts of vote patterns of all rows; a labelled row's class
is known, any other's is its posterior. Patterns are at most 2 ** 16, so the counts are small whatever the table.

Classifier. Logistic regression on the hashed words and beginnings of a text and its votes, trained on the label model's
posteriors of about TRAIN_ROWS rows (half of them likely toxic, of about TRAIN_CHARS characters together, chosen by
hashes), then applied to every text as a whole.

Defined cases: a null text is an empty one, without words or votes, and scored by the bias; a null label, or one other
than 0 and 1, is unknown, and rows held out have no label here; an id with both labels counts for each; repeated rows
count and are scored one by one; without any learnable label of 1 every score is 0; long texts are read whole, in
pieces of 1 MB, and a word counts once a text; an empty table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import storage, vectors

TRAIN_ROWS, TRAIN_CHARS = 8000, 24_000_000
#: Bytes of the beginnings that stand beside whole words (0), and the least count of an entry in texts of label 1.
KINDS, LEAST = (0, 4, 5, 6, 7, 8), 4
#: Of pure and of loose entries: the share of label 1 in their texts, two more without label 1 assumed, how many standard errors their log odds are above 0, and the entries of a kind.
PURE, LOOSE, LEXICON = (0.88, 3.2), (0.35, 5.0), 2048
#: Different words that a voter wants: of pure words, loose words, pure beginnings, loose beginnings.
WANTED = ((1, 2), (1, 2, 3, 5), (1, 2), (1, 2, 3, 5))
#: Features that a task counts before it sends them.
SEND = 400_000
PATTERNS = ("shouting", "masked", "marks", "lower")
VOTERS = sum(map(len, WANTED)) + len(PATTERNS)
ROWS = 1 << 20
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.3, 1e-3
FOLDS, HELD_OUT = 5, 0
U = np.uint64

_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 256)]] = True


class Words:
    """The distinct words of some texts without marks at their ends, their features, and what the patterns need."""

    def __init__(self, texts: pa.Array):
        _, first, data, starts, ends = vectors.words(texts)
        n = len(first) - 1
        doc = np.repeat(np.arange(n), np.diff(first))
        mark = _MARK[data]
        # without marks at the ends: the last byte that is none up to a word's end, the first from its start on
        place = np.arange(len(data))
        bare_ends = np.maximum.accumulate(np.where(mark, -1, place))[ends - 1] + 1 if len(ends) else ends
        begins = np.minimum.accumulate(np.where(mark, len(data), place)[::-1])[::-1][starts] if len(starts) else starts
        some = begins < bare_ends
        some &= (begins < ends) & (bare_ends > starts)
        self.patterns = self._patterns(n, doc, data, mark, starts, ends)
        doc, begins, bare_ends = doc[some], begins[some], bare_ends[some]
        low = data + np.where(_UPPER[data], 32, 0).astype(np.uint8)
        hashes = vectors.hashed(low, begins, bare_ends)
        self.own, index, word = np.unique(hashes, return_index=True, return_inverse=True)
        self.texts = n
        self._pair(doc, word)
        self.features, self.has = self._features(self.own, low, begins[index], bare_ends[index])

    def _pair(self, doc: np.ndarray, word: np.ndarray) -> None:
        """(text, word) pairs, each once."""
        pairs = vectors.distinct((doc.astype(U) << U(32)) | word.astype(U))
        self.doc, self.word = (pairs >> U(32)).astype(np.int64), (pairs & U(0xFFFFFFFF)).astype(np.int64)

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        """Words of texts of any length: long ones by pieces, put together again."""
        cut, owner = vectors.pieces(texts)
        if len(cut) == len(texts):
            return cls(texts)
        parts, out = [cls(cut.slice(i, 1)) for i in range(len(cut))], cls(pa.array([], pa.string()))
        out.own, index, word = np.unique(np.concatenate([x.own for x in parts]), return_index=True, return_inverse=True)
        out.features, out.has = (np.concatenate(x)[index] for x in ([x.features for x in parts], [x.has for x in parts]))
        out.texts, out.patterns = len(texts), np.zeros((len(texts), 5), np.int64)
        np.add.at(out.patterns, owner, np.concatenate([x.patterns for x in parts]))
        shift = np.cumsum([0, *[len(x.own) for x in parts]])
        out._pair(np.repeat(owner, [len(x.word) for x in parts]), word[np.concatenate([x.word + o for x, o in zip(parts, shift, strict=False)])])
        return out

    @staticmethod
    def _features(own, low, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word's feature of each kind, whether it has one); a word is longer than its beginnings."""
        padded = np.concatenate([low, np.zeros(max(KINDS), np.uint8)])
        out, has = [vectors.mix(own ^ U(21))], [np.ones(len(own), bool)]
        code = np.full(len(starts), 7, U)
        for j in range(max(KINDS)):
            code = code * U(1_000_003) + padded[starts + j].astype(U) + U(1)
            if j + 1 in KINDS:
                out.append(vectors.mix(code ^ U((j + 1) << 56)))
                has.append(ends - starts > j + 1)
        return np.stack(out, 1), np.stack(has, 1)

    @staticmethod
    def _patterns(n, doc, data, mark, starts, ends) -> np.ndarray:
        """Counts by text: words, words in capitals, words with marks between letters, words ending in a run of marks, words in lower case after the end of a sentence."""
        out = np.zeros((n, 5), np.int64)
        if not len(starts):
            return out
        sums = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        letters, upper = sums(_LETTER[data]), sums(_UPPER[data])
        size, caps = letters[ends] - letters[starts], upper[ends] - upper[starts]
        between = np.zeros(len(data), bool)
        between[1:-1] = np.isin(data[1:-1], np.frombuffer(b"*#@$%", np.uint8)) & _LETTER[data[:-2]] & _LETTER[data[2:]]
        masked = sums(between)
        last = data[ends - 1]
        run = (ends - starts > 2) & mark[ends - 1] & (data[np.maximum(ends - 2, 0)] == last)
        stop = np.concatenate([[False], np.isin(data[ends[:-1] - 1], np.frombuffer(b".!?", np.uint8)) & (doc[1:] == doc[:-1])])
        low = (data[starts] >= 97) & (data[starts] <= 122)
        for j, x in enumerate((np.ones(len(starts), bool), (size > 1) & (caps == size), masked[ends] - masked[starts] > 0, run, stop & low)):
            out[:, j] = np.bincount(doc, x, n)
        return out

    def root(self) -> np.ndarray:
        """The root of each text's number of different words."""
        return np.sqrt(np.maximum(np.bincount(self.doc, minlength=self.texts), 1))

    def votes(self, lexicons: list[list[np.ndarray]]) -> np.ndarray:
        """Texts by voters: whether each votes."""
        out, hits = [], np.zeros((len(WANTED), len(self.own)), bool)
        for i, kinds in enumerate(lexicons):
            for kind, entries in kinds:
                at = np.searchsorted(entries, self.features[:, kind])
                hit = self.has[:, kind] & (at < len(entries))
                hit[hit] = entries[at[hit]] == self.features[hit, kind]
                hits[i] |= hit
        for hit, wanted in zip(hits, WANTED, strict=True):
            n = np.bincount(self.doc, hit[self.word], self.texts)
            out += [n >= k for k in wanted]
        words, caps, masked, run, low = self.patterns.T
        out += [x & (words > 0) for x in (5 * caps > words, masked > 0, run > 1, low > 0)]
        return np.stack(out, 1)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, feature, texts of label 0, of label 1), counted in a task as far as memory allows."""

    def sent(found) -> pa.RecordBatch:
        kind, feature, y, n = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(feature.view(np.int64)), pa.array(np.where(y == 0, n, 0)), pa.array(np.where(y == 1, n, 0))], names=["kind", "feature", "n0", "n1"])

    found, size = [], 0
    for b in vectors.slices(batches):
        words = Words.of(b.column("text"))
        labels = b.column("y").to_numpy()[words.doc]
        for kind in range(len(KINDS)):
            # a beginning counts once a text, whatever the words that begin so
            ok = words.has[words.word, kind]
            ids, code = np.unique(words.features[:, kind], return_inverse=True)
            pairs = vectors.distinct((words.doc[ok].astype(U) << U(33)) | (labels[ok].astype(U) << U(32)) | code[words.word[ok]].astype(U)) & U((1 << 33) - 1)
            pairs, n = np.unique(pairs, return_counts=True)
            found.append((np.full(len(n), kind, np.int32), ids[(pairs & U(0xFFFFFFFF)).astype(np.int64)], (pairs >> U(32)).astype(np.int64), n))
            size += len(n)
        if size >= SEND:
            yield sent(found)
            found, size = [], 0
    if found:
        yield sent(found)


def lexicons_of(counts: DataFrame, n0: int, n1: int) -> list[list[tuple[int, np.ndarray]]]:
    """Pure words, loose words, pure beginnings, loose beginnings: (kind, sorted entries); counts: kind, feature, n0, n1 with n0 and n1 rows of the labels in all."""
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    odds = F.ln(a / (n1 + 1.0 - a + 0.5)) - F.ln(b / (n0 + 1.0 - b + 0.5))
    z, share = F.round(odds / F.sqrt(1 / a + 1 / b), 9), a / (F.col("n0") + F.col("n1") + 2)
    scored = counts.where(f"n1 >= {LEAST}").withColumn("z", z).withColumn("pure", (share >= PURE[0]) & (z >= PURE[1])).where(F.col("pure") | ((share >= LOOSE[0]) & (z >= LOOSE[1])))
    place = F.row_number().over(W.partitionBy("kind", "pure").orderBy(F.desc("z"), "feature"))
    best: dict[tuple[int, bool], list[int]] = {}
    for r in scored.withColumn("place", place).where(F.col("place") <= LEXICON).select("kind", "pure", "feature").collect():
        best.setdefault((r["kind"], r["pure"]), []).append(r["feature"])
    each = {k: (k[0], np.sort(np.array(x, np.int64).view(U))) for k, x in best.items()}
    return [[x for (kind, is_pure), x in sorted(each.items()) if is_pure == pure and (kind > 0) == begins] for begins in (False, True) for pure in (True, False)]


def _vote(lexicons):
    bits = 1 << np.arange(VOTERS)

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vectors.slices(batches):
            votes = Words.of(b.column("text")).votes(lexicons.value)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), pa.array((votes * bits).sum(1).astype(np.int32))], names=[*(c for c in b.schema.names if c != "text"), "votes"])

    return vote


class LabelModel:
    """P(y) and P(votes | y) along a tree of voters, fitted by EM."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 25, least: float = 1e-3):
        """votes: patterns by voters; counts: patterns by rows of label 0, of label 1, of none."""
        v = votes.astype(float)
        known = counts[:, :2]
        self.prior = (known.sum(0) + 1) / (known.sum() + 2)
        self._fit(v, known, least)
        for _ in range(rounds):
            p = self.posterior(votes)
            weights = known + counts[:, 2:] * np.stack([1 - p, p], 1)
            self.prior = (weights.sum(0) + 1) / (weights.sum() + 2)
            self._fit(v, weights, least)

    def _fit(self, v: np.ndarray, weights: np.ndarray, least: float) -> None:
        n = v.shape[1]
        total = weights.sum(0)
        one = np.stack([v.T @ w for w in weights.T])  # class, voter
        both = np.stack([v.T @ (w[:, None] * v) for w in weights.T])  # class, voter, voter
        joint = np.zeros((2, n, n, 2, 2))  # class, a, b, vote of a, vote of b
        joint[..., 1, 1] = both
        joint[..., 1, 0] = one[:, :, None] - both
        joint[..., 0, 1] = one[:, None, :] - both
        joint[..., 0, 0] = total[:, None, None] - one[:, :, None] - one[:, None, :] + both
        joint = np.maximum(joint, 0) + 0.5
        p = joint / joint.sum((-1, -2), keepdims=True)
        apart = p.sum(-1, keepdims=True) * p.sum(-2, keepdims=True)
        #: Correlation of two voters beyond the class: their mutual information given it, in nats.
        self.information = np.einsum("c,cabxy->ab", self.prior, p * np.log(p / apart))
        np.fill_diagonal(self.information, 0)
        self.parent, reached = np.full(n, -1), {0}
        gain, best = self.information[0].copy(), np.zeros(n, int)
        for _ in range(n - 1):
            j = max((x for x in range(n) if x not in reached), key=lambda x: gain[x])
            if gain[j] >= least:
                self.parent[j] = best[j]
            reached.add(j)
            more = self.information[j] > gain
            gain, best = np.where(more, self.information[j], gain), np.where(more, j, best)
        #: Accuracies: each voter's chance to vote, by class.
        self.rates = (one + 0.5) / (total[:, None] + 1)
        self.table = np.zeros((2, n, 2, 2))  # class, voter, parent's vote, own vote: log of the chance
        for j, a in enumerate(self.parent):
            own = joint[:, a, j] if a >= 0 else np.repeat(np.stack([1 - self.rates[:, j], self.rates[:, j]], 1)[:, None], 2, 1)
            self.table[:, j] = np.log(own / own.sum(-1, keepdims=True))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(y = 1 | votes) of each pattern."""
        x = votes.astype(int)
        up = np.where(self.parent >= 0, x[:, self.parent], 0)
        at = np.arange(x.shape[1])
        s = [np.log(self.prior[c]) + self.table[c, at, up, x].sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(s[0] - s[1], -40, 40)))


class Classifier:
    def __init__(self, weights: np.ndarray, by_vote: np.ndarray, bias: float):
        self.weights, self.by_vote, self.bias = weights, by_vote, bias

    def sums(self, words: Words) -> np.ndarray:
        """What the words of each text add: their weights' sum over the root of their number, so that a long text does not add up noise."""
        each = (self.weights[(words.features & U(ROWS - 1)).astype(np.int64)] * words.has).sum(1, dtype=float)
        return np.bincount(words.doc, each[words.word], words.texts) / words.root()


def train(texts: list[str], votes: np.ndarray, posterior: np.ndarray, share: float, seed: int = 9) -> Classifier:
    """AdaGrad on the cross-entropy with the posteriors; of the rows drawn, likely toxic ones are as many as others, so each class weighs by its share of all rows."""
    rng = np.random.default_rng(seed)
    weights, squares = np.zeros(ROWS, np.float32), np.full(ROWS, 1e-2, np.float32)
    by_vote, vote_squares = np.zeros(VOTERS), np.full(VOTERS, 1e-2)
    likely = max(float((posterior >= 0.5).mean()), 1e-9)
    weigh = np.where(posterior >= 0.5, max(share, 0.05) / likely, (1 - max(share, 0.05)) / max(1 - likely, 1e-9))
    bias, bias_square = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), 1.0
    order, batches = rng.permutation(len(texts)), []
    for i in range(0, len(order), BATCH):
        mine = order[i : i + BATCH]
        w = Words(pa.array([texts[j] for j in mine], pa.string()))
        rows = np.where(w.has, (w.features & U(ROWS - 1)).astype(np.int64), -1).astype(np.int32)
        batches.append((mine, rows, w.doc.astype(np.int32), w.word.astype(np.int32), w.root()))
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch) ** 0.5
        for i in rng.permutation(len(batches)):
            mine, rows, doc, word, root = batches[i]
            each = np.where(rows >= 0, weights[rows], 0).sum(1, dtype=float)
            x = votes[mine].astype(float)
            s = bias + np.bincount(doc, each[word], len(mine)) / root + x @ by_vote
            g = weigh[mine] * (1 / (1 + np.exp(np.clip(-s, -40, 40))) - posterior[mine])
            bias_square += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(bias_square)
            gv = x.T @ g + DECAY * by_vote
            vote_squares += gv**2
            by_vote -= rate * gv / np.sqrt(vote_squares)
            per_word = np.bincount(word, (g / root)[doc], len(rows))
            flat, spread = rows.ravel(), np.repeat(per_word, rows.shape[1])
            ids, back = np.unique(flat, return_inverse=True)
            gw = (np.bincount(back, spread) + DECAY * weights[ids]).astype(np.float32)
            if len(ids) and ids[0] < 0:
                ids, gw = ids[1:], gw[1:]
            squares[ids] += gw * gw
            weights[ids] -= rate * gw / np.sqrt(squares[ids])
    return Classifier(weights, by_vote, bias)


def _score(model):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons, c = model.value
        for b in vectors.slices(batches):
            words = Words.of(b.column("text"))
            p = 1 / (1 + np.exp(np.clip(-(c.bias + c.sums(words) + words.votes(lexicons) @ c.by_vote), -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(p)], names=["id", "held_out", "score"])

    return score


def held_out(key: str, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % folds == fold, F.lit(False))


def _bits(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> np.arange(VOTERS)) & 1 == 1


def fitted(every: DataFrame, labels: DataFrame) -> tuple[list, LabelModel, Classifier] | None:
    """(lexicons, label model, classifier) from rows (id, text, held_out) and labels (id, y); None without a learnable label of 1."""
    spark = every.sparkSession
    learn = every.where("not held_out")
    known = labels.where("y in (0, 1)").distinct()
    known = storage.small(known, known.count(), 24)
    n = {r["y"]: r["count"] for r in learn.select("id").join(known, "id").groupBy("y").count().collect()}
    if not n.get(1):
        return None
    counts = learn.join(known, "id").select("text", F.col("y").cast("int").alias("y")).mapInArrow(_count, "kind int, feature long, n0 long, n1 long").groupBy("kind", "feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = storage.materialise(counts.where(f"n1 >= {LEAST}"), "lexicon")
    lexicons = lexicons_of(counts, n.get(0, 0), n[1])
    shared = spark.sparkContext.broadcast(lexicons)
    kind = every.schema["id"].dataType.simpleString()
    voted = every.select("id", "held_out", F.length("text").alias("chars"), F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 31) - 1)).alias("draw"), "text")
    voted = storage.materialise(voted.mapInArrow(_vote(shared), f"id {kind}, held_out boolean, chars int, draw long, votes int"), "votes")
    label = F.when(F.col("held_out") | F.col("y").isNull(), 2).otherwise(F.col("y")).cast("int")
    patterns = voted.join(known, "id", "left").groupBy("votes", label.alias("label")).count().collect()  # 3 * 2 ** VOTERS rows at most
    pattern = np.array(sorted({r["votes"] for r in patterns}))
    table = np.zeros((len(pattern), 3))
    for r in patterns:
        table[np.searchsorted(pattern, r["votes"]), r["label"]] += r["count"]
    model = LabelModel(_bits(pattern), table)
    p = model.posterior(_bits(pattern))
    share = float((table.sum(1) @ p) / table.sum())
    likely = spark.createDataFrame([(int(v),) for v, x in zip(pattern, p, strict=True) if x >= 0.5], "votes int").withColumn("likely", F.lit(True))
    drawn = voted.where("not held_out").join(F.broadcast(likely), "votes", "left").withColumn("likely", F.coalesce("likely", F.lit(False)))
    sums = {r["likely"]: (r["n"], r["chars"] or 0) for r in drawn.groupBy("likely").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()}
    most = {k: int(min(1.0, TRAIN_ROWS / 2 / n, TRAIN_CHARS / 2 / max(c, 1)) * (1 << 31)) for k, (n, c) in sums.items()}
    chosen = drawn.where(F.col("draw") < F.when(F.col("likely"), most.get(True, 0)).otherwise(most.get(False, 0))).select("id", "draw").distinct()
    chosen = storage.materialise(chosen.orderBy("draw", "id").limit(2 * TRAIN_ROWS), "sample")
    again = learn.withColumn("draw", F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 31) - 1)))
    sample = again.join(F.broadcast(chosen), ["id", "draw"], "left_semi").select("id", "text").distinct().limit(2 * TRAIN_ROWS).collect()
    sample.sort(key=lambda r: (r["id"], r["text"]))
    texts = [r["text"] for r in sample]
    del sample
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    votes = np.concatenate([np.zeros((0, VOTERS), bool), *[Words.of(b.column("text")).votes(lexicons) for b in vectors.slices([batch])]])
    return lexicons, model, train(texts, votes, model.posterior(votes), share)


def scores(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", labelled: str = "doc_id", label: str = "toxic", held: Column | None = None) -> DataFrame:
    """key, held_out, score, predicted of each row of df; labels holds ids and 0 or 1, of which rows not held out may be learned from."""
    spark = df.sparkSession
    storage.ship(spark)
    held = held_out(key) if held is None else held
    every = df.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), held.alias("held_out"))
    known = labels.select(F.col(f"`{labelled}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).dropna()
    with storage.scratch(spark):
        model = fitted(every, known)
    if model is None:
        found = every.select("id", "held_out", F.lit(0.0).alias("score"))
    else:
        kind = every.schema["id"].dataType.simpleString()
        shared = spark.sparkContext.broadcast((model[0], model[2]))
        found = every.mapInArrow(_score(shared), f"id {kind}, held_out boolean, score double")
    return found.select(F.col("id").alias(key), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
