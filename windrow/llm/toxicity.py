"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters look at a whole text and vote toxic (1), not toxic (-1) or abstain (0).
The label model takes the class as hidden: expectation-maximisation over the
distinct vote patterns, counted once by Spark, estimates how often each voter
gives each vote in each class, and pairs that agree within the classes beyond
chance share their weight. Its posteriors are the labels from which a logistic
classifier over voter counts and text statistics is trained.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import matrix, pool_adjacent, summed
from .textkit import cut, given_back, slim

THRESHOLD = 0.7
#: Words learnt from labelled rows that join the lexicon, least documents for one, and calibration bins.
LEARNT, LEAST, BINS = 192, 4, 256
#: Labelled documents whose words are counted for the lexicon: the first by hash, whatever the input.
SAMPLE = 50_000
#: Standard errors from which two voters' agreement within a class counts.
BEYOND = 5
_WORD = re.compile(r"[^\W\d_]{2,}")

LEXICON = {
    "person": "idiot idiots moron morons imbecile imbeciles loser losers clown clowns fool fools dumbass jackass jerk scumbag bastard bitch asshole cretin freak pervert creep",
    "contempt": "worthless pathetic disgusting useless stupid dumb trash garbage scum filth filthy vermin parasite parasites vile repulsive subhuman braindead brainless ugly",
    "threat": "kill die hang shoot stab beat destroy exterminate deport punish suffer rot",
    "obscene": "shit bullshit crap damn fuck fucking fucked fucker motherfucker piss cunt dick prick whore slut",
    "hate": "hate hates hated despise loathe racist nazi savage savages inferior",
    "french": "idiote idiots imbécile imbéciles crétin crétine connard connasse salope salaud merde putain abruti débile ordure pourriture minable raclure",
    "german": "idioten trottel dummkopf arschloch scheiße scheisse hurensohn schlampe wichser abschaum versager widerlich ekelhaft wertlos dreckig",
    "spanish": "idiotas imbécil estúpido estúpida estúpidos mierda puta puto cabrón gilipollas pendejo basura asqueroso asquerosa inútil patético maldito escoria",
}
PATTERNS = {
    "you are": re.compile(r"\byou(?:'re| are)\s+(?:such\s+)?(?:an?\s+)?\w*(?:idiot|moron|stupid|loser|trash|scum|clown|pathetic|worthless)", re.I),
    "shut up": re.compile(r"\bshut\s+up\b|\bgo\s+to\s+hell\b|\bdrop\s+dead\b", re.I),
    "masked": re.compile(r"\b\w[\w]*[*@#$]{2,}\w+\b"),
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b[!?]*\s+){4,}"),
    "bang": re.compile(r"!{3,}"),
}
_LEX = {k: frozenset(v.split()) for k, v in LEXICON.items()}


def lower_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, marks = [], []
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = set(lower_words(text or ""))
            words += own
            marks += [y] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(marks, pa.int64())], names=["w", "y"])


def learnt_words(marked: DataFrame, most: int = LEARNT, least: int = LEAST) -> list[str]:
    """Words that far more toxic than other labelled documents hold; at most `most` reach the driver."""
    marked = cut(marked.groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("y").alias("y")))  # copies count once
    total = marked.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    p, n = int(total["p"] or 0), int(total["n"] or 0)
    if not p or p == n:
        return []
    counts = marked.select("text", "y").mapInArrow(given_back(_words), "w string, y long").groupBy("w").agg(F.sum("y").alias("a"), F.count("*").alias("c"))
    rate = (F.col("a") / p) / ((F.col("c") - F.col("a") + 0.5) / (n - p + 1))
    # a list that toxic documents use needs both a strong ratio and a share that chance does not give
    best = counts.where((F.col("a") >= max(least, 0.008 * p)) & (rate >= 10)).orderBy(F.col("a").desc(), "w").limit(most)
    return sorted(r["w"] for r in best.collect())


class Voters:
    """Counts of each voter's evidence in a text, and their votes."""

    def __init__(self, learnt: list[str]):
        self.words: dict[str, list[int]] = {}
        for i, group in enumerate(_LEX.values()):
            for w in group:
                self.words.setdefault(w, []).append(i)
        self.base = len(_LEX)
        for i, w in enumerate(learnt):
            self.words.setdefault(w, []).append(self.base + i)
        self.patterns = list(PATTERNS.values())
        self.evidence = self.base + len(learnt) + len(self.patterns)
        #: one voter more for each of: two kinds of evidence, dense evidence
        self.voters = self.evidence + 2
        self.size = self.evidence + 4

    def features(self, text: str) -> list[float]:
        counts = [0] * self.evidence
        kinds: set[str] = set()
        hits = 0
        for w in lower_words(text):
            voters = self.words.get(w)
            if voters is None:
                continue
            for i in voters:
                counts[i] += 1
            kinds.add(w)
            hits += 1
        first = self.evidence - len(self.patterns)
        for i, pattern in enumerate(self.patterns):
            counts[first + i] = sum(1 for _ in pattern.finditer(text))
        n = max(1, text.count(" ") + 1)
        return [float(np.log1p(c)) for c in counts] + [float(np.log1p(len(kinds))), float(np.log1p(hits)), min(1.0, 20 * hits / n), float(np.log1p(n)) / 8]

    def votes(self, x: np.ndarray) -> np.ndarray:
        """1 toxic, 0 abstain, -1 not toxic: a voter of evidence abstains without it, the last two also vote -1.

        They say not toxic where no listed word stands, and abstain on a single kind of it or a thin spread.
        """
        fires = (x[:, : self.evidence] > 0).astype(np.int8)
        kinds, dense = x[:, self.evidence], x[:, self.evidence + 2]
        wide = np.where(kinds > np.log1p(1.5), 1, np.where(kinds > 0, 0, -1))[:, None]
        thick = np.where(dense > 0.1, 1, np.where(dense > 0, 0, -1))[:, None]
        return np.hstack([fires, wide, thick]).astype(np.int8)

    def unpacked(self, patterns: pa.Array) -> np.ndarray:
        """Vote patterns as rows, from binary values of a byte a voter."""
        return np.frombuffer(b"".join(patterns.to_pylist()), np.int8).reshape(len(patterns), self.voters)


class LabelModel:
    """P(vote | class) for each voter and vote (not toxic, abstain, toxic), each voter's share of its weight, the class balance.

    chance[c, o, i] is how often voter i gives vote o - 1 in class c.
    """

    def __init__(self, chance: np.ndarray, prior: float, share: np.ndarray):
        self.chance, self.prior, self.share = chance, prior, share

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        gain = np.log(self.chance[1] / self.chance[0])
        says = np.where(votes > 0, gain[2], np.where(votes < 0, gain[0], gain[1]))
        odds = np.log(self.prior / (1 - self.prior)) + says @ self.share
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def counted_patterns(seen: DataFrame) -> DataFrame:
    """(votes, n): each distinct vote pattern and its rows. The pattern without evidence, most of all rows, is one row."""
    return seen.groupBy("votes").agg(F.count("*").alias("n"))


def _beyond_chance(joint: np.ndarray, rate: np.ndarray, n: float) -> np.ndarray:
    """Correlations of toxic votes in one class, from sums over its n (expected) rows; 0 within BEYOND standard errors.

    Without that limit the noise of some two hundred pairs would add up to agreement for every voter.
    """
    n = max(1.0, n)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    out = ((joint / n - np.outer(rate, rate)) / np.outer(spread, spread)).clip(0, 1)
    return np.where(out > BEYOND / np.sqrt(n), out, 0)


def fit_label_model(patterns: DataFrame, voters: Voters, start: LabelModel, rounds: int = 4) -> LabelModel:
    """Expectation-maximisation over (votes, n): each round is one pass that sums expected votes and pair agreements in both classes.

    `start` counts as a prior of a twentieth of the rows, so that the hidden class keeps its meaning.
    """
    v = voters.voters
    model = start
    for _ in range(rounds):

        def expect(batch: pa.RecordBatch, model: LabelModel = model) -> np.ndarray:
            votes = voters.unpacked(batch.column(0))
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            on, off = (votes > 0).astype(float), (votes < 0).astype(float)
            toxic = model.posterior(votes) * n
            sums = [[n.sum()]]
            for w in (n - toxic, toxic):
                sums += [[w.sum()], off.T @ w, on.T @ w, (on.T @ (on * w[:, None])).ravel()]
            return np.concatenate(sums)

        own = 1 + 2 * v + v * v
        s = summed(patterns, expect, 1 + 2 * own)
        if not s[0]:
            return start
        weight = 0.05 * s[0]
        chance, agree = np.empty((2, 3, v)), np.zeros((v, v))
        for c, part in enumerate((s[1 : 1 + own], s[1 + own :])):
            n, off, on, joint = part[0], part[1 : 1 + v], part[1 + v : 1 + 2 * v], part[1 + 2 * v :].reshape(v, v)
            anchor = weight * (start.prior if c else 1)
            no, yes = ((x + anchor * start.chance[c, o]) / (n + anchor) for o, x in ((0, off), (2, on)))
            chance[c] = no, 1 - no - yes, yes
            # each class counts by its share of a voter pair's joint votes: what agrees in the rare class is not drowned
            agree += _beyond_chance(joint, on / max(1.0, n), n) * joint
            if c == 0:
                of_both = joint.copy()
            else:
                of_both += joint
        agree /= np.maximum(of_both, 1e-9)
        np.fill_diagonal(agree, 0)
        prior = float(np.clip((s[1 + own] + weight * start.prior) / (s[0] + weight), 1e-4, 0.5))
        # voters that err together count as one between them
        model = LabelModel(chance.clip(1e-5, 1 - 1e-5), prior, 1 / (1 + agree.sum(1)))
    return model


def start_model(marked: DataFrame, voters: Voters) -> LabelModel:
    """First guesses of the accuracies from labelled rows (votes, y); without them, that evidence is rare and mostly right."""
    v = voters.voters

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        votes = voters.unpacked(batch.column(0))
        on, off = (votes > 0).astype(float), (votes < 0).astype(float)
        y = batch.column(1).to_numpy(zero_copy_only=False)
        return np.concatenate([[len(y), y.sum()], off.T @ (1 - y), on.T @ (1 - y), off.T @ y, on.T @ y])

    s = summed(marked, counts, 2 + 4 * v)
    n, toxic, parts = s[0], s[1], s[2:].reshape(2, 2, v)
    speaks = np.zeros(v)
    speaks[voters.evidence :] = 1  # the voters that can say not toxic
    chance = np.empty((2, 3, v))
    for c, (rows, no, yes) in enumerate(((n - toxic, 0.5, 0.01), (toxic, 0.1, 0.1))):
        low, high = (parts[c, 0] + no * speaks) / (rows + 1), (parts[c, 1] + yes) / (rows + 1)
        chance[c] = low, 1 - low - high, high
    return LabelModel(chance.clip(1e-5, 1 - 1e-5), float(np.clip((toxic + 0.5) / (n + 10), 1e-3, 0.5)), np.ones(v))


def fit_linear(rows: DataFrame, voters: Voters, labels: LabelModel, rounds: int = 6, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression on posterior labels, by partition-summed Newton steps over every row."""
    size = voters.size + 1
    weights = np.zeros(size)
    for _ in range(rounds):

        def step(batch: pa.RecordBatch, weights: np.ndarray = weights) -> np.ndarray:
            x = matrix(batch.column(0))
            p = labels.posterior(voters.votes(x))
            z = np.hstack([np.ones((len(x), 1)), x])
            q = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
            return np.concatenate([(z.T @ (z * (q * (1 - q) + 1e-6)[:, None])).ravel(), z.T @ (p - q), [len(x)]])

        s = summed(rows, step, size * size + size + 1)
        n = max(1.0, s[-1])
        h = s[: size * size].reshape(size, size) / n + ridge * np.eye(size)
        move = np.linalg.solve(h, s[size * size : -1] / n - ridge * weights)
        weights = weights + move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
    return weights


def score_documents(docs: DataFrame, labels: DataFrame, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not
    `held`: they add words to the lexicon (from the first SAMPLE labelled rows
    by hash), start the label model and calibrate the score. A null or empty
    text has no evidence and gets the base score; a null id is scored but
    teaches nothing; repeated rows come back as often as they come; repeated
    labels of one document count once (the larger). Texts of any length are read whole, other columns of docs are not
    read, whatever their names; empty docs give an empty table, and without labels only the built-in voters speak.
    """
    rest = lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(3))
    rows = slim(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("y"))
    known = cut(known.where(rest(F.col("doc_id")) != held))
    picked = known.orderBy(F.xxhash64("doc_id")).limit(SAMPLE)
    # at most SAMPLE pairs of longs are broadcast, so that no text but theirs is shuffled
    voters = Voters(learnt_words(rows.join(F.broadcast(picked), "doc_id").select("text", "y")))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([voters.features(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, voters.size)
            packed = [row.tobytes() for row in voters.votes(x)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(packed, pa.binary())], names=["doc_id", "x", "votes"])

    seen = cut(rows.mapInArrow(given_back(evidence), "doc_id long, x array<double>, votes binary"))
    marked = cut(seen.join(known, "doc_id").select("x", F.col("y").cast("double").alias("y"), "votes"))
    model = fit_label_model(cut(counted_patterns(seen)), voters, start_model(marked.select("votes", "y"), voters))
    weights = fit_linear(seen.select("x"), voters, model)
    edge = lambda x: 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        at = np.minimum((edge(matrix(batch.column(0))) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False), minlength=BINS)])

    h = summed(marked, histogram, 2 * BINS)
    used = np.flatnonzero(h[:BINS])
    centres = (used + 0.5) / BINS
    levels = pool_adjacent(h[BINS:][used] + 0.05 * centres, h[:BINS][used] + 0.05)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = edge(matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            out = np.clip(0.999 * np.interp(raw, centres, levels) + 0.001 * raw, 0, 1) if len(used) else raw
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = seen.select("doc_id", "x").mapInArrow(given_back(score), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(rest(F.col("doc_id")) == held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
