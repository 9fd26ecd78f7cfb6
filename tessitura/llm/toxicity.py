"""Abusive, hateful or sexually explicit passages.

A text is cut into clauses and scored by its worst clause, so one sentence in a long patent is enough and the
rest of the text does not dilute it. Clauses are scored by a linear model over words, word pairs and triples
(Chinese: characters), after undoing the usual disguises. The model is fitted by non-negative
positive-unlabelled learning: documents confirmed as toxic are the positives, a sample of all documents is
unlabelled, and the risk is corrected by the class prior, which is estimated from what the model finds among
unconfirmed documents and its recall of held-out positives. Only the fit uses a sample; the vocabulary comes from the
document frequencies of all texts, and every text is scored in full.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.workspace import Workspace, bounded_sample

#: Documents the fit may read: confirmed positives, and unlabelled ones (by the hash of their id).
MAX_POSITIVE, MAX_UNLABELLED = 6_000, 8_000
#: Characters of all texts that the fit may read (the driver's memory); whole texts, as many as fit.
MAX_FIT_CHARS = 40_000_000
#: A word is known if it occurs in this share of all documents and in LEAST of them, or in two confirmed ones. So there are at
#: most as many words as an average document has, over the share, whatever the number of documents.
WORD_SHARE, LEAST = 3 / 8000, 3
#: Different words that a task counts before it hands them on.
COUNTED = 500_000
#: Hashed dimensions of pairs and triples.
DIMENSIONS = 1 << 20
#: Class prior that the first fit assumes.
PRIOR = 0.03
#: Largest prior that is believed; clauses of the unlabelled texts that are background in every round.
MAX_PRIOR, BACKGROUND = 0.2, 60_000
MIN_PRIOR = 0.01
#: Quantile of the unlabelled texts' first scores that a positive must reach to be believed.
BELIEVED = 0.9
#: Folds of positives, each left out of one of the first rounds; afterwards a positive is believed if the model
#: that had not seen it gave it more than DOUBT (log-odds), or its first score reaches the quantile STRONG.
FOLDS, DOUBT, STRONG = 3, -2.5, 0.995
#: Weight of the evidence of words, pairs and triples.
ORDERS = (1.0, 0.7, 0.35)
#: Score from which a document counts as toxic: the fit leaves most clauses near 0.02 and is cautious above.
THRESHOLD = 0.15
#: Labels that confirm a case.
TOXIC = ("abusive", "hateful", "sexual")

_CJK = "㐀-鿿"
_TOKEN = re.compile(rf"[{_CJK}]|[@$]?[^\W_{_CJK}]+(?:[*@$]+[^\W_{_CJK}]*|[&!][^\W_{_CJK}]+)*|[.!?;:\n。！？；：,，、]").findall
_ENDS = ".!?;:\n。！？；："
_COMMAS = ",，、"
# Ids of special tokens; the 26 letters follow, then words.
END, COMMA, NUMBER, UNKNOWN, MASK, LETTERS = 0, 1, 2, 3, 4, 5
FIRST_WORD = LETTERS + 26
# Letters that digits and signs stand for, and look-alikes of other scripts.
_LEET = str.maketrans("0134578@$", "oieastbas")
_ALIKE = str.maketrans("асеорхуікмнтв", "aceopxyikmhtb")
_BROKEN = re.compile(r"[^\x00-\x7f]+")


def _repaired(m: re.Match) -> str:
    try:
        return m.group().encode("cp1252").decode("utf-8")
    except UnicodeError:
        return m.group()


def _clean(text: str) -> str:
    if "Ã" in text or "Â" in text or "â" in text:
        text = _BROKEN.sub(_repaired, text)
    return text.lower()


class Pieces(dict):
    """Piece of text between spaces to the tokens in it, or to ``of`` these. Tokens never hold a space, so a text's tokens are
    those of its pieces, and most pieces have been seen before. Long ones (text without spaces) are not remembered."""

    #: Pieces remembered, the memory being emptied beyond, and characters of the longest of them.
    REMEMBER, LONGEST = 300_000, 40

    def __init__(self, of: Callable[[list[str]], Iterable]):
        super().__init__()
        self._of = of

    def __missing__(self, piece: str) -> tuple:
        found = tuple(self._of(_TOKEN(piece)))
        if len(piece) <= self.LONGEST:
            if len(self) > self.REMEMBER:
                self.clear()
            self[piece] = found
        return found

    def in_text(self, text: str) -> chain:
        return chain.from_iterable(map(self.__getitem__, text.split(" ")))


class Vocabulary(dict):
    """Token to id. Words that are not known are looked up without disguise, once each."""

    #: Remembered unknown words; the memory is emptied beyond.
    REMEMBER = 300_000

    def __init__(self, words: list[str]):
        super().__init__()
        self.words = words
        self._restart()
        self._wild: dict[str, int] = {}
        for i, w in enumerate(words):
            if len(w) >= 5:
                for k in range(len(w)):
                    self._wild.setdefault(f"{w[:k]}*{w[k + 1:]}", FIRST_WORD + i)

    def _restart(self) -> None:
        self.clear()
        self.pieces = Pieces(partial(map, self.__getitem__))
        self.update({c: END for c in _ENDS} | {c: COMMA for c in _COMMAS})
        self.update({chr(97 + i): LETTERS + i for i in range(26)})
        self.update({w: FIRST_WORD + i for i, w in enumerate(self.words)})

    def __reduce__(self):
        return Vocabulary, (self.words,)

    def __missing__(self, token: str) -> int:
        if len(self) > self.REMEMBER + len(self.words):
            self._restart()
        self[token] = found = self._undisguised(token)
        return found

    def _undisguised(self, token: str) -> int:
        if token.isdigit():
            return NUMBER
        if "*" in token.strip("*"):
            return MASK
        bare = "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c)).translate(_ALIKE)
        forms = [bare]
        if any(c.isdigit() or c in "@$" for c in bare) and any(c.isalpha() for c in bare):
            forms.append(bare.translate(_LEET))
        forms += [re.sub(r"(.)\1{2,}", r"\1", f) for f in forms] + [re.sub(r"(.)\1+", r"\1", f) for f in forms]
        for f in forms:
            if f in self and self[f] >= FIRST_WORD:
                return self[f]
        f = forms[1] if len(forms) > 3 and forms[1] != bare else bare
        if len(f) >= 5 and sum(c.isalpha() for c in f) >= len(f) - 1:
            for k in range(len(f)):
                if (i := self._wild.get(f"{f[:k]}*{f[k + 1:]}")) is not None:
                    return i
        return UNKNOWN

    def spelled(self, letters: str) -> list[int] | None:
        """Words that letters written one by one spell, longest first; None if there is none."""
        out, at = [], 0
        while at < len(letters):
            for n in range(len(letters) - at, 2, -1):
                if (i := dict.get(self, letters[at : at + n], UNKNOWN)) >= FIRST_WORD:
                    out.append(i)
                    at += n
                    break
            else:
                at += 1
        return out or None


@dataclass
class Tokens:
    """Token ids of texts one after the other; text i ends before ``ends[i]``."""

    ids: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(texts: list[str | None], vocabulary: Vocabulary) -> Tokens:
        parts, ends, n = [], [], 0
        for t in texts:
            ids = np.fromiter(vocabulary.pieces.in_text(_clean(t)), dtype=np.int32) if t else np.zeros(0, dtype=np.int32)
            ids = _joined(ids, vocabulary)
            ids = np.append(ids[ids != NUMBER], END).astype(np.int32)
            parts.append(ids)
            n += len(ids)
            ends.append(n)
        return Tokens(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32), np.array(ends, dtype=np.int64))

    def clauses(self) -> tuple[np.ndarray, np.ndarray]:
        """First token of every clause, and the text it belongs to."""
        cut = np.flatnonzero(self.ids <= COMMA) + 1
        starts = np.concatenate([[0], cut[:-1]]) if len(cut) else cut
        return starts, np.searchsorted(self.ends, starts, side="right")


def _joined(ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Runs of three or more single letters, also with stops between them, become the words they spell."""
    single = (ids >= LETTERS) & (ids < FIRST_WORD)
    if single.sum() < 3:
        return ids
    stop = ids <= COMMA
    stop[1:-1] &= single[:-2] & single[2:]
    stop[[0, -1]] = False
    ids = ids[~stop & (ids != NUMBER)]
    single = (ids >= LETTERS) & (ids < FIRST_WORD)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a >= 3 and (words := vocabulary.spelled("".join(chr(97 + i - LETTERS) for i in ids[a:b]))):
            ids[a:b] = NUMBER  # left out
            ids[a : a + len(words)] = words
    return ids


def _features(ids: np.ndarray, words: int) -> list[np.ndarray]:
    """Columns of the word, pair and triple that begin at every token; -1 where there is none."""
    one = np.where(ids > NUMBER, ids, -1).astype(np.int64)
    inside = one >= 0
    two, three = np.full(len(ids), -1, dtype=np.int64), np.full(len(ids), -1, dtype=np.int64)
    if len(ids) > 1:
        h = (one[:-1] * 0x9E3779B1 + one[1:] * 0x85EBCA6B) & 0xFFFFFFFF
        ok = inside[:-1] & inside[1:]
        two[:-1] = np.where(ok, words + ((h ^ (h >> 15)) & (DIMENSIONS - 1)), -1)
        if len(ids) > 2:
            g = (h[:-1] * 0xC2B2AE35 + one[2:] * 0x27D4EB2F + 1) & 0xFFFFFFFF
            three[:-2] = np.where(ok[:-1] & inside[2:], words + ((g ^ (g >> 13)) & (DIMENSIONS - 1)), -1)
    return [one, two, three]


@dataclass
class ToxicityModel:
    """Vocabulary, weights (the last is 0 and stands for no feature), bias and class prior."""

    vocabulary: Vocabulary
    weights: np.ndarray
    bias: float = 0.0
    prior: float = PRIOR
    history: list[float] = field(default_factory=list)

    def to_table(self, spark: SparkSession) -> DataFrame:
        """One row that keeps the model, so that a fit serves many runs."""
        row = pa.table({"words": pa.array([self.vocabulary.words], pa.list_(pa.string())), "weights": pa.array([self.weights.astype("<f4").tobytes()], pa.binary()), "bias": [float(self.bias)], "prior": [float(self.prior)]})
        return spark.createDataFrame(row)

    @staticmethod
    def from_table(df: DataFrame) -> ToxicityModel:
        """The model of a table of :meth:`to_table`; anything but one fitting row raises."""
        rows = df.limit(2).collect()
        if len(rows) != 1 or len(rows[0].weights) != 4 * (FIRST_WORD + len(rows[0].words) + DIMENSIONS + 1):
            raise ValueError("not the table of one model")
        r = rows[0]
        return ToxicityModel(Vocabulary(list(r.words)), np.frombuffer(r.weights, dtype="<f4"), r.bias, r.prior)

    def clause_scores(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        starts, text = t.clauses()
        if not len(starts):
            return np.zeros(0), text
        n = FIRST_WORD + len(self.vocabulary.words)
        per = sum(o * self.weights[f] for o, f in zip(ORDERS, _features(t.ids, n)))
        return np.add.reduceat(per, starts) + self.bias, text

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of a toxic passage by text: that of its worst clause; 0 without any."""
        t = Tokens.of(texts, self.vocabulary)
        s, text = self.clause_scores(t)
        worst = np.full(len(texts), -30.0)
        np.maximum.at(worst, text, s)
        empty = np.diff(np.concatenate([[0], t.ends])) <= 1
        return np.where(empty, 0.0, 1 / (1 + np.exp(-np.clip(worst, -30, 30))))


def _log_odds(pos: Tokens, unl: Tokens, n_words: int) -> np.ndarray:
    """Naive log-odds of features by the documents they occur in: only picks the first clauses."""
    counts = []
    for t in (pos, unl):
        c = np.zeros(n_words + DIMENSIONS + 1)
        doc = np.searchsorted(t.ends, np.arange(len(t.ids)), side="right")
        for f in _features(t.ids, n_words):
            has = f >= 0
            c += np.bincount(np.unique(doc[has] * len(c) + f[has]) % len(c), minlength=len(c))
        counts.append((c, len(t.ends)))
    (p, np_), (u, nu) = counts
    w = np.log((p + 0.3) / (np_ + 1)) - np.log((u + 1) / (nu + 2))
    w[p < 2] = np.minimum(w[p < 2], 0)
    w[(p + u) == 0] = 0
    w[-1] = 0
    return w


def _rows(t: Tokens, picked: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight) of the features of the picked clauses."""
    starts, _ = t.clauses()
    stops = np.append(starts[1:], len(t.ids))
    rows, cols, orders = [], [], []
    lengths = stops[picked] - starts[picked]
    token = np.repeat(starts[picked] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    row = np.repeat(np.arange(len(picked)), lengths)
    for o, f in zip(ORDERS, _features(t.ids, n_words)):
        c = f[token]
        rows.append(row[c >= 0])
        cols.append(c[c >= 0])
        orders.append(np.full(len(cols[-1]), o))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(orders)


def _worst(t: Tokens, model: ToxicityModel, shorten: bool) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of the worst clause of every text."""
    s, text = model.clause_scores(t)
    starts, _ = t.clauses()
    if shorten:  # sums favour long clauses
        s = s / np.sqrt(np.append(starts[1:], len(t.ids)) - starts + 3)
    order = np.lexsort((s, text))
    last = order[np.append(np.flatnonzero(np.diff(text[order])), len(order) - 1)]
    return s[last], last


def _wordlike(w: str) -> bool:
    return not w.isdigit() and w not in _ENDS and w not in _COMMAS and "*" not in w and not (len(w) == 1 and "a" <= w <= "z")


def document_frequencies(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): number of documents that every word occurs in, over all texts; null and empty ones have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        pieces = Pieces(lambda tokens: filter(_wordlike, tokens))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b[0].to_pylist():
                if t:
                    seen.update(set(pieces.in_text(_clean(t))))
            if len(seen) > COUNTED:
                yield out()
                seen = Counter()
        yield out()

    return texts.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(positive: list[str], unlabelled: list[str], confirmed: np.ndarray, prior: float = PRIOR, rounds: int = 5, steps: int = 40, rate: float = 0.4, l2: float = 6e-6, frequent: list[str] | None = None) -> ToxicityModel:
    """Fit by non-negative PU learning over the worst clause of every text.

    ``confirmed`` marks the unlabelled texts that are among the confirmed ones. The share of the other texts
    that the model finds, over its recall of the positives held out of the round, gives the class prior of the next
    round. ``frequent`` are the words known from all documents; without it they are counted among the unlabelled texts.
    Without positives or unlabelled texts nothing is found toxic.
    """
    in_positive: Counter = Counter()
    for x in positive:
        in_positive.update(set(_TOKEN(_clean(x))))
    if frequent is None:
        df: Counter = Counter()
        for x in unlabelled:
            df.update(set(_TOKEN(_clean(x))))
        frequent = [w for w, n in df.items() if n >= LEAST]
    words = sorted(w for w in {*frequent, *(w for w, n in in_positive.items() if n >= 2)} if _wordlike(w))
    vocabulary = Vocabulary(words)
    n = FIRST_WORD + len(words)
    model = ToxicityModel(vocabulary, np.zeros(n + DIMENSIONS + 1), -5.0, prior)
    if not positive or not unlabelled:
        model.bias = -30.0
        return model
    pos, unl = Tokens.of(positive, vocabulary), Tokens.of(unlabelled, vocabulary)
    guess = ToxicityModel(vocabulary, _log_odds(pos, unl, n), 0.0, prior)
    n_pos, n_unl = len(positive), len(unlabelled)
    fold = np.arange(n_pos) % FOLDS if n_pos >= 20 else np.full(n_pos, -1)
    unseen = np.full(n_pos, np.inf)  # score by a model that was not fitted on the text
    starts = unl.clauses()[0]
    pool = np.unique(np.random.default_rng(5).choice(len(starts), min(len(starts), BACKGROUND), replace=False))
    (fs, first), (us, first_unl) = _worst(pos, guess, True), _worst(unl, guess, True)
    # positives whose most suspicious clause could be anybody's are left out: wrong labels
    believed = fs >= min(np.quantile(us, BELIEVED), np.median(fs))
    for r in range(rounds):
        held = (fold == r) if r < FOLDS else np.zeros(n_pos, dtype=bool)
        if r == FOLDS:  # nor are those that the rest of the positives gives no support
            believed &= (unseen > DOUBT) | (fs >= np.quantile(us, STRONG))
        pw, uw = first, first_unl
        if r:  # positives that the model does not find yet keep their first clause
            (ms, mw), (_, uw) = _worst(pos, model, False), _worst(unl, model, False)
            pw = np.where(ms > 0, mw, first)
        sure = believed & ~held
        pool = np.union1d(pool, uw)
        pr, pc, po = _rows(pos, pw[sure], n)
        ur, uc, uo = _rows(unl, pool, n)
        w, b = np.zeros_like(model.weights), -3.0
        squares, sb, loss = np.full_like(w, 1e-10), 1e-10, 0.0
        k = int(sure.sum())
        for _ in range(steps):
            gp = np.bincount(pr, weights=w[pc] * po, minlength=k) + b
            gu = np.bincount(ur, weights=w[uc] * uo, minlength=len(pool)) + b
            sp, su = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))
            # logistic loss as positive on P; as negative on U by document, and as negative on P for the correction
            negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).sum() / n_unl + model.prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
            if negative >= 0:
                du, dp = su / n_unl, -model.prior / k * np.ones(k)
            else:  # the negative risk must not fall below 0: step back on it alone
                du, dp = -su / n_unl, model.prior * sp / k
            loss = max(0.0, negative) - model.prior * np.log(np.maximum(sp, 1e-12)).mean()
            grad = np.bincount(pc, weights=dp[pr] * po, minlength=len(w)) + np.bincount(uc, weights=du[ur] * uo, minlength=len(w)) + l2 * w
            squares += grad**2
            sb += (dp.sum() + du.sum()) ** 2
            w -= rate * grad / np.sqrt(squares)
            b -= rate * (dp.sum() + du.sum()) / np.sqrt(sb)
        w[-1] = 0
        model.weights, model.bias = w, float(b)
        model.history.append(float(loss))
        if held.any():
            unseen[held] = _worst(pos, model, False)[0][held]
            recall = max(0.1, float((unseen[held] > 0).mean()))
            others = float((_worst(unl, model, False)[0][~confirmed] > 0).mean()) if (~confirmed).any() else 0.0
            known = float(confirmed.mean())
            model.prior = float(np.clip(known + (1 - known) * others / recall, max(known, MIN_PRIOR), MAX_PRIOR))
    model.weights = model.weights.astype(np.float32)
    return model


def _bounded(ids: DataFrame, texts: DataFrame, chars: int) -> pa.Table:
    """Whole texts of the sample ``ids`` in the order of their hash, as many as fit into ``chars`` in all; a text that does
    not fit any more is passed over. Lengths are weighed before any text comes to the driver."""
    sizes = texts.join(ids, "doc_id").select("doc_id", F.char_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    kept, left = [], chars
    for doc, n in zip(sizes["doc_id"].to_pylist(), sizes["n"].to_pylist()):
        if n <= left:
            kept.append((doc,))
            left -= n
    chosen = F.broadcast(texts.sparkSession.createDataFrame(kept, "doc_id long"))  # at most the sample's rows
    return texts.join(ids, "doc_id").join(chosen, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()


def train(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on documents confirmed as toxic (by a reviewer, and not called clean by as many others) and on a
    sample of all. Contradicting labels count as a vote; a tie confirms nothing."""
    ws = Workspace(documents.sparkSession, "toxicity")
    vote = F.when(F.col("label").isin(*TOXIC), 1).when(F.col("label") == "clean", -1)
    confirmed = labels.groupBy("doc_id").agg(F.sum(vote).alias("votes")).where("votes > 0").select("doc_id", F.lit(True).alias("confirmed"))
    texts = documents.where("text is not null and text <> ''").select("doc_id", "text")
    n = documents.count()
    chosen = ws.write(bounded_sample(confirmed, "doc_id", MAX_POSITIVE, labels.count()).select("doc_id"), "confirmed")
    positive = _bounded(F.broadcast(chosen), texts, MAX_FIT_CHARS // 2)  # at most MAX_POSITIVE ids
    sample = bounded_sample(texts.select("doc_id"), "doc_id", MAX_UNLABELLED, n)
    sample = ws.write(sample.join(confirmed, "doc_id", "left").select("doc_id", F.coalesce("confirmed", F.lit(False)).alias("confirmed")), "sample")
    unlabelled = _bounded(F.broadcast(sample), texts, MAX_FIT_CHARS // 2)  # at most MAX_UNLABELLED ids
    counts = document_frequencies(texts).where(F.col("n") >= max(LEAST, WORD_SHARE * n))
    frequent = [r.word for r in counts.collect()]  # bounded by WORD_SHARE
    return fit(positive["text"].to_pylist(), unlabelled["text"].to_pylist(), np.asarray(unlabelled["confirmed"].to_pylist(), dtype=bool), frequent=frequent)


def score(documents: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``score``, the probability of a toxic passage; null and empty texts have 0."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = shared.value.scores(part[text].to_pylist())
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(s, pa.float64())], [*keep, "score"])

    return documents.select(*keep, text).mapInArrow(run, documents.select(*keep).schema.add("score", "double"))


def toxic_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: ToxicityModel | None = None) -> DataFrame:
    """(doc_id, source, score, toxic) of every document, by ``model`` or one fitted on these."""
    model = model or train(documents, labels)
    return score(documents, model, ["doc_id", "source"]).withColumn("toxic", F.col("score") >= threshold)


def toxicity_rates(scored: DataFrame) -> DataFrame:
    """Per source (null included): documents, toxic ones, their rate and the mean score."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if("toxic").alias("n_toxic"),
        F.avg(F.col("toxic").cast("double")).alias("toxic_rate"), F.avg("score").alias("mean_score"),
    )
