"""Language identification as inference of a multilingual mixture.

Training counts character n-grams of labelled texts for each language.  A document is a
bag of words; a word's likelihood in a language is the product of those of its n-grams.
Expectation-maximisation estimates the share of each language in the document, and the
set of languages is the one of highest log-likelihood less a penalty for each language.
The document's language is the one of the largest share in that set, the score its share.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import claim, mix, slices

#: Numbers that a regular expression's words hold beside letters (Unicode categories N but Nd), such as ½.
NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha())
LETTERS = re.compile(rf"[^\W_{re.escape(NUMBERS)}]+")
#: Hashed slots of n-grams of bytes for a language, n-gram sizes, additive smoothing.
SLOTS, SIZES, SMOOTH = 1 << 15, (2, 3, 4), 0.5
#: Most labelled documents of a language that training reads, in expectation.
TRAIN_DOCS = 2000
#: Penalty of each language in the set, in units of the logarithm of the number of words.
PENALTY = 2.0
#: Words cached in a worker.
CACHED = 300_000


def letters(token: str) -> str:
    """The words of a token, lower-cased, a space around each; empty without a letter."""
    if token.isalpha():
        return f" {token.lower()} "
    words = LETTERS.findall(token.lower())
    return f" {' '.join(words)} " if words else ""


def gram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index into words, slot) of every n-gram of the words' UTF-8 bytes."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    owners, slots = [], []
    for n in SIZES:
        m = len(data) - n + 1
        if m <= 0:
            continue
        ok = owner[:m] == owner[n - 1 :]
        g = np.full(m, n, np.uint64)
        for i in range(n):
            g = (g << np.uint64(8)) | data[i : i + m]
        owners.append(owner[:m][ok])
        slots.append((mix(g[ok]) % np.uint64(SLOTS)).astype(np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *owners]), np.concatenate([none, *slots])


def held_out(id_col: str) -> Column:
    """Whether the CRC-32 of an id's text leaves 1 modulo 3; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Log-likelihoods of hashed n-grams: a row for each slot, a column for each language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        c = counts + SMOOTH
        self.table = np.log(c / c.sum(0)) if len(langs) else c
        self.words: dict[str, int] = {}
        self.rows = np.zeros((1024, len(langs)))
        self.facts = np.zeros((1024, 2))
        self.used = 0

    def learn(self, tokens: list[str]) -> None:
        """Gives new tokens their places in rows and facts (number of n-grams, log-likelihood in
        the best language); -1: no letter."""
        words = [letters(t) for t in tokens]
        have = [i for i, w in enumerate(words) if w]
        self.words.update(dict.fromkeys(tokens, -1))
        if not have:
            return
        at = self.used
        owner, slot = gram_slots([words[i] for i in have])
        x = np.stack([np.bincount(owner, self.table[slot, k], len(have)) for k in range(len(self.langs))], 1)
        while at + len(have) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        self.facts[at : at + len(have)] = np.stack([np.bincount(owner, minlength=len(have)), x.max(1)], 1)
        self.rows[at : at + len(have)] = np.exp(np.maximum(x - x.max(1, keepdims=True), -60))
        self.words.update(zip([tokens[i] for i in have], range(at, at + len(have)), strict=True))
        self.used = at + len(have)

    def shares(self, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of the languages by expectation-maximisation, and the log-likelihood."""
        total = n.sum()
        p = np.full(e.shape[1], 1 / e.shape[1])
        for _ in range(40):
            mixed = e @ p
            new = p * ((n / mixed) @ e) / total
            done = np.abs(new - p).max() < 1e-3
            p = new
            if done:
                break
        return p, float(n @ np.log(np.maximum(e @ p, 1e-300)))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, dict[str, float], float | None]]:
        """Language, score, the shares of the selected set and the fit, for each text.

        The fit is the mixture's log-likelihood of an n-gram, on average, less that of n-grams
        drawn evenly from all slots; None without a letter, 0 if no language is known."""
        if not self.langs:
            return [("und", 0.0, {}, 0.0 if any(map(letters, (t or "").split())) else None) for t in texts]
        tokens = [t.split() if t else [] for t in texts]
        new = list(set(chain.from_iterable(tokens)).difference(self.words))
        if len(self.words) + len(new) > CACHED:
            self.words.clear()
            self.used = 0
            new = list(set(chain.from_iterable(tokens)))
        self.learn(new)
        return [self._predict(Counter(t)) for t in tokens]

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float], float | None]:
        return self.predict_all([text])[0]

    def _predict(self, counts: Counter) -> tuple[str, float, dict[str, float], float | None]:
        at = np.fromiter(map(self.words.__getitem__, counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), float, len(counts))
        ok = at >= 0
        if not ok.any():
            return "und", 0.0, {}, None
        e, n, facts = self.rows[at[ok]], n[ok], self.facts[at[ok]]
        p, most = self.shares(e, n)
        order = np.argsort(-p, kind="stable")
        cost = PENALTY * np.log(n.sum() + 1)
        one = float(n @ np.log(np.maximum(e[:, order[0]], 1e-300)))
        best, chosen, value = order[:1], np.ones(1), one - cost
        for k in range(2, len(order) + 1):
            if most - k * cost <= value:  # no larger set can do better
                break
            q, got = self.shares(e[:, order[:k]], n)
            if got - k * cost > value:
                best, chosen, value = order[:k], q, got - k * cost
        top = int(np.argmax(chosen))
        grams, most = n @ facts
        fit = (value + len(best) * cost + most) / grams + np.log(SLOTS)
        return self.langs[best[top]], float(min(max(chosen[top], 0.0), 1.0)), {self.langs[i]: float(x) for i, x in zip(best, chosen, strict=True)}, float(fit)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model:
    """A model from the labelled documents of `docs`, read whole.

    About `train_docs` documents of each language are used, chosen by a hash of their id;
    the counts are added up on the executors, and the driver gets at most SLOTS numbers
    for each language."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    have = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(have)
    if not langs:
        return Model([], np.zeros((SLOTS, 0)))
    part = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(min(1.0, train_docs / have[k]) * 1_000_000)))])
    some = labelled.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < part[F.col(lang_col)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = [w for w in map(letters, text.split()) if w]
                held[lang] = held.get(lang, 0) + np.bincount(gram_slots(words)[1], minlength=SLOTS)
        for lang, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "slot", "n"])

    sums = some.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    counts = np.zeros((SLOTS, len(langs)))
    got = sums.toPandas()
    counts[got["slot"].to_numpy(int), [langs.index(x) for x in got["lang"]]] = got["n"]
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model, text_col: str = "text", fit: bool = False) -> DataFrame:
    """`docs` with lang_pred, score and lang_shares (the selected set's shares) added.

    A null text, or one without a letter, is `und` with score 0 and no shares; so is every
    text if the model knows no language.  Texts in unknown letters get the first
    language and an equal share.  With `fit`, lang_fit says how well the mixture explains a
    text (see predict_all): below 0, worse than n-grams by chance.  Columns of these names in
    `docs` are replaced.
    """
    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "lang_shares": pa.map_(pa.string(), pa.float64())} | ({"lang_fit": pa.float64()} if fit else {})
    rest = docs.drop(*kinds)
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.table))
    columns, text_at = rest.columns, rest.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        for b in slices(batches, 512):
            if m is None:
                claim("language")
                m = Model([], np.zeros((SLOTS, 0)))
                m.langs, m.table = sent.value
                m.rows, m.facts = np.zeros((1024, len(m.langs))), np.zeros((1024, 2))
            got = m.predict_all(b.column(text_at).to_pylist())
            made = [[x[0] for x in got], [x[1] for x in got], [list(x[2].items()) for x in got], [x[3] for x in got]]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(made, kinds.values()))], names=[*b.schema.names, *kinds])

    rest_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    out = rest.mapInArrow(predict, f"{rest_schema}, lang_pred string, score double, lang_shares map<string,double>{", lang_fit double" if fit else ""}")
    return out.select(*columns, *kinds)
