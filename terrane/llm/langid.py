"""Language identification by error-correcting output codes.

Each language has a codeword; one linear classifier over hashed character n-grams of words predicts each of its bits.
Decoding adds the logistic losses of the bits, weighted by how well each bit separates in training, and takes the
language of least loss. A text whose two best languages differ by less than ``margin`` is flagged as ambiguous.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import fraction_of
from .words import WordTable, kept, text_chunks

BUCKETS = 4096
#: Bound of the training sample: documents of one language, and of all languages.
SAMPLE_PER_LANGUAGE = 500
SAMPLE = 4000
LONGEST_GRAM = 3
MARGIN = 0.05


#: Fixed multipliers of the n-gram hash.
MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint64)
NOT_LETTERS = re.compile(r"[^\w ]|[\d_]")


_SPACE = re.compile(r"\s")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the 1- to 3-grams of the letters of ``words``, lower-cased, between spaces; the words' numbers.

    ``words`` hold no white space; a word without letters has no n-grams.
    """
    cut = NOT_LETTERS.sub("", " ".join(words)).lower().split(" ")
    cut = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in cut]
    code = np.frombuffer(f" {' '.join(cut)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    space = code == 32
    word = np.cumsum(space) - 1
    buckets, owners = [], []
    for n in range(1, LONGEST_GRAM + 1):
        size = len(code) - n + 1
        if size < 1:
            break
        h = np.full(size, np.uint64(n))
        for i in range(n):
            h = (h ^ (code[i : i + size] + np.uint64(1))) * MULTIPLIERS[i]
            h ^= h >> np.uint64(29)
        # inside one word: no space but at its own ends, and a letter at least
        fits = ~space[:size] if n == 1 else ~(space[:size] & space[n - 1 :])
        for i in range(1, n - 1):
            fits &= ~space[i : i + size]
        at = np.flatnonzero(fits)
        buckets.append((h[at] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(word[at])
    return np.concatenate(buckets), np.concatenate(owners)


def _words(text: str | None) -> list[str]:
    return text.split() if text else []


def _slices(text: str, most: int):
    """Lists of the words of ``text``, each of about ``most`` characters of it; no word is cut."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, min(len(text), at + most))
        end = space.start() if space else len(text)
        yield text[at:end].split()
        at = end


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages: all distinct splits for few, random columns for many."""
    if n <= 7:
        columns = [[1 if i == 0 or (k >> (i - 1)) & 1 else -1 for i in range(n)] for k in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.float64).T.reshape(n, -1)
    draw, best = np.random.default_rng(seed), None
    for _ in range(50):
        code = draw.choice([-1.0, 1.0], (n, int(10 * np.log2(n))))
        code = code[:, np.abs(code.sum(0)) < n]
        gap = (code.shape[1] - (code @ code.T)[~np.eye(n, dtype=bool)]).min() / 2
        if best is None or gap > best[0]:
            best = gap, code
    return best[1]


class Model:
    """Languages, codewords, and for each bit the n-gram weights, bias and decoding weight."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150, rate: float = 0.05) -> Model:
        """``x``: rows of n-gram shares times ``SCALE``; ``y``: row numbers of ``languages``."""
        code = codewords(len(languages))
        target = (code[y] > 0).astype(np.float32)
        w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        m = v = mb = vb = 0
        weight = (1 / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)[:, None] / max(1, len(languages))
        for t in range(1, steps + 1):
            g = weight * (target - 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))))
            gw, gb = x.T @ g - 1e-5 * w, g.sum(0)
            m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
            w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
            b += rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
        right = ((x @ w + b > 0) == (target > 0.5)).astype(np.float64)
        trust = np.maximum((right * weight).sum(0) - 0.5, 1e-3)
        return cls(languages, code, w, b, trust / trust.sum())

    def decode(self, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language numbers, scores and ambiguity flags from the summed bit margins of documents."""
        bits = sums / np.maximum(counts, 1)[:, None] * SCALE + self.bias
        loss = np.logaddexp(0, -bits[:, None, :] * self.code[None]) @ self.trust
        share = np.exp(-loss * max(1, self.code.shape[1]))
        share = share / share.sum(1, keepdims=True)
        order = np.sort(loss, axis=1)
        unsure = order[:, 1] - order[:, 0] < MARGIN if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        best = loss.argmin(1)
        return best, share[np.arange(len(best)), best], unsure


#: Words that a Python worker keeps the scores of, and characters of a long text that are looked up at once.
WORDS, SLICE = 150_000, 400_000

#: n-gram shares are small; they are learned from and applied at this scale.
SCALE = 50.0


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, sample: int = SAMPLE, salt: int = 11) -> Model | None:
    """Fit on (doc_id, text, lang) rows with a lang. None if there are none.

    The languages' counts come to the driver (one row each) and at most about ``sample`` rows as hashed n-gram counts:
    ``min(per_language, sample / languages)`` expected of each language, chosen by a hash of doc_id.
    """
    found = {r["lang"]: r["n"] for r in labelled.filter("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(found)
    if not languages:
        return None
    quota = max(1, min(per_language, sample // len(languages)))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, quota / found[k]))])
    chosen = labelled.filter("lang IS NOT NULL").withColumn("lang", F.col("lang").cast("string")).filter(fraction_of("doc_id", salt=salt) < share[F.col("lang")]).select("text", "lang")

    def count(batches):
        for batch in batches:
            shares, langs = [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = np.bincount(grams(_words(text))[0], minlength=BUCKETS).astype(np.float32)
                total = seen.sum()
                if total:
                    at = np.flatnonzero(seen).astype("<u2")
                    shares.append(at.tobytes() + (seen[at] / total).astype("<f4").tobytes())
                    langs.append(lang)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "grams": pa.array(shares, pa.binary())})

    rows = map_arrow(chosen, count, "lang string, grams binary").collect()
    seen = sorted({r["lang"] for r in rows})
    if not seen:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["grams"])))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        k = len(r["grams"]) // 6
        x[i, np.frombuffer(r["grams"], "<u2", k)] = np.frombuffer(r["grams"], "<f4", k, 2 * k)
    return Model.fit(x * SCALE, np.array([seen.index(r["lang"]) for r in rows]), seen)


def _scorer(model: Model | None):
    """A function from an Arrow column of texts to (languages, scores, ambiguity flags), with its words kept between tasks."""
    width = 0 if model is None else model.code.shape[1]
    key = uuid.uuid4().hex

    def compute(words):
        buckets, owners = grams(words)
        out = np.empty((len(words), width + 1), np.float32)
        for k in range(width):
            out[:, k] = np.bincount(owners, model.weights[buckets, k], len(words))
        out[:, width] = np.bincount(owners, minlength=len(words))
        return out

    def score(texts):
        words = kept(key, lambda: WordTable(compute, width + 1, WORDS))
        lang, scores, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for a, b, chunk in text_chunks(texts) if model is not None else ():
            if len(chunk) == 1 and len(chunk[0] or "") > SLICE:
                # a long text is looked up slice by slice
                sums = np.zeros((1, width + 1))
                for c in _slices(chunk[0], SLICE):
                    at = words.lookup(c)
                    sums += words.rows[at].sum(0, dtype=np.float64, keepdims=True)
            else:
                cut = [_words(t) for t in chunk]
                sizes = np.array([len(c) for c in cut])
                at = words.lookup([w for c in cut for w in c])
                total = np.concatenate((np.zeros((1, width + 1)), np.cumsum(words.rows[at], axis=0, dtype=np.float64)))
                ends = np.cumsum(sizes)
                sums = total[ends] - total[ends - sizes]
            best, share, near = model.decode(sums[:, :width], sums[:, width])
            known = sums[:, width] > 0.5
            for i in np.flatnonzero(known):
                lang[a + i] = model.languages[best[i]]
            scores[a:b], unsure[a:b] = np.where(known, share, 0), near & known
        return lang, scores, unsure

    return score


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous; ``keep`` names the columns to carry (doc_id if not given).

    A text that is null or without a letter, or any text when nothing was learned, is ``und`` with score 0 and not
    ambiguous. Whole texts count, very long ones slice by slice; repeated rows are scored alike; columns other than ``keep`` and
    text are ignored; an empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    taken = {"lang_pred", "score", "ambiguous"} & set(keep)
    if taken:
        raise ValueError(f"columns {sorted(taken)} would clash")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[:-1])
    score = _scorer(model)

    def run(batches):
        for batch in batches:
            lang, scores, unsure = score(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(scores), pa.array(unsure)], [*batch.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    return map_arrow(source, run, f"{schema}, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """``docs`` without those whose language is ``und``, or ambiguous with a score under ``least``; all columns stay.

    Null texts and texts without a letter are ``und`` and go; so does every row when nothing was learned. Texts are read whole,
    however long; repeated rows share their fate; an empty table gives no rows.
    """
    at, score = docs.columns.index("text"), _scorer(model)

    def run(batches):
        for batch in batches:
            lang, scores, unsure = score(batch.column(at))
            yield batch.filter(pa.array([x != "und" and not (u and s < least) for x, s, u in zip(lang, scores, unsure)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
