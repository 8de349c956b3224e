"""Toxic spans by a linear-chain conditional random field over words.

A word's features are itself and its first four, five and six letters. Labels mark documents, so words are labelled first:
a word counts as toxic in a toxic training document when documents that hold one of its features are toxic far more
often than chance. The field is fitted to these tokens; its forward-backward marginals give the offending spans, and a
logistic regression over their sums and maximum gives the document's score.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import sample_labels
from .crf import Adam, fit_logistic, gradients, marginals
from .words import WordTable, kept, text_chunks

#: Bound of the training sample: expected documents of each label.
SAMPLE_PER_LABEL = 1000
#: Documents of more words are scored, but not learned from.
LONGEST_LEARNED = 10_000
#: A feature joins the vocabulary when this many sampled documents hold it.
VOCABULARY_DOCUMENTS = 4
#: A feature is toxic when its standardised log odds reach this, and the odds themselves the second figure.
TOXIC_Z, TOXIC_ODDS = 3.0, 8.0
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


PREFIXES = (4, 5, 6)
FEATURES = 1 + len(PREFIXES)


def word_features(words: list[str]) -> np.ndarray:
    """Rows of signed 64-bit hashes: the word, lower-cased, without marks at its ends, and its prefixes; 0 where it has none."""
    out = np.zeros((len(words), FEATURES), np.uint64)
    digest = xxhash.xxh3_64_intdigest
    for i, w in enumerate(words):
        core = (w if w.isalpha() else EDGES.sub("", w)).lower()
        if core:
            out[i, 0] = digest(core.encode("utf-8", "surrogatepass"))
            for k, n in enumerate(PREFIXES, 1):
                if len(core) >= n:
                    out[i, k] = digest(core[:n].encode("utf-8", "surrogatepass"), n)
    return out.view(np.int64)


def distinct_documents(documents: list[np.ndarray]) -> np.ndarray:
    """Numbers of documents that share none of four least hashes of three-word shingles with an earlier one.

    Copies of one document would make all of its words look like marks of its label.
    """
    seen: set[tuple[int, int]] = set()
    out = []
    for i, d in enumerate(documents):
        w = d[:, 0].view(np.uint64)
        h = w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:] * np.uint64(7) if len(w) > 2 else w
        least = {(k, int(((h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)).min())) for k in range(4)} if len(h) else {(-1, 0)}
        if not least & seen:
            out.append(i)
        seen |= least
    return np.array(out, np.int64)


class Model:
    """Feature weights by hash, the weight of every word, transitions and the document regression."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float, trans: np.ndarray, init: float, document: np.ndarray):
        self.hashes, self.weights, self.bias, self.trans, self.init, self.document = hashes, weights, bias, trans, init, document

    def word_logits(self, features: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(features), self.bias)
        at = np.minimum(np.searchsorted(self.hashes, features), len(self.hashes) - 1)
        return np.where(self.hashes[at] == features, self.weights[at], 0).sum(1) + self.bias

    def score(self, p: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(document_features(p, starts, sizes) @ self.document, -30, 30)))


def document_features(p: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each document: the largest marginal's log odds, the log of the expected toxic words, the share of toxic words, 1."""
    out = np.zeros((len(sizes), 4))
    out[:, 3] = 1
    full = np.flatnonzero(sizes)
    if len(full):
        most = np.clip(np.maximum.reduceat(p, starts[full]), 1e-4, 1 - 1e-4)
        total = np.add.reduceat(p, starts[full])
        out[full, 0] = np.log(most / (1 - most)) - np.log(1e-4)
        out[full, 1] = np.log1p(total)
        out[full, 2] = 10 * total / sizes[full]
    return out


def fit(documents: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, steps: int = 40) -> Model:
    """Fit to word features of documents (rows of ``FEATURES``), their labels (0 or 1) and how many documents each stands for."""
    own = distinct_documents(documents)
    documents, toxic, weight = [documents[i] for i in own], toxic[own].astype(np.int64), weight[own]
    sizes = np.array([len(d) for d in documents], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(documents) if len(documents) else np.zeros((0, FEATURES), np.int64)
    owner = np.repeat(np.arange(len(documents)), sizes)
    vocab, at = np.unique(flat, return_inverse=True)
    at = at.reshape(flat.shape)
    pairs = np.unique((at.astype(np.int64) * max(1, len(documents)) + owner[:, None]).reshape(-1))
    feature, doc = pairs // max(1, len(documents)), pairs % max(1, len(documents))
    held = np.bincount(feature, minlength=len(vocab))
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    in1 = np.bincount(feature, toxic[doc].astype(float), len(vocab))
    in0 = held - in1
    odds = np.log((in1 + 0.5) / (n1 - in1 + 0.5)) - np.log((in0 + 0.5) / (n0 - in0 + 0.5))
    error = np.sqrt(1 / (in1 + 0.5) + 1 / (n1 - in1 + 0.5) + 1 / (in0 + 0.5) + 1 / (n0 - in0 + 0.5))
    known = (held >= VOCABULARY_DOCUMENTS) & (vocab != 0)
    bad = known & (odds >= np.log(TOXIC_ODDS)) & (odds / error >= TOXIC_Z)
    y = (bad[at].any(1) & (toxic[owner] == 1)).astype(np.int64) if len(flat) else np.zeros(0, np.int64)

    # one weight for each known feature; slot 0 is for all others and stays 0
    slot = np.where(known, np.cumsum(known), 0)[at] if len(flat) else np.zeros((0, FEATURES), np.int64)
    width = int(known.sum()) + 1
    params = {"w": np.zeros(width), "bias": np.array([-4.0]), "trans": np.zeros((2, 2)), "init": np.zeros(1)}
    full = starts[sizes > 0]
    climb, uses = Adam(0.15), np.bincount(slot.reshape(-1), minlength=width) + 1.0
    for _ in range(steps if len(full) else 0):
        g, gt, gi = gradients(params["w"][slot].sum(1) + params["bias"][0], full, y, params["trans"], params["init"][0])
        gw = (np.bincount(slot.reshape(-1), np.repeat(g, FEATURES), width) - 0.05 * params["w"]) / uses
        gw[0] = 0
        climb.update(params, {"w": gw, "bias": np.array([g.sum() / len(g)]), "trans": (gt - 0.1 * params["trans"]) / len(flat), "init": np.array([(gi - 0.1 * params["init"][0]) / len(full)])})
    p = marginals(params["w"][slot].sum(1) + params["bias"][0], full, params["trans"], params["init"][0])
    x = document_features(p, starts, sizes)
    document = fit_logistic(x, toxic, weight / max(weight.mean(), 1e-9)) if n1 and n0 else np.array([0, 0, 0, -20.0 if not n1 else 20.0])
    return Model(vocab[known], params["w"][1:], float(params["bias"][0]), params["trans"], float(params["init"][0]), document)


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, salt: int = 23, longest: int = LONGEST_LEARNED) -> Model:
    """Fit on documents (doc_id, text) that have a label of 0 or 1 in ``labels`` (doc_id, label); null texts are empty.

    About ``per_label`` documents of each label, chosen by a hash of doc_id, come to the driver as word features, but for those of
    more than ``longest`` words, which are not learned from. Both bound the driver's memory; scoring has no bound.
    """
    chosen, share = sample_labels(labels, per_label, salt)
    chosen = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batches):
        for batch in batches:
            out, taken = [], []
            for a, _, texts in text_chunks(batch.column(0)):
                for i, text in enumerate(texts):
                    words = text.split() if text else []
                    if len(words) <= longest:
                        distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
                        rows = word_features(list(distinct))
                        out.append(rows[np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))].tobytes())
                        taken.append(a + i)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1).take(pa.array(taken, pa.int64()))], ["words", "label"])

    rows = map_arrow(chosen.select(F.col("text").cast("string"), F.col("label").cast("int")), features, "words binary, label int").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["words"])))
    label = np.array([r["label"] for r in rows], np.int64)
    return fit([np.frombuffer(bytes(r["words"]), np.int64).reshape(-1, FEATURES) for r in rows], label, np.array([1 / share[k] for k in label.tolist()]))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """``docs`` with score and spans: an array of (start, end) code points of runs of toxic words (marginal over 0.5).

    ``keep`` names the columns to carry (doc_id if not given). Null and empty texts get the score of a text without
    words and no spans. Repeated rows are scored alike; other columns are ignored.
    """
    keep = ["doc_id"] if keep is None else keep
    if taken := {"score", "spans"} & set(keep):
        raise ValueError(f"columns {sorted(taken)} would clash")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[:-1])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    key = uuid.uuid4().hex

    def compute(words):
        return model.word_logits(word_features(words)).astype(np.float32)[:, None]

    def run(batches):
        table = kept(key, lambda: WordTable(compute, 1))
        for batch in batches:
            score, found = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for a, b, texts in text_chunks(batch.column(batch.num_columns - 1)):
                cut = [t.split() if t else [] for t in texts]
                sizes = np.array([len(c) for c in cut])
                starts = np.cumsum(sizes) - sizes
                at = table.lookup([w for c in cut for w in c])
                p = marginals(table.rows[at, 0].astype(np.float64), starts[sizes > 0], model.trans, model.init)
                score[a:b] = model.score(p, starts, sizes)
                hit = np.flatnonzero(p > 0.5) if spans else ()
                for i in np.unique(np.searchsorted(starts + sizes, hit, "right")) if len(hit) else ():
                    found[a + i] = toxic_spans(texts[i], p[starts[i] : starts[i] + sizes[i]] > 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array(found, span_type)], [*batch.schema.names[:-1], "score", "spans"])

    return map_arrow(source, run, f"{schema}, score double, spans array<struct<start:int,end:int>>")


def toxic_spans(text: str, toxic: np.ndarray) -> list[dict]:
    """Offsets of runs of flagged words; words are what ``str.split`` gives."""
    out: list[dict] = []
    at, before = 0, False
    for w, bad in zip(text.split(), toxic.tolist()):
        at = text.index(w, at)
        if bad and before:
            out[-1]["end"] = at + len(w)
        elif bad:
            out.append({"start": at, "end": at + len(w)})
        before, at = bad, at + len(w)
    return out
