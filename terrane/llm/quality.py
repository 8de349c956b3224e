"""Document quality from a linear-chain conditional random field over lines.

Every line is good (0) or bad (1). Its features are shares of character classes and of repeated words, with those of the
lines before and after it. Labels mark documents, so lines are labelled first: in a bad document the lines that look
unlike those of good documents are bad, and at least its worst one. Marginals weighted by line length give the
document's quality through a logistic regression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import sample_labels
from .crf import Adam, fit_logistic, gradients, marginals
from .words import text_chunks

#: Bound of the training sample: expected documents of each label.
SAMPLE_PER_LABEL = 2000
#: Documents of more lines are scored, but not learned from.
LONGEST_LEARNED = 10_000
#: Bytes' classes: upper-case ASCII, lower-case ASCII, digits, spaces, marks; bytes of other characters.
CLASSES = 6
FEATURES = 14


def _classes() -> np.ndarray:
    out = np.full(256, 5, np.uint8)
    for k, chars in enumerate((range(65, 91), range(97, 123), range(48, 58), (9, 11, 12, 13, 32))):
        out[list(chars)] = k
    marks = [c for c in range(128) if out[c] == 5]
    out[marks] = 4
    return out


CLASS = _classes()


def line_features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of ``texts``, the lengths of lines in bytes, the numbers of lines of each text.

    Lines end at newlines. A null or empty text has one empty line.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(joined == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    sizes = ends - starts
    code = CLASS[joined]
    code[ends] = CLASSES
    counts = np.zeros((len(ends), CLASSES))
    for k in range(CLASSES):
        total = np.concatenate(([0], np.cumsum(code == k, dtype=np.int64)))
        counts[:, k] = total[ends] - total[starts]
    # two equal marks side by side, as in *** and !!
    same = np.zeros(len(joined), bool)
    same[1:] = (joined[1:] == joined[:-1]) & (code[1:] == 4)
    total = np.concatenate(([0], np.cumsum(same, dtype=np.int64)))
    doubled = total[ends] - total[starts]
    words = [line.split() for r in raw for line in r.split(b"\n")]
    n = np.array([len(w) for w in words], np.float64)
    different = np.array([len(set(w)) for w in words], np.float64)
    repeats = np.array([sum(map(bytes.__eq__, w, w[1:])) for w in words], np.float64)
    single = np.array([sum(map((1).__eq__, map(len, w))) for w in words], np.float64)
    some, size = np.maximum(n, 1), np.maximum(sizes, 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 5], 1)
    x = np.empty((len(ends), FEATURES))
    x[:, 0] = counts[:, 0] / letters
    x[:, 1] = counts[:, 2] / size
    x[:, 2] = counts[:, 4] / size
    x[:, 3] = doubled / some
    x[:, 4] = 1 - different / some
    x[:, 5] = repeats / some
    x[:, 6] = single / some
    x[:, 7] = counts[:, 3] / size
    x[:, 8] = np.log1p(n) / 5
    x[:, 9] = n == 0
    x[:, 10] = counts[:, 4] / some / 4
    x[:, 11] = np.minimum(size / some, 40) / 20
    x[:, 12] = counts[:, 0] > 0.5 * letters
    x[:, 13] = 1
    return x, sizes, np.array([r.count(b"\n") + 1 for r in raw])


def with_neighbours(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and of the line after; zeros beyond the document."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[starts] = 0
    after[np.concatenate((starts[1:], [len(x)])) - 1] = 0
    return np.hstack((x, before, after))


def document_features(p: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each document: the length-weighted share of bad lines, the worst line, the log of bad length, of length, 1."""
    weight = sizes + 1.0
    bad, total = np.add.reduceat(p * weight, starts), np.add.reduceat(weight, starts)
    most = np.clip(np.maximum.reduceat(p, starts), 1e-4, 1 - 1e-4)
    return np.stack((bad / total, np.log(most / (1 - most)) / 4, np.log1p(bad) / 5, np.log(total) / 5, np.ones(len(starts))), 1)


class Model:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, init: float, document: np.ndarray):
        self.weights, self.trans, self.init, self.document = weights, trans, init, document

    def lines(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """P(bad) of each line."""
        return marginals(with_neighbours(x, starts) @ self.weights, starts, self.trans, self.init)

    def score(self, p: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(document_features(p, sizes, starts) @ self.document, -30, 30)))


def fit(x: np.ndarray, sizes: np.ndarray, lines: np.ndarray, good: np.ndarray, weight: np.ndarray, steps: int = 150) -> Model:
    """Fit to the lines of documents that are good (1) or bad (0); ``weight``: documents that each stands for."""
    if len(np.unique(good)) < 2:
        return Model(np.zeros(3 * x.shape[1]), np.zeros((2, 2)), 0.0, np.array([0, 0, 0, 0, 20.0 if len(good) and good[0] else -20.0]))
    starts = np.cumsum(lines) - lines
    bad = np.repeat(1 - good, lines)
    x3 = with_neighbours(x, starts)
    y, w = bad.astype(np.int64), None
    for _ in range(3):
        w = fit_logistic(x, y, l2=1e-4)
        z = x @ w
        worst = np.repeat(np.maximum.reduceat(z, starts), lines)
        y = ((bad == 1) & ((z > 0) | (z >= worst))).astype(np.int64)
    params = {"w": np.concatenate((w, np.zeros(2 * x.shape[1]))), "trans": np.zeros((2, 2)), "init": np.zeros(1)}
    climb = Adam(0.05)
    for _ in range(steps):
        g, gt, gi = gradients(x3 @ params["w"], starts, y, params["trans"], params["init"][0])
        climb.update(params, {"w": x3.T @ g / len(y) - 1e-5 * params["w"], "trans": gt / len(y) - 1e-5 * params["trans"], "init": np.array([gi / len(starts)])})
    p = marginals(x3 @ params["w"], starts, params["trans"], params["init"][0])
    document = fit_logistic(document_features(p, sizes, starts), good, weight / weight.mean(), l2=1e-4)
    return Model(params["w"], params["trans"], float(params["init"][0]), document)


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, salt: int = 31, longest: int = LONGEST_LEARNED) -> Model:
    """Fit on documents (doc_id, text) that have a label in ``labels`` (doc_id, label), 1 good and 0 bad; null texts are empty.

    About ``per_label`` documents of each label, chosen by a hash of doc_id, come to the driver as line features, but for those of
    more than ``longest`` lines, which are not learned from. Both bound the driver's memory; scoring has no bound.
    """
    chosen, share = sample_labels(labels, per_label, salt)
    chosen = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batches):
        for batch in batches:
            x, sizes, rows = [], [], []
            for a, _, texts in text_chunks(batch.column(0)):
                for i, text in enumerate(texts):
                    f, s, _ = line_features([text])
                    if len(s) <= longest:
                        x.append(f.astype("<f4").tobytes())
                        sizes.append(s.astype("<i8").tobytes())
                        rows.append(a + i)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(sizes, pa.binary()), batch.column(1).take(pa.array(rows, pa.int64()))], ["x", "sizes", "label"])

    rows = map_arrow(chosen.select(F.col("text").cast("string"), F.col("label").cast("int")), features, "x binary, sizes binary, label int").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["x"])))
    label = np.array([r["label"] for r in rows], np.int64)
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), "<f4").reshape(-1, FEATURES).astype(np.float64)
    sizes = np.frombuffer(b"".join(bytes(r["sizes"]) for r in rows), "<i8")
    return fit(x, sizes, np.array([len(r["sizes"]) // 8 for r in rows], np.int64), label, np.array([1 / share[k] for k in label.tolist()]))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score (probability of good quality), lines and bad_lines (how many are likelier bad).

    ``keep`` names the columns to carry (doc_id if not given). Null and empty texts have one empty line. Whole texts
    count; repeated rows are scored alike; other columns are ignored.
    """
    keep = ["doc_id"] if keep is None else keep
    if taken := {"score", "lines", "bad_lines"} & set(keep):
        raise ValueError(f"columns {sorted(taken)} would clash")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[:-1])

    def run(batches):
        for batch in batches:
            score, count, bad = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b, texts in text_chunks(batch.column(batch.num_columns - 1)):
                x, sizes, lines = line_features(texts)
                starts = np.cumsum(lines) - lines
                p = model.lines(x, starts)
                score[a:b], count[a:b], bad[a:b] = model.score(p, sizes, starts), lines, np.add.reduceat((p > 0.5).astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array(count), pa.array(bad)], [*batch.schema.names[:-1], "score", "lines", "bad_lines"])

    return map_arrow(source, run, f"{schema}, score double, lines long, bad_lines long")
