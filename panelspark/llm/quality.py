"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text train a small network on the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),

where a step that drives the bracket below zero goes back up on it instead.  The prior, the share of positives in
unlabelled text, is the best-bin estimate: over the thresholds of a first classifier of positives against unlabelled, the
least ratio of the shares above the threshold, with its confidence margin.  Negative labels are never used.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import bound_batches, chunks, fold, is_blank, lower_ascii, mix, span_hashes, text_buffer, word_spans

POSITIVE_ROWS, UNLABELLED_ROWS = 8_000, 16_000
#: Byte classes: lower case, upper case, digit, space, line end, other blanks, bytes beyond ASCII, single marks, all else.
_MARKS = b".,;:!?'\"-_|/\\()[]{}<>@#$%^&*+=~`"
_CLASS = np.full(256, 7, np.int64)
_CLASS[list(range(97, 123))], _CLASS[list(range(65, 91))], _CLASS[list(range(48, 58))] = 0, 1, 2
_CLASS[32], _CLASS[10], _CLASS[[9, 11, 12, 13]], _CLASS[128:] = 3, 4, 5, 6
_CLASS[list(_MARKS)] = 8 + np.arange(len(_MARKS))
N_CLASS = 8 + len(_MARKS)
N_PAIR = 9
LAGS = (1, 2, 3, 5, 8, 13, 21, 34)


def features(column: pa.Array) -> np.ndarray:
    """One row for each text: shares of byte classes and of pairs of coarse classes, word lengths, repetition of words at
    several lags, distinct words and lines, sizes.  Empty texts give zeros."""
    data, offs = text_buffer(column)
    n, size = len(column), np.diff(offs)
    doc = np.repeat(np.arange(n), size)
    cls = _CLASS[data]
    share = np.bincount(doc * N_CLASS + cls, minlength=n * N_CLASS).reshape(n, N_CLASS) / np.maximum(size, 1)[:, None]
    coarse = np.minimum(cls, N_PAIR - 1)
    same = doc[1:] == doc[:-1]
    pair = np.bincount((doc[1:] * N_PAIR + coarse[:-1])[same] * N_PAIR + coarse[1:][same], minlength=n * N_PAIR ** 2).reshape(n, N_PAIR ** 2) / np.maximum(size, 1)[:, None]

    starts, stop, w_doc = word_spans(is_blank(data), offs)
    words = np.bincount(w_doc, minlength=n)
    per = np.maximum(words, 1)
    hashes = span_hashes(lower_ascii(data), starts, stop)
    length = stop - starts
    cols = [np.bincount(w_doc, length, minlength=n) / per, np.sqrt(np.bincount(w_doc, length ** 2.0, minlength=n) / per)]
    cols += [np.bincount(w_doc, (length >= a) & (length < b), minlength=n) / per for a, b in ((1, 3), (3, 6), (6, 10), (10, 16), (16, 1 << 30))]
    for lag in LAGS:
        again = (hashes[lag:] == hashes[:-lag]) & (w_doc[lag:] == w_doc[:-lag])
        cols.append(np.bincount(w_doc[lag:][again], minlength=n) / per)
    _, at = np.unique(mix(hashes ^ mix(w_doc.astype(np.uint64))), return_index=True)
    cols.append(np.bincount(w_doc[at], minlength=n) / per ** 0.75)
    lines = np.bincount(doc[data == 10], minlength=n) + 1
    cols += [np.log1p(size), np.log1p(words), np.log1p(lines), np.log1p(words / lines)]
    capital = (data[starts] >= 65) & (data[starts] <= 90)
    cols.append(np.bincount(w_doc, capital, minlength=n) / per)
    return np.hstack([np.sqrt(share), np.sqrt(pair), np.stack(cols, 1)]).astype(np.float32)


@dataclass
class Network:
    """One hidden layer on standardised features."""
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    @staticmethod
    def start(x: np.ndarray, hidden: int, rng: np.random.Generator) -> Network:
        mean, scale = x.mean(0), x.std(0) + 1e-3
        return Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)).astype(np.float32), np.zeros(hidden, np.float32),
                       rng.normal(0, 1 / np.sqrt(hidden), hidden).astype(np.float32), 0.0)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.standard(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(float), -30, 30)))

    def train(self, xp: np.ndarray, xu: np.ndarray, outer, epochs: int, rng: np.random.Generator, rate: float = 2e-3, decay: float = 1e-4) -> Network:
        """Adam on mini-batches; `outer(gp, gu)` gives the risk's derivatives at the margins of both sides."""
        xp, xu = self.standard(xp), self.standard(xu)
        names, first, second, t = ("w1", "b1", "w2", "b2"), {}, {}, 0
        for epoch in range(epochs):
            order_p, order_u = rng.permutation(len(xp)), rng.permutation(len(xu))
            steps = max(1, len(xu) // 256)
            for bp, bu in zip(np.array_split(order_p, steps), np.array_split(order_u, steps)):
                x = np.vstack([xp[bp], xu[bu]])
                h = np.maximum(x @ self.w1 + self.b1, 0)
                g = h @ self.w2 + self.b2
                d = np.concatenate(outer(g[:len(bp)], g[len(bp):])).astype(np.float32)
                back = np.outer(d, self.w2) * (h > 0)
                grads = {"w1": x.T @ back + decay * self.w1, "b1": back.sum(0), "w2": h.T @ d + decay * self.w2, "b2": d.sum()}
                t += 1
                for k in names:
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * grads[k]
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * grads[k] ** 2
                    setattr(self, k, getattr(self, k) - rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8))
        return self


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def non_negative_risk(prior: float):
    """Derivatives of the non-negative risk with logistic loss: loss(+) has slope p - 1, loss(-) slope p."""
    def outer(gp, gu):
        pp, pu = _sigmoid(gp), _sigmoid(gu)
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        dn_p, dn_u = -prior * pp / len(gp), pu / len(gu)
        if rest < 0:
            return -dn_p, -dn_u
        return prior * (pp - 1) / len(gp) + dn_p, dn_u
    return outer


def best_bin_prior(sp: np.ndarray, su: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among scores `su`, given scores `sp` of held-out positives."""
    cuts = np.sort(sp)[::-1]
    qp = np.arange(1, len(sp) + 1) / len(sp)
    qu = 1 - np.searchsorted(np.sort(su), cuts, "left") / len(su)
    margin = np.sqrt(np.log(4 / delta) / 2 / len(su)) + np.sqrt(np.log(4 / delta) / 2 / len(sp))
    return float(np.clip((qu / qp)[np.argmin((qu + margin) / qp)], 0.01, 0.99))


def fit(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, seed: int = 7) -> tuple[Network | None, float]:
    """Network and prior.  Learns from at most `positive_rows` documents labelled 1 outside the held-out fold and about
    `unlabelled_rows` documents drawn by a hash of the id, whose labels are not looked at.  Without positives: (None, 0)."""
    bound_batches(docs.sparkSession)
    total = max(1, docs.count())
    pick = (labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 1)).select("doc_id").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(positive_rows).withColumn("p", F.lit(True)))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, unlabelled_rows / total) * (1 << 30))
    sample = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id", "left").withColumns({"p": F.coalesce("p", F.lit(False)), "u": F.coalesce(drawn, F.lit(False))}).where("p OR u")

    def run(batches):
        for b in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("p"), b.column("u"), pa.array(list(features(b.column("text"))), pa.list_(pa.float32()))], names=["p", "u", "x"])

    got = sample.select("text", "p", "u").mapInArrow(run, "p boolean, u boolean, x array<float>").toPandas()
    if not got["p"].any() or not got["u"].any():
        return None, 0.0
    x = np.stack(got["x"].to_numpy())
    xp, xu = x[got["p"].to_numpy(bool)], x[got["u"].to_numpy(bool)]
    rng = np.random.default_rng(seed)
    xp, xu = xp[np.lexsort(xp.T[:3])][rng.permutation(len(xp))], xu[np.lexsort(xu.T[:3])][rng.permutation(len(xu))]

    def versus(gp, gu):
        return (_sigmoid(gp) - 1) / len(gp), _sigmoid(gu) / len(gu)
    hp, hu = len(xp) // 2, len(xu) // 2
    if hp and hu:
        first = Network.start(xu, 16, rng).train(xp[:hp], xu[:hu], versus, 15, rng)
        prior = best_bin_prior(first.margin(xp[hp:]), first.margin(xu[hu:]))
    else:
        prior = 0.5
    return Network.start(xu, 32, rng).train(xp, xu, non_negative_risk(prior), 60, rng), prior


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """All columns of `docs` and score (0 to 1), over whole texts.

    Null and empty texts score as a text of no words; without a network (no positives) every score is 0.5.  Repeated rows
    are scored each; an existing column named score is replaced.
    """
    cast, docs = docs.sparkSession.sparkContext.broadcast(network), docs.drop("score")

    def run(batches):
        net = cast.value
        for b in chunks(batches, "text"):
            s = np.full(b.num_rows, 0.5) if net is None else net.score(features(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.astype(float))], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", score double")
