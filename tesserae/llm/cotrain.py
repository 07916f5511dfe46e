"""Quality classifier by co-training: a text view and a metadata view teach each other.

The text-content view sees the words (counts of words and word pairs, hashed into
``WORDS`` signed buckets) and what words and characters are like; the metadata
view what surrounds the text (language, source, sizes, line layout; sizes and
layout are measured on the text, so the views share no column but aren't
independent).  Each is a logistic regression.  A round scores every distinct text without a label by both
views; from each view the most confident new ones of each class, a ``SHARE`` of
all confident ones and ``PER_ROUND`` at least (ties come along), join the *other*
view's training rows.  After ``ROUNDS`` the
views are calibrated on held-out labelled rows (Platt) and combined by a
logistic regression of their calibrated log odds, and all documents are scored.

The driver holds about ``labelled`` labelled rows (those with the least hashes of
their ids; a documented bound and a parameter) of about 130 numbers: a threshold
on the hash is applied where the rows are, so no more are sent whatever the number
of partitions.  Rows that the views give each other stay distributed; a fit takes
sums over them, 27 kB a task and step from ``SUMS`` tasks at most, which get ``SUM_ROWS`` rows or more.  Texts are never
shuffled or written again: :func:`keep_good` makes features a second time where it scores.

Edge cases: a null text is an empty one; null metadata is a value of its own;
repeated labels of one id are averaged, a tie counts as no label; labels without
a document are ignored; without labels of both classes every document scores 1,
as nothing speaks against it; repeated rows get equal scores; ties of a score are
taken together; whole texts are read, however long; columns beside the named ones
pass through :func:`keep_good` untouched (``__t`` and ``__m`` are refused); an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, slices

LABELLED = 20_000
PER_ROUND = 400
SHARE = 0.02
ROUNDS = 3
HELD_OUT = 5  #: one labelled row in so many calibrates instead of trains
PSEUDO_WEIGHT = 0.3
SOURCES, LANGS = 32, 8  #: hash buckets of the metadata view
WORDS = 64  #: hash buckets of words and word pairs
SHAPES = 17
N_TEXT, N_META = SHAPES + WORDS, 10 + SOURCES + LANGS

SUMS = 1024  #: most tasks that send the driver a sum
SUM_ROWS = 2048  #: a task sums so many rows or more, as far as there are
FLAT = 1e-6  #: added to a column's deviation, so one without any has no say

_CUTS = re.compile(r"[.!?\n]+")


def word_features(words: list[str]) -> list[float]:
    """Signed counts of words and word pairs in lower case by hash bucket, scaled to length 1."""
    import numpy as np

    total = np.zeros(WORDS)
    for counted in (Counter(words), Counter(map(" ".join, pairwise(words)))):
        if counted:
            at = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in counted), "i8", len(counted))
            n = np.fromiter(counted.values(), "f8", len(counted))
            total += np.bincount(at % WORDS, np.where(at >> 16 & 1, n, -n), WORDS)
    return (total / (np.sqrt(total @ total) or 1.0)).tolist()


def text_features(text: str) -> list[float]:
    """The text-content view."""
    import numpy as np

    if not text:
        return [0.0] * (SHAPES - 1) + [1.0] + [0.0] * WORDS
    raw = text.encode("utf-8", "surrogatepass")
    h = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    n = max(1, len(raw) - int(h[32] + h[9:14].sum()))
    low, up, digits, high = int(h[97:123].sum()), int(h[65:91].sum()), int(h[48:58].sum()), int(h[128:].sum())
    stops = int(h[46] + h[44] + h[58] + h[59] + h[39] + h[45])
    symbols = n - low - up - digits - high - stops
    p = h[h > 0] / len(raw)
    words = text.split()
    k = max(1, len(words))
    parts = [x for x in _CUTS.split(text) if len(x) > 12]
    shouted = sum(map(str.isupper, words)) / k
    short = sum(len(w) < 4 for w in words) / k
    distinct = len(set(words))
    follows = len(set(pairwise(words))) / max(1, k - 1)
    return [
        up / n, shouted, symbols / n, math.sqrt(symbols / n), digits / n, int(h[33] + h[63]) / n, int(h[124]) / n, stops / n,
        float(-(p * np.log2(p)).sum()), n / k, short, distinct / k, math.log1p(distinct) / math.log1p(k), min(1.0, follows),
        len(set(parts)) / max(1, len(parts)), float(h.argmax() != 32), 0.0, *word_features(text.lower().split()),
    ]


def meta_features(text: str, lang: str | None, source: str | None) -> list[float]:
    """The metadata view: columns beside the text, sizes and layout."""
    lines = [len(x) for x in text.split("\n")]
    n = len(text)
    out = [math.log1p(n), math.log1p(n) ** 2 / 10, math.log1p(len(lines)), math.log1p(max(lines)), math.log1p(n / len(lines)), lines.count(0) / len(lines), sum(x < 30 for x in lines) / len(lines), float(lang is None), float(source is None), math.log1p(min(lines))]
    bucket = lambda x, k: [float(i == zlib.crc32((x or "").encode()) % k) for i in range(k)]
    return out + bucket(source, SOURCES) + bucket(lang, LANGS)


class Logistic:
    """Ridge logistic regression by Newton steps, on standardised columns."""

    def __init__(self, ridge: float = 1.0, near: Logistic | None = None):
        self.ridge, self.near = ridge, near  #: an earlier fit to start from

    def fit(self, x, y, w=None, more=None):
        """``more``: sums a function of ``x, y, w`` over further, distributed rows."""
        import numpy as np

        x, y = np.asarray(x, "f8"), np.asarray(y, "f8")
        w = np.ones(len(y)) if w is None else np.asarray(w, "f8")
        k = x.shape[1]
        total = lambda f: f(x, y, w) + (more(f) if more else 0.0)
        first = total(lambda x, y, w: np.append(w @ x, w.sum()))
        weight, mean = first[-1], first[:-1] / first[-1]
        scale = np.sqrt(total(lambda x, y, w: w @ (x - mean) ** 2) / weight) + FLAT
        self.mean, self.scale = mean, scale
        penalty = np.diag([self.ridge] * k + [1e-6])
        half = np.triu_indices(k + 1)

        def at(beta):
            def sums(x, y, w):
                z = np.column_stack((np.clip((x - mean) / scale, -8, 8), np.ones(len(y))))
                odds = z @ beta
                p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                loss = w @ (np.logaddexp(0, odds) - y * odds)
                return np.concatenate(((z.T @ (z * (w * p * (1 - p) + 1e-9)[:, None]))[half], z.T @ (w * (y - p)), [loss]))

            both = total(sums)
            bend = np.zeros((k + 1, k + 1))
            bend[half] = bend.T[half] = both[: -k - 2]
            return both[-1] + beta @ penalty @ beta / 2, bend + penalty, both[-k - 2 : -1] - penalty @ beta

        beta = np.zeros(k + 1)
        if self.near is not None:
            old, self.near = self.near, None
            beta[:-1] = np.where(old.scale > FLAT, old.beta[:-1] * scale / old.scale, 0)
            beta[-1] = old.beta[-1] + beta[:-1] @ ((mean - old.mean) / scale)
        loss, bend, slope = at(beta)
        for _ in range(25):  # Newton steps, halved while they lead up
            step = np.linalg.solve(bend, slope)
            for _ in range(20):
                new = at(beta + step)
                if new[0] <= loss:
                    break
                step /= 2
            else:
                break
            beta, gain = beta + step, loss - new[0]
            loss, bend, slope = new
            if gain < 1e-7 * (1 + loss):
                break
        self.beta = beta
        return self

    def margin(self, x):
        import numpy as np

        return np.clip((np.asarray(x, "f8") - self.mean) / self.scale, -8, 8) @ self.beta[:-1] + self.beta[-1]


class CoTrained:
    """Two views, their calibration and their combination."""

    def __init__(self, text: Logistic, meta: Logistic, calibrated: list[Logistic], both: Logistic, accuracy: float):
        self.text, self.meta, self.calibrated, self.both, self.accuracy = text, meta, calibrated, both, accuracy

    def score(self, t, m):
        """Probability of good quality, from rows of both views' features."""
        import numpy as np

        odds = np.column_stack([c.margin(v.margin(x)[:, None]) for c, v, x in zip(self.calibrated, (self.text, self.meta), (t, m), strict=True)])
        return 1 / (1 + np.exp(-np.clip(self.both.margin(odds), -30, 30)))


def _views(texts, langs, sources):
    texts = [t or "" for t in texts]
    return [text_features(t) for t in texts], [meta_features(t, a, b) for t, a, b in zip(texts, langs, sources, strict=True)]


def featurise(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, h, t, m``: both views' features and a hash of the text for ties."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))

    def run(batches):
        for b in slices(batches):
            t, m = _views(*(b.column(i).to_pylist() for i in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(t, pa.list_(pa.float32())), pa.array(m, pa.list_(pa.float32()))], names=["doc_id", "h", "t", "m"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h bigint, t array<float>, m array<float>")


def _matrix(column, width: int):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def distinct_pool(marked: DataFrame) -> DataFrame:
    """``h, t, m, y0, y1``: one row of each text without a label; ``y0`` and ``y1`` are what the views are given."""
    one = marked.where("y is null").groupBy("h").agg(F.min(F.struct("doc_id", "t", "m")).alias("r"))
    none = F.lit(None).cast("double")
    return cut(one.select("h", "r.t", "r.m", none.alias("y0"), none.alias("y1")))


def exchange(state: DataFrame, views: list[Logistic], per_round: int = PER_ROUND, share: float = SHARE) -> tuple[DataFrame, bool]:
    """``state`` after each view has labelled its most confident texts that the other one does not have yet; whether there were any."""
    text_view, meta_view = views

    def margins(batches):
        for b in batches:
            if b.num_rows:
                made = [pa.array(v.margin(_matrix(b.column(i), k))) for v, i, k in ((text_view, 1, N_TEXT), (meta_view, 2, N_META))]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=["h", "t", "m", "y0", "y1", "by0", "by1"])

    scored = cut(state.mapInArrow(margins, "h bigint, t array<float>, m array<float>, y0 double, y1 double, by0 double, by1 double"))
    cases = [(teacher, sign) for teacher in (0, 1) for sign in (1, -1)]
    sure = {(k, s): F.when((F.col(f"by{k}") * s > 1) & F.col(f"y{1 - k}").isNull(), F.col(f"by{k}") * s) for k, s in cases}
    n = scored.agg(*[F.count(sure[c]) for c in cases]).first()
    if not any(n):
        return state, False
    wanted = [max(per_round, round(share * k)) for k in n]
    from_ = scored.agg(*[F.percentile_approx(sure[c], max(0.0, 1 - w / max(1, k)), 10_000) for c, w, k in zip(cases, wanted, n, strict=True)]).first()
    picked = {c: sure[c] >= (1.0 if k <= w else at) for c, w, k, at in zip(cases, wanted, n, from_, strict=True) if k}
    given = lambda pupil: F.coalesce(f"y{pupil}", *[F.when(picked[c], F.lit(float(c[1] > 0))) for c in cases if c[0] == 1 - pupil and c in picked])
    return cut(scored.select("h", "t", "m", given(0).alias("y0"), given(1).alias("y1"))), True


def summing(state: DataFrame, side: int):
    """What sums a function of ``x, y, w`` over the rows that view ``side`` was given."""
    import numpy as np

    rows = cut(state.where(F.col(f"y{side}").isNotNull()).select("m" if side else "t", f"y{side}"))
    few = rows.coalesce(min(SUMS, 1 + rows.count() // SUM_ROWS))
    width = N_META if side else N_TEXT

    def more(f):
        def run(batches):
            parts = [f(_matrix(b.column(0), width).astype("f8"), y := b.column(1).to_numpy(), np.full(len(y), PSEUDO_WEIGHT)) for b in batches if b.num_rows]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([sum(parts).tobytes()], pa.binary())], names=["s"])

        return sum((np.frombuffer(r.s) for r in few.mapInArrow(run, "s binary").collect()), 0.0)

    return more


def labelled_rows(marked: DataFrame, most: int = LABELLED) -> pa.Table:
    """About ``most`` of the rows with a label, all if there are no more: those with the least hashes of ``doc_id, h``.

    The hash is compared with a threshold in each task, so the driver gets
    ``most`` rows give or take their square root, from however many partitions.
    """
    known = marked.where("y is not null").withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id", "h"), 1))
    n = known.count()
    if n > most:
        known = known.where(F.col("draw") < int((1 << 63) * most / n))
    return known.select("draw", "doc_id", "h", "t", "m", "y").toArrow().sort_by([("draw", "ascending"), ("doc_id", "ascending"), ("h", "ascending")]).combine_chunks()


def train(
    features: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND, share: float = SHARE
) -> CoTrained | None:
    """Co-train on ``features`` (of :func:`featurise`) and ``labels`` (an id and 0 or 1)."""
    import numpy as np

    mean = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.avg(label).alias("y"))
    marked = cut(features.join(mean.where("y <> 0.5").select("doc_id", (F.col("y") > 0.5).alias("y")), "doc_id", "left"))
    known = labelled_rows(marked, labelled)
    y = known["y"].to_numpy().astype("f8")
    if len(set(y)) < 2:
        return None
    t, m = _matrix(known["t"].combine_chunks(), N_TEXT), _matrix(known["m"].combine_chunks(), N_META)
    held = np.array([zlib.crc32(str(i).encode()) % HELD_OUT == 0 for i in known["doc_id"].to_pylist()])
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)  # too few to hold any back
    fit = ~held
    rows = [(t[fit], y[fit], np.ones(fit.sum())), (m[fit], y[fit], np.ones(fit.sum()))]
    views = [Logistic().fit(*r) for r in rows]
    state = distinct_pool(marked)
    for _ in range(rounds):
        state, grown = exchange(state, views, per_round, share)
        if not grown:
            break
        views = [Logistic(near=v).fit(*r, more=summing(state, side)) for side, (r, v) in enumerate(zip(rows, views, strict=True))]
    judge = held if held.any() else np.ones(len(y), bool)
    odds = [v.margin(x[judge])[:, None] for v, x in zip(views, (t, m), strict=True)]
    calibrated = [Logistic().fit(o, y[judge]) for o in odds]
    both = np.column_stack([c.margin(o) for c, o in zip(calibrated, odds, strict=True)])
    top = Logistic().fit(both, y[judge])
    return CoTrained(*views, calibrated, top, float(((top.margin(both) > 0) == (y[judge] > 0.5)).mean()))


def score_features(features: DataFrame, model: CoTrained | None) -> DataFrame:
    """``doc_id, score`` of every row of ``features``."""
    if model is None:
        return features.select("doc_id", F.lit(1.0).alias("score"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1), N_TEXT), _matrix(b.column(2), N_META)))], names=["doc_id", "score"])

    rows = features.select("doc_id", "t", "m")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id, score`` of every document."""
    features = cut(featurise(docs))
    return score_features(features, train(features, labels, label))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, untouched.

    Training works on narrow features; the rows are scored where they are read, by
    features made again.  So no copy of the texts lies on disk until the result,
    which is lazy, has been written.
    """
    if clash := {"__t", "__m"} & set(docs.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    features = cut(featurise(docs, text, lang, source))
    model = train(features, labels, label)
    if model is None:
        return docs
    at = [docs.columns.index(c) for c in (text, lang, source)]

    def run(batches):
        import numpy as np

        for b in slices(batches):
            t, m = _views(*(b.column(i).cast(pa.string()).to_pylist() for i in at))
            yield b.filter(pa.array(model.score(np.asarray(t, "f4"), np.asarray(m, "f4")) >= threshold))

    return docs.mapInArrow(run, docs.schema)
