"""Quality classifier by co-training.

Two views of a document, its text content and its page metadata, each have a logistic classifier. Over rounds, each names
the unlabelled documents of which it is sure, and the other learns from them. Both are calibrated on labels kept aside and
combined there. "quality" and "toxic" are learned apart; a document is rejected when either says so.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, packed

META = 256  # hashed categories of the metadata view; binned numbers follow
BINS = 12
_LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_DIGITS = b"0123456789"
_BLANKS = b" \t\r\n"
_END = b".,;:'\"()-"


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))  # of 32 bits, so few of the chosen ones are hit by chance


def word_features(word: str) -> list[int]:
    """Hashed features of one lower-cased word: itself without marks at its ends, its prefixes, how it ends."""
    core = word.strip(".,;:!?\"'()")
    out = [_hash("w:" + core), _hash("e:" + word[-3:])]
    out += [_hash(f"p{n}:{core[:n]}") for n in (4, 5, 6) if len(core) > n]
    return out


def meta_numbers(text: str, words: list[str], kinds: int) -> list[float]:
    """Layout figures of a page: length, lines, and what its characters and words are made of."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    letters, digits, blanks = (size - len(raw.translate(None, c)) for c in (_LETTERS, _DIGITS, _BLANKS))
    marks = size - len(raw.translate(None, _END))
    lines = raw.count(b"\n") + 1
    n = max(1, len(words))
    return [len(text), lines, len(text) / lines, letters / size, digits / size, marks / size, (size - letters - digits - blanks - marks) / size, len(text) / n, kinds / n, n]


class Featurizer:
    """Feature ids of documents; a bounded cache by word. ``chosen`` limits the content features to a dictionary of ids."""

    def __init__(self, chosen: dict[int, int] | None = None, room: int = 300_000):
        self.chosen, self.room = chosen, room
        self.cache: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        found = word_features(word)
        if self.chosen is not None:
            found = [self.chosen[f] for f in found if f in self.chosen]
        if len(self.cache) >= self.room:
            self.cache.clear()
        self.cache[word] = out = tuple(found)
        return out

    def __call__(self, text: str | None, lang: str | None, source: str | None) -> tuple[list[int], list[int], list[float]]:
        """Content features, metadata categories, metadata numbers."""
        text = text or ""
        words = text.lower().split()
        kinds = set(words)
        get, slow, found = self.cache.get, self._word, set()
        for w in kinds:
            f = get(w)
            if f is None:
                f = slow(w)
            if f:
                found.update(f)
        tags = [zlib.crc32(f"{k}={v}".encode("utf-8", "surrogatepass")) % META for k, v in (("lang", lang), ("source", source))]
        return sorted(found), tags, meta_numbers(text, words, len(kinds))


class Sparse:
    """Binary feature rows."""

    def __init__(self, rows: list, width: int):
        self.lens = np.array([len(r) for r in rows], np.int64)
        self.cols = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(rows) and self.lens.sum() else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.lens)
        self.width, self.n = width, len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.cols], self.n)

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, r[self.row], self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by accelerated gradient descent, each feature scaled by its curvature."""
    scale = 1 / (0.25 * x.t_dot(weight) + l2)
    total = max(1e-9, weight.sum())
    rate = np.clip((weight * y).sum() / total, 1e-6, 1 - 1e-6)
    w, b = np.zeros(x.width), float(np.log(rate / (1 - rate)))
    mean_len = max(1.0, x.lens.mean() if x.n else 1.0)
    w0, b0, vw, vb, t = w, b, w, b, 1.0
    for _ in range(steps):
        r = weight * (_sigmoid(x.dot(vw) + vb) - y)
        w, b = vw - scale / mean_len**0.5 * (x.t_dot(r) + l2 * vw), vb - r.sum() / (0.25 * total) / mean_len**0.5
        t1 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if (r @ (x.dot(w - w0) + (b - b0))) > 0:  # restart when momentum goes uphill
            t1 = 1.0
        vw, vb = w + (t - 1) / t1 * (w - w0), b + (t - 1) / t1 * (b - b0)
        w0, b0, t = w, b, t1
    return w, b


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """A few Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + l2 * w)
    return w


def choose_features(rows: list[np.ndarray], y: np.ndarray, most: int, least_docs: int, least_chi: float) -> np.ndarray:
    """The ``most`` content features with the largest chi-square against ``y``, sorted by id, of those in ``least_docs`` rows
    or more. ``least_chi`` is high, as among so many features some look good by chance; and what is far weaker than the best
    is left out, as long texts gather weak features."""
    n, rate = len(rows), y.mean()
    ids, df = np.unique(np.concatenate(rows), return_counts=True)
    usable = (df >= least_docs) & (df <= 0.9 * n)
    ids, df = ids[usable], df[usable]
    own, counts = np.unique(np.concatenate([r for r, bad in zip(rows, y) if bad]), return_counts=True)
    if not len(own) or not len(ids):
        return ids[:0]
    at = np.minimum(np.searchsorted(own, ids), len(own) - 1)
    pos = np.where(own[at] == ids, counts[at], 0)
    expected = df * rate
    chi = (pos - expected) ** 2 / np.maximum(expected * (1 - rate) * (1 - df / n), 1e-9)
    top = np.argsort(-chi, kind="stable")[:most]
    return np.sort(ids[top[chi[top] > max(least_chi, 0.03 * chi.max())]])


def _places(ids: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Where the ids that were chosen stand among the chosen."""
    if not len(chosen):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(chosen, ids), len(chosen) - 1)
    return at[chosen[at] == ids]


def cotrain_target(content: tuple[Sparse, Sparse, Sparse], meta: tuple[Sparse, Sparse, Sparse], y: np.ndarray, y_kept: np.ndarray, rounds: int, sure: float, per_round: int) -> dict:
    """Weights of both views and of their combination. Each view comes as (training, kept aside, unlabelled) rows."""
    views = [content, meta]
    extra: list[dict[int, float]] = [{}, {}]
    model: dict = {}
    for turn in range(rounds + 1):
        fitted = []
        for v, (train, kept, pool) in enumerate(views):
            own = sorted(extra[v])
            picked = np.zeros(pool.n, bool)
            picked[own] = True
            mask = picked[pool.row]
            both = Sparse([], train.width)
            renumber = np.cumsum(picked) - 1
            both.cols, both.row = np.concatenate([train.cols, pool.cols[mask]]), np.concatenate([train.row, train.n + renumber[pool.row[mask]]])
            both.n, both.lens = train.n + len(own), np.concatenate([train.lens, pool.lens[own]])
            target = np.concatenate([y, [extra[v][i] for i in own]])
            weight = np.concatenate([np.ones(train.n), np.full(len(own), 0.5)])
            w, b = fit_logistic(both, target, weight, (0.3, 1.0)[v])
            platt = fit_dense((kept.dot(w) + b)[:, None], y_kept, 0.01)
            fitted.append((w, b, platt))
        model = {"views": fitted}
        if turn == rounds:
            break
        for v, (w, b, platt) in enumerate(fitted):
            p = _sigmoid((views[v][2].dot(w) + b) * platt[0] + platt[1])
            other = extra[1 - v]
            for sign, value in ((-p, 1.0), (p, 0.0)):
                order = np.argsort(sign, kind="stable")
                certain = [i for i in order[: per_round * 4] if (p[i] >= sure if value else p[i] <= 1 - sure) and i not in other]
                other.update((int(i), value) for i in certain[:per_round])
    logits = np.column_stack([(views[v][1].dot(w) + b) * q[0] + q[1] for v, (w, b, q) in enumerate(model["views"])])
    model["mix"] = fit_dense(logits, y_kept, 0.1)
    return model


def _combined(model: dict, scores: list[np.ndarray]) -> np.ndarray:
    logits = [s * q[0] + q[1] for s, (_, _, q) in zip(scores, model["views"])]
    return _sigmoid(np.column_stack(logits) @ model["mix"][:-1] + model["mix"][-1])


def sample_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, meta_cols: tuple[str, str], max_labelled: int, max_pool: int) -> tuple[list, list]:
    """Feature rows of a bounded sample: labelled ones (with quality and toxic) and unlabelled ones.

    The rows with the least hashes of their ids are taken, up to ``max_labelled`` and ``max_pool``; only fitting uses them.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__q"), F.max("toxic").alias("__t"))
    rows = docs.select(named(id_col).alias("__id"), named(text_col).alias("__text"), *(named(c).cast("string").alias(f"__m{i}") for i, c in enumerate(meta_cols)))
    ids = rows.select("__id").where("__id is not null").distinct().join(known, "__id", "left").withColumn("__h", F.xxhash64("__id"))
    has = F.col("__q").isNotNull() & F.col("__t").isNotNull()
    few = ids.where(has).orderBy("__h", "__id").limit(max_labelled).unionByName(ids.where(~has).orderBy("__h", "__id").limit(max_pool))
    picked = {r[0]: (r[1], r[2]) for r in few.select("__id", "__q", "__t").collect()}  # at most max_labelled + max_pool
    if not picked:
        return [], []
    spark = docs.sparkSession
    small = spark.createDataFrame([(i,) for i in picked], "__id " + dict(rows.dtypes)["__id"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Featurizer()
        for batch in batches:
            out = [own(*(c[i].as_py() for c in batch.columns[1:])) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([np.array(o[0], np.uint32).tobytes() for o in out], pa.binary()), pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.list_(pa.float64()))],
                ["id", "content", "tags", "numbers"])

    kind = dict(rows.dtypes)["__id"]
    got = rows.join(F.broadcast(small), "__id").dropDuplicates(["__id"]).mapInArrow(features, f"id {kind}, content binary, tags array<int>, numbers array<double>")
    labelled, pool = [], []
    for r in got.toLocalIterator():
        q, t = picked[r.id]
        row = (r.id, np.frombuffer(bytes(r.content), np.uint32), r.tags, r.numbers)
        (pool if q is None or t is None else labelled).append((*row, q, t))
    labelled.sort(key=lambda r: r[0])
    pool.sort(key=lambda r: r[0])
    return labelled, pool


def fit(labelled: list, pool: list, rounds: int = 3, sure: float = 0.98, per_round: int = 400, most_features: int = 4000, least_docs: int = 4, least_chi: float = 25.0) -> dict:
    """A model of both targets from the rows of :func:`sample_features`."""
    model: dict = {"edges": None, "targets": {}}
    if len(labelled) < 8:
        return model
    aside = np.arange(len(labelled)) % 4 == 3
    train, kept = [r for r, a in zip(labelled, aside) if not a], [r for r, a in zip(labelled, aside) if a]
    numbers = np.array([r[3] for r in train])
    model["edges"] = np.quantile(numbers, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    meta = [Sparse([meta_row(r[2], r[3], model["edges"]) for r in part], META + len(model["edges"]) * BINS) for part in (train, kept, pool)]
    for name, at, bad in (("quality", 4, 0), ("toxic", 5, 1)):
        y, y_kept = (np.array([float(r[at] == bad) for r in part]) for part in (train, kept))
        if not 0 < y.mean() < 1:
            model["targets"][name] = {"rate": float(y.mean())}
            continue
        chosen = choose_features([r[1] for r in train], y, most_features, least_docs, least_chi)
        content = [Sparse([_places(r[1], chosen) for r in part], len(chosen) + 1) for part in (train, kept, pool)]
        model["targets"][name] = {"chosen": chosen} | cotrain_target(tuple(content), tuple(meta), y, y_kept, rounds, sure, per_round)
    return model


def meta_row(tags: list[int], numbers: list[float], edges: np.ndarray) -> list[int]:
    return [*tags, *(META + i * BINS + int(np.searchsorted(e, x, side="right")) for i, (e, x) in enumerate(zip(edges, numbers)))]


class Scorer:
    """Probabilities of "bad quality" and "toxic" for documents."""

    def __init__(self, model: dict):
        self.model = model
        self.names = [n for n in ("quality", "toxic") if n in model["targets"]]
        ids = sorted({int(f) for n in self.names for f in model["targets"][n].get("chosen", ())})
        self.featurizer = Featurizer({f: i for i, f in enumerate(ids)})
        place = {f: i for i, f in enumerate(ids)}
        self.dense = {}
        for n in self.names:
            t = model["targets"][n]
            if "views" in t:
                w = np.zeros(len(ids) + 1)
                for k, f in enumerate(t["chosen"]):
                    w[place[int(f)]] = t["views"][0][0][k]
                self.dense[n] = w

    def __call__(self, text, lang, source) -> tuple[float, float]:
        content, tags, numbers = self.featurizer(text, lang, source)
        out = {"quality": 0.0, "toxic": 0.0}
        meta = meta_row(tags, numbers, self.model["edges"]) if self.model["edges"] is not None else []
        for n in self.names:
            t = self.model["targets"][n]
            if "views" not in t:
                out[n] = t["rate"]
                continue
            (_, b0, _), (w1, b1, _) = t["views"]
            scores = [np.array([self.dense[n][content].sum() + b0]), np.array([w1[meta].sum() + b1])]
            out[n] = float(_combined(t, scores)[0])
        return out["quality"], out["toxic"]


def fit_from_tables(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, str] = ("lang", "source"), max_labelled: int = 8000, max_pool: int = 4000, **how) -> dict:
    return fit(*sample_features(docs, labels, id_col, text_col, meta_cols, max_labelled, max_pool), **how)


def score_column(model: dict, session, text: Column, lang: Column, source: Column) -> Column:
    """struct(low_quality, toxic): probabilities for a document."""
    shared = session.sparkContext.broadcast(model)

    @F.arrow_udf("struct<low_quality:double,toxic:double>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts, langs, sources in batches:
            out = [scorer(t.as_py(), a.as_py(), s.as_py()) for t, a, s in zip(texts, langs, sources)]
            yield pa.StructArray.from_arrays([pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.float64())], ["low_quality", "toxic"])

    return of(text, lang.cast("string"), source.cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, str] = ("lang", "source"), threshold: float = 0.5, **how) -> DataFrame:
    """One row per document: ``id, low_quality, toxic`` (probabilities) and ``kept`` (both below ``threshold``).

    Fitting takes a sample of at most ``max_labelled`` labelled and ``max_pool`` other documents; scoring takes every
    document and its whole text, in place, without a shuffle. Null text: as empty. Null metadata: a category of its own.
    Labels that are null, or of unknown documents, aren't used; of repeated ones the worse holds. With fewer than eight
    labelled documents nothing is rejected; with one class only, its rate is the score. An empty table gives no rows.
    """
    model = fit_from_tables(docs, labels, id_col, text_col, meta_cols, **how)
    score = score_column(model, docs.sparkSession, named(text_col), *(named(c) for c in meta_cols))
    rows = docs.select(named(id_col).alias("id"), score.alias("s"))
    return rows.select("id", "s.low_quality", "s.toxic", ((F.col("s.low_quality") < threshold) & (F.col("s.toxic") < threshold)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, str] = ("lang", "source"), threshold: float = 0.5, **how) -> DataFrame:
    """``docs`` without those that :func:`score_documents` rejects."""
    model = fit_from_tables(docs, labels, id_col, text_col, meta_cols, **how)
    scored = packed(docs, score=score_column(model, docs.sparkSession, named(text_col), *(named(c) for c in meta_cols)))
    return scored.where((F.col("score.low_quality") < threshold) & (F.col("score.toxic") < threshold)).select("row.*")
