"""Quality classifier: ordinal cumulative-link (logistic) regression on graded ratings.

One weight for each hashed text feature, shared by all grades, and ordered thresholds between the grades:
P(grade <= k) = sigmoid(threshold_k - score). The score's distribution over grades gives the expected grade and the tail
probability that a document has at least some grade, by which documents are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.llm import wordhash as wh
from ledgerwell.llm.shared import free_name, table_cut

FEATURE_BITS = 18
#: Bytes of a word that form its stems, which inflected forms share.
STEMS = (4, 5)
#: Labelled rows that a model is fitted on at most: those with the smallest hashes of their ids. Scoring has no bound.
FIT_ROWS = 12_000
#: Steps of the fit and its L2 penalty.
STEPS, PENALTY = 400, 1e-3
#: To get a weight, a feature must be in so many sampled documents, and their mean grade so many standard errors off: what
#: chance alone does to one feature of four hundred. The penalty holds those small.
LEAST_ROWS, LEAST_SCORE = 2, 3.0
#: Entries (a feature with a weight in a sampled row) that the fit takes at most, in the order of the sample: a second
#: bound on labelled rows, for very long texts. It bounds what the task that fits holds.
FIT_ENTRIES = 8_000_000
#: With fewer labelled documents, or all of one grade, nothing is rejected.
LEAST_LABELS = 40

#: Byte classes: 0 separates, 1 letters and digits (and all of UTF-8 beyond ASCII), 2 marks.
_CLASSES = np.ones(256, np.uint8)
_CLASSES[:33] = 0
_CLASSES[33:48] = _CLASSES[58:65] = _CLASSES[91:97] = _CLASSES[123:128] = 2


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    rows: int
    grades: int = 0


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct feature numbers of each text: words without marks, their stems, runs of marks, shares of capitals, marks, repeats.

    Feature 0 is always there (an empty text has nothing else). Texts are worked on in portions of at most wordhash.BLOCK
    bytes (or one text), as the arrays over a portion take many times its bytes.
    """
    at = 0
    while at < len(offsets) - 1:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + wh.BLOCK, "right")) - 1)
        yield from _features(data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at])
        at = upto


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    hashes, kind, counts = wh.runs(data, offsets, _CLASSES, (None, *STEMS))
    mask = np.uint64((1 << FEATURE_BITS) - 1)
    numbers = np.stack([((h + np.uint64(i) * np.uint64(0x5BD1E995)) & mask).astype(np.int32) for i, h in enumerate(hashes)])
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    caps = (upper[offsets[1:]] - upper[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
    same = np.concatenate((numbers[0, 1:] == numbers[0, :-1], [False])) if len(kind) else np.zeros(0, bool)
    at = 0
    for c, capital in zip(counts.tolist(), caps.tolist(), strict=True):
        mine, marks = numbers[:, at : at + c], int((kind[at : at + c] == 2).sum())
        n = max(1, c - marks)
        found = np.unique(mine)
        shares = (capital, marks / n / 2, 1 - len(found) / max(1, mine.size), int(same[at : at + c - 1].sum()) / n if c else 0.0)
        yield np.concatenate((found[found >= 65], [0], [1 + 16 * k + min(15, int(16 * s)) for k, s in enumerate(shares)])).astype(np.int32)
        at += c


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """Fit by Adam on the mean negative log likelihood; each feature of `rows` gets a weight. Without rows every grade is as likely as another."""
    size = 1 << FEATURE_BITS
    cuts0 = np.arange(1, n_grades) / n_grades
    b = np.log(cuts0 / (1 - cuts0))
    if not len(rows):
        return Model(np.zeros(size, np.float32), b, 0)
    share = np.clip([(grades <= k).mean() for k in range(n_grades - 1)], 1e-3, 1 - 1e-3)
    b = np.log(share / (1 - share))
    # entries by row and by feature, both as narrow as they can be: these arrays are most of the driver's memory
    used = np.unique(np.concatenate([np.zeros(0, np.int32), *(np.unique(np.concatenate(rows[i : i + 256])) for i in range(0, len(rows), 256))]))
    filled = np.flatnonzero([len(r) for r in rows])
    of_row = np.cumsum([0, *(len(rows[i]) for i in filled)])
    features_ = np.concatenate([np.searchsorted(used, rows[i]).astype(np.int32) for i in filled] or [np.zeros(0, np.int32)])
    order = np.argsort(features_, kind="stable").astype(np.int32)
    rows_ = (np.searchsorted(of_row, order, "right") - 1).astype(np.int32)
    of_feature = np.concatenate(([0], np.cumsum(np.bincount(features_, minlength=len(used)))[:-1])).astype(np.int64)
    del order
    theta = np.zeros(len(used) + n_grades - 1)
    theta[len(used)] = b[0]
    theta[len(used) + 1 :] = np.log(np.maximum(np.diff(b), 1e-2))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    inf = 30.0
    for t in range(1, steps + 1):
        w, gaps = theta[: len(used)], np.exp(theta[len(used) + 1 :])
        cuts = theta[len(used)] + np.concatenate(([0], np.cumsum(gaps)))
        score = np.zeros(len(rows))
        if len(used):
            score[filled] = np.add.reduceat(w[features_], of_row[:-1])
        up = np.where(grades < n_grades - 1, np.append(cuts, inf)[grades] - score, inf)
        low = np.where(grades > 0, np.append(-inf, cuts)[grades] - score, -inf)
        su, sl = sigmoid(up), sigmoid(low)
        p = np.maximum(su - sl, 1e-9)
        du, dl = su * (1 - su) * (grades < n_grades - 1) / p, sl * (1 - sl) * (grades > 0) / p
        g_score = (du - dl) / len(rows)
        g_cut = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            g_cut[k] = (-du[grades == k].sum() + dl[grades == k + 1].sum()) / len(rows)
        grad = np.empty_like(theta)
        if len(used):
            grad[: len(used)] = np.add.reduceat(g_score[filled][rows_], of_feature) + penalty * w
        grad[len(used)] = g_cut.sum()
        grad[len(used) + 1 :] = np.cumsum(g_cut[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = theta[: len(used)]
    return Model(weights, theta[len(used)] + np.concatenate(([0], np.cumsum(np.exp(theta[len(used) + 1 :])))), len(rows), len(np.unique(grades)))


def train(docs: DataFrame, grades: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", n_grades: int = 3, bound: int = FIT_ROWS) -> Model:
    """Fit on at most `bound` labelled documents. Rows without id, text or a grade within 0 .. n_grades - 1 are left out.

    The sample is made in Spark (smallest id hashes, so a rerun takes the same rows; of rows that repeat an id, one by the
    hash of its features) and stored. Features are counted in Spark too; one task fits the bounded sample.
    """
    g = grades.select(F.col(f"`{doc_id}`").alias("g_id"), F.col(f"`{grade}`").cast("int").alias("grade")).filter(F.col("grade").between(0, n_grades - 1) & F.col("g_id").isNotNull())
    picked = g.groupBy("g_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("g_id"), "g_id").limit(bound)
    sample = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(picked), F.col("id") == F.col("g_id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(list(features(*wh.text_bytes(batch.column(0)))), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([found, batch.column(1), batch.column(2)], names=["f", "grade", "id"])

    rows = sample.select("text", "grade", "id").mapInArrow(extract, "f array<int>, grade int, id long")
    rows = table_cut(rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("f").alias("h"), "f", "grade")).alias("r")).select("id", "r.f", "r.grade"), "fit-rows")
    told = told_features(rows)

    def reduce_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, every = np.asarray(batch.column(0).offsets), batch.column(0).values.to_numpy()
            kept = [x[np.isin(x, told)] for x in (every[a:b] for a, b in zip(at[:-1], at[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in kept], pa.binary()), batch.column(1), batch.column(2)], names=["f", "grade", "id"])

    reduced = rows.select("f", "grade", "id").mapInArrow(reduce_to, "f binary, grade int, id long")
    so_far = F.sum(F.octet_length("f")).over(Window.orderBy(F.xxhash64("id"), "id"))  # at most `bound` rows, in one task
    found = reduced.withColumn("so_far", so_far).filter(F.col("so_far") <= 4 * FIT_ENTRIES).select("f", "grade", "id")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pylist([], pa.schema([("f", pa.binary()), ("grade", pa.int32()), ("id", pa.int64())]))]).sort_by("id")
        m = fit([np.frombuffer(x, np.int32) for x in table["f"].to_pylist()], table["grade"].to_numpy().astype(np.int64), n_grades)
        yield pa.RecordBatch.from_pylist([{"weights": m.weights.tobytes(), "thresholds": m.thresholds.tolist(), "rows": m.rows, "grades": m.grades}])

    # the sample is bounded, so one task fits the model, and the driver gets nothing but the weights
    done = found.mapInArrow(fitted, "weights binary, thresholds array<double>, rows long, grades long").collect()
    if not done:
        return fit([], np.zeros(0, np.int64), n_grades)
    return Model(np.frombuffer(done[0]["weights"], np.float32), np.array(done[0]["thresholds"]), done[0]["rows"], done[0]["grades"])


def told_features(rows: DataFrame) -> np.ndarray:
    """The features of (f, grade) that tell the grade: by their rows' number and mean grade, both summed up in Spark."""
    mean, spread = rows.agg(F.avg("grade"), F.coalesce(F.stddev_pop("grade"), F.lit(0.0))).first()
    if mean is None:
        return np.zeros(0, np.int32)
    sums = rows.select(F.explode("f").alias("feature"), (F.col("grade") - mean).alias("off")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("off").alias("off"))
    off = F.abs(F.col("off")) / F.sqrt("n") / max(spread, 1e-9)
    told = sums.filter((F.col("n") >= LEAST_ROWS) & (off >= LEAST_SCORE)).select("feature").toArrow()  # at most 2 ** FEATURE_BITS numbers
    return np.sort(told["feature"].to_numpy().astype(np.int32))


def score(docs: DataFrame, model: Model, text: str = "text", tail: int | None = None) -> DataFrame:
    """docs with expected_grade and tail_probability (of grade `tail` or more; the top grade if not given).

    Every row is scored over its whole text; a null text counts as an empty one. Input columns of these names are
    replaced. The model (a fixed number of weights) is broadcast.
    """
    keep = [c for c in docs.columns if c.lower() not in ("expected_grade", "tail_probability")]
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    k = len(model.thresholds) if tail is None else tail

    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, cuts = sent.value
        for texts in column:
            s = np.array([w[f].sum(dtype=np.float64) for f in features(*wh.text_bytes(texts))]).reshape(-1)
            below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - s[:, None], -50, 50)))
            yield pa.StructArray.from_arrays([pa.array((1 - below).sum(axis=1)), pa.array(1 - below[:, k - 1] if k > 0 else np.ones(len(s)))], names=["expected_grade", "tail_probability"])

    marked = F.arrow_udf(run, "expected_grade double, tail_probability double") if hasattr(F, "arrow_udf") else None
    out = free_name(docs, "scored")
    if marked is None:
        raise RuntimeError("this operator needs Arrow UDFs")
    return docs.select(*[F.col(f"`{c}`") for c in keep], marked(F.col(f"`{text}`")).alias(out)).select(*[F.col(f"`{c}`") for c in keep], f"{out}.expected_grade", f"{out}.tail_probability")


def select_good(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """docs with expected_grade, tail_probability and `kept`.

    The grade is quality + (1 - toxic), 0 to 2: 2 is good and clean text. A document is kept if its probability of
    grade 2 is `at_least`. A document with a label is judged by the model like every other. With fewer than LEAST_LABELS
    labelled documents, or with labels of one grade only, too little is known of the grades, and all documents are kept.
    """
    graded = labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    model = train(docs, graded)
    return score(docs, model).withColumn("kept", F.col("tail_probability") >= at_least if model.rows >= LEAST_LABELS and model.grades > 1 else F.lit(True))
