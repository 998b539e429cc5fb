"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import textarrays as ta
from threadloom.llm.common import case_safe, hashed_sample, materialize, sliced, table

#: Labelled documents that the field is fitted on, at most: those with the smallest hashes of doc_id. Their lines are
#: cut into chains of PART lines; of more than LINES lines in all, the chains with the smallest hashes are taken.
SAMPLE, LINES, PART = 4000, 200_000, 64
#: Chains that are swept together.
SWEPT = 2048
ROUNDS, RATE, RIDGE = 150, 0.1, 1e-4

OWN = 19
#: Of a line's own features, those also seen by its neighbours.
SHARED = (1, 2, 3, 4, 6, 7, 9, 10, 11, 12, 13)
WIDTH = OWN + 2 * len(SHARED) + 2


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, characters, features) of each line with a word, in order; whole texts, any length."""
    t = ta.Texts(texts)
    n_words = len(t.word_starts)
    if not n_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WIDTH), np.float32)
    feeds = np.flatnonzero(t.codes == 10)
    word_line = np.searchsorted(feeds, t.word_starts)
    first = np.flatnonzero(np.diff(word_line, prepend=-1))  # the first word of each line that has one
    words = np.diff(np.concatenate((first, [n_words])))
    start, end = t.word_starts[first], t.word_ends[np.concatenate((first[1:], [n_words])) - 1]
    text, size = t.word_text[first], end - start
    sums = {}
    for bit in (ta.LETTER, ta.UPPER, ta.DIGIT, ta.SPACE, ta.PUNCTUATION, ta.SYMBOL):
        total = np.concatenate(([0], np.cumsum((t.classes & bit) != 0)))
        sums[bit] = total[end] - total[start]
        if bit == ta.LETTER:
            letters_of = total[t.word_ends] - total[t.word_starts]
        elif bit == ta.DIGIT:
            digits_of = total[t.word_ends] - total[t.word_starts]
    per_line = lambda flags: np.add.reduceat(flags.astype(np.float64), first)
    h = t.word_hashes(lower=True)
    same_line = np.concatenate(([False], word_line[1:] == word_line[:-1]))
    again = same_line & np.concatenate(([False], h[1:] == h[:-1]))
    line = np.repeat(np.arange(len(first)), words)
    order = np.lexsort((h, line))
    fresh = np.ones(n_words, bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.add.reduceat(fresh.astype(np.float64), first)  # lexsort keeps lines in order
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(ta.mix(h + (np.arange(n_words) - np.repeat(first, words)).astype(np.uint64) * ta.GOLDEN), first)
    order = np.lexsort((np.arange(len(first)), whole, text))
    seen = np.zeros(len(first), bool)
    seen[order[1:]] = (whole[order][1:] == whole[order][:-1]) & (text[order][1:] == text[order][:-1])
    letters = np.maximum(sums[ta.LETTER], 1)
    symbols, upper = sums[ta.SYMBOL] / size, sums[ta.UPPER] / letters
    repeated, bare = per_line(again) / words, per_line((letters_of == 0) & (digits_of == 0)) / words
    bangs = np.concatenate(([0], np.cumsum(t.codes == ord("!"))))
    bangs = (bangs[end] - bangs[start]) / words
    stale = 1 - distinct / words
    last, begin = t.codes[end - 1], t.classes[start]
    own = np.stack(
        [
            np.ones(len(first)), np.minimum(1, 5 * symbols), symbols > 0.02, upper > 0.5, np.minimum(1, bangs), np.minimum(1, 5 * sums[ta.DIGIT] / size),
            np.minimum(1, 2 * repeated), repeated > 0.1, sums[ta.PUNCTUATION] / size, np.minimum(1, 3 * bare), bare > 0.1, stale, stale > 0.5, seen,
            np.minimum(1, np.log1p(words) / 6), np.isin(last, [ord(c) for c in ".?!"]), (begin & ta.UPPER) != 0,
            np.minimum(1.5, letters / words / 10), per_line((letters_of > 0) & (letters_of <= 3)) / words,
        ], 1,
    ).astype(np.float32)
    shared = own[:, SHARED]
    joined = np.concatenate(([False], text[1:] == text[:-1]))[:, None]
    before, after = np.zeros_like(shared), np.zeros_like(shared)
    before[1:], after[:-1] = shared[:-1], shared[1:]
    following = np.concatenate((joined[1:], [[False]]))
    return text, size, np.concatenate((own, before * joined, after * following, ~joined, ~following), 1).astype(np.float32)


def marginals(odds: list[float], stay: tuple[float, float, float, float]) -> list[float]:
    """P(good) of each line of one text by forward-backward. odds: exp of each line's score for good over bad;
    stay: potentials of (bad, bad), (bad, good), (good, bad), (good, good)."""
    bb, bg, gb, gg = stay
    ahead, b, g = [], 1.0, 1.0
    for i, o in enumerate(odds):
        if i:
            b, g = b * bb + g * gb, b * bg + g * gg
        g *= o
        total = b + g
        b, g = b / total, g / total
        ahead.append((b, g))
    out, b, g = [0.0] * len(odds), 1.0, 1.0
    for i in range(len(odds) - 1, -1, -1):
        fb, fg = ahead[i]
        good, bad = fg * g, fb * b
        out[i] = good / (good + bad)
        o = odds[i]
        b, g = bb * b + bg * o * g, gb * b + gg * o * g
        total = b + g
        b, g = b / total, g / total
    return out


def _sweep(score: np.ndarray, there: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded texts: P(good) of each line, and each text's expected transitions."""
    n, steps = score.shape
    e = np.ones((n, steps, 2))
    e[:, :, 1] = np.exp(score)
    a, m = np.empty((n, steps, 2)), np.exp(trans)
    for i in range(steps):
        now = e[:, i] if i == 0 else np.where(there[:, i, None], (a[:, i - 1] @ m) * e[:, i], a[:, i - 1])
        a[:, i] = now / now.sum(1, keepdims=True)
    b, pairs = np.ones((n, 2)), np.zeros((n, 2, 2))
    good = np.zeros((n, steps))
    for i in range(steps - 1, -1, -1):
        p = a[:, i] * b
        good[:, i] = p[:, 1] / p.sum(1)
        if i:
            eb = e[:, i] * b
            x = a[:, i - 1, :, None] * m[None] * eb[:, None]
            pairs += there[:, i, None, None] * x / x.sum((1, 2), keepdims=True)
            nb = eb @ m.T
            b = np.where(there[:, i, None], nb / nb.sum(1, keepdims=True), b)
    return good, pairs


def fit(parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> dict:
    """Fit weights, transitions and the calibration of a text's mean from chains of lines: (document, label, sizes, features).

    Every line carries its text's label; the likelihood's gradient comes from forward-backward, its ascent is Adam's.
    Chains of about one length are padded to the longest of their group, so that a long text costs what its lines do."""
    parts = [p for p in parts if len(p[2])]
    label, lines = {p[0]: p[1] for p in parts}, {}
    for p in parts:
        lines[p[0]] = lines.get(p[0], 0) + len(p[2])
    good = sum(label.values())
    if not parts or good in (0, len(label)):
        return {"weights": np.zeros(WIDTH), "trans": np.zeros((2, 2)), "scale": (0.0, 6.0 if good else 0.0), "empty": 0.99 if good else 0.5}
    order = sorted(range(len(parts)), key=lambda i: len(parts[i][2]))
    groups = []
    for at in range(0, len(order), SWEPT):
        some = [parts[i] for i in order[at : at + SWEPT]]
        steps = len(some[-1][2])
        x, there = np.zeros((len(some), steps, WIDTH), np.float32), np.zeros((len(some), steps), bool)
        for i, (_, _, sizes, f) in enumerate(some):
            x[i, : len(sizes)], there[i, : len(sizes)] = f, True
        y = np.array([p[1] for p in some])
        # a text counts once, however many chains it has; bad texts as much as good ones together
        w = np.where(y == 1, 0.5 / good, 0.5 / (len(label) - good)) / np.array([lines[p[0]] for p in some])
        groups.append((x, there, y, w))
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, ROUNDS + 1):
        grad = -RIDGE * theta
        for x, there, y, w in groups:
            p, pairs = _sweep(x @ theta[:WIDTH].astype(np.float32), there, theta[WIDTH:].reshape(2, 2))
            grad[:WIDTH] += np.einsum("ns,nsw->w", w[:, None] * (y[:, None] - p) * there, x)
            seen = np.zeros((len(y), 2, 2))
            seen[np.arange(len(y)), y, y] = there.sum(1) - 1
            grad[WIDTH:] += np.einsum("n,nab->ab", w, seen - pairs).ravel()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = {"weights": theta[:WIDTH], "trans": theta[WIDTH:].reshape(2, 2), "scale": (1.0, 0.0), "empty": good / len(label)}
    sums = {d: [0.0, 0.0] for d in label}
    for d, _, sizes, f in parts:
        sums[d][0] += document_mean(sizes, f, model) * sizes.sum()
        sums[d][1] += sizes.sum()
    raw = np.array([a / b for a, b in sums.values()])
    model["scale"] = calibrate(np.log(raw / (1 - raw)), np.array([label[d] for d in sums], float))
    return model


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from mean to label, by Newton's method with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * z).sum() - 0.1 * (a - 1), (y - p).sum()])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = max(0.05, a + da), b + db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def document_mean(sizes: np.ndarray, features: np.ndarray, model: dict) -> float:
    """The length-weighted mean of a text's marginals, kept off 0 and 1."""
    odds = np.exp(np.clip(features @ model["weights"], -30, 30)).tolist()
    p = marginals(odds, tuple(np.exp(np.clip(model["trans"], -10, 10)).ravel().tolist()))
    return float(np.clip(np.dot(p, sizes) / sizes.sum(), 1e-4, 1 - 1e-4))


def scores(texts: list[str], model: dict) -> list[float]:
    """The quality of each text, 0 to 1; a text without words has the share of good labels."""
    out = [float(model["empty"])] * len(texts)
    a, b = model["scale"]
    for lo, hi in ta.chunks(texts):
        text, size, features = line_features(texts[lo:hi])
        cuts = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            z = document_mean(size[s:e], features[s:e], model)
            out[lo + int(text[s])] = float(1 / (1 + np.exp(-(a * np.log(z / (1 - z)) + b))))
    return out


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")), F.lit(3)) == 1


def chains(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc, part, n, h, y, sizes, features) of at most `sample` labelled, not held-out documents: their lines in chains."""
    chosen = labels.where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    chosen = hashed_sample(chosen, sample, ["doc_id", "quality"])
    schema = pa.schema([("doc", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("h", pa.float64()), ("y", pa.int32()), ("sizes", pa.binary()), ("features", pa.binary())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids, texts, y = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()], b.column(2).to_pylist()
            for lo, hi in ta.chunks(texts):
                text, size, f = line_features(texts[lo:hi])
                cuts = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
                for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    i = lo + int(text[s])
                    with np.errstate(over="ignore"):
                        h = ta.mix(np.arange(-(-(e - s) // PART), dtype=np.uint64) * ta.PRIME + ta.mix(np.array([ids[i]], np.int64).view(np.uint64))).astype(np.float64) / 2.0**64
                    rows = [{"doc": ids[i], "part": k, "n": min(e, at + PART) - at, "h": float(h[k]), "y": y[i], "sizes": size[at : min(e, at + PART)].tobytes(), "features": f[at : min(e, at + PART)].astype(np.float16).tobytes()} for k, at in enumerate(range(s, e, PART))]
                    yield pa.RecordBatch.from_pylist(rows, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")  # bounded: `sample` rows
    return rows.mapInArrow(extract, "doc long, part int, n int, h double, y int, sizes binary, features binary")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> dict:
    """Fit on chains(); only their features reach the driver, of about `lines` lines at most, however long the documents."""
    held = materialize(chains(docs, labels, sample), "chains")
    total = held.agg(F.sum("n")).first()[0] or 0  # one number
    rows = (held if total <= lines else held.where(F.col("h") < lines / total)).collect()
    rows.sort(key=lambda r: (r.doc, r.part, r.sizes, r.features))
    return fit([(r.doc, r.y, np.frombuffer(r.sizes, np.int64), np.frombuffer(r.features, np.float16).reshape(-1, WIDTH).astype(np.float32)) for r in rows])


@case_safe()
def scored(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of `docs` (doc_id, text); null texts are empty. The text itself does not come back from Python.

    Each row is scored by itself: repeated rows score alike; an empty table gives no rows; other columns are ignored."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores([x or "" for x in b.column(1).to_pylist()], model), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


@case_safe(rows=True)
def keep(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows of `docs` (text, any others) that score `least` or more, with their columns, whatever their names."""
    at = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield b.filter(pa.array([s >= least for s in scores([x or "" for x in b.column(at).to_pylist()], model)], pa.bool_()))

    return docs.mapInArrow(good, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
