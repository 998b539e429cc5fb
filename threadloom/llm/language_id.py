"""Language identification by bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import textarrays as ta
from threadloom.llm.common import case_safe, hashed_sample, materialize, sliced, small, table
from threadloom.llm.line_crf import held_out

#: Labelled documents a language that the filters are built from, at most: those with the smallest hashes of doc_id.
SAMPLE = 500
#: An n-gram enters a language's filter if at least this share of the language's sampled documents hold it.
SHARE = 0.02
#: Characters of an n-gram; slots of the filters (a power of two) and probes an n-gram; languages of a mask word.
N, SLOTS, PROBES, WORD = 3, 1 << 20, 3, 64


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, texts) of each n-gram, and whether each text has a letter.

    A text is its lower-case letters, each run of other characters one blank, with a blank at either end; an n-gram of
    three characters of 21 bits is its own exact 63-bit code."""
    t = ta.Texts(texts)
    letter = (t.classes & ta.LETTER) != 0
    codes = np.where(letter, ta.lower_table()[t.codes], 32).astype(np.uint64)
    text = np.repeat(np.arange(t.n), t.lengths + 1)
    # keep letters and the first of a run of others; a text's closing line feed is its last blank
    kept = letter | np.concatenate(([True], letter[:-1])) | np.concatenate(([True], text[1:] != text[:-1]))
    has = np.bincount(text[letter], minlength=t.n) > 0 if t.n else np.zeros(0, bool)
    codes, text, letter = codes[kept], text[kept], letter[kept]
    # a text that begins with a letter gets its blank from the one before, which is a blank too
    codes, text = np.concatenate((np.full(1, 32, np.uint64), codes)), np.concatenate(([0], text))
    middle = np.arange(1, max(1, len(codes) - 1))
    middle = middle[codes[middle] != 32]
    value = (codes[middle - 1] << np.uint64(42)) | (codes[middle] << np.uint64(21)) | codes[middle + 1]
    return value, text[middle], has


class Filters:
    """Bloom filters of up to any number of languages, sliced: a slot holds one bit a language."""

    def __init__(self, languages: list[str], members: list[np.ndarray]):
        self.languages = languages
        self.slots = np.zeros((max(1, -(-len(languages) // WORD)), SLOTS), np.uint64)
        for i, codes in enumerate(members):
            for slot in self.probe(codes):
                self.slots[i // WORD][slot] |= np.uint64(1 << i % WORD)
        #: chance that an n-gram outside a language's set passes its filter
        self.false = np.array([((self.slots[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean() ** PROBES for i in range(len(languages))])

    @staticmethod
    def probe(codes: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            h = ta.mix(codes * ta.GOLDEN)
        for i in range(PROBES):
            yield ((h >> np.uint64(20 * i)) & np.uint64(SLOTS - 1)).astype(np.int64)

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """Words of language bits: the languages that contain each n-gram, for all languages at once."""
        out = None
        for slot in self.probe(codes):
            found = self.slots[:, slot]
            out = found if out is None else out & found
        return out

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages): the share of a text's n-grams in a language, corrected for false positives; has a letter."""
        codes, text, has = grams(texts)
        masks, n = self.masks(codes), np.maximum(np.bincount(text, minlength=len(texts)), 1)
        hits = np.empty((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            bit = (masks[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)
            hits[:, i] = np.bincount(text[bit == 1], minlength=len(texts)) / n
        return np.clip((hits - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1), has


@case_safe()
def train(docs: DataFrame, sample: int = SAMPLE, share: float = SHARE) -> Filters:
    """Build filters from `docs` (doc_id, text, lang): not held out, lang known, at most `sample` documents a language.

    n-grams are counted on the executors; those that pass `share` reach the driver, at most a document's distinct
    n-grams over `share` for each language. No step deals a language to one task: samples are thinned by hash before
    they are ranked, and counts go by language and n-gram."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    chosen = hashed_sample(known.select("doc_id", "lang"), sample, ["doc_id"], "lang").distinct()
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")  # bounded: `sample` rows a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
        for b in sliced(batches):
            langs, texts = np.array(b.column(0).to_pylist(), object), [x or "" for x in b.column(1).to_pylist()]
            for lo, hi in ta.chunks(texts):
                codes, text, _ = grams(texts[lo:hi])
                order = np.lexsort((codes, text))
                codes, text = codes[order], text[order]
                fresh = np.ones(len(codes), bool)
                fresh[1:] = (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])
                of = langs[lo:hi]
                for lang in sorted(set(of)):
                    held, n = np.unique(codes[fresh & (of == lang)[text]], return_counts=True)
                    # the code 0 stands for the documents themselves
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(held) + 1)), pa.array(np.concatenate(([0], held.astype(np.int64)))), pa.array(np.concatenate(([int((of == lang).sum())], n)))], schema=schema)

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "grams")
    total = counts.where("code = 0").select("lang", F.col("n").alias("total"))  # one row a language
    common = counts.where("code <> 0").join(small(total), "lang").where(F.col("n") >= F.ceil(F.col("total") * share)).select("lang", "code").toPandas()
    return Filters(languages := sorted(common["lang"].unique()), [common["code"][common["lang"] == x].to_numpy().astype(np.uint64) for x in languages])


@case_safe()
def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang, share) of `docs` (doc_id, text): the language with the largest corrected share of a text's n-grams, ties by name.

    `und` and 0 where a text is null or has no letter, or where there is no filter. Each row is judged by itself;
    repeated rows fare alike; an empty table gives no rows; other columns are ignored. The text itself does not come
    back from Python."""
    held = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS words of 8 bytes a 64 languages

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for b in sliced(batches):
            texts = [x or "" for x in b.column(1).to_pylist()]
            langs, score = ["und"] * len(texts), np.zeros(len(texts))
            for lo, hi in ta.chunks(texts):
                if not f.languages:
                    break
                shares, has = f.shares(texts[lo:hi])
                best = shares.argmax(1)
                for i in np.flatnonzero(has):
                    langs[lo + i], score[lo + i] = f.languages[best[i]], shares[i, best[i]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs), pa.array(score)], names=["doc_id", "lang", "share"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, share double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), F.col("lang").alias("lang_pred"), F.col("share").alias("score"))
