"""Licence scans: winnowed template fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import textarrays as ta
from threadloom.llm.common import case_safe, sliced, table
from threadloom.llm.license_texts import TEMPLATES

#: Most words of a gram and most grams of a window; shape() has those of a template.
K, WINDOW = 3, 4
#: Diagonals beside those of the hits that the alignment may use; matched share of a template from which it is reported.
BAND, LEAST_COVERAGE = 8, 0.8
MATCH, MISMATCH, GAP = 2, -1, -1

FOUND = "doc_id long, license string, coverage double, matched int, template_words int, first_word int, last_word int, spans array<struct<start:long,end:long>>, also array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("template_words", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("spans", _SPANS), ("also", pa.list_(pa.string()))])


def hashed_words(texts: list[str]) -> tuple[ta.Texts, np.ndarray, np.ndarray]:
    """(texts, indices, hashes) of words with letters or digits, in lower case and without other characters."""
    t = ta.Texts(texts)
    h = t.word_hashes(lower=True, keep=ta.LETTER | ta.DIGIT)
    at = np.flatnonzero(h)
    return t, at, h[at]


def shape(n: int, least: float) -> tuple[int, int]:
    """Words of a gram and grams of a window for a template of n words: any run of k + window - 1 words shared with it is a hit.

    At least `need` of the words are matched and the others part them into n - need + 1 runs at most, so the longest run
    has need / (n - need + 1) words or more; gram and window are such that it holds a hit."""
    need = max(1, math.ceil(least * n - 1e-9))
    run = -(-need // (n - need + 1))
    k = min(K, run)
    return k, min(WINDOW, run - k + 1)


def least_hits(n: int, least: float) -> int:
    """Fingerprints that a text with `least` of a template's n words shares with it at least.

    Each missing word breaks at most k + window - 1 of the template's windows, and a fingerprint stands for `window`
    windows at most."""
    k, window = shape(n, least)
    whole = n - k - window + 2 - (n - max(1, math.ceil(least * n - 1e-9))) * (k + window - 1)
    return max(1, -(-whole // window))


def gram_hashes(h: np.ndarray, k: int = K) -> np.ndarray:
    total = np.zeros(max(0, len(h) - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total = total * ta.PRIME + h[j : j + len(total)]
    return ta.mix(total)


def winnow(g: np.ndarray, window: int = WINDOW) -> list[int]:
    """Positions of the least gram of each window, the rightmost of several."""
    if len(g) <= window:
        return [len(g) - 1 - int(np.argmin(g[::-1]))] if len(g) else []
    views = np.lib.stride_tricks.sliding_window_view(g, window)
    return sorted(set((np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], 1)).tolist()))


class Index:
    """Templates and the inverted index of their winnowed fingerprints, by words of a gram: gram hash to (template, position)."""

    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE):
        self.names = list(templates)
        self.words: list[np.ndarray] = []
        #: matched words that make a find, and hits that make a candidate, of each template
        self.need: list[int] = []
        self.hits: list[int] = []
        posting: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for i, text in enumerate(templates.values()):
            _, _, h = hashed_words([text])
            self.words.append(h)
            self.need.append(max(1, math.ceil(least * len(h) - 1e-9)))
            self.hits.append(least_hits(len(h), least) if len(h) else 0)
            if not len(h):
                continue
            k, window = shape(len(h), least)
            g = gram_hashes(h, k)
            for p in winnow(g, window):
                posting[k][int(g[p])].append((i, p))
        self.posting = {k: (np.array(sorted(found), np.uint64), dict(found)) for k, found in sorted(posting.items())}


def align(template: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[int, list[tuple[int, int]]]:
    """Local alignment of word sequences within the diagonals low..high (document less template position).

    Returns the best score and the matched pairs (template position, document position) of the first alignment that
    has it. A row of the table is one template word against all diagonals at once; gaps along a row are a running
    maximum."""
    width = high - low + 1
    steps, there = np.arange(width), np.arange(width) + low
    rows, same, best, at = [], [], 0, (0, 0)
    above = np.zeros(width + 1, np.int64)  # column b stands for diagonal low + b; the last is a rim
    for i, word in enumerate(template):
        j = there + i
        inside = (j >= 0) & (j < len(doc))
        match = inside & (doc[np.clip(j, 0, len(doc) - 1)] == word)
        s = np.maximum(np.maximum(above[:-1] + np.where(match, MATCH, MISMATCH), above[1:] + GAP), 0)
        s[~inside] = 0
        s = np.maximum.accumulate(s - GAP * steps) + GAP * steps
        s[~inside] = 0
        top = int(s.argmax())
        if s[top] > best:
            best, at = int(s[top]), (i, top)
        rows.append(s)
        same.append(match)
        above = np.concatenate((s, [0]))
    pairs, (i, b) = [], at
    while best and i >= 0 and 0 <= b < width and rows[i][b] > 0:
        diagonal, missing = (rows[i - 1][b], rows[i - 1][b + 1] if b + 1 < width else 0) if i else (0, 0)
        if rows[i][b] == diagonal + (MATCH if same[i][b] else MISMATCH):
            if same[i][b]:
                pairs.append((i, i + low + b))
            i -= 1
        elif rows[i][b] == missing + GAP:  # the template's word is missing in the document
            i, b = i - 1, b + 1
        else:  # a further word in the document
            b -= 1
    return best, pairs[::-1]


def places(words: np.ndarray, need: int, doc: np.ndarray, low: int, high: int, begin: int, end: int) -> Iterator[list[int]]:
    """Matched document positions of each place, between begin and end, where `need` words of a template align.

    Once a place is found, what is left before and after it is aligned again."""
    todo = [(begin, end)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < need:
            continue
        _, pairs = align(words, doc[lo:hi], max(low - lo, 1 - len(words)), min(high - lo, hi - lo - 1))
        if len(pairs) >= need:
            found = [lo + j for _, j in pairs]
            yield found
            todo += [(lo, found[0]), (found[-1] + 1, hi)]


def regions(found: list[tuple[int, int]], least: int, slack: int) -> Iterator[tuple[int, int]]:
    """Ranges of diagonals that hold at least `least` hits (document, template position) within `slack`; those that meet are one."""
    starts = np.sort(np.array([p - q for p, q in found]))
    last = np.searchsorted(starts, starts + slack, "right") - 1
    held: tuple[int, int] | None = None
    for i in np.flatnonzero(last - np.arange(len(starts)) + 1 >= least).tolist():
        lo, hi = int(starts[i]), int(starts[last[i]])
        if held and lo <= held[1]:
            held = (held[0], max(hi, held[1]))
        else:
            if held:
                yield held
            held = (lo, hi)
    if held:
        yield held


def settled(finds: list[tuple[int, list[int]]], sizes: list[int]) -> list[tuple[int, list[int], list[int]]]:
    """One find a place: (template, matched positions, other templates found there), in order of place.

    Of finds that share half of their words, that with more matched words stays, then that with the larger share of
    its template, then the first in order of templates."""
    owner: dict[int, int] = {}
    kept: list[tuple[int, list[int], list[int]]] = []
    for template, at in sorted(finds, key=lambda f: (-len(f[1]), -len(f[1]) / sizes[f[0]], f[0], f[1][0])):
        shared = [owner[p] for p in at if p in owner]
        if 2 * len(shared) >= len(at):
            theirs = kept[max(sorted(set(shared)), key=shared.count)]
            if template != theirs[0] and template not in theirs[2]:
                theirs[2].append(template)
            continue
        owner.update((p, len(kept)) for p in at if p not in owner)
        kept.append((template, at, []))
    return sorted(kept, key=lambda f: (f[1][0], f[0]))


def scan_texts(texts: list[str], index: Index) -> Iterator[tuple]:
    """(text, license, coverage, matched, template words, first word, last word, spans, also) of each find, in order of text."""
    t, at, h = hashed_words(texts)
    of = t.word_text[at]
    hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for k, (keys, posting) in index.posting.items():
        g = gram_hashes(h, k)
        slot = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        for p in np.flatnonzero((keys[slot] == g) & (of[: len(g)] == of[k - 1 :])).tolist():
            for template, q in posting[int(g[p])]:
                hits[int(of[p]), template].append((p, q))
    first = np.searchsorted(of, np.arange(t.n + 1))
    finds: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for (text, template), found in sorted(hits.items()):
        words, need = index.words[template], index.need[template]
        if len(found) < index.hits[template]:
            continue
        slack = len(words) - need + BAND
        for low, high in regions(found, index.hits[template], slack):
            low, high = low - slack, high + slack
            begin, end = max(int(first[text]), low), min(int(first[text + 1]), high + len(words))
            finds[text] += [(template, place) for place in places(words, need, h, low, high, begin, end)]
    for text, some in sorted(finds.items()):
        for template, place, also in settled(some, [len(w) for w in index.words]):
            spans: list[list[int]] = []
            last = None
            for w in at[place].tolist():
                begin, stop = int(t.word_starts[w] - t.starts[text]), int(t.word_ends[w] - t.starts[text])
                if last is not None and w == last + 1:
                    spans[-1][1] = stop
                else:
                    spans.append([begin, stop])
                last = w
            own, n = int(t.first_word[text]), len(index.words[template])
            yield text, index.names[template], len(place) / n, len(place), n, int(at[place[0]]) - own, last - own, spans, [index.names[x] for x in sorted(also)]


@case_safe()
def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """Where `docs` (doc_id, text) hold a template by at least `least` of its words: one row a document and place.

    coverage: matched share of the template's words; first_word, last_word: positions among the text's words; spans:
    character ranges of runs of matched words; also: other templates that fit the place less well. Words compare in
    lower case by letters and digits alone, so comment marks and punctuation do not matter. Null and empty texts give
    no rows; repeated rows give each their own; rows of one document are in order of place; an empty table gives no
    rows; other columns are ignored. Words of a template may be missing or replaced anywhere; further words in the
    document count as such where they part the template's words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, least)
        for b in sliced(batches):
            ids, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            for lo, hi in ta.chunks(texts):
                found = [
                    {"doc_id": ids[lo + i], "license": name, "coverage": c, "matched": m, "template_words": n, "first_word": f, "last_word": e, "spans": [{"start": x, "end": y} for x, y in spans], "also": also}
                    for i, name, c, m, n, f, e, spans, also in scan_texts(texts[lo:hi], index)
                ]
                yield pa.RecordBatch.from_pylist(found, _SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(rows, FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
