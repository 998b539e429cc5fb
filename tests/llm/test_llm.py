"""The training-data operators against brute force, on small fixtures with nulls, empties, ties, repeats and long texts."""

import base64
import collections
import hashlib
import itertools
import math
import pathlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import common, conversation_repair, flat_graph, language_id, license_scan, line_crf, mixing, near_pairs, near_vectors, packing, quality_rules, quality_sql, registry, sharding, source_divergence, textarrays, warc, winnowing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(5)
VOCABULARY = ["the", "of", "und", "der", "xylo", "éa", "ñu", "walk", "tree", "a", "2024", "Go"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) + str(rng.randrange(40)) * (rng.random() < 0.7) for _ in range(n))


EDGE = [(1, None, None, None), (2, "", "en", "b"), (3, " \n\t ", "en", None), (4, "one", "en", "a"), (4, "one", "en", "a"), (None, "no id here", "en", "a"), (5, "x" * 30_000, "en", "b"), (6, "emoji 😀 " * 20, "zz", "é")]


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with an extra column of a clashing name."""

    def build(rows):
        full = [(*r, *((None,) * (4 - len(r))), "extra") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, size string").repartition(3)

    return build


# ---------------------------------------------------------------- 1 WARC


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, None if i == 3 else f"http://x/{i}\r\nX: y", html) for i, html in enumerate(["<p>a</p>", "", None, "<p>a</p>", "é" * 9, "z" * 200_000, "<p>a</p>"])]
    df = spark.createDataFrame([*pages, (None, "u", "<p>a</p>"), (4, "again", "é" * 9)], "page_id long, url string, html string")
    rows = warc.round_trip(df, str(tmp_path / "w")).collect()
    assert len(rows) == 9
    for r in rows:
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest and len(r.payload) == r.payload_bytes
    got = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.record_type, r.refers_to) for r in rows)
    assert got == [(-1, 8, "revisit", 0), (0, 8, "response", None), (1, 0, "response", None), (2, 0, "revisit", 1), (3, 8, "revisit", 0), (4, 18, "response", None), (4, 18, "response", None), (5, 200_000, "response", None), (6, 8, "revisit", 0)]
    data = next((tmp_path / "w").iterdir()).read_bytes()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    assert warc.round_trip(df.where("page_id > 99"), str(tmp_path / "v")).count() == 0


def agrees_with_sql(spark, query, sql, folder):
    con = duckdb.connect()
    for path in pathlib.Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    want = con.sql(sql)
    key = lambda rows: sorted((tuple((x is None, x) for x in r) for r in rows), key=str)
    assert key(map(tuple, query(spark, folder).select(*want.columns).collect())) == key(want.fetchall())


def test_warc_matches_sql(spark):
    agrees_with_sql(spark, warc.query, warc.SQL, SF)


def test_warc_dictionary_and_limits(tmp_path):
    records = [f"record {i} with much the same text".encode() * 4 for i in range(300)]
    for dictionary in (warc.build_dictionary(records), b""):
        with open(tmp_path / "f", "wb") as out:
            n, size = warc.write_file(out, dictionary, iter(records))
        assert n == 300 and size == (tmp_path / "f").stat().st_size
        with open(tmp_path / "f", "rb") as source:
            assert list(warc.read_file(source, chunk=100)) == records
    with open(tmp_path / "f", "wb") as out:
        assert warc.write_file(out, b"", iter(records), limit=200)[0] < 300
    assert warc.build_dictionary([]) == b""


# ---------------------------------------------------------------- 2 packing


def test_plan_is_valid_and_tight():
    for seed in range(20):
        rng = random.Random(seed)
        capacity = rng.choice([7, 50, 4096])
        counts = {n: rng.randrange(1, 60) for n in {rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 40))}}
        bins, seen = collections.defaultdict(list), collections.Counter()
        for length, first, slots, copies, start, base in packing.plan(counts, capacity):
            assert first == seen[length] and slots % copies == 0
            seen[length] += slots
            for i in range(slots):
                bins[start + i // copies].append((base + i % copies * length, length))
        assert seen == counts
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(n * c for n, c in counts.items())
        # best-fit decreasing piece by piece
        rooms = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = [r for r in rooms if r >= length]
                if fit:
                    rooms.remove(min(fit))
                rooms.append((min(fit) if fit else capacity) - length)
        assert math.ceil(total / capacity) <= len(bins) <= len(rooms) * 1.02 + 1
    assert packing.plan({}) == []


def test_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(packing.default_tokenizer()), packing.ChunkEncoder(None)
    letters = "aZé ÄßİŒœ'sdllre09½²!#.,<|>\n\t\x1c\x85\xa0　Σςσ中日́ﬁ😀​\x00"
    rng = random.Random(1)
    for _ in range(1500):
        x = "".join(rng.choice(letters) for _ in range(rng.randrange(25)))
        assert np.frombuffer(encoder.encode(x), "<u4").tolist() == whole.encode(x, add_special_tokens=False).ids, repr(x)
    x = "An <|endoftext|> IN <|ENDOFTEXT|> text"
    assert np.frombuffer(encoder.encode(x), "<u4").tolist() == whole.encode(x, add_special_tokens=False).ids


def test_packing(frame):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    docs = [*[(i, t) for i, t, *_ in EDGE], *[(i, prose(RNG.randrange(1, 200))) for i in range(10, 60)], (99, prose(9000))]
    rows = packing.pack_documents(frame(docs)).collect()
    want = collections.Counter()
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[i, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= math.ceil(sum(r.length for r in rows) / 4096) + 1
    assert packing.pack_documents(frame([(1, "x")]).where("doc_id > 5")).count() == 0


# ---------------------------------------------------------------- 3 licences


def test_license_spans(frame):
    mit = license_scan.TEMPLATES["mit"]
    changed = mit.replace("merge, publish", "combine, publish").replace("free of charge, ", "")
    commented = "\n".join(" * " + line for line in re.findall(r".{1,60}(?:\s|$)", mit))
    docs = [(1, f"before {mit} after {mit}"), (2, changed), (3, commented), (4, prose(300)), (5, None), (6, ""), (7, mit[: len(mit) // 2]), (8, "x Released under the MIT License."), (8, "x Released under the MIT License.")]
    found = collections.defaultdict(list)
    for r in license_scan.scan(frame(docs)).collect():
        found[r.doc_id].append(r)
    assert [r.coverage for r in found[1]] == [1.0, 1.0] and {r.license for r in found[1]} == {"mit"}
    text = docs[0][1]
    assert sorted(text[r.spans[0].start : r.spans[-1].end] for r in found[1]) == [mit, mit]
    assert [r.license for r in found[2]] == ["mit"] and 0.9 < found[2][0].coverage < 1 and len(found[2][0].spans) >= 2
    assert [(r.license, r.coverage) for r in found[3]] == [("mit", 1.0)]
    assert not any(found[i] for i in (4, 5, 6, 7)) and len(found[8]) == 2


def brute_places(text, index):
    """Finds without fingerprints or bands: every template is aligned with the whole text, again and again."""
    t, at, h = license_scan.hashed_words([text])
    finds = []
    for k, words in enumerate(index.words):
        todo = [(0, len(h))]
        while todo:
            lo, hi = todo.pop()
            pairs = license_scan.align(words, h[lo:hi], 1 - len(words), hi - lo - 1)[1] if hi > lo else []
            if len(pairs) >= license_scan.LEAST_COVERAGE * len(words):
                found = [lo + j for _, j in pairs]
                finds.append((k, found))
                todo += [(lo, found[0]), (found[-1] + 1, hi)]
    return [(index.names[k], len(p), int(at[p[0]]), int(at[p[-1]]), [index.names[x] for x in sorted(also)]) for k, p, also in license_scan.settled(finds, [len(w) for w in index.words])]


def test_license_scan_against_brute_force():
    rng, index = random.Random(12), license_scan.Index(license_scan.TEMPLATES)
    filler = lambda n: " ".join(rng.choice("alpha beta the of under license and public notice is to be".split()) for _ in range(n))
    names, texts, alone = list(license_scan.TEMPLATES), [], {}
    for name, t in license_scan.TEMPLATES.items():
        alone[len(texts)] = [name]
        texts.append(t)
        alone[len(texts)] = [name] * 2
        texts.append(f"{t} {t}")
        texts += [f"{filler(20)} {t} {filler(30)} {t} {t}", f"{t} {t.split()[0]} {' '.join(t.split()[:4])} {t}"]
        other = rng.choice(names)
        texts.append(f"{filler(5)} {t} {license_scan.TEMPLATES[other]} {filler(5)}")
        for _ in range(6):
            words = t.split()
            for _ in range(rng.randrange(1, max(2, len(words) // 6))):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["xyzzy"], [words[at], "xyzzy"][: 1 + (len(words) > 60)]])
                words = words or ["x"]
            texts.append(f"{filler(10)} {' '.join(words)} {filler(10)}")
    got = collections.defaultdict(list)
    for i, name, _, m, _, f, e, _, also in license_scan.scan_texts(texts, index):
        got[i].append((name, m, f, e, also))
    for i, t in enumerate(texts):
        assert got[i] == brute_places(t, index), t
    for i, want in alone.items():
        assert [x[0] for x in got[i]] == want
    assert got[names.index("bsd-2-clause") * 11][0][4] == ["bsd-3-clause"]


def test_edits_of_short_templates_against_full_alignment():
    index, missed, held = license_scan.Index(license_scan.TEMPLATES), [], 0
    for name, template in license_scan.TEMPLATES.items():
        words = re.findall("[a-z0-9]+", template.lower())
        own = index.words[index.names.index(name)]
        if len(own) > 16 or len(words) < len(own):
            continue
        parts = template.split()
        for size in (1, 2, 3):
            for at in itertools.combinations(range(len(parts)), size):
                for other in ("xyzzy", ""):
                    text = "some words before " + " ".join(other if i in at else w for i, w in enumerate(parts)) + " and some after"
                    _, _, h = license_scan.hashed_words([text])
                    pairs = license_scan.align(own, h, 1 - len(own), len(h) - 1)[1]
                    if len(pairs) >= license_scan.LEAST_COVERAGE * len(own):
                        held += 1
                        if name not in {x for f in license_scan.scan_texts([text], index) for x in (f[1], *f[8])}:
                            missed.append(text)
    assert held > 400 and not missed
    assert {f[1] for f in license_scan.scan_texts(["Released under the MIT Licence."], index)} == {"mit-line"}
    tiny = license_scan.Index({"one": "Unlicensed", "two": "Public domain"})
    assert [f[1] for f in license_scan.scan_texts(["x", "it is unlicensed", "", "public domain"], tiny)] == ["one", "two"]
    for n in range(1, 300):  # every arrangement of need matched words has a run that holds a hit
        k, window = license_scan.shape(n, 0.8)
        need = math.ceil(0.8 * n - 1e-9)
        assert 1 <= k <= n and (n - need + 1) * (k + window - 2) < need and license_scan.least_hits(n, 0.8) >= 1


def test_least_hits_of_edited_templates():
    rng, index = random.Random(3), license_scan.Index(license_scan.TEMPLATES)
    for k, words in enumerate(index.words):
        n = len(words)
        for _ in range(60):
            kept = sorted(rng.sample(range(n), index.need[k]))
            doc = np.array([words[i] if i in set(kept) else rng.randrange(1, 1 << 60) for i in range(n)], np.uint64) if rng.random() < 0.5 else words[kept]
            gram, window = license_scan.shape(n, license_scan.LEAST_COVERAGE)
            g = set(license_scan.gram_hashes(doc, gram).tolist())
            own = license_scan.gram_hashes(words, gram)
            assert sum(int(own[p]) in g for p in license_scan.winnow(own, window)) >= index.hits[k]


def test_alignment_against_full_dynamic_programming():
    for _ in range(300):
        a, b = [RNG.randrange(4) for _ in range(RNG.randrange(1, 9))], [RNG.randrange(4) for _ in range(RNG.randrange(1, 12))]
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, pairs = license_scan.align(np.array(a), np.array(b), 1 - len(a), len(b) - 1)
        assert score == h.max() and bool(pairs) == (score > 0)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in itertools.pairwise(pairs))
        # the pairs are worth the score: between two of them each word left over costs one, or one together
        assert score == 2 * len(pairs) - sum(max(q - p, s - r) - 1 for (p, r), (q, s) in itertools.pairwise(pairs))


# ---------------------------------------------------------------- 4 mixing


def fill(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    caps, total, target, open_ = {s: 2.0 * n for s, n in sizes.items()}, 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if caps[s] <= w[s] * level}
        if not full:
            return target | {s: w[s] * level for s in open_}
        target |= {s: caps[s] for s in full}
        open_ -= full
    return target


def test_mixing(frame):
    rng = random.Random(8)
    docs = [*EDGE, *[(100 + i, prose(rng.randrange(1, 60), rng), None, rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(400)]]
    df = frame(docs)
    rows = mixing.mix(df)[0].collect()
    sizes = collections.Counter()
    for _, t, _, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    target = fill(dict(sizes))
    assert collections.Counter((r.doc_id, r["size"]) for r in rows) == collections.Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in docs)
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1  # the target, rounded
    # document by document: a source's stream, in order of md5, is taken round after round
    for s in sizes:
        stream = sorted(((hashlib.md5(f"mix|{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r["size"], r.taken) for r in rows if r.source == s), key=lambda x: x[:2])
        left, want = round(target[s]), [0] * len(stream)
        while left and sizes[s]:
            for k, (_, n, _) in enumerate(stream):
                want[k] += min(n, left)
                left -= min(n, left)
        assert [t for *_, t in stream] == want
    again = mixing.mix(df.repartition(7))[0].collect()
    key = lambda rs: sorted((str(r.doc_id), r["size"], r.taken) for r in rs)
    assert key(again) == key(rows)
    copies = mixing.repeated(df).collect()
    assert abs(sum(len(WORD.findall(r.text)) for r in copies) - sum(taken.values())) < 0.02 * sum(taken.values())
    assert mixing.mix(df.where("doc_id < 0"))[0].count() == 0


def test_mixing_matches_sql(spark):
    agrees_with_sql(spark, mixing.query, mixing.SQL, SF)


def test_schedule_spreads_sources(spark):
    shares = {"a": 0.55, "b": 0.3, "c": 0.1, "d": 0.05}
    targets = spark.createDataFrame([(k, 40_000, 120_000 * v) for k, v in shares.items()], "sid string, source_size long, target double")
    rows = mixing.schedule(targets, 16).orderBy("slot").collect()
    order = [r.sid for r in rows]
    assert collections.Counter(order) == {k: 7500 * v for k, v in shares.items()}
    # every stretch of the mix, from its start on and in between, holds each source by its share
    for k, share in shares.items():
        count = np.cumsum([x == k for x in order])
        assert np.abs(count - share * np.arange(1, len(order) + 1)).max() < 4
    # slot t is the source whose interval of the cumulative weights holds the t-th golden-ratio point
    weights = np.cumsum([0, *shares.values()])
    for r in rows[:2000]:
        at = r.slot * mixing.STEP % (1 << mixing.BITS) / (1 << mixing.BITS)
        assert "abcd"[int(np.searchsorted(weights, at, "right")) - 1] == r.sid
    assert abs(mixing.STEP / (1 << mixing.BITS) - (math.sqrt(5) - 1) / 2) < 1e-11 and mixing.STEP % 2
    big = [0, 1, (1 << 39) + 12345, (1 << 40) - 1]
    got = spark.createDataFrame([(x,) for x in big], "t long").select("t", mixing.point(F.col("t")).alias("at")).collect()
    assert all(r["at"] == r.t * mixing.STEP % (1 << mixing.BITS) / (1 << mixing.BITS) for r in got)


def test_small_sources_reach_their_targets(spark, frame):
    sizes = {"a": 60, "b": 300, "c": 1_000, "d": 3_000, "e": 10_000, "f": 50_000, "g": 40_000_000, "h": 4096}
    targets = spark.createDataFrame([(s, n, 2.0 * n if s != "g" else 1.3 * n) for s, n in sizes.items()], "sid string, source_size long, target double")
    rows = mixing.schedule(targets, 4096).collect()
    taken, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        taken[r.sid] += r.tokens
        slots[r.sid].append((r.rank, r.slot))
        assert 0 < r.tokens <= 4096 and r.block * 4096 + r.tokens <= sizes[r.sid]
    assert taken == {s: 2 * n if s != "g" else 52_000_000 for s, n in sizes.items()}
    assert len({r.slot for r in rows}) == len(rows)
    for held in slots.values():
        assert [rank for rank, _ in sorted(held, key=lambda x: x[1])] == list(range(len(held)))
        for rank, slot in held:
            assert abs(rank - slot * len(held) / len(rows)) < 4
    # from documents on, with blocks far longer than the small sources
    rng = random.Random(11)
    docs = [(i, prose(n, rng), None, s) for i, (n, s) in enumerate([(60, "x"), (150, "y"), (150, "y"), (700, None), *[(2000, "z")] * 30])]
    total, target = collections.Counter(), {}
    for r in mixing.mix(frame(docs), block=4096)[0].collect():
        total[r.source] += r.taken
        target[r.source] = r.target
    assert set(total) == {"x", "y", "z", None} and all(abs(total[s] - target[s]) <= 1 for s in total)


# ---------------------------------------------------------------- 5 quality rules


def base(t):
    w = WORD.findall(t or "")
    tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j + d for j in range(len(w) - 2) if tri[w[j], w[j + 1], w[j + 2]] > 1 for d in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_base_and_verdict(frame, spark, tmp_path):
    def english(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice("the of and to in a is that it for on house river walked slowly green stone".split()) for _ in range(n)).capitalize() + "."

    junk = "| " + " | ".join(f"qx{i}zz" for i in range(200))
    docs = [*EDGE, *[(10 + i, english(120 + i, i), "en", "s") for i in range(40)], (70, junk, "en", "s"), (71, "again and again " * 60, None, None), (72, "a\nb\na\n\n \nb", "de", "s"), (73, english(200, 99).upper() + "!!", "en", "s")]
    frame(docs).write.parquet(str(tmp_path / "documents.parquet"))
    rows = quality_rules.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    want = collections.Counter((i, *base(t)) for i, t, *_ in docs)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[10 + i] for i in range(40)) and not kept[70] and not kept[71] and not kept[73]
    good = quality_rules.keep_good(frame(docs))
    assert good.columns == frame(docs).columns and sorted(r.doc_id for r in good.collect()) == sorted(i for i, k in kept.items() if k)
    assert quality_rules.keep_good(frame(docs).where("doc_id < 0")).count() == 0


COMMON = {
    "en": "the of and to in a is that it for on was as with be by are this", "it": "il di che è per una sono non con si da come anche ma nel",
    "pl": "i w nie na się z do że jak po ale od za przez", "pt": "de a o que e do da em um para com não uma os no se na por", "nl": "de en van ik te dat die in een hij het niet zijn is was op aan met",
    "ru": "и в не на я он с что а по это она к но мы все как из за", "ja": "これ は それ が の に を と た し で も な い",
}
STEMS = {"ru": ("кам бор тел рив сол".split(), "ино ето ара иле ура".split(), ["", "ре", "ндо", "то"]), "ja": ("山川 空海 森林 石橋 花火".split(), "の下 の上 の中 と共 から".split(), ["", "まで", "より"])}


def clean(lang, n, seed):
    rng, common = random.Random(seed), COMMON[lang].split()
    first, second, ends = STEMS.get(lang, ("cam bor tel riv sol".split(), "ino eto ara ile ura".split(), ["", "re", "ndo", "to"]))
    words = [rng.choices(common, [1 / (k + 2) for k in range(len(common))])[0] if rng.random() < 0.45 else rng.choice(first) + rng.choice(second) + rng.choice(ends) for _ in range(n)]
    return " ".join(w.capitalize() if i % 14 == 0 else w + "." * (i % 14 == 13) for i, w in enumerate(words))


def test_quality_of_any_language(frame, spark, tmp_path):
    sizes, docs = [60, 75, 90, 120, 400, 5000], []
    for k, lang in enumerate(COMMON):  # a table with references, and the same languages without or with few rows
        docs += [(1000 * (k + 1) + i, clean(lang, sizes[i % 6], 1000 * k + i), lang, "s") for i in range(30)]
        docs += [(20_000 + 1000 * k + i, clean(lang, n, 7000 + 1000 * k + i), None, "s") for i, n in enumerate(sizes)]
        docs += [(40_000 + 1000 * k + i, clean(lang, n, 9000 + 1000 * k + i), f"x-{lang}", "s") for i, n in enumerate(sizes)]
    docs += [(60_000, " ".join(f"Qzx{i}vk" for i in range(300)), "it", "s"), (60_001, " ".join(f"|{i}#{i * 7}" for i in range(300)), "x", "s"), (60_002, " ".join(f"|{i}#{i * 7}" for i in range(300)), None, "s")]
    docs += [(60_003, " ".join(f"word{chr(97 + i % 26)}" + "abcdefghij"[i % 10] for i in range(300)), "en", "s"), (60_004, clean("it", 300, 1), "en", "s"), *EDGE]
    docs += [(61_000 + i, "the same junk " + " ".join(f"{j}%" for j in range(100)), "en", "s") for i in range(200)]  # copies are one text to a reference
    frame(docs).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in quality_rules.query(spark, str(tmp_path)).collect()}
    assert [i for i in rows if i is not None and 60_000 > i >= 1000 and not rows[i].kept] == []
    assert not any(rows[i].kept for i in (60_000, 60_001, 60_002, 60_003, 61_000, 61_199)) and rows[60_004].kept
    assert rows[2000].word_distance is not None and rows[20_000].word_distance is None and rows[40_000].word_distance is None
    assert rows[20_000 + 6000].class_distance is None and rows[7000].class_distance is not None  # letters without case
    good = quality_rules.keep_good(frame(docs))
    assert good.columns == frame(docs).columns and {r.doc_id for r in good.collect()} == {i for i, r in rows.items() if r.kept}
    agrees_with_sql(spark, quality_rules.query, quality_sql.SQL, str(tmp_path))


def test_quality_matches_sql(spark):
    agrees_with_sql(spark, quality_rules.query, quality_sql.SQL, SF)


def test_quality_repeats_of_all_kinds(frame, spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdefghijklmnop"[: 2 + i % 15]) for _ in range(rng.randrange(0, 400)))) for i in range(120)] + [(200, " ".join(f"{k} {k + 1} {k}" for k in list(range(80)) * 2))]
    rows = {r.row.doc_id: r.q.n_repeat_words for r in quality_rules.counted(frame(docs), {}).collect()}
    assert rows == {i: base(t)[4] for i, t in docs}


def test_distance(spark):
    for p, q in (([0.5, 0.5, 0.0], [0.2, 0.3, 0.5]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([0.2, 0.8, 0.0], [0.2, 0.8, 0.0])):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)  # noqa: E731, B023
        got = spark.range(1).select(quality_rules.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
        assert got == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2), abs=1e-9)


# ---------------------------------------------------------------- 6 similar documents


def shingles(t):
    w = WORD.findall(t or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(docs, threshold=0.8):
    sets = [shingles(t) for _, t in docs]
    parent, links = list(range(len(docs))), [0] * len(docs)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a == b or (len(a & b) >= threshold * len(a | b) and a & b):
            links[i], links[j] = links[i] + 1, links[j] + 1
            parent[find(i)] = find(j)
    heads = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        heads[find(i)].append(d)
    return [(d, min(heads[find(i)]), links[i]) for i, (d, _) in enumerate(docs)]


def test_near_pairs(frame, monkeypatch):
    rng = random.Random(3)
    docs = []
    for g in range(25):
        words = prose(rng.randrange(5, 160), rng).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(1000)}"
            docs.append((len(docs) + 100, " ".join(copy)))
    docs += [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "a b"), (6, "a c"), (7, "x" * 50_000), (8, docs[0][1] + "\n"), (8, docs[0][1] + "\n")]
    want = sorted(brute_classes(docs))
    run = lambda: sorted((r.doc_id, r.class_id, r.n_links) for r in near_pairs.join(frame(docs)).collect())
    assert run() == want
    heads = {c for _, c, _ in want}
    kept = near_pairs.one_of_each(frame(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(heads) and kept.columns == frame(docs).columns
    for most in (4096, 3):  # groups of all sizes are cut into blocks, a few or many
        monkeypatch.setattr(near_pairs, "BLOCK", 2)
        monkeypatch.setattr(near_pairs, "CELL_BLOCK", 3)
        monkeypatch.setattr(near_pairs, "MOST", most)
        monkeypatch.setattr(near_pairs, "FEW", 4)
        monkeypatch.setattr(near_pairs, "CELL_FEW", 5)
        assert run() == want
    assert near_pairs.join(frame(docs).where("doc_id < 0")).count() == 0


def test_near_copies_need_space_by_documents(spark, frame, monkeypatch):
    """Of a group of near copies a row a copy is stored, and its links are all counted."""
    rng, n = random.Random(12), 1500
    words = prose(120, rng).split()
    docs = []
    for i in range(n):
        copy = list(words)
        copy[rng.randrange(120)] = f"w{i}"
        docs.append((i, " ".join(copy)))
    stored = collections.Counter()
    written = near_pairs.materialize

    def counted(df, name):
        out = written(df, name)
        stored[name] = out.count()
        return out

    monkeypatch.setattr(near_pairs, "materialize", counted)
    rows = near_pairs.join(frame(docs)).collect()
    assert {(r.class_id, r.n_links) for r in rows} == {(0, n - 1)} and len(rows) == n
    # a row a class, and what each of its blocks and buckets says of it
    assert stored["sets"] == n and stored["links"] <= near_pairs.CELL_FEW * n and stored["candidates"] <= 4 * near_pairs.BANDS * n


def test_near_pairs_match_sql(spark, frame, tmp_path):
    agrees_with_sql(spark, near_pairs.query, near_pairs.SQL, SF)


def test_pruning_table_and_estimates():
    need = near_pairs.least_matches()
    assert need[16] <= need[64] <= need[128] and 60 < need[128] < 95
    # a pair at the threshold is not dropped at any look
    assert near_pairs.missed_share(need) < 1e-6
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64)))
    assert abs((near_pairs.minhash(a) == near_pairs.minhash(b)).mean() - 0.6) < 0.15
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(20)]
    got = near_pairs.intersections(sets)
    for i, j in itertools.combinations(range(20), 2):
        assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))
    for pairs in ([(0, np.array([3, 5])), (4, np.array([9]))], [(i, np.arange(i + 1, 20)) for i in range(19)]):
        for i, js, both in near_pairs.overlaps(sets, pairs):
            assert both.tolist() == [len(np.intersect1d(sets[i], sets[j])) for j in js]


def test_each_pair_is_compared_once_and_only_survivors_are_verified():
    rng = np.random.default_rng(2)
    core = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate((core[: 300 - 12 * i], rng.integers(0, 1 << 63, 12 * i).astype(np.uint64)))) for i in range(12)]
    values = np.stack([near_pairs.minhash(s) for s in sets])
    keys, need = near_pairs.band_keys(values), near_pairs.least_matches()
    seen = collections.Counter((i, int(j)) for i, later in near_pairs.asked(values, None, need) for j in later)
    # what buckets connect is what the pairs that survive connect
    whole, buckets = near_pairs.Forest(12), near_pairs.Forest(12)
    for i, j in seen:
        whole.join(i, [j])
    for band in range(near_pairs.BANDS):
        for members in {tuple(np.flatnonzero(keys[:, band] == k)) for k in keys[:, band]}:
            for side in (None, np.arange(len(members)) % 2, 1 - np.arange(len(members)) % 2):
                for i, r in enumerate(near_pairs.connected(values[list(members)], band, side, need).roots()):
                    buckets.join(int(members[i]), [members[int(r)]])
    assert whole.roots().tolist() == buckets.roots().tolist()
    across = collections.Counter((i, int(j)) for i, later in near_pairs.asked(values, np.arange(12) % 2, need) for j in later)
    assert set(across) == {(i, j) for i, j in seen if (i + j) % 2}
    jaccard = {(i, j): len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i, j in itertools.combinations(range(12), 2)}
    assert set(seen.values()) == {1} and {p for p, x in jaccard.items() if x >= 0.8} <= set(seen)
    assert len(seen) < len(jaccard)
    pairs = [(i, np.array([j for a, j in seen if a == i])) for i in sorted({a for a, _ in seen})]
    documents, linked, _ = near_pairs.links(sets, np.ones(12, np.int64), pairs)
    assert linked.tolist() == documents.tolist() == [sum(x >= 0.8 for p, x in jaccard.items() if i in p) for i in range(12)]


# ---------------------------------------------------------------- 7 winnowing


def winnow(t):
    u = [x for w in WORD.findall(t) for x in (list(w) if len(w) > winnowing.LONGEST else [w])]
    if not u:
        return []
    prime, base, k = winnowing.PRIME, winnowing.BASE, min(winnowing.K, len(u))
    d = [((xxhash.xxh64_intdigest(x.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)) % prime for x in u]
    h, g = 0, []
    for i, x in enumerate(d):  # rolling: the digit that leaves is taken off, the next is put on
        h = ((h - (d[i - k] * pow(base, k - 1, prime) if i >= k else 0)) * base + x) % prime
        if i >= k - 1:
            g.append(h * pow(base, winnowing.K - k, prime) % prime)
    g, out = [(h, -i) for i, h in enumerate(g)], []
    for i in range(max(1, len(g) - winnowing.WINDOW + 1)):
        x = min(g[i : i + winnowing.WINDOW])
        if x not in out:
            out.append(x)
    return out


def test_winnowing_guarantee_with_and_without_blanks(spark, frame):
    rng = random.Random(6)
    letters = "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生"
    for join, shared in ((" ", [f"w{rng.randrange(500)}" for _ in range(8)]), ("", [rng.choice(letters) for _ in range(8)])):
        units = lambda n: [f"w{rng.randrange(500)}" if join else rng.choice(letters) for _ in range(n)]  # noqa: E731, B023
        docs = [(i, join.join([*units(rng.randrange(40, 90)), *shared, *units(rng.randrange(40, 90))])) for i in range(40)]
        rows = frame(docs).select(winnowing.hashes(winnowing.fingerprint(F.col("text"))).alias("h")).collect()
        assert len(set.intersection(*(set(r.h) for r in rows))) >= 1
    text = "".join(rng.choice(letters) for _ in range(900))
    near = frame([(1, text), (2, text[:600] + "".join(rng.choice(letters) for _ in range(300)))])
    one, two = (set(r.h) for r in near.orderBy("doc_id").select(winnowing.hashes(winnowing.fingerprint(F.col("text"))).alias("h")).collect())
    assert 0.35 < len(one & two) / len(one | two) < 0.65


def test_winnowing(frame, spark, tmp_path):
    docs = [(i, t) for i, t, *_ in EDGE if i is not None and i != 4] + [(80, prose(60).replace(" ", "")), (10 + 71, "中文" * 90 + " and words " + "x" * 32 + " " + "y" * 33)] + [(10 + i, prose(RNG.randrange(1, 90))) for i in range(60)] + [(200, "same words here"), (201, "same words here")]
    frame(docs).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in winnowing.query(spark, str(tmp_path)).collect()}
    text = {i: t or "" for i, t in docs}
    order = sorted(text, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    shown = lambda p: " ".join(f"{h:010X}:{-back}" for h, back in p)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert len(rows) == len(docs)
    for i, t in text.items():
        cut, after = len(t) // 3, text[following[i]]
        edited = t[: len(t) - cut] + after[:cut]
        own, new, other = ({h for h, _ in winnow(y)} for y in (t, edited, after))
        r = rows[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(winnow(t)), shown(winnow(edited)))
        assert (r.near_edited, r.near_next) == (pytest.approx(jaccard(own, new)), pytest.approx(jaccard(own, other)))
    # positions are told as they are, however long the text
    long = " ".join(["w"] * 30_000 + ["end"] * 3)
    last = frame([(1, long)]).select(winnowing.positions(winnowing.fingerprint(F.col("text"))).alias("p")).first().p
    assert last == [-back for _, back in winnow(long)] and last[-1] >= 29_990
    repeated = frame([(1, "a b"), (1, "a b"), (1, "c"), (2, "d"), (None, "e")])
    seen, _ = winnowing.with_next(repeated)
    assert sorted((str(r.doc_id), r.text, r.next_text) for r in seen.where("NOT guest").collect()) == [("1", "a b", "a b"), ("1", "a b", "c"), ("1", "c", "e"), ("2", "d", "a b"), ("None", "e", "d")]
    assert winnowing.with_next(repeated.where("doc_id > 9"))[0].count() == 0


# ---------------------------------------------------------------- 8 sharding


def test_sharding(frame):
    docs = [*[(i, t) for i, t, *_ in EDGE], *[(1000 + i, prose(3)) for i in range(3000)]]
    rows = sharding.shard(frame(docs), [1.0] * 40, [1.0] * 41).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == len(docs)
    text = {i: t or "" for i, t in docs}
    for r in rows:
        data = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(data) + 16, zlib.crc32(data))

    def brute(key, weights):
        n, p = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16), sharding.PRIME
        mixed = [((((n >> 30) + i * sharding.FIRST) % p) ** 2 + n % (1 << 30)) % p for i in range(len(weights))]
        draws = [-math.log(((y * y + i * sharding.SECOND) % p + 0.5) / p) / w for i, (y, w) in enumerate(zip(mixed, weights, strict=True))]
        return draws.index(min(draws))

    for r in rows[:300]:
        assert (r.shard, r.grown_shard) == (brute(r.doc_id, [1.0] * 40), brute(r.doc_id, [1.0] * 41))
    heavy = sharding.shard(frame(docs), [1.0, 3.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / len(docs) for r in heavy}
    assert abs(share[1] - 0.75) < 0.04
    assert sharding.shard(frame(docs).where("doc_id < 0"), [1.0]).count() == 0


def test_sharding_is_even(spark):
    keys = spark.range(200_000).select(sharding.key_digest(F.col("id")).alias("h"))
    placed = keys.select(sharding.rendezvous(F.col("h"), [1.0] * 40).alias("a"), sharding.rendezvous(F.col("h"), [1.0] * 41).alias("b"))
    counts = {(r.a, r.b): r["count"] for r in placed.groupBy("a", "b").count().collect()}
    shares, moved = collections.Counter(), collections.Counter()
    for (a, b), n in counts.items():
        shares[a] += n
        moved[b == 40] += n
        assert b in (a, 40)
    assert len(shares) == 40 and sum((n - 5000) ** 2 / 5000 for n in shares.values()) < 80  # chi-squared, 39 degrees
    assert abs(moved[True] / 200_000 - 1 / 41) < 0.002


def test_sharding_matches_sql(spark):
    agrees_with_sql(spark, sharding.query, sharding.SQL, SF)


# ---------------------------------------------------------------- 9 line field


def test_marginals_against_enumeration():
    rng = random.Random(2)
    for n in range(1, 6):
        odds, trans = [math.exp(rng.gauss(0, 1)) for _ in range(n)], [math.exp(rng.gauss(0, 1)) for _ in range(4)]
        weight, good = 0.0, [0.0] * n
        for labels in itertools.product((0, 1), repeat=n):
            w = math.prod(o if y else 1.0 for o, y in zip(odds, labels, strict=True)) * math.prod(trans[2 * a + b] for a, b in itertools.pairwise(labels))
            weight += w
            good = [g + w * y for g, y in zip(good, labels, strict=True)]
        assert line_crf.marginals(odds, tuple(trans)) == pytest.approx([g / weight for g in good])
        padded, pairs = line_crf._sweep(np.log([odds + [1.0]]), np.array([[True] * n + [False]]), np.log(np.array(trans)).reshape(2, 2))
        assert padded[0, :n] == pytest.approx([g / weight for g in good]) and pairs.sum() == pytest.approx(n - 1)


def test_line_field(spark, frame):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = line_crf.train(docs, labels)
    rows = line_crf.scored(docs, model).select("doc_id", line_crf.held_out().alias("out"), "score").collect()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    tested = [(quality[r.doc_id], r.score >= 0.5) for r in rows if r.doc_id in quality and r.out]
    assert len(rows) == docs.count() and sum(bool(q) == p for q, p in tested) >= 0.9 * len(tested)
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    edge = line_crf.scored(frame(EDGE), model)
    assert edge.columns == ["doc_id", "score"] and all(0 <= r.score <= 1 for r in edge.collect())
    assert line_crf.scored(frame(EDGE).where("doc_id < 0"), model).count() == 0
    kept = line_crf.keep(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score >= 0.5}
    assert line_crf.keep(frame(EDGE), model, 0.0).exceptAll(frame(EDGE)).count() == 0
    alone = line_crf.train(docs, labels.where("quality = 1"))
    assert all(0.5 < s <= 1 for s in line_crf.scores(["text", ""], alone))
    assert line_crf.scores(["text"], line_crf.train(docs, labels.where("doc_id < 0")))[0] <= 0.5


def test_line_field_against_enumeration_of_labels(spark):
    """Document scores from the definition: every labelling of a text's lines, weighed."""
    model = line_crf.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    texts = ["Is and the of it.", "Is and the of it.\n\nAA!! BB!! CC!!\n | x | y | z", "a\nb\na\nb\nlonger line of words, with marks.\n99 $$ 1", "###\n\tThe end."]
    a, b = model["scale"]
    for t, got in zip(texts, line_crf.scores(texts, model), strict=True):
        _, sizes, f = line_crf.line_features([t])
        score, weight, good = f @ model["weights"], 0.0, np.zeros(len(sizes))
        for y in itertools.product((0, 1), repeat=len(sizes)):
            w = math.exp(sum(s for s, k in zip(score, y, strict=True) if k) + sum(model["trans"][j, k] for j, k in itertools.pairwise(y)))
            weight, good = weight + w, good + w * np.array(y)
        z = np.clip((good / weight * sizes).sum() / sizes.sum(), 1e-4, 1 - 1e-4)
        assert got == pytest.approx(1 / (1 + math.exp(-(a * math.log(z / (1 - z)) + b))), abs=1e-6)


def test_line_field_fits_a_very_long_document(spark, frame, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    long = "\n".join(f"Line {i} of a long text, and so on." for i in range(300_000))
    i = next(i for i in range(10**6, 10**6 + 9) if zlib.crc32(str(i).encode()) % 3 != 1)
    more = docs.union(frame([(i, long)]).select("doc_id", "text")), labels.union(spark.createDataFrame([(i, 1)], labels.schema))
    parts = line_crf.chains(*more)
    sizes = [r["sum(n)"] for r in parts.groupBy("doc").sum("n").collect()]
    assert max(sizes) == 300_000 and parts.agg({"n": "max"}).first()[0] == line_crf.PART
    seen, fit = [], line_crf.fit
    monkeypatch.setattr(line_crf, "fit", lambda parts: seen.append(sum(len(p[2]) for p in parts)) or fit(parts))
    model = line_crf.train(*more, lines=20_000)
    assert 10_000 < seen[0] < 30_000 and line_crf.scores(["Line 1 of a long text, and so on.\n" * 3], model)[0] > 0.5


# ---------------------------------------------------------------- 10 languages


def test_languages(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    filters = language_id.train(docs)
    rows = language_id.predict(docs, filters).join(docs.select("doc_id", docs.lang.alias("true")), "doc_id").collect()
    right = [r.lang == r.true for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(right) >= 0.9 * len(right) and len(rows) == docs.count()
    edge = {r.doc_id: (r.lang, r.share) for r in language_id.predict(frame([*EDGE, (9, "1234 !!", "en", "a")]), filters).collect()}
    assert edge[1] == edge[2] == edge[9] == ("und", 0.0) and all(0 <= s <= 1 for _, s in edge.values())
    nothing = language_id.train(docs.where("lang IS NULL"))
    assert {r.lang for r in language_id.predict(frame(EDGE), nothing).collect()} == {"und"}


def test_languages_against_exact_sets(spark):
    """Filters from the definition: sets of n-grams of the sampled documents, and shares counted one n-gram at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL")
    rows = docs.select("doc_id", "text", "lang").collect()

    def grams(t):
        letters = re.sub(r"[^\w]|[\d_]", " ", t.lower())
        out = [f" {' '.join(letters.split())} "]
        return [x[i : i + 3] for x in out for i in range(len(x) - 2) if x[i + 1] != " "] if letters.strip() else []

    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:  # fewer documents a language than SAMPLE: all of them that are not held out
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts[r.lang].update(set(grams(r.text or "")))
            n[r.lang] += 1
    sets = {lang: {g for g, k in c.items() if k >= math.ceil(n[lang] * language_id.SHARE)} for lang, c in counts.items()}
    assert max(n.values()) <= language_id.SAMPLE
    filters = language_id.train(docs)
    code = lambda x: (ord(x[0]) << 42) | (ord(x[1]) << 21) | ord(x[2])
    for k, lang in enumerate(filters.languages):
        bits = (filters.masks(np.array([code(g) for g in sets[lang]], np.uint64))[k // 64] >> np.uint64(k % 64)) & np.uint64(1)
        assert bits.all() and filters.false[k] < 0.001
    found = {r.doc_id: r for r in language_id.predict(docs, filters).collect()}
    for r in rows:
        g = grams(r.text or "")
        shares = {lang: sum(x in s for x in g) / len(g) for lang, s in sets.items()} if g else {}
        if not shares:
            assert found[r.doc_id].lang == "und"
            continue
        best = max(shares.values())
        assert found[r.doc_id].share == pytest.approx(best, abs=0.02) and shares[found[r.doc_id].lang] >= best - 0.02


def test_filters_hold_their_members_and_bound_false_ones():
    rng = np.random.default_rng(4)
    members = [np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64)) for _ in range(70)]
    filters = language_id.Filters([f"l{i:02}" for i in range(70)], members)
    for i in (0, 63, 64, 69):
        bits = (filters.masks(members[i])[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        assert bits.all()
        other = (filters.masks(members[(i + 1) % 70])[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        assert abs(other.mean() - filters.false[i]) < 0.01
    codes, text, has = language_id.grams(["ab c", "", "Ä"])
    code = lambda x: (ord(x[0]) << 42) | (ord(x[1]) << 21) | ord(x[2])
    assert sorted(zip(codes.tolist(), text.tolist(), strict=True)) == sorted([(code(" ab"), 0), (code("ab "), 0), (code(" c "), 0), (code(" ä "), 2)])
    assert has.tolist() == [True, False, True]


# ---------------------------------------------------------------- arrays and registry


# ---------------------------------------------------------------- 11 conversation repair


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw:
            row = (conv, turn, "user" if draw == 4 else role, "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text)
            out += [row] * (2 if draw == 3 else 1)
    return out


def cheapest_repair(turns):
    """By trying everything: of all edits of (role, text, fault) that give (s?(ua)+)?, the cheapest, then the ASCII-least."""
    legal = lambda x: re.fullmatch("s?(ua)*u?", x) is not None
    found = []
    todo = [(0, "", 0, "", ())]
    while todo:
        at, shape, cost, audit, lines = todo.pop()
        if cost > 3 * len(turns):
            continue
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", shape):
            found.append((cost, audit, lines))
        for r in ("user", "assistant"):
            if legal(shape + r[0]):
                todo.append((at, shape + r[0], cost + 2, audit + "I", (*lines, f"{r}:")))
        if at < len(turns):
            role, text, fault = turns[at]
            todo.append((at + 1, shape, cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                for r, c, letter in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                    if legal(shape + r[:1]) and r[:1]:
                        todo.append((at + 1, shape + r[0], cost + c + extra, audit + letter, (*lines, f"{r}:{text}")))
    return min(found)


def repaired_by_hand(rows):
    out = {}
    kept = collections.defaultdict(list)
    for r in damage(rows):
        kept[r[0]].append(r)
    for conv in {r[0] for r in rows}:
        mine = sorted(kept[conv], key=lambda r: ((r[1] is not None, r[1] or 0), r[2], r[3]))
        seen, turns = set(), []
        for _, _, role, text in mine:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = [r[1] for r in mine if r[1] is not None]
        count = collections.Counter(t[2] for t in turns)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = cheapest_repair(turns)
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, list(lines))
    return out


def test_conversation_repair(spark):
    rng = random.Random(21)
    rows = []
    for conv in range(90):
        n = rng.randrange(1, 5)
        for turn in sorted(rng.sample(range(9), n)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None])
            rows.append((conv, turn, role, rng.choice(["yes.", "no!", "well", "", " \n", None, "why? ", "yes.", "ünd.", f"t{rng.randrange(3)}."])))
    rows += [(500, None, "user", "a."), (500, 3, "assistant", "b."), (500, 3, "assistant", "b."), (500, 3, "user", "c"), (None, 1, "user", "x."), (None, 7, None, None), (501, None, None, None), (502, 0, "system", "s."), (502, 9, "user", "q?")]
    rows += [(k, 0, "user", "only.") for k in range(600, 900) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][:3]  # nothing is left of them
    df = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, cost string").repartition(3)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired) for r in conversation_repair.repair(conversation_repair.damaged(df)).collect()}
    assert got == repaired_by_hand(rows)
    assert any(x[:7] == (0, 0, 0, 0, 0, 0, "") for x in got.values())
    assert conversation_repair.repair(conversation_repair.damaged(df.where("conv_id < 0"))).count() == 0


def test_long_conversation(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(3000)]
    row = conversation_repair.repair(conversation_repair.damaged(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    assert re.fullmatch("(?:user|assistant):.*", row.repaired[0]) and [x[0] for x in row.repaired] == ["u", "a"] * (len(row.repaired) // 2)
    assert len(row.audit) >= len(damage(turns)) and row.gaps == 2998 + 1 + 1 - len({t for _, t, *_ in damage(turns)}) - (2999 - max(t for _, t, *_ in damage(turns))) - min(t for _, t, *_ in damage(turns))


def test_conversation_repair_matches_sql(spark):
    agrees_with_sql(spark, conversation_repair.query, conversation_repair.SQL, SF)


# ---------------------------------------------------------------- 12 source divergence


def divergence(docs, least, top):
    """By counting everything."""
    term = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    df, n, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in docs:
        lang, source, found = lang or "", source or "", [x.translate(lower) for x in term.findall(text or "")]
        groups.add((lang, source))
        df.update((lang, x) for x in set(found))
        n.update((lang, source, x) for x in found)
    rows = []
    for lang in {g[0] for g in groups}:
        kept = [x for (g, x), c in df.items() if g == lang and c >= least]
        sources = [s for g, s in groups if g == lang]
        share = lambda count, total: 1 + (1_000_000_000 * (count + 5)) // (total + 5 * len(kept))  # noqa: B023, E731
        p = {s: {x: share(n[lang, s, x], sum(n[lang, s, y] for y in kept)) for x in kept} for s in sources}
        whole = {x: sum(n[lang, s, x] for s in sources) for x in kept}
        q = {x: share(whole[x], sum(whole.values())) for x in kept}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][x] - p[o][x]) for x in kept), o.encode()) for o in sources if o != s))
            terms = sorted((q[x] - p[s][x], x.encode()) for x in kept if n[lang, s, x] and p[s][x] > q[x])
            rows += [(lang, s, part, item.decode(), -value, k) for part, found in (("pair", pairs), ("term", terms[:top])) for k, (value, item) in enumerate(found, 1)]
    return sorted(rows)


def test_source_divergence(frame, monkeypatch):
    rng = random.Random(22)
    words = [f"{a}{b}" for a in ("the", "Zebra", "ärger", "ÄRGER", "x", "中文", "K") for b in "abcdefghij"] + ["same" + "long" * 9 + x for x in "abcdefgh"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60))) + rng.choice(["", "1x2", "_a-b", "\x7fq"]), rng.choice(["en", "de", None, "fr"]), rng.choice(["a", "b", "c", "é", None, ""])) for i in range(500)]
    docs += [(900, None, "none", "x"), (901, "", "none", "y"), (902, "few words here", "rare", "z"), (903, "one two " * 40_000, "en", "a"), (904, "one two " * 3, None, None)]
    docs += docs[:3]
    # ties of many terms, cut by their bytes
    docs += [(2000 + i, " ".join(f"tie{k:03d}" for k in range(120)), "tie", "t" if i < 20 else "u") for i in range(40)] + [(3000, "more words", "tie", "u")]
    monkeypatch.setattr(source_divergence, "HELD", 50)
    monkeypatch.setattr(source_divergence, "PIECE", 997)
    for least, top in ((30, 50), (5, 7)):
        monkeypatch.setattr(source_divergence, "LEAST", least)
        df = frame(docs)
        got = sorted(map(tuple, source_divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())) if top == 50 else None
        want = divergence([d[1:] for d in docs], least, 50)
        if got is not None:
            assert got == want
    assert source_divergence.audit(frame(docs).where("doc_id < 0")).count() == 0


def test_radix_selection_against_sorting(spark):
    rng = random.Random(23)
    rows = [("l", "ties", f"same{k:04d}", 7) for k in range(3000)] + [("l", "few", f"t{k}", k) for k in range(9)] + [("m", "ties", chr(200 + k % 900) * (1 + k // 900), rng.choice([5, 5, 5, (1 << 30) - 1, 1])) for k in range(1800)]
    rows += [("l", "spread", f"w{k}", rng.randrange(1 << 30)) for k in range(3000)] + [("l", "begins", "a" * k, 3) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "lang string, source string, term string, value long").repartition(4)
    for most in (50, 5):
        got = collections.defaultdict(list)
        for r in source_divergence.top_values(df, most).collect():
            got[r.lang, r.source].append((-r.value, r.term.encode()))
        for g in {r[:2] for r in rows}:
            assert sorted(got[g]) == sorted((-v, t.encode()) for *x, t, v in rows if tuple(x) == g)[:most]


def test_terms_of_pieces(monkeypatch):
    rng = random.Random(24)
    for _ in range(200):
        text = "".join(rng.choice("aB é中1-\n ") for _ in range(rng.randrange(0, 60)))
        whole = [x for part in source_divergence.terms_of(text) for x in part]
        monkeypatch.setattr(source_divergence, "PIECE", rng.randrange(1, 9))
        assert [x for part in source_divergence.terms_of(text) for x in part] == whole
        monkeypatch.setattr(source_divergence, "PIECE", 1 << 22)


def test_source_divergence_matches_sql(spark):
    agrees_with_sql(spark, source_divergence.query, source_divergence.SQL, SF)


# ---------------------------------------------------------------- 13 embedding near-dedup


def linked_by_hand(rows, threshold=0.93):
    ok = lambda v, g: g is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    vecs = [np.array(v, float) / np.abs(np.array(v, float)).max() if ok(v, g) else None for _, v, g in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = vecs[i], vecs[j]
        if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
            links[i], links[j] = links[i] + 1, links[j] + 1
            parent[find(i)] = find(j)
    heads = collections.defaultdict(list)
    for i, r in enumerate(rows):
        heads[find(i)].append(r[0])
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return sorted(((r[0], links[i], least(heads[find(i)]), r[0] == least(heads[find(i)])) for i, r in enumerate(rows)), key=str)


def vectors(rng, n, dim, crowds=()):
    found = [rng.normal(size=dim) for _ in range(n)]
    for k in range(0, n // 4, 2):
        found[k + 1] = found[k] + rng.normal(size=dim) * 0.3 * rng.random()
    for size, noise in crowds:
        centre = rng.normal(size=dim)
        found += [centre + rng.normal(size=dim) * noise for _ in range(size)]
    return [[float(np.float32(x)) for x in v] for v in found]


def test_near_vectors(spark):
    rng = np.random.default_rng(25)
    rows = [(i, v, 1) for i, v in enumerate(vectors(rng, 120, 16, [(40, 0.1)]))]
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [3e38] * 16, [1e-44] * 16, [2.0] * 16, [1.0] * 8]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(2000 + i, rows[i][1], g) for i, g in enumerate([1, 1, 2, 2, None, None])] + [(2000, rows[0][1], 1), (None, rows[3][1], 1), (None, [-1.0] * 16, 1), (3000, [-x for x in rows[5][1]], 1), (3001, [2 * x for x in rows[5][1]], 1)]
    df = spark.createDataFrame([(*r, "more") for r in rows], "vec_id long, embedding array<float>, label int, node string").repartition(3)
    got = sorted((tuple(r) for r in near_vectors.near(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == linked_by_hand(rows)
    assert near_vectors.near(df.where("vec_id < 0")).count() == 0
    assert near_vectors.near(df.where("vec_id = 1000")).first()["kept"]


@pytest.mark.parametrize(("most", "crowds"), [(64, [(150, 0.05)]), (60, [(30, 0.2), (90, 0.16)])])
def test_near_vectors_in_small_shards(spark, most, crowds):
    """Groups far larger than a shard: tight crowds become balls, looser ones are parted or dealt into blocks."""
    rng = np.random.default_rng(most)
    rows = [(i, v, i % 2) for i, v in enumerate(vectors(rng, 300, 24, crowds))]
    want = linked_by_hand(rows)
    got = near_vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), most=most).collect()
    links = {r.vec_id: r.n_links for r in got}
    assert len(got) == len(rows) and all(links[i] <= n for i, n, *_ in want)
    assert sum(links.values()) >= 0.97 * sum(n for _, n, *_ in want)


def test_flat_graph_recall_and_pruning():
    rng = np.random.default_rng(26)
    units = np.array(vectors(rng, 500, 32, [(120, 0.1)]), np.float32)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    adjacent = flat_graph.build(units)
    a, b = flat_graph.in_range(units, adjacent, flat_graph.medoid(units), 0.93)
    true = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(units @ units.T >= 0.93, 1)), strict=True)}
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    assert found <= true | {(i, j) for i, j in found if units[i] @ units[j] > 0.93 - 1e-6} and len(found & true) >= 0.99 * len(true)
    assert all(len(set(x[x >= 0])) == (x >= 0).sum() and k not in x for k, x in enumerate(adjacent))
    # of two candidates in one direction only the nearer is kept
    near = np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [0, 1]], float)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    likes = near @ near[0]
    assert flat_graph.pruned(near, np.array([0]), np.array([[1, 2, 3]]), likes[None, 1:], 3)[0].tolist() == [1, 3, -1]


def test_near_vectors_match_sql(spark):
    agrees_with_sql(spark, near_vectors.query, near_vectors.SQL, SF)


# ---------------------------------------------------------------- names that differ in case


def test_names_that_differ_in_case(spark):
    df = spark.createDataFrame([(i, f"word{i % 7} " * 60, "other", "en", "s") for i in range(30)], "doc_id long, text string, Text string, lang string, source string")
    taken = mixing.repeated(df)
    assert taken.columns == df.columns and {r[2] for r in taken.collect()} == {"other"}
    assert near_pairs.one_of_each(df).columns == df.columns and near_pairs.join(df).count() == 30
    assert quality_rules.keep_good(df).columns == df.columns and sharding.shard(df, [1.0] * 3).count() == 30
    assert source_divergence.audit(df).count() > 0 and mixing.mix(df)[0].count() == 30
    assert common.case_safe()(lambda x: x.columns)(df.select("Text", "text", "doc_id")) == ["Text (0)", "text", "doc_id"]


def test_scratch_tables_have_small_row_groups(spark, tmp_path):
    """What a writing task holds in its heap does not grow with what it writes."""
    text = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.sha2(F.concat_ws(" ", "id", i), 256)))
    assert common.write_table(spark.range(0, 4000, 1, 1).select("id", text.alias("text")), str(tmp_path / "texts")).count() == 4000
    (path,) = (tmp_path / "texts").glob("*.parquet")
    groups = [pq.read_metadata(path).row_group(i) for i in range(pq.read_metadata(path).num_row_groups)]
    sizes = [sum(g.column(i).total_compressed_size for i in range(g.num_columns)) for g in groups]
    assert len(sizes) > 1 and max(sizes) < 20 << 20


def test_text_arrays():
    texts = ["a b  b\n", "", "é😀 x\x85y", "  ", "ab a", "b" * 3000]
    t = textarrays.Texts(texts)
    words = [["".join(map(chr, t.codes[s:e])) for s, e in zip(t.word_starts[a:b], t.word_ends[a:b], strict=True)] for a, b in itertools.pairwise(t.first_word)]
    assert words == [WORD.findall(x) for x in texts]
    h, flat = t.word_hashes(), [w for ws in words for w in ws]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    assert list(textarrays.chunks(["x" * 10] * 5, 25)) == [(0, 2), (2, 4), (4, 5)]


def test_registry():
    assert [n.split("_")[0] for n in sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, sizes = docs.columns, []
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        rows = docs.collect()
        assert docs.columns == columns and rows, name
        sizes.append(len(rows))
        if name == "quality_classifier":
            assert sum(labels.get(r.doc_id) == 0 for r in rows) == 0
        if name == "near_duplicates":
            assert len({shingles(r.text) for r in rows}) == len(rows)
    assert sizes[0] >= sizes[1] >= sizes[2] and sizes[3] > sizes[2]
    packed = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in packed) == sizes[-1]
