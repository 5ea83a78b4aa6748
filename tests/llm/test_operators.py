"""Corpus operators against brute force, on small whole tables with nulls, repeats, empties and extra columns."""

import base64
import collections
import gzip
import hashlib
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm import ann, bpe, gru_lm, jaccard_join, line_dedup, ngram_quality, packing, queries, quality_rules, suffix_dedup, warc
from touchline.llm.base import connected, shared_dir

SMALL = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    return {r.doc_id: (r.text or "").encode() for r in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, copies and a clashing extra column."""
    long = " ".join(f"w{i % 700}" for i in range(1500))
    rows = [(1, None, None, None, 1), (2, "", "en", "s", 2), (3, "one", "en", "s", 3), (3, "one", "en", "s", 3), (4, long, "en", "s", 4), (5, long, "en", None, 5), (6, long + " end", None, "s", 6), (None, "lost words here", "en", "s", 7), (7, "same id", "en", "s", 8), (7, "other text", "en", "s", 9)]
    return spark.createDataFrame([(*r, 0) for r in rows], DOC + ", n_words int")


def test_connected(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (140, 2))]
    root = {v: v for p in pairs for v in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    linked = {v for a, b in pairs if a != b for v in (a, b)}
    got = {r.id: r.comp for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: r for v, r in root.items() if v in linked}


# -- quality rules


def brute_counts(text):
    words = text.split()
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(words), sum(len(w.decode()) for w in words), sum(text.decode().count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_verdicts(spark, docs):
    rows = quality_rules.quality_rules(docs).collect()
    texts = texts_of(docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for r in rows:
        want = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
        if labels.get(r.doc_id) == 1 and not r.base_failed:
            assert r.kept


def test_quality_distances_equal_numpy(spark):
    """The fitted scatter is that of a concentrated subset: outliers planted in a normal cloud don't move it."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (900, quality_rules.P)) + 3
    x[:90] += 40
    cols = ["doc_id", "grp", *quality_rules.FEATURES]
    df = spark.createDataFrame([(i, "g", *map(float, v)) for i, v in enumerate(x)], "doc_id long, grp string, " + ", ".join(f"{c} double" for c in quality_rules.FEATURES))
    p = quality_rules.mcd(df.select(*cols)).first()
    mean = np.array([p[f"m{i}"] for i in range(quality_rules.P)])
    assert np.abs(mean - x[90:].mean(0)).max() < 0.3
    d = x - mean
    inv = np.array([[p[f"q{min(i, j)}_{max(i, j)}"] for j in range(quality_rules.P)] for i in range(quality_rules.P)])
    d2 = np.einsum("ni,ij,nj->n", d, inv, d) / p["scale"]
    assert d2[:90].min() > quality_rules.CUTOFF > d2[90:].max()


def test_quality_odd_rows(spark, odd):
    rows = quality_rules.quality_rules(odd).collect()
    assert len(rows) == 10 and {r.n_words for r in rows if r.doc_id in (1, 2)} == {0}
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns
    extra = odd.selectExpr("*", *(f"n_words AS {c}" for c in ("kept_doc_id", "_kept_doc_id", "Kept_Lang", "kept_source", "kept_text_key", "text_key", "grp", "kept")))
    got = quality_rules.keep_good(extra)
    assert got.columns == extra.columns and got.count() == quality_rules.keep_good(odd).count()


# -- line dedup


def brute_line_dedup(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows.items()):
        lines, chunks, chunk, last = text.split("\n"), [], [], 0
        for i, x in enumerate(lines):
            h = int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
            chunk.append(x)
            if ((h * 31 + last * 17) % line_dedup.MODULUS) % line_dedup.DIVISOR == 0 or i == len(lines) - 1:
                chunks.append(chunk)
                chunk = []
            last = h
        kept = []
        for c in chunks:
            t = "\n".join(c)
            if sum(bool(x.strip(" ")) for x in c) >= 2:
                if t in seen:
                    continue
                seen.add(t)
            kept += c
        out[doc] = "\n".join(kept)
    return out


def test_line_dedup_equals_brute_force_and_sql(spark, docs):
    got = {r.doc_id: r for r in queries.op2_line_dedup(spark, SMALL).collect()}
    want = brute_line_dedup({k: v.decode() for k, v in texts_of(docs).items()})
    assert {k: r.text for k, r in got.items()} == want
    names = ("line_d", "_line_d", "LINE_TH", "line_of_d", "line_of_th", "line_gone", "line_cut", "d", "th", "k", "h", "chunk", "gone", "__line_d")
    extra = line_dedup.line_dedup(docs.select("doc_id", "text", *(F.lit(1).alias(n) for n in names)))
    assert {r.doc_id: r.text for r in extra.collect()} == want and set(names) <= set(extra.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    assert {r[0]: r[1] for r in con.execute(line_dedup.ORACLE).fetchall()} == want


def test_line_dedup_shifted_chunks_and_odd_rows(spark, odd):
    block = "\n".join(f"line {i} of a passage" for i in range(60))
    df = spark.createDataFrame([(1, block, 0), (2, "new first\n" + block, 0), (None, None, 0)], "doc_id long, text string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    assert got[1].text == block and got[2].n_removed_lines > 45 and got[2].text.startswith("new first") and got[None].text is None
    assert line_dedup.line_dedup(odd).count() == 10 and line_dedup.line_dedup(odd.limit(0)).count() == 0


# -- WARC


def test_warc_round_trip_and_members(spark):
    rows = [(1, "http://a/?q=x y\r\nz", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "x" * 100_000), (6, "http://e", "y")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, record_type string").repartition(2)
    folder = f"{shared_dir(spark)}/warc-test"
    got = {r.page_id: r for r in warc.warc_round_trip(pages, folder, with_payload=True).collect()}
    for page, _, html in rows:
        payload = (html or "").encode()
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        top = max(p for p, _, h in rows if (h or "") == (html or ""))
        assert (r.record_type, r.refers_to) == (("response", None) if page == top else ("revisit", top))
        assert r.payload == (payload if page == top else None)
    for f in (__import__("pathlib").Path(folder.removeprefix("file://")) / "members").glob("*.warc.gz"):
        data = f.read_bytes()
        for line in f.with_name(f.name + ".idx").read_text().splitlines():
            offset, length, record_id, _ = line.split("\t")
            member = gzip.decompress(data[int(offset) : int(offset) + int(length)])
            assert record_id.encode() in member.split(b"\r\n\r\n")[0]
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


# -- packing


def test_word_encoder_equals_the_library():
    lib, own = Tokenizer.from_file(VOCAB), packing.WordEncoder(VOCAB)
    odd_texts = ["", " ", "a  b", "a\n\nb c\n d", "tab\tx <|endoftext|> y", " lead", "trail ", "it's 12345 don't", "日本 é\xa0z", "a\nb\n"]
    for t in odd_texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_packing_is_whole_and_gapless(spark, docs):
    rows = packing.best_fit_packing(docs, VOCAB).collect()
    lib, by_doc, by_seq = Tokenizer.from_file(VOCAB), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    total = 0
    for doc, text in texts_of(docs).items():
        ids = lib.encode(text.decode(), add_special_tokens=False).ids + [0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > 2048 or len(by_doc[doc]) == 1)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_seq) <= math.ceil(total / 2048) + 2


def test_packing_genetics():
    rng = np.random.default_rng(2)
    sizes = rng.integers(300, 1500, 300).tolist()
    first = packing.Packing(sizes, 2048)
    first.best_fit(sorted(range(300), key=lambda i: -sizes[i]))
    people = packing.evolve(sizes, [], 2048, 1, 30)
    again = packing.evolve(sizes, people, 2048, 2, 30)
    for labels in again:
        assert np.bincount(labels, weights=sizes).max() <= 2048
    assert len(set(again[0].tolist())) <= len(set(people[0].tolist())) <= len(first.bins)


def test_packing_odd_rows(spark, odd):
    rows = packing.best_fit_packing(odd, VOCAB).collect()
    assert sorted(r.length for r in rows if r.doc_id in (1, 2)) == [1, 1]
    assert sum(r.doc_id is None for r in rows) == 1
    assert packing.best_fit_packing(odd.limit(0), VOCAB).count() == 0


# -- Jaccard join


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_on_documents(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute_components(texts_of(docs), 4, 85)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard_on_edited_families(spark, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = {}
    for base in range(14):
        words = [f"b{base}x{i}" for i in range(int(rng.integers(1, 150)))]
        for _ in range(int(rng.integers(1, 30))):
            w = list(words)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 10**9)}"
            rows[len(rows) * 7 % 1009] = " ".join(w[int(rng.integers(0, 2)) :])
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, width, percent).collect()}
    assert got == brute_components({k: v.encode() for k, v in rows.items()}, width, percent)


@pytest.mark.parametrize("block", [8, 4096])
def test_family_of_many_sizes(spark, monkeypatch, block):
    """A family whose sets differ widely in size keeps every link, in one block or in many."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = np.random.default_rng(8)
    pool = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    sets = {i: pool[: int(rng.integers(1, 200))] for i in range(120)}
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "id long, tokens binary")
    got = jaccard_join.family_links(rows.select("id", F.lit(0).cast("long").alias("comp")), rows, 80, 4).collect()
    assert all(100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])) for a, b in got)

    def groups(pairs):
        root = {i: i for i in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return {i: find(i) for i in sets}

    every = [(a, b) for a in sets for b in sets if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert groups((r.a, r.b) for r in got) == groups(every)


def test_pigeonhole_never_misses():
    """Whatever few shingles two sets differ in, a probe of the larger meets an index entry of the smaller."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = rng.integers(0, jaccard_join.differences(len(a), len(a), 85) + 1)
        b = np.concatenate([a[drop // 2 :], rng.integers(0, 1 << 63, int(drop) - int(drop) // 2, dtype=np.uint64)])
        b = np.unique(b)
        common = len(np.intersect1d(a, b))
        if 100 * common < 85 * (len(a) + len(b) - common):
            continue
        big, small = (a, b) if len(a) >= len(b) else (b, a)
        kb, ks = jaccard_join.keys_of(big), jaccard_join.keys_of(small)
        probes, entries = kb[kb & np.uint64(2) > 0] >> np.uint64(2), ks[ks & np.uint64(1) > 0] >> np.uint64(2)
        assert len(np.intersect1d(probes, entries)), (len(a), len(b))


def test_jaccard_odd_rows(spark, odd):
    got = [(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(odd).collect()]
    assert len(got) == 10 and (5, 4) in got and (6, 4) in got and (None, None) in got and (1, 1) in got
    assert jaccard_join.jaccard_components(odd.limit(0)).count() == 0
    assert {r.doc_id for r in jaccard_join.one_of_each(odd).collect()} == {None, 1, 2, 3, 4, 7}


# -- suffix dedup


def brute_suffix(texts, least):
    seen, out = set(), {}
    for i, b in sorted(texts.items()):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - least + 1):
            if b[p : p + least] in seen:
                gone[p : p + least] = True
            seen.add(b[p : p + least])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def digests(df, least=100):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df, least).collect()}


def test_suffix_on_documents(spark, docs):
    assert digests(docs.select("doc_id", "text")) == brute_suffix(texts_of(docs), 100)


def test_suffix_on_periodic_crowded_and_shifted_texts(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 4, n))
    common, passage = word(60), word(260)
    rows = {i: word(90) + common + word(90) for i in range(60)}
    rows |= {100: "ab" * 400, 101: "x" * 350, 102: "ab" * 300 + "c", 103: passage, 104: word(30) + passage[5:] + word(10), 105: passage + passage, 106: "é" * 120, 107: "\0" * 150, 108: passage}
    rows |= {200 + i: passage[: 100 + i] + word(20) for i in range(40)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert digests(df) == brute_suffix({k: v.encode() for k, v in rows.items()}, 100)


def test_suffix_odd_rows(spark, odd):
    got = suffix_dedup.suffix_dedup(odd).collect()
    assert len(got) == 10 and {r.doc_id: r.text for r in got}[5] == "" and all(r.n_removed == 0 for r in got if r.doc_id in (1, 2, 3, 7))
    assert suffix_dedup.suffix_dedup(odd.limit(0)).count() == 0


# -- nearest neighbours


def exact(x, ids, q, k):
    s = x @ x[q]
    s[ids == ids[q]] = -np.inf
    order = np.lexsort((ids, -s))[:k]
    return [(int(ids[i]), float(s[i])) for i in order if np.isfinite(s[i])]


def test_ann_recall_and_order(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[:300] = x[0]  # a hot vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), 10, 100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    ids = np.arange(3000)
    for q in range(0, 3000, 50):
        want = exact(x.astype(float), ids, q, 10)
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True) and len(got[q]) == 10
        assert all(abs(s - float(x[v].astype(float) @ x[q].astype(float))) < 1e-9 for v, s in got[q])
        hit += len({v for v, _ in want} & {v for v, _ in got[q]})
    assert hit / 600 >= 0.9


def test_ann_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.5, 0.5]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [2.0, 0.0]), (8, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect()]
    assert sorted(got) == [(20, 1, 1, 2.0), (20, 2, 6, 1.0), (20, 3, 8, 1.0)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


# -- language models


def test_kneser_ney_equals_brute_force(spark):
    """Probabilities of a small table against a dictionary model, and each context sums to one."""
    good = [b"abab", b"abcab", b"bcabab"]
    n = ngram_quality.ORDER
    codes, _ = ngram_quality.codes_of(good)
    counts = collections.Counter(codes.tolist())
    tables = {n: counts}
    for k in range(n - 1, 0, -1):
        tables[k] = collections.Counter(c & ((1 << 8 * k) - 1) for c in tables[k + 1])
    disc = {}
    for k, t in tables.items():
        f = collections.Counter(t.values())
        y = f[1] / (f[1] + 2 * f[2])
        d = [min(max(j - (j + 1) * y * f[j + 1] / f[j], 0.1), j - 0.1) if f[j] else 0.5 for j in (1, 2, 3)]
        disc[k] = d

    def prob(code, k):
        if k == 0:
            return 1 / 256
        t, ctx = tables[k], code >> 8
        mine = {c: v for c, v in t.items() if c >> 8 == ctx}
        low = prob(code & ((1 << 8 * (k - 1)) - 1), k - 1)
        if not mine:
            return low
        d = lambda v: disc[k][min(v, 3) - 1]
        own = mine.get(code, 0)
        return ((own - d(own)) if own else 0) / sum(mine.values()) + sum(map(d, mine.values())) / sum(mine.values()) * low

    asked = sorted({int(c) for c in ngram_quality.codes_of([*good, b"cabx"])[0]})
    df = spark.createDataFrame([("en", c) for c in asked], "lang string, code long")
    table = spark.createDataFrame([("en", c, v) for c, v in counts.items()], "lang string, code long, c long")
    got = {r.code: r.p for r in ngram_quality.probabilities(df, ngram_quality.count_tables(table)).collect()}
    assert got == pytest.approx({c: prob(c, n) for c in asked})
    ctx = asked[3] >> 8
    assert sum(prob((ctx << 8) | b, n) for b in range(256)) == pytest.approx(1.0)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op1_quality_classifier(spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    kept = collections.Counter((q, got[d].kept) for d, q in labels)
    assert kept[1, False] <= 0.02 * (kept[1, True] + kept[1, False])
    assert kept[0, False] >= 0.6 * (kept[0, True] + kept[0, False])


def test_classifier_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = ngram_quality.quality_classifier(odd, labels).collect()
    assert len(rows) == 10 and all(r.perplexity > 1 and r.n_bytes > 0 for r in rows)  # the model tells it, however few are trusted
    assert all(r.kept for r in rows if r.threshold is None)
    assert ngram_quality.quality_classifier(odd.limit(0), labels).count() == 0


def test_gru_gradient_is_numeric():
    rng = np.random.default_rng(7)
    v = gru_lm.Vocabulary([(i, 5) for i in range(40)], {(1, 0): (3, 3, 3), (2, 1): (2, 6, 1)}, 500, 60, 9)
    m = gru_lm.Model(gru_lm.Model.fresh(v).weights.astype(np.float64))
    m.bh[:] = rng.normal(0, 0.1, m.bh.shape)
    x, y = rng.integers(0, gru_lm.START_ID, (4, 3)), rng.integers(0, gru_lm.START_ID, (4, 3))
    live = np.array([[1, 1, 1], [1, 1, 0], [1, 1, 0], [1, 0, 0]], bool)
    h0 = rng.normal(0, 0.5, (3, gru_lm.HIDDEN))

    def loss():
        h, total = h0, 0.0
        for t in range(4):
            new = m.step(x[t], h)[0]
            h = np.where(live[t][:, None], new, h)
            total -= m.log_probs(h[live[t]], y[t][live[t]]).sum()
        return total

    grad, _ = m.gradient(x, y, live, h0)
    for i in [*rng.integers(0, len(grad), 60), *np.argsort(-np.abs(grad))[:20]]:
        keep = m.weights[i]
        m.weights[i] = keep + 1e-5
        up = loss()
        m.weights[i] = keep - 1e-5
        down = loss()
        m.weights[i] = keep
        assert (up - down) / 2e-5 == pytest.approx(grad[i], abs=1e-5, rel=1e-4)


def test_gru_distribution_sums_to_one_and_state_is_carried():
    v = gru_lm.Vocabulary([(i, 5) for i in range(gru_lm.HEAD)], {(e, g): (2, 2 + g * 8, 2) for e in range(16) for g in range(3)}, 500, 60, 9)
    m = gru_lm.Model.fresh(v)
    h = np.random.default_rng(8).normal(0, 1, (1, gru_lm.HIDDEN)).astype(np.float32)
    targets = np.r_[np.arange(gru_lm.HEAD), gru_lm.HEAD + np.arange(gru_lm.TAIL), gru_lm.END_ID]
    assert np.exp(m.log_probs(np.repeat(h, len(targets), 0), targets)).sum() == pytest.approx(1.0, abs=1e-4)
    long = [np.r_[gru_lm.START_ID, np.arange(100) % 500, gru_lm.END_ID], np.array([gru_lm.START_ID, gru_lm.END_ID])]
    whole = gru_lm.log10_of(m, long)
    h, total = np.zeros((1, gru_lm.HIDDEN), np.float32), 0.0
    for a, b in zip(long[0], long[0][1:]):
        h = m.step(np.array([a]), h)[0]
        total += m.log_probs(h, np.array([b]))[0]
    assert whole[0] == pytest.approx(total / np.log(10), rel=1e-4)


def test_lm_scores_base_and_held_out_gain(spark, docs, odd):
    rows = gru_lm.lm_scores(docs).collect()
    texts = {k: v.lower().split() for k, v in texts_of(docs).items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    c = collections.Counter(w for k, ws in texts.items() if not held[k] for w in ws)
    n_docs = sum(not x for x in held.values())
    total, types = sum(c.values()) + n_docs, len(c) + 1
    log = lambda n: math.log10((n + 0.5) / (total + 0.5 * (types + 1)))
    for r in rows:
        ws = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (held[r.doc_id], len(ws) + 1, total, sum(c[w] > 0 for w in ws) + 1)
        assert r.base_score == pytest.approx(sum(log(c[w]) for w in ws) + log(n_docs))
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    got = gru_lm.lm_scores(odd).collect()
    assert len(got) == 10 and all(math.isfinite(r.score) for r in got)
    assert gru_lm.lm_scores(odd.limit(0)).count() == 0
