"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on the awkward rows."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from folioscope.llm import exact_dedup, language_id, lattice_lm, license_scan, media, near_dedup, packing, piece_bpe, queries, token_files, toxicity
from folioscope.llm.components import components
from folioscope.llm.piece_encoder import Encoder

SF = "/root/testdata/sf0.001"
BPE, WORDS, PIECES = (queries.tokenizer(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, sig string, token string, row long, keep_id long, n_bytes long, bucket string"


def near(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def texts():
    rng = random.Random(3)
    base = [f"alpha{rng.randrange(500)}" for _ in range(150)]
    out = [None, "", " ", "  a\tb\n", "a b ", "A B", "12 34 !!", "one two three", "One two THREE", "x" * 3000, "word " * 20_000]
    out += [" ".join(base)] * 3 + [" ".join(base).upper()] + [near(base, rng, k) for k in (1, 1, 2, 3, 4, 6, 9) for _ in range(3)]
    out += ["Licensed under the Apache License, Version 2.0.", "é à ñandú ½ x² 日本語 😀 n b\x1cc", "  lead trail  ", "▁ ▁x"]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    return [(i * 7 % 101 if i else None, x) for i, x in enumerate(t)] + [(7, t[1]), (None, "one two three"), (14, t[2])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "t", 1, 2, 3, "b") for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_media(docs, rows, empty):
    got = sorted(((r.doc_id is None, r.doc_id, r.payload_sha256, r.n_bytes, r.tail_crc32, r.payload_bytes) for r in media.media_columns(docs).collect()), key=str)
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        want.append((i is None, i, hashlib.sha256(p).hexdigest(), len(raw), zlib.crc32(p[-16:]), len(p)))
    assert got == sorted(want, key=str)
    assert media.media_columns(empty).count() == 0


def test_png_filters_and_checksums():
    rng = np.random.RandomState(0)
    img = rng.randint(0, 256, (10, 192)).astype(np.uint8)
    rows = np.empty((10, 193), np.uint8)
    for y in range(10):
        kind, above = y % 5, img[y - 1] if y else np.zeros(192, np.uint8)
        left = np.concatenate(([0], img[y, :-1]))
        corner = np.concatenate(([0], above[:-1]))
        guess = []
        for a, b, c in zip(left.tolist(), above.tolist(), corner.tolist()):
            p = a + b - c
            near_ = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            guess.append([0, a, b, (a + b) // 2, near_][kind])
        rows[y, 0], rows[y, 1:] = kind, (img[y].astype(int) - guess) % 256
    assert (media.unfilter(rows) == img).all()
    png = media.encode_png(img.tobytes())
    assert (media.decode_png(png) == img).all()
    for at in (3, 20, 60, len(png) - 2):
        with pytest.raises(media.MediaError):
            media.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(media.MediaError):
        media.decode_png(png[:-12])


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_dedup(docs, rows, empty, bits):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    ids = defaultdict(list)
    for (i, _), n in zip(rows, norm):
        ids[n].append(i)
    keep = {n: min((i for i in v if i is not None), default=None) for n, v in ids.items()}
    want = [(i, keep[n], len(ids[n]), i == keep[n], hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm)]
    got = [tuple(r) for r in exact_dedup.exact_groups(docs, digest_bits=bits).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_semi_joins_beyond_the_filter(spark, docs, rows, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 0)
    assert sorted(map(str, exact_dedup.exact_groups(docs).collect())) == want
    assert {r.doc_id for r in exact_dedup.without(docs, spark.createDataFrame([(7,), (14,)], "doc_id long")).collect()} == {i for i, _ in rows} - {7, 14}


@pytest.mark.parametrize("most", [0, 1 << 28])
def test_digest_index_takes_batches(docs, empty, most, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_BITS", most)
    parts = [exact_dedup.flush_runs(x) for x in (docs.where("doc_id < 50"), docs.where("doc_id >= 50 or doc_id is null"), empty)]
    level = exact_dedup.compact(parts[0])
    earlier = {bytes(r.digest): (r.keep_id, r.group_size) for r in level.collect()}
    batch = {bytes(r.digest) for r in parts[1].collect()}
    assert {bytes(r.digest): (r.keep_id, r.group_size) for r in exact_dedup.known(level, parts[1]).collect()} == {d: x for d, x in earlier.items() if d in batch}
    for p in parts[1:]:
        level = exact_dedup.compact(p, level)
    assert sorted(map(str, level.collect())) == sorted(map(str, exact_dedup.compact(exact_dedup.flush_runs(docs)).collect()))


def test_language_held_out(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_of(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    awkward = {(r.doc_id, r.lang_pred) for r in language_id.language_of(docs).collect()}
    assert (None, "und") in awkward and (6 * 7, "und") in awkward
    assert language_id.language_of(empty).count() == 0


def test_language_counts_by_brute_force(spark):
    """Trigram counts of every row, letters beyond the basic plane among them, against plain loops; these letters have a language."""
    own = [("en", "The cat, the hat"), ("en", "a𝐀𠀀 b1c"), ("fr", "Été d'été"), ("fr", ""), ("fr", "12 😀")]
    want = Counter()
    for lang, text in own:
        s = [0, *map(language_id.symbol, text), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            if b:
                want[lang, (a * language_id.SYMBOLS + b) * language_id.SYMBOLS + c] += 1
    rows = language_id.count_trigrams(spark.createDataFrame(own, "lang string, text string")).collect()
    assert {(r.lang, r.cell): r.n for r in rows} == want
    model = language_id.LanguageModel.from_counts([tuple(r) for r in rows])
    assert model.predict("𝐀𠀀")[0] == "en" and model.predict("12 😀")[0] == language_id.UNKNOWN


def test_language_mixture():
    rng = random.Random(1)
    words = {k: ["".join(rng.choice(s) for _ in range(5)) for _ in range(200)] for k, s in (("aa", "abcde"), ("bb", "fghij"), ("cc", "klmno"))}
    counts = Counter()
    for lang, ws in words.items():
        cells, n = language_id.trigrams(" ".join(ws))
        counts.update({(lang, int(c)): int(k) for c, k in zip(cells, n)})
    model = language_id.LanguageModel.from_counts([(*k, n) for k, n in counts.items()])
    mix = model.shares(*language_id.trigrams(" ".join(words["aa"][:150] + words["bb"][:50])))
    assert set(mix) == {"aa", "bb"} and abs(mix["aa"] - 0.75) < 0.1
    long = " ".join(words["aa"] * 2000)
    a, b = language_id.trigrams(long), language_id.trigrams(long[:0] + long)
    assert len(long) > language_id.BLOCK and (a[1] == b[1]).all() and a[1].sum() == sum(map(len, long.split()))


def marginal(word, model, logp):
    """Brute force: every segmentation of a short word."""
    text, at = "▁" + word, {p: i for i, p in enumerate(model.names)}

    def total(s):
        if not s:
            return 1.0
        out = 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in at:
                out += np.exp(logp[at[s[:n]]]) * total(s[n:])
            elif n == 1:
                out += np.exp(sum(logp[len(model.names) + b] for b in s[0].encode())) * total(s[1:])
        return out

    return np.log(total(text))


def test_lattice(docs, rows, empty):
    model = lattice_lm.Pieces(PIECES)
    words = ["the", "a", "日x", "running", "\u0001", "ñandú"]
    z, expected = model.marginals(words, np.log(model.prior), np.ones(len(words)))
    assert np.allclose(z, [marginal(w, model, np.log(model.prior)) for w in words])
    got = lattice_lm.lattice_scores(docs, PIECES).collect()
    train = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            train.update((t or "").encode().lower().split())
            train["end"] += 1
    n, v = sum(train.values()), len(train)
    want = []
    for i, t in rows:
        toks = [*(t or "").encode().lower().split(), "end"]
        want.append((i, len(toks), sum(train[x] > 0 for x in toks), n, round(float(sum(np.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks)), 4)))
    assert sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got], key=str) == sorted(want, key=str)
    assert all(r.score < 0 for r in got)
    assert lattice_lm.lattice_scores(empty, PIECES).count() == 0


def test_lattice_tail_equals_dictionary(real, monkeypatch):
    whole = {r.doc_id: r for r in lattice_lm.lattice_scores(real, PIECES).collect()}
    monkeypatch.setattr(lattice_lm, "HOT_TOKENS", 5)
    for r in lattice_lm.lattice_scores(real, PIECES).collect():
        w = whole[r.doc_id]
        assert r.n_known == w.n_known and abs(r.score - w.score) < 1e-6 * abs(w.score) and abs(r.base_score - w.base_score) < 1e-6 * abs(w.base_score)


@pytest.mark.parametrize("kind,path", [("byte", BPE), ("word", WORDS)])
def test_encoder_is_the_librarys(kind, path, real):
    enc = Encoder(path, kind, keep=300)
    odd = ["a  b", "x\n\ny", " lead", "trail ", "it's I'LL don't", "tab\tx \ty", "ΑΣ Σ", "İstanbul", "<|endoftext|> hi", "foo\x1cbar", "ſt K", "12 345'6's", "_a_ b_c", "x\ny", "a.\nb é\nÉ,\n's", "word, Wörd! İx µm ªº ÿ. Ŀ·l", "a­b", "n\n d", " x", "áb"]
    for t in odd + [x or "" for x in texts()] + [r.text for r in real.limit(60).collect()]:
        assert np.frombuffer(enc.encode(t), np.uint16).tolist() == enc.library.encode(t, add_special_tokens=False).ids, t[:40]


def test_token_files(docs, rows, empty):
    enc = Encoder(BPE, "byte")
    got = sorted(token_files.token_files(docs, BPE, 0).collect(), key=lambda r: r.start)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*enc.library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_files.token_files(empty, BPE).count() == 0
    uri = token_files.write_token_files(docs, BPE, parts=5)
    assert sorted(map(tuple, token_files.read_token_files(docs.sparkSession, uri).collect()), key=lambda r: r[1]) == want


def check_packing(pieces, ids):
    """ids: list of (doc_id, id array), all doc_ids different."""
    own, seqs = defaultdict(list), defaultdict(list)
    for r in pieces:
        own[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(own) == {i for i, _ in ids}
    for i, x in ids:
        at = 0
        for r in sorted(own[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == x.size and r.ids_crc32 == zlib.crc32(x[at : at + r.length].astype("<u4"))
            at += r.length
        assert at == x.size
    lengths = []
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        lengths.append(at)
    assert packing.padding(lengths) == 0


def test_packing(spark, real, empty, docs, rows):
    enc = Encoder(WORDS, "word")
    unique = [(i, t) for i, t in enumerate(x for _, x in rows)]
    for frame, own in ((spark.createDataFrame(unique, "doc_id long, text string"), unique), (real, [(r.doc_id, r.text) for r in real.collect()])):
        check_packing(packing.pack_documents(frame, WORDS).collect(), [(i, np.append(np.frombuffer(enc.encode(t or ""), np.uint16), 1)) for i, t in own])
    assert packing.pack_documents(empty, WORDS).count() == 0
    assert sum(r.length for r in packing.pack_documents(docs, WORDS).collect()) == sum(len(enc.encode(t or "")) // 2 + 1 for _, t in rows)


def test_packing_prefers_neighbours():
    rng = np.random.RandomState(2)
    topics = [rng.randint(100 * k, 100 * k + 60, (12, 200)) for k in range(1, 5)]
    own = [np.append(t[j], 1).astype("<u2") for j in range(12) for t in topics]
    n = len(own)
    df = np.bincount(np.concatenate([packing.term_counts(x)[0] for x in own]), minlength=packing.VOCABULARY)
    order = list(packing.Shard(list(range(n)), own, np.log1p((n - df + 0.5) / (df + 0.5)), 201.0).order())
    assert sorted(order) == list(range(n))
    assert sum(a % 4 == b % 4 for a, b in zip(order, order[1:])) > 0.7 * n


def brute_components(rows):
    sets = [near_dedup.shingle_set(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), (least.get(find(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows)]


def test_near_dedup(spark, docs, rows, empty, real):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows), key=str)
    own = [(r.doc_id, r.text) for r in real.collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_groups(real).collect()]
    assert sorted(got) == sorted(brute_components(own))
    assert near_dedup.near_groups(empty).count() == 0


@pytest.mark.parametrize("block", [2048, 24])
def test_near_dedup_large_bucket(spark, monkeypatch, block):
    """Hundreds of texts that share most words: some near, some just below the limit; in one block, and in many."""
    monkeypatch.setattr(near_dedup.split_large, "__defaults__", (85, block))
    monkeypatch.setattr(near_dedup.block_links, "__defaults__", (85, block // 4 if block < 100 else block))
    rng = random.Random(5)
    base = [f"b{k}" for k in range(220)]
    own = [(k, near(base, rng, rng.choice((1, 2, 3, 5, 7, 9)))) for k in range(400)]
    got = [(r.doc_id, r.component_id) for r in near_dedup.near_groups(spark.createDataFrame(own, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted((i, c) for i, _, c in brute_components(own))


def test_block_sends_a_forest():
    """The links of a block join the same components as all links do, and are fewer than the components."""
    rng = random.Random(8)
    base = [f"c{k}" for k in range(150)]
    own = [near(base, rng, rng.choice((1, 2, 3, 4, 6))) for _ in range(120)]
    hashes = [near_dedup.shingle_hashes(t.encode()) for t in own]
    rows = pa.table({"node": range(120), "comp": [k // 2 * 2 for k in range(120)], "left": [True] * 120, "right": [True] * 120, "sig": [near_dedup.signature(h) for h in hashes], "hashes": pa.array([h.view(np.int64).tolist() for h in hashes])})
    a, b = near_dedup.forest(rows)
    assert 0 < len(a) < 60
    root = {k: k // 2 * 2 for k in range(120)}

    def merge(x, y):
        old, new = root[x], root[y]
        for k in root:
            root[k] = new if root[k] == old else root[k]

    for x, y in zip(a, b, strict=True):
        assert near_dedup.linked(near_dedup.shingle_set(own[x]), near_dedup.shingle_set(own[y])) and root[x] != root[y]
        merge(x, y)
    sets = [near_dedup.shingle_set(t) for t in own]
    assert all(root[x] == root[y] for x in range(120) for y in range(x) if near_dedup.linked(sets[x], sets[y]))


def test_components(spark):
    rng = random.Random(4)
    links = [(a, a + 1) for a in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 100 for k in range(101, 160))
    assert all(got[a] == got[b] for a, b in links if a != b)


def test_pruning_keeps_links():
    rng = np.random.RandomState(6)
    lost = 0
    for _ in range(200):
        common, own = rng.randint(0, 1 << 62, 170).astype(np.uint64), rng.randint(0, 1 << 62, 30).astype(np.uint64)
        a, b = (np.frombuffer(near_dedup.signature(np.concatenate((common, x))), "<u4")[None] for x in (own[:15], own[15:]))
        lost += near_dedup.survivors(a, b).size == 0
    assert lost == 0


def test_toxicity(spark, empty, docs):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    got = toxicity.toxicity(d, labels).where("held_out").join(labels, "doc_id").collect()
    hit = [r for r in got if r.toxic]
    assert len(hit) > 80 and sum(r.predicted for r in hit) / len(hit) > 0.93
    assert sum(r.predicted for r in got if not r.toxic) / (len(got) - len(hit)) < 0.01
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(empty, none).count() == 0


def test_lexicon_by_brute_force(spark, monkeypatch):
    """Weights, exceptions and training rows against plain counting; labels that repeat, are null, or have no document."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    more = spark.createDataFrame([(None, 1, 1), (10**12, 1, 1), (-5, 1, 0), (0, 1, None)], "doc_id long, quality int, toxic int")
    labels = labels.select("doc_id", "quality", "toxic").union(more).union(labels.limit(20).selectExpr("doc_id", "quality", "1 AS toxic"))
    mark = {}
    for r in labels.collect():
        if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            mark[r.doc_id] = max(mark.get(r.doc_id, 0), r.toxic)
    own = [(r.text or "", mark[r.doc_id]) for r in d.collect() if r.doc_id in mark]
    assert sorted(map(tuple, toxicity.training_rows(d, labels).collect())) == sorted(own)
    monkeypatch.setattr(toxicity, "LABEL_BYTES", 0)
    assert sorted(map(tuple, toxicity.training_rows(d, labels).collect())) == sorted(own)
    n = [sum(y == k for _, y in own) for k in (0, 1)]
    count = [Counter(e for t, y in own if y == k for e in toxicity.entries(t)) for k in (0, 1)]
    least = max(min(4, max(2, n[1] // 50)), -(-n[1] // 500))
    want = toxicity.weighed({k: c for k, c in count[1].items() if c >= least}, count[0], n[1], n[0])
    got = toxicity.train_lexicon(toxicity.training_rows(d, labels))
    assert want and got.weights == want and any(len(k) < 4 for k in toxicity.entries("an ox"))
    plain = toxicity.Lexicon(want)
    odd = [Counter(p for t, y in own if y == k for f, s in [plain.matches(t)] for p in {p for at, *_ in f for p in toxicity.phrases(s, at)}) for k in (0, 1)]
    assert got.exceptions == set(toxicity.EXCEPTIONS) | {k for k, c in odd[0].items() if c >= 3 and c / n[0] > 4 * odd[1][k] / n[1]}


def test_toxic_folding_and_exceptions():
    lex = toxicity.Lexicon({"idiot": 8.0, "clown": 6.0}, coef=(-3.0, 2.0, 0.5))
    for t in ("you idiot", "you 1d10t!", "YOU ІDІОТ", "ｉｄｉｏｔ", "an ìdíöt.", "i​diot", "idiot!!"):
        assert lex.score(t)[1] == 1, t
    assert lex.score("a clown fish swims")[1] == 0 and lex.score("a clown swims")[1] == 1
    assert lex.score("videotape")[1] == 0 and lex.score("")[1] == 0


def test_piece_bpe(docs, rows, empty, real):
    m = piece_bpe.PieceModel(PIECES, keep=500)
    odd = ["▁", "a▁b", " ▁ x", "a" * 900, "    indent", "<s> </s>", "\u0000x", "<0x41>", " ", "", "x ", "日本語 😀"]
    for t in odd + [t or "" for _, t in rows] + [r.text for r in real.limit(60).collect()]:
        assert np.frombuffer(m.encode(t), np.uint16).tolist() == m.library.encode(t, add_bos=True, add_eos=True), t[:30]
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_bpe.piece_round_trip(docs, PIECES).collect()), key=str)
    want = []
    for i, t in rows:
        ids = m.library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(m.library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert piece_bpe.piece_round_trip(empty, PIECES).count() == 0


def test_licenses(spark, docs, empty):
    s = license_scan.Scanner()
    long = license_scan.TEMPLATES[1][1]
    for k, (name, wording) in enumerate(license_scan.TEMPLATES):
        got = s.scan(f"some text before it\nfoo bar. {wording} baz\nand more")
        assert [(g[0], g[3]) for g in got] == [(name, 0)], (k, got)
    worded = long.replace("You may obtain", "You can obtain").replace("distributed on an", "delivered on an")
    assert [(g[0], g[3]) for g in s.scan(worded)] == [("Apache-2.0", 2)]
    assert s.scan("we have permission to say that copyright is a word, and a license too") == []
    twice = "Released under the MIT License.\n" + "x y z\n" * 300 + "Licensed under CC BY-NC 4.0."
    assert [g[0] for g in s.scan(twice)] == ["MIT", "CC-BY-NC-4.0"]
    assert [r.license for r in license_scan.scan_licenses(docs).collect()] == ["Apache-2.0"]
    assert license_scan.scan_licenses(empty).count() == 0
    lines = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(r"text rlike '(?i)licensed under|released under the'").select("doc_id")
    found = license_scan.scan_licenses(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id").distinct()
    assert lines.exceptAll(found).count() == 0 and found.exceptAll(lines).count() == 0


@pytest.mark.parametrize("leader", ["", "# ", " * ", "// ", "        ;; "])
def test_licenses_wrapped(leader):
    """Every template as files have it: hard-wrapped, in a comment, among other lines."""
    s = license_scan.Scanner()
    for width in range(60, 81, 2):
        for name, wording in license_scan.TEMPLATES:
            lines = textwrap.wrap(wording, width, initial_indent=leader, subsequent_indent=leader)
            got = s.scan("\n".join(["int main() {", *lines, leader.rstrip(), "more code here"]))
            assert [(g[0], g[3]) for g in got] == [(name, 0)], (width, lines, got)


def test_licenses_in_long_lines():
    """Notices in long text, whether or not the dictionary makes it smaller, and among many cues."""
    s, rng = license_scan.Scanner(), random.Random(8)
    some = [w for w in open(license_scan.re.__file__).read().split() if w.isalpha()]
    for size in (100, 300, 900, 4000):
        for name, wording in (x for x in license_scan.TEMPLATES if len(x[1]) < 80):
            for cues in (0, 40):
                words = [rng.choice(some) + str(rng.randrange(1000)) for _ in range(size)]
                for k in range(0, size, max(1, size // cues) if cues else size):
                    words[k] = "copyright"
                words.insert(rng.randrange(size), wording)
                got = s.scan(" ".join(words))
                assert [(g[0], g[3]) for g in got] == [(name, 0)], (size, cues, wording, got)
    every = "\n".join(" ".join(rng.choices(some, k=30)) + " " + t for _, t in license_scan.TEMPLATES * 20)
    assert [(g[0], g[3]) for g in s.scan(every)] == [(n, 0) for n, _ in license_scan.TEMPLATES * 20]


def test_best_span_by_brute_force():
    """No span goes over taken words; the least number of differences is found."""
    rng = np.random.RandomState(9)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(200):
        words, wanted = rng.randint(-1, 4, 14), rng.randint(0, 4, 5)
        n, a, b = license_scan.best_span(words, wanted)
        every = {(i, j): distance(words[i:j], wanted) for i in range(15) for j in range(i, 15) if -1 not in words[i:j]}
        assert n == min(every.values()) == every[a, b]


def test_licenses_without_template():
    """Licences that have no template aren't taken for one that has; other words may still differ."""
    s = license_scan.Scanner()
    long = {n: t for n, t in license_scan.TEMPLATES}
    for t in (
        "Licensed under the BSD License.", "Licensed under the MIT-0 License.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY ND 4.0.", "Licensed under CC BY 3.0.",
        "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the Apache License, Version 1.1.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "This work is licensed under a Creative Commons Attribution 3.0 International License.",
        long["GPL-3.0"].replace("General", "Affero General"), long["GPL-2.0"].replace("2", "1"), long["MPL-2.0"].replace("2.0", "1.1"), long["Apache-2.0"].replace("2.0", "1.1"),
    ):
        assert s.scan(t) == [], t
    for name, t in (("MIT", "Published under the MIT licence."), ("Apache-2.0", "Licensed under the Apache License v2.0"), ("GPL-3.0", "This program is licensed under the GNU General Public Licence, version 3.0."), ("CC-BY-SA-4.0", "License: shared under CC BY-SA 4.0")):
        assert [g[0] for g in s.scan(t)] == [name], t


def test_pipeline_drops_rows(spark):
    """Ids that repeat, with the same or other texts, and null ids: of each text one row with the smallest id stays."""
    words = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "ABCDEF"}
    own = [(7, "A"), (7, "B"), (3, "B"), (5, "C"), (5, "C"), (None, "C"), (None, "D"), (None, "D"), (4, "E"), (None, "E"), (7, "F"), (9, "F")]
    want = [("3", "B"), ("4", "E"), ("5", "C"), ("7", "A"), ("7", "F"), ("None", "D")]
    for stage, change in ((corpus_pipeline.exact_stage, lambda t, k: t), (corpus_pipeline.near_stage, lambda t, k: f"{t} x{k}")):
        docs = spark.createDataFrame([(i, change(words[x], k), "en") for k, (i, x) in enumerate(own)], "doc_id long, text string, lang string").repartition(4)
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert sorted((str(r.doc_id), r.text[0]) for r in got.collect()) == want


def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    """Empty tables and columns whose names operators use inside: rows stay whole, columns stay as they are."""
    schema = "doc_id long, text string, lang string, _bucket string, _bitmap int, _bit int, _hit string, _dropped long, bucket int, id long, member_of int"
    rows = [(i, t, "en", "b", 1, 2, "h", 3, 4, 5, 6) for i, t in ((1, "same words here"), (2, "same words here"), (2, "other words there and more"), (None, None), (None, ""))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for stage, want in ((corpus_pipeline.exact_stage, [(1, "same words here"), (2, "other words there and more"), (None, "")]), (corpus_pipeline.near_stage, [(1, "same words here"), (2, "other words there and more"), (None, ""), (None, "")])):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == sorted(want, key=str)
        assert {tuple(r)[2:] for r in got.collect()} == {rows[0][2:]}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_pipeline_filters(spark):
    """Documents without letters go at the language stage, toxic ones at the toxicity stage; the others stay whole."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    left = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "/root/testdata/sf0.1").collect()}
    assert left == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    left = {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, "/root/testdata/sf0.1").collect()}
    said = {r.doc_id: r.toxic for r in labels.collect()}
    clean, toxic = ({i for i in said if said[i] == k} for k in (0, 1))
    assert len(clean - left) <= 0.01 * len(clean) and len(toxic & left) <= 0.07 * len(toxic)


def test_near_stage_links_from_80(spark):
    """Pairs between 0.80 and 0.85: the near stage links them, op7 doesn't; those under 0.80 stay."""
    rng = random.Random(11)
    own, between, under = [], set(), set()
    while len(between) < 30 or len(under) < 30:
        base = [f"k{rng.randrange(10**9)}" for _ in range(rng.randrange(90, 200))]
        pair = [" ".join(base), near(base, rng, rng.choice((2, 3, 4, 5, 6)))]
        a, b = map(near_dedup.shingle_set, pair)
        j = len(a & b) / len(a | b)
        if 0.77 < j < 0.85:
            (between if j >= 0.8 else under).add(len(own) + 1)
            own += [(len(own), pair[0]), (len(own) + 1, pair[1])]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect()}
    assert left == {i for i, _ in own} - between
    assert near_dedup.near_groups(docs).where("kept").count() == len(own)
    assert near_dedup.banding(85) == (20, 6) and near_dedup.banding(80) == (24, 5)


@pytest.mark.parametrize("kind,path", [("byte", BPE), ("word", WORDS)])
def test_added_tokens_are_the_librarys(kind, path):
    """Texts with an added token's literal have the ids of a tokenizer as it is loaded."""
    from tokenizers import Tokenizer

    enc, library = Encoder(path, kind), Tokenizer.from_file(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in added
    for x in added:
        for t in (x, f"a {x} b", f"a{x}b", f"{x}{x} ", f" the cat\n{x}\tsat", f"A {x.upper()} b", f"a {x.title()}", f"it's {x[:-1]} {x[1:]}", "plain text", "a <| b"):
            assert np.frombuffer(enc.encode(t), np.uint16).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packing_meets_across_partitions(spark):
    """Near copies that are stored in different partitions are laid into one window."""
    rng = random.Random(12)
    vocabulary = [w for w in open(re.__file__).read().lower().split() if w.isalpha()]
    base = [rng.choices(sorted(set(vocabulary)), k=250) for _ in range(60)]
    own = [(k * 2 + j, " ".join(b if j else b[:-5])) for j in (0, 1) for k, b in enumerate(base)]
    frame = spark.createDataFrame(own, "doc_id long, text string").repartition(40)
    at = defaultdict(set)
    for r in packing.pack_documents(frame, WORDS).collect():
        at[r.doc_id].add(r.sequence_id)
    assert sum(bool(at[2 * k] & at[2 * k + 1]) for k in range(60)) > 40


def test_packing_places_by_content(spark, monkeypatch):
    """Of many shards, the one that a document goes to has its like."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    rng = np.random.RandomState(13)
    topics = [np.arange(1000 + 50 * k, 1040 + 50 * k) for k in range(20)]
    own = [(k, np.concatenate((rng.choice(topics[k % 20], 60), rng.randint(0, 900, 60))).astype("<u2").tobytes()) for k in range(200)]
    ids = spark.createDataFrame([(i, bytearray(x)) for i, x in own], "doc_id long, ids binary").repartition(7)
    df = np.bincount(np.concatenate([packing.term_counts(np.frombuffer(x, "<u2"))[0] for _, x in own]), minlength=packing.VOCABULARY)
    got = packing.placed(ids, 200, 200 * 120, df).selectExpr("doc_id", "spark_partition_id() AS p").collect()
    assert sorted(r.doc_id for r in got) == list(range(200)) and len({r.p for r in got}) > 8
    shards = defaultdict(list)
    for r in got:
        shards[r.doc_id % 20].append(r.p)
    assert sum(Counter(v).most_common(1)[0][1] for v in shards.values()) > 120


def test_packing_queries_with_all_terms():
    """A neighbour that shares none of the seed's weightiest terms."""
    own = [np.repeat(np.arange(100, 140), 3), np.arange(140, 180), np.arange(500, 560)]
    own[0] = np.append(own[0], np.arange(140, 180))
    shard = packing.Shard([0, 1, 2], [x.astype("<u2") for x in own], np.ones(packing.VOCABULARY), 100.0)
    shard.unused[0] = False
    assert shard.neighbours(0) == [1]


def test_packing_lets_encoder_caches_go(monkeypatch):
    """Workers hold the encoder while they encode only: the steps behind it free what it has kept."""
    from types import SimpleNamespace

    from folioscope.llm import packing, piece_encoder

    maps = []

    class Rows:
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

        def mapInArrow(self, f, schema):
            maps.append(f)
            return self

        def __getattr__(self, name):
            return lambda *a, **k: [] if name == "collect" else self

    monkeypatch.setattr(packing, "encode_documents", lambda *a: Rows())
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    packing.pack_documents(Rows(), "none")
    assert len(maps) == 4
    for f in maps:
        piece_encoder._encoders["kept"] = object()
        list(f(iter([])))
        assert not piece_encoder._encoders


def test_token_files_cache_bears_on_speed_only(spark):
    from folioscope.llm import queries, token_files

    docs = spark.createDataFrame([(k, f"word{k} again, again Word{k % 3} x{k}y  end") for k in range(40)] + [(40, None)], "doc_id long, text string")
    small, large = [sorted(map(tuple, token_files.token_files(docs, queries.tokenizer("byte_bpe_50k.json"), keep=n).collect())) for n in (2, 1000)]
    assert small == large and len(small) == 41


def test_packing_encodes_texts_together(real, monkeypatch):
    """Ids of texts encoded together are the library's, also over cache turns, and a cut of several texts is looked up once."""
    from folioscope.llm import piece_encoder

    enc = piece_encoder.Encoder(queries.tokenizer("word_bpe_49k.json"), "word", 60)
    odd = ["", " ", "  a  b ", "tab\tand\u2003wide\u00a0space ", "a\x1cb c", "<|endoftext|> A <|ENDOFTEXT|>", "\u0130\u0130 \u00c4\u00d6\u00dc stra\u00dfe", "\u65e5\u672c \U0001f600 e\u0301", "can't, (x) 3.14!", "\x85mid\u2028line"]
    texts = odd + [r.text or "" for r in real.limit(60).collect()] + odd
    looked = []
    each = piece_encoder.Kept.each
    monkeypatch.setattr(piece_encoder.Kept, "each", lambda self, keys: looked.extend(keys) or each(self, keys))
    want = [np.array(enc.library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert enc.encode_all(texts) == want and enc.encode_all(texts[::-1]) == want[::-1] and enc.encode_all([]) == [] and enc.encode_all([""]) == [b""]
    assert len(looked) > 100 and len(looked) < 3 * len(set(looked))


def test_packing_counts_together(monkeypatch):
    """Postings and sketches of many documents against one document at a time, in portions of any size, empty ones among them."""
    rng = np.random.RandomState(8)
    docs = [rng.zipf(1.3, rng.randint(0, 90)).clip(0, packing.VOCABULARY - 1).astype("<u2") for _ in range(300)]
    docs[7] = docs[-1] = np.zeros(0, "<u2")
    doc, term, tf = packing.postings(docs)
    want = [(i, int(t), int(n)) for i, d in enumerate(docs) for t, n in zip(*np.unique(d, return_counts=True), strict=True)]
    assert list(zip(doc.tolist(), term.tolist(), tf.tolist(), strict=True)) == want and all(x.size == 0 for x in packing.postings([]))
    df = np.bincount(term, minlength=packing.VOCABULARY)
    idf = np.log1p((300 - df + 0.5) / (df + 0.5)).astype(np.float32)
    least = [max(2, 300 / (packing.COARSEST * packing.FINER**k)) for k in range(packing.LEVELS)]

    def sketch(d):
        t, n = np.unique(d, return_counts=True)
        w = idf[t] * (n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * d.size / 40.0)))
        levels = [[(-x, int(y)) for x, y in zip(w, t, strict=True) if df[y] >= m] for m in least]
        return b"".join(int(min(x)[1] if x else packing.VOCABULARY - 1).to_bytes(2, "big") for x in levels)

    for most in (1 << 18, 50):
        monkeypatch.setattr(packing, "PORTION", most)
        assert packing.Sketcher(300, df, idf, 40.0)(docs) == [sketch(d) for d in docs]
