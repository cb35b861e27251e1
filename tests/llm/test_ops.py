"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import base64
import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from unittest import mock

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from granthi.llm import bpe, chat, common, components, dedup, media, packing, pii, quality, similarity, tokencount

BASE = " ".join(f"word{i} and other{i * 7 % 13}" for i in range(60))
TEXTS = [
    (0, BASE), (1, BASE), (2, BASE.replace("word9 ", "Wort9 ", 1)), (3, None), (4, ""), (5, "  \n\t "), (6, "one"), (7, "ONE"), (8, "two words"),
    (9, "é ü 日本語 🎉 token = \"3fdf5a35c7b8d733c0b5c7d364aa11bb22cc33dd\" a.b@mail0.example.com +1 (743) 555-3824 at 10.0.0.256 or 1.2.3.4 or 4111 1111 1111 1111 x"),
    (10, "x " * 6000 + BASE), (11, "same  text"), (12, "same\ntext"), (12, "same\ntext"), (None, "no id"), (13, "a" * 30000), (14, "1" * 5000 + "." + "2.3" * 2000 + " a@b" + ".c" * 3000),
]
ROWS = [(i, t, "en", "src0", len(t or ""), 1.5, True) for i, t in TEXTS]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORDS.findall(text or "")]


def test_packing(spark, docs):
    rows = packing.pack(docs, keep_ids=True).collect()
    tok = Tokenizer.from_file(packing.TOKENIZER)
    own = defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
    for i, t in TEXTS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        got = sorted(own[i], key=lambda r: r["piece"])
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got]).tolist() == ids * (len(got) * 4096 >= 2 * len(ids) and i == 12 and 2 or 1)
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] for r in got)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_holds_no_ids_that_nobody_wants(monkeypatch):
    """Without ``keep_ids`` a batch costs its pieces' rows alone, and Arrow's free memory goes back after each lot of texts."""
    monkeypatch.setattr(packing, "TaskContext", mock.Mock(get=lambda: mock.Mock(partitionId=lambda: 0)))
    pool = mock.Mock()
    monkeypatch.setattr(packing.pa, "default_memory_pool", lambda: pool)
    texts = ["a b c d e f g h " * 20_000] * 100  # 160,000 tokens each, 64 MB of ids
    frame = mock.MagicMock()
    packing.pieces(frame)
    rows = frame.select.return_value.mapInArrow.call_args[0][0]
    tracemalloc.start()
    try:
        made = [*rows(iter([pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], names=["doc_id", "text"])]))]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made[0].num_rows == 100 * 40
    assert most < 90_000_000
    assert pool.release_unused.call_count == 10  # lots of 3 million characters


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    counts = Counter(int(x) for x in np.minimum(rng.lognormal(6, 1, 3000), 4096).astype(int) + 1 if x <= 4096)
    made = packing.plan(counts)
    used = Counter()
    for pattern, n in made:
        assert sum(pattern) <= 4096
        for length in pattern:
            used[length] += n
    assert used == counts
    assert sum(n for _, n in made) <= np.ceil(sum(k * n for k, n in counts.items()) / 4096) * 1.01 + 1


def test_quality(spark, docs):
    rows = [(i, f"A fine text number {i}. It has sentences, and they end.") for i in range(0, 200)] + [(i, f"BUY!!! $$$ {i} WIN *** NOW!!!") for i in range(200, 400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(table, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == (r["doc_id"] < 200) for r in got) >= 396
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    kept = quality.accepted(docs, quality.train(table, labels))
    assert kept.columns == docs.columns


def test_quality_learns_one_row_of_an_id(spark, monkeypatch):
    """However many rows carry a labelled id, the driver gets one of them."""
    rows = [(i, f"text {i}", "x") for i in range(20)] + [(3, f"copy {k} of the id", "x") for k in range(200)]
    labels = [(i, i % 2, 0) for i in range(20)] * 3
    sizes = []
    monkeypatch.setattr(quality.Machine, "fit", lambda self, x, y, f=quality.Machine.fit: sizes.append(len(y)) or f(self, x, y))
    quality.train(spark.createDataFrame(rows, "doc_id long, text string, note string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sizes == [sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(20))]


def test_quality_learns_every_word(spark):
    ids = [i for i in range(12) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(5000))) for i in ids]
    labels = [(i, int(k % 2), 0) for k, i in enumerate(ids)]
    machine = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for _, text in rows:
        slots, values, offsets = quality.features([text], np.array([-1]))
        assert len(np.unique(slots)) == len(slots) == offsets[-1] and len(slots) > 4500
        assert values[: -quality.STATS - 1].sum() == pytest.approx(5000 / np.sqrt(5000), rel=1e-4)
        assert (machine.w[slots] != 0).all()


def test_machine_uses_the_sum_of_squares_identity():
    m = quality.Machine(50, 3)
    m.w[:] = np.random.default_rng(0).normal(size=50)
    slots, values = np.array([3, 7, 9, 20]), np.array([1, 0.5, 2, 1], np.float32)
    want = (m.w[slots] * values).sum() + sum(values[i] * values[j] * (m.v[slots[i]] @ m.v[slots[j]]) for i in range(4) for j in range(i))
    assert m.raw(slots, values, np.array([0, 4]))[0][0] == pytest.approx(want, rel=1e-4)


def brute_components(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = tokens(t)
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < words else [tuple(w[k : k + words]) for k in range(len(w) - words + 1)])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [*sets]
    for a in range(len(ids)):
        for b in range(a):
            p, q = sets[ids[a]], sets[ids[b]]
            if p and q and den * len(p & q) >= num * len(p | q):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("words", "num", "den", "block"), [(3, 90, 100, 1500), (5, 80, 100, 1500), (3, 90, 100, 7), (5, 80, 100, 7), (5, 80, 100, 1)])
def test_jaccard(spark, docs, monkeypatch, words, num, den, block):
    """At each size of blocks; with large ones all links must come from the product, without the reduction."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block)
    ran = []
    monkeypatch.setattr(similarity, "_reduced", lambda *a, f=similarity._reduced: ran.append(1) or f(*a))
    rng = np.random.default_rng(5)
    rows = [x for x in dict(TEXTS).items() if x[0] is not None]
    base = [f"w{k}" for k in range(150)]
    for i in range(100, 160):  # near copies: some linked to each other, some not
        w = [*base]
        for k in rng.integers(0, 150, rng.integers(0, 6)):
            w[k] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base[: 9 + i])) for i in range(8)]
    got = by_id(similarity.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words, num, den))
    want = brute_components(rows, words, num, den)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert bool(ran) == (block < 1500)
    assert similarity.jaccard_components(docs).count() == len(TEXTS)
    assert similarity.jaccard_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1500, 7])
def test_jaccard_one_python_worker_a_task(spark, monkeypatch, block):
    """Links reach components from tables: a product and the contraction in one task would hold two Python workers."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block)
    plans = []
    monkeypatch.setattr(similarity, "components", lambda links: plans.append(links._jdf.queryExecution().executedPlan().toString()) or components.components(links))
    base = [f"w{k}" for k in range(150)]
    rows = [(i, " ".join([*base[:i], f"n{i}", *base[i + 1 :]])) for i in range(40)]
    got = similarity.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}
    assert plans and not [p for p in plans if "InArrow" in p]


def test_jaccard_rows_that_share_an_id(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text + " a"), (None, text + " b"), (7, text + " c"), (7, "one of its own kind and long enough"), (9, "one of its own kind and long enough"), (None, "alone in all the world"), (8, None)]
    got = similarity.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0, r["component_id"]) for r in got), key=str) == sorted([(0, 7), (0, 7), (7, 7), (7, 7), (9, 7), (0, None), (8, 8)], key=str)


def test_overlaps():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 900 if k % 3 else 60, rng.integers(1, 80))).astype(np.uint64) for k in range(120)]
    got = similarity.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(120) for j in range(120) if i != j)


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 2000 + k) for k in range(100)]
    a, b = (np.array(x) for x in zip(*links, strict=True))
    want = dict(zip(*(x.tolist() for x in components.local_roots(a, b)), strict=True))
    got = {r["child"]: r["parent"] for r in components.components(spark.createDataFrame(links, "child long, parent long")).collect()}
    assert got == want


def test_components_keep_every_parent(spark):
    """Links in many tasks: a node gets a parent from each of them, and each parent is a link."""
    rng = np.random.default_rng(3)
    links = [(101, 50), (101, 10), (102, 50), (102, 20), (103, 50), (103, 30)]
    for tree in range(1, 21):  # sparse random trees of 20 nodes, named in no order
        names = tree * 1000 + rng.permutation(20)
        links += [(int(names[k]), int(names[rng.integers(0, k)])) for k in range(1, 20)]
    a, b = (np.array(x) for x in zip(*links, strict=True))
    want = dict(zip(*(x.tolist() for x in components.local_roots(a, b)), strict=True))
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = [(r["child"], r["parent"]) for r in components.components(spark.createDataFrame(links, "child long, parent long")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted(want.items())


def test_bpe(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.bpe_digests(docs))
    for i, t in TEXTS:
        ids = own.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    for t in ("\x1c \x1d\x85\xa0  x", "²³ ¼x ɏa", "don't I'll", " a​"):
        assert bpe.encoder(bpe.RANKS).encode(t) == " ".join(map(str, own.encode_ordinary(t)))


def brute_feature(payload):
    """Sample by sample, by the codecs' definitions."""

    def mu(code):
        code = ~code & 0xFF
        size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
        return -size if code & 0x80 else size

    def a_law(code):
        code ^= 0x55
        step, size = (code >> 4) & 7, (code & 0x0F) << 4
        size = size + 8 if step == 0 else (size + 0x108) << (step - 1)
        return size if code & 0x80 else -size

    blocks = []
    for k in range(0, len(payload), 64):
        block = payload[k : k + 64]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        blocks.append(value)
        for code in (c for byte in block[4:] for c in (byte & 15, byte >> 4)):
            step = int(media.STEPS[index])
            change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = max(-32768, min(32767, value + (-change if code & 8 else change)))
            index = max(0, min(88, index + int(media.SHIFTS[code])))
            blocks.append(value)
    call = [mu(c) for c in payload]
    wide = [x for i, c in enumerate(call) for x in (c, (c + call[min(i + 1, len(call) - 1)]) >> 1)]
    wide[-1] = call[-1]
    crc = zlib.crc32(b"".join(x.to_bytes(2, "little", signed=True) for x in wide))
    return f"mulaw={sum(map(abs, call))};alaw={sum(abs(a_law(c)) for c in payload)};adpcm={sum(blocks)},{max(map(abs, blocks))};pcm16k={sum(map(abs, wide))},{crc:08x}"


def test_media(spark, docs, tmp_path):
    got = by_id(media.media_digests(media.media_table(docs)))
    assert got == by_id(media.media_digests(media.write_media(docs, str(tmp_path / "media"))))
    assert media.media_digests(media.media_table(docs.limit(0))).count() == 0
    for i, t in TEXTS:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert (r["media_bytes"], r["media_sha256"]) == (len(media.store(t)), hashlib.sha256(media.store(t)).hexdigest())
        assert r["feature"] == brute_feature(payload)
    assert got[3]["feature"] == got[4]["feature"] and got[0]["feature"] == got[1]["feature"]


def test_codecs():
    assert (media.MU_LAW[0xFF], media.MU_LAW[0x7F], media.MU_LAW[0x80], media.MU_LAW[0x00]) == (0, 0, 32124, -32124)
    assert (media.A_LAW[0xD5], media.A_LAW[0x55], media.A_LAW[0xAA], media.A_LAW[0x2A]) == (8, -8, 32256, -32256)
    payload = np.random.default_rng(3).integers(0, 256, 576).astype(np.uint8)
    want = []
    for block in payload.reshape(-1, 64):
        value, index = int(np.array(block[:2]).view("<i2")[0]), min(int(block[2]), 88)
        want.append(value)
        for byte in block[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = int(media.STEPS[index])
                change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
                value = max(-32768, min(32767, value + (-change if code & 8 else change)))
                index = max(0, min(88, index + int(media.SHIFTS[code])))
                want.append(value)
    assert media.decode(payload, "adpcm").tolist() == want
    assert media.resample(np.array([0, 10, 20], np.int16)).tolist() == [0, 5, 10, 15, 20, 20]
    assert media.read_back(media.pcm_file(media.store("ab"))) == media.resample(media.MU_LAW[np.frombuffer(b"ab" + b"\xff" * 574, np.uint8)]).tobytes()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            luhn = sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, docs):
    more = [(50, "a@b.com%x@c.de 1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.0255"), (51, "+1 2 x +12345678901234567890 +1-234-567-8901."), (52, "🎉 é 4111-1111-1111-1111 5500 0000 0000 0005"), (53, "@ a@b a@b. .@.. x@-.-")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = by_id(pii.pii_spans(table))
    for i, t in [*TEXTS, *more]:
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want, got[i])
        assert set(want) <= set(filter(None, got[i]["spans"].split(",")))
    assert pii.pii_spans(docs.limit(0)).count() == 0


def test_pii_long_runs_end(spark):
    rows = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "1 " * 100_000), (4, "a@b" + ".c" * 50_000), (5, "+1" + "." * 100_000)]
    got = by_id(pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (got[4]["n_email"], got[1]["n_email"], got[3]["n_card"], got[5]["n_phone"]) == (1, 0, 0, 0)


def test_reliabilities_find_the_good_labeler():
    counts = {("secret", 1, 1, 2, 0, 0): 90, ("secret", 0, 0, 2, 0, 0): 100, ("secret", 1, 0, 2, 0, 0): 5, ("secret", 0, 1, 2, 0, 0): 5}
    share, votes, posterior = pii.reliabilities(counts)
    assert posterior["secret", 1, 1, 2, 0, 0] > 0.9 > 0.1 > posterior["secret", 0, 0, 2, 0, 0]
    assert votes[0][1][1] > 0.8 and 0.3 < share["secret"] < 0.7


def test_learned_spans_of_other_kinds(spark):
    """Expectation-maximisation adds numbers in looser writing where the labelers agree, and refuses others of the same shape."""
    rows = [(i, f"please call me: (743) 555-{1000 + i} soon") for i in range(100)] + [(100 + i, f"mail +1 743 555 {1000 + i} phone or write to j.doe{i} [at] mail.example (dot) com") for i in range(100)]
    rows += [(200 + i, f"lot 043-155-{2000 + i} of the store") for i in range(100)] + [(300, "+1 (743) 555-3824"), (301, "server 10.0.0.256, card 4111 1111 1111 1112")]
    got = by_id(pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(got[i]["spans"] == "phone:16:30" and got[i]["n_phone"] == 0 for i in range(100))
    assert all(got[i]["spans"].startswith("email:39:") and got[i]["spans"].endswith(",phone:5:20") for i in range(100, 200))
    assert all(got[i]["spans"] == "" for i in range(200, 300))
    assert (got[300]["spans"], got[301]["spans"]) == ("phone:0:17", "")


def test_redact(spark, docs):
    got = by_id(pii.redact(docs))
    assert "<email>" in got[9]["text"] and "<phone>" in got[9]["text"] and "<card>" in got[9]["text"] and "4111" not in got[9]["text"] and "10.0.0.256" in got[9]["text"]
    assert got[9]["n_chars"] == len(got[9]["text"]) and got[3]["text"] is None and got[0]["text"] == BASE
    assert pii.redact(docs).columns == docs.columns
    assert pii.redact(docs.limit(0)).count() == 0


def test_redact_leaves_columns_of_any_name(spark):
    names = ["pii_text", "pii_candidates", "pii_spans", "pii_new", "kept", "found", "spans", "cut", "n", "new", "whole", "email", "a.b"]
    rows = [(i, text, *(f"{c} {i}" for c in names)) for i, text in enumerate(["mail a.b@mail.com now", None, "", "mail a.b@mail.com now"])]
    got = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names)))
    want = [(i, "mail <email> now" if text else text, *rest) for i, text, *rest in rows]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and got.columns == ["doc_id", "text", *names]


def test_redact_many_spans_and_long_texts(spark):
    many = "é " + " und ".join(f"x{k}@host{k}.org, +1 743 555 {1000 + k}" for k in range(3000))
    text, n = by_id(pii.redact(spark.createDataFrame([(1, many, 0)], "doc_id long, text string, n_chars int")))[1][1:]
    assert text == "é " + " und ".join(["<email>, <phone>"] * 3000) and n == len(text)


def test_dedup(spark, docs):
    got = dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in TEXTS:
        groups[norm(t)].append(i)
    texts = defaultdict(set)
    for i, t in TEXTS:
        texts[i].add(norm(t))
    assert len(got) == len(TEXTS)
    for r in got:
        (t,) = texts[r["doc_id"]]
        keep = min((i for i in groups[t] if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(groups[t]), r["doc_id"] == keep)
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert dedup.exact_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [0, 1000])
def test_copies_read_survivors_alone(spark, monkeypatch, sent):
    monkeypatch.setattr(dedup, "SENT", sent)
    long = "x" * 300
    rows = [(0, "a  b"), (1, "a b"), (2, None), (3, ""), (4, "ab"), (5, long + "1"), (6, long + "2"), (7, "a\tb"), (8, long + "1"), (9, "unique text")]
    got = {r["row"]: r["group"] for r in dedup.copies(spark.createDataFrame(rows, "pipeline_row long, text string"), "pipeline_row").collect()}
    assert got == {0: 0, 1: 0, 7: 0, 2: 2, 3: 2, 5: 5, 8: 5}
    assert dedup.copies(spark.createDataFrame(rows, "k long, text string").limit(0), "k").count() == 0


def test_look_up_deals_out_no_hot_key(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)], "a long, v long")
    table = spark.createDataFrame([(k, k * 10, 100 if k == 0 else 5) for k in range(6)], "a long, b long, n long")
    for share in (1, 10, 1000):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        got = common.look_up(rows, table, ["a"], "n", 300).collect()
        assert sorted((r["a"], r["v"], -1 if r["b"] is None else r["b"]) for r in got) == sorted((a, v, a * 10 if a < 6 else -1) for a, v in ((k % 7 if k % 3 else 0, k) for k in range(300)))


def test_chat(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\s> [\\\\INST] <|x|> <\\\\|", None, "", "a\nb \\"]
    rows = [(1, k, role, t) for k, (role, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant"], odd, strict=True))]
    rows += [(4, 0, "a\x00b", "nul"), (4, 1, "\\p\\l|\\", "y"), (4, 2, "assistant", "one"), (4, 3, "assistant", "</s> two")]
    rows += [(1, None, "we|ird<|>", "x"), (2, 0, "user", "only"), (None, 0, "assistant", "z"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (3, 0, None, "r")]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(table)
    back = {r["conv_id"]: r for r in made.select("*", chat.parsed_turns(F.col("formatted")).alias("turns")).collect()}
    own = defaultdict(list)
    for c, k, role, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((role or "", t or ""))
    for c, turns in own.items():
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == turns
        assert len(back[c]["examples"]) == sum(role == "assistant" for role, _ in turns)
    losses = chat.examples(made).where("conv_id = 4").orderBy("turn_no").collect()
    assert [r["loss"] for r in losses] == ["one", "</s> two"]
    examples = chat.example_texts(made).where("conv_id = 1").orderBy("turn_no").collect()
    assert all(back[1]["formatted"].startswith(e["text"]) and e["text"].endswith("</s>") for e in examples)
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_token_counts(spark, docs):
    own = Tokenizer(models.Unigram(tokencount.vocabulary(), 0, True))
    own.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    dice = np.random.default_rng(9)
    blanks = ["if x:\n        return 1", "a    b", "    ", "a   ", " " * 40 + "x" + " " * 17 + "yz", "▁▁ a▁ b"]
    blanks += ["".join(dice.choice(list("ab  é▁ .\n"), dice.integers(1, 60))) for _ in range(200)]
    rows = [*dict(TEXTS).items(), *enumerate(blanks, 100)]
    got = by_id(tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, t in rows:
        assert got[i]["n_tokens"] == len(own.encode(t or "", add_special_tokens=False).ids)
    assert tokencount.token_counts(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    good = "A fine text about number {}. It has sentences, and they end well, so it is kept by all. " * 3
    rows = [(i, good.format(i, i * 3, i * 7) + " ".join(f"u{i}v{k}" for k in range(40)), "en", "src0", 9) for i in range(150)]
    rows += [(i, f"BUY!!! $$$ {i} WIN *** NOW!!! " * 4, "en", "src0", 9) for i in range(150, 300)]
    rows += [(300, rows[0][1], "en", "src0", 9), (301, rows[1][1] + " tail", "en", "src0", 9), (302, rows[2][1] + " mail me: a.b@mail.example.com", "en", "src0", 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "jaccard_join", "pii", "best_fit_packing"]
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not kept & {*range(150, 300)} and 300 not in kept and 301 not in kept and {*range(150)} <= kept


def test_pipeline_judges_rows_one_by_one(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "null copy"), (None, "null  copy"), (1, "twice"), (1, "twice"), (2, "kept too"), (3, "shared"), (3, "alone"), (0, "shared"), (None, "shared"), (None, None), (9, "")]
    got = corpus_pipeline.dedup_stage(spark, spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, pipeline_row int"), "")
    assert got.columns == ["doc_id", "text", "pipeline_row"] and {r["pipeline_row"] for r in got.collect()} == {7}
    left = sorted((str(r["doc_id"]), (r["text"] or "").replace("  ", " ")) for r in got.collect())
    assert left == [("0", "shared"), ("1", "twice"), ("2", "kept too"), ("3", "alone"), ("9", ""), ("None", "null copy")]
    near = [(None, long + " a"), (None, long + " b"), (5, "one of its own kind and long enough"), (5, long + " c"), (4, long + " d"), (None, "no other text is like this one at all")]
    got = corpus_pipeline.near_stage(spark, spark.createDataFrame(near, "doc_id long, text string"), "").collect()
    assert {tuple(r) for r in got} == {near[2], near[4], near[5]} and len(got) == 3
