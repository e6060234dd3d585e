"""Alignment, conversation trie and MinHash against brute force; hot groups, many partitions, long texts."""

import collections
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradewind.llm import align, minhash, mixing, pii, registry, simhash, trie
from tradewind.llm.blobs import unpack_raw

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    own = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    odd = [None, "", " ", "\n\t", "a▁b", "▁", " lead", "trail ", "two  spaces   three", "x\x00y", "né 日本語 😀", "<|endoftext|> <s> </s>", "<0x41>", "1" * 5000, "ab" * 3000, "\x1c \x1d", "a b", " ".join(own), own[0]]
    return own + odd


def aligned_brute(rows):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ids = {v: k for k, v in t.get_vocab(False).items()}
    per, df = [], collections.Counter()
    for d, x in rows:
        if not x:
            per.append((d, None))
            continue
        a, b = t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x)
        ab = [bytes(back[c] for c in ids[i]) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(ab) != (" " + x).encode() or b"".join(bb) != (" " + x).encode():
            per.append((d, None))
            continue
        ea, eb = np.cumsum([len(y) for y in ab]).tolist(), np.cumsum([len(y) for y in bb]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            p, q = ea.index(end, i) + 1, eb.index(end, j) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(max(0, np.searchsorted(eb, ea[i] - len(ab[i]), "right")), len(b)) if eb[j] - len(bb[j]) < ea[i]] if len(a) < 3000 else None
        if links is None:
            links, j = [], 0
            for i in range(len(a)):
                while eb[j] <= ea[i] - len(ab[i]):
                    j += 1
                k = j
                while k < len(b) and eb[k] - len(bb[k]) < ea[i]:
                    links.append((a[i], b[k]))
                    k += 1
        df.update(set(links))
        per.append((d, (len(a), len(b), len(groups), links, ";".join(groups))))
    best = collections.defaultdict(int)
    for (a, _), n in df.items():
        best[a] = max(best[a], n)
    out = []
    for d, v in per:
        if v is None:
            out.append((d, 0, 0, 0, 0, 0, 0, "", ""))
        else:
            out.append((d, *v[:3], len(v[3]), sum(df[x] == best[x[0]] for x in v[3]), sum(df[x] for x in v[3]), hashlib.sha256(v[4].encode()).hexdigest(), v[4]))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_alignment_against_brute_force(spark, texts, monkeypatch, small):
    if small:  # many blocks, in teams
        monkeypatch.setattr(align, "TEAM", 2)
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4])]
    df = spark.createDataFrame([(d, x, "mine", d) for d, x in rows], "doc_id long, text string, n_a string, block long")
    out = align.align_documents(df, **registry.pieces(), groups=True, block_bytes=2000 if small else 1 << 23)
    assert sorted(out.columns) == sorted(["doc_id", "block", *align.RESULTS, "groups"])
    got = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups").collect()
    assert sorted(map(tuple, got), key=str) == sorted(aligned_brute(rows), key=str)
    assert align.align_documents(df.limit(0), **registry.pieces()).count() == 0


def test_runs_cover_both_sides():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 60)
        cut = lambda p: sorted({n, *(k for k in range(1, n) if rng.random() < p)})  # noqa: B023, E731
        ea, eb = cut(rng.choice([0.2, 0.9, 1])), cut(rng.choice([0.2, 0.9, 1]))
        runs = align.alignment(ea, eb)
        assert [r[0] for r in runs] == [0, *(r[1] for r in runs[:-1])] and runs[-1][1] == len(ea) and runs[-1][3] == len(eb)
        ends = [ea[k] for i, p, j, q, one in runs for k in (range(i, p) if one else [p - 1])]
        assert ends == sorted(set(ea) & set(eb))
        ga, gb = align.group_ends(runs)
        assert [ea[k - 1] for k in ga] == ends and [eb[k - 1] for k in gb] == ends


@pytest.mark.parametrize("shape", ["1", "ab", "日本", " x", "\n", "a b▁"])
def test_alignment_of_long_texts_is_linear(shape):
    own = align.aligner(**registry.pieces())
    began = time.time()
    for a, b in own.tokens([(shape * 1_000_000)[:1_000_000]]):
        if len(a):
            align.alignment(np.cumsum(own.a_sizes[a]).tolist(), np.cumsum(own.b_sizes[b]).tolist())
    assert time.time() - began < 60


def trie_brute(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + v[h:]
    nodes = collections.defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    out = []
    for k, members in nodes.items():
        below = [n for n in nodes if n[: len(k)] == k]
        ends = sorted(c for c in members if len(rebuilt[c]) == len(k))
        children = lambda n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes)
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children(k), sum(not children(n) for n in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_trie_against_brute_force(spark, monkeypatch, small):
    if small:  # buckets, chunks and parents of many children, all of them tiny
        for name, value in (("BUCKET", 2), ("CHUNK", 3), ("MANY", 1)):
            monkeypatch.setattr(trie, name, value)
    rng = random.Random(11)
    rows = []
    for c in [*range(45), 1000, 1003]:
        for t in range(rng.choice([0, 1, 2, 5, 12])):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "user", "bot", None]), rng.choice(["hé", "hé", "yo", None, ""])))
    rows += [rows[0], (None, 1, "user", "lost"), (7, 2, "user", "x" * 3000)]
    df = spark.createDataFrame([(c, t, r, x, 1, 2) for c, t, r, x in rows], "conv_id long, turn int, role string, text string, depth int, k int")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = trie.conversation_trie(df)
    assert got.columns == names and [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(trie_brute(rows), key=str)
    if not small:
        assert trie.conversation_trie(df.limit(0)).count() == 0


def test_trie_tells_equal_products_apart(spark, monkeypatch):
    monkeypatch.setattr(trie, "PRIMES", (31, 37))
    df = spark.createDataFrame([(c, t, "u", f"text {c * 7 + t}") for c in range(70) for t in range(4)], "conv_id long, turn int, role string, text string")
    with pytest.raises(RuntimeError):
        trie.conversation_trie(df).collect()


def shingles(text, n):
    ws = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    return {" ".join(ws)} if 0 < len(ws) < n else {" ".join(ws[k : k + n]) for k in range(len(ws) - n + 1)} if ws else set()


def components_brute(rows, n, percent):
    sets = [shingles(x, n) for _, x in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[top(k)] = min(d, least.get(top(k), d))
    return sorted(((d, len(s), least.get(top(k)) if s else d, d == (least.get(top(k)) if s else d)) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize("shingle", [2, 5])
def test_minhash_against_brute_force(spark, texts, shingle, monkeypatch):
    rng = random.Random(shingle)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = list(enumerate(texts))
    for k in range(90):  # a family around the threshold: many members near the hub, others only near each other
        own = list(base)
        for _ in range(rng.choice([0, 1, 3, 5, 8, 12, 20])):
            own[rng.randrange(len(own))] = f"v{rng.randrange(900)}"
        rows.append((100 + k, " ".join(own)))
    rows += [(300, "One"), (301, "one"), (302, "ONE two"), (303, "one\ttwo"), (None, rows[30][1]), (5, rows[5][1]), (None, "alone here by itself now ok")]
    df = spark.createDataFrame([(d, x, "z", d, "b") for d, x in rows], "doc_id long, text string, fp string, label long, bits string")
    out = minhash.minhash_duplicates(df, shingle=shingle)
    assert sorted(out.columns) == sorted(["doc_id", "fp", "label", "bits", *minhash.RESULTS])
    assert sorted(map(tuple, out.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str) == [(d, n, c, d == c) for d, n, c, _ in components_brute(rows, shingle, 80)]
    if shingle == 2:
        assert minhash.minhash_duplicates(df.limit(0)).count() == 0


def test_signatures_follow_similarity_and_vary_less():
    rng = np.random.default_rng(2)
    for j, n in ((0.8, 40), (0.5, 300)):
        shared = int(round(j * n))
        seen = []
        for _ in range(150):
            own = rng.integers(1, 1 << 62, 2 * n - shared).astype(np.uint64)
            a, b = minhash.signatures([own[:n], np.concatenate([own[:shared], own[n:]])])
            seen.append((a == b).mean())
        true = shared / (2 * n - shared)
        assert abs(np.mean(seen) - true) < 0.02
        assert np.std(seen) < 1.1 * np.sqrt(true * (1 - true) / minhash.SIZE)
        if n < minhash.SIZE:  # where ranks are all different, components are less spread than independent ones
            assert np.std(seen) < 0.9 * np.sqrt(true * (1 - true) / minhash.SIZE)
    few = [np.arange(1, k + 1, dtype=np.uint64) for k in range(4)]
    assert (minhash.signatures(few)[0] == 0).all() and (minhash.signatures([few[3], few[3][::-1]])[0] == minhash.signatures([few[3]])[0]).all()


def test_early_stopping_changes_nothing():
    """Against the plain form: every element takes all its steps."""
    from tradewind.llm.blobs import U64, mix

    x = np.random.default_rng(1).integers(1, 1 << 62, 900).astype(np.uint64)
    best = np.full(minhash.SIZE, ~U64(0))
    first = mix(x ^ U64(0xA5A5A5A5A5A5A5A5))
    b, a = (first & U64(0xFFFFFFFF)).astype(np.int64) % minhash.SIZE, 1 + (first >> U64(32)).astype(np.int64) % (minhash.SIZE - 1)
    for j in range(minhash.SIZE):
        offer = (mix(x + U64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U64(32)) | U64(j << 32)
        np.minimum.at(best, (a * j + b) % minhash.SIZE, offer)
    kind = minhash.signatures([x]).dtype
    assert (minhash.signatures([x])[0] == mix(best).astype(kind)).all()


def cells_of(spark, members, cell_rows):
    def one_variant(table):
        own = table["fp"].to_numpy().view(np.uint64)
        return own, simhash.mix(own >> np.uint64(40))

    fps = spark.createDataFrame(members, "fp long, label long")
    out = []
    for r in simhash.cells_apart(fps, one_variant, 1, cell_rows).collect():
        out.append(list(zip(*(unpack_raw(r.cell[c]).view(np.int64).tolist() for c in ("keys", "fps", "labels")), strict=True)))
    return out


def test_members_of_one_label_are_not_sent(spark):
    hot = [(1 << 40 | k, 7) for k in range(100_000)]
    assert cells_of(spark, hot, 1 << 18) == []
    cells = cells_of(spark, [*hot, (2 << 40, 1), (2 << 40 | 1, 2)], 1 << 18)
    assert sorted(m[1] for c in cells for m in c) == [2 << 40, 2 << 40 | 1]


def test_pieces_of_hot_variants_meet_in_pairs(spark):
    members = [(1 << 40 | k, 7) for k in range(900)] + [(1 << 40 | 1000 + k, 100 + k % 5) for k in range(60)] + [(3 << 40 | k, k) for k in range(150)]
    cells = cells_of(spark, members, 100)
    assert max(map(len, cells)) < 200
    met = {(a[1], b[1]) for c in cells for a in c for b in c if a[0] == b[0]}
    assert all((a, b) in met for a, la in members for b, lb in members if a >> 40 == b >> 40 and la != lb)
    # No cell is of the large label alone.
    assert all(len({m[2] for m in c}) > 1 for c in cells)


def test_stream_order_with_thousands_of_partitions(spark):
    rows = spark.range(3000).select(F.pmod(F.xxhash64("id"), F.lit(700)).alias("slot"), F.col("id").alias("place"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5000")
    try:
        out = mixing.in_stream_order(rows, rows)
        got = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [s for s, _ in got] == sorted(s for s, _ in got) and len(got) == 3000


def test_bounds_passed(spark):
    for bounds in ([], [5], [1, 2, 3, 10, 50], list(range(0, 900, 3))):
        df = spark.range(0, 1000).select("id", mixing.bounds_passed(F.col("id"), bounds).alias("n"))
        assert all(r.n == sum(b <= r.id for b in bounds) for r in df.collect())


SHAPES = {"dot, then digits": lambda n: "." + "1" * n, "digits, then dots": lambda n: "1" * n + "." * n, "dotted": lambda n: "12." * n, "dotted runs": lambda n: "1.." * n, "digits with one dot": lambda n: "1" * n + ".5 a"}


@pytest.mark.parametrize("name", SHAPES)
def test_base_spans_of_digits_beside_dots(name):
    text = SHAPES[name](2_000_000)
    began = time.time()
    pii.base_spans(text)
    assert time.time() - began < 20
    for n in (1, 2, 7, 40):
        text = "x" + SHAPES[name](n) + " 1.2.3.4 "
        want = [(m.start(), m.end(), 1) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s for s in pii.base_spans(text) if s[2] == 1] == want


def test_long_digits_through_spark(spark):
    rows = [(1, "." + "1" * 1_000_000), (2, "1" * 1_000_000 + "." * 1000), (3, "mail me@x.org or 10.0.0.1")]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(out[k].n_email, out[k].n_ip) for k in (1, 2, 3)] == [(0, 0), (0, 0), (1, 1)]


def test_url_rules_against_brute_force(spark):
    import re

    rng = random.Random(4)
    word = lambda: rng.choice(["ads", "img", "cdn", "track", "a", "b1", "shop", "x" + str(rng.randrange(60))])
    rules = [(f"r{k:03d}", f"/{w}/" if k % 3 else rf"[/.]{w}([/.]|$)", rng.choice(["block", "allow"]), [w], rng.randrange(5)) for k, w in ((k, word()) for k in range(300))]
    rules += [("two", r"\bads\b.*\bcdn\b", "block", ["ads", "cdn"], 9), ("none", "zz$", "block", [], 3), ("null", None, "block", ["a"], 99), ("host", r"://([^/]*\.)?b1\.org/", "allow", ["b1", "org"], 1_000_007)]
    urls = [f"http://{word()}.{rng.choice(['org', 'com'])}/{word()}/{word()}{rng.choice(['', '/', 'zz', '?q=' + word()])}" for _ in range(400)] + [None, "", "plain/ads/x"]
    urls += urls[:5]
    table = spark.createDataFrame(rules, "rule string, pattern string, verdict string, tokens array<string>, weight int")
    df = spark.createDataFrame([(k, u, "c") for k, u in enumerate(urls)], "page_id int, url string, token string")
    from tradewind.llm.url_filter import url_filter

    got = {r.page_id: (r.rule or r.pattern, r.verdict) for r in url_filter(df, rules=table).collect()}
    for k, u in enumerate(urls):
        text = u or ""
        if "://" in text:
            head, rest = text.split("://", 1)
            at = re.search(r"[/?#]|$", rest).start()
            text = "u://" + rest[:at].lower() + rest[at:]
        tokens = set(re.split("[^a-z0-9]+", text.lower()))
        fits = [(w, n, v) for n, p, v, t, w in rules if p is not None and re.search(p, text) and set(t) <= tokens]
        assert got[k] == (max(fits)[1:] if fits else (None, "allow")), u


def plain_subwords(text):
    """Counts of byte n-grams by bucket, byte by byte."""
    data = b" " + b" ".join(text.lower().split()) + b" "
    out = collections.Counter()
    for n in (2, 3, 4):
        for s in range(len(data) - n + 1):
            h = n
            for c in data[s : s + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
            h ^= h >> 15
            out[(h * 0x85EBCA6B & 0xFFFFFFFF) >> 16] += 1
    return out


def test_language_model_against_a_plain_twin():
    """The same descent with loops over subwords and languages, and scores from averaged embeddings, on few texts."""
    from tradewind.llm import langid

    rows = [(b"the cat sat on the mat", "en"), (b"der hund und die katze", "de"), ("el niño y la niña".encode(), "es"), (b"the dog and a cat", "en"), (b"das ist ein Haus", "de"), ("años de oro".encode(), "es")]
    model = langid.train(rows, dim=4, epochs=3)
    languages = ["de", "en", "es"]
    rng = np.random.default_rng(5)
    for x, _ in rows:  # the cuts come first
        for n in langid.CUTS:
            rng.integers(max(1, len(x.split()) - n + 1))
    e = rng.uniform(-1 / 4, 1 / 4, (langid.BUCKETS, 4))
    w = [[0.0] * 3 for _ in range(4)]
    at = 0
    for _ in range(3):
        for k in rng.permutation(len(rows)).tolist():
            counts, y = plain_subwords(rows[k][0]), languages.index(rows[k][1])
            total = sum(counts.values())
            h = [sum(n / total * e[b][d] for b, n in counts.items()) for d in range(4)]
            z = [sum(h[d] * w[d][c] for d in range(4)) for c in range(3)]
            top = max(z)
            g = [np.exp(v - top) for v in z]
            g = [v / sum(g) - (c == y) for c, v in enumerate(g)]
            lr = 4.0 * (1 - at / 18)
            at += 1
            back = [sum(w[d][c] * g[c] for c in range(3)) for d in range(4)]
            w = [[w[d][c] - lr * 0.1 * h[d] * g[c] for c in range(3)] for d in range(4)]
            for b, n in counts.items():
                for d in range(4):
                    e[b][d] -= lr * np.sqrt(len(counts)) * n / total * back[d]
    assert model.languages == languages
    for text in ("the house", "und der", "niño", "xyz", "The CAT\tsat"):
        counts = plain_subwords(text.encode())
        total = sum(counts.values())
        h = [sum(n / total * e[b][d] for b, n in counts.items()) for d in range(4)]
        z = np.array([sum(h[d] * w[d][c] for d in range(4)) for c in range(3)])
        assert np.allclose(model.logits(text.encode()), z, atol=1e-4)
        p = np.exp(z / model.temperature - (z / model.temperature).max())
        lang, score, accepted = model.predict(text.encode())
        assert lang == languages[int(z.argmax())] and abs(score - (p / p.sum()).max()) < 1e-2 and accepted == (score >= model.threshold)
