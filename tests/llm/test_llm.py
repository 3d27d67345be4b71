"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import json
import math
import random
import re
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, html, jaccard, lines, media, mixing, ppm, quality, substrings, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    r = random.Random(5)
    vocab = ["".join(r.choice("etaoinshr") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = prose(90)
    out = [None, "", " ", "\n\n", "one", "Same line of text here\nSame line of text here", "short\nline"]
    out += [f"{prose(r.randint(3, 120))}\n{prose(20)}. Ünïcødé ΣΑΣ été\t{prose(30)}" for _ in range(25)]
    base = prose(160)
    out += [base, base, base.upper(), base + " tail", "head " + base, base.replace(base.split()[80], "changed", 1)]
    out += [f"{prose(40)} {passage} {prose(30)}" for _ in range(3)] + [passage, passage + " " + passage]
    out += ["%%% $$$ ### &&& | < > * " * 30, "again and again we go on " * 40, prose(9000), "x" * 30000]
    return out


@pytest.fixture(scope="module")
def rows():
    sources = ["a", "b", None, "Z"]
    out = [(i, t, "en", sources[i % 4]) for i, t in enumerate(texts())]
    out += [out[9], (None, out[10][1], "en", "a"), (None, "null id " * 40, "de", "a"), (12, "second text of a repeated id " * 8, "fr", "b")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("kept_text", F.lit("x")).withColumn("n_words", F.lit(1)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def bag(df, *cols):
    return collections.Counter(tuple(r) for r in df.select(*cols).collect())


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# ---------------------------------------------------------------- 1


def test_mixing(docs, rows, empty):
    got = mixing.copies(docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len(WORD.findall(t or ""))
    total, order = sum(size.values()), ["Z", "a", "b", None]
    weight, capped = dict(zip(order, (5, 2, 1, 5), strict=True)), set()
    while True:
        free = sum(weight[s] for s in order if s not in capped)
        left = total - sum(3 * size[s] for s in capped)
        goal = {s: 3 * size[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if goal[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    taken = collections.Counter()
    for r in got:
        assert math.isclose(r["target"], goal[r["source"]], rel_tol=1e-9) and r["source_size"] == size[r["source"]]
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    largest = max(len(WORD.findall(t or "")) for _, t, _, _ in rows)
    assert all(abs(taken[s] - goal[s]) <= largest for s in order)
    assert bag(mixing.copies(docs.repartition(7)), "id", "row", "copies") == bag(mixing.copies(docs), "id", "row", "copies")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.copies(empty).count() == 0


def test_pivot_keeps_the_words(spark):
    import numpy as np

    r = np.random.default_rng(1)
    size, p = r.integers(1, 50, 500).astype(float), r.random(500)
    out, left = mixing.pivot(size, p, r.random(500))
    assert abs((out * size).sum() - (p * size).sum()) < 1e-6 and ((out == 0) | (out == 1) | (np.arange(500) == left)).all()


def test_settle_brings_a_long_remainder_near():
    import numpy as np

    size = np.array([5000.0, *range(1, 301)])
    p = np.full(301, 0.4)
    for seed in range(20):
        draw = np.random.default_rng(seed).random(301)
        out, left = mixing.pivot(size, p, draw)
        if left >= 0:
            out[left] = float(draw[0] < out[left])
        before, out = (size * (p - out)).sum(), mixing.settle(size, p, out)
        after = (size * (p - out)).sum()
        assert set(out.tolist()) <= {0.0, 1.0} and abs(after) <= abs(before) and abs(after) < 0.001 * (size * p).sum()
        turns = after - size * (1 - 2 * out)  # what is missing after each single turn
        assert (abs(turns) >= abs(after) - 1e-6).all()
    assert mixing.settle(size[:1], p[:1], np.zeros(1)).tolist() == [0.0]


def test_pivot_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    df = spark.createDataFrame([(i, "w " * (i % 17 + 1), "s" if i % 3 else "t") for i in range(1500)], "doc_id long, text string, source string")
    g = mixing.copies(df).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("k"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in g) == 1500 and all(abs(r["t"] - r["k"]) <= 17 for r in g)


# ---------------------------------------------------------------- 2


def test_media(docs, rows, empty):
    got = media.columns(docs).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t, _, _ in rows:
        data = (t or "").encode()
        pay = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        want[i, len(data), len(pay), sha(pay), zlib.crc32(pay[-32:]), len(pay) // 576] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["height"]) for r in got) == want
    assert media.columns(empty).count() == 0
    with pytest.raises(ValueError):
        media.decode_png(media.encode_png(bytes(576))[:-20] + bytes(20))


def test_shards_are_tar_files(spark, docs):
    import tarfile

    catalog = media.store(docs).collect()
    assert len({r["digest"] for r in catalog}) == len(catalog)
    for shard in {r["shard"] for r in catalog}:
        path = shard.removeprefix("file://")
        with tarfile.open(path) as t:
            assert all(m.name.endswith(".pngs") or m.name == media.INDEX for m in t.getmembers())
            index = [json.loads(x) for x in t.extractfile(media.INDEX).read().splitlines()]
        data = open(path, "rb").read()
        for x in index:  # each object is found in the shard by its digest
            assert sha(media.decode_png(data[x["offset"] : x["offset"] + x["length"]])) == x["digest"]
        assert {r["digest"] for r in catalog if r["shard"] == shard} <= {x["digest"] for x in index}
        for r in catalog:
            if r["shard"] == shard:
                assert sha(media.decode_png(data[r["offset"] : r["offset"] + r["length"]])) == r["digest"]


# ---------------------------------------------------------------- 3


def test_line_dedup(docs, rows, empty):
    first, key = {}, lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    order = lambda i: math.inf if i is None else i
    for i, t, _, _ in rows:
        for line in (t or "").split("\n"):
            first[key(line)] = min(first.get(key(line), math.inf), order(i))
    want = collections.Counter()
    for i, t, _, _ in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < 10 or first[key(x)] == order(i)]
        want[i, len(ls), len(ls) - len(kept), sha("\n".join(kept))] += 1
    df, n = lines.with_kept(docs)
    assert bag(df, "doc_id", n["n_lines"], n["n_dropped"], F.sha2(n["kept"], 256)) == want
    assert lines.dedup(docs).columns == docs.columns and lines.dedup(empty).count() == 0


def test_hot_lines_give_the_same(spark):
    rows = [(i, f"a very common line\nline number {i % 50} of it\nend") for i in range(3000)]
    out = lines.with_kept(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r[0]: r[1] for r in out[0].select("doc_id", out[1]["n_dropped"]).collect()}
    assert got == {i: int(i > 0) + int(i >= 50) for i in range(3000)}


# ---------------------------------------------------------------- 4


def test_bpe_equals_the_library(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    want = collections.Counter()
    for i, x, _, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), sha(b"".join(k.to_bytes(4, "little") for k in ids)), sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert bag(bpe.digests(docs, ["doc_id"]), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.digests(empty, ["doc_id"]).count() == 0
    assert bpe.encoded(docs).columns == [*docs.columns, "token_ids"]


@pytest.fixture(scope="module")
def coder():
    return bpe.Transducer(bpe.vocabulary_path())


def test_bpe_odd_texts(coder):
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(bpe.vocabulary_path()), random.Random(2)
    cases = ["<|endoftext|>", "a<|startoftext|>b<|endoftext|>", "it's we'll I'D", "١٢٣ ½ ǅ ﬁ", "áé  x y", "Σ ΑΣ", "\U00018f86 \U0001e030 \U00010d50", "ha" * 8000, "é" * 9000]
    cases += ["".join(chr(r.choice([r.randint(32, 0x24F), r.randint(0x370, 0x3FF), r.randint(0x4E00, 0x4FFF), r.randint(0x1F300, 0x1F6FF)])) for _ in range(30)) for _ in range(200)]
    for x in cases:
        parts = b"".join(coder.encode(x))
        assert [int.from_bytes(parts[k : k + 4], "little") for k in range(0, len(parts), 4)] == t.encode(x, add_special_tokens=False).ids, x[:60]


def test_bpe_marks_that_the_library_does_not_know(coder):
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(bpe.vocabulary_path()), random.Random(9)
    marks = [c for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))]
    cases = ["\U00011935\U00011930", "\U00011938", *("".join(chr(r.choice([r.choice(marks), r.choice(marks), r.randint(0x61, 0x17F), 0x20])) for _ in range(10)) for _ in range(3000))]
    for x in cases:
        parts = b"".join(coder.encode(x))
        assert [int.from_bytes(parts[k : k + 4], "little") for k in range(0, len(parts), 4)] == t.encode(x, add_special_tokens=False).ids, ascii(x)


def test_the_lookahead_suffices():
    """On a small merge list: what ends `ahead` before the end never changes, whatever follows."""
    r = random.Random(4)
    for _ in range(40):
        symbols = list("abc")
        merges, seen = [], set()
        for _ in range(12):
            pair = (r.choice(symbols), r.choice(symbols))
            if pair not in seen and len("".join(pair)) < 9 and "".join(pair) not in symbols:
                seen.add(pair)
                merges.append(pair)
                symbols.append("".join(pair))
        ids = {s: i for i, s in enumerate(symbols)}
        m, length = bpe.Merges(merges, ids), {i: len(s) for s, i in ids.items()}
        ahead = m.lookahead(length)
        for _ in range(60):
            head = [ids[r.choice("abc")] for _ in range(r.randint(1, 30))]
            ends = []
            for _ in range(2):
                at, out = 0, []
                for x in m.apply(head + [ids[r.choice("abc")] for _ in range(r.randint(0, 25))]):
                    at += length[x]
                    if at <= len(head) - ahead:
                        out.append((at, x))
                ends.append(out)
            assert ends[0] == ends[1]


def test_incremental_decoding():
    data = {0: "é".encode()[:1], 1: "é".encode()[1:], 2: b"x", 3: b"\xf0\x9f"}
    d = bpe.ByteText(data)
    assert d.feed([0]) + d.feed([1, 2]) + d.feed([3]) + d.feed([], final=True) == "éx�"
    j = bpe.Joined({0: "a", 1: "b</w>"})
    assert j.feed([0]) + j.feed([]) + j.feed([1, 0]) == "a b</w> a"


# ---------------------------------------------------------------- 5 and 9


def brute_cover(items, window):
    count = collections.Counter(tuple(x[j : j + window]) for x in items for j in range(len(x) - window + 1))
    out = []
    for x in items:
        gone = [False] * len(x)
        for j in range(len(x) - window + 1):
            if count[tuple(x[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out.append(gone)
    return out


def thue_morse(n):
    """Two unlike words of 2 ** n letters that have equal hashes in any polynomial modulo 2 ** 64."""
    bits = "a"
    for _ in range(n):
        bits += bits.translate(str.maketrans("ab", "ba"))
    return bits, bits.translate(str.maketrans("ab", "ba"))


def test_patterned_words_are_told_apart(spark):
    """In word dedup, the Jaccard join and word counts."""
    a, b = thue_morse(10)
    body = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*body[:30], a, *body[30:]])), (2, " ".join([*body[:30], b, *body[30:]])), (3, a), (4, b), (6, " ".join(body[:34]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(substrings.kept(df), "doc_id", "n_removed") == collections.Counter((i, 0) for i, _ in rows)
    assert bag(jaccard.components(df), "doc_id", "n_shingles", "component_id") == brute_components(rows)
    assert {r["doc_id"]: r["n_known"] for r in ppm.scores(df).collect()}[4] == 1 + (zlib.crc32(b"4") % 5 != 1)


def test_substring_dedup(docs, rows, empty):
    items = [(t or "").encode().split() for _, t, _, _ in rows]
    want = collections.Counter()
    for (i, *_), w, gone in zip(rows, items, brute_cover(items, 35), strict=True):
        want[i, len(w), sum(gone), sha(b" ".join(a for a, b in zip(w, gone, strict=True) if not b))] += 1
    got = substrings.kept(docs.drop("n_words"))
    assert bag(got, "doc_id", "n_words", "n_removed", F.sha2("kept", 256)) == want
    assert substrings.kept(empty).count() == 0


def test_suffix_dedup(docs, rows, empty, monkeypatch):
    passage = "a passage of less than four hundred bytes that two texts share " * 5
    short = [(i, t if t is None or len(t) < 5000 else t[:5000]) for i, t, _, _ in rows] + [(900, "one " + passage + "end of it"), (901, passage + "and another end")]
    items = [(t or "").encode() for _, t in short]
    want = collections.Counter()
    marks = {}
    for w in (256, 400):
        count = collections.Counter(x[j : j + w] for x in items for j in range(len(x) - w + 1))
        for k, x in enumerate(items):
            gone = marks[w, k] = bytearray(len(x))
            for j in range(len(x) - w + 1):
                if count[x[j : j + w]] > 1:
                    gone[j : j + w] = b"\1" * w
    for k, ((i, _), x) in enumerate(zip(short, items, strict=True)):
        gone = marks[400, k]
        want[i, len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), sum(marks[256, k]), sha(bytes(a for a, b in zip(x, gone, strict=True) if not b))] += 1
    assert any(r[4] > r[2] for r in want)
    df = docs.sparkSession.createDataFrame(short, "doc_id long, text string").repartition(3)
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", F.sha2("kept", 256))
    assert bag(suffixes.kept(df), *cols) == want
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 600)  # tiles, merged by binary search
    assert bag(suffixes.kept(df), *cols) == want
    assert suffixes.kept(empty).count() == 0


def test_suffix_arrays():
    import numpy as np

    r = np.random.default_rng(3)
    for letters, n in ((1, 300), (2, 3000), (4, 3000)):
        x = r.integers(97, 97 + letters, n).astype(np.uint8)
        x[n // 2 :] = x[: n - n // 2]
        raw, order = x.tobytes(), suffixes.suffix_array(x)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        common = suffixes.kasai(x, order, 50)
        for k in range(1, n):
            a, b = raw[order[k - 1] :][:50], raw[order[k] :][:50]
            assert common[k] == next((j for j, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


# ---------------------------------------------------------------- 6


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return collections.Counter((i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets))


def test_jaccard(docs, rows, empty, monkeypatch):
    want = brute_components([(i, t) for i, t, _, _ in rows])
    assert bag(jaccard.components(docs), "doc_id", "n_shingles", "component_id") == want
    monkeypatch.setattr(jaccard, "TILE_TOKENS", 300)
    monkeypatch.setattr(jaccard, "GROUP", 2)
    assert bag(jaccard.components(docs), "doc_id", "n_shingles", "component_id") == want
    assert jaccard.components(empty).count() == 0
    assert jaccard.dedup(docs).columns == docs.columns


def test_jaccard_dedup_keeps_a_row_of_each_component(docs, rows, spark):
    """Null ids and repeated ids with unlike texts: a row per component, of its smallest id, and each row without words."""

    def want(rows):
        sets = []
        for _, t in rows:
            w = WORD.findall((t or "").translate(LOWER))
            sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        root = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    root = [root[b] if r == root[a] else r for r in root]
        out = collections.defaultdict(list)
        for r, s, row in zip(root, sets, rows, strict=True):
            out[r if s else object()].append(row)
        return list(out.values())

    def check(df, rows):
        left = list(map(tuple, df.select("doc_id", "text").collect()))
        assert len(left) == len(want(rows))
        for group in want(rows):
            least = min((i for i, _ in group if i is not None), default=None)
            own = next(x for x in left if x[0] == least and x in group)
            left.remove(own)

    check(jaccard.dedup(docs), [(i, t) for i, t, _, _ in rows])
    prose = lambda k: " ".join(f"{c}{k}" for c in "abcdefghij")
    more = [(None, prose(k)) for k in range(9)] + [(None, prose(3)), (None, None), (None, ""), (7, prose(20)), (7, prose(21)), (7, prose(21).upper()), (3, prose(21)), (None, prose(20)), (5, " "), (5, " "), (None, "")]
    check(jaccard.dedup(spark.createDataFrame(more, "doc_id long, text string").repartition(3)), more)


def test_jaccard_near_the_threshold(spark, monkeypatch):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(40):
        base = [r.choice(vocab) for _ in range(r.randint(5, 90))]
        for _ in range(r.randint(1, 5)):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = r.choice(vocab)
            rows.append((n, " ".join(own + [r.choice(vocab) for _ in range(r.randint(0, 6))])))
            n += 1
    monkeypatch.setattr(jaccard, "TILE_TOKENS", 500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert bag(jaccard.components(df), "doc_id", "n_shingles", "component_id") == brute_components(rows)


# ---------------------------------------------------------------- 7


def test_lm_scores(docs, rows, empty):
    toks = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t, _, _ in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, *_ in rows]
    count = collections.Counter(w for ws, h in zip(toks, held, strict=True) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for (i, *_), ws, h in zip(rows, toks, held, strict=True):
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want[i, h, len(ws), sum(w in count for w in ws), n, round(base, 6)] += 1
    got = ppm.scores(docs)
    assert bag(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)) == want
    assert all(r["score"] < 0 for r in got.collect()) and ppm.scores(empty).count() == 0


def test_ppm_is_a_distribution_and_learns():
    import numpy as np
    import pyarrow as pa

    from ledgerloom.llm.text import utf8

    raw, off = utf8(pa.array(["abracadabra alakazam " * 30, "the cat sat on the mat " * 20]))
    context, symbol, _ = ppm.contexts(raw, off)
    grams, n = np.unique((context << np.uint64(8)) | symbol, return_counts=True)
    counts = {}
    for k in range(ppm.ORDER + 1):
        keys, at = np.unique(grams & np.uint64((1 << (8 * k + 8)) - 1), return_inverse=True)
        counts[k] = [(keys >> np.uint64(8)).astype(np.int64), (keys & np.uint64(255)).astype(np.int64), np.bincount(at, n)]
    trie = ppm.Trie(counts)
    assert np.allclose((10.0 ** trie.rows.reshape(-1, 256)).sum(1), 1, atol=1e-3)
    assert trie.score(context, symbol).sum() > -0.2 * len(symbol)
    with np.errstate(divide="ignore"):
        bare = ppm.Trie({k: [np.zeros(0, np.int64)] * 3 for k in range(ppm.ORDER + 1)})
    assert np.allclose(bare.score(context, symbol), -math.log10(256), atol=1e-4)


def test_lm_scores_of_all_contexts(spark):
    """Against a loop, over more contexts of five bytes than the trie once kept (24,576)."""
    r = random.Random(12)
    rows = [(i, " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 7))) for _ in range(700))) for i in range(60)]
    seen = collections.defaultdict(collections.Counter)
    split = lambda t: [(b"\xff" * 5 + t)[j : j + 5] for j in range(len(t) + 1)]
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for context, symbol in zip(split(t.encode()), t.encode() + b"\xff", strict=True):
                for k in range(6):
                    seen[context[5 - k :]][symbol] += 1
    assert sum(len(c) == 5 for c in seen) > 24_576

    def code(context, symbol):
        mass, out = 1.0, set()
        for k in range(5, -1, -1):
            here = {s: n for s, n in seen.get(context[5 - k :], {}).items() if s not in out}
            if here:
                if symbol in here:
                    return math.log10(mass * (here[symbol] - 0.5) / sum(here.values()))
                mass *= 0.5 * len(here) / sum(here.values())
                out |= set(here)
        return math.log10(mass / (256 - len(out)))

    got = {x["doc_id"]: x["score"] for x in ppm.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in rows:
        assert math.isclose(got[i], sum(map(code, split(t.encode()), t.encode() + b"\xff")), rel_tol=1e-5)


# ---------------------------------------------------------------- 8


def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    count = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    covered = {j + k for j in range(len(w) - 4) if count[tuple(w[j : j + 5])] > 1 for k in range(5)}
    ls = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality(docs, rows, empty):
    got = quality.judge(docs.drop("n_words"))
    want = collections.Counter((i, *brute_quality(t)) for i, t, _, _ in rows)
    assert bag(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and not any("%%%" in (r["text"] or "") for r in kept.collect())
    assert quality.keep(empty).count() == 0 and quality.judge(empty).count() == 0


def brute_posterior(patterns, rounds=200):
    """The same model in plain loops."""
    rules = len(patterns[0][0])
    good = [1 / (1 + math.exp(-sum(p))) for p, _ in patterns]
    for _ in range(rounds):
        rate, total = {}, {}
        for kind in (0, 1):
            weight = [n * (g if kind else 1 - g) for (_, n), g in zip(patterns, good, strict=True)]
            total[kind] = sum(weight) + quality.PRIOR_TEXTS
            for j in range(rules):
                for a, prior in zip((-1, 0, 1), quality.PRIOR[kind], strict=True):
                    rate[kind, j, a] = sum(w for (p, _), w in zip(patterns, weight, strict=True) if p[j] == a) + quality.PRIOR_TEXTS * prior
                whole = sum(rate[kind, j, a] for a in (-1, 0, 1))
                for a in (-1, 0, 1):
                    rate[kind, j, a] /= whole
        odds = [math.log(total[1] / total[0]) + sum(math.log(rate[1, j, a] / rate[0, j, a]) for j, a in enumerate(p)) for p, _ in patterns]
        good = [1 / (1 + math.exp(-x)) for x in odds]
    return good


def verdicts(patterns):
    bias, weights = quality.expectation_maximisation(patterns)
    return [bias + sum(w[a + 1] for w, a in zip(weights, p, strict=True)) for p, _ in patterns]


def test_em_differs_from_all_must_pass():
    """Rule 0 also errs on good texts, rules 1 to 3 answer on nearly all of them."""
    patterns = [((1, 1, 1, 1), 900), ((-1, 1, 1, 1), 60), ((-1, -1, -1, 0), 70), ((0, -1, -1, -1), 30), ((0, 0, 0, -1), 40), ((-1, 0, 0, 0), 30), ((0, 0, 0, 0), 3)]
    got = dict(zip([p for p, _ in patterns], verdicts(patterns), strict=True))
    assert got[-1, 1, 1, 1] > 0 and got[0, 0, 0, 0] < 0 and got[1, 1, 1, 1] > 0 and got[-1, -1, -1, 0] < 0
    want = brute_posterior(patterns)
    assert all(math.isclose(1 / (1 + math.exp(-x)), w, abs_tol=1e-6) for x, w in zip(got.values(), want, strict=True))
    assert quality.expectation_maximisation([]) == (0.0, [])


def test_quality_verdicts(spark):
    """The whole query's kept against brute force: measures, votes, model and posterior."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() + "." * (r.random() < 0.1) for _ in range(n))
    rows = [prose(r.randint(12, 200)) for _ in range(150)] + [" ".join(w + r.choice(["###", "$$$", "%%%"]) for w in prose(80).split()) for _ in range(20)]
    rows += [" | ".join(prose(60).split()) for _ in range(15)] + [f"{prose(5)} {prose(4) * 8}" for _ in range(5)] + [prose(40) + " #1" for _ in range(6)] + [None, "", "12 34 56 78 90 12 34 56 78 90 11 22"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)

    def answers(t):
        n, wc, sym, dup, rep, _ = brute_quality(t)
        w, t = WORD.findall(t or ""), t or ""
        ls, let = sum(bool(WORD.search(x)) for x in t.split("\n")), sum(c.isalpha() for c in t)
        bare, ends = sum(not any(c.isalpha() for c in x) for x in w), sum(x[-1] in ".!?" for x in w)
        pairs = [(10 * sym > n, sym == 0), (100 * sym > 3 * wc, 200 * sym < wc), (10 * let < 7 * wc, 10 * let >= 8 * wc), (5 * bare > n, 20 * bare <= n), (wc < 3 * n or 2 * wc > 15 * n, 7 * n <= 2 * wc <= 13 * n)]
        pairs += [(100 * ends < n or 10 * ends > 4 * n, 50 * ends >= n and 10 * ends <= 3 * n), (10 * dup > 3 * ls, dup == 0), (10 * rep > n, 50 * rep <= n), (10 * len(set(w)) < 3 * n, 2 * len(set(w)) >= n), (n < 20, n >= 50)]
        return tuple(-1 if bad else int(good) for bad, good in pairs)

    count = collections.Counter(map(answers, rows))
    patterns = sorted(count.items())
    good = dict(zip([p for p, _ in patterns], brute_posterior(patterns), strict=True))
    want = {i: not brute_quality(t)[-1] and good[answers(t)] >= 0.5 for i, t in enumerate(rows)}
    assert {x["doc_id"]: x["kept"] for x in quality.judge(df).collect()} == want
    assert any(k and -1 in answers(rows[i]) for i, k in want.items()) and sorted(x["doc_id"] for x in quality.keep(df).collect()) == [i for i, k in want.items() if k]


# ---------------------------------------------------------------- 10

ARTICLE = "<article><h1>Head &amp; line</h1><p>First\n  part<br>of it <b>bold</b><p>Second&nbsp;one</p></article>"
PAGE = f'<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div>{ARTICLE}<aside>side</aside><div class="comments"><p>I disagree with all of this very strongly indeed</p></div><footer>&copy; x</footer></body></html>'


def test_html(spark):
    want = "Head & line\nFirst part of it bold\nSecond one"
    rows = [(i, f"http://h.org/{i}", PAGE) for i in range(6)]
    rows += [(6, "http://h.org/odd", "<body><div class='post-7'><p>only this text here</p></div>"), (7, None, None), (8, "u", ""), (9, "http://g.org/", "<p>cut <b off"), (0, "http://h.org/0", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = collections.Counter((r["page_id"], r["text"], r["n_chars"]) for r in html.extracted(df).collect())
    assert got == collections.Counter([*((i, want, len(want)) for i in (*range(6), 0)), (6, "only this text here", 19), (7, "", 0), (8, "", 0), (9, "cut", 3)])
    assert html.extracted(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<main><h1>T</h1><div class='body'><p>one</p><p>two</p></div></main><div class='sidebar'><p>no no no no no no</p></div>", "T\none\ntwo"),
        ("<article><header><h1>T</h1></header><p>a&nbsp;b<br>c</p><ul><li>1<li>2</ul><form><p>f</p></form>tail</article><footer>z", "T\na b c\n1\n2\ntail"),
        ("<div id='cookie-notice'><p>We use many cookies on this site of ours</p></div><div><p>real text</p></div>", "real text"),
        ("a < b <b>x</b>y", "a < b xy"),
        ("<p>x<span class='ad'>buy</span>y</p><div hidden><p>h</p></div>", "xy"),
        ("<article><p>1 &lt; 2 &#233;&amp;&amp;</p><noscript><p>no</p></noscript></article>", "1 < 2 é&&"),
    ],
)
def test_html_cases(source, text):
    assert html.extract(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<article><header><h1>T</h1></header><div class='entry-content'><p>one and one</p><p>two</p></div></article>", "T\none and one\ntwo"),
        ("<article><p>lead</p><div class='body'><p>one and one and one</p><p>two</p></div></article><div class='related'><article><p>other</p></article></div>", "lead\none and one and one\ntwo"),
        ("<main><header><h1>T</h1></header><article><div><p>one and one</p></div></article></main>", "T\none and one"),
        ("<div class='content has-sidebar'><article><h1>T</h1><p>text of it</p></article><div class='sidebar'><p>no no no</p></div></div>", "T\ntext of it"),
        ("<section id='page-comments-on'><main><p>text</p></main></section><div class='comments'><p>long long long long</p></div>", "text"),
        ("<div class='content has-sidebar'><p>most of the text of this page</p></div><div><p>bit</p></div>", "most of the text of this page"),
        ("<div class='story'><p>short</p></div><div class='comments-area'><p>long long long long</p></div>", "short"),
    ],
)
def test_html_takes_the_whole_article(source, text):
    assert html.extract(source) == text


def test_hosts_agree_on_a_path(spark):
    """A page whose comments outweigh its article still yields the article, as its host's other pages vote."""
    body = "<div class='content-3'><p>{}</p></div><div class='thread'><p>{}</p></div>"
    rows = [(i, f"http://k.net/{i}", body.format("good words of the article " * 20, "chat")) for i in range(5)]
    rows.append((9, "http://k.net/9", body.format("short article", "long chatter " * 80)))
    got = {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short article"


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = [(i, t) for i, t, _, _ in rows if not brute_quality(t)[-1]]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        assert {r["doc_id"] for r in df.collect()} <= {i for i, _ in good}
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.count() == df.count() > 0
    assert final.agg(F.sum("n_tokens")).first()[0] == corpus_pipeline.STAGES[-1][1](spark, df, "").agg(F.sum("n_tokens")).first()[0]


PROSE = "Some plain words of the article that go on for a while, as they do. " * 3


@pytest.mark.parametrize(
    "source,text",
    [
        (f"<body><form id=aspnet><nav>x</nav><div class=c><article><h1>T</h1><p>{PROSE}</p></article></div></form></body>", f"T\n{PROSE.strip()}"),
        (f"<body><form id=aspnet><nav>x</nav><div class=c><p>{PROSE}</p><p>{PROSE}</p></div></form></body>", f"{PROSE.strip()}\n{PROSE.strip()}"),
        (f"<article><p>{PROSE}</p><form><label>Mail</label><p>Write to us.</p></form></article>", PROSE.strip()),
        ("<body><form><label>Name</label><input><label>Mail</label></form></body>", ""),
        (f"<article><p>{PROSE}</p><p class='share-price'>It rose.</p><section class='related-work'><p>Earlier work.</p></section></article>", f"{PROSE.strip()}\nIt rose.\nEarlier work."),
        (f"<article><p>{PROSE}</p><div class='related-posts'><a href=1>One</a> <a href=2>Two</a></div></article>", PROSE.strip()),
        (f"<article><p>{PROSE}</p><p>a <math><mi>x</mi></math> <span class='share-price'>12</span></p></article>", f"{PROSE.strip()}\na x 12"),
    ],
)
def test_html_keeps_parts_of_an_article(source, text):
    assert html.extract(source) == text


def test_two_tiles_have_one_array(spark, monkeypatch):
    """The tiles of a large component are sorted two at a time, not merged pair by pair."""
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 600)
    monkeypatch.setattr(suffixes, "merge", None)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = text(700)
    docs = [(i, text(rng.randrange(300)) + common[i * 20 : i * 20 + 450] + text(rng.randrange(300))) for i in range(12)]
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffixes.kept(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    starts = collections.Counter(t[i : i + 400] for _, t in docs for i in range(len(t) - 399))
    for i, t in docs:
        off = {j + k for j in range(len(t) - 399) if starts[t[j : j + 400]] > 1 for k in range(400)}
        assert got[i] == (len(off), "".join(x for j, x in enumerate(t) if j not in off).encode())
    assert sum(n for n, _ in got.values())


def test_chains_of_passages_are_not_searched_by_pairs_of_tiles(spark, monkeypatch, tmp_path):
    """Each text shares a passage with the next: all are one component, but what is searched doesn't grow with the square of the chain."""
    search = suffixes.search

    def counted(windows):
        run = search(windows)

        def of(rows):
            import uuid

            (tmp_path / uuid.uuid4().hex).write_text(str(sum(len(x.as_py()) for x in rows.column("data"))))
            return run(rows)

        return of

    monkeypatch.setattr(suffixes, "SHARD_BYTES", 2000)
    monkeypatch.setattr(suffixes, "search", counted)
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefg é") for _ in range(12700))
    docs = [(i, long[200 * i : 200 * i + 700]) for i in range(60)]
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffixes.kept(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    texts = [(i, t.encode()) for i, t in docs]
    starts = collections.Counter(t[i : i + 400] for _, t in texts for i in range(len(t) - 399))
    for i, t in texts:
        off = {j + k for j in range(len(t) - 399) if starts[t[j : j + 400]] > 1 for k in range(400)}
        assert got[i] == (len(off), bytes(x for j, x in enumerate(t) if j not in off))
    searched = sum(int(p.read_text()) for p in tmp_path.iterdir())
    assert 0 < searched < 6 * sum(len(t) for _, t in texts), searched / sum(len(t) for _, t in texts)
