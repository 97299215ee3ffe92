import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import decontaminate, mixing, quality, sharding, simhash, sstable
from paperloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_quality_counts(spark, odd):
    out = {(r["doc_id"], r["text"]): r for r in quality.judge(odd).collect()}
    assert len(out) == len(set(key(odd)))
    for (_, text), r in out.items():
        w = WORD.findall(text or "")
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert (r["q_n_words"], r["q_word_chars"], r["q_dup_lines"], r["q_repeat_words"], r["q_failed"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again), failed)
    kept = {r["doc_id"] for r in quality.clean(odd).collect()}
    assert 8 in kept and 7 not in kept and 3 not in kept
    assert quality.clean(odd).columns == odd.columns
    assert quality.judge(odd.limit(0)).count() == 0


def test_quality_many_repeats(spark):
    text = " ".join(str(i % 40) for i in range(400)) + " tail end here"
    r = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["q_repeat_words"] == 400


def test_token_shards(spark, odd, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, out = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/s"
    manifest = sstable.write(odd, out, path)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in sstable.read(spark, out).collect())
    plain = Tokenizer.from_file(path)
    want = sorted((d is not None, d or 0, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t in key(odd) for i in [[*plain.encode(t or "", add_special_tokens=False).ids, 2]])
    assert sorted((a, b, n, c) for a, b, _, n, c in got) == want
    starts = sorted((s, n) for _, _, s, n, _ in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    import pyarrow.fs as fs

    found = {}
    for m in manifest:
        with fs.LocalFileSystem().open_input_file(f"{tmp_path}/s/{m['name']}") as f:
            r = sstable.Reader(f)
            for d in [1, 3, 8, None, 999]:
                if (ids := r.get(d)) is not None:
                    found[d] = ids.tolist()
    assert set(found) == {1, 3, 8, None} and found[3] == [2]
    assert sstable.read(spark, out).count() == odd.count()
    sstable.write(odd.limit(0), f"{out}0", path)
    assert sstable.read(spark, f"{out}0").count() == 0


def test_encoder_words_equal_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["It's don't; étude, ÀÉ. a_b 12,3 x" + "y" * 300, "é İstanbul ǅ ʼn ﬁ <|endoftext|> a b c \x1c d", "漢字 Große STRASSE. ...!! '' ??", ""]
    encode, plain = sstable.Encoder(path), Tokenizer.from_file(path)
    assert [x.tolist() for x in encode([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("blocks", [1, 3])
def test_decontamination(spark, odd, monkeypatch, blocks):
    base = "The quick brown fox jumps over one lazy dog near the old river bank today. "
    items = [(1, base), (2, "Unique3 unique4"), (2, "unique4 UNIQUE5"), (None, "lazy dog"), (4, None), (5, "..."), (6, "never seen here"), (10, base * 2 + "more")]
    if blocks > 1:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in items:
        w = word(t)
        k = min(13, len(w))
        for s in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[s : s + k]), set()).add("null" if i is None else str(i))
    marked = [decontaminate.mark(odd.repartition(n), bench).withColumn("bad", decontaminate.verdict()).collect() for n in (1, 5)]
    out, again = (sorted((str(r["doc"]["doc_id"]), r["d_words"], r["d_hit"], r["d_items"], r["bad"], r["d_longest"], r["d_item"] or "", r["d_at"] or 0) for r in rows) for rows in marked)
    assert out == again
    want = []
    parts = [("null" if i is None else str(i), word(t)) for i, t in items]
    for d, t in key(odd):
        w, hit, names = word(t), set(), set()
        for g, ids in windows.items():
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit.update(range(s, s + len(g)))
                    names |= ids
        best = (0, "", 0)
        for i, b in parts:
            for s in range(len(w)):
                for j in range(len(b)):
                    n = next((n for n in range(len(b) - j) if s + n >= len(w) or w[s + n] != b[j + n]), len(b) - j)
                    if n >= min(13, len(b)):
                        best = min(best, (n, i, s), key=lambda m: (-m[0], m[1], m[2]))
        want.append((str(d), len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w), *best))
    assert out == sorted(want)
    assert decontaminate.remove(odd, bench).columns == odd.columns
    assert decontaminate.mark(odd, bench.limit(0)).filter("size(d_items) > 0").count() == 0
    assert decontaminate.mark(odd.limit(0), bench).count() == 0


def test_longest_match():
    b = decontaminate.Benchmark([(7, "a b c d e f")], 3)
    ids = np.array([b.vocabulary.get(w, 0) for w in b"x b c d e y a b c".split()])
    _, items, best = b.search([ids])
    assert items == [{"7"}] and best == [(4, "7", 1)]
    _, items, best = b.search([ids, ids[5:], ids[:0], ids])  # every copy has its match
    assert best == [(4, "7", 1), (3, "7", 1), (0, None, None), (4, "7", 1)]


def brute_simhash(texts):
    from xxhash import xxh64_intdigest

    out = []
    for t in texts:
        w = WORD.findall(lower(t))
        h = [xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def brute_groups(fps, ids):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(fps))]


def test_simhash(spark, odd):
    rows = key(odd)
    fps = brute_simhash([t for _, t in rows])
    want = sorted((str(d), f, str(g)) for (d, _), f, g in zip(rows, fps, brute_groups(fps, [d for d, _ in rows])))
    marked = simhash.fingerprints(odd)
    got = sorted((str(r["doc_id"]), r["fp"] % 2**64, str(r["component_id"])) for r in simhash.groups(marked).collect())
    assert got == want
    one = simhash.dedup(odd)
    assert one.columns == odd.columns and sorted(str(r["doc_id"]) for r in one.collect()) == sorted({g for _, _, g in want})


@pytest.mark.parametrize("hot", [4096, 40])
def test_simhash_links_random_clusters(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_MEMBERS", hot)
    rng = np.random.default_rng(1)
    fps = []
    for _ in range(12):
        center = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(20):
            x = center
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(df).collect()}
    assert [got[i] for i in range(len(fps))] == brute_groups(fps, list(range(len(fps))))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_sharding(spark, odd):
    out = sharding.assign(sharding.light(odd), "source", ["doc_id", "text_hash", "size"], shards=5).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in key(odd))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    counts = Counter(r["shard"] for r in out)
    assert set(counts) <= set(range(5)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    whole = sharding.sharded(odd, shards=5)
    assert whole.columns == [*odd.columns, "shard", "slot"]
    assert Counter(key(whole)) == Counter(key(odd))
    assert sharding.assign(sharding.light(odd.limit(0)), "source", ["doc_id", "text_hash", "size"]).count() == 0
    assert sharding.sharded(odd.limit(0)).count() == 0


def plain_interleaving(rows, seed, order):
    """Ranks of rows (source, ...) by the fraction of their shuffled place in their source."""
    out = []
    for source in {r["source"] for r in rows}:
        own = sorted((r for r in rows if r["source"] == source), key=order)
        out += [((2 * k + 1) / (2 * len(own)), source, k, r) for k, r in enumerate(own)]
    return out


def test_interleaving_order_against_a_plain_sort(spark):
    rows = spark.range(500).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source", "xxhash64(17, id) AS seeded", "xxhash64(17, CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END) AS tie")
    placed = plain_interleaving(rows.collect(), 17, lambda r: (r["seeded"], r["doc_id"]))
    want = [r["doc_id"] for _, _, _, r in sorted(placed, key=lambda x: (x[0], x[3]["tie"], x[3]["seeded"]))]
    got = sharding.assign(rows.select("doc_id", "source"), "source", ["doc_id"], shards=7).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))] == want


def test_interleaving_is_proportional(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    out = sharding.assign(rows, "source", ["doc_id"], shards=10).groupBy("shard", "source").count().collect()
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r["count"])
    assert all(max(c) - min(c) <= 2 for c in by.values())  # a cut may fall on either side of a row of each other source


def test_mixing_targets():
    sizes = {"a": 100, "b": 10, "c": 500, "d": 0, None: 40}
    t = mixing.targets(sizes)
    assert t["b"] == 30 and t["d"] == 0 and sum(t.values()) == pytest.approx(650)
    assert all(t[s] <= 3 * n for s, n in sizes.items())
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0}


@pytest.mark.parametrize("block, ranges", [(7, 256), (64, 256), (7, 3)])
def test_mixing(spark, odd, monkeypatch, block, ranges):
    monkeypatch.setattr(mixing, "RANGES", ranges)
    rows = odd.selectExpr("doc_id", "source", f"size(array_remove(split(coalesce(text, ''), '[ \\t-\\r]+'), '')) + 0L AS size", "xxhash64(text) AS _hash")
    out = mixing.taken(rows, block=block, per_shard=16, order=["doc_id", "_hash"]).collect()
    assert len(out) == odd.count()
    sizes = {}
    for d, t, s in ((r["doc_id"], r["text"], r["source"]) for r in odd.collect()):
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    for s in sizes:
        own = [r for r in out if r["source"] == s]
        assert {(r["source_size"], r["target"]) for r in own} == {(sizes[s], mixing.targets(sizes)[s])}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    again = mixing.taken(rows.repartition(5), block=block, per_shard=16, order=["doc_id", "_hash"]).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in again) == Counter((r["doc_id"], r["size"], r["taken"]) for r in out)
    mixed = mixing.mixed(odd, block=block)
    assert mixed.columns == odd.columns
    words = sum(len(WORD.findall(t or "")) for _, t in key(mixed))
    assert words == sum(r["taken"] for r in mixing.taken(rows, block=block, order=["doc_id", "_hash"]).collect())
    assert mixing.mixed(odd.limit(0)).count() == 0


@pytest.mark.parametrize("ranges", [256, 2])
def test_slots_take_every_block_as_often_as_planned(spark, monkeypatch, ranges):
    monkeypatch.setattr(mixing, "RANGES", ranges)
    sizes = {"a": 1000, "b": 95, "c": 0, None: 333}
    sources = mixing.plan(sizes, block=10, seed=29)
    rows = mixing.slots(spark, sources, block=10, per_shard=16, seed=29).collect()
    shards = Counter(r["shard"] for r in rows)
    assert sorted(shards) == list(range(len(shards))) and all(n == 16 for s, n in shards.items() if s < len(shards) - 1)
    for s in sources:
        own = Counter((r["block"], r["epoch"]) for r in rows if r["k"] == s["k"])
        assert len(own) == s["slots"] and set(own.values()) <= {1}  # each block at most once in an epoch
        last = [min(10, s["size"] - 10 * r["block"]) if r["words"] == 10 else r["words"] for r in rows if r["k"] == s["k"]]
        assert sum(last) == round(s["target"])
        if s["slots"]:
            full = s["slots"] // s["blocks"]
            assert all((b, e) in own for b in range(s["blocks"]) for e in range(full))
    # Shards follow the mixture: each holds every source near its share of all slots.
    total = Counter(r["k"] for r in rows)
    mean = {k: [sum(r["k"] == k for r in rows if r["shard"] == s) for s in shards] for k in total}
    assert all(abs(np.mean(v) / 16 - total[k] / len(rows)) < 0.05 for k, v in mean.items())


def test_mixed_texts_against_a_plain_cut(spark):
    """Whole texts come back word for word, and the words of a document are taken as often as ``taken`` says."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(int(rng.integers(1, 40)))), f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(docs, block=16, per_shard=8).collect()
    used = Counter(w for r in out for w in r["text"].split())
    light = docs.selectExpr("doc_id", "source", "size(split(text, ' ')) + 0L AS size", "xxhash64(text) AS _hash")
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(light, block=16, per_shard=8, order=["doc_id", "_hash"]).collect()}
    for i, text, _ in rows:
        assert sum(used[w] for w in text.split()) == taken[i] and max((used[w] for w in text.split()), default=0) <= 3
    by_source = Counter()
    for r in out:
        assert r["doc_id"] == int(r["text"].split()[0][1:].split("w")[0])
        by_source[r["source"]] += len(r["text"].split())
    sizes = Counter()
    for _, text, s in rows:
        sizes[s] += len(text.split())
    assert all(abs(by_source[s] - t) <= 1 for s, t in mixing.targets(dict(sizes)).items())


def test_permutation():
    for n in (1, 2, 3, 17, 64, 1000):
        p = mixing.permute(np.arange(n), n, 12345)
        assert sorted(p) == list(range(n)) and (mixing.permute(p, n, 12345, back=True) == np.arange(n)).all()
