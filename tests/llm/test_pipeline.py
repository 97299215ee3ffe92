import re
from collections import Counter

import numpy as np
import pytest
from test_minhash import brute_first

import corpus_pipeline
from paperloom.llm import mixing, quality
from paperloom.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_clean(text):
    """The kept text of a document, or None: the rules of the quality stage, line by line."""
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    if len(words) < 50 or 2 * len(again) > len(words):
        return None
    kept = []
    lines = [x for x in text.split("\n") if WORD.search(x)]
    for x in lines:
        own, low = WORD.findall(x), x.lower()
        phrases = sum(len(p) * low.count(p) for p in quality.BOILERPLATE)
        bad = not re.search(r"""[.!?:;…。！？]["'”’)\]]*[\x20\x09-\x0D]*$""", x)
        bad |= 4 * len(re.findall(r"[#*$%&|<>]", x)) > len(own) or len(re.findall(r"[!?]{2,}", x)) >= 3
        bad |= len(re.findall(r"\x20[|»>·•]", x)) >= 3 or (phrases > 0 and 100 * phrases >= quality.FURNITURE_SHARE * len(x))
        kept += [] if bad else [x]
    chars = lambda ls: sum(len(w) for x in ls for w in WORD.findall(x))
    return "\n".join(kept) if 2 * chars(kept) >= chars(lines) else None


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = np.random.default_rng(11), tmp_path_factory.mktemp("corpus")
    line = lambda n=12: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) + "."
    item = line(30)
    odd = ["Home | About | News > More | All.", "All rights reserved. Privacy policy.", "no end here", "$$ ## %% a.", "What?? Why!! Who?! Yes??"]
    texts = []
    for i in range(60):
        body = [line() for _ in range(6)]
        if i % 3 == 0:
            body.insert(int(rng.integers(0, 6)), odd[i % 5])
        if i % 7 == 0:
            body += [odd[2]] * 8
        if i % 9 == 0:
            body.insert(2, item)
        texts.append("\n".join(body))
    texts += [texts[1], texts[2].replace("w", "v", 3), texts[4] + " tail.", "short text.", "", None, "a b c " * 40, f"It says all rights reserved in a long line of prose {line(60)}"]
    rows = [(i, t, "en", f"s{i % 4}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, item


def test_stages_against_plain_versions(spark, corpus):
    folder, rows, item = corpus
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), name)
        out[name] = docs.collect()
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {i: plain_clean(t) for i, t, *_ in rows}
    clean = {i: t for i, t in clean.items() if t is not None}
    assert {r["doc_id"]: r["text"] for r in out["quality_rules"]} == clean
    assert all(r["n_chars"] == len(r["text"]) for r in out["quality_rules"])
    first = brute_first(sorted(clean.items()))
    assert sorted(r["doc_id"] for r in out["near_dedup"]) == first and len(first) < len(clean)
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = {tuple(plain(item)[i : i + 13]) for i in range(18)}

    def bad(text):
        w = plain(text)
        hit = {i + k for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for k in range(13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    left = [i for i in first if not bad(clean[i])]
    assert sorted(r["doc_id"] for r in out["decontamination"]) == left and len(left) < len(first)
    sizes, source = Counter(), {i: s for i, _, _, s, _ in rows}
    for i in left:
        sizes[source[i]] += len(WORD.findall(clean[i]))
    taken = Counter()
    for r in out["mix"]:
        words = WORD.findall(r["text"])
        whole = WORD.findall(clean[r["doc_id"]])
        assert r["source"] == source[r["doc_id"]] and not Counter(words) - Counter(whole)
        taken[r["source"]] += len(words)
    assert all(abs(taken[s] - t) <= 1 for s, t in mixing.targets(dict(sizes)).items())
    light = lambda rs: Counter((r["doc_id"], r["text"], r["source"]) for r in rs)
    assert light(out["shard"]) == light(out["mix"])
    counts = Counter(r["shard"] for r in out["shard"])
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in out["shard"] if r["shard"] == s) == list(range(n)) for s, n in counts.items())


def test_run_gives_the_same_rows_again(spark, corpus):
    folder, _, _ = corpus
    one, two = (Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert one == two and one


def test_run_on_an_empty_table(spark, corpus, tmp_path):
    folder, _, _ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
