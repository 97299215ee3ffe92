"""Language-model scoring by a log-bilinear neural model (operator 5).

Counts. All training words are counted by the tasks and summed; the counts are a table in the shared
folder, which grows with the corpus. The COMMON most frequent words (a fixed number) go to every task;
the counts of all other words reach the documents by a join on the word.

Leaves. The OWN most frequent words with LEAST training tokens or more, and the text end, have vectors
of their own. Every other word shares those of its ending (the last ENDING bytes): the ENDINGS - 1
endings with most tokens are leaves, and one leaf is for all others. So each word has a vector, as a
target and as a context, also one never seen. Leaves are numbered by their spelling from the back,
which makes groups of alike endings for the two-step network in ``neural``.

Training. The codes of all training documents are dealt into shards of SHARD_TOKENS tokens by a hash of
the document, so neither the model nor its seeds depend on how files are split. One shard is trained
first; each further round trains GROWTH times as many shards, all from the average of the last round
(by tokens, in a tree of TREE models a step), until every training token has been used PASSES times.

Scores. A leaf's log probability comes from the network, normalised over all leaves. A word that shares
its leaf has the part (c - d) / n of it, n being the leaf's training tokens and d the discount
n1 / (n1 + 2 n2) of the numbers of words seen once and twice; what is left, d v / n for v words, is
that of any unseen word there. So probabilities add to 1 over all words seen and one unseen word for
each ending's leaf.

Training documents are those whose crc32(doc_id as text) mod 10 is not 0. Defined results: null text
is empty and has one token, the end; a null doc_id reads as empty text and so is held out; repeated
rows are each scored (and counted); a very long text is read in pieces of 65,536 tokens, each of which
starts without context; without training documents every token has c = 0; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neural
from .common import LOWER, partitions, stored, text_chunks, tune

COMMON = 200_000
OWN, LEAST = 3_071, 25
ENDING, ENDINGS = 3, 1_024
SHARD_TOKENS = 2_000_000
GROWTH, PASSES = 3, 1
TREE = 8
#: Bytes of texts whose words are counted together.
FLUSH = 20 << 20
END = b""  # no word is empty


def _is_held_out(doc_id: str | None) -> bool:
    return zlib.crc32((doc_id or "").encode()) % 10 == 0


def _words(texts: list[bytes]) -> pa.LargeListArray:
    """Lower-cased words of each text and the end; Arrow's ASCII white space is that of the contract."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string())))
    # What follows a last space is an empty word, the end; a blank text is just that.
    none, gap = pa.scalar("", bare.type), pa.scalar(" ", bare.type)
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(bare, none), bare, pc.binary_join_element_wise(bare, none, gap)))


def _held_out(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([_is_held_out(x) for x in batch.column("name").to_pylist()], bool)


def _bytes(words: pa.Array) -> list[bytes]:
    return words.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all training tokens."""

    def count(batches):
        texts, size = [], 0

        def out():
            found = pa.chunked_array(texts, pa.large_string()).value_counts()
            texts.clear()
            word = found.field("values").view(pa.large_binary())
            for at in range(0, len(word), 50_000):
                yield pa.RecordBatch.from_arrays([word.slice(at, 50_000).cast(pa.binary()), found.field("counts").slice(at, 50_000)], names=["word", "c"])

        for b in batches:
            held = _held_out(b)
            for first, chunk in text_chunks(b):
                own = [t for t, h in zip(chunk, held[first : first + len(chunk)].tolist(), strict=True) if not h]
                texts.append(_words(own).flatten())
                size += sum(map(len, own))
                if size >= FLUSH:
                    yield from out()
                    size = 0
        yield from out()

    return docs.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _least_common(counts: DataFrame) -> int:
    """The least count for which at most COMMON words have as many, up to steps of a quarter of a percent;
    a histogram over the logarithm of the counts is all that is gathered."""
    step = F.floor(F.log("c") * 400)
    left, least = COMMON, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["step"]):
        left -= r["n"]
        if left < 0:
            break
        least = r["c"]
    return least if least is not None else 2**62


class Lexicon:
    """Common words with counts and leaves, and what words that share a leaf have of it.

    ``endings`` holds (ending, tokens, words) of words without a leaf of their own, its first row (None)
    those of all other endings; ``once`` and ``twice`` are numbers of words.
    """

    def __init__(self, common: list[tuple[bytes, int]], own: set[bytes], endings: list[tuple], once: int, twice: int, total: int):
        # Nothing is spelled like None, which comes first.
        leaves = sorted([(0, b"", 0, None), *((1, e[::-1], 0, e) for e, _, _ in endings if e is not None), *((1, w[::-1], 1, w) for w in own | {END})])
        self.ending = {e: i for i, (_, _, is_word, e) in enumerate(leaves) if not is_word}
        number = {w: i for i, (_, _, is_word, w) in enumerate(leaves) if is_word}
        self.end = number[END]
        self.discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        tokens, words = np.zeros(len(leaves)), np.zeros(len(leaves))
        for e, n, v in endings:
            tokens[self.ending[e]], words[self.ending[e]] = n, v
        #: Log10 of the tokens of a shared leaf, and of an unseen word's part of it.
        self.log_tokens = np.log10(np.maximum(tokens, 1))
        self.unseen = np.where(tokens > 0, np.log10(np.maximum(self.discount * words, 1e-300)) - self.log_tokens, 0.0)
        self.index = {w: i + 1 for i, (w, _) in enumerate(common)}  # 0: not common
        self.counts = np.array([0, *(c for _, c in common)], np.int64)
        self.leaf = np.array([0, *(number[w] if w in number else self.shared(w) for w, _ in common)], np.int64)
        self.is_own = np.array([False, *(w in number for w, _ in common)])
        for (w, c), leaf in zip(common, self.leaf[1:].tolist(), strict=True):
            if w in number:
                tokens[leaf] = c
        share = np.maximum(tokens, 1)
        self.share, self.total = share / share.sum(), total
        if len(share) > 1 << 16:
            raise ValueError("leaves are stored in two bytes")

    def drop_words(self) -> None:
        """Frees what only ``codes`` needs."""
        self.index, self.leaf, self.counts, self.is_own = {}, None, None, None

    def shared(self, word: bytes) -> int:
        return self.ending.get(word[-ENDING:], 0)

    def codes(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of common words (0: none) and leaves."""
        codes = np.fromiter(map(self.index.get, tokens, repeat(0)), np.int64, len(tokens))
        leaves, get = self.leaf[codes], self.ending.get
        at = np.flatnonzero(codes == 0)
        leaves[at] = [get(t[-ENDING:], 0) if t else self.end for t in map(tokens.__getitem__, at.tolist())]
        return codes, leaves


def lexicon_of(counts: DataFrame) -> tuple[Lexicon, int]:
    """The lexicon of a table of counts, and its number of words; COMMON + OWN + ENDINGS rows reach the driver."""
    spark = counts.sparkSession
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    end = F.col("word") == F.lit(END)
    # As Arrow columns, which take a fraction of the driver's memory that rows do.
    found = counts.filter((F.col("c") >= _least_common(counts)) | end).toArrow()
    common = sorted(zip(found.column("word").to_pylist(), found.column("c").to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
    del found
    own = {w for w, c in common[:OWN] if c >= LEAST} | {END}
    table = spark.createDataFrame([(w,) for w in sorted(own)], "word binary")
    shared = counts.join(F.broadcast(table), "word", "left_anti")  # OWN + 1 rows
    each = shared.groupBy(F.expr(f"substring(word, -{ENDING}, {ENDING})").alias("ending")).agg(
        F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")
    )
    each = stored(each, "endings")
    rest = each.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "once", "twice"))).first()
    top = [(bytes(r["ending"]), r["n"], r["v"]) for r in each.orderBy(F.desc("n"), "ending").limit(ENDINGS - 1).collect()]
    others = (None, rest["n"] - sum(n for _, n, _ in top), rest["v"] - sum(v for _, _, v in top))
    return Lexicon(common, own, [others, *top], rest["once"], rest["twice"], sums["n"] or 0), sums["v"]


def encoded(docs: DataFrame, lexicon: Lexicon, distinct: int) -> DataFrame:
    """What scoring needs of each text, without its words: two-byte ``leaves``, sums over the common words
    (``base``, ``inside``: parts of shared leaves), and the other words with their number in ``tail``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # COMMON words and ENDINGS endings
    all_words = float(np.log10(lexicon.total + 0.1 * (distinct + 1)))
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("leaf", pa.int32()), ("n", pa.int64())]))
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "inside", "tail", "leaves"]

    def encode(batches):
        from pyspark import TaskContext

        neural.keep_freed_memory()
        words, row = shared.value, TaskContext.get().partitionId() << 40
        log_base = np.log10(words.counts + 0.1)
        log_base[0] = 0
        # Words with a leaf of their own, and code 0, add nothing here.
        log_inside = np.where(words.is_own | (words.counts == 0), 0.0, np.log10(np.maximum(words.counts - words.discount, 1e-9)) - words.log_tokens[words.leaf])
        log_inside[0] = 0
        is_known = words.counts > 0
        for b in batches:
            ids, is_held = b.column("doc_id"), _held_out(b)
            for first, chunk in text_chunks(b):
                n, split = len(chunk), _words(chunk)
                ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
                starts, lens = np.append(0, ends[:-1]), np.diff(ends, prepend=0)
                # Each word of the chunk is looked up once; numbers of its words stand for the tokens.
                coded = split.flatten().dictionary_encode()
                number = coded.indices.to_numpy()
                codes, leaf = words.codes(_bytes(coded.dictionary))
                by_doc = lambda x: np.add.reduceat(x[number], starts)  # noqa: E731, B023
                base, inside, known = by_doc(log_base[codes]) - lens * all_words, by_doc(log_inside[codes]), by_doc(is_known[codes].astype(np.int64))
                at = np.flatnonzero((codes == 0)[number])
                pairs, times = np.unique(np.repeat(np.arange(n), lens)[at] * len(codes) + number[at], return_counts=True)
                doc, word = np.divmod(pairs, len(codes))
                found = coded.dictionary.take(pa.array(word)).view(pa.large_binary()).cast(pa.binary())
                each = pa.StructArray.from_arrays([found, pa.array(leaf[word], pa.int32()), pa.array(times, pa.int64())], fields=list(tail_type.value_type))
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), each)
                # The two-byte leaves of all texts, one after another, are the values of a column of bytes.
                packed = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(2 * np.append(0, ends)), pa.py_buffer(leaf.astype("<u2")[number])]).cast(pa.binary())
                columns = [np.arange(row, row + n), ids.slice(first, n), is_held[first : first + n], lens, known, base, inside]
                yield pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c) for c in columns), tail, packed], names=names)
                row += n

    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, inside double, tail array<struct<word: binary, leaf: int, n: bigint>>, leaves binary"
    return docs.mapInArrow(encode, schema)


def rounds_of(shards: int) -> list[tuple[int, int]]:
    """Ranges of shards: one, then GROWTH times as many each time, PASSES times over all."""
    out, first, n = [], 0, 1
    while first < shards:
        out.append((first, min(shards, first + n)))
        first, n = first + n, n * GROWTH
    return out + [(0, shards)] * (PASSES - 1)


def fit(codes: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Train on all of ``codes`` (held_out, doc_id, leaves), as the module says; the network's numbers."""
    spark = codes.sparkSession
    shards = max(1, -(-lexicon.total // SHARD_TOKENS))
    light = codes.filter("NOT held_out").select("leaves", F.xxhash64("doc_id", "leaves").alias("deal"))
    light = light.withColumn("shard", F.pmod("deal", F.lit(shards)).cast("int"))
    flat = neural.Network(lexicon.share, lexicon.end).flat
    share, end = lexicon.share, lexicon.end

    for turn, (low, high) in enumerate(rounds_of(shards)):
        start = spark.sparkContext.broadcast(flat)  # some thousand leaves times DIM

        def train(batches, start=start, turn=turn):
            neural.keep_freed_memory()
            shard, net, rng, n, held = None, None, None, 0, []

            def spend():
                nonlocal n
                for leaf, pos in neural.batches(held):
                    net.train(leaf, pos, rng)
                    n += len(leaf)
                held.clear()

            def row():
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([net.flat.tobytes()], pa.binary())], names=["at", "n", "flat"])

            size = 0
            for b in batches:
                for s, leaves in zip(b.column("shard").to_pylist(), b.column("leaves"), strict=True):
                    if s != shard:
                        if net is not None:
                            spend()
                            yield row()
                        shard, net, rng, n, size = s, neural.Network(share, end, start.value.copy()), np.random.default_rng([turn, s]), 0, 0
                    held.append(np.frombuffer(leaves.as_buffer(), "<u2").astype(np.int64))
                    size += len(held[-1])
                    if size >= neural.BATCH:
                        spend()
                        size = 0
            if net is not None:
                spend()
                yield row()

        own = light.filter(F.col("shard").between(low, high - 1))
        dealt = own.repartitionById(high - low, F.col("shard") - low).sortWithinPartitions("shard", "deal")
        models = stored(dealt.select("shard", "leaves").mapInArrow(train, "at long, n long, flat binary"), "models")
        flat = _average(models, flat)
    return flat


def _average(models: DataFrame, start: np.ndarray) -> np.ndarray:
    """The mean by tokens of the models (at, n, flat), at most TREE of which are in one place."""
    size = len(start)

    def average(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for at, n, flat in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = sums.setdefault(at, [0, np.zeros(size)])
                own[0], own[1] = own[0] + n, own[1] + n * np.frombuffer(flat, np.float32)
        for at, (n, total) in sorted(sums.items()):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([(total / max(n, 1)).astype(np.float32).tobytes()], pa.binary())], names=["at", "n", "flat"])

    while models.count() > TREE:
        near = models.withColumn("at", F.expr(f"at div {TREE}")).repartition(partitions(models.sparkSession), "at").sortWithinPartitions("at", "n")
        models = stored(near.mapInArrow(average, models.schema), "models")
    last = [r for r in models.orderBy("at").collect() if r["n"]]
    if not last:
        return start
    total = sum(r["n"] for r in last)
    return sum(np.frombuffer(r["flat"], np.float32) * (r["n"] / total) for r in last).astype(np.float32)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", F.col("doc_id").cast("string").alias("name"), "text")
    counts = stored(word_counts(docs), "counts")
    lexicon, distinct = lexicon_of(counts)
    codes = stored(encoded(docs, lexicon, distinct), "codes")
    lexicon.drop_words()
    flat = fit(codes, lexicon)
    shared = spark.sparkContext.broadcast((lexicon.share, lexicon.end, flat))

    def from_network(batches):
        neural.keep_freed_memory()
        net = neural.Network(*shared.value)
        for b in batches:
            held = [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in b.column("leaves")]
            sums, doc, at = np.zeros(len(held)), np.repeat(np.arange(len(held)), [len(x) for x in held]), 0
            for leaf, pos in neural.batches(held):
                sums += np.bincount(doc[at : at + len(leaf)], weights=net.log_probs(leaf, pos), minlength=len(held))
                at += len(leaf)
            columns = [c for c, name in zip(b.columns, b.schema.names, strict=True) if name != "leaves"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums / np.log(10))], names=[*(n for n in b.schema.names if n != "leaves"), "full"])

    light = codes.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "inside", "leaves")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in light.schema if f.name != "leaves")
    scored = light.mapInArrow(from_network, f"{kinds}, full double")
    of_leaf = [(leaf, float(lexicon.log_tokens[leaf]), float(lexicon.unseen[leaf])) for leaf in sorted(lexicon.ending.values())]
    leaves = spark.createDataFrame(of_leaf, "leaf int, log_tokens double, unseen double")
    tail = codes.select("row", F.inline("tail")).join(counts, "word", "left").join(F.broadcast(leaves), "leaf", "left")  # ENDINGS rows
    inside = F.when(F.col("c").isNull(), F.coalesce("unseen", F.lit(0.0))).otherwise(F.log10(F.col("c") - lexicon.discount) - F.col("log_tokens"))
    rest = tail.groupBy(F.col("row").alias("at")).agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more_base"), F.sum(F.col("n") * inside).alias("more_inside"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("more_known")
    )
    zero = F.lit(0.0)
    return scored.join(rest, F.col("row") == F.col("at"), "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("full") + F.col("inside") + F.coalesce("more_inside", zero)).alias("score"),
    )


def op5_lm_scores(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
