"""LM scoring (operator 10): prediction by partial matching over bytes, pretrained on the corpus itself.

Model: the trie of byte contexts up to ORDER bytes, over all documents that are learned from. A byte (or the end of
a text) that its longest known context has seen gets count / (n + q), where n counts what followed the context and q
how many different symbols did; else the model escapes with q / (n + q) to the next shorter context, in which all
symbols that the longer one has seen are excluded, down to a uniform choice of the symbols never seen. A document's
score is the sum of log10 probabilities of its bytes and its end.

Documents are dealt into chunks of about CHUNK_BYTES. A chunk gives its distinct words and context-symbol pairs with
counts (never one row for each token); Spark adds the counts up over all chunks, computes every pair's probability in
shards of the trie (contexts that end in the same two symbols lie together), and hands each chunk just the entries it
asked for: chunks are dealt evenly by number, and a task holds the entries of one chunk at a time. Only orders 0 and 1,
at most 258 x 258 numbers, are broadcast. Words are known by 64-bit hashes.

ORDER is the longest whose tables stay small beside the texts: of 16 MB of text, 1.3 % of the grams are distinct at order
4, 4 % at order 5 and 11 % at order 6, and each distinct one of a chunk travels three times.

Nulls and odd rows: a null text is an empty one (only its end is scored); a null doc_id is neither held out nor
learned from; repeated rows count and score each by itself; with nothing to learn from, every symbol has probability
1/257 and every token 1/1 (N = V = 0). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, words

ORDER = 4
BITS = 9
#: Symbols: 0 before a text, 1 to 256 its bytes, 257 its end.
END = 257
ALPHABET = 257
CHUNK_BYTES = 16 << 20
#: Chunks are scored by a task each, or in turn by so many tasks.
MOST_TASKS = 10_000
LOWEST = (1 << 2 * BITS) - 1


def mask(symbols: int) -> int:
    return (1 << BITS * symbols) - 1


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): for each byte of each document and its end, ORDER symbols of context and the symbol itself; and where each document's codes begin."""
    docs, size = len(off) - 1, np.diff(off)
    seq = np.zeros(len(data) + docs * (ORDER + 1), np.int64)
    begin = off[:-1] + np.arange(docs) * (ORDER + 1) + ORDER
    real = np.ones(len(seq), bool)
    for k in range(1, ORDER + 1):
        real[begin - k] = False
    ends = begin + size
    body = real.copy()
    body[ends] = False
    seq[body] = data.astype(np.int64) + 1
    seq[ends] = END
    code = seq.copy()
    for k in range(1, ORDER + 1):
        code[k:] |= seq[:-k] << (BITS * k)
    first = np.concatenate([off[:-1] + np.arange(docs), [len(data) + docs]])
    return code[real], first


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sums of their counts."""
    keys, codes = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(codes, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)


def counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, uniques = pd.factorize(keys)
    return uniques, np.bincount(codes, weights=learn, minlength=len(uniques))


def packed(rows: list[pa.RecordBatch]) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for r in rows:
            w.write_batch(r)
    return out.getvalue().to_pybytes()


def lower_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words after A-Z became a-z, and the index of each document's first word."""
    low = words.LOWER[data]
    starts, ends, first = words.spans(low, off)
    return words.hashes(low, starts, ends).view(np.int64), first


CHUNK = "chunk long, docs binary, words array<long>, word_counts array<long>, grams array<long>, gram_counts array<long>, tokens long, learned long"


def chunks(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    schema = common.fields(CHUNK)

    def run(batches: Iterator[pa.RecordBatch]):
        task = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        word_parts, gram_parts, size, n, tokens, learned = [], [], 0, 0, 0, 0

        def out():
            w, g = added(word_parts), added(gram_parts)
            return common.batch(schema, chunk=[(task << 24) + n], docs=[packed(held)], words=[w[0]], word_counts=[w[1]], grams=[g[0]], gram_counts=[g[1]], tokens=[tokens], learned=[learned])

        for b in common.slices(batches, "text"):
            data, off = common.arrow_bytes(b.column("text"))
            learn = b.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)
            if held and size + len(data) > chunk_bytes:
                yield out()
                held, word_parts, gram_parts, size, n, tokens, learned = [], [], [], 0, n + 1, 0, 0
            h, first = lower_words(data, off)
            code, begin = grams(data, off)
            word_parts.append(counted(h, np.repeat(learn, np.diff(first))))
            gram_parts.append(counted(code, np.repeat(learn, np.diff(begin))))
            held.append(b)
            size += len(data)
            tokens += int((learn * np.diff(first)).sum())
            learned += int(learn.sum())
            if len(word_parts) >= 8:
                word_parts, gram_parts = [added(word_parts)], [added(gram_parts)]
        if held:
            yield out()

    return rows.mapInArrow(run, CHUNK)


def log_probabilities(code: np.ndarray, count: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each gram under the trie.

    code, count: all grams whose contexts end in the same two symbols as any of these (count 0: asked for, never
    learned). pairs: counts of all (symbol, next symbol), by their code of two symbols.
    """
    c, n, q = {}, {}, {}
    ex_d, ex_q = {}, {}
    entry, entry_count = {}, {}
    singles = pairs.reshape(-1, 1 << BITS).sum(axis=0)
    for k in range(ORDER, 1, -1):
        entry[k], inverse = np.unique(code & mask(k + 1), return_inverse=True)
        entry_count[k] = np.bincount(inverse, weights=count, minlength=len(entry[k]))
        c[k] = entry_count[k][inverse]
    low = code & LOWEST
    c[1], c[0] = pairs[low], singles[code & mask(1)]
    pair_n = pairs.reshape(-1, 1 << BITS).sum(axis=1)
    pair_q = (pairs.reshape(-1, 1 << BITS) > 0).sum(axis=1)
    n[1], q[1] = pair_n[low >> BITS], pair_q[low >> BITS]
    n[0], q[0] = np.full(len(code), singles.sum()), np.full(len(code), (singles > 0).sum())

    def below(k: int, keys: np.ndarray) -> np.ndarray:
        """Counts at order k of entries of order k + 1."""
        if k == 1:
            return pairs[keys & LOWEST]
        if k == 0:
            return singles[keys & mask(1)]
        return entry_count[k][np.searchsorted(entry[k], keys & mask(k + 1))]

    for k in range(ORDER, 0, -1):
        if k > 1:
            seen = entry_count[k] > 0
            keys = entry[k]
            context, inverse = np.unique(keys >> BITS, return_inverse=True)
            at = np.searchsorted(context, (code & mask(k + 1)) >> BITS)
            n[k] = np.bincount(inverse, weights=entry_count[k], minlength=len(context))[at]
            q[k] = np.bincount(inverse, weights=seen, minlength=len(context))[at]
            excluded = np.bincount(inverse, weights=np.where(seen, below(k - 1, keys), 0), minlength=len(context))[at]
        else:
            two = pairs.reshape(-1, 1 << BITS) > 0
            excluded = (two * singles[None, :]).sum(axis=1)[low >> BITS]
        ex_d[k] = excluded  # of the next shorter context's count
    for k in range(ORDER, 0, -1):
        ex_q[k] = q[k - 1] - q[k]
        ex_d[k] = n[k - 1] - ex_d[k] + ex_q[k]

    out = np.zeros(len(code))
    started, done = np.zeros(len(code), bool), np.zeros(len(code), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(ORDER, -1, -1):
            known = n[k] > 0
            top = ~started & known
            hit = c[k] > 0
            total = np.where(top, n[k] + q[k], ex_d.get(k + 1, np.ones(len(code))))
            novel = np.where(top, q[k], ex_q.get(k + 1, np.ones(len(code))))
            live = (top | started) & ~done
            out += np.where(live & hit, np.log10(c[k] / total), 0)
            out += np.where(live & ~hit & (total > 0), np.log10(novel / total), 0)
            done |= live & hit
            started |= known
        left = ALPHABET - np.where(started, (singles > 0).sum(), 0)
        out += np.where(done, 0, -np.log10(np.maximum(left, 1)))
    return out


def trie(totals: DataFrame, pairs: np.ndarray, at_once: int = 2_000_000) -> DataFrame:
    """(key, value): log10 probability of each gram of totals (key, n)."""
    spark = totals.sparkSession
    shared = spark.sparkContext.broadcast(pairs)
    dealt = totals.withColumn("shard", F.shiftright("key", BITS).bitwiseAND(LOWEST)).repartition(common.buckets(spark), "shard").sortWithinPartitions("shard")
    schema = common.fields("key long, value double")

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for b in batches:
            held.append(tuple(b.column(k).to_numpy() for k in ("key", "n", "shard")))
            rows += b.num_rows
            if rows >= at_once:
                key, n, shard = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
                if cut:
                    yield common.batch(schema, key=key[:cut], value=log_probabilities(key[:cut], n[:cut].astype(np.float64), shared.value))
                held, rows = [(key[cut:], n[cut:], shard[cut:])], len(key) - cut
        if rows:
            key, n, _ = (np.concatenate(x) for x in zip(*held, strict=True))
            yield common.batch(schema, key=key, value=log_probabilities(key, n.astype(np.float64), shared.value))

    return dealt.mapInArrow(run, "key long, value double")


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scoring(docs: DataFrame, learn, held_out, chunk_bytes: int = CHUNK_BYTES, most_tasks: int = MOST_TASKS) -> DataFrame:
    """RESULT for every row of docs; learn and held_out are boolean columns over doc_id and text."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = common.picked(docs, doc_id="long", text="string").select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    kept = common.written(chunks(rows, chunk_bytes), "lm-chunks")
    total = kept.agg(F.sum("tokens").alias("t"), F.sum("learned").alias("d"), F.count("chunk").alias("chunks"), F.max(F.shiftright("chunk", 24)).alias("task")).first()
    learned = int(total["d"] or 0)

    def entries(keys: str, counts: str) -> DataFrame:
        return kept.select("chunk", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(counts).alias("n"))).alias("e")).select("chunk", F.col("e.key").alias("key"), F.col("e.n").alias("n"))

    # words: a key has a row for each chunk at most
    w = Window.partitionBy("key")
    known = common.written(entries("words", "word_counts").select("chunk", "key", F.sum("n").over(w).alias("n"), (F.min("chunk").over(w) == F.col("chunk")).alias("first")).where("n > 0"), "lm-words")
    distinct = known.where("first").count()
    # grams: totals once, then probabilities in shards of the trie
    totals = common.written(entries("grams", "gram_counts").groupBy("key").agg(F.sum("n").alias("n")), "lm-grams")
    pairs = np.zeros(1 << 2 * BITS)
    low = totals.groupBy(F.col("key").bitwiseAND(LOWEST).alias("pair")).agg(F.sum("n").alias("n")).toPandas()
    pairs[low["pair"].to_numpy(np.int64)] = low["n"].to_numpy(np.float64)
    probability = trie(totals, pairs)
    asked = entries("grams", "gram_counts").select("chunk", "key").join(probability, "key")
    # what a chunk asked for comes before its documents; turn is the one number to sort by
    book = known.select((F.col("chunk") * 4).alias("turn"), "key", F.col("n").cast("double").alias("value")).unionByName(asked.select((F.col("chunk") * 4 + 1).alias("turn"), "key", "value"))
    both = book.withColumn("docs", F.lit(None).cast("binary")).unionByName(kept.select((F.col("chunk") * 4 + 2).alias("turn"), F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("value"), "docs"))
    parts = max(1, min(total["chunks"], most_tasks))
    chunk = F.shiftright("turn", 2)
    dense = chunk.bitwiseAND((1 << 24) - 1) * ((total["task"] or 0) + 1) + F.shiftright(chunk, 24)
    dealt = both.repartitionById(parts, F.pmod(dense, F.lit(parts)).cast("int")).sortWithinPartitions("turn")
    train = int(total["t"] or 0) + learned
    vocabulary = distinct + (learned > 0)
    schema = common.fields(RESULT)

    def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Keys in ascending order, and their values."""
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0)
        key, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        return key[order], value[order]

    def look(book, keys):
        codes, uniques = pd.factorize(keys)
        found = np.zeros(len(uniques))
        if len(book[0]):
            at = np.minimum(np.searchsorted(book[0], uniques), len(book[0]) - 1)
            found = np.where(book[0][at] == uniques, book[1][at], 0)
        return found[codes]

    def sums(x, first):
        run = np.concatenate([[0], np.cumsum(x)])
        return run[first[1:]] - run[first[:-1]]

    def scored(blob: bytes, counts, values) -> Iterator[pa.RecordBatch]:
        end = np.log10((learned + 1) / (train + vocabulary + 1))
        for b in pa.ipc.open_stream(blob):
            data, off = common.arrow_bytes(b.column("text"))
            h, first = lower_words(data, off)
            c = look(counts, h)
            code, begin = grams(data, off)
            yield common.batch(
                schema,
                doc_id=b.column("doc_id"),
                held_out=b.column("held_out"),
                n_tokens=np.diff(first) + 1,
                n_known=sums(c > 0, first).astype(np.int64) + int(learned > 0),
                train_tokens=np.full(b.num_rows, train),
                base_score=sums(np.log10((c + 1) / (train + vocabulary + 1)), first) + end,
                score=sums(look(values, code), begin),
            )

    def run(batches):
        books: tuple[list, list] = ([], [])
        for b in batches:
            turn, key, value = (b.column(k).to_numpy() for k in ("turn", "key", "value"))
            cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(turn)]
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                if at == to:
                    continue
                kind = int(turn[at]) & 3
                if kind < 2:
                    books[kind].append((key[at:to], value[at:to]))
                    continue
                counts, values = joined(books[0]), joined(books[1])
                books = ([], [])
                for blob in b.column("docs").slice(at, to - at):
                    yield from scored(blob.as_py(), counts, values)
                common.release()

    return dealt.mapInArrow(run, RESULT)


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    rest = common.crc_mod("doc_id", 7)
    return lm_scoring(common.table(spark, sf_dir, "documents"), rest != 2, rest == 2)


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
