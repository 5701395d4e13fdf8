"""Phrase collocations of each language: phrases of words that stand together more often than their parts let expect.

1. Texts are lower-cased and split into pieces and words in column operations over Arrow buffers; identical pieces become one row with
   a multiplicity, in a grouping. Pieces are packed into blocks of about ``BLOCK_BYTES`` and written.
2. Each block counts its own words and pairs of words, weighted by multiplicity, and deals them out to hash buckets as packed
   columns. A bucket gathers the same phrases of all blocks and counts them out of core in duckdb; it answers each block which
   of its pairs are frequent (an answer is a list of the block's own numbers, so it is small and meets its block again by a
   shuffle). The block then counts phrases of three and four words that hold frequent pairs alone, which are all that can be
   frequent, and these are counted in buckets alike.
3. Each candidate asks for the counts of its parts, and tells phrases inside of it about its own count; requests are shuffled to
   their phrases and answers back to the candidates, where the lowest cut is taken. The first ones of a language are found in
   shares of its candidates before they meet.

Nothing is approximate: a phrase is left out only where a part of it is too rare. All is sent between tasks; nothing grows on the
driver. A bucket spills to the folders that Spark gives its Python workers for that, and leaves nothing there.

Defined cases: null text counts as empty, null language as ``und``; pieces without words count for nothing; repeated rows all
count; very long words, pieces and texts are whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import bounded_batches, written

#: Least occurrences of a candidate, most words of it, rows of a language in the result.
LEAST, WORDS, MOST = 30, 4, 2000
#: Bytes of text in a block of pieces, and memory of a bucket in duckdb before it spills.
BLOCK_BYTES, BUCKET_MEMORY = 8 << 20, "256MB"
#: Shares of a language's candidates whose first ones are found apart.
SHARES = 32
_SCALE = 2_000_000
_REQUEST = "bucket long, block long, request binary"
_COUNTED = "block long, answer binary, lang string, phrase string, words int, n long"

# Bytes of UTF-8 texts: capitals to small letters, ends of pieces to line ends, tabs to spaces. All are ASCII, so no other character changes.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[ord("A") : ord("Z") + 1] += 32
_BYTES[[ord(c) for c in ".,;:!?\n\v\f\r"]] = ord("\n")
_BYTES[ord("\t")] = ord(" ")


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def pieces_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The pieces of some texts, their words joined by single spaces, and the text that each is of."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts])  # without an offset into a longer buffer
    offsets, data = texts.buffers()[1:]
    data = pa.py_buffer(_BYTES[np.frombuffer(data, np.uint8)]) if data is not None else data
    pieces = pc.split_pattern(pa.LargeStringArray.from_buffers(len(texts), offsets, data), "\n")
    of, pieces = pc.list_parent_indices(pieces), pc.ascii_trim(pc.list_flatten(pieces), " ")
    some = pc.not_equal(pieces, "")
    pieces = pc.binary_join(pc.ascii_split_whitespace(pieces.filter(some)), pa.scalar(" ", pa.large_string()))
    return of.filter(some).to_numpy(), pieces


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of, pieces = pieces_of(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pieces.cast(pa.string())], ["lang", "piece"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs rows of (lang, piece, n) into blocks, numbered within their task."""
    from pyspark import TaskContext

    first, kept, size, count = TaskContext.get().partitionId() << 32, [], 0, 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([first + count]), pa.array([packed(pa.Table.from_batches(kept))], pa.binary())], ["block", "pieces"])

    for batch in batches:
        kept.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield block()
            kept, size, count = [], 0, count + 1
    if kept:
        yield block()


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    starts = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    return list(zip(starts, [*starts[1:], len(values)][: len(starts)], strict=True))


class Phrases:
    """The phrases of a block, numbered in an order that the block alone decides, so that it can be built again."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        langs = pc.dictionary_encode(table["lang"]).combine_chunks()
        words = pc.split_pattern(table["piece"], " ").combine_chunks()
        piece, words = pc.list_parent_indices(words).to_numpy(), pc.dictionary_encode(pc.list_flatten(words))
        self.langs, self.texts = langs.dictionary, words.dictionary
        self.piece, self.times = piece, table["n"].to_numpy()[piece]
        # A word is one of a language; the dictionary's codes are in order of appearance.
        lang = langs.indices.to_numpy()[piece].astype(np.int64)
        self.kinds, self.codes = np.unique(lang * max(1, len(self.texts)) + words.indices.to_numpy(), return_inverse=True)

    def counted(self, codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct codes, their sums, and the place of each code among them."""
        distinct, place = np.unique(codes, return_inverse=True)
        order = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[order], np.arange(len(distinct)))
        return distinct, np.add.reduceat(times[order], starts) if len(distinct) else times[:0], place

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The places where a pair starts; distinct pairs, their counts, and which pair stands at each place."""
        at = np.flatnonzero(self.piece[1:] == self.piece[:-1])
        return at, *self.counted(self.codes[at] * len(self.kinds) + self.codes[at + 1], self.times[at])

    def text(self, *words: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Languages and texts of phrases from the kinds of their words."""
        size = max(1, len(self.texts))
        parts = [self.texts.take(pa.array(self.kinds[w] % size)) for w in words]
        lang = self.langs.take(pa.array(self.kinds[words[0]] // size))
        return lang, pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]


def _requests(block: int, buckets: int, groups: list[tuple[int, np.ndarray, pa.Array, pa.Array, np.ndarray]]) -> pa.RecordBatch:
    """Deals phrases (words, numbers, languages, texts, counts) out to buckets by the hash of language and text."""
    import pandas as pd

    table = pa.concat_tables([
        pa.table({"lang": lang.cast(pa.string()), "phrase": text.cast(pa.string()), "words": pa.array(np.full(len(count), words, np.int8)), "number": pa.array(number, pa.int64()), "n": pa.array(count, pa.int64())})
        for words, number, lang, text, count in groups
    ]).combine_chunks()
    named = pc.binary_join_element_wise(table["lang"], table["phrase"], " ").to_numpy(zero_copy_only=False)
    bucket = (pd.util.hash_array(named, categorize=False) % np.uint64(buckets)).astype(np.int64) if len(named) else np.zeros(0, np.int64)
    order = np.argsort(bucket, kind="stable")
    table, bucket = table.take(pa.array(order)), bucket[order]
    own = runs(bucket)
    data = [packed(table.slice(a, b - a)) for a, b in own]
    return pa.RecordBatch.from_arrays([pa.array(bucket[np.array([a for a, _ in own], np.int64)], pa.int64()), pa.array([block] * len(data), pa.int64()), pa.array(data, pa.binary())], ["bucket", "block", "request"])


def short_phrases(buckets: int):
    """Words and pairs of each block, and (as phrases of no words) how many words it has in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                p = Phrases(unpacked(data.as_py()))
                kinds, n, _ = p.counted(p.codes, p.times)
                lang, text = p.text(kinds)
                lang_of = p.kinds // max(1, len(p.texts))
                langs, total, _ = p.counted(lang_of, n)
                _, pairs, pair_n, _ = p.pairs()
                pair_lang, pair_text = p.text(pairs // len(p.kinds), pairs % len(p.kinds))
                none = pa.array([""] * len(langs), pa.string())
                yield _requests(block, buckets, [(0, np.full(len(langs), -1), p.langs.take(pa.array(langs)), none, total), (1, np.full(len(kinds), -1), lang, text, n), (2, np.arange(len(pairs)), pair_lang, pair_text, pair_n)])

    return run


def long_phrases(buckets: int):
    """Phrases of three and four words of a block, of frequent pairs alone, from the block and the answers to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary())], ["bucket", "block", "request"])]
        if left.num_rows and right.num_rows:
            p = Phrases(unpacked(left["pieces"][0].as_py()))
            at, pairs, _, place = p.pairs()
            frequent = np.zeros(len(pairs), bool)
            for answer in right["answer"]:
                frequent[np.frombuffer(answer.as_py(), np.int64)] = True
            good = np.zeros(len(p.codes), bool)
            good[at[frequent[place]]] = True  # a frequent pair starts here
            groups = []
            for words in range(3, WORDS + 1):
                start = np.flatnonzero(np.logical_and.reduce([good[k : len(good) - words + 1 + k] for k in range(words - 1)])) if len(good) >= words else at[:0]
                # Codes of a phrase by steps, so that they stay small whatever the number of words.
                code = p.codes[start]
                for k in range(1, words):
                    code = np.unique(code, return_inverse=True)[1] * len(p.kinds) + p.codes[start + k]
                _, n, where = p.counted(code, p.times[start])
                some = np.zeros(len(n), np.int64)
                some[where] = start
                groups.append((words, np.full(len(n), -1), *p.text(*(p.codes[some + k] for k in range(words))), n))
            out.append(_requests(left["block"][0].as_py(), buckets, groups))
        return pa.Table.from_batches(out)

    return run


def counts(least: int):
    """Counts the requests of a bucket in duckdb: frequent phrases, and answers to blocks that asked for numbers."""

    def run(table: pa.Table) -> pa.Table:
        import duckdb

        place = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        with tempfile.TemporaryDirectory(prefix="bucket-", dir=place if place and os.path.isdir(place) else None, ignore_cleanup_errors=True) as spill:
            con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": spill, "preserve_insertion_order": False})
            con.execute("CREATE TABLE asked (block BIGINT, lang VARCHAR, phrase VARCHAR, words TINYINT, number BIGINT, n BIGINT)")
            for block, request in zip(table["block"].to_pylist(), table["request"], strict=True):
                one = unpacked(request.as_py())  # noqa: F841
                con.execute("INSERT INTO asked SELECT ?, lang, phrase, words, number, n FROM one", [block])
            con.execute(f"CREATE TABLE frequent AS SELECT lang, phrase, words, sum(n)::BIGINT AS n FROM asked GROUP BY ALL HAVING words = 0 OR sum(n) >= {least}")
            found = con.sql("SELECT lang, phrase, words::INT AS words, n FROM frequent").to_arrow_table()
            answers = con.sql("SELECT block, number FROM asked JOIN frequent USING (lang, phrase, words) WHERE number >= 0 ORDER BY block").to_arrow_table()
            con.close()
        block, number = answers["block"].to_numpy(), answers["number"].to_numpy()
        own = runs(block)
        data = [number[a:b].astype(np.int64).tobytes() for a, b in own]
        n, m = found.num_rows, len(data)
        return pa.table({
            "block": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([int(block[a]) for a, _ in own], pa.int64())]),
            "answer": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(data, pa.binary())]),
            "lang": pa.concat_arrays([found["lang"].combine_chunks().cast(pa.string()), pa.nulls(m, pa.string())]),
            "phrase": pa.concat_arrays([found["phrase"].combine_chunks().cast(pa.string()), pa.nulls(m, pa.string())]),
            "words": pa.concat_arrays([found["words"].combine_chunks(), pa.nulls(m, pa.int32())]),
            "n": pa.concat_arrays([found["n"].combine_chunks(), pa.nulls(m, pa.int64())]),
        })

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of up to WORDS words that occur ``least`` times, and (lang, n) of all words."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    pieces = texts.mapInArrow(_pieces, "lang string, piece string").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("n"))
    blocks = written(pieces.mapInArrow(_blocks, "block long, pieces binary"), "phrase-blocks")
    buckets = max(8, blocks.count())

    def in_buckets(requests: DataFrame, name: str) -> DataFrame:
        return written(requests.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(counts(least), _COUNTED), name)

    short = in_buckets(blocks.mapInArrow(short_phrases(buckets), _REQUEST), "phrase-short")
    answers = short.where(F.col("answer").isNotNull()).select("block", "answer")
    long = in_buckets(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(long_phrases(buckets), _REQUEST), "phrase-long")
    found = short.unionByName(long).where(F.col("answer").isNull()).select("lang", "phrase", "words", "n")
    return found.where("words > 0"), found.where("words = 0").select("lang", "n")


def big(c: str):
    """A count as a number whose products with small ones are exact."""
    return F.col(c).cast("decimal(20,0)")


def scored(found: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, a, l, r, score) with their lowest cut, and inside, the most that a longer candidate around them
    occurs, from the counts of phrases."""
    words = found.withColumn("parts", F.split("phrase", " ", -1))
    candidates = words.where("words >= 2")
    slice_ = lambda a, n: F.array_join(F.slice("parts", a, n), " ")
    sides = F.flatten(F.expr("transform(sequence(1, words - 1), k -> array(struct(k AS cut, 1 AS side, array_join(slice(parts, 1, k), ' ') AS part), struct(k AS cut, 2 AS side, array_join(slice(parts, k + 1, words - k), ' ') AS part)))"))
    requests = candidates.select("lang", "phrase", F.col("n").alias("a"), F.explode(sides).alias("ask")).select("lang", "phrase", "a", "ask.*")
    replies = requests.join(found.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"])
    # What a longer phrase tells the ones inside of it.
    inside = F.flatten(F.expr("transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(parts, i, m), ' ')))"))
    told = candidates.where("words >= 3").select("lang", F.explode(inside).alias("phrase"), F.col("n").alias("around"))
    both = replies.select("lang", "phrase", "a", "cut", "side", "n", F.lit(None).cast("long").alias("around")).unionByName(told, allowMissingColumns=True)
    at = lambda k, side: F.max(F.when((F.col("cut") == k) & (F.col("side") == side), F.col("n")))
    met = both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("around").alias("around"), *(at(k, side).alias(f"{x}{k}") for k in range(1, WORDS) for side, x in ((1, "l"), (2, "r"))))
    cut = lambda k: F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"(cast({_SCALE} AS decimal(10,0)) * cast(a AS decimal(20,0))) div (cast(l{k} AS decimal(20,0)) + cast(r{k} AS decimal(20,0)))").alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    lowest = met.withColumn("low", F.array_min(F.filter(F.array(*map(cut, range(1, WORDS))), lambda x: x.isNotNull())))
    return lowest.select("lang", "phrase", "a", "low.l", "low.r", "low.score", "around")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``most`` candidates that no longer one holds in four of five."""
    found, totals = phrase_counts(docs, least, text_col, lang_col)
    kept = scored(found).where(F.col("around").isNull() | (F.lit(100).cast("decimal(3,0)") * big("around") < F.lit(80).cast("decimal(3,0)") * big("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for share in ([F.pmod(F.xxhash64("phrase"), F.lit(SHARES))], []):
        kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang", *share).orderBy(*order))).where(F.col("rank") <= most)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
