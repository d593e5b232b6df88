"""Collocations of two to four words by best-first branch-and-bound growth.

Words are named by 64 bits of a keyed hash of language and word; no two words of the corpus may share a name, which is checked.
Unigrams are counted once, then all pairs of words that are frequent enough. From there on phrases grow: a batch of the phrases
with the best bounds is *expanded*, that is, one pass over the corpus counts every word before and after each of their
occurrences. A phrase with count ``a`` and first parts ``l1, l2, ...`` bounds the score of all that begin with it by
``floor(2000000 a / (l + a))`` for each first part, as neither a longer phrase's count nor a rest's can pass ``a`` or fall short of the
phrase's own. The growth ends when, in each language, no phrase that isn't expanded has a bound that reaches the lowest score of the
best ``top`` survivors, ties included. A phrase is dropped for a longer one that holds nearly all its occurrences; if there is such a
one, there is one of one word more, because counts fall with length. So expanding a phrase settles whether it survives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenora.llm.sieve import bits_of, has_bit
from tenora.plans.staging import staged

LEAST, TOP, DROP_PERCENT, SCALE = 30, 2000, 80, 2_000_000
BATCH_OF_LANGUAGE, BATCH = 1 << 14, 1 << 16  # phrases expanded in one pass; what is broadcast is at most BATCH of 24 bytes
SLICE = 4 << 20  # bytes of text taken at once; only a piece longer than this is taken whole
HELD = 4_000_000  # words or pairs counted before they are handed on
REMEMBERED = 1 << 20

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes.maketrans(_UPPER + b"\t" + b".,;:!?\n\x0b\x0c\r", _LOWER + b" " + b"\n" * 10)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _Names(dict):
    """Words of one language to their names; the end of a piece is 0."""

    def __init__(self, lang: str, seed: int):
        super().__init__({b"\n": 0})
        self.key = hashlib.blake2b(f"{seed} {lang}".encode(), digest_size=32).digest()

    def __missing__(self, word: bytes) -> int:
        name = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little", signed=True) or 1
        self[word] = name
        return name


def _slices(text: str) -> Iterator[bytes]:
    data = text.encode().translate(_TABLE)
    at = 0
    while len(data) - at > SLICE:
        end = data.rfind(b"\n", at + 1, at + SLICE)  # a slice begins with the end of a piece, which is not its own end
        end = data.find(b"\n", at + SLICE) if end < 0 else end
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def _token_arrays(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[str, _Names, np.ndarray]]:
    """Languages (null: und), their names, and names of words in order, with 0 before, after and between pieces."""
    known: dict[str, _Names] = {}
    waiting: dict[str, list[bytes]] = {}
    held = 0

    def taken() -> Iterator[tuple[str, _Names, np.ndarray]]:
        for lang, parts in waiting.items():
            if len(known) > 64:
                known.clear()
            names = known.setdefault(lang, _Names(lang, seed))
            if len(names) > REMEMBERED:
                names = known[lang] = _Names(lang, seed)
            words = b"\n".join([b"", *parts, b""]).replace(b"\n", b" \n ").split(b" ")
            yield lang, names, np.fromiter(map(names.__getitem__, filter(None, words)), np.int64)
        waiting.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in _slices(text):
                waiting.setdefault(lang, []).append(part)
                held += len(part)
                if held > SLICE:
                    yield from taken()
                    held = 0
    yield from taken()


def _scan(docs: DataFrame, seed: int, count: Callable[[Iterator[tuple[str, _Names, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL AND text <> ''")
    return rows.mapInArrow(lambda batches: count(_token_arrays(batches, seed)), schema)


def _tally(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of equally long columns with their numbers; rows whose mixture collides may come in several parts."""
    mixed = reduce(np.bitwise_xor, ((c.astype(np.uint64) * m) ^ ((c.astype(np.uint64) * m) >> np.uint64(29)) for c, m in zip(columns, _MIX, strict=False)))
    order = np.argsort(mixed)
    ordered = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = reduce(np.logical_or, (c[1:] != c[:-1] for c in ordered))
    at = np.flatnonzero(new)
    return [c[at] for c in ordered], np.diff(np.append(at, len(order)))


def word_counts(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Words of each language: lang, word, name, n."""

    def count(arrays: Iterator[tuple[str, _Names, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], int] = {}
        texts: dict[tuple[str, int], bytes] = {}

        def out() -> pa.RecordBatch:
            keys = list(sums)
            columns = [[k[0] for k in keys], [texts[k].decode() for k in keys], [k[1] for k in keys], list(sums.values())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["lang", "word", "name", "n"])

        for lang, names, words in arrays:
            found, n = np.unique(words[words != 0], return_counts=True)
            told = {v: k for k, v in names.items()}
            for name, c in zip(found.tolist(), n.tolist(), strict=True):
                key = (lang, name)
                if key in sums:
                    sums[key] += c
                else:
                    sums[key], texts[key] = c, told[name]
            if len(sums) > REMEMBERED:
                yield out()
                sums.clear(), texts.clear()
        yield out()

    return _scan(docs, seed, count, "lang string, word string, name long, n long").groupBy("lang", "word", "name").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, frequent: DataFrame, least: int, seed: int = 0) -> DataFrame:
    """Neighbouring pairs of frequent words (column name) with at least ``least`` occurrences: w1, w2, a."""
    bits = docs.sparkSession.sparkContext.broadcast(bits_of(frequent, F.col("name")))

    def count(arrays: Iterator[tuple[str, _Names, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                (a, b), n = _tally(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held.clear()
                for at in range(0, len(n), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in (a, b, n)], ["w1", "w2", "n"])

        for _, _, words in arrays:
            fine = has_bit(bits.value, words) & (words != 0)
            both = fine[:-1] & fine[1:]
            held.append((words[:-1][both], words[1:][both]))
            if sum(len(a) for a, _ in held) > HELD:
                yield from out()
        yield from out()

    return _scan(docs, seed, count, "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


class _Wanted:
    """Phrases of one length to be found in a sequence of names."""

    def __init__(self, phrases: np.ndarray, numbers: np.ndarray):
        mixed = self._mixed([phrases[:, i] for i in range(phrases.shape[1])])
        order = np.argsort(mixed)
        self.mixed, self.phrases, self.numbers = mixed[order], phrases[order], numbers[order]
        self.near = np.zeros(1 << 22, bool)
        self.near[(self.mixed >> np.uint64(42)).astype(np.int64)] = True
        # phrases with one mixture stand beside each other
        self.most = int(np.unique(mixed, return_counts=True)[1].max(initial=0))

    @staticmethod
    def _mixed(columns: list[np.ndarray]) -> np.ndarray:
        out = reduce(np.bitwise_xor, ((c.astype(np.uint64) * m) ^ ((c.astype(np.uint64) * m) >> np.uint64(29)) for c, m in zip(columns, _MIX, strict=False)))
        return out * _MIX[0]

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a wanted phrase begins, and its number."""
        size = self.phrases.shape[1]
        if not len(self.numbers) or len(words) < size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        columns = [words[i : len(words) - size + 1 + i] for i in range(size)]
        mixed = self._mixed(columns)
        at = np.flatnonzero(self.near[(mixed >> np.uint64(42)).astype(np.int64)])
        first = np.searchsorted(self.mixed, mixed[at])
        places, numbers = [], []
        for step in range(self.most):
            j = np.minimum(first + step, len(self.numbers) - 1)
            same = np.ones(len(at), bool) if step == 0 else first + step < len(self.numbers)
            for i, c in enumerate(columns):
                same &= self.phrases[j, i] == c[at]
            places.append(at[same])
            numbers.append(self.numbers[j[same]])
        return np.concatenate(places), np.concatenate(numbers)


def neighbour_counts(docs: DataFrame, batch: list, least: int, seed: int = 0) -> DataFrame:
    """Words before and after the phrases (w1, w2, w3 or null) of ``batch``, with their occurrences: number, after, word, n.

    ``batch`` is broadcast; callers bound it by ``BATCH``. Words with fewer than ``least`` occurrences there are left out.
    """
    groups = []
    for size in (2, 3):
        of = [(i, [row["w1"], row["w2"], row["w3"]][:size]) for i, row in enumerate(batch) if (row["w3"] is None) == (size == 2)]
        groups.append((np.array([p for _, p in of], np.int64).reshape(-1, size), np.array([i for i, _ in of], np.int64)))
    sent = docs.sparkSession.sparkContext.broadcast(groups)

    def count(arrays: Iterator[tuple[str, _Names, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        wanted = [_Wanted(*g) for g in sent.value]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                (side, word), n = _tally(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held.clear()
                for at in range(0, len(n), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in (side, word, n)], ["side", "word", "n"])

        for _, _, words in arrays:
            for w in wanted:
                at, number = w.found(words)
                for after, word in ((0, words[at - 1]), (1, words[np.minimum(at + w.phrases.shape[1], len(words) - 1)])):
                    real = word != 0  # a piece begins or ends here
                    held.append((number[real] * 2 + after, word[real]))
            if sum(len(a) for a, _ in held) > HELD:
                yield from out()
        yield from out()

    rows = _scan(docs, seed, count, "side long, word long, n long").groupBy("side", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return rows.select(F.shiftright("side", 1).alias("number"), (F.col("side") % 2 == 1).alias("after"), "word", "n")


def _div(a: str, parts: str) -> Column:
    return F.expr(f"(CAST({SCALE} AS DECIMAL(8,0)) * CAST({a} AS DECIMAL(20,0))) div CAST({parts} AS DECIMAL(21,0))")


_PHRASE = ["lang", "w1", "w2", "w3", "w4", "size", "a", "l", "r", "score", "bound", "f1", "f2", "f3"]


def _scored(rows: DataFrame, size: int) -> DataFrame:
    """Phrases with the counts of their first parts f1.. and rests r1..: the lowest-scoring cut, and the bound of what begins with them."""
    cuts = [F.struct(_div("a", f"f{k} + r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"f{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]
    best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    bounds = [_div("a", f"f{k} + a") for k in range(1, size)]
    none = F.lit(None).cast("long")
    out = rows.withColumn("best", best).withColumn("bound", F.least(*bounds) if len(bounds) > 1 else bounds[0])
    words = [F.col(f"w{i}") if i <= size else none.alias(f"w{i}") for i in range(1, 5)]
    parts = [F.col(f"f{i}") if i < size else none.alias(f"f{i}") for i in range(1, 4)]
    return out.select("lang", *words, F.lit(size).alias("size"), "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"), "bound", *parts)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, drop_percent: int = DROP_PERCENT) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Reads lang and text alone, so other columns may have any name. Null languages are ``und``, null and empty texts have no words. Ties
    are broken by count, then by the phrase's bytes. Repeated rows count as often as they occur. An empty table, and one
    without frequent phrases, gives no rows.
    """
    seed = 0
    while True:
        words = staged(word_counts(docs, seed), "words")
        if words.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            break
        seed += 1  # two words share a name: name them anew
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    uni = frequent.select("name", F.col("n").alias("f"))
    pairs = staged(pair_counts(docs, frequent, least, seed), "pairs")
    first = frequent.select(F.col("name").alias("w1"), "lang", F.col("n").alias("f1"))
    last = frequent.select(F.col("name").alias("w2"), F.col("n").alias("r1"))
    known = staged(_scored(pairs.join(first, "w1").join(last, "w2"), 2), "phrases")
    triples: list[DataFrame] = []
    settled: DataFrame | None = None
    while True:
        floors = _floors(known, settled, top, drop_percent)
        batch = _batch(known, settled, floors)
        if not batch:
            break
        found = staged(neighbour_counts(docs, batch, least, seed), "neighbours")
        spark = docs.sparkSession
        asked = spark.createDataFrame([(i, *row) for i, row in enumerate(batch)], f"number long, {known.select(*_PHRASE).schema.simpleString()[7:-1].replace(':', ' ')}")
        most = found.groupBy("number").agg(F.max("n").alias("most"))
        now = asked.join(most, "number", "left").select("w1", "w2", "w3", F.coalesce("most", F.lit(0)).alias("most"))
        settled = staged(now if settled is None else settled.unionByName(now), "settled")
        grown = asked.join(found.where("after").select("number", "word", F.col("n").alias("longer")), "number")
        three = grown.where("size = 2").select("lang", "w1", "w2", F.col("word").alias("w3"), F.col("longer").alias("a"), "f1", F.col("a").alias("f2"))
        ends = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"))
        three = three.join(ends, ["w2", "w3"]).join(uni.select(F.col("name").alias("w3"), F.col("f").alias("r2")), "w3")
        three = staged(_scored(three, 3), "triples")
        triples.append(three)
        rest3 = reduce(DataFrame.unionByName, triples).select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), F.col("a").alias("r1"))
        rest2 = pairs.select(F.col("w1").alias("w3"), F.col("w2").alias("w4"), F.col("a").alias("r2"))
        four = grown.where("size = 3").select("lang", "w1", "w2", "w3", F.col("word").alias("w4"), F.col("longer").alias("a"), "f1", "f2", F.col("a").alias("f3"))
        four = four.join(rest3, ["w2", "w3", "w4"]).join(rest2, ["w3", "w4"]).join(uni.select(F.col("name").alias("w4"), F.col("f").alias("r3")), "w4")
        known = staged(known.unionByName(three).unionByName(_scored(four, 4)), "phrases")
    return _named(_surviving(known, settled, drop_percent), floors, words, totals, top)


def _with_state(known: DataFrame, settled: DataFrame | None) -> DataFrame:
    """Phrases with ``most``, the count of their most frequent extension, null where it isn't known yet."""
    if settled is None:
        return known.withColumn("most", F.when(F.col("size") == 4, F.lit(0)).cast("long"))
    s = settled.select(F.col("w1").alias("s1"), F.col("w2").alias("s2"), F.col("w3").alias("s3"), "most")
    on = (F.col("w1") == F.col("s1")) & (F.col("w2") == F.col("s2")) & F.coalesce("w3", F.lit(0)).eqNullSafe(F.coalesce("s3", F.lit(0))) & (F.col("size") < 4)
    return known.join(s, on, "left").drop("s1", "s2", "s3").withColumn("most", F.when(F.col("size") == 4, F.lit(0).cast("long")).otherwise(F.col("most")))


def _surviving(known: DataFrame, settled: DataFrame | None, drop_percent: int) -> DataFrame:
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return _with_state(known, settled).where(F.col("most").isNotNull() & (wide("most") * 100 < wide("a") * drop_percent))


def _floors(known: DataFrame, settled: DataFrame | None, top: int, drop_percent: int) -> DataFrame:
    """The lowest score among each language's best ``top`` survivors so far; no row for a language with fewer."""
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc()))
    best = _surviving(known, settled, drop_percent).select("lang", "score").withColumn("nth", nth).where(F.col("nth") <= top)
    return staged(best.groupBy("lang").agg(F.min("score").alias("floor"), F.count("*").alias("have")).where(F.col("have") >= top).select("lang", "floor"), "floors")


def _batch(known: DataFrame, settled: DataFrame | None, floors: DataFrame) -> list:
    """The next phrases to expand, best bounds first, each with the pair that ends it, as a longer phrase's rests need that one's count."""
    state = _with_state(known, settled)
    open_ = state.where(F.col("most").isNull()).join(floors, "lang", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("bound").desc(), "w1", "w2", "w3"))
    chosen = staged(open_.withColumn("nth", nth).where(F.col("nth") <= BATCH_OF_LANGUAGE).orderBy("nth").limit(BATCH // 2).select(*_PHRASE), "chosen")
    ends = chosen.where("size = 3").select(F.col("w2").alias("e1"), F.col("w3").alias("e2")).distinct()
    support = state.where("size = 2 AND most IS NULL").join(ends, (F.col("w1") == F.col("e1")) & (F.col("w2") == F.col("e2")), "left_semi").select(*_PHRASE)
    return chosen.unionByName(support).distinct().collect()


def _named(rows: DataFrame, floors: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    best = rows.join(floors, "lang", "left").where(F.col("floor").isNull() | (F.col("score") >= F.col("floor")))
    for i in range(1, 5):
        best = best.join(words.select(F.col("name").alias(f"w{i}"), F.col("word").alias(f"t{i}")), f"w{i}", "left")
    best = best.select("lang", F.concat_ws(" ", "t1", "t2", "t3", "t4").alias("phrase"), "a", "l", "r", "score")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    ranked = best.withColumn("rank", nth.cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations over all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY 1),
grams AS (SELECT lang, k AS size, w[i : i + k - 1] AS p, count(*) AS a FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, range(1, 5) r(k) WHERE len(w) >= k) GROUP BY ALL),
cand AS (SELECT * FROM grams WHERE size > 1 AND a >= 30),
cuts AS (SELECT c.lang, c.size, c.p, c.a, x.a AS l, y.a AS r, k, CAST(2000000::HUGEINT * c.a // (x.a + y.a) AS BIGINT) AS score FROM cand c JOIN range(1, 4) t(k) ON k < c.size JOIN grams x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN grams y ON y.lang = c.lang AND y.p = c.p[k + 1 :]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, a, p[i : i + k - 1] AS p FROM (SELECT lang, size, a, p, k, unnest(range(1, size - k + 2)) AS i FROM cand, range(2, 4) r(k) WHERE k < size)),
tops AS (SELECT lang, p, max(a) AS most FROM inner_parts GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(array_to_string(b.p, ' '))) AS rank, array_to_string(b.p, ' ') AS phrase, b.a, b.l, b.r, n, score
FROM best b JOIN totals USING (lang) LEFT JOIN tops t ON t.lang = b.lang AND t.p = b.p WHERE t.most IS NULL OR 100::HUGEINT * t.most < 80::HUGEINT * b.a QUALIFY rank <= 2000"""
