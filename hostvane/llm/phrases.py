"""Word collocations: n-gram counts from an FM-index per shard, summed across shards and scored by their weakest cut.

Texts are lower-cased (A-Z only) and split into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces
and tabs. Everything is counted per language.

1. Every task writes its texts as blocks of one language: the sequence of local word numbers, and a dictionary with
   counts. Counts of all dictionaries give each word's frequency; only words frequent enough to be part of a
   candidate go back to the blocks, under a number they have everywhere.
2. A block is a shard. Its text, and the text reversed, are sorted by the next few words, which gives two
   Burrows-Wheeler transforms. Starting from single words, intervals are extended to the right: the symbols of
   the reversed transform inside a phrase's interval are the words that follow it, so counting them gives all longer phrases
   at once, with their intervals in both indexes. The symbols before and after a phrase tell how often it extends at
   all. Depth is limited, so sorting by that many words is enough.
3. Every shard deals its phrases out to buckets by hash, packed as sorted columns; a bucket's counts are summed across
shards. Every phrase is scored by its worst cut into two known phrases.

Only the numbers of words and phrases are shuffled, each once per shard; a word that fills a third of the
corpus is one dictionary entry per shard. No count is dropped before it is summed. There are as many buckets as the
corpus has words for, so none grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostvane.llm.workers import slices
from hostvane.operators.toprows import RANK, top_rows
from hostvane.session import materialize

MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
CONTAINED_PERCENT = 50
SCALE = 1_000_000
UNKNOWN = "und"
BLOCK_BYTES = 3 << 20  # text held by a task at once; a block has at most as many words
BUCKET_PHRASES = 2_000_000  # counts of phrases that are summed at once, at most
LOCAL_BITS = 32
# What ends a piece, and what stands between words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
BORDER, RARE = 0, 1  # symbols that no phrase holds

BLOCK_SCHEMA = "shard long, local long, lang string, word string, n long, numbers binary"


def _flags(which: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(which)] = True
    return out


def words_of(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words of all texts in lower case, whether a piece begins with each of them)."""
    raw = np.frombuffer(b"\n".join(texts).lower(), np.uint8)  # bytes.lower() changes A-Z only
    ends = _flags(PIECE_ENDS)[raw]
    inside = ~ends & ~_flags(BLANKS)[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, stops = edges[::2], edges[1::2]
    bounds = np.concatenate([[0], np.cumsum(stops - starts)])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw[inside].tobytes())]
    ).dictionary_encode()
    seen = np.concatenate([[0], np.cumsum(ends)])
    first = np.ones(len(starts), dtype=bool)
    first[1:] = seen[starts[1:]] != seen[stops[:-1]]
    return words, first


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    from pyspark import TaskContext

    pack, names = zstandard.ZstdCompressor(level=1).compress, ["shard", "local", "lang", "word", "n", "numbers"]
    shard, held, size = TaskContext.get().partitionId() << 32, {}, 0

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal shard
        for lang, texts in held.items():
            words, first = words_of(texts)
            found = words.dictionary
            if not len(found):
                continue
            numbers = words.indices.to_numpy().astype(np.uint32) + np.uint32(1)
            sequence = np.zeros(len(numbers) + int(first.sum()), np.uint32)
            sequence[np.arange(len(numbers)) + np.cumsum(first)] = numbers  # a zero in front of every piece
            n = np.bincount(numbers)[1:]
            none = pa.nulls(len(found), pa.binary())
            spoken = pa.array([lang] * len(found), pa.string())
            local = pa.array(np.arange(len(found)), pa.int64())
            text = found.cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), shard)), local, spoken, text, pa.array(n), none], names)
            whole = [[shard], [-1], [lang], [None], [len(numbers)], [pack(sequence.tobytes())]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(whole, kinds)], names)
            shard += 1

    for batch in (part for whole in batches for part in slices(whole)):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
            if size >= BLOCK_BYTES:
                yield from flushed()
                held, size = {}, 0
    yield from flushed()


def blocks(docs: DataFrame) -> DataFrame:
    """Shards of ``docs`` (text, lang), written once: rows with ``numbers`` are sequences, the others dictionary entries."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    slim = docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text"))
    return materialize(slim.mapInArrow(_blocks, BLOCK_SCHEMA), "phrase-blocks")


def vocabulary(written: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((shard, local, word_id), (word_id, lang, word, f), (lang, n)) of the words seen ``min_count`` times or more.

    A word's first occurrence in any dictionary names it; names are then numbered without gaps, so that phrases are short.
    """
    entries = written.where("numbers IS NULL").select("shard", "local", "lang", "word", "n")
    sizes = entries.groupBy("lang").agg(F.sum("n").alias("n"))
    same = Window.partitionBy("lang", "word")
    place = F.struct("shard", "local")
    counted = entries.withColumn("f", F.sum("n").over(same)).withColumn("name", F.min(place).over(same))
    frequent = materialize(counted.where(F.col("f") >= min_count).drop("n"), "phrase-words")
    named = frequent.where(F.col("name") == place).select("shard", "local", "lang", "word", "f")
    named = materialize(named.withColumn("at", F.monotonically_increasing_id()), "phrase-names")
    # Numbers without gaps: a row's place in its part, after the rows of the parts before (one row a part).
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = named.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    parts = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    numbered = named.withColumn("part", part).join(F.broadcast(parts), "part")
    number = F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    words = materialize(numbered.select("shard", "local", number.alias("word_id"), "lang", "word", "f"), "phrase-vocabulary")
    if words.where(F.col("word_id") >= F.lit(1 << 32)).limit(1).count():
        raise ValueError("more than 2**32 words")
    names = words.select(F.struct("shard", "local").alias("name"), "word_id")
    return frequent.select("shard", "local", "name").join(names, "name").drop("name"), words.drop("shard", "local"), sizes


def _sort_keys(symbols: np.ndarray, depth: int) -> np.ndarray:
    """A number per position that orders the next ``depth`` symbols; nothing counts beyond a symbol no phrase holds."""
    n, base = len(symbols), int(symbols.max(initial=0)) + 1
    key, ended, top = symbols.copy(), symbols <= RARE, base
    for k in range(1, depth):
        if top * base >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            top = n
        following = np.zeros(n, np.int64)
        following[: n - k] = symbols[k:]
        following[ended] = 0
        key, top = key * base + following, top * base
        ended |= following <= RARE
    return key


def transformed(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The Burrows-Wheeler transform under an order of ``depth`` symbols: the symbol before each suffix, in that order."""
    order = np.argsort(_sort_keys(symbols, depth), kind="stable")
    return np.where(order > 0, symbols[order - 1], BORDER)


def enumerate_phrases(symbols: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(phrases as rows of symbols, counts, occurrences after a word, occurrences before a word) for 1 to ``depth`` words.

    ``symbols`` begin and end with a border, so both transforms hold the same symbols as the text.
    ``low`` is where a phrase's interval begins in the index of the text, ``back`` where it does in that of the reversed text.
    """
    left, right = transformed(symbols, depth), transformed(symbols[::-1], depth)
    count = np.bincount(symbols, minlength=RARE + 1)
    begin = np.cumsum(count) - count
    rank = np.empty(len(right), np.int64)  # of a row's symbol among equal ones, in its place among all: the LF mapping
    rank[np.argsort(right, kind="stable")] = np.arange(len(right))
    alive = np.flatnonzero(count)
    alive = alive[alive > RARE]
    phrase, low, back, size = alive[:, None], begin[alive], begin[alive], count[alive]
    words_before = np.concatenate([[0], np.cumsum(left != BORDER)])
    words_after = np.concatenate([[0], np.cumsum(right != BORDER)])
    for length in range(1, depth + 1):
        if not len(size):
            return
        yield phrase, size, words_before[low + size] - words_before[low], words_after[back + size] - words_after[back]
        if length == depth:
            return
        owner = np.repeat(np.arange(len(size)), size)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        row = back[owner] + offset
        base = int(count.shape[0])
        pairs, first, many = np.unique(owner * base + right[row], return_index=True, return_counts=True)
        parent, symbol = pairs // base, pairs % base
        # Inside the parent's interval the text's index is ordered by the next symbol.
        before = np.cumsum(many) - many
        inner = before - before[np.searchsorted(parent, parent)]
        longer = symbol > RARE
        parent, symbol = parent[longer], symbol[longer]
        phrase = np.column_stack([phrase[parent], symbol])
        low, back, size = low[parent] + inner[longer], rank[row[first[longer]]], many[longer]


def _planes(column: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: most are alike."""
    return column.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def packed(columns: list[np.ndarray], compress) -> bytes:
    return compress(b"".join(_planes(c) for c in columns))


def unpacked(blob, columns: int, decompress) -> np.ndarray:
    """What was ``packed`` (columns x rows)."""
    planes = np.frombuffer(decompress(blob), np.uint8).reshape(columns, 4, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(columns, -1)


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    mixed = np.zeros(len(ids), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ids.shape[1]):
            mixed = (mixed ^ ids[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(buckets)).astype(np.int64)


def _count_phrases(max_words: int, buckets: int):
    kinds, names = [pa.int64(), pa.int32(), pa.binary()], ["bucket", "words", "counts"]

    def counted(sequences: pa.Table, numbers: pa.Table) -> pa.Table:
        import zstandard

        out = [[], [], []]
        if sequences.num_rows and numbers.num_rows:
            compress = zstandard.ZstdCompressor(level=1).compress
            sequence = np.frombuffer(zstandard.ZstdDecompressor().decompress(sequences.column("numbers")[0].as_buffer()), np.uint32)
            local, ids = numbers.column("local").to_numpy(), numbers.column("word_id").to_numpy()
            order = np.argsort(ids)  # symbols in the order of words everywhere, so phrases come sorted
            local, ids = local[order], ids[order]
            symbol = np.full(int(sequence.max()) + 1, RARE, np.int64)
            symbol[0] = BORDER
            symbol[local + 1] = RARE + 1 + np.arange(len(local))
            symbols = symbol[sequence]
            again = np.zeros(len(symbols), dtype=bool)
            again[1:] = (symbols[1:] == symbols[:-1]) & (symbols[1:] <= RARE)
            symbols = np.append(symbols[~again], BORDER)
            for phrase, n, after_word, before_word in enumerate_phrases(symbols, max_words):
                if phrase.shape[1] < 2:
                    continue
                spelled = ids[phrase - RARE - 1]
                where = _bucket(spelled, buckets)
                dealt = np.argsort(where, kind="stable")
                bounds = np.searchsorted(where[dealt], np.arange(buckets + 1))
                columns = [*spelled[dealt].T, n[dealt], after_word[dealt], before_word[dealt]]
                for k in np.flatnonzero(np.diff(bounds)):
                    out[0].append(k)
                    out[1].append(phrase.shape[1])
                    out[2].append(packed([c[bounds[k] : bounds[k + 1]] for c in columns], compress))
        return pa.table([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    return counted


def _sum_counts(min_count: int):
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def summed(table: pa.Table) -> pa.Table:
        import zstandard

        decompress, words = zstandard.ZstdDecompressor().decompress, table.column("words")[0].as_py()
        every = np.hstack([unpacked(b.as_buffer(), words + 3, decompress) for b in table.column("counts")])
        ids, numbers = every[:words], every[words:]
        order = np.lexsort(ids[::-1])
        ids = ids[:, order]
        first = np.flatnonzero(np.append(True, (ids[:, 1:] != ids[:, :-1]).any(axis=0)))
        sums = np.add.reduceat(numbers[:, order].astype(np.int64), first, axis=1)
        kept = sums[0] >= min_count
        ids, sums = np.ascontiguousarray(ids[:, first[kept]].T.astype(">u4")), sums[:, kept]
        bounds = pa.py_buffer((np.arange(len(ids) + 1) * 4 * words).astype(np.int32))
        keys = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, bounds, pa.py_buffer(ids.tobytes())])
        return pa.table([keys, *map(pa.array, sums)], schema=pa.schema(list(zip(["phrase", "n", "after_word", "before_word"], kinds))))

    return summed


def phrase_counts(written: DataFrame, numbers: DataFrame, max_words: int, min_count: int) -> DataFrame:
    """(phrase, n, after_word, before_word): phrases of 2 to ``max_words`` words with their counts over all shards.

    ``phrase`` holds the numbers of its words, four bytes each. ``after_word`` and ``before_word``: occurrences that follow a word
    of their piece, and that one follows.
    """
    sequences = written.where("numbers IS NOT NULL").select("shard", "numbers", "n")
    shards, words = sequences.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(1, -(-words // BUCKET_PHRASES))  # phrases of one length are at most as many as words
    tasks = max(int(written.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // 4))
    own = sequences.select("shard", "numbers").repartition(tasks, "shard").groupBy("shard")
    counted = own.cogroup(numbers.repartition(tasks, "shard").groupBy("shard")).applyInArrow(
        _count_phrases(max_words, buckets), "bucket long, words int, counts binary"
    )
    placed = counted.repartition(buckets * (max_words - 1), "bucket", "words").groupBy("bucket", "words")
    summed = placed.applyInArrow(_sum_counts(min_count), "phrase binary, n long, after_word long, before_word long")
    return materialize(summed, "phrase-counts")


def word_at(phrase: Column, k: int) -> Column:
    """Number of the ``k``-th word, from 0."""
    return F.conv(F.hex(F.substring(phrase, 4 * k + 1, 4)), 16, 10).cast("long")


def floor_score(a: str, l: str, r: str) -> Column:
    """The floor of SCALE a a / (l r), exact: products have up to 38 digits."""
    a, l, r = (f"CAST({x} AS DECIMAL(19,0))" for x in (a, l, r))
    return F.expr(f"({a} * {a} * CAST({SCALE} AS DECIMAL(7,0))) div ({l} * {r})")


def collocations(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    contained_percent: int = CONTAINED_PERCENT,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of ``docs`` (text, lang).

    a: occurrences of the phrase; l, r: of the two parts of its worst cut; n: words of the language; score: the floor of
    1,000,000 a a / (l r). A phrase inside a longer one that has at least ``contained_percent`` of its occurrences is left out.
    Null texts are empty and null languages ``und``; repeated rows count each; an empty table, or one
    without frequent phrases, gives no rows.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have two words or more, seen at least once")
    written = blocks(docs)
    numbers, words, sizes = vocabulary(written, min_count)
    counts = phrase_counts(written, numbers, max_words, min_count)
    return ranked(counts, words, sizes, max_words, top, contained_percent)


def ranked(counts: DataFrame, words: DataFrame, sizes: DataFrame, max_words: int, top: int, contained_percent: int) -> DataFrame:
    """Score, filter and rank phrase ``counts``."""
    length = (F.octet_length("phrase") / 4).cast("int")
    single = words.select(F.unhex(F.lpad(F.hex("word_id"), 8, "0")).alias("part"), F.col("f").alias("n"))
    known = single.unionByName(counts.select(F.col("phrase").alias("part"), "n"))
    scored = None
    for size in range(2, max_words + 1):
        rows = counts.where(length == size).select("phrase", F.col("n").alias("a"))
        for k in range(1, size):
            for side, start, many in (("l", 0, k), ("r", k, size - k)):
                part = F.substring("phrase", 4 * start + 1, 4 * many)
                rows = rows.withColumn("part", part).join(known.withColumnRenamed("n", f"{side}{k}"), "part").drop("part")
        cuts = [
            F.struct(
                floor_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")
            )
            for k in range(1, size)
        ]
        worst = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        rows = rows.select("phrase", "a", worst.alias("cut")).select("phrase", "a", "cut.score", "cut.l", "cut.r")
        scored = rows if scored is None else scored.unionByName(rows)
    # How often the most frequent longer phrase around each phrase occurs.
    inside = None
    for size in range(3, max_words + 1):
        rows = counts.where(length == size)
        for many in range(2, size):
            for start in range(size - many + 1):
                one = rows.select(F.substring("phrase", 4 * start + 1, 4 * many).alias("phrase"), "n")
                inside = one if inside is None else inside.unionByName(one)
    if inside is not None:
        around = inside.groupBy("phrase").agg(F.max("n").alias("around"))
        scored = scored.join(around, "phrase", "left").where(
            F.col("around").isNull() | (F.lit(100) * F.col("around") < F.lit(contained_percent) * F.col("a"))
        )
    scored = materialize(scored, "phrase-scores")
    out = None
    for size in range(2, max_words + 1):
        rows = scored.where(length == size)
        for k in range(size):
            own = words.select(F.col("word_id").alias("at"), F.col("word").alias(f"w{k}"), *([F.col("lang")] if k == 0 else []))
            rows = rows.withColumn("at", word_at(F.col("phrase"), k)).join(own, "at").drop("at")
        rows = rows.select("lang", F.concat_ws(" ", *[f"w{k}" for k in range(size)]).alias("phrase"), "a", "l", "r", "score")
        out = rows if out is None else out.unionByName(rows)
    first = top_rows(out, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    named = first.join(F.broadcast(sizes), "lang")
    return named.select("lang", F.col(RANK).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(max_count: int = MIN_COUNT) -> str:
    """The same for DuckDB, for phrases of two and three words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), numbered AS (
  SELECT lang, row_number() OVER () AS piece_id, regexp_split_to_array(piece, '[\\x20\\x09]+') AS w FROM pieces
), spoken AS (
  SELECT lang, piece_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM numbered
), runs AS (
  SELECT lang, w AS w1, lead(w) OVER (PARTITION BY piece_id ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY piece_id ORDER BY i) AS w3
  FROM spoken WHERE w <> ''
), grams AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM runs
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL
), f AS (
  SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL
), sizes AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), split AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {max_count}
), cuts AS (
  SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS c FROM split
), parts AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.c, x.f AS l, y.f AS r, (1000000 * c.a * c.a) // (x.f * y.f) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.c], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.c + 1:], ' ')
), worst AS (
  SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM split WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM split WHERE k = 3)
  GROUP BY ALL
), kept AS (
  SELECT x.* FROM worst x LEFT JOIN inside i ON i.lang = x.lang AND i.phrase = x.phrase
  WHERE i.a IS NULL OR 100 * i.a < {CONTAINED_PERCENT} * x.a
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT p.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       s.n, CAST(score AS BIGINT) AS score
FROM placed p JOIN sizes s ON s.lang = p.lang WHERE rank <= {TOP}
"""
