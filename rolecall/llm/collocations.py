"""Phrases of two to four words that stand together, counted exactly by counting quotient filters.

1. *Blocks*: texts of one language are cut into words and pieces inside a task; each block
   (about ``BLOCK`` bytes of text) keeps its distinct words with their counts and the
   sequence of its words as small numbers.
2. *Words*: counts are added over blocks. A phrase that occurs ``least`` times consists of
   words that do, so only those get an id, numbered over all languages. Blocks learn the
   ids of their own distinct words by a join on (language, word): one row per word and
   block, never per occurrence. Nothing is broadcast.
3. *N-grams*: every 2-, 3- and 4-gram of numbered words inside a piece goes into the
   filter of its block, cut into buckets of the permuted n-gram (``quotient_filter``). The
   filters of a bucket are merged in one task; the number of buckets follows the number of
   words, and the permutation spreads any n-grams evenly, so a bucket holds about
   ``BUCKET`` entries at most. A frequent n-gram is one counter per filter.
4. *Scores*: a phrase's parts occur as often as itself, so their counts are among the
   words or phrases found. Everything after the merge is joins and aggregates of them.

Defined results: a null text is empty; a null language is ``und``; repeated rows and ids count as rows
of their own; a text of any length stays within one block; ties of the score are ordered by
count, then by the phrase's bytes; an empty table gives no rows; other columns have no
influence, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.llm import quotient_filter as qf
from rolecall.llm import ragged, rows
from rolecall.session import staged

#: Bytes of text in one block; a longer text is a block of its own.
BLOCK = 4 << 20
#: Entries of one filter before it is sent.
FILTER = 1 << 21
#: N-gram occurrences a bucket is planned for.
BUCKET = 1 << 22
LONGEST = 4
#: Bytes that end a piece, and bytes between words.
STOPS = b".,;:!?\n\x0b\x0c\r"
GAPS = b" \t"
_STOP = np.zeros(256, bool)
_STOP[list(STOPS)] = True
_BETWEEN = _STOP.copy()
_BETWEEN[list(GAPS)] = True


def sequence(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, their counts, words in order) of texts; words count from 1 in order, 0 ends a piece."""
    data, offsets = ragged.texts(column)
    data = ragged.LOWER[data]
    starts, ends, text = ragged.token_spans(data, offsets, _BETWEEN)
    if not len(starts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int32)
    edges = np.concatenate([[0], np.cumsum(ends - starts)])
    kept = np.ascontiguousarray(data[~_BETWEEN[data]])
    spans = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(kept)])
    coded = spans.dictionary_encode()
    order = coded.indices.to_numpy().astype(np.int32)
    stops = np.cumsum(_STOP[data])[starts]
    new = np.flatnonzero((stops[1:] != stops[:-1]) | (text[1:] != text[:-1])) + 1
    return coded.dictionary, np.bincount(order), np.insert(order + np.int32(1), new, np.int32(0))


def planes(numbers: np.ndarray) -> bytes:
    """Small numbers by bytes of equal weight; the upper bytes, mostly zero, compress to little."""
    return np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


def _blocks(docs: DataFrame) -> DataFrame:
    """(lang, words, counts, seq) of each block of ``docs`` (lang, text)."""

    def work(batches):
        waiting: dict[str, list] = {}
        size: dict[str, int] = {}

        def send(lang):
            words, counts, order = sequence(pa.concat_arrays(waiting.pop(lang)))
            size.pop(lang)
            if len(words):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang]),
                        pa.array([words.to_pylist()], pa.list_(pa.string())),
                        pa.array([counts], pa.list_(pa.int64())),
                        pa.array([planes(order)], pa.binary()),
                    ],
                    ["lang", "words", "counts", "seq"],
                )

        for batch in batches:
            langs, texts = batch.column(0), batch.column(1).cast(pa.large_string())
            for lang in pc.unique(langs).to_pylist():
                own = texts.filter(pc.equal(langs, lang)).drop_null()
                length = pc.cumulative_sum(pc.binary_length(own)).to_numpy(zero_copy_only=False)
                at = 0
                while at < len(own):
                    done = length[at - 1] if at else 0
                    end = max(at + 1, int(np.searchsorted(length, done + BLOCK - size.get(lang, 0), "right")))
                    waiting.setdefault(lang, []).append(own.slice(at, end - at))
                    size[lang] = size.get(lang, 0) + int(length[min(end, len(own)) - 1] - done)
                    at = end
                    if size[lang] >= BLOCK or sum(size.values()) >= 4 * BLOCK:
                        yield from send(max(size, key=size.get))
        for lang in list(waiting):
            yield from send(lang)

    schema = "lang string, words array<string>, counts array<bigint>, seq binary"
    return docs.select("lang", "text").mapInArrow(work, schema)


def ngrams(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of all 2- to 4-grams of a sequence of word ids; 0 ends a piece or is no frequent word."""
    found = []
    for n in range(2, LONGEST + 1):
        m = max(0, len(ids) - n + 1)
        grams = np.zeros((LONGEST, m), np.int64)
        for i in range(n):
            grams[i] = ids[i : i + m]
        grams = grams[:, (grams[:n] > 0).all(axis=0)]
        found.append(grams)
    top, rest = qf.permute(np.concatenate(found, axis=1), bits)
    return qf.counted(top, rest, np.ones(len(top), np.int64))


def _filters(blocks: DataFrame, bits: int, prefix: int) -> DataFrame:
    """(bucket, filter) of the n-grams of ``blocks`` (seq, ids)."""

    def cut(entries):
        top, rest, count = entries
        bucket = (top >> np.uint64(64 - prefix)).astype(np.int64) if prefix else np.zeros(len(top), np.int64)
        first, end = ragged.runs(bucket)
        made = [qf.encode(top[a:b], rest[a:b], count[a:b], bits, prefix) for a, b in zip(first, end, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(made, pa.binary())], ["bucket", "filter"])

    def work(batches):
        waiting, size = [], 0
        for batch in batches:
            for seq, ids in zip(batch.column(0), batch.column(1), strict=True):
                at, value = ids.values.field("at").to_numpy(), ids.values.field("id").to_numpy()
                order = from_planes(seq.as_buffer())
                known = np.zeros(int(order.max(initial=0)) + 1, np.int64)
                known[at] = value
                waiting.append(ngrams(known[order], bits))
                size += len(waiting[-1][0])
                if size >= FILTER:
                    yield cut(qf.merge(waiting))
                    waiting, size = [], 0
        if size:
            yield cut(qf.merge(waiting))

    return blocks.select("seq", "ids").mapInArrow(work, "bucket bigint, filter binary")


def _phrases(filters: DataFrame, least: int, bits: int, prefix: int) -> DataFrame:
    """(g, a) of the n-grams that occur ``least`` times; g lists two to four word ids."""

    def settle(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        held, size = [], 0
        for raw in table["filter"]:
            held.append(qf.decode(raw.as_py(), bucket, bits, prefix))
            size += len(held[-1][0])
            if size >= FILTER:  # what is merged early counts once afterwards
                held = [qf.merge(held)]
                size = 0
        top, rest, count = qf.merge(held)
        often = count >= least
        ids = qf.restore(top[often], rest[often], bits)
        length = (ids > 0).sum(axis=0)
        edges = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        flat = ids.T.reshape(-1)
        grams = pa.ListArray.from_arrays(pa.array(edges), pa.array(flat[flat > 0]))
        return pa.table([grams, pa.array(count[often])], names=["g", "a"])

    return filters.groupBy("bucket").applyInArrow(settle, "g array<bigint>, a bigint")


def phrases(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases (g, a), words (id, lang, word, a), totals (lang, n)) of ``docs`` (lang, text).

    ``g`` lists the ids of a phrase's words; both tables hold what occurs ``least`` times in its language.
    """
    named = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    blocks = staged(_blocks(named).withColumn("block", F.monotonically_increasing_id()), "blocks")
    totals = staged(
        blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")),
        "lang-totals",
    )
    told = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    words = told.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("a")).filter(F.col("a") >= least)
    placed = staged(words.withColumn("place", F.monotonically_increasing_id()), "words-placed")
    part = F.shiftright("place", 33)
    of = placed.agg(F.max(part).alias("parts")).first()
    step = (of.parts or 0) + 1
    # place is (partition, number in it): numbers of all partitions interleave, so ids stay dense
    words = staged(placed.select((F.col("place").bitwiseAND((1 << 33) - 1) * step + part + 1).alias("id"), "lang", "word", "a"), "words")
    size = words.agg(F.max("id").alias("ids")).first()
    n = totals.agg(F.sum("n").alias("n")).first().n or 0
    bits = qf.bits_for(size.ids or 1)
    prefix = max(0, int((LONGEST - 1) * n // BUCKET).bit_length())
    asked = blocks.select("block", "lang", F.posexplode("words").alias("at", "word"))
    known = asked.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(
        F.collect_list(F.struct((F.col("at") + 1).alias("at"), "id")).alias("ids")  # at most the distinct words of one block
    )
    filters = _filters(blocks.select("block", "seq").join(known, "block"), bits, prefix)
    return staged(_phrases(filters, least, bits, prefix), "phrases"), words, totals




def collocations(docs: DataFrame, least: int = 30, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language of ``docs`` (lang, text).

    The score of a phrase is that of its weakest cut, 2,000,000 a / (l + r) rounded down,
    where l and r count the parts. A phrase is left out if a longer one that contains it
    occurs at least four fifths as often.
    """
    found, words, totals = phrases(docs, least)
    parts = found.select("g", F.col("a").alias("f")).unionByName(words.select(F.array("id").alias("g"), F.col("a").alias("f")))
    cuts = F.expr("transform(sequence(1, size(g) - 1), k -> struct(k, slice(g, 1, k) AS left, slice(g, k + 1, size(g) - k) AS right))")
    cut = found.select("g", "a", F.explode(cuts).alias("cut")).select("g", "a", "cut.k", "cut.left", "cut.right")
    cut = cut.join(parts.select(F.col("g").alias("left"), F.col("f").alias("l")), "left")
    cut = cut.join(parts.select(F.col("g").alias("right"), F.col("f").alias("r")), "right")
    exact = [F.col(c).cast("decimal(20,0)") for c in ("a", "l", "r")]
    cut = cut.withColumns({"da": exact[0], "both": exact[1] + exact[2]})
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(7,0)) * da) div both AS BIGINT)")
    best = cut.select("g", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("g", "a").agg(F.min("cut").alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size(g) - 1), n -> transform(sequence(1, size(g) - n + 1), i -> slice(g, i, n))))")
    held = found.filter(F.size("g") > 2).select(F.explode(F.array_distinct(inner)).alias("g"), "a").groupBy("g").agg(F.max("a").alias("longer"))
    wide = {c: F.col(c).cast("decimal(20,0)") for c in ("longer", "a")}
    kept = best.join(held, "g", "left").filter(F.col("longer").isNull() | (wide["longer"] * 100 < wide["a"] * 80))
    # the words of a phrase, in order: one row per word meets the table of words
    each = kept.select("g", F.posexplode("g").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    spelt = each.groupBy("g").agg(
        F.first("lang").alias("lang"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"),
    )
    full = kept.join(spelt, "g").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = full.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language over every whole document, with ``least`` = 30."""
    docs = rows.table(spark, sf_dir, "documents")
    return collocations(docs.select("lang", "text"), 30, 2000)


OP11_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, p.i AS piece,
         list_filter(regexp_split_to_array(p.t, '[\\x20\\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, row_number() OVER () AS doc_id,
               unnest(list_transform(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[.,;:!?\\x0A-\\x0D]'), lambda t, i: {'t': t, 'i': i})) AS p
        FROM documents WHERE text IS NOT NULL)
), grams AS (
  SELECT lang, array_to_string(w[s:s + k - 1], ' ') AS g, k, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s
        FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
  GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM grams WHERE f >= 30),
cand AS (SELECT lang, g, f AS a, k, string_split(g, ' ') AS w FROM often WHERE k > 1),
cuts AS (
  SELECT c.lang, c.g, c.a, c.k, j, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN often x ON x.lang = c.lang AND x.g = array_to_string(c.w[1:c.j], ' ')
  JOIN often y ON y.lang = c.lang AND y.g = array_to_string(c.w[c.j + 1:c.k], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inner_parts AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS g, max(a) AS longer
  FROM (SELECT lang, w, a, k, m, unnest(range(1, k - m + 2)) AS s FROM cand, (SELECT unnest([2, 3]) AS m) WHERE m < k)
  GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_parts i USING (lang, g)
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, g AS phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
