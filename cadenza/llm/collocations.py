"""Collocations: phrases whose words come together more often than their parts do.

Each chunk of texts is a generalised suffix automaton, bounded to the longest
phrase. Its states are the nodes of the suffix tree of the pieces read
backwards, so it is built by sorting the places of words by the words before
them: a state is an interval of places (its endpos set), with one string for
each of its lengths. The chunks' counts are summed by ranges of hashes
(``ngram_counts``), and of every frequent phrase one chunk gives the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.arrowtext import LOWER, give_back, mix, stretch_hashes, take_strings, word_bounds
from cadenza.llm.ngram_counts import CELL, RANGE, answer, ask, gram_hashes, parts, squeeze, unsqueeze
from cadenza.plans.scratch import Scratch

#: Longest phrase, least count, percent of a phrase's count at which a longer one stands for it, rows of a language, and parts a language is dealt over before its last sort.
LONGEST, LEAST, COVERED, TOP, SALTS = 4, 30, 80, 2000, 64
#: Bytes of text of a chunk; its automaton takes some forty times as many.
CHUNK = 3 << 20
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATOR = BREAK.copy()
SEPARATOR[[0x20, 0x09]] = True
UNKNOWN = "und"

_bounds = partial(word_bounds, separator=SEPARATOR)


class Automaton:
    """States of the generalised suffix automaton of strings of ids, up to a depth.

    ids: from 0, one string after the other; depth: words before each in its
    string; those before ``first`` are context that isn't counted. State x
    has the strings of ``shortest[x]`` to ``longest[x]`` words that end at
    ``place[x]``, each with ``count[x]`` ends. ``link[x]`` is the state of
    the longest suffix that has more ends, -1 for the root.
    """

    def __init__(self, ids: np.ndarray, depth: np.ndarray, most: int, first: int = 0):
        back = [(ids + 1).astype(np.int32)]
        for j in range(1, most):
            b = np.zeros(len(ids), np.int32)
            b[j:] = back[0][:-j]
            b[depth < j] = 0
            back.append(b)
        radix = int(ids.max(initial=0)) + 2
        key, size = back[-1][first:].astype(np.int64), radix
        for j in reversed(range(most - 1)):
            if size * radix >= 1 << 62:
                _, key = np.unique(key, return_inverse=True)
                size = int(key.max(initial=0)) + 1
            key, size = back[j][first:].astype(np.int64) * size + key, size * radix
        order = np.argsort(key, kind="stable").astype(np.int32) + np.int32(first)
        del key
        n = len(order)
        new = np.zeros(n + 1, bool)
        new[[0, n]] = True
        starts, counts, covers = [], [], []
        for k in range(most):
            b = back[k][order]
            new[1:n] |= b[1:] != b[:-1]
            at = np.flatnonzero(new)
            size_k, at = np.diff(at), at[:-1]
            shown = b[at] > 0 if n else np.zeros(0, bool)
            starts.append(at[shown].astype(np.int32))
            counts.append(size_k[shown].astype(np.int32))
        del back, new
        # A string of k words is in the state of the string of k + 1 that begins at the same row if they have the same ends.
        for k in range(most):
            same = np.zeros(len(starts[k]), bool)
            if k + 1 < most and len(starts[k + 1]):
                at = np.searchsorted(starts[k + 1], starts[k])
                hit = np.minimum(at, len(starts[k + 1]) - 1)
                same = (starts[k + 1][hit] == starts[k]) & (counts[k + 1][hit] == counts[k])
            covers.append(same)
        row, longest = [], []
        for k in range(most):
            row.append(np.stack([starts[k][~covers[k]], counts[k][~covers[k]]]))
            longest.append(np.full(row[-1].shape[1], k + 1))
        at, self.count = np.concatenate(row, 1)
        self.longest = np.concatenate(longest)
        self.place = order[at] if n else at
        self.shortest, self.link = self.longest.copy(), np.full(len(at), -1)
        base = np.cumsum([0] + [len(x) for x in longest])
        state_of = []  # of each string of k words
        for k in reversed(range(most)):
            own = np.empty(len(starts[k]), np.int32)
            own[~covers[k]] = base[k] + np.arange(int((~covers[k]).sum()))
            if covers[k].any():
                own[covers[k]] = state_of[0][np.searchsorted(starts[k + 1], starts[k][covers[k]])]
                self.shortest[own[covers[k]]] = k + 1
            state_of.insert(0, own)
        for k in range(1, most):  # the suffix of k words of a state whose shortest string has k + 1
            of = np.flatnonzero(self.shortest == k + 1)
            if len(of):
                self.link[of] = state_of[k - 1][np.searchsorted(starts[k - 1], at[of], "right") - 1]

    def strings(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Last place and count of each distinct string of so many words."""
        own = (self.shortest <= length) & (length <= self.longest)
        return self.place[own], self.count[own]


def _chunks(docs: DataFrame, most: int, longest: int) -> DataFrame:
    """Chunks of ``docs`` (lang, text): ids of (language, word) by frequency, those pairs themselves, and the words before each in its piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            names, of_row = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            o = np.concatenate([[0], np.cumsum([len(x.encode()) for x in names])])
            salt = mix(stretch_hashes(np.frombuffer("".join(names).encode(), np.uint8), o[:-1], o[1:]) + np.uint64(1))  # else a word in a language would be as that language's name in one named like the word
            for lo, hi, data, start, end, row, carried, _ in parts(batch.column(1), SEPARATOR, _bounds, most, longest - 1):
                if len(start) <= carried:
                    continue
                data = LOWER[data]
                lang = of_row[lo:hi][row]
                h = mix(stretch_hashes(data, start, end) + salt[lang])
                words, at, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                by = np.argsort(-count, kind="stable")
                rank = np.empty(len(by), np.int64)
                rank[by] = np.arange(len(by))
                in_order = np.argsort(at[by])
                text = take_strings(data, start[at[by]][in_order], end[at[by]][in_order]).take(pa.array(np.argsort(in_order)))
                breaks = np.zeros(len(data) + 1, np.int32)
                np.cumsum(BREAK[data], dtype=np.int32, out=breaks[1:])
                begins = np.ones(len(start), bool)
                begins[1:] = (row[1:] != row[:-1]) | (breaks[start[1:]] != breaks[end[:-1]])
                at_start = np.maximum.accumulate(np.where(begins, np.arange(len(start)), 0))
                depth = np.minimum(np.arange(len(start)) - at_start, longest - 1)
                sums = np.bincount(lang[carried:], minlength=len(names))
                used = np.flatnonzero(sums)
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([base + n], pa.int64()), "carried": pa.array([carried], pa.int32()), "langs": pa.array([names[used].tolist()], pa.list_(pa.string())), "sizes": pa.array([sums[used].tolist()], pa.list_(pa.int64())),
                    "lang": [squeeze(np.searchsorted(used, lang[at[by]]))], "text": [zstandard.ZstdCompressor(level=1).compress("\n".join(text.to_pylist()).encode())],
                    "words": [words[by].tobytes()], "ids": [squeeze(rank[inverse])], "depth": [squeeze(depth)],
                })
                n += 1
            give_back()

    return docs.mapInArrow(run, "chunk long, carried int, langs array<string>, sizes array<long>, lang binary, text binary, words binary, ids binary, depth binary")


def _strings(c: dict, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The ids of a chunk, and of each length the length, sorted hashes, counts and last places of its strings."""
    ids, depth, words = unsqueeze(c["ids"]), unsqueeze(c["depth"]), np.frombuffer(c["words"], np.uint64)
    states, hashes, out = Automaton(ids, depth, longest, c["carried"]), words[ids], []
    for k in range(1, longest + 1):
        place, count = states.strings(k)
        h = gram_hashes(hashes, place, k)
        by = np.argsort(h)
        out.append((k, h[by], count[by], place[by]))
    return ids, out


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, chunk: int = CHUNK, per_range: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Two tables: lang, k, phrase, f of all runs of 1 to ``longest`` words that occur ``least`` times or more in a language, and lang, n: the words of each language."""
    scratch = Scratch(docs.sparkSession, "phrases")
    asked = scratch.save(_chunks(docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")), chunk, longest))
    sizes = asked.select(F.explode(F.arrays_zip("langs", "sizes")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.sizes").alias("n"))
    total = int(asked.select(F.explode("sizes").alias("n")).agg(F.sum("n")).first()[0] or 0)
    ranges = max(1, -(-total // per_range))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c = batch.slice(k, 1).to_pylist()[0]
                yield ask(c["chunk"], [(k, h, n) for k, h, n, _ in _strings(c, longest)[1]], ranges)
            give_back()

    def reply(k: int, n: np.ndarray, total: np.ndarray, first: np.ndarray) -> dict:
        """Which of the cell's strings the chunk spells, and how often the corpus has them."""
        own = np.flatnonzero(first & (total >= least))
        return {"size": len(n), "own": squeeze(own), "f": squeeze(total[own])}

    answers = answer(asked.select("chunk", "carried", "words", "ids", "depth").mapInArrow(cells, CELL), reply, "size long, own binary, f binary")

    def spell(left: pa.Table, right: pa.Table) -> pa.Table:
        c = left.to_pylist()[0]
        text = zstandard.ZstdDecompressor().decompress(c["text"]).decode().split("\n")
        lang, langs = unsqueeze(c["lang"]), c["langs"]
        ids, strings = _strings(c, longest)
        right = right.sort_by("range").to_pylist()
        out: dict[str, list] = {"lang": [], "k": [], "phrase": [], "f": []}
        for k, _, _, place in strings:
            at = 0
            for r in right:
                if r["range"] >> 32 != k:
                    continue
                for p, f in zip(place[at + unsqueeze(r["own"])].tolist(), unsqueeze(r["f"]).tolist(), strict=True):
                    run = ids[p - k + 1 : p + 1].tolist()
                    out["lang"].append(langs[lang[run[-1]]])
                    out["k"].append(k)
                    out["phrase"].append(" ".join(text[w] for w in run))
                    out["f"].append(f)
                at += r["size"]
        give_back()
        return pa.table(out, pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())]))

    found = asked.select("chunk", "carried", "langs", "lang", "text", "words", "ids", "depth").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(spell, "lang string, k int, phrase string, f long")
    return scratch.save(found), scratch.save(sizes)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int | None = TOP, chunk: int = CHUNK, per_range: int = RANGE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best ``top`` phrases of each language; all if None.

    Null texts are empty, a null language is ``und``. Words are of bytes that
    are neither spaces nor tabs nor end a piece, ASCII letters in lower case.
    Repeated rows count each. Ties go to the higher count, then to the phrase
    by its bytes. An empty table gives no rows. Only the language and the
    text are read, so other columns may have any name.
    """
    f, sizes = frequent_phrases(docs, lang, text, longest, least, chunk, per_range)
    words = F.split("phrase", " ")
    cand = f.where("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    cuts = cand.select("*", cut.alias("cut")).select(
        "lang", "k", "phrase", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest")
    )
    whole = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast(a as decimal(20, 0)) * cast(2000000 as decimal(10, 0)) div (cast(l as decimal(20, 0)) + r)").cast("long")
    lowest = whole.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    # What a longer candidate covers, one that is longer by a word covers too: its link (without the first word), or the string it prolongs.
    inside = F.explode(F.array(F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " ")))
    longer = cand.where("k >= 3").select("lang", inside.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(f"longer is null or cast(100 as decimal(20, 0)) * longer < cast({covered} as decimal(20, 0)) * a").drop("longer")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        kept = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of every language of documents; nulls, ties, repeats: see ``collocations``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY lang, k, phrase HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2),
cuts AS (SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.lang = s.lang AND len(c.w) > len(string_split(s.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * CAST(c.a AS HUGEINT) >= 80 * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
