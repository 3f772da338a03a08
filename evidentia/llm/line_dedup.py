"""Line dedup: lines whose words are nearly those of an earlier line go.

A line is the set of its words. Two lines match at a Jaccard similarity of 0.8, and a line goes if
any line before it, in the order of (doc_id, line number), matches. The exact set-similarity join:

* Words are ordered by rarity. Frequencies over the whole corpus are counted in a fixed number of
  hash buckets, so the order fits in one small array; it sorts words the same way in every line.
* Two sets that match share one of the rarest few words of each (prefix filter), agree in size
  (length filter), and have enough words left behind the shared one (positional filter). A 64-bit
  parity map of the words bounds their difference from below, which drops nearly all other pairs.
* What is left is verified on all words: first each set against the earlier one that seems least
  apart, then only those that this does not decide against all their others.

Equal sets are one row from the start, so copies of a line meet nobody. Three things keep a word
that many sets share from pairing them all:

* Variants of one passage first meet only the earliest set that has one of the last words of their
  prefixes, where there is a crowd: the first words are often a variant's own, the last the passage's.
  Most match it and are decided; two decided sets are never compared again.
* A word that occurs more than ``frequent`` times is no key by itself. Sets that match share two
  words of prefixes longer by one, and three of prefixes longer by two; so keys are chains of the
  first words shared, one word, two or three, as many as it takes until the counts promise few sets
  on the chain. The bound is a number, not a share, so what one key holds does not grow with the
  corpus. Long lines would have too many chains: over ``pairs_up_to`` words they keep single words,
  over ``triples_up_to`` pairs, and shorter ones that may match them have both.
* Sets that share a run of words are compared at its first only.

A set of few words (under four at 0.8) matches equal sets only; it has its row, but joins nobody.

Only DataFrame functions are used. Words are compared by 63-bit hashes, equal sets found by 128
bits. Defined results: every line with a word takes part unless ``least_words`` says otherwise; a
line without a word never goes; a null text has one empty line and an empty text too; a line of
any length, and a text of any length, is handled whole; rows that agree in id and text are one
document, and each gets its result; documents under one id that differ are ordered by the hash of
their text; null ids come first; empty tables give empty results. Of the columns of ``documents``
only doc_id and text are read; others pass through ``line_dedup``, and one called ``removed``
gives way to the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import let, sieve, sieved
from evidentia.plans.staging import staged

#: Sets of more words have two parity maps, for 64 bits say little of their difference.
SPLIT_PARITY = 90
#: Hash buckets in which word frequencies are counted: 2 ** BUCKET_BITS.
BUCKET_BITS = 18
_REST = 63 - BUCKET_BITS
#: Words of a chain at most; a prefix is longer by as many, less one.
CHAIN = 3
#: Words of a prefix, from its end, by which the sets of a crowd find their earliest.
CROWD_WORDS = 6


@dataclass(frozen=True)
class LineMatching:
    """similarity: Jaccard of word sets. least_words: a line with fewer is left alone.
    hot: sets that share a word from which they first meet the earliest of them.
    frequent: occurrences (of a chain: expected ones) beyond which a key takes another word.
    pairs_up_to, triples_up_to: the most words of a line whose keys take a second and a third word.
    The last four change the work, never the result."""

    similarity: float = 0.8
    least_words: int = 1
    hot: int = 8
    frequent: float = 48
    pairs_up_to: int = 128
    triples_up_to: int = 40


def _spaced(text: Column) -> Column:
    """The text with a plain space for each other white space but line ends."""
    odd = text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\x0c")
    return F.when(odd, F.translate(text, "\t\r\x0b\x0c", "    ")).otherwise(text)


def _bucket(word: Column) -> Column:
    return F.hash(word).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))


def word_ranks(documents: DataFrame) -> DataFrame:
    """One row: ``ranks``, for each hash bucket its place in the order of frequency, rarest first (shifted up),
    ``grades``, for each place how often a word there is expected to occur (as a power of two), and
    ``total``, all words.

    The buckets are numbered in one task; there are 2 ** BUCKET_BITS of them at any size of input. What a
    bucket has of its own is what it has beyond the words that any bucket has."""
    spark = documents.sparkSession
    flat = F.replace(_spaced(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit(" "))
    # Outer here and below, for an inner one would first filter by the array's size, and so split all texts twice.
    counts = documents.select(F.explode_outer(F.split(flat, " ")).alias("w")).groupBy(_bucket(F.col("w")).alias("bucket")).agg(F.count("*").alias("n"))
    every = spark.range(1 << BUCKET_BITS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("n"))
    whole = counts.unionByName(every).groupBy("bucket").agg(F.sum("n").alias("n"))
    ordered = whole.agg(F.sort_array(F.collect_list(F.struct("n", "bucket"))).alias("s"), F.sum("n").alias("total"))
    beyond = F.ceil(F.log2(F.greatest(F.col("s.n") - F.col("total") / (1 << BUCKET_BITS), F.lit(1.0)))).cast("tinyint")
    places = ordered.select("total", F.posexplode("s").alias("rank", "s")).select("total", "rank", F.col("s.bucket").alias("bucket"), beyond.alias("own"))
    by = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"])
    return staged(places.agg(by("bucket", F.shiftleft(F.col("rank").cast("long"), _REST)).alias("ranks"), by("rank", F.col("own")).alias("grades"), F.max("total").alias("total")), "line_word_ranks")


def word_sets(lines: DataFrame, ranks: DataFrame) -> DataFrame:
    """The lines with ``n`` and ``own`` in the place of their text: the distinct words as numbers,
    rarest first, and how many they are.

    A number is the rank of the word's bucket, then 45 bits of another hash. Numbers are never
    null, so they are sorted as plain integers."""
    keep = [c for c in lines.columns if c != "line"]
    rank = lambda w, r: F.coalesce(F.get(r, _bucket(w)), F.lit(0).cast("long"))
    number = lambda w, r: rank(w, r).bitwiseXOR(F.shiftrightunsigned(F.xxhash64(w), BUCKET_BITS + 1))
    numbers = let(F.col("ranks"), lambda r: F.transform("w", lambda w: number(w, r)))
    none = ranks.select(number(F.lit(""), F.col("ranks"))).scalar()
    split = lines.select(*keep, F.split(_spaced(F.col("line")), " ").alias("w"), ranks.select("ranks").scalar().alias("ranks"), none.alias("none"))
    # What is inside a function with a lambda is interpreted; equal words and empty ones go outside of it, in compiled code.
    return split.select(*keep, F.sort_array(F.array_distinct(F.array_remove(numbers, F.col("none")))).alias("own")).select(*keep, F.size("own").alias("n"), "own")


def word_hashes(lines: DataFrame) -> DataFrame:
    """The lines with ``n`` and ``own`` in the place of their text: hashes of the different words, and how many."""
    keep = [c for c in lines.columns if c != "line"]
    own = F.array_remove(F.array_distinct(F.transform(F.split(_spaced(F.col("line")), " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    return lines.select(*keep, own.alias("own")).select(*keep, F.size("own").alias("n"), "own")


def _prefix_length(n: Column, t: float) -> Column:
    """Of two sets that match, each has a shared word among so many of its rarest."""
    return (n - F.ceil(n * t - 1e-9) + 1).cast("int")


def line_keys(documents: DataFrame, ranks: DataFrame, rule: LineMatching) -> DataFrame:
    """Every line: where it is, n, the two keys of its word set, the parity maps (of all words, and of half of
    them if there are many), and of its rarest words, those of the prefix and two more, a hash and the grade."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # The hash is a column before the lines are dealt out, else each line would hash the whole text.
    hashed = documents.select("doc_id", F.xxhash64(text).alias("text_hash"), F.split(text, "\n").alias("lines"))
    own = word_sets(hashed.select("doc_id", "text_hash", F.posexplode_outer("lines").alias("line_no", "line")), ranks)
    n = F.col("n")
    length = _prefix_length(n, rule.similarity)
    prefix = F.slice("own", F.lit(1), F.when(_meets(n, rule), length + (CHAIN - 1)).otherwise(0))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    half = lambda x: x.bitwiseAND(F.lit(64)) == 0
    none = F.lit(0).cast("long")
    parity = F.aggregate("own", none, lambda a, x: a.bitwiseXOR(bit(x)))
    second = F.when(n > SPLIT_PARITY, F.aggregate("own", none, lambda a, x: F.when(half(x), a).otherwise(a.bitwiseXOR(bit(x))))).otherwise(none)
    keyed = own.select("doc_id", "text_hash", "line_no", "n", F.xxhash64("own").alias("k1"), F.xxhash64("own", F.lit(1)).alias("k2"), parity.alias("parity"), second.alias("second"), F.transform(prefix, lambda x: F.hash(x)).alias("prefix"), prefix.alias("rarest"), ranks.select("grades").scalar().alias("known"))
    # Each column is used once, so both projections become one; else each row between them would hold a copy of all known grades.
    grades = let(F.col("known"), lambda g: F.transform("rarest", lambda x: F.coalesce(F.get(g, F.shiftright(x, _REST).cast("int")), F.lit(0).cast("tinyint"))))
    return keyed.select("doc_id", "text_hash", "line_no", "n", "k1", "k2", "parity", "second", "prefix", grades.alias("grades"))


def _meets(n: Column, rule: LineMatching) -> Column:
    """n words match n + 1 at best: below this size only equal sets match, and they are one row."""
    return n >= rule.similarity / (1 - rule.similarity) - 1e-9 if rule.similarity < 1 else F.lit(False)


def line_sets(keys: DataFrame, rule: LineMatching) -> DataFrame:
    """One row for each word set, with a number, the place of its first line and how many lines it has."""
    at = F.struct("doc_id", "text_hash", "line_no")
    # What lines of one set have in common comes after the place, so it has no part in the order.
    same = ("n", "parity", "second", "prefix", "grades")
    found = keys.filter(F.col("n") >= max(rule.least_words, 1)).groupBy("k1", "k2").agg(F.min(F.struct(at.alias("first"), *same)).alias("s"), F.count("*").alias("n_lines"))
    return found.select("k1", "k2", "s.first", "n_lines", *[f"s.{c}" for c in same]).withColumn("id", F.monotonically_increasing_id())


def overlap_needed(a: Column, b: Column, t: float) -> Column:
    return F.ceil((a + b) * (t / (1 + t)) - 1e-9)


#: What the filters need of a set.
_SET = ("id", "n", "parity", "second")
#: What tells whether a pair is still of use: whether the set is undecided, and how early it is.
_USE = ("open", "age")


def key_rows(sets: DataFrame, ranks: DataFrame, rule: LineMatching) -> DataFrame:
    """A row for each chain of each set (id, n, parity, second, open, age, prefix, grades): the key; ``room``, the most
    words that two sets can share if the chain is the first words that they share; and the word
    ``before`` the chain.

    Whether a chain takes another word depends on its words alone, and by size on the side of a limit:
    sets on either side of it that may match have the shorter chain in common."""
    t, n, size, last = rule.similarity, F.col("n"), F.size("prefix"), F.col("last")
    limits = (rule.pairs_up_to, rule.triples_up_to)
    counted = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.get("grades", i).cast("int")).cast("double")
    facts = sets.filter(size > 0).withColumn("total", ranks.select("total").scalar())
    rows = facts.withColumn("length", F.least(_prefix_length(n, t), size))
    rows = rows.select("*", F.explode_outer(F.sequence(F.lit(0), F.col("length") - 1)).alias("last")).withColumn("first", last)
    rows = rows.withColumns({"key": F.get("prefix", last).cast("long"), "expected": counted(last), "words": F.lit(1)})
    for words in range(1, CHAIN):
        longer = (F.col("words") == words) & (F.col("expected") > rule.frequent) & (n <= limits[words - 1])
        stays = ~longer | (n >= limits[words - 1] * t - 1e-9)
        # The place of the chain's next word; -1 for the chain as it is.
        start, stop = last + 1, F.least(F.col("length") + words, size)
        more = F.when(longer & (start < stop), F.sequence(start, stop - 1)).otherwise(F.array().cast("array<int>"))
        itself = F.when(stays, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
        rows = rows.select("*", F.explode_outer(F.concat(itself, more)).alias("next")).filter("next is not null")
        # A line holds about ten words.
        share = F.least(F.lit(1.0), counted(F.col("next")) * 10 / F.greatest("total", F.lit(1)))
        grown = F.col("next") >= 0
        step = {"key": F.xxhash64("key", F.get("prefix", F.col("next"))), "expected": F.col("expected") * share, "last": F.col("next"), "words": F.lit(words + 1)}
        rows = rows.withColumns({name: F.when(grown, value).otherwise(F.col(name)) for name, value in step.items()}).drop("next")
    before = F.coalesce(F.get("prefix", F.col("first") - 1), F.lit(0))
    return rows.select("key", (n - last + (F.col("words") - 1)).alias("room"), before.alias("before"), *_USE, *_SET)


def _may_match(t: float) -> tuple[Column, Column]:
    """Whether sets a and b that share a key may match, and the least possible difference: length,
    positional and parity filters."""
    c = lambda side, name: F.col(f"{side}.{name}")
    n, m = c("a", "n"), c("b", "n")
    need = overlap_needed(n, m, t)
    differ = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    whole = differ(c("a", "parity"), c("b", "parity"))
    halves = differ(c("a", "parity").bitwiseXOR(c("a", "second")), c("b", "parity").bitwiseXOR(c("b", "second"))) + differ(c("a", "second"), c("b", "second"))
    apart = F.when((n > SPLIT_PARITY) & (m > SPLIT_PARITY), halves).otherwise(whole)
    sized = F.least(n, m) >= F.greatest(n, m) * t - 1e-9
    return (c("a", "key") == c("b", "key")) & sized & (F.least(c("a", "room"), c("b", "room")) >= need) & (apart <= n + m - 2 * need), apart


def pairs_with_earliest(sets: DataFrame, rule: LineMatching) -> DataFrame:
    """(later, earlier): the sets of a crowd that shares one of the last words of their prefixes, and
    the earliest set of it, where these may match by length and parity; each word has one such pair
    for each set at most, so no position is asked for."""
    last = F.slice("prefix", F.greatest(F.size("prefix") - (CROWD_WORDS - 1), F.lit(1)), F.lit(CROWD_WORDS))
    rows = sets.select(*_SET, F.col("n").alias("room"), "first", F.explode(last).alias("key"))
    crowds = rows.groupBy("key").agg(F.count("*").alias("many"), F.min(F.struct("first", *_SET, "room")).alias("p")).filter(F.col("many") >= rule.hot)
    may, _ = _may_match(rule.similarity)
    met = rows.alias("a").join(crowds.select("key", "p.*").alias("b"), may & (F.col("a.id") != F.col("b.id")))
    return met.select(F.col("a.id").alias("later"), F.col("b.id").alias("earlier")).distinct()


def candidates(rows: DataFrame, t: float) -> DataFrame:
    """(one, other, apart): sets that may match, the later of them undecided; each pair once.

    Sets of one document, or of null ids, are of one age; there either may be the later."""
    may, apart = _may_match(t)
    older, either = F.col("a.age") < F.col("b.age"), F.col("a.open") | F.col("b.open")
    useful = F.when(older, F.col("b.open")).when(F.col("a.age") > F.col("b.age"), F.col("a.open")).otherwise(either)
    fresh = (F.col("a.before") != F.col("b.before")) | (F.col("a.before") == 0)
    met = rows.alias("a").join(rows.alias("b"), (F.col("a.id") > F.col("b.id")) & either & fresh & useful & may)
    return met.select(F.col("a.id").alias("one"), F.col("b.id").alias("other"), apart.alias("apart")).distinct()


def _words_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, first and ``own``, all words, of the sets in ``wanted`` (id, first), from the documents.

    Documents without a wanted line stay where they are read, and of the others only the wanted
    lines are split into words."""
    lines = F.collect_list(F.struct("id", F.col("first.line_no").alias("line_no")))
    spots = staged(wanted.groupBy(F.col("first.doc_id").alias("of"), F.col("first.text_hash").alias("its_hash")).agg(lines.alias("spots")), "line_spots")
    text = F.coalesce("text", F.lit(""))
    some = documents.select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text"))
    some = sieved(some, sieve(spots.select(F.xxhash64("of", "its_hash").alias("h")), "line_sieve"), F.xxhash64("doc_id", "hash"))
    met = some.join(spots, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("its_hash")))
    split = met.select("doc_id", "hash", "spots", F.split("text", "\n").alias("lines"))
    picked = F.transform("spots", lambda x: F.struct(x["id"].alias("id"), x["line_no"].alias("line_no"), F.get("lines", x["line_no"]).alias("line")))
    rows = split.select("doc_id", "hash", picked.alias("picked")).select("doc_id", "hash", F.explode_outer("picked").alias("s"))
    place = F.struct("doc_id", F.col("hash").alias("text_hash"), F.col("s.line_no").alias("line_no"))
    return word_hashes(rows.select(F.col("s.id").alias("id"), place.alias("first"), F.col("s.line").alias("line")))


class _Verifier:
    """Holds the words of sets as they are asked for, and tells which pairs match."""

    def __init__(self, documents: DataFrame, sets: DataFrame, t: float):
        self.documents, self.t = documents, t
        self.places = sets.select("id", "first")
        self.words: DataFrame | None = None

    def learn(self, ids: DataFrame) -> None:
        """Fetch the words of sets that are not there yet."""
        wanted = ids.distinct()
        if self.words is not None:
            wanted = wanted.join(self.words.select("id"), "id", "left_anti")
        wanted = self.places.join(wanted, "id", "left_semi")
        found = staged(_words_of(self.documents, wanted).dropDuplicates(["id"]), "line_words")
        self.words = found if self.words is None else self.words.union(found)

    def later(self, pairs: DataFrame) -> DataFrame:
        """``id`` of the later set of each pair (later, earlier) that matches."""
        a = self.words.select(F.col("id").alias("later"), F.col("n").alias("n_a"), F.col("own").alias("own_a"))
        b = self.words.select(F.col("id").alias("earlier"), F.col("n").alias("n_b"), F.col("own").alias("own_b"))
        both = pairs.select("later", "earlier").join(b, "earlier").join(a, "later")
        common = F.size(F.array_intersect("own_a", "own_b"))
        return both.filter(common >= overlap_needed(F.col("n_a"), F.col("n_b"), self.t)).select(F.col("later").alias("id")).distinct()

    def likeliest_first(self, pairs: DataFrame) -> DataFrame:
        """The same, but each later set first meets the earlier one that seems least apart from it.

        Only those that this does not decide meet all their others."""
        best = pairs.groupBy("later").agg(F.min(F.struct("apart", "earlier"))["earlier"].alias("earlier"))
        decided = staged(self.later(best), "line_decided")
        rest = pairs.join(decided.withColumnRenamed("id", "later"), "later", "left_anti").join(best, ["later", "earlier"], "left_anti")
        return decided.union(self.later(rest))


def matched_sets(documents: DataFrame, ranks: DataFrame, sets: DataFrame, rule: LineMatching) -> DataFrame:
    """``id`` of the sets that match an earlier set."""
    t = rule.similarity
    verify = _Verifier(documents, sets, t)
    ids = lambda pairs, a, b: pairs.select(F.col(a).alias("id")).union(pairs.select(b))
    crowded = staged(pairs_with_earliest(sets, rule), "line_crowded")
    verify.learn(ids(crowded, "later", "earlier"))
    known = staged(verify.later(crowded), "line_decided")
    marked = sets.join(known.withColumn("done", F.lit(True)), "id", "left").withColumn("open", F.col("done").isNull()).withColumn("age", F.col("first.doc_id"))
    met = staged(candidates(key_rows(marked, ranks, rule), t), "line_pairs")
    verify.learn(ids(met, "one", "other"))
    place = lambda name, first: verify.words.select(F.col("id").alias(name), F.col("first").alias(first))
    ordered = met.join(place("one", "f"), "one").join(place("other", "g"), "other")
    pick = lambda x, y: F.when(F.col("f") < F.col("g"), F.col(y)).otherwise(F.col(x))
    pairs = ordered.select(pick("one", "other").alias("later"), pick("other", "one").alias("earlier"), "apart")
    pairs = staged(pairs.join(known.withColumnRenamed("id", "later"), "later", "left_anti"), "line_ordered")
    return staged(known.union(verify.likeliest_first(pairs)), "line_decided")


def duplicate_lines(documents: DataFrame, rule: LineMatching = LineMatching()) -> DataFrame:
    """doc_id, text_hash and ``removed``, the numbers (from 0) of the lines that go, where there are any."""
    ranks = word_ranks(documents)
    keys = staged(line_keys(documents, ranks, rule), "line_keys")
    sets = staged(line_sets(keys, rule), "line_sets")
    gone = matched_sets(documents, ranks, sets, rule).distinct().withColumn("gone", F.lit(True))
    verdict = sets.select("id", "k1", "k2", "first", "n_lines").join(gone, "id", "left").filter("gone or n_lines > 1").drop("id", "n_lines")
    at = keys.select("doc_id", "text_hash", "line_no", "k1", "k2")
    judged = at.join(verdict, ["k1", "k2"]).filter(F.coalesce("gone", F.lit(False)) | (F.struct("doc_id", "text_hash", "line_no") > F.col("first")))
    return judged.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def line_dedup(documents: DataFrame, rule: LineMatching = LineMatching()) -> DataFrame:
    """The documents, each with the lines that stay, and ``removed``, the numbers of those that went.

    A column of the documents that is called ``removed`` gives way."""
    removed = staged(duplicate_lines(documents, rule), "line_removed")
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[F.col(c) for c in documents.columns])
    rows = documents.select(row.alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"))
    met = rows.join(removed, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    kept = lambda removed: F.array_join(F.filter(F.split(F.col("row.text"), "\n"), lambda x, i: ~F.array_contains(removed, i)), "\n")
    new = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept(F.col("removed")))
    return met.select(*[new.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in documents.columns if c != "removed"], F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
