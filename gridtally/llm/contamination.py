"""Benchmark passages in documents, found through a positional inverted index.

The index holds one posting (term, row, pos) for every word of a document that some test item uses,
sorted by term within each part, and one record per document. It is cut by documents, like the shards
of a search engine, so building it shuffles nothing and a frequent word is no hot key. Every run of
`width` words of an item is a phrase. Its two rarest words, by the counts of the index, are its probe:
their lists are moved by their offsets and intersected, which leaves next to nothing but real matches;
these are intersected with the lists of the phrase's other words. Only DataFrame functions are used.

Defined results: a null or empty text has no words; an item without words has no phrase; a null
item_id marks words as hit, but names no item; items with the same item_id are one item; repeated
documents are judged each for itself. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import small, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts that postings of one word are dealt into where the vocabulary is too large to broadcast.
SALTS = 64


def raw_words(text: Column) -> Column:
    """Words of a text as an array, still in their own case."""
    cells = F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS)
    lead = (F.get(cells, F.lit(0)) == "").cast("int")
    trail = (F.element_at(cells, -1) == "").cast("int")
    return F.slice(cells, lead + 1, F.greatest(F.size(cells) - lead - trail, F.lit(0)))


def folded_word(word: Column) -> Column:
    """A-Z lower-cased; the quick way where the word is ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


@dataclass
class Phrases:
    """Stored test phrases: the distinct ones with their words, the items that hold them, and all their words."""

    width: int
    windows: DataFrame
    items: DataFrame
    vocabulary: DataFrame


def phrases(benchmark: DataFrame, width: int = 10) -> Phrases:
    """Every run of `width` words of an item; an item of fewer words is one phrase."""
    words = F.transform(raw_words(F.col("text")), folded_word)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    runs = items.select("item_id", "words", F.explode(starts).alias("j")).select("item_id", F.slice("words", F.col("j"), F.lit(width)).alias("words"))
    runs = stored(runs.distinct(), "phrases")
    windows = stored(runs.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "phrases-distinct")
    held = stored(runs.where("item_id IS NOT NULL").join(windows, "words").select("wid", "item_id"), "phrases-items")
    vocabulary = windows.select(F.explode("words").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id())
    return Phrases(width, windows, held, stored(vocabulary, "phrases-words"))


@dataclass
class Index:
    """Postings (term, row, pos) of the words asked for, and (row, doc_id, n_words) of every document."""

    postings: DataFrame
    documents: DataFrame


def build_index(docs: DataFrame, vocabulary: DataFrame, max_words: int = 500_000) -> Index:
    """The positions, from 1, of every vocabulary word (word, term) in docs. One pass over the texts.

    vocabulary: a stored table. Up to `max_words` words of 32 bytes on average are broadcast; beyond
    that postings and copies of the words meet by word and salt.

    A document's record is the posting of the empty word at position 0, so records and postings come
    from the same write and agree on `row`, whatever executor is lost meanwhile.
    """
    words = raw_words(F.col("text"))
    rows = docs.select(F.col("doc_id"), words.alias("words")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "doc_id", F.size("words").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), F.col("words"))).alias("pos", "raw"))
    record = F.col("pos") == 0
    rows = rows.select(
        "row", "pos", folded_word(F.col("raw")).alias("word"),
        F.when(record, F.col("doc_id")).alias("doc_id"), F.when(record, F.col("n")).alias("n_words"))
    terms = vocabulary.select("word", "term").unionAll(docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(-1).cast("long").alias("term")))
    n, size = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if n <= max_words and size <= 32 * max_words:
        found = rows.join(F.broadcast(terms), "word")
    else:
        # Too many words to broadcast: every posting goes to one of several copies of its word.
        salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = rows.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["word", "salt"])
    table = stored(found.select("term", "row", "pos", "doc_id", "n_words").sortWithinPartitions("term", "row", "pos"), "index", "zstd")
    return Index(
        table.where("term >= 0").select("term", "row", "pos"),
        table.where("term = -1").select("row", "doc_id", F.col("n_words").cast("long").alias("n_words")))


def _parts(index: Index, asked: Phrases) -> DataFrame:
    """(wid, width, parts): the words of every phrase as (freq, term, off), rarest first.

    Phrases with a word that no document has cannot occur and are left out.
    """
    freq = index.postings.groupBy("term").agg(F.count("*").alias("freq"))
    known = asked.vocabulary.join(freq, "term")
    words = asked.windows.select("wid", F.size("words").alias("width"), F.posexplode("words").alias("off", "word"))
    rows = words.join(known, "word").groupBy("wid").agg(
        F.first("width").alias("width"), F.sort_array(F.collect_list(F.struct("freq", "term", "off"))).alias("parts"))
    return stored(rows.where(F.size("parts") == F.col("width")), "phrases-rare")


def _probes(parts: DataFrame) -> DataFrame:
    """(t1, t2, delta, wids): the two rarest words and how far apart they are; wids are (wid, off of the rarest)."""
    first, second = F.col("parts")[0], F.coalesce(F.get("parts", F.lit(1)), F.col("parts")[0])
    return parts.select(
        "wid", first["term"].alias("t1"), second["term"].alias("t2"), (second["off"] - first["off"]).alias("delta"), first["off"].alias("off1"))


def _candidates(index: Index, probes: DataFrame) -> DataFrame:
    """(row, wid, start): where both words of a phrase's probe stand as far apart as in the phrase."""
    pairs = stored(probes.select("t1", "t2", "delta").distinct().withColumn("pid", F.monotonically_increasing_id()), "probes")
    rare = index.postings.join(small(pairs.select(F.col("t1").alias("term"), "pid")), "term").select("row", "pid", "pos")
    moved = pairs.where("t1 <> t2 OR delta <> 0").select(F.col("t2").alias("term"), "pid", "delta")
    next_rare = index.postings.join(small(moved), "term").select("row", "pid", (F.col("pos") - F.col("delta")).alias("pos"))
    # A phrase of one word has nothing else to intersect.
    alone = rare.join(small(pairs.where("t1 = t2 AND delta = 0").select("pid")), "pid", "left_semi")
    both = rare.join(next_rare, ["row", "pid", "pos"], "left_semi").unionByName(alone)
    named = probes.join(pairs, ["t1", "t2", "delta"]).select("pid", "wid", "off1")
    return both.join(small(named), "pid").select("row", "wid", (F.col("pos") - F.col("off1")).alias("start"))


def matches(index: Index, asked: Phrases) -> DataFrame:
    """(row, wid, start, width): every exact occurrence of a phrase, by intersecting the lists of all its words."""
    parts = _parts(index, asked)
    found = stored(_candidates(index, _probes(parts)), "candidates")
    # The other words of a phrase, and where they must stand.
    rest = parts.select("wid", "width", F.slice("parts", 3, 1 << 20).alias("rest"))
    found = found.join(small(rest, rows=50_000), "wid")
    wanted = found.select("row", "wid", "start", "width", F.explode("rest").alias("p")).select(
        "row", "wid", "start", "width", F.col("p.term").alias("term"), (F.col("start") + F.col("p.off")).alias("pos"))
    lists = index.postings.join(small(found.select("row").distinct()), "row", "left_semi")
    # Phrases that overlap ask for the same postings; `have` is one row for each that exists.
    have = wanted.select("row", "term", "pos").distinct().join(lists, ["row", "term", "pos"], "left_semi")
    full = wanted.join(have, ["row", "term", "pos"]).groupBy("row", "wid", "start", "width").agg(F.count("*").alias("n"))
    full = full.where("n = width - 2").select("row", "wid", "start", "width")
    return stored(found.where(F.size("rest") == 0).select("row", "wid", "start", "width").unionAll(full), "matches")


def near_matches(index: Index, asked: Phrases, within: int = 20) -> DataFrame:
    """(row, wid, pos): proximity matches. All distinct words of the phrase stand, in any order, at most
    `within` words away from its rarest word at `pos`.

    Lists are intersected by row and stretches of `within` positions and their neighbours, the second
    rarest word first, so that the frequent words are only looked up beside what is left.
    """
    parts = _parts(index, asked)
    terms = parts.select("wid", F.array_distinct(F.transform("parts", lambda p: p["term"])).alias("terms"))
    terms = terms.select("wid", F.col("terms")[0].alias("t1"), F.slice("terms", 2, 1 << 20).alias("others"))
    stretch = F.expr(f"pos div {within + 1}")
    left = index.postings.join(small(terms.select("wid", F.col("t1").alias("term"), "others"), rows=50_000), "term")
    left = left.select("row", "wid", F.col("pos").alias("at"), "others")
    done = left.where(F.size("others") == 0).select("row", "wid", F.col("at").alias("pos"))

    def beside(rows: DataFrame, lists: DataFrame) -> DataFrame:
        """Rows (row, wid, at, term) that have a posting of the term at most `within` away."""
        spread = rows.withColumn("s", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.expr(f"at div {within + 1}") + d)))
        close = F.abs(F.col("at") - F.col("pos")) <= within
        hit = spread.join(lists.select("row", "term", "pos", stretch.alias("s")), ["row", "term", "s"]).where(close)
        return hit.select("row", "wid", "at", "term").distinct()

    second = left.where(F.size("others") > 0).withColumn("term", F.get("others", F.lit(0)))
    lists = index.postings.join(small(terms.where(F.size("others") > 0).select(F.get("others", F.lit(0)).alias("term")).distinct()), "term", "left_semi")
    some = stored(beside(second.select("row", "wid", "at", "term"), lists).drop("term"), "near-candidates")
    rest = some.join(small(terms.select("wid", F.slice("others", 2, 1 << 20).alias("rest")), rows=50_000), "wid")
    done = done.unionAll(rest.where(F.size("rest") == 0).select("row", "wid", F.col("at").alias("pos")))
    rest = rest.where(F.size("rest") > 0)
    lists = index.postings.join(small(some.select("row").distinct()), "row", "left_semi")
    found = beside(rest.select("row", "wid", "at", F.explode("rest").alias("term")), lists).groupBy("row", "wid", "at").agg(F.count("*").alias("n"))
    full = found.join(small(terms.select("wid", (F.size("others") - 1).alias("need"))), "wid").where("n = need")
    return done.unionAll(full.select("row", "wid", F.col("at").alias("pos")))


def digest(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per document: its words, those inside an occurrence of a phrase, and the items whose phrases occur."""
    asked = phrases(benchmark, width)
    index = build_index(docs, asked.vocabulary)
    found = matches(index, asked)
    places = found.select("row", F.explode(F.sequence("start", F.col("start") + F.col("width") - 1)).alias("pos")).distinct()
    hit = places.groupBy("row").agg(F.count("*").alias("n_hit"))
    # One list per document, no longer than the items there are: the digest is over all of them.
    items = found.select("row", "wid").distinct().join(small(asked.items), "wid").select("row", "item_id").distinct()
    items = items.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("ids"))
    rows = index.documents.join(hit, "row", "left").join(items, "row", "left")
    n_hit, n_items = (F.coalesce(c, F.lit(0)).cast("long") for c in ("n_hit", "n_items"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"),
                       F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
