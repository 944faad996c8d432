"""Removing lines that nearly repeat an earlier line: an exact set-similarity join.

A line is the set of its words. Two lines with Jaccard similarity of at least the
threshold must share ``SHARED`` words among the rarest few of either (prefix
filter), be of similar size (length filter), and have each such word far enough forward
in both orders for the rest to suffice (positional filter); and the parities of their
hashed words differ in no more bits than their words may (a lower bound, so
nothing is lost). What passes is verified on all words. Lines of fewer than ``SMALL`` words
reach the threshold only with an equal set, which stands for a single prefix word.

For a line to go, one earlier match is enough. So first each of a line's ``TRIED`` rarest words
offers its earliest line of each of some sizes, and the nearest of these is verified:
one pair a line, which settles families of variants. Only lines that match none there
meet all earlier lines of all their prefix words; of words that very many lines have, they meet the lines
that have two of these in their prefix.

Everything is DataFrame operations. Which lines of a document are meant is an array of
booleans by line number, so texts of any number of lines are read in one pass.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wiresift.llm.common import documents, expand, free_names, stored, text_key

THRESHOLD = 0.8
SPACES = r"[\x20\x09-\x0D]+"
LAST = (1 << 63) - 1  # stands for a null id, so such rows come last
SHARED = 2  # how many prefix words a pair must share; prefixes are longer by this less one
SMALL = 4
TRIED = 5
BAND = 1.05
LOOSE = 0.75  # of the threshold: lines this near are taken to be of one family
HOT_LINES, HOT_SHARE = 20_000, 1e-5
PRIOR = 2  # how many of the words before its own a prefix row of a family's line carries
PARITIES = ("even", "odd")
SLOTS = 1 << 16  # of the table of rarities, a constant size
LINE = ("at", "no")  # the document's place in the order, and the line number from 0


def split_words(text: Column) -> Column:
    """The text's words, lower-cased, with empty ones among them. Line breaks and single spaces are found without a pattern."""
    line, other = F.replace(text, F.lit("\n"), F.lit(" ")), reduce(lambda x, y: x | y, [F.contains(text, F.lit(c)) for c in "\t\v\f\r"])
    return F.when(other, F.split(F.lower(text), SPACES)).otherwise(F.split(F.lower(line), " "))


def has_words(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\n\v\f\r")) != ""


def words(line: Column) -> Column:
    """The line's different words, lower-cased."""
    return F.array_remove(F.array_distinct(split_words(line)), "")


def rarities(docs: DataFrame) -> list[int]:
    """How common words are: a grade for each of ``SLOTS`` hashes.

    Counted over all words of all documents. A finer table would order words
    better; any order gives the same result.
    """
    each = docs.where(F.col("text").isNotNull()).select(F.explode(split_words(F.col("text"))).alias("word")).where("word != ''")
    slot = F.xxhash64("word").bitwiseAND(F.lit(SLOTS - 1).cast("long")).cast("int")
    grades = [0] * SLOTS
    for row in each.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect():
        grades[row["slot"]] = int(256 * math.log2(1 + row["n"]))
    return grades


def hashes(line: Column) -> Column:
    """The hashes of the line's different words. Numbers are told apart faster than strings."""
    return F.array_remove(F.array_distinct(F.transform(split_words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def ranked(found: Column, grades: list[int]) -> Column:
    """The words with these hashes as numbers whose order is rarest first; the lower 48 bits are the word's hash."""
    table = F.split(F.lit(",".join(map(str, grades))), ",").cast("array<int>")
    # without nulls as far as Spark knows, so that the numbers are sorted as primitives
    grade = lambda h: F.coalesce(F.get(table, h.bitwiseAND(F.lit(SLOTS - 1).cast("long")).cast("int")), F.lit(0)).cast("long")
    number = lambda h: F.shiftleft(grade(h), 48).bitwiseOR(h.bitwiseAND(F.lit((1 << 48) - 1)))
    return F.sort_array(F.transform(found, number))


def halfway(grades: list[int]) -> int:
    """The grade that parts the words, each as often as it was counted, into two halves."""
    counts = [(grade, 2 ** (grade / 256) - 1) for grade in sorted(grades)]
    left = sum(n for _, n in counts) / 2
    for grade, n in counts:
        left -= n
        if left <= 0:
            return grade
    return 0


def flags(nos: Column) -> Column:
    """Ascending line numbers as booleans: true at each of them, up to the last."""
    gap = lambda i: F.element_at(nos, i) - F.coalesce(F.try_element_at(nos, F.nullif(i - 1, F.lit(0))), F.lit(-1)) - 1
    runs = F.transform(F.sequence(F.lit(1), F.size(nos)), lambda i: F.concat(F.array_repeat(F.lit(False), gap(i)), F.array(F.lit(True))))
    return F.when(F.size(nos) > 0, F.flatten(runs)).otherwise(F.array().cast("array<boolean>"))


def flagged(marks: str, no: Column) -> Column:
    return F.coalesce(F.get(F.col(marks), no), F.lit(False))


def first_lines(docs: DataFrame) -> DataFrame:
    """Where each different line with words stands first: (at, doc, key, first), stored.

    ``at`` numbers the documents that have such lines by doc and key, with gaps;
    ``first`` flags the lines.
    """
    lines = docs.select("doc", "key", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(has_words(F.col("line")))
    digests = lines.select("doc", "key", "no", F.xxhash64("line").alias("high"), F.xxhash64(F.lit(1), "line").alias("low"))
    first = digests.groupBy("high", "low").agg(F.min(F.struct("doc", "key", "no")).alias("first")).select("first.*")
    listed = first.groupBy("doc", "key").agg(F.sort_array(F.collect_list("no")).alias("nos"))
    ordered = listed.repartitionByRange("doc", "key").sortWithinPartitions("doc", "key").withColumn("at", F.monotonically_increasing_id())
    return stored(ordered.select("at", "doc", "key", flags(F.col("nos")).alias("first")), "first-lines")


def lines_of(texts: DataFrame, wanted: DataFrame, marks: str) -> DataFrame:
    """The lines (at, no, line) that ``wanted`` (at, doc, key and the flags ``marks``) asks for."""
    chosen = texts.join(wanted, ["doc", "key"])
    numbered = F.transform(F.split("text", "\n"), lambda line, no: F.struct(no.alias("no"), line.alias("line")))
    asked = F.filter(numbered, lambda each: flagged(marks, each["no"]))
    return chosen.select("at", F.explode(asked).alias("each")).select("at", "each.no", "each.line")


def described(lines: DataFrame, grades: list[int], threshold: float) -> DataFrame:
    """A row for each line: at, no, size, 128 bits of parities, and ``prefix``, the numbers of its rarest words."""
    sized = lines.select(*LINE, ranked(hashes(F.col("line")), grades).alias("ids")).withColumn("size", F.size("ids"))
    length = F.least(F.col("size"), F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + SHARED).cast("int")
    # bits 0 to 5 of a number choose the bit; the words below ``middle`` make one half and the others the other
    middle = F.lit(halfway(grades) << 48)
    sized = sized.withColumn("cut", F.array_position(F.sort_array(F.concat("ids", F.array(middle))), middle).cast("int"))
    parity = lambda part: f"aggregate({part}, 0L, (bits, id) -> bits ^ shiftleft(1L, cast(id & 63L as int)))"
    even, odd = F.expr(parity("slice(ids, 1, cut - 1)")), F.expr(parity("slice(ids, cut, size)"))
    prefix = F.when(F.col("size") < SMALL, F.array(F.xxhash64("ids"))).otherwise(F.slice("ids", F.lit(1), length))
    return sized.select(*LINE, "size", even.alias("even"), odd.alias("odd"), prefix.alias("prefix"))


def prefixes(lines: DataFrame, upto: int | None = None) -> DataFrame:
    """A row for each prefix word of lines from ``described``, or the first few: word, at, no, size, place (from 0), parities, other columns.

    ``word`` is 32 bits of the word's hash, enough to meet by: words that share them add candidates and lose none.
    """
    rest = [c for c in lines.columns if c != "prefix"]
    chosen = F.col("prefix") if upto is None else F.slice("prefix", 1, upto)
    return lines.select(*rest, F.posexplode(chosen).alias("place", "word")).withColumn("word", F.hash("word"))


def apart(a: str, b: str) -> Column:
    """In how many words two lines differ at least, by their parities."""
    return sum(F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in PARITIES)


def near(a: str, b: str, threshold: float) -> Column:
    """Whether two prefix rows of one word may belong to lines at the threshold.

    The words they share come from this word on, but for ``SHARED`` less one at most before it; and they are no
    more than half of what the parities leave. The shorter this is, the likelier Java compiles the join's loop.
    """
    at = lambda side, name: F.col(f"{side}.{name}")
    total = at(a, "size") + at(b, "size")
    behind = F.least(at(a, "size") - at(a, "place"), at(b, "size") - at(b, "place"))
    room = behind + F.least(at(a, "place"), at(b, "place"), F.lit(SHARED - 1))
    least = total * F.lit(threshold / (1 + threshold)) - 1e-9
    return (least <= room) & (least <= (total - apart(a, b)) / 2)


def before(x: str, y: str) -> Column:
    at = lambda side: F.col(f"{side}.at")
    return (at(x) < at(y)) | ((at(x) == at(y)) & (F.col(f"{x}.no") < F.col(f"{y}.no")))


def order(side: str) -> Column:
    return F.struct(*[F.col(f"{side}.{c}") for c in LINE])


def dealt(rows: DataFrame) -> DataFrame:
    """The rows by word. The filter says what holds anyway; with it all uses are the same plan, and it is run once."""
    return rows.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in rows.columns])).repartition("word")


def offers(lines: DataFrame, threshold: float, loose: float) -> DataFrame:
    """(y, x, bits, may): earlier lines x that the rarest words of y offer and that may be at ``loose``, and whether they may be at the threshold."""
    few = dealt(prefixes(lines, TRIED))
    # sizes by steps of BAND, so that a word has few of them however many lines it has
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(BAND))
    heads = few.groupBy("word", band.alias("band")).agg(F.min(F.struct(*LINE, "size", "place", *PARITIES)).alias("p")).select("word", "p.*")
    met = few.alias("y").join(heads.alias("x"), (F.col("y.word") == F.col("x.word")) & before("x", "y") & near("y", "x", loose))
    return met.select(order("y").alias("y"), order("x").alias("x"), apart("y", "x").alias("bits"), near("y", "x", threshold).alias("may"))


def nearest(offered: DataFrame) -> DataFrame:
    """(y, x), the nearest of the offered lines that may be at the threshold."""
    best = offered.where("may").groupBy("y").agg(F.min(F.struct("bits", "x")).alias("best"))
    return best.select("y", "best.x")


def nearest_first(lines: DataFrame, threshold: float) -> DataFrame:
    """For lines to which one of their rarest words offers an earlier line that may be at the threshold: (y, x), the nearest of these."""
    return nearest(offers(lines, threshold, threshold))


def keyed_rows(lines: DataFrame) -> DataFrame:
    """The prefix rows of lines under the keys where they meet others: a word, or two hot words.

    Rows of lines marked ``family`` have in ``prior`` the last ``PRIOR`` words before their own, those that may be hot left
    out: all of them would make a line's rows grow with the square of its prefix.

    A word of more than ``HOT_LINES`` prefixes (and ``HOT_SHARE`` of all lines) is hot. Lines at the threshold
    share two prefix words: either one that is not hot, or two hot ones. Where no word is hot, one is enough, and they
    share that in prefixes shorter by one.
    """
    often = max(HOT_LINES, int(lines.count() * HOT_SHARE))
    # a word's grade is of a count that is no less than the lines it is in, so words below this one's are not hot
    grade = int(256 * math.log2(1 + often))
    none = F.array().cast("array<bigint>")
    family = F.when(F.col("family") & (F.col("size") >= SMALL), F.col("prefix")).otherwise(none) if "family" in lines.columns else none
    last = F.slice("all", F.greatest(F.col("place") + 1 - PRIOR, F.lit(1)), F.least(F.col("place"), F.lit(PRIOR)))
    # without nulls as far as Spark knows, or a later filter by them would work it out a second time
    cold = F.coalesce(F.when(F.size("all") > 0, F.filter(last, lambda w: F.shiftright(w, 48) < grade)), none)
    common = prefixes(lines.where(F.col("size") >= SMALL).withColumn("prefix", F.filter("prefix", lambda w: F.shiftright(w, 48) >= grade)))
    counts = common.groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
    # hot words are fewer than SIZE / HOT_SHARE for prefixes of SIZE words in the mean, however many lines there are
    hot = F.broadcast(stored(counts.where(F.col("_n") > often).select("word"), "hot-words"))
    plain = hot.isEmpty()
    if plain:
        lines = lines.withColumn("prefix", F.slice("prefix", F.lit(1), F.greatest(F.size("prefix") + 1 - SHARED, F.lit(1))))
    rows = prefixes(lines.withColumn("all", family).drop("family")).withColumn("prior", cold).drop("all")
    if plain:
        return rows
    single = rows.join(hot, "word", "left_anti")
    of_line = [c for c in lines.columns if c not in ("prefix", "family")]
    two = rows.join(hot, "word", "left_semi").groupBy(*of_line).agg(F.sort_array(F.collect_list(F.struct("word", "place"))).alias("h")).where(F.size("h") > 1)
    pairs = F.flatten(F.transform("h", lambda a, i: F.transform(F.slice("h", i + 2, F.size("h")), lambda b: F.struct(F.hash(a["word"], b["word"]).alias("word"), a["place"].alias("place")))))
    met = two.select(*of_line, F.explode(pairs).alias("pair")).select(*of_line, "pair.place", "pair.word", none.alias("prior"))
    return single.unionByName(met)


def banded(rows: DataFrame, threshold: float) -> DataFrame:
    """The rows with ``word`` now standing for a word and a band of sizes, and some again, marked ``up``, in the band above.

    A band is as wide as two times the largest difference in size, so lines at the threshold are in one band or two next to each other.
    Up go the rows whose words from here on (but for ``SHARED`` less one) suffice for the least size in the band above, which ``near``
    asks for as well: no pair is lost, and a word's lines do not meet those of very different size.
    """
    width = 2 * math.log(1 / threshold) + 1e-6
    size, place = F.col("size"), F.col("place")
    band = F.floor(F.log(size.cast("double")) / width).cast("int")
    least = (size + F.exp((F.col("band") + 1) * width)) * F.lit(threshold / (1 + threshold)) - 1e-6
    ups = F.when(least <= size - place + F.least(place, F.lit(SHARED - 1)), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    both = rows.withColumn("band", band).withColumn("up", F.explode(ups))
    return both.withColumn("word", F.hash("word", F.col("band") + F.col("up").cast("int"))).drop("band")


def packed(rows: DataFrame) -> DataFrame:
    """The rows with their small numbers in two long ones and nothing that may be null: less to shuffle.

    ``low`` has 16 bits of the place, 16 of the size, the flags and 30 bits of the line number, and ``high`` the other bits, zeros as a rule.
    """
    number = lambda name: F.coalesce(F.col(name).cast("long"), F.lit(0))
    bits = lambda name, n, to: F.shiftleft(number(name).bitwiseAND(F.lit((1 << n) - 1).cast("long")), to)
    above = lambda name, n, to: F.shiftleft(F.shiftright(number(name), n), to)
    either = lambda columns: reduce(lambda x, y: x.bitwiseOR(y), columns)
    low = either([bits("place", 16, 0), bits("size", 16, 16), bits("open", 1, 32), bits("up", 1, 33), bits("no", 30, 34)])
    high = either([above("place", 16, 0), above("size", 16, 16), above("no", 30, 32)])
    prior = F.coalesce("prior", F.array().cast("array<bigint>"))
    return rows.select(high.alias("high"), low.alias("low"), "word", *[number(c).alias(c) for c in (*PARITIES, "at")], prior.alias("prior"))


def unpacked(rows: DataFrame) -> DataFrame:
    part = lambda name, n, to: F.shiftrightunsigned(name, to).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    whole = lambda n, low, high: part("low", n, low).bitwiseOR(F.shiftleft(part("high", 16, high), n)).cast("int")
    numbers = whole(16, 16, 16).alias("size"), whole(16, 0, 0).alias("place"), whole(30, 34, 32).alias("no")
    return rows.select("word", "at", *numbers, *PARITIES, (part("low", 1, 32) != 0).alias("open"), (part("low", 1, 33) != 0).alias("up"), "prior")


def encounters(lines: DataFrame, threshold: float) -> DataFrame:
    """The pairs (y, x) of ``open`` lines and earlier lines that share prefix words and may be at the threshold, some of them repeated.

    Lines of families share many; with ``prior`` they do not meet again under a word that follows one they share. The first they
    share (or the second, if that is hot) follows none, so no pair is lost.
    """
    rows = unpacked(dealt(packed(banded(keyed_rows(lines), threshold))))
    # no ``at`` is negative; naming both sides keeps the condition in the join, as below it would make the two uses differ
    asks = F.col("y.open") | (F.col("x.open") & (F.col("x.at") < 0))
    both = rows.alias("y").join(rows.alias("x"), (F.col("y.word") == F.col("x.word")) & asks & before("x", "y") & ~(F.col("x.up") & F.col("y.up")) & near("y", "x", threshold) & ~F.arrays_overlap("y.prior", "x.prior"))
    return both.select(order("y").alias("y"), order("x").alias("x"))


def meeting(lines: DataFrame, threshold: float) -> DataFrame:
    """The same, each pair once."""
    return encounters(lines, threshold).distinct()


def similar(pairs: DataFrame, texts: DataFrame, first: DataFrame, threshold: float, keep: bool = False) -> DataFrame:
    """The later lines y of the pairs (y, x) whose words' Jaccard similarity is the threshold or more.

    With ``keep`` the lines' words are stored, for where each of their two uses would deal out all texts.
    """
    asked = pairs.select("y.*").union(pairs.select("x.*")).groupBy("at").agg(F.sort_array(F.collect_set("no")).alias("nos"))
    wanted = asked.select("at", flags(F.col("nos")).alias("asked")).join(first.select("at", "doc", "key"), "at")
    sets = lines_of(texts, wanted, "asked").select(F.struct(*LINE).alias("line"), hashes(F.col("line")).alias("ids"))
    sets = stored(sets, "line-sets") if keep else sets
    both = (
        pairs.join(sets.select(F.col("line").alias("y"), F.col("ids").alias("of_y")), "y")
        .join(sets.select(F.col("line").alias("x"), F.col("ids").alias("of_x")), "x")
    )
    shared = F.size(F.array_intersect("of_y", "of_x"))
    return both.where(shared >= threshold * (F.size("of_y") + F.size("of_x") - shared) - 1e-9).select("y").distinct()


def kept_lines(texts: DataFrame, grades: list[int], first: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, key, kept): flags of the lines with words that no earlier line matches.

    ``texts`` is from ``once``, ``first`` from ``first_lines``.
    """
    lines = stored(described(lines_of(texts, first, "first"), grades, threshold), "line-prefixes")
    offered = stored(offers(lines, threshold, threshold * LOOSE).groupBy("y", "x", "bits").agg(F.max("may").alias("may")), "line-offers")
    tried = stored(nearest(offered), "line-pairs")
    matched = stored(similar(tried, texts, first, threshold).select("y.*"), "matched-lines")
    near_others = offered.select("y.*").union(offered.select("x.*")).withColumn("_gone", F.lit(False))
    marks = near_others.union(matched.withColumn("_gone", F.lit(True))).groupBy(*LINE).agg(F.max("_gone").alias("_gone"))
    open_, family = ~F.coalesce(F.col("_gone"), F.lit(False)), F.col("_gone").isNotNull()
    # stored, so that the plan that follows reads it from there instead of dealing the lines out for each of its uses
    marked = stored(lines.join(marks, list(LINE), "left").withColumns({"open": open_, "family": family}).drop("_gone"), "line-prefixes")
    rest = stored(meeting(marked, threshold).join(tried, ["y", "x"], "left_anti"), "line-pairs")
    removed = matched.union(similar(rest, texts, first, threshold, keep=True).select("y.*"))
    gone = removed.groupBy("at").agg(F.sort_array(F.collect_set("no")).alias("nos")).select("at", flags(F.col("nos")).alias("gone"))
    left = F.zip_with("first", "gone", lambda f, g: f & ~F.coalesce(g, F.lit(False)))
    return first.join(gone, "at", "left").select("doc", "key", F.coalesce(left, F.col("first")).alias("kept"))


def once(own: DataFrame) -> DataFrame:
    """(doc, key, text), one row for rows repeated whole, dealt out by doc and key."""
    return own.groupBy("doc", "key").agg(F.first("text").alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("key", text_key())


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text, lines, removed_lines): documents without the lines that an earlier line matches.

    Earlier means a smaller doc_id (null last), then text key, then line number. A line
    goes whether or not the earlier line stays. Lines without words always
    stay, a null text stays null, and a text all of whose lines go is empty. Rows
    repeated whole keep the same lines. Other columns play no part. The threshold must be above 3/4.
    """
    own = keyed(docs.select("doc_id", "text")).select("doc", "key", "text")
    grades, first = rarities(own), first_lines(own)
    kept = kept_lines(once(own), grades, first, threshold)
    texts = own.groupBy("doc", "key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("_rows"))
    left = texts.join(kept, ["doc", "key"], "left").withColumn("left", lines_left("text", "kept"))
    counted = left.select(
        "doc", "_rows", F.array_join("left", "\n").alias("text"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("lines"), F.coalesce(F.size("left"), F.lit(0)).alias("_left")
    ).withColumn("removed_lines", F.col("lines") - F.col("_left"))
    return expand(counted, "_rows", "_row").select(
        F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "text", "lines", "removed_lines"
    )


def lines_left(text: str, kept: str) -> Column:
    """The lines of a text that have no words or are flagged to be kept."""
    return F.filter(F.split(text, "\n"), lambda line, no: flagged(kept, no) | ~has_words(line))


def documents_without_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with the columns they came with, whatever their names, and the text that ``dedup_lines`` leaves."""
    own = keyed(docs.select("doc_id", "text")).select("doc", "key", "text")
    kept = stored(kept_lines(once(own), rarities(own), first_lines(own), threshold), "kept-lines")
    doc, key, marks = free_names(docs, "doc", "key", "kept")
    whole = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), key: text_key()})
    joined = whole.join(kept.select(F.col("doc").alias(doc), F.col("key").alias(key), F.col("kept").alias(marks)), [doc, key], "left")
    return joined.withColumn("text", F.array_join(lines_left("text", marks), "\n")).select(*docs.columns)


def op4_prefix_line_dedup(spark, sf_dir) -> DataFrame:
    """Every document with its text after lines that nearly repeat an earlier one are cut."""
    return dedup_lines(documents(spark, sf_dir))
