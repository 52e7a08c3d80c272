"""Removal of lines that repeat an earlier line, by an exact set-similarity join.

A line is the set of its words. It goes if an earlier line (by document id, then by place) has a
Jaccard similarity of ``THRESHOLD`` or more with it, whether that line itself stays or goes. Equal
lines are one from the start. Of the others, words are ordered by rarity. Of a similar pair, the longer
line shares a word of its probe prefix (its rarest words, as many as a similar line of any length may
lack, and one) with the index prefix of the shorter one, which need only allow for lines no shorter than
itself. Lines that meet under a word are compared if length, position and a parity sketch of the sets
(the bits in which two sketches differ are at most the words in which the sets do) allow the similarity;
the words of those that remain are compared in full. The sketch has 64 bits, from ``LONG`` words on 128 and
from ``LONGER`` on 512: a sketch says nothing about sets that may differ in half as many words as it has bits.

One earlier line is enough. Rows of a line and a word that meet no line which may be similar are left out first, by
a semi-join, which lists each of the others once, however many lines it meets. Of these a first pass compares each line
only with a few: of the first line under each word and the last ones before it (in a share of the word's lines), those
with the nearest sketches. Only lines that none of them is similar to are paired with all that they meet.
Groups of near copies thus cost about their size, and the second pass loses nothing. A
word under which more than ``POOL`` lines are listed (its rarity tells) is dealt to pools, and each pair of
pools meets by itself, so that no word's lines meet in one task.

Rarity is that of a word's bucket among ``BUCKETS``, counted over all texts: any fixed order is exact, and
the table of buckets has a fixed size, whatever the vocabulary's. Words are told apart by 64-bit hashes in the
filters (56 bits, and the rarity that another hash gives), and letter by letter in the comparison. Everything
is DataFrame expressions.

Defined results: null texts stay null; blank lines and empty texts stay as they are; a very long line or
text is one set or one row like any other; ids that are null (last) or repeated are told apart by the
order of the table as written; a text is rejoined by line feeds; an empty table gives an empty table;
extra columns pass through untouched, also those named like a column that is used on the way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.common import BLOOM, discard, internal, materialize

THRESHOLD = 0.8
BUCKETS = 1 << 18
#: Bits of a word's hash under its rarity in a key.
HASH_BITS = 56
#: Bits of a line's number for its place in the document, and for the document's.
PLACE_BITS = 27
MOST_ROWS = 1 << (62 - PLACE_BITS)
#: Lines under one word that the join looks at together.
POOL = 65536
#: Shares to which the lines under one word are dealt in the first pass, and lines before each that it looks at.
SHARES = 8
LAST = 2
#: Of the lines that the first pass finds for a line, so many are compared with it.
NEAREST = 3
#: Words from which a line has the second part of its sketch, and the third of ``WIDE`` times 64 bits.
LONG = 100
LONGER = 200
WIDE = 8
SKETCH = ("s", "t", "wide")


def split_words(line: Column) -> Column:
    """The words of a line, in order. Splitting at one fixed character is several times faster than at a
    pattern."""
    return F.array_remove(F.split(_one_space(line), " "), "")


def _one_space(line: Column) -> Column:
    """The line with each character of white space as a space."""
    return F.when(line.rlike(r"[\t\n\x0b\f\r]"), F.translate(line, "\t\n\x0b\f\r", "     ")).otherwise(line)


def words(line: Column) -> Column:
    return F.array_distinct(split_words(line))


def number_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number per row that follows doc_id: the id itself where ids are distinct and fit,
    else the place in the order of ids."""
    name = internal(docs, "row")
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    odd = ids.agg(F.max("n").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if odd["n"] is None or (odd["n"] == 1 and not odd["nulls"] and odd["low"] >= 0 and odd["high"] < MOST_ROWS):
        return docs.withColumn(name, F.col("doc_id")), name
    mark, part, first = internal(docs, "mark"), internal(docs, "part"), internal(docs, "first")
    table = materialize(docs.withColumn(mark, F.monotonically_increasing_id()), "rows")
    order = table.select("doc_id", mark).orderBy(F.col("doc_id").asc_nulls_last(), mark)
    order = materialize(order.select(mark, F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(name)), "row-order")
    sizes = order.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(F.col(part).alias(first + "p"), F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(first))
    placed = order.join(starts, F.col(part) == F.col(first + "p")).select(F.col(mark).alias(mark + "o"), (F.col(first) + F.col(name)).alias(name))
    return materialize(table.join(placed, F.col(mark) == F.col(mark + "o")).drop(mark, mark + "o"), "rows"), name


def lines_of(docs: DataFrame, row: str) -> DataFrame:
    """(row, place, line) of every line with a word."""
    # outer, and the null line left out after: Spark would filter on the size of an inner explode's
    # array below it, and split the text several times for that
    split = docs.select(F.col(row).alias("row"), F.split("text", "\n", -1).alias("ls"))
    return split.select("row", F.posexplode_outer("ls").alias("place", "line")).filter(has_word(F.col("line")))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def rarity(docs: DataFrame) -> Column:
    """The quarter-log counts of the word buckets, as a constant array of BUCKETS entries."""
    # empty words are counted like any other, which is cheaper than taking them out
    each = docs.select(F.split(_one_space(F.replace("text", F.lit("\n"), F.lit(" "))), " ").alias("ws")).select(F.explode_outer("ws").alias("w"))
    counts = each.groupBy(_bucket(F.col("w")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    tier = F.coalesce(F.least(F.floor(F.log2(F.col("n") + 1) * 4), F.lit(126)), F.lit(0))
    every = docs.sparkSession.range(BUCKETS).join(counts, F.col("id") == F.col("b"), "left").select(F.struct("id", tier.alias("tier")).alias("e"))
    text = every.agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e.tier.cast("string")), ",")).first()[0]  # a fixed size
    return F.split(F.lit(text), ",").cast("array<long>")


def _bucket(word: Column) -> Column:
    return F.hash(word).bitwiseAND(F.lit(BUCKETS - 1))


def keys(line: Column, tiers: Column) -> Column:
    """The line's distinct words as numbers in the order of rarity."""
    low = F.lit((1 << HASH_BITS) - 1)
    tier = lambda w: F.shiftleft(F.coalesce(F.get(tiers, _bucket(w)), F.lit(0).cast("long")), HASH_BITS)  # noqa: E731  never null, which makes sorting faster
    return F.sort_array(F.array_distinct(F.transform(split_words(line), lambda w: tier(w).bitwiseOR(F.xxhash64(w).bitwiseAND(low)))))


def _probe(n: Column, threshold: float) -> Column:
    """Length of the prefix that meets similar lines of any length."""
    return n - F.ceil(n * threshold - 1e-9).cast("int") + 1


def _parity(k: Column, one: Callable[[Column], Column]) -> Column:
    """The parities of the numbers' low six bits, of those numbers for which ``one`` is 1."""
    return F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", one(x), x.bitwiseAND(F.lit(63).cast("long")).cast("int"))))


def listed(distinct: DataFrame, tiers: Column, threshold: float) -> DataFrame:
    """Each distinct line (number, line, ...) with n, its sketch (s, t and wide), prefix, and the most pools
    of a word of the prefix, which are those of the last one."""
    ordered = distinct.withColumn("k", keys(F.col("line"), tiers))
    n, bits = F.size("k"), lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(WIDE - 1).cast("long"))
    half = F.when(n >= LONG, _parity(F.col("k"), lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(1).cast("long")))).otherwise(F.lit(0).cast("long"))
    wide = F.when(n >= LONGER, F.array(*[_parity(F.col("k"), lambda x, j=j: (bits(x) == j).cast("long")) for j in range(WIDE)]))
    made = ordered.select(*distinct.columns, n.alias("n"), _parity(F.col("k"), lambda x: F.lit(1).cast("long")).alias("s"), half.alias("t"), wide.alias("wide"), F.slice("k", F.lit(1), _probe(n, threshold)).alias("prefix"))
    return made.withColumns({"s": F.col("s").bitwiseXOR(F.col("t")), "pools": _pools(F.element_at("prefix", -1))})


def _need(n: Column, m: Column, threshold: float) -> Column:
    """Words that similar lines of ``n`` and ``m`` words share at least."""
    return F.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)


def sketches_allow(x: dict[str, Column], y: dict[str, Column], most: Column) -> Column:
    """Whether sets with these sketches may differ in ``most`` words at most."""
    differ = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    both = differ(x["s"], y["s"]) + differ(x["t"], y["t"])
    narrow = F.when(F.least(x["n"], y["n"]) >= LONG, both).otherwise(differ(x["s"].bitwiseXOR(x["t"]), y["s"].bitwiseXOR(y["t"])))
    apart = sum((differ(F.get(x["wide"], j), F.get(y["wide"], j)) for j in range(1, WIDE)), differ(F.get(x["wide"], 0), F.get(y["wide"], 0)))
    return (narrow <= most) & F.coalesce(apart <= most, F.lit(True))


def verified(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """The later lines (number) of a written table of ``pairs`` (later, earlier) that are similar. Few lines
    are in a pair: Spark may build a Bloom filter of a bounded size for them, by which the scan leaves out others."""
    text = lines.select("number", "line")
    told = pairs.filter("earlier >= 0 AND later >= 0")  # of all numbers; Spark builds no filter from a side without a condition
    ends = told.select(F.explode(F.array("later", "earlier")).alias("end")).distinct()
    few = text.join(ends, F.col("number") == F.col("end"), "left_semi")
    one = told.join(few.withColumnsRenamed({"number": "b", "line": "earlier_line"}), F.col("earlier") == F.col("b")).select("later", "earlier_line")
    two = one.join(few.withColumnsRenamed({"number": "a", "line": "later_line"}), F.col("later") == F.col("a"))
    # bound as the elements of one-element arrays, so that words are split and intersected once a pair
    sets = F.array(F.struct(words(F.col("later_line")).alias("x"), words(F.col("earlier_line")).alias("y")))
    sizes = lambda s: F.array(F.struct(F.size(F.array_intersect(s.x, s.y)).alias("both"), (F.size(s.x) + F.size(s.y)).alias("all")))
    similar = F.exists(sets, lambda s: F.exists(sizes(s), lambda z: z.both >= threshold * (z["all"] - z.both) - 1e-9))
    return two.filter(similar).select(F.col("later").alias("number")).distinct()


def _pools(key: Column) -> Column:
    """How many groups of about POOL the lines under a word are dealt to, by the word's rarity."""
    return F.ceil(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(key, HASH_BITS + 2).cast("int")) / POOL).cast("int")


def under_words(lines: DataFrame) -> DataFrame:
    """A row per line and word of its prefix: (key, number, place, s, t, wide), where the place packs n and at."""
    each = lines.select("number", "n", "pools", *SKETCH, F.posexplode_outer("prefix").alias("at", "key"))
    place = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("place")
    plain = each.filter("pools = 1").select("key", "number", place, *SKETCH)
    # lines with a word of several pools, which the parquet files' statistics mostly rule out
    dealt = each.filter("pools > 1").withColumn("pools", _pools(F.col("key"))).withColumn("pool", F.pmod(F.hash("number"), F.col("pools")))
    dealt = dealt.withColumn("others", F.sequence(F.lit(0), F.col("pools") - 1)).withColumn("other", F.explode_outer("others"))
    meet = F.when(F.col("pools") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("pool", "other"), F.greatest("pool", "other")))
    return plain.unionAll(dealt.select(meet.alias("key"), "number", place, *SKETCH))


def _side(of: str, threshold: float) -> list[Column]:
    """The columns of ``under_words`` unpacked, for one side of a join, with the fewest words of a similar line and
    the words from this one on."""
    n, at = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    made = {"key": F.col("key"), "number": F.col("number"), "place": F.col("place"), "n": n, "least": F.ceil(n * threshold - 1e-9).cast("int"), "rest": n - at} | {c: F.col(c) for c in SKETCH}
    return [c.alias(f"{of}_{k}") for k, c in made.items()]


def _allowed(a: Callable[[str], Column], b: Callable[[str], Column], threshold: float) -> Column:
    """Whether lines that share the words at their places can be similar. That as many words follow as they must
    share keeps the word of the shorter one to its index prefix."""
    need = _need(a("n"), b("n"), threshold)
    length = (b("n") >= a("least")) & (a("n") >= b("least"))
    position = (a("rest") >= need) & (b("rest") >= need)
    return length & position & sketches_allow({c: a(c) for c in ("n", *SKETCH)}, {c: b(c) for c in ("n", *SKETCH)}, a("n") + b("n") - 2 * need)


def partners(lines: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``under_words`` that meet another one which may be similar: each once, however many it meets.
    Both sides are one shuffle."""
    rows = under_words(lines).repartition("key")
    a, b = rows.select(*_side("a", threshold)), rows.select(*_side("b", threshold))
    meets = (F.col("a_key") == F.col("b_key")) & (F.col("a_number") != F.col("b_number")) & _allowed(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"), threshold)
    return a.join(b, meets, "left_semi").select(*[F.col(f"a_{c}").alias(c) for c in ("key", "number", "place", *SKETCH)])


def near_matches(met: DataFrame, threshold: float) -> DataFrame:
    """At most ``NEAREST`` pairs (later, earlier) of each line: of the first line under each word and the last ones before
    it of its share of the word's lines, that may be similar, those with the nearest sketches."""
    share = Window.partitionBy("a_key", F.pmod(F.hash("a_number"), F.lit(SHARES))).orderBy("a_number")
    one = F.struct(*[F.col(f"a_{c}").alias(c) for c in ("number", "n", "least", "rest", *SKETCH)])
    rows = met.select(*_side("a", threshold)).select("a_key", "a_number", one.alias("one"))
    heads = rows.groupBy(F.col("a_key").alias("k")).agg(F.min("one").alias("head"))
    rows = rows.join(heads, F.col("a_key") == F.col("k"))
    before = F.array("head", *[F.lag("one", k).over(share) for k in range(1, LAST + 1)])
    pairs = rows.withColumn("before", before).select("one", F.explode("before").alias("b"))
    a, b = (lambda c: F.col(f"one.{c}")), (lambda c: F.col(f"b.{c}"))
    found = pairs.filter((b("number") < a("number")) & _allowed(a, b, threshold))
    apart = F.bit_count(a("s").bitwiseXOR(b("s"))) + F.bit_count(a("t").bitwiseXOR(b("t")))
    tried = F.collect_set(F.struct(apart.alias("apart"), b("number").alias("earlier")))  # no more than LAST + 1 of each word of the line
    nearest = found.groupBy(a("number").alias("later")).agg(F.slice(F.sort_array(tried), 1, NEAREST).alias("nearest"))
    return nearest.select("later", F.explode("nearest.earlier").alias("earlier"))


def all_matches(met: DataFrame, done: DataFrame, threshold: float) -> DataFrame:
    """Pairs (later, earlier) of lines that may be similar, of which the later one isn't ``done``."""
    later = met.join(done.withColumnRenamed("number", "d"), F.col("number") == F.col("d"), "left_anti").select(*_side("a", threshold))
    earlier = met.select(*_side("b", threshold))
    meets = (F.col("a_key") == F.col("b_key")) & (F.col("b_number") < F.col("a_number")) & _allowed(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"), threshold)
    return later.join(earlier, meets).select(F.col("a_number").alias("later"), F.col("b_number").alias("earlier")).distinct()


def repeats(lines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The numbers of the lines of a written table (see ``listed``) to which an earlier line is similar."""
    met = materialize(partners(lines, threshold), "partners")
    near = materialize(near_matches(met, threshold), "near-pairs")
    done = materialize(verified(near, lines, threshold), "near-repeats", BLOOM)
    discard(near)
    rest = materialize(all_matches(met, done, threshold), "pairs")
    discard(met)
    more = materialize(verified(rest, lines, threshold), "more-repeats", BLOOM)
    discard(rest)
    return done.unionAll(more)


def _marks(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit("line"), line).alias("g")]


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, str, str]:
    """``docs`` with its text less repeated lines, and two more columns, whose names follow: the places of
    the lines removed (null if none), and how many lines with a word there were."""
    docs, row = number_rows(docs)
    gone, count = internal(docs, "removed"), internal(docs, "lines")
    number = F.shiftleft(F.col("row"), PLACE_BITS) + F.col("place")
    found = lines_of(docs, row)
    distinct = found.groupBy("line").agg(F.min(number).alias("number"), F.count(F.lit(1)).alias("times"))
    lines = materialize(listed(distinct, rarity(docs), threshold), "lines")
    again = repeats(lines, threshold).withColumnRenamed("number", "r")
    # what becomes of the lines that occur more than once or go: all others stay
    state = lines.select("number", "times", *_marks(F.col("line"))).join(again, F.col("number") == F.col("r"), "left").filter((F.col("times") > 1) | F.col("r").isNotNull())
    state = materialize(state.select(F.col("h").alias("sh"), F.col("g").alias("sg"), F.when(F.col("r").isNull(), F.col("number")).alias("stays")), "line-state")
    discard(lines)
    seen = found.select("row", "place", number.alias("number"), *_marks(F.col("line")))
    lost = seen.join(state, (F.col("h") == F.col("sh")) & (F.col("g") == F.col("sg"))).filter(F.col("stays").isNull() | (F.col("stays") != F.col("number")))
    places = materialize(lost.groupBy("row").agg(F.collect_list("place").alias(gone)).withColumnRenamed("row", gone + "r"), "lost-lines")
    discard(state)
    joined = docs.join(places, F.col(row) == F.col(gone + "r"), "left")
    all_ = F.split("text", "\n", -1)
    # the lines are bound as the element of an array, so that the text is split once, not once a line
    stay = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone))
    kept = F.get(F.transform(F.array(all_), lambda ls: F.array_join(F.transform(stay(ls), lambda i: F.get(ls, i)), "\n")), 0)
    return joined.select(
        *[F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept).alias("text") if c.lower() == "text" else F.col(c) for c in docs.columns if c != row],
        gone, F.coalesce(F.size(F.filter(all_, has_word)), F.lit(0)).alias(count)), gone, count


def without_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` less their repeated lines, ``n_chars`` (where there is one) to match; documents that had
    lines and lost all of them go."""
    out, gone, count = dedup_lines(docs, threshold)
    left = F.col(gone).isNull() | (F.size(gone) < F.col(count))
    chars = {c: F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length("text")).cast(docs.schema[c].dataType) for c in docs.columns if c == "n_chars"}
    return out.filter(left).withColumns(chars).select(*docs.columns)
