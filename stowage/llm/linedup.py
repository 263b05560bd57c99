"""Repeated lines by an exact set-similarity join, in DataFrame operations only.

Lines with the same words form one class, whose first line stands for it.  Each has signatures, of
which two lines that reach the threshold share one.  At high thresholds these are parts of the set:
hashes of words are dealt into more parts than the sets can differ in words, so one part is equal.
At others the words are ordered by rarity, and the lines share a word of their prefixes.  Pairs
that meet there pass the length, position and bit-vector filters, are verified on their whole word
sets, and the later line of a pair goes.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import dense, marked, pick, unpack_rows, whole_rows
from stowage.operators.scratch import drop, save, save_step

#: Percent of shared words from which the later of two lines goes.
PERCENT = 90
#: Words are counted in this many hashed buckets (a power of two); it only decides on the order of words.
COUNTERS = 1 << 18
#: Lines of a signature that every other line of it is compared with before all the rest.
FIRST = 16
#: Parts of the words of the prefixes that are looked at in one go: a sample first, all others, and all again in halves.
SAMPLE, OTHERS, HALVES = (0,), (1, 2, 3), ((0, 1), (2, 3))
#: Lines of a word of the prefixes that every other line of it is compared with before all the rest.
FEW = 4
#: Words of a set from which lines meet by 128 and by 256 bits instead of 64, which long sets fill.
MORE_BITS = (48, 192)
#: Words of 64 bits that are compared before word sets are.
WIDE = 4
#: Percent from which lines meet by equal parts; below, parts hold too few words to tell lines apart.
PARTS_FROM = 85
#: Sizes of sets that differ by less than this factor are cut into the same number of parts.
RATIO = 1.5
#: Words of a set up to which places in it are looked for one by one.
SHORT = 256

_NO_ID = (1 << 63) - 1
_HASH_BITS = 57


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, h, pos, line): every line of every text, with spaces for other white space."""
    text = F.col("text")
    for space in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    # most texts have none of these, which one look tells
    text = F.when(F.col("text").rlike(r"[\t\x0B\f\r]"), text).otherwise(F.col("text"))
    return docs.select("doc", "h", F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def _words() -> Column:
    """The words of ``line``, lower-cased; none of a blank line."""
    return F.array_remove(F.split(F.lower("line"), " "), "")


def _ranks(docs: DataFrame) -> DataFrame:
    """How frequent words are, by hashed counters, as one array of fixed size."""
    word = F.explode(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")).alias("word")
    place = F.pmod(F.xxhash64("word"), F.lit(COUNTERS)).alias("at")
    counted = docs.select(word).groupBy(place).count()
    rank = F.least(F.floor(F.log2(F.col("count").cast("double")) * 2), F.lit(63)).alias("value")
    return dense(docs.sparkSession, counted.select("at", rank), COUNTERS, "int")


def _with_prefixes(docs: DataFrame, percent: int) -> DataFrame:
    """Lines with ``words``, their distinct words as numbers, and ``signs``, the words of the prefix."""
    name = f"_stowage_ranks_{uuid.uuid4().hex[:8]}"
    save(_ranks(docs), "ranks").createOrReplaceTempView(name)
    # distinct words ordered by rarity, then by hash: a word keeps its rank and 57 bits of its hash
    # (coalesce tells Spark that no value is null, so that it sorts plain longs)
    hashes = F.array_distinct(F.transform(_words(), lambda w: F.xxhash64(w)))
    spread = _lines(docs).withColumn("hashes", hashes)
    spread = spread.withColumn("ranks", F.expr(f"(select first(all) from {name})"))
    ordered = F.expr(
        "sort_array(array_distinct(transform(hashes, x ->"
        f" coalesce(get(ranks, cast(x & {COUNTERS - 1} as int)) * {1 << _HASH_BITS}L, 0L)"
        f" | shiftrightunsigned(x, {64 - _HASH_BITS}))))"
    )
    spread = spread.withColumn("words", ordered).withColumn("n", F.size("words"))
    kept = F.expr(f"n - (n * {percent} + 99) div 100 + 1").cast("int")
    # 32 bits of a word's hash: lines that meet by equal ones of unlike words are no more than candidates
    narrow = F.expr(f"transform(prefix, w -> cast((w & {(1 << 32) - 1}L) - {1 << 31}L as int))")
    return spread.withColumn("prefix", F.slice("words", F.lit(1), kept)).withColumn("signs", narrow)


def _hashed(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 2)


def _with_parts(docs: DataFrame, percent: int) -> DataFrame:
    """Lines with ``words``, their distinct words as numbers, and ``signs``, hashes of the parts of this set.

    Sizes fall into classes.  Two lines meet in the class of the smaller one, so a line is cut for its own
    class and for that of the smallest line that can be like it.  There, sets of a and b words that reach
    the threshold differ in at most (100 - percent) * (a + b) / (100 + percent) words, and with one part
    more than that for the largest a and b a part holds none of them.  An empty part is a part as well.
    """
    hashes = F.transform(F.split(F.lower("line"), " "), lambda w: _hashed(w))
    words = F.array_remove(F.array_distinct(hashes), _hashed(F.lit("")))
    spread = _lines(docs).withColumn("words", F.sort_array(words)).withColumn("n", F.size("words"))
    size_class = f"cast(floor(ln({{}}) / ln({RATIO}D)) as int)"
    own, least = size_class.format("n"), size_class.format(f"(n * {percent}L + 99) div 100")
    spread = spread.withColumn("classes", F.expr(f"if(n > 0, array_distinct(array({least}, {own})), array())"))
    # the largest smaller set, the most words that differ from it, the number of parts
    most = f"cast(ceil(power({RATIO}D, c + 1)) as bigint)"
    differ = f"({100 - percent} * ({most} + {most} * 100 div {percent})) div {100 + percent}"
    cuts = f"transform(classes, c -> struct(c as c, {differ} + 1 as parts))"
    cuts = f"transform({cuts}, x -> struct(x.c as c, x.parts as parts, {1 << 62}L div x.parts + 1 as width))"
    # the part of every word, then the places where the parts that hold words begin; slices of a
    # transformed array don't copy all of it
    held = "transform(words, w -> w) as plain, transform(words, w -> w div x.width) as held"
    cuts = f"transform({cuts}, x -> struct(x.c as c, x.parts as parts, {held}))"
    few = "transform(array_distinct(x.held), p -> cast(array_position(x.held, p) as int) - 1)"
    many = "filter(sequence(0, n - 1), i -> i = 0 or get(x.held, i) > get(x.held, i - 1))"
    begins = f"if(n <= {SHORT}, {few}, {many}) as begins"
    cuts = f"transform({cuts}, x -> struct(x.c as c, x.parts as parts, x.plain as plain, x.held as held, {begins}))"
    full = (
        "transform(x.begins, (i, k) -> xxhash64(x.c, get(x.held, i),"
        " slice(x.plain, i + 1, coalesce(get(x.begins, k + 1), n) - i)))"
    )
    none = "transform(array_except(sequence(0L, x.parts - 1), x.held), j -> xxhash64(x.c, j))"
    return spread.withColumn("signs", F.expr(f"flatten(transform({cuts}, x -> concat({full}, {none})))"))


def kept_lines(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All lines (doc, h, pos, n) of (doc, h, text), and those with words that stay (doc, h, pos)."""
    by_parts = percent >= PARTS_FROM
    spread = _with_parts(docs, percent) if by_parts else _with_prefixes(docs, percent)
    # bits that an odd number of words have, so that long lines don't fill them
    bits = F.aggregate("words", F.lit(0).cast("long"), lambda held, w: held.bitwiseXOR(_bit(w)))
    held = {"bits": bits} | ({} if by_parts else _more_bits())
    order = ["doc", "h", "pos"]
    known = save(
        spread.select(
            *order,
            "n",
            F.xxhash64("words").alias("id1"),
            F.xxhash64(F.lit(1), "words").alias("id2"),
            "signs",
            *[column.alias(name) for name, column in held.items()],
        ),
        "lines",
    )

    # one line for each set of words, numbered in the order of lines
    first = F.min(F.struct(*order, "n", *held, "signs")).alias("f")
    firsts = known.filter("n > 0").groupBy("id1", "id2").agg(first).select("f.*")
    firsts = firsts.repartitionByRange(*order).sortWithinPartitions(*order)
    firsts = save(firsts.withColumn("oid", F.monotonically_increasing_id()), "firsts")
    similar = save((_like_by_parts if by_parts else _like_by_prefixes)(docs, firsts, percent), "similar")
    return known.select(*order, "n"), firsts.join(similar, "oid", "left_anti").select(*order)


def _like_by_parts(docs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """(oid): lines that an earlier one is like, found among lines with an equal part."""
    post = firsts.select("oid", "n", "bits", F.explode("signs").alias("sign"))
    places = Window.partitionBy("sign").orderBy("oid")
    ranked = post.withColumn("rank", F.row_number().over(places)).withColumn("behind", F.col("n"))
    # few lines share a part with any other
    ranked = ranked.withColumn("next", F.lead("oid").over(places)).filter("rank > 1 or next is not null")
    ranked = save(ranked.drop("next"), "shared")

    # every line meets the first lines of its signatures; what they don't settle meets the others.  One
    # job makes the pairs and sets the others aside, and all its parts start from the same ranked
    # postings (``least`` and ``rank >= 1`` see to that), so that these are shuffled once.
    early = F.least("rank", F.lit(FIRST + 1)) <= FIRST
    near = _meet(ranked.filter(early), ranked.filter("rank >= 1"), percent)
    deep = ranked.filter(~early).drop("rank")
    met = save(near.unionByName(deep, allowMissingColumns=True), "met")
    near = save(met.filter("a is not null").select("a", "b").distinct(), "pairs")
    deep = met.filter("oid is not null").select("sign", "oid", "bits", "n", "behind")
    gone = save(_alike(near, _sets(docs, near, firsts), percent), "gone")
    rest = _meet(deep, deep.join(gone, "oid", "left_anti"), percent)
    rest = save(rest.distinct(), "pairs")
    return gone.union(_alike(rest, _sets(docs, rest, firsts), percent))


def _like_by_prefixes(docs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """(oid): lines that an earlier one is like, found among lines with a word of the prefix in common.

    Every line meets the first lines of its words, by a part of the words and then by the others, which settles
    copies: a line of a group of any size meets few of it.  What is not settled then meets the other lines of
    its words.  Postings are shuffled for one part of the words at a time.
    """
    places = Window.partitionBy("sign").orderBy("oid")
    early = F.least("rank", F.lit(FEW + 1)) <= FEW
    held = ["n", "bits", *_more_bits()]

    def alike(gone: DataFrame | None, firsts_of_words: bool, *rounds: tuple[int, ...]) -> DataFrame:
        met = []
        for parts in rounds:
            numbers = ", ".join(map(str, parts))
            own = F.expr(f"filter(transform(signs, (sign, i) -> struct(i, sign)), s -> s.sign & 3 in ({numbers}))")
            post = firsts.select("oid", *held, own.alias("own")).filter(F.size("own") > 0)
            if gone is not None:
                # a settled line has a negative number of words, which does not change how its postings are dealt
                post = post.join(gone.withColumn("gone", F.lit(True)), "oid", "left")
                post = post.withColumn("n", F.when(F.col("gone"), -F.col("n")).otherwise(F.col("n")))
            post = post.select("oid", *held, F.inline("own"))
            post = post.select("sign", "oid", *held, (F.abs("n") - F.col("i")).alias("behind"))
            post = post.withColumn("rank", F.row_number().over(places)).filter("rank >= 1")
            pairs = _meet(post.filter(early if firsts_of_words else ~early), post.filter("n > 0"), percent)
            met.append(save(pairs.distinct(), "met_in_round"))
        found = _alike_closest(docs, reduce(DataFrame.union, met), firsts, percent)
        for table in met:
            drop(table)
        return found

    gone = alike(None, True, SAMPLE)
    gone = gone.union(alike(gone, True, OTHERS))
    return gone.union(alike(gone, False, *HALVES))


def _meet(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a before b, that share a signature and pass the filters."""
    sides = []
    more = [c for c in left.columns if c in _more_bits()]
    for side, rows in (("a", left), ("b", right)):
        sides.append(
            rows.select(
                "sign",
                F.col("oid").alias(side),
                *[F.col(c).alias(f"{side}_{c}") for c in ("bits", *more)],
                F.abs("n").cast("long").alias(f"{side}_n"),
                F.col("behind").cast("long").alias(f"{side}_rest"),
            )
        )
    both = F.col("a_n") + F.col("b_n")
    differ = _differ(bool(more))
    # an overlap o reaches the threshold if (100 + percent) * o >= percent * (a_n + b_n)
    met = (
        sides[0]
        .join(sides[1], "sign")
        .filter(
            (F.col("a") < F.col("b"))
            & (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
            & (F.least("a_rest", "b_rest") * (100 + percent) >= both * percent)
            & ((both - differ) * (100 + percent) >= both * percent * 2)
        )
    )
    return met.select("a", "b")


def _more_bits() -> dict[str, Column]:
    """Bits as ``bits`` has them, of a half and of two quarters of the words (by hash); 0 for sets too small for them."""

    def of(mask: int, value: int, least: int) -> Column:
        own = F.filter("words", lambda w: w.bitwiseAND(F.lit(mask)) == value)
        odd = F.aggregate(own, F.lit(0).cast("long"), lambda held, w: held.bitwiseXOR(_bit(w)))
        return F.when(F.col("n") >= least, odd).otherwise(F.lit(0).cast("long"))

    two, four = MORE_BITS
    return {"half": of(64, 64, two), "second": of(192, 64, four), "third": of(192, 128, four)}


def _differ(more: bool) -> Column:
    """The least number of words that two lines of ``_meet`` differ in, by all bits that both have."""

    def other(name: str) -> Column:
        return F.col(f"a_{name}").bitwiseXOR(F.col(f"b_{name}"))

    one = F.bit_count(other("bits"))
    if not more:
        return one
    # what is left of the whole is the other half, of the halves the other quarters
    rest = other("bits").bitwiseXOR(other("half"))
    halves = F.bit_count(other("half")) + F.bit_count(rest)
    quarters = [other("second"), other("second").bitwiseXOR(other("half")), other("third"), other("third").bitwiseXOR(rest)]
    least, (two, four) = F.least("a_n", "b_n"), MORE_BITS
    return F.when(least < two, one).when(least < four, halves).otherwise(sum(map(F.bit_count, quarters)))


def _alike_closest(docs: DataFrame, met: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """As ``_alike``; more bits drop most pairs, and a line is compared with the nearest one, then with others."""
    pairs = save(met.distinct(), "pairs")
    sets = _sets(docs, pairs, firsts)
    wide = sets.select("oid", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    wide = save(wide.select("oid", "n", F.array(*[_odd(k) for k in range(WIDE)]).alias("bits")), "bits")
    near = pairs
    for side in ("a", "b"):
        near = near.join(wide.toDF(side, f"{side}_n", f"{side}_bits"), side)
    differ = sum(F.bit_count(F.get("a_bits", F.lit(k)).bitwiseXOR(F.get("b_bits", F.lit(k)))) for k in range(WIDE))
    near = near.select("a", "b", differ.alias("differ"), (F.col("a_n") + F.col("b_n")).alias("both"))
    near = save(near.filter((F.col("both") - F.col("differ")) * (100 + percent) >= F.col("both") * (percent * 2)), "near")
    closest = save(near.groupBy("b").agg(F.min(F.struct("differ", "a")).alias("best")).select("best.a", "b"), "closest")
    settled = save(_alike(closest, sets, percent), "settled")
    others = near.select("a", "b").join(settled.toDF("b"), "b", "left_anti").join(closest, ["a", "b"], "left_anti")
    found = save(settled.union(_alike(others, sets, percent)), "gone")
    for table in (pairs, sets, wide, near, closest, settled):
        drop(table)
    return found


def _odd(k: int) -> Column:
    """Bits that an odd number of those hashes in ``words`` have which fall to the ``k``-th of ``WIDE`` parts."""
    own = F.filter("words", lambda w: F.shiftrightunsigned(w, 6) % WIDE == k)
    return F.aggregate(own, F.lit(0).cast("long"), lambda held, w: held.bitwiseXOR(_bit(w)))


def _sets(docs: DataFrame, pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(oid, words): the whole word sets of the lines of the pairs."""
    wanted = pairs.select(F.col("a").alias("oid")).union(pairs.select("b")).distinct()
    wanted = save(firsts.join(wanted, "oid").select("oid", "doc", "h", "pos"), "wanted")
    # a bit for every document and line that is needed keeps most others from being parted and joined
    keys = ["doc", "h", "pos"]
    bit_set = marked(wanted.select(F.xxhash64("doc").alias("hash")).union(wanted.select(F.xxhash64("doc", "pos"))))
    lines = _lines(docs.filter(bit_set("xxhash64(doc)"))).filter(bit_set("xxhash64(doc, pos)"))
    lines = lines.select(*keys, F.array_distinct(_words()).alias("words"))
    full = lines.join(wanted, keys).dropDuplicates(keys)
    return save(full.select("oid", "words"), "sets")


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(oid): the later lines of the pairs whose whole word sets reach the threshold."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.toDF(side, f"{side}_words"), side)
    overlap = F.size(F.array_intersect("a_words", "b_words"))
    same = overlap * (100 + percent) >= (F.size("a_words") + F.size("b_words")) * percent
    return pairs.filter(same).select(F.col("b").alias("oid")).distinct()


def _bit(word: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), word.bitwiseAND(F.lit(63)).cast("int"))


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, h, text): a document is known by its id and the hash of its text."""
    docs = pick(docs, key, text).toDF("doc_id", "text")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"),
        "text",
    )


def line_decisions(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One row per line: key, line_no from 0, n_words (distinct), kept.

    Lines end at a line feed; words are lower-cased and parted by ASCII white space.  A line goes if an
    earlier one, in order of ``key`` and line number, has a Jaccard similarity of at least
    ``percent`` to it on their sets of words, whether or not that one goes as well.  Lines without
    words stay.  A null text has no lines, an empty one has one.  Rows without a key come last and
    share the key 2**63 - 1; a repeated row (same key and text) is one document and gets its
    decisions as often as it occurs.  Of two texts with one key that with the smaller hash is the
    earlier.  Texts and lines may have any length; an empty table gives no rows; other columns
    are not looked at.
    """
    known, kept = kept_lines(_identified(docs, key, text), percent)
    found = known.join(kept.withColumn("_kept", F.lit(True)), ["doc", "h", "pos"], "left")
    return found.select(
        F.when(F.col("doc") != _NO_ID, F.col("doc")).alias(key),
        F.col("pos").alias("line_no"),
        F.col("n").alias("n_words"),
        ((F.col("n") == 0) | F.col("_kept").isNotNull()).alias("kept"),
    )


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """``docs`` without the lines that ``line_decisions`` removes, all columns as they were.

    A document that had words and loses every line with words goes; others stay, also null and
    empty texts.
    """
    identified = _identified(docs, key, text)

    def removed() -> DataFrame:
        known, kept = kept_lines(identified, percent)
        lines = known.filter("n > 0").join(kept, ["doc", "h", "pos"], "left_anti").drop("n").distinct()
        return lines.groupBy("doc", "h").agg(F.collect_list("pos").alias("_gone"))

    gone = save_step(docs.sparkSession, removed, "removed")
    bit_set = marked(gone.select(F.xxhash64("doc", "h").alias("hash")))
    rows = whole_rows(docs, key, text)
    rows = rows.select(
        F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"),
        "_row",
    )
    at = f"_c{docs.columns.index(text)}"
    # documents that lose no line mostly stay where they are
    held = bit_set("xxhash64(doc, h)")
    whole = rows.filter(~held).withColumn("_gone", F.lit(None).cast("array<int>"))
    rows = rows.filter(held).join(gone, ["doc", "h"], "left").unionByName(whole)
    kept = F.expr(
        f"filter(split(_row.{at}, '\\n'), (line, i) -> not array_contains(_gone, i))"
    )
    rows = rows.withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept))
    has_words = F.exists("_kept", lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.filter(F.col("_gone").isNull() | has_words)
    text_now = F.when(F.col("_gone").isNull(), F.col("_row")[at]).otherwise(F.array_join("_kept", "\n"))
    return unpack_rows(rows.withColumn("_row", F.col("_row").withField(at, text_now)), docs.columns)
