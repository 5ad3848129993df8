"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line is a repeat if the same line, or one within MAX_EDITS edits (of lines with FUZZY_CHARS code points or more), occurs
earlier in the corpus, in order of document id and line number.  Repeats are removed; blank lines are not lines.

Edit join: a line is split into MAX_EDITS + 1 segments; two lines within MAX_EDITS edits share a segment at positions that
lie close together.  Every line enters an index of its segments by length and probes, for its own and slightly smaller
lengths, only those substrings that a multi-match-aware shift allows.  Pairs that meet are verified with a bit-parallel
edit distance in a band of 2 * MAX_EDITS + 2 rows, after their common ends are cut off.

A segment that many lines share (more than LONG_LIST) gives no pairs.  With one edit the difference of two lines that share
a segment lies in the rest, the hole; the hole is cut into HOLES smaller ones and the lines meet again by all that is outside
one of these, until lists are short or the hole is a single code point.  Lines that agree outside one code point are
within one edit of each other, so there the earliest of a list decides, without pairs: work grows with the lines of a list,
not with their square.  (With more than one edit long lists do give their pairs.)

Only hashes of lines and segments are shuffled; texts of lines are fetched for candidate pairs alone.  Copies of a line
merge before the join, so a very common line is one row of it.

A null text stays null, an empty text stays empty.  Rows with equal ids and texts are one document (all stay or lose the
same lines); a null id sorts first.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stash

MAX_EDITS = 1
FUZZY_CHARS = 10
#: Lists of at most so many lines give their pairs; holes that a longer list's hole is cut into.
LONG_LIST = 8
HOLES = 8
LINE = ["h1", "h2", "n"]


def segments(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """(start from 1, size) of each of edits + 1 segments of a line; the last ones take what does not divide."""
    parts = edits + 1
    base, more = F.floor(length / parts).cast("int"), F.pmod(length, F.lit(parts))
    out, at = [], F.lit(1)
    for i in range(parts):
        size = base + F.when(F.lit(i) >= F.lit(parts) - more, 1).otherwise(0)
        out.append((at, size))
        at = at + size
    return out


def signatures(line: Column, length: Column, edits: int) -> Column:
    """Array of (key, probe, part): index entries, which also stand for the equal probe, and the other probes, with the shared segment."""

    def entry(i: int, indexed: Column, start: Column, size: Column, probe: bool) -> Column:
        key = F.xxhash64(F.lit(i), indexed.cast("int"), F.substring(line, start, size))
        return F.struct(key.alias("key"), F.lit(probe).alias("probe"), F.lit(i).cast("byte").alias("part"))

    entries = [entry(i, length, start, size, False) for i, (start, size) in enumerate(segments(length, edits))]
    for less in range(edits + 1):
        indexed = length - less
        for i, (start, size) in enumerate(segments(indexed, edits)):
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                if less or shift:
                    at = start + shift
                    fits = (at >= 1) & (at + size - 1 <= length)
                    entries.append(F.when(fits, entry(i, indexed, at, size, True)))
    return F.array_distinct(F.array_compact(F.array(*entries)))


def shared_ends(a: Column, b: Column) -> Column:
    """Struct of before and after: how many code points two strings have in common at the front, and of the rest at the end.

    Both are found by halving steps, each a comparison of substrings.
    """
    least = F.least(F.char_length(a), F.char_length(b))
    steps = F.array(*(F.lit(1 << i) for i in range(30, -1, -1)))

    def front(have: Column, step: Column) -> Column:
        return F.when(have + step > least, have).when(F.substring(a, have + 1, step) == F.substring(b, have + 1, step), have + step).otherwise(have)

    def with_back(before: Column) -> Column:
        def back(have: Column, step: Column) -> Column:
            more = have + step
            same = F.substring(a, F.char_length(a) - more + 1, step) == F.substring(b, F.char_length(b) - more + 1, step)
            return F.when(before + more > least, have).when(same, more).otherwise(have)

        return F.struct(before.alias("before"), F.aggregate(steps, F.lit(0), back).alias("after"))

    return _let(F.aggregate(steps, F.lit(0), front), with_back)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings (code points) is at most edits; what they share at the ends changes nothing."""

    def rest(ends: Column) -> Column:
        x, y = (F.substring(s, ends["before"] + 1, F.char_length(s) - ends["before"] - ends["after"]) for s in (a, b))
        return _let(F.struct(x.alias("x"), y.alias("y")), lambda s: within_band(s["x"], s["y"], edits))

    near = F.abs(F.char_length(a) - F.char_length(b)) <= edits
    return F.when(near, _let(shared_ends(a, b), rest)).otherwise(False)


def within_band(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most edits, by bit-parallel columns in a band.

    Bit w - 1 of the vectors stands for the row that is edits below the diagonal; each column shifts the band by one row.
    The distance is followed down the band's lowest diagonal, then along the last row.  It never falls on the diagonal, and
    the last row is at most edits long, so beyond twice the edits nothing more is computed.
    """
    w = 2 * edits + 2
    full = (1 << w) - 1
    long, short = F.when(F.char_length(a) >= F.char_length(b), a).otherwise(b), F.when(F.char_length(a) >= F.char_length(b), b).otherwise(a)
    both = F.struct(F.split(long, "").alias("rows"), F.split(short, "").alias("columns"), F.char_length(long).alias("m"), F.char_length(short).alias("n"))

    def distance(x: Column) -> Column:
        rows, m, n = x["rows"], x["m"], x["n"]
        start = F.struct(F.lit(full & ~((1 << (w - edits - 1)) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(edits).cast("long").alias("d"), F.lit(0).alias("i"))

        def step(state: Column, char: Column) -> Column:
            vp, vn, i = state["vp"], state["vn"], state["i"]
            match = F.lit(0).cast("long")
            for b_ in range(w):
                match = match + F.when(F.coalesce(F.get(rows, i + (edits - w + 1 + b_)) == char, F.lit(False)), 1 << b_).otherwise(0)

            def columns(s: Column) -> Column:
                pm = s["pm"]
                d0 = (((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn)).bitwiseAND(F.lit(full))
                return F.struct(d0.alias("d0"), F.lit(full).bitwiseAND(vn.bitwiseOR(F.lit(full).bitwiseXOR(d0.bitwiseOR(vp).bitwiseAND(F.lit(full))))).alias("hp"), d0.bitwiseAND(vp).alias("hn"))

            def moved(s: Column) -> Column:
                d0, hp, hn = s["d0"], s["hp"], s["hn"]
                half = F.shiftright(d0, 1)
                last_row = i - (m - edits)  # columns past the one where the band reaches the last row
                at = F.lit(w - 2) - last_row
                along = _bit(hp, at) - _bit(hn, at)
                down = F.lit(1) - _bit(d0, F.lit(w - 1))
                d = state["d"] + F.when(last_row < 0, down).otherwise(along)
                return F.struct(hn.bitwiseOR(F.lit(full).bitwiseXOR(half.bitwiseOR(hp).bitwiseAND(F.lit(full)))).alias("vp"), half.bitwiseAND(hp).alias("vn"), d.alias("d"), (i + 1).alias("i"))

            return _let(_let(F.struct(match.alias("pm")), columns), moved)

        def guarded(state: Column, char: Column) -> Column:
            return F.when(state["d"] > 2 * edits, state).otherwise(step(state, char))

        return F.aggregate(F.when(n > 0, x["columns"]).otherwise(F.array().cast("array<string>")), start, guarded, lambda s: s["d"])

    # Strings of at most edits code points are within reach of each other; the band needs a longer one.
    return F.when(F.abs(F.char_length(a) - F.char_length(b)) > edits, False).otherwise(F.when(F.char_length(long) <= edits, True).otherwise(_let(both, distance) <= edits))


def _bit(x: Column, at: Column) -> Column:
    return F.pmod(F.floor(x / F.pow(F.lit(2.0), at)), F.lit(2)).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_rows(docs: DataFrame, id_col: str, text_col: str, edits: int) -> DataFrame:
    """A row for each line that is not blank: id, d (hash of id and text), pos, and the line's hashes and length."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("d"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    rows = rows.where(F.trim("line") != "")
    return rows.select("id", "d", "pos", "line", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), F.char_length("line").alias("n"))


def texts_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, firsts: DataFrame) -> DataFrame:
    """LINE, first (id, d, pos) and line (the text) of the wanted lines, each read where it stands first."""
    places = wanted.join(firsts, LINE).groupBy("first.id", "first.d").agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), *LINE, "first")).alias("lines"))
    places = places.withColumnsRenamed({"id": "_id", "d": "_d"})
    whole = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("d"), F.col(text_col).alias("text"))
    found = whole.join(places, F.col("d").eqNullSafe(F.col("_d")) & F.col("id").eqNullSafe(F.col("_id")))
    found = found.select(F.split("text", "\n", -1).alias("all"), F.explode("lines").alias("l"))
    return found.select("l.h1", "l.h2", "l.n", "l.first", F.get("all", F.col("l.pos")).alias("line")).dropDuplicates(LINE)


def lists_of(entries: DataFrame) -> DataFrame:
    """Entries of keys that an index entry shares with another, with m, the number of entries of the key."""
    sizes = entries.groupBy("key").agg(F.count("*").alias("m"), F.min("probe").alias("no_index")).where("m > 1 and not no_index")
    return entries.join(sizes.select("key", "m"), "key")


def pairs_of(lists: DataFrame) -> DataFrame:
    """Pairs of an index entry and another entry of the same key."""
    left, right = (lists.select("key", "probe", *LINE).withColumnsRenamed({c: f"{c}_{side}" for c in (*LINE, "probe")}) for side in ("a", "b"))
    met = left.join(right.where("not probe_b"), "key").where("(probe_a and n_a >= n_b or not probe_a and n_a = n_b and (h1_a, h2_a) < (h1_b, h2_b)) and not (h1_a = h1_b and h2_a = h2_b and n_a = n_b)")
    return met.select(*(f"{c}_{s}" for s in "ab" for c in LINE))


def first_holes(lists: DataFrame) -> DataFrame:
    """What one edit may touch in lines that share a half: probe, start and size of the other half (for a probe, in the longer line)."""
    indexed = F.col("n") - F.col("probe").cast("int")
    (_, head), (_, tail) = segments(indexed, 1)
    more = F.col("probe").cast("int")
    start = F.when(F.col("part") == 0, head + 1).otherwise(F.lit(1))
    return lists.select(*LINE, "probe", start.cast("int").alias("start"), (F.when(F.col("part") == 0, tail).otherwise(head) + more).cast("int").alias("size")).distinct()


def smaller_holes(holes: DataFrame) -> DataFrame:
    """Each hole cut into up to HOLES smaller ones, with the key of all that is outside."""
    more = F.col("probe").cast("int")
    room = F.col("size") - more
    parts = F.greatest(F.lit(1), F.least(F.lit(HOLES), room))
    at = lambda i: F.floor(room * i / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct((F.col("start") + at(i)).alias("start"), (at(i + 1) - at(i) + more).alias("size")))
    cuts = holes.select(*LINE, "first", "line", "probe", F.explode(cut).alias("hole")).select(*LINE, "first", "line", "probe", "hole.start", "hole.size")
    outside = F.xxhash64(F.col("n") - more, "start", F.col("size") - more, F.substring("line", F.lit(1), F.col("start") - 1), F.substring("line", F.col("start") + F.col("size"), F.col("n")))
    return cuts.withColumn("key", outside)


def late_in_long_lists(lists: DataFrame, texts: DataFrame, pairs: list[DataFrame]) -> DataFrame | None:
    """LINE of lines in long lists that an earlier line within one edit precedes; lists that become short add to pairs."""
    texts = stash(texts, "line-long-texts")
    holes, ends = stash(first_holes(lists), "line-holes"), []
    while not holes.isEmpty():
        cut = stash(smaller_holes(holes.join(texts, LINE)).withColumn("hole", F.substring("line", F.col("start"), F.col("size"))).withColumn("hole", F.when(F.char_length("hole") <= 2, F.col("hole"))).drop("line"), "line-cuts")
        narrow = F.col("size") - F.col("probe").cast("int") <= 1
        ends.append(cut.where(narrow))
        met = stash(lists_of(cut.where(~narrow)), "line-lists")
        pairs.append(pairs_of(met.where(F.col("m") <= LONG_LIST)))
        holes = stash(met.where(F.col("m") > LONG_LIST).select(*LINE, "probe", "start", "size").distinct(), "line-holes")
    if not ends:
        return None
    last = functools.reduce(DataFrame.union, ends)
    # Lines of one length that agree outside one code point: each is near all others.
    same = last.where("not probe").select(*LINE, "first", F.xxhash64("key", F.lit(0)).alias("gives"), F.xxhash64("key", F.lit(0)).alias("takes"))
    # A line and those that hold one code point more: the longer ones are near the line, not near each other.
    shorter = last.where("not probe").select(*LINE, "first", F.xxhash64("key", F.lit(1), "hole").alias("gives"), F.xxhash64("key", F.lit(2), "hole").alias("takes"))
    rests = F.when(F.col("size") == 1, F.array(F.lit(""))).otherwise(F.array_distinct(F.array(F.substring("hole", 1, 1), F.substring("hole", 2, 1))))
    longer = last.where("probe").withColumn("hole", F.explode(rests)).select(*LINE, "first", F.xxhash64("key", F.lit(2), "hole").alias("gives"), F.xxhash64("key", F.lit(1), "hole").alias("takes"))
    rows = stash(same.union(shorter).union(longer), "line-ends")
    least = rows.groupBy("gives").agg(F.min("first").alias("least")).withColumnRenamed("gives", "takes")
    return rows.join(least, "takes").where("least < first").select(*LINE).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = MAX_EDITS, fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """id, d, drops (numbers of the lines to remove) of each document that has repeats."""
    lines = line_rows(docs, id_col, text_col, edits)
    places = stash(lines.select("id", "d", "pos", *LINE), "line-places")
    firsts = stash(places.groupBy(*LINE).agg(F.min(F.struct("id", "d", "pos")).alias("first"), F.count("*").alias("copies")), "line-firsts")

    entries = lines.where(F.col("n") >= fuzzy_chars).select(*LINE, F.explode(signatures(F.col("line"), F.col("n"), edits)).alias("e")).select(*LINE, "e.key", "e.probe", "e.part").distinct()
    met = stash(lists_of(stash(entries, "line-segments")), "line-lists")
    short = F.col("m") <= LONG_LIST if edits == 1 else F.lit(True)
    pairs, late = [pairs_of(met.where(short))], None
    if edits == 1:
        long = stash(met.where(~short), "line-long-lists")
        if not long.isEmpty():
            late = late_in_long_lists(long, texts_of(docs, id_col, text_col, long.select(*LINE).distinct(), firsts), pairs)
    pairs = stash(functools.reduce(DataFrame.union, pairs).distinct(), "line-pairs")

    wanted = pairs.select(*(F.col(f"{c}_a").alias(c) for c in LINE)).union(pairs.select(*(F.col(f"{c}_b").alias(c) for c in LINE))).distinct()
    texts = stash(texts_of(docs, id_col, text_col, wanted, firsts), "line-texts")
    a, b = (texts.withColumnsRenamed({c: f"{c}_{side}" for c in texts.columns}) for side in ("a", "b"))
    near = pairs.join(a, [f"{c}_a" for c in LINE]).join(b, [f"{c}_b" for c in LINE]).where(within_edits(F.col("line_a"), F.col("line_b"), edits))
    later = F.when(F.col("first_a") < F.col("first_b"), F.struct(*(F.col(f"{c}_b").alias(c) for c in LINE))).otherwise(F.struct(*(F.col(f"{c}_a").alias(c) for c in LINE)))
    near = near.select(later.alias("l")).select("l.*")
    late = (near if late is None else near.union(late)).distinct().withColumn("late", F.lit(True))

    matter = firsts.join(late, LINE, "left").where("copies > 1 or late").select(*LINE, "first", F.coalesce("late", F.lit(False)).alias("late"))
    matter = stash(matter, "line-repeats")
    drops = places.join(matter, LINE).where("late or not (first.id <=> id and first.d = d and first.pos = pos)")
    return drops.groupBy("id", "d").agg(F.array_sort(F.collect_set("pos")).alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = MAX_EDITS) -> DataFrame:
    """docs with text without its repeats, __lines and __dropped (numbers of lines that are not blank, and of repeats)."""
    drops = repeated_lines(docs, id_col, text_col, edits).select(F.col("id").alias("__id"), F.col("d").alias("__d"), F.col("drops").alias("__drops"))
    keyed = docs.withColumn("__key", F.xxhash64(F.col(id_col), F.col(text_col)))
    joined = keyed.join(drops, F.col("__key").eqNullSafe(F.col("__d")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left")
    all_lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains(F.col("__drops"), i)), "\n")
    return (
        joined.withColumn("__lines", F.coalesce(F.size(F.filter(all_lines, lambda x: F.trim(x) != "")), F.lit(0)))
        .withColumn("__dropped", F.greatest(F.coalesce(F.size("__drops"), F.lit(0)), F.lit(0)))
        .withColumn(text_col, F.when(F.col("__drops").isNull(), F.col(text_col)).otherwise(kept))
        .drop("__id", "__d", "__drops", "__key")
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text of every document."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__dropped").cast("long").alias("n_dropped"), "text")


#: Lines within one edit share their first or their second half, so the halves are enough to find them.
REPORT_SQL = """
    WITH l AS (SELECT doc_id, hash(doc_id, text) AS d, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    p AS (SELECT * FROM l WHERE trim(line, ' ') <> ''),
    f AS (SELECT line, len(line) AS n, min((doc_id, d, pos)) AS first, len(line) // 2 AS h FROM p GROUP BY line),
    c AS (SELECT a.line AS x, a.n, a.first AS fx, b.line AS y, b.first AS fy FROM f a JOIN f b ON a.n = b.n AND left(a.line, a.h) = left(b.line, b.h) WHERE a.n >= 10 AND a.line < b.line
          UNION SELECT a.line, a.n, a.first, b.line, b.first FROM f a JOIN f b ON a.n = b.n AND a.line[a.h + 1:] = b.line[b.h + 1:] WHERE a.n >= 10 AND a.line < b.line
          UNION SELECT a.line, a.n, a.first, b.line, b.first FROM f a JOIN f b ON a.n = b.n + 1 AND left(a.line, b.h) = left(b.line, b.h) WHERE b.n >= 10
          UNION SELECT a.line, a.n, a.first, b.line, b.first FROM f a JOIN f b ON a.n = b.n + 1 AND a.line[b.h + 2:] = b.line[b.h + 1:] WHERE b.n >= 10),
    e AS (SELECT CASE WHEN fx < fy THEN y ELSE x END AS line FROM c
          WHERE CASE WHEN len(x) = len(y) THEN len(list_filter(range(1, n + 1), lambda i: x[i] <> y[i])) <= 1
                ELSE len(list_filter(range(1, n + 1), lambda i: left(x, i - 1) || x[i + 1:] = y)) > 0 END),
    m AS (SELECT p.*, p.line IN (SELECT line FROM e) OR (p.doc_id, p.d, p.pos) <> f.first AS again FROM p JOIN f USING (line)),
    r AS (SELECT doc_id, d, list(DISTINCT pos) FILTER (again) AS drops, count(DISTINCT pos) AS n_lines FROM m GROUP BY doc_id, d)
    SELECT t.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(len(drops), 0)::BIGINT AS n_dropped,
           CASE WHEN drops IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(drops, i)), chr(10)) END AS text
    FROM documents t LEFT JOIN r ON t.doc_id = r.doc_id AND hash(t.doc_id, text) = r.d
"""
