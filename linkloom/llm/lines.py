"""Repeated lines: equal ones by hash, near-equal ones by a segment-partition edit join. Row functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import computed_once
from ..session import stage

#: Edits (insert, delete, replace one code point) up to which two lines count as one.
MAX_EDITS = 2
#: Shorter lines are only compared for equality: a few edits make one short line into another.
MIN_CHARS = 20
#: Characters whose counts must nearly agree before two lines are compared; any sixteen frequent ones do.
COUNTED = "entaiorsdlhcu.gb"
#: Line ids or places up to this number (some 60 MB) are broadcast after a count; more are joined by a shuffle.
BROADCAST_LINES = 1_000_000
BLANK = " \t\r"
#: Columns that line dedup adds.
ADDED = ("n_lines", "n_equal", "n_near", "n_links")


def split_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def form(line: Column) -> Column:
    """What of a line is compared: all but blanks at its ends."""
    return F.btrim(line, F.lit(BLANK))


def segments(length: Column, parts: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of ``parts`` runs that cover a line; later ones take the remainder."""
    base, rest = F.floor(length / parts), length % parts
    found, start = [], F.lit(1)
    for i in range(parts):
        size = (base + F.when(F.lit(parts - i) <= rest, 1).otherwise(0)).cast("int")
        found.append((start, size))
        start = (start + size).cast("int")
    return found


def index_keys(line: str, length: str, edits: int) -> Column:
    """One key for each segment of a line: its number, the line's length and the segment itself."""
    own = F.col(length)
    return F.array(*[F.xxhash64(F.lit(i), own, F.substr(F.col(line), s, n)) for i, (s, n) in enumerate(segments(own, edits + 1))])


def probe_keys(line: str, length: str, edits: int) -> Column:
    """Keys under which a line meets every line that is at most ``edits`` away and not longer.

    Such a line keeps at least one of its segments, in a place that its number and the difference in length
    narrow down: before segment i at most i edits, behind it at most ``edits`` - i (with i from 0).
    """
    keys = []
    for shorter in range(edits + 1):
        other = (F.col(length) - shorter).cast("int")
        for i, (start, size) in enumerate(segments(other, edits + 1)):
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            keys += [F.xxhash64(F.lit(i), other, F.substr(F.col(line), (start + by).cast("int"), size)) for by in range(low, high + 1)]
    return F.array(*keys)


def letter_counts(line: str) -> Column:
    """Counts of sixteen characters, each modulo 16, packed into one long."""
    packed = F.lit(0).cast("long")
    for i, c in enumerate(COUNTED):
        count = F.length(line) - F.length(F.replace(F.col(line), F.lit(c), F.lit("")))
        packed = packed.bitwiseOR(F.shiftleft((count % 16).cast("long"), 4 * i))
    return packed


def counts_near(a: Column, b: Column, edits: int) -> Column:
    """Whether the packed counts allow that few edits: each changes two counts by one at most."""
    apart = F.lit(0)
    for i in range(len(COUNTED)):
        gap = F.abs(F.shiftrightunsigned(a, 4 * i).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(b, 4 * i).bitwiseAND(F.lit(15)))
        apart = apart + F.least(gap, F.lit(16) - gap)
    return apart <= 2 * edits


def code_points(line: Column) -> Column:
    """Four bytes for each character, so that a character is found in constant time."""
    return F.encode(line, "UTF-32")


def _part(text: Column, start: Column, size: Column) -> Column:
    """``size`` characters of ``code_points`` behind the first ``start`` ones."""
    return F.substr(text, 4 * start + F.lit(1), 4 * size)


def _common(a: str, b: str, most: Column, behind: bool = False) -> Column:
    """How many characters, ``most`` at most, two texts share at their beginnings (or ends): halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(26, -1, -1)])
    sizes = [F.length(t).cast("int") / 4 for t in (a, b)]

    def longer(found: Column, step: Column) -> Column:
        starts = [(size - found - step).cast("int") if behind else found for size in sizes]
        same = _part(F.col(a), starts[0], step) == _part(F.col(b), starts[1], step)
        return F.when((found + step <= most) & same, found + step).otherwise(found)

    return F.aggregate(steps, F.lit(0), longer)


def edits_within(pairs: DataFrame, a: str, b: str, edits: int) -> DataFrame:
    """The rows of ``pairs`` whose ``code_points`` columns ``a`` and ``b`` are at most ``edits`` edits apart.

    What both have in common at their ends cannot change the distance and is cut off, except ``edits``
    characters on each side. Every step is computed once per row.
    """
    names = pairs.columns
    least = F.least(F.length(a), F.length(b)).cast("int") / 4
    rows = computed_once(pairs, names, {"least": least.cast("int")})
    front = F.greatest(_common(a, b, F.col("least")) - edits, F.lit(0))
    rows = computed_once(rows, [*names, "least"], {"front": front})
    back = F.greatest(_common(a, b, F.col("least") - F.col("front"), behind=True) - edits, F.lit(0))
    rows = computed_once(rows, [*names, "front"], {"back": back})
    middle = lambda t: _part(F.col(t), F.col("front"), (F.length(t) / 4).cast("int") - F.col("front") - F.col("back"))
    rows = computed_once(rows, names, {"left": middle(a), "right": middle(b)})
    return rows.where(_banded("left", "right", edits)).select(*names)


def _banded(a: str, b: str, edits: int) -> Column:
    """Whether two ``code_points`` texts are at most ``edits`` apart; ``a`` has at least ``edits`` characters.

    Banded and bit-parallel: the 2 * edits + 1 cells of a column that can matter are bits of one long, with
    a bit set in ``up`` (``down``) where the distance rises (falls) from the cell above. One column is a few
    operations on longs. The distance is followed along the lower edge of the band and then along the last row.
    """
    width = 2 * edits + 1
    full, low_edge = (1 << width) - 1, width - 1
    rows, columns = ((F.length(t) / 4).cast("int") for t in (a, b))
    char = lambda text, at: _part(F.col(text), at - F.lit(1), F.lit(1))

    def equal(column: Column) -> Column:
        bits = F.lit(0).cast("long")
        for bit in range(width):
            row = column - edits + bit
            same = (row >= 1) & (row <= rows) & (char(a, row) == char(b, column))
            bits = bits + F.when(same, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct(column.alias("column"), bits.alias("equal"))

    def let(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def bit_of(word: Column, at: Column) -> Column:
        return F.call_function("shiftright", word, at.cast("int")).bitwiseAND(F.lit(1)).cast("int")

    def step(state: Column, here: Column) -> Column:
        up, down, eq = state["up"], state["down"], here["equal"]
        carried = ((eq.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(eq).bitwiseOR(down).bitwiseAND(F.lit(full))

        def after(flat: Column) -> Column:
            rising = down.bitwiseOR(F.bitwise_not(flat.bitwiseOR(up))).bitwiseAND(F.lit(full))
            falling = flat.bitwiseAND(up)
            moved = F.shiftright(flat, 1)
            edge = here["column"] + edits <= rows
            last = F.greatest(rows - here["column"] + edits, F.lit(0))
            change = F.when(edge, 1 - bit_of(flat, F.lit(low_edge))).otherwise(bit_of(rising, last) - bit_of(falling, last))
            return F.struct(
                falling.bitwiseOR(F.bitwise_not(moved.bitwiseOR(rising)).bitwiseAND(F.lit(full))).alias("up"),
                moved.bitwiseAND(rising).alias("down"),
                (state["distance"] + change).cast("int").alias("distance"),
            )

        return let(carried, after)

    start = F.struct(
        F.lit(full ^ ((1 << edits) - 1)).cast("long").alias("up"), F.lit(0).cast("long").alias("down"), F.lit(edits).cast("int").alias("distance")
    )
    columns_of = F.transform(F.when(columns > 0, F.sequence(F.lit(1), columns)).otherwise(F.array().cast("array<int>")), equal)
    distance = F.aggregate(columns_of, start, step, lambda s: s["distance"])
    return (F.abs(rows - columns) <= edits) & F.when(columns == 0, rows <= edits).otherwise(distance <= edits)


def _line_rows(docs: DataFrame) -> DataFrame:
    """``doc, at, line``: every line that is not blank, with its document and place."""
    lines = docs.select("doc", F.posexplode(split_lines("text")).alias("at", "line"))
    return lines.select("doc", "at", form(F.col("line")).alias("line")).where("line <> ''")


def _without(lines: Column, dropped: Column) -> Column:
    """The lines whose place is not in ``dropped``, joined again."""
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")


def _places(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc").agg(F.collect_set("at").alias("dropped"))


def repeated_places(docs: DataFrame) -> DataFrame:
    """``doc, dropped``: the places of lines that equal an earlier one. Lines are told apart by 128 bits of hash."""
    lines = _line_rows(docs).select("doc", "at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("g"), "line").alias("g"))
    classes = lines.groupBy("h", "g").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n"))
    classes = stage(classes.where("n > 1").select("h", "g", "first"), "repeated-lines")
    return _places(lines.join(classes, ["h", "g"]).where(F.struct("doc", "at") > F.col("first")))


def near_links(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``earlier, later``: places (``doc, at``) of lines at most ``edits`` apart, each pair once.

    The lines of ``docs`` must differ from each other. Every line is found by its segments; the counts of
    a few letters sort out most of what only shares a segment, and the edit distance decides.
    """
    return _links(_line_rows(docs), edits, min_chars)


def _links(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """``near_links`` of lines ``doc, at, line`` that differ from each other.

    Keys that occur on both sides are found by eight bytes alone, each row once, without making pairs. Letters are
    counted only for lines behind such keys, and a pair is made only where the counts allow it.
    """
    lines = lines.withColumn("length", F.length("line")).where(F.col("length") >= min_chars)
    lines = lines.withColumn("h", F.xxhash64("line"))
    index = lines.select("h", F.explode(index_keys("line", "length", edits)).alias("key"))
    probes = lines.select(F.col("h").alias("h2"), F.explode(probe_keys("line", "length", edits)).alias("key"))
    other = (F.col("i.key") == F.col("p.key")) & (F.col("i.h") != F.col("p.h2"))
    left = stage(index.alias("i").join(probes.alias("p"), other, "left_semi"), "shared-keys")
    right = stage(probes.join(_few(left.select("key").distinct(), "keys"), "key", "left_semi"), "shared-probes")
    named = _few(left.select("h").union(right.select("h2")).distinct(), "sharing-lines")
    counted = stage(lines.join(named, "h").select("h", letter_counts("line").alias("counts")), "letters")
    near = counts_near(F.col("counts"), F.col("counts2"), edits) & (F.col("h") != F.col("h2"))
    met = left.join(counted, "h").join(right.join(counted.toDF("h2", "counts2"), "h2"), "key").where(near)
    pairs = stage(met.select(F.least("h", "h2").alias("a"), F.greatest("h", "h2").alias("b")).distinct(), "line-pairs")
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    texts = lines.join(_few(wanted, "wanted-lines"), "h")
    texts = stage(texts.select("h", F.struct("doc", "at").alias("place"), code_points(F.col("line")).alias("line")), "line-texts")
    sides = pairs.join(texts.toDF("a", "place_a", "line_a"), "a").join(texts.toDF("b", "place_b", "line_b"), "b")
    linked = edits_within(sides, "line_a", "line_b", edits)
    return linked.select(F.least("place_a", "place_b").alias("earlier"), F.greatest("place_a", "place_b").alias("later"))


def _few(rows: DataFrame, name: str) -> DataFrame:
    """A narrow table, written out, and marked for broadcast if a count shows that its rows are few."""
    rows = stage(rows, name)
    return F.broadcast(rows) if rows.count() <= BROADCAST_LINES else rows


def classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = MAX_EDITS, min_chars: int = MIN_CHARS
) -> tuple[DataFrame, DataFrame]:
    """The links between all different lines, and what they mean for every line: ``pairs`` and ``members``.

    Equal lines are a class, named after the first of its places in the order of ``dedup``; a place is a key and
    a line's number in the whole text, from 0. ``pairs`` has ``earlier_doc, earlier_line, later_doc, later_line``
    for the classes at most ``edits`` apart, each pair once. ``members`` has a row per line that is not blank:
    ``key, line_no``, its class as ``class_doc, class_line``, and ``n_links``, the number of other classes that
    the class links to; a copy has the links of the line it repeats.
    """
    lines = _line_rows(docs.select(_place(key, text), F.col(text).alias("text")))
    hashes = [F.xxhash64("line").alias("h"), F.xxhash64(F.lit("g"), "line").alias("g")]
    lines = lines.select("doc", "at", "line", *hashes)
    found = lines.groupBy("h", "g").agg(F.min(F.struct("doc", "at")).alias("first"), F.first("line").alias("line"))
    found = stage(found, "line-classes")
    links = stage(_links(found.select("first.doc", "first.at", "line"), edits, min_chars), "line-links")
    ends = links.select(F.col("earlier").alias("first")).union(links.select("later")).groupBy("first").agg(F.count("*").alias("n_links"))
    named = stage(found.select("h", "g", "first").join(ends, "first", "left"), "linked-classes")
    number = lambda place: F.col(f"{place}.at").cast("long")
    members = lines.select("doc", "at", "h", "g").join(named, ["h", "g"]).select(
        F.col("doc.id").alias(key), F.col("at").cast("long").alias("line_no"), F.col("first.doc.id").alias("class_doc"),
        number("first").alias("class_line"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    sides = [c for side in ("earlier", "later") for c in (F.col(f"{side}.doc.id").alias(f"{side}_doc"), number(side).alias(f"{side}_line"))]
    return links.select(*sides), members


def _place(key: str, text: str) -> Column:
    """A row's place in the order of keys: null last, then by a hash of the text."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("hash")).alias("doc")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without repeated lines, with ``n_lines, n_equal, n_near, n_links``.

    A line that equals an earlier one goes (``n_equal``); earlier means a smaller key (null last; then a
    hash of the text, so that rows with one key have an order) or the same text further up. Of the others, a
    line of at least ``min_chars`` goes when an earlier line is at most ``edits`` edits away (``n_near``).
    ``n_links`` counts a document's links to other different lines that were left for that comparison;
    ``classes`` gives the links of all lines, repeated ones included.
    Blanks at the ends of a line do not count, and blank lines stay.

    A null text stays null and has no lines; an empty one has one blank line. Rows equal in key and text
    are treated alike. Columns of ``docs`` with the new names are replaced; all others stay.
    """
    names = [c for c in docs.columns if c not in ADDED]
    others = [F.col(c).alias(f"c{i}") for i, c in enumerate(names) if c != text]  # the text travels once
    rows = docs.select(_place(key, text), F.col(text).alias("text"), F.struct(F.lit(0).alias("k"), *others).alias("row"))
    equal = stage(repeated_places(rows.select("doc", "text")), "equal-lines")
    lines = split_lines("text")
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    kept = rows.join(_small(equal), "doc", "left").select(
        "doc", "row", F.when(F.col("dropped").isNotNull(), _without(lines, F.col("dropped"))).otherwise(F.col("text")).alias("text"),
        F.coalesce(breaks + 1, F.lit(0)).alias("n_lines"), _count("dropped").alias("n_equal"),
    )
    kept = stage(kept, "distinct-lines")
    links = stage(near_links(kept.select("doc", "text"), edits, min_chars), "line-links")
    near = _places(links.select("later.*"))
    ends = links.select("earlier.doc").union(links.select("later.doc")).groupBy("doc").agg(F.count("*").alias("n_links"))
    changes = stage(near.join(ends, "doc", "full"), "near-lines")
    body = F.when(F.col("dropped").isNotNull(), _without(split_lines("text"), F.col("dropped"))).otherwise(F.col("text")).alias(text)
    found = kept.join(_small(changes), "doc", "left")
    columns = [body if c == text else F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)]
    n_links = F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    return found.select(*columns, "n_lines", "n_equal", _count("dropped").alias("n_near"), n_links)


def _count(places: str) -> Column:
    return F.coalesce(F.size(places), F.lit(0))


def _small(rows: DataFrame) -> DataFrame:
    """``rows(doc, dropped)`` marked for broadcast if a count of rows and places shows that they are few."""
    weight = rows.agg(F.coalesce(F.sum(_count("dropped") + 1), F.lit(0))).first()[0]
    return F.broadcast(rows) if weight <= BROADCAST_LINES else rows
