"""Line deduplication by a segment-partition edit join, with DataFrame functions only.

A line is split into threshold + 1 segments: whatever `threshold` edits hit, one segment survives, shifted by a bounded amount.
Each line is indexed by its segments, keyed by its length, and probes the indexes of its own and slightly smaller lengths with
the substrings that can meet a segment there. Most keys occur in one line only, so keys are first aggregated without any text;
the lines are read again for keys that two different lines share. Pairs are verified by a banded bit-parallel edit distance, and
linked lines form classes. For classes, each key's lines are first compared with one leader, in linear work, and components are formed;
only lines of a key that are still in different components are then paired. A key of many such lines is refined: what lies beside the
matched segment keeps a known part of the edits and is partitioned in turn.

A line of at least `least_chars` characters stays where its class occurs first, by (doc_id, text hash, line number), and is removed
everywhere else. Shorter lines and lines of blanks are left alone. Lines are identified by a 64-bit hash; a second one tells different
lines of one hash apart, and such lines are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_BYTES, ROW_BYTES, checkpointed, maybe_broadcast, pick
from docloom.llm.components import components

#: Rows (lines by region) under one key that are paired at once, and the refinements tried to get there.
HOT, LEVELS = 512, 4


def line_rows(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, th, line_no, line) of the lines that can be removed; th is a hash of the text, so rows with one doc_id but different texts stay apart."""
    df = pick(docs, "doc_id", "text").where("text IS NOT NULL")
    df = df.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return df.where((F.length("line") >= least_chars) & (F.trim("line") != ""))


def probes(threshold: int) -> list[tuple[int, int, int]]:
    """(difference of lengths, segment, shift) of every look-up; the first threshold + 1 are the line's own segments, that is its index entries."""
    own = [(0, i, 0) for i in range(1, threshold + 2)]
    rest = [
        (d, i, shift)
        for d in range(threshold + 1)
        for i in range(1, threshold + 2)
        for shift in range(max(1 - i, d - threshold - 1 + i), min(i - 1, d + threshold + 1 - i) + 1)
    ]
    return own + [x for x in rest if x not in own]


def segment(length: Column, parts: Column | int, i: Column | int) -> tuple[Column, Column]:
    """First position (from 1) and length of segment i; the last segments are one longer where the parts don't divide the length."""
    parts, i = (x if isinstance(x, Column) else F.lit(x) for x in (parts, i))
    size, more = F.floor(length / parts).cast("int"), length % parts
    late = F.greatest(i - 1 - (parts - more), F.lit(0))
    return (i - 1) * size + late + 1, size + (i > parts - more).cast("int")


def keyed(lines: DataFrame, threshold: int) -> DataFrame:
    """(id, line, pos, key), a row for every look-up of a line; pos is the place of the look-up in probes().

    The look-ups are exploded first and the key is one small expression on each row, which the JVM compiles well. Segments are
    cut from four bytes a character, made once a line, so a cut does not walk the line.
    """
    looks = [F.struct(F.lit(n).alias("pos"), F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for n, (d, i, s) in enumerate(probes(threshold))]
    rows = lines.select("id", "line", F.length("line").alias("_n"), F.encode("line", "UTF-32").alias("_b"))
    rows = rows.select("id", "line", "_n", "_b", F.explode(F.array(*looks)).alias("_k"))
    rows = rows.select("id", "line", "_b", "_k.pos", "_k.i", "_k.s", (F.col("_n") - F.col("_k.d")).alias("_n"))
    at, size = segment(F.col("_n"), threshold + 1, F.col("i"))
    cut = F.substring("_b", 4 * (at + F.col("s")) - 3, 4 * size)
    return rows.select("id", "line", "pos", F.xxhash64("_n", "i", cut).alias("key"))


def regions(threshold: int) -> list[Column]:
    """For a row with key number `pos`: what lies beside its segment (start, end, length on the index side) and the edits left there.

    To the right of segment i at most threshold + 1 - i edits remain, to the left of the last one at most threshold.
    """
    a = b = size = left = None
    for pos, (d, i, shift) in enumerate(probes(threshold)):
        length = F.length("line") - d
        at, n = segment(length, threshold + 1, i)
        last = i == threshold + 1
        told = (F.lit(1), at + shift, at - 1, F.lit(threshold)) if last else (at + shift + n, F.length("line") + 1, length - at - n + 1, F.lit(threshold + 1 - i))
        here = F.col("pos") == pos
        a, b, size, left = (F.when(here, x.cast("int")) if y is None else y.when(here, x.cast("int")) for x, y in zip(told, (a, b, size, left)))
    return [a.alias("a"), b.alias("b"), size.alias("size"), left.alias("left")]


def common(x: Column, y: Column, most: Column, right: bool) -> Column:
    """Length of the common prefix (or suffix) of two strings, `most` at most, by bisection over equality."""
    start = F.struct(F.lit(0).alias("lo"), most.cast("int").alias("hi"))

    def cut(s: Column, n: Column) -> Column:
        return s.substr(F.length(s) - n + 1, n) if right else s.substr(F.lit(1), n)

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc.lo + acc.hi + 1) / 2).cast("int")
        same = cut(x, mid) == cut(y, mid)
        return F.struct(F.when(same, mid).otherwise(acc.lo).alias("lo"), F.when(same, acc.hi).otherwise(F.greatest(mid - 1, acc.lo)).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(most, F.lit(1)) + 1)).cast("int"))
    return F.aggregate(steps, start, step, lambda acc: acc.lo)


def strip_common(pairs: DataFrame) -> DataFrame:
    """line_a and line_b without their common prefix and suffix, which no edit needs to touch.

    Each step passes through a generator of one row: the optimizer would otherwise copy the expressions into every use.
    """
    a, b = F.col("line_a"), F.col("line_b")
    for right in (False, True):
        n = F.col("_n")
        df = pairs.withColumn("_n", F.explode(F.array(common(a, b, F.least(F.length(a), F.length(b)), right))))
        cut = [F.struct(*[(x.substr(F.lit(1), F.length(x) - n) if right else x.substr(n + 1, F.length(x))).alias(k) for k, x in (("line_a", a), ("line_b", b))])]
        pairs = df.select("a", "b", F.explode(F.array(*cut)).alias("_k")).select("a", "b", "_k.line_a", "_k.line_b")
    return pairs


def within(x: str, y: str, threshold: int) -> Column:
    """Whether two strings, whose lengths differ by the threshold at most, are within so many edits.

    A machine word holds the vertical differences of the 2 * threshold + 1 rows around the diagonal; each character of y moves
    the band down a row (Hyyrö's banded form of Myers' algorithm). The distance is followed along the diagonal that ends in
    the last cell.
    """
    t, mask = threshold, (1 << 2 * threshold + 1) - 1
    match = " | ".join(f"shiftleft(cast(element_at(v.x, j + {k}) = element_at(v.y, j) as bigint), {k})" for k in range(2 * t + 1))
    d0 = f"transform(array({match}), m -> ((((m & acc.p) + acc.p) ^ acc.p) | m | acc.n) & {mask}L)"
    hp = f"(acc.n | (~(d | acc.p) & {mask}L))"
    step = f"""transform({d0}, d -> named_struct(
        'p', ((d & acc.p) | ~(shiftright(d, 1) | {hp})) & {mask}L,
        'n', shiftright(d, 1) & {hp},
        's', acc.s + if(j + v.g >= 1 and (shiftright(d, v.g + {t}) & 1L) = 0L, 1, 0)))[0]"""
    start = f"named_struct('p', {((1 << t + 1) - 1) << t}L, 'n', 0L, 's', abs(v.g))"
    pad = f"concat(array_repeat('', {t}), split({x}, ''), array_repeat('', {3 * t}))"
    told = f"named_struct('x', {pad}, 'y', split({y}, ''), 'g', length({x}) - length({y}))"
    run = f"aggregate(sequence(1, length({y})), {start}, (acc, j) -> {step}, acc -> acc.s)"
    return F.expr(f"transform(array({told}), v -> if(length({y}) = 0, length({x}), {run}))[0] <= {t}")


def signature(line: str) -> Column:
    """64 parities of character counts. An edit changes at most two of them, so lines within t edits differ in 2 t at most."""
    return F.expr(f"aggregate(split({line}, ''), 0L, (acc, c) -> acc ^ shiftleft(1L, ascii(c) % 64))")


def shared(rows: DataFrame, *region: str) -> DataFrame:
    """Distinct rows of keys that lines of at least two components (column comp) share, one line of them in the index, with the number n of rows of each key.

    Where a line is periodic, shifted look-ups cut the same substring, and the line stands under one key with several regions
    (told apart by the columns `region`). Each is kept: refinement may meet the other line beside any one of them.
    """
    rows = checkpointed(rows.dropDuplicates(["key", "index", "id", *region]))
    return rows.join(_several(rows), "key")


def _several(rows: DataFrame) -> DataFrame:
    """(key, n, main) of the keys of shared(): n is the number of rows, main the component of the key's smallest line."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.max("index").alias("_in"), F.min_by("comp", "id").alias("main"))
    return counts.where((F.col("_lo") != F.col("_hi")) & F.col("_in")).select("key", "n", "main")


def refine(rows: DataFrame) -> DataFrame:
    """New keys for rows of hot keys: their region is partitioned for the edits left in it, and probed with every possible shift."""
    parts, gap = F.col("left") + 1, F.length("region") - F.col("size")

    def one(i: Column) -> Column:
        at, n = segment(F.col("size"), parts, i)
        low = F.when(F.col("index"), F.lit(0)).otherwise(F.greatest(1 - i, gap - parts + i))
        high = F.when(F.col("index"), F.lit(0)).otherwise(F.least(i - 1, gap + parts - i))
        shifts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

        def shifted(s: Column) -> Column:
            start, last = at + s, i == parts
            rest = F.when(last, F.col("region").substr(F.lit(1), start - 1)).otherwise(F.col("region").substr(start + n, F.length("region")))
            return F.struct(
                F.when((start >= 1) & (start + n <= F.length("region") + 1), F.xxhash64("key", i, F.col("region").substr(start, n))).alias("key"),
                rest.alias("region"),
                F.when(last, at - 1).otherwise(F.col("size") - at - n + 1).cast("int").alias("size"),
                F.when(last, F.col("left")).otherwise(parts - i).cast("int").alias("left"),
            )

        return F.transform(shifts, shifted)

    made = rows.select("index", "id", "comp", "sig", "chars", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), parts), one))).alias("_k"))
    return made.select("_k.key", "index", "id", "comp", "sig", "chars", "_k.region", "_k.size", "_k.left").where("key IS NOT NULL")


def pairs(rows: DataFrame, threshold: int, blocks: bool = False) -> DataFrame:
    """Index lines joined with the lines of other components that probe them, by key, where lengths and signatures allow the edits: (a, b).

    Here a line counts once under a key, whatever its regions. Lines of the key's main component are not enumerated against each other.
    With `blocks`, the lines of a key are dealt to blocks of about HOT, which meet two by two: no task gets a key of any size as a whole.
    """
    rows = rows.select("key", "index", "id", "comp", "sig", "chars", "n", (F.col("comp") == F.col("main")).alias("main")).dropDuplicates(["key", "index", "id"])
    near = F.bit_count(F.col("a.sig").bitwiseXOR(F.col("b.sig"))) <= 2 * threshold
    turn = (F.col("a.chars") < F.col("b.chars")) | ((F.col("a.chars") == F.col("b.chars")) & (F.col("a.id") < F.col("b.id")))
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") != F.col("b.comp")) & near & turn

    if blocks:
        met = met & (F.col("a._i") == F.col("b._i")) & (F.col("a._j") == F.col("b._j"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        count = F.ceil(F.col("n") / HOT).cast("int")
        return side.withColumn(own, F.pmod(F.xxhash64("id"), count).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), count - 1))) if blocks else side

    def joined(index: DataFrame, probing: DataFrame) -> DataFrame:
        index, probing = dealt(index, "_i", "_j"), dealt(probing, "_j", "_i")
        return index.alias("a").join(probing.alias("b"), met).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))

    index, probing = rows.where("index"), rows.where("NOT index")
    return joined(index.where("NOT main"), probing).union(joined(index.where("main"), probing.where("NOT main")))


def verified(found: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose lines (id, line), once each, are within the threshold."""
    found = found.distinct().join(lines.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a")
    found = found.join(lines.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b").select("a", "b", "line_a", "line_b")
    return strip_common(found).where(within("line_a", "line_b", threshold)).select("a", "b")


def keyed_rows(lines: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Stored rows (key, index, id, sig, chars, region, size, left) of the keys that two lines share, one of them in the index; and their lines (id, line), once each."""
    # Of all look-ups only numbers are moved, once; the lines of keys that are shared are read again.
    same = Window.partitionBy("key")
    rows = keyed(lines, threshold).select("key", "pos", "id").withColumns({"_lo": F.min("id").over(same), "_hi": F.max("id").over(same), "_pos": F.min("pos").over(same)})
    found = checkpointed(rows.where((F.col("_lo") != F.col("_hi")) & (F.col("_pos") <= threshold)).select("key", "pos", "id").distinct())
    ids = checkpointed(found.select(F.col("id").alias("_id")).distinct())
    texts = checkpointed(lines.select("id", "line").join(maybe_broadcast(ids), F.col("id") == F.col("_id"), "left_semi").dropDuplicates(["id"]))
    rows = found.join(texts, "id").select("key", "pos", "id", "line")
    # A line's own segment stands in the index and is also the unshifted probe of its own length.
    rows = rows.withColumn("index", F.explode(F.when(F.col("pos") <= threshold, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    members = checkpointed(rows.select("key", "index", "id", "line", *regions(threshold)).dropDuplicates(["key", "index", "id", "a", "b"]))
    region = F.col("line").substr(F.col("a"), F.col("b") - F.col("a"))
    # Stored, too, since signatures are dear and these rows are read several times.
    told = checkpointed(members.select("key", "index", "id", signature("line").alias("sig"), F.length("line").alias("chars"), region.alias("region"), "size", "left"))
    return told, texts


def joined_keys(rows: DataFrame, threshold: int) -> DataFrame:
    """Candidate pairs (a, b) of rows as keyed_rows() gives them, with a column comp: lines of one component are not paired.

    Up to HOT rows under one key are compared with each other. Refinement stops after LEVELS rounds; the lines still under
    one key then differ only within a small region, and are paired in blocks.
    """
    rows = rows.join(_several(rows), "key")
    out = pairs(rows.where(F.col("n") <= HOT), threshold)
    hot = rows.where(F.col("n") > HOT)
    for level in range(LEVELS):
        if hot.isEmpty():
            break
        rows = shared(refine(hot), "region")
        out = out.union(pairs(rows.where(F.col("n") <= HOT), threshold))
        hot = rows.where(F.col("n") > HOT)
    else:
        out = out.union(pairs(hot, threshold, blocks=True))
    return out


def links(lines: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b) for all different lines within `threshold` edits, from rows (id, line) that may repeat; lines must be longer than the threshold.

    The number of links can be the square of the lines; classes() needs fewer.
    """
    rows, texts = keyed_rows(lines, threshold)
    return verified(joined_keys(rows.withColumn("comp", F.col("id")), threshold), texts, threshold)


def led(rows: DataFrame, threshold: int) -> DataFrame:
    """Candidate pairs (a, b) of every line of a key with the key's leader, its smallest line: as many as there are rows."""
    first = rows.groupBy("key").agg(F.min(F.struct("id", "sig", "chars")).alias("_f"))
    near = (F.bit_count(F.col("sig").bitwiseXOR(F.col("_f.sig"))) <= 2 * threshold) & (F.abs(F.col("chars") - F.col("_f.chars")) <= threshold)
    return rows.select("key", "id", "sig", "chars").join(first, "key").where(near & (F.col("id") != F.col("_f.id"))).select(F.col("_f.id").alias("a"), F.col("id").alias("b"))


def classes(lines: DataFrame, threshold: int = 2) -> DataFrame:
    """(id, root) of the lines that links of up to `threshold` edits connect, root the smallest id; the links themselves are only found as far as that takes.

    Two lines within the threshold share a key. They are in one component after the keys' leaders are linked, or they are paired then.
    """
    rows, texts = keyed_rows(lines, threshold)
    first = checkpointed(verified(led(rows, threshold), texts, threshold))
    known = checkpointed(components(first).select(F.col("id").alias("_id"), "root"))
    rows = rows.join(maybe_broadcast(known), F.col("id") == F.col("_id"), "left").withColumn("comp", F.coalesce("root", "id")).drop("_id", "root")
    rest = checkpointed(verified(joined_keys(rows, threshold), texts, threshold))
    return known.withColumnRenamed("_id", "id") if rest.isEmpty() else components(first.union(rest))


def repeated(table: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Of a stored table (id, n, first), the most repeated lines, as many as `most` bytes hold: those of at least 2, 4, 8 or so occurrences."""
    level = F.floor(F.log2("n")).cast("int")
    counts = sorted((-r["_l"], r["_k"]) for r in table.where("n > 1").groupBy(level.alias("_l")).agg(F.count("*").alias("_k")).collect())
    least, held = 64, 0
    for minus, k in counts:
        held += k * (ROW_BYTES + 64)
        if held > most:
            break
        least = -minus
    return table.where(level >= least).select(F.col("id").alias("_id"), F.col("first").alias("_first"))


def removals(docs: DataFrame, threshold: int = 2, least_chars: int = 20) -> DataFrame:
    """(doc_id, th, removed: sorted array of line numbers from 0, n_near), one row for each document that loses a line.

    n_near counts removed lines whose text differs from the one that stays. Of a line that occurs often only the first occurrence is looked up: the others are
    known by its hash. Which lines these are is broadcast, as far as that fits; a line left out for that is looked up a few times over, with one result.
    """
    lines = line_rows(docs, least_chars).withColumn("id", F.xxhash64("line"))
    place = F.struct("doc_id", "th", "line_no", "id")
    # The second hash, of another seed, differs where two lines share the first.
    check = F.xxhash64(F.lit(1), "line")
    table = lines.select("doc_id", "th", "line_no", "id", check.alias("_c")).groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi"))
    table = checkpointed(table)
    at = lambda first: F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("th") == first["th"]) & (F.col("line_no") == first["line_no"])
    once = lines.join(F.broadcast(repeated(table)), F.col("id") == F.col("_id"), "left").where(F.col("_id").isNull() | at(F.col("_first")))
    found = checkpointed(classes(once.select("id", "line"), threshold))
    first = table.where("_lo = _hi").join(found.union(found.select(F.col("root").alias("id"), "root").distinct()), "id", "left")
    first = checkpointed(first.where("n > 1 OR root IS NOT NULL").select("id", "root", "first"))
    linked = first.where("root IS NOT NULL")
    best = linked.groupBy("root").agg(F.min("first").alias("best")).select(F.col("root").alias("_root"), "best")
    first = first.join(best, F.col("root") == F.col("_root"), "left").select(F.col("id").alias("_id"), F.coalesce("best", "first").alias("first"))
    gone = lines.select("doc_id", "th", "line_no", "id").join(first, F.col("id") == F.col("_id"))
    gone = gone.where(~at(F.col("first"))).select("doc_id", "th", "line_no", (F.col("id") != F.col("first.id")).cast("bigint").alias("near"))
    # Repeated rows of one document lose a line once; the lines of a document are few, so a set in the aggregate suffices.
    gone = gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("removed"), F.size(F.collect_set(F.when(F.col("near") == 1, F.col("line_no")))).cast("bigint").alias("n_near"))
    return gone


def decide(docs: DataFrame, threshold: int = 2, least_chars: int = 20) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, n_near, removed (line numbers from 0, comma-joined).

    Null text has no lines, empty text one. Rows with equal doc_id and text lose the same lines, since they are one document
    repeated; ties in doc_id are broken by the text's hash. A null doc_id sorts first.
    """
    gone = removals(docs, threshold, least_chars).withColumnRenamed("doc_id", "_doc").withColumnRenamed("th", "_th")
    df = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n"), F.col("text").isNull().alias("none"))
    df = df.join(gone, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    number = F.when(F.col("none"), 0).otherwise(F.col("n")).cast("bigint")
    removed = F.coalesce(F.array_join(F.transform("removed", lambda x: x.cast("string")), ","), F.lit(""))
    return df.select("doc_id", number.alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("n_near", F.lit(0)).alias("n_near"), removed.alias("removed"))


def dedup(docs: DataFrame, threshold: int = 2, least_chars: int = 20) -> DataFrame:
    """The columns of documents, with removed lines cut out of text and n_chars set anew; a document that loses its last word goes.

    Documents that lose nothing stay as they are.
    """
    gone = maybe_broadcast(checkpointed(removals(docs, threshold, least_chars).withColumnRenamed("doc_id", "_doc").withColumnRenamed("th", "_th")))
    df = pick(docs, "doc_id", "text", "lang", "source", "n_chars").withColumn("_own", F.xxhash64("text"))
    df = df.join(gone, (F.col("_own") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    out = df.withColumn("_new", text).where(F.col("removed").isNull() | F.col("_new").rlike(r"[^\x20\x09-\x0D]"))
    return out.select("doc_id", F.col("_new").alias("text"), "lang", "source", F.when(F.col("removed").isNull(), F.col("n_chars")).otherwise(F.length("_new")).cast("bigint").alias("n_chars"))
