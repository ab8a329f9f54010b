"""Removal of passages that repeat anywhere in a corpus, by content-defined chunks of lines.

A line here is a physical line, one of its clauses or a run of words of one: text up to a line
feed, or up to a stop, comma or the like and the space behind it, or up to a space behind some
word endings. What is longer than ``MAX_BYTES`` still is cut behind words whose hash is lower than
that of their neighbours, so no stretch of a text is one line for want of punctuation. Lines are hashed, a rolling hash (cyclic
polynomial) runs over two line hashes, and a chunk ends where it has a local minimum, at
the end of a physical line of two lines or more, or at every fourth of lines that are all the same. That
depends on the lines around alone, so equal passages are cut alike wherever they stand. Chunks of two or more lines
that occur again anywhere are looked up, their bytes compared with the first occurrence, and the match is carried on, line
by line, into the chunks before and after. Matches that go on from one another
here and where they first stood are one passage. Passages of ``MIN_WORDS`` words or more are removed
from all but the first place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutlake.llm.common import read, staged

MIN_WORDS = 20
# No floor: chunks of any length start a look-up.
MIN_CHARS = 0
# A line ends behind these (the letters are those with even, odd and even codes) ...
_EVEN, _ODD = "[bdfhjlnprtvxzBDFHJLNPRTVXZ]", "[acegikmoqsuwyACEGIKMOQSUWY]"
# A line is words none of which ends it, then one that does or the rest; nothing behind the last one.
_LINE = rf"(?:[^\n ]* (?<![.,;:!?] )(?<!{_EVEN}{_ODD}{_EVEN} ))*+(?:[^\n ]*[\n ]|[^\n ]+|\z)"
# ... and one of more bytes behind some of its words too, or every eighth of equal words.
MAX_BYTES = 64
_WORD = r"[^ \t\x0b\x0c\r]*[ \t\x0b\x0c\r]|[^ \t\x0b\x0c\r]+"


def _rotated(column: Column, bits: int) -> Column:
    return F.shiftleft(column, bits).bitwiseOR(F.shiftrightunsigned(column, 64 - bits))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ended(ends: Column, n: Column) -> Column:
    """``ends`` in order, with ``n`` behind them unless it is the last one."""
    return F.when(F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)) == n, ends).otherwise(F.concat(ends, F.array(n)))


def _word_runs(line: Column) -> Column:
    """A long line in runs of words, cut where the hash of a word is a local minimum."""

    def pieces(words: Column, hashes: Column) -> Column:
        h = lambda i: F.get(hashes, i)
        cut = lambda x, i: ((x < h(i - 1)) & (x < h(i + 1))) | ((x == h(i - 1)) & (i % 8 == 7))
        ends = F.array_remove(F.transform(hashes, lambda x, i: F.when(cut(x, i), i + 1).otherwise(0)), 0)
        piece = lambda ends: lambda end, j: _let(
            F.when(j > 0, F.get(ends, j - 1)).otherwise(F.lit(0)), lambda first: F.array_join(F.slice(words, first + 1, end - first), "")
        )
        return _let(_let(ends, lambda ends: _ended(ends, F.size(words))), lambda ends: F.transform(ends, piece(ends)))

    hashes = lambda words: F.transform(words, lambda x: F.xxhash64(x))
    return _let(F.regexp_extract_all(line, F.lit(_WORD), F.lit(0)), lambda words: _let(hashes(words), lambda found: pieces(words, found)))


def lines_of(text: Column) -> Column:
    """The lines of a text; joined again they are the text."""
    long = lambda line: F.octet_length(line) > MAX_BYTES
    cut = lambda lines: F.flatten(F.transform(lines, lambda x: F.when(long(x), _word_runs(x)).otherwise(F.array(x))))
    found = F.array_remove(F.regexp_extract_all(text, F.lit(_LINE), F.lit(0)), "")
    return _let(found, lambda lines: F.when(F.exists(lines, long), cut(lines)).otherwise(lines))


def _chunked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``lines`` and ``ends``, the number of lines up to the end of each chunk."""
    step = docs.select("*", lines_of(F.coalesce("text", F.lit(""))).alias("lines")).drop("text")
    step = step.select("*", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("lines", lambda x: x.endswith("\n")).alias("feeds"))
    # Both one place on: what stands at i belongs to the line before line i.
    turned = F.concat(F.array(F.lit(0).cast("long")), F.transform("hashes", lambda x: _rotated(x, 1)))
    step = step.select("*", turned.alias("turned"), F.concat(F.array(F.lit(False)), "feeds").alias("ahead"))
    feed, ahead = lambda i: F.get("feeds", i), lambda i: F.get("ahead", i)
    # A physical line of several clauses is rolled over and cut by itself, its first clause never alone.
    roll = F.transform("hashes", lambda h, i: F.when(ahead(i) & ~feed(i), h).otherwise(h.bitwiseXOR(F.get("turned", i))))
    step = step.select("*", roll.alias("roll")).drop("hashes", "turned")
    r = lambda i: F.get("roll", i)
    lowest = lambda x, i: (x < r(i - 1)) & (x < r(i + 1)) & (feed(i) | ~ahead(i))
    cut = lambda x, i: (feed(i) & ~ahead(i) & (i > 0)) | lowest(x, i) | ((x == r(i - 1)) & (i % 4 == 3))
    found = F.array_remove(F.transform("roll", lambda x, i: F.when(cut(x, i), i + 1).otherwise(0)), 0)
    step = step.select("*", found.alias("found")).drop("roll", "feeds", "ahead")
    return step.select("*", _ended(F.col("found"), F.size("lines")).alias("ends")).drop("found")


def _span(k: Column) -> tuple[Column, Column]:
    """First line (from 0) and end of chunk ``k``."""
    return F.coalesce(F.when(k > 0, F.get("ends", k - 1)), F.lit(0)), F.coalesce(F.get("ends", k), F.lit(0))


def _slice(k: Column) -> Column:
    """The lines of chunk ``k``; none where there is no such chunk."""
    first, end = _span(k)
    return F.when((k >= 0) & (k < F.size("ends")), F.slice("lines", first + 1, end - first)).otherwise(F.array().cast("array<string>"))


def _words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), ""))


def _alike(a: Column, b: Column) -> Column:
    """How many items two arrays share from the front."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(a, i) != F.get(b, i)))
    return F.get(differs, F.lit(0))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, mark (hash of the text), first and end of the spans of lines to take out of each text."""
    docs = docs.select("doc_id", "text")
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    chunked = _chunked(marked).select("*", F.concat(F.array(F.lit(0)), "ends").alias("starts"))
    size = lambda end, k: end - F.get("starts", k)
    hashes = F.transform("ends", lambda end, k: F.when(size(end, k) > 1, F.xxhash64(F.slice("lines", F.get("starts", k) + 1, size(end, k)))))
    # posexplode_outer: no filter on the arrays is inferred, which would be worked out a second time below.
    index = chunked.select("doc_id", "mark", F.posexplode_outer(hashes).alias("chunk", "hash"))
    index = staged(index.where("hash is not null"), "chunk-index")
    parts = ["doc_id", "mark", "chunk"]
    # By number first: few chunks stand more than once, and only for those is the first place looked for.
    many = index.groupBy("hash").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select(F.col("hash").alias("of_hash"))
    # Merge joins all through: the plan is the same at any size, and no side must fit into memory.
    places = staged(index.join(many.hint("merge"), F.col("hash") == F.col("of_hash"), "left_semi"), "repeated-chunks")
    place = F.struct(*parts)
    again = places.groupBy("hash").agg(F.min(place).alias("origin")).select(F.col("hash").alias("of_hash"), "origin")
    later = places.join(again.hint("merge"), F.col("hash") == F.col("of_hash")).where(place != F.col("origin")).select(*parts, "origin")
    later = later.repartition("doc_id", "mark").distinct()
    # Where the chunk stood last in the same text: texts that go round in circles are one passage only from round to round.
    rounds, order = Window.partitionBy("doc_id", "mark", "origin").orderBy("chunk"), Window.partitionBy("doc_id", "mark").orderBy("chunk")
    # Whether the chunk before or after matches the one before or after the origin: then no line of it need be compared.
    goes_on = lambda near, step: F.coalesce(
        (near("chunk") == F.col("chunk") + step) & near("origin.doc_id").eqNullSafe(F.col("origin.doc_id"))
        & (near("origin.mark") == F.col("origin.mark")) & (near("origin.chunk") == F.col("origin.chunk") + step), F.lit(False),
    )
    led, followed = goes_on(lambda c: F.lag(c).over(order), -1), goes_on(lambda c: F.lead(c).over(order), 1)
    later = later.select(place.alias("place"), "origin", F.lag("chunk").over(rounds).alias("prior"), led.alias("led"), followed.alias("followed"))
    later = staged(later, "later-chunks")
    # The lines of these chunks, cut out of the texts once, each with the place it is compared with.
    first = later.groupBy("origin").agg(F.min("led").alias("led"), F.min("followed").alias("followed"))
    first = first.select(F.col("origin").alias("place"), "origin", F.lit(None).cast("int").alias("prior"), "led", "followed")
    wanted = later.union(first).groupBy("place.doc_id", "place.mark").agg(
        F.collect_set(F.struct("place.chunk", "origin", "prior", "led", "followed")).alias("chunks")
    ).select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), "chunks")
    held = marked.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")))
    # Sliced before they are exploded: an exploded row must not carry all lines of its text.
    prior = lambda x: F.when(_slice(x["prior"]) == _slice(x["chunk"]), _span(x["prior"])[0])
    sliced = lambda x: F.struct(
        x["chunk"].alias("chunk"), x["origin"].alias("origin"), _span(x["chunk"])[0].alias("first"), _span(x["chunk"])[1].alias("end"), prior(x).alias("prior"),
        _slice(x["chunk"]).alias("body"),
        F.when(x["led"], F.array().cast("array<string>")).otherwise(F.reverse(_slice(x["chunk"] - 1))).alias("before"),
        F.when(x["followed"], F.array().cast("array<string>")).otherwise(_slice(x["chunk"] + 1)).alias("after"),
    )
    cut = _chunked(held.select("doc_id", "mark", "text", "chunks"))
    cut = cut.select("doc_id", "mark", F.explode_outer(F.transform("chunks", sliced)).alias("x"))
    cut = staged(
        cut.select(F.struct("doc_id", "mark", F.col("x.chunk").alias("chunk")).alias("place"), *[f"x.{c}" for c in ("origin", "first", "end", "prior", "body", "before", "after")]),
        "chunk-lines",
    )
    # Repeated rows give an origin more than once.
    origins = staged(cut.where("place = origin").drop("place", "end", "prior").dropDuplicates(["origin"]), "origin-lines")
    origins = origins.select([F.col(c).alias(f"its_{c}") for c in origins.columns])
    met = cut.where("place <> origin").join(origins.hint("merge"), F.col("origin") == F.col("its_origin")).where("body = its_body")
    # The stretch of lines of each match, under the document they repeat and how far on they stand in this one.
    along = lambda text, first: F.xxhash64(f"{text}.doc_id", f"{text}.mark", F.col("first") - F.col(first))
    met = met.select("place.doc_id", "place.mark", "first", "end", "prior", "body", along("origin", "its_first").alias("far"), along("place", "prior").alias("near"),
        F.slice("before", F.lit(1), _alike(F.col("before"), F.col("its_before"))).alias("up"), F.slice("after", F.lit(1), _alike(F.col("after"), F.col("its_after"))).alias("down"),
    )
    words = lambda lines: F.transform(lines, _words)
    stretch = lambda key, first, end, words: F.struct(F.col(key).alias("along"), first.alias("first"), end.alias("end"), words.alias("words"))
    far = stretch("far", F.col("first") - F.size("up"), F.col("end") + F.size("down"), words(F.concat(F.reverse("up"), "body", "down")))
    near = F.when(F.col("prior").isNotNull(), stretch("near", F.col("first"), F.col("end"), words("body")))
    held = met.select("doc_id", "mark", F.explode(F.array(far, near)).alias("x")).where("x is not null").select("doc_id", "mark", "x.*")
    # Neighbouring matches are one passage, however many there are; a line that several hold counts once.
    order = Window.partitionBy("doc_id", "mark", "along").orderBy("first", "end")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    held = held.repartition("doc_id", "mark").select("*", reach.alias("reach"))
    known = F.least(F.greatest(F.col("reach") - F.col("first"), F.lit(0)), F.size("words"))
    fresh = F.aggregate(F.slice("words", known + 1, F.size("words") - known), F.lit(0), lambda a, b: a + b)
    held = held.select("doc_id", "mark", "along", "first", "end", fresh.alias("words"), F.when(F.col("first") > F.col("reach"), 1).otherwise(0).alias("opens"))
    held = held.select("*", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    spans = held.groupBy("doc_id", "mark", "along", "island").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.sum("words").alias("words"))
    return spans.where(F.col("words") >= min_words).select("doc_id", "mark", "first", "end")


def _merged(spans: DataFrame) -> DataFrame:
    """doc_id, mark and ``cuts``, the spans of each text in order, those that touch made one."""
    order = Window.partitionBy("doc_id", "mark").orderBy("first", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.select("*", F.when(F.col("first") <= reach, 0).otherwise(1).alias("opens"))
    runs = opens.select("*", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    runs = runs.groupBy("doc_id", "mark", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return runs.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("cuts"))


def _without(lines: Column, cuts: Column) -> Column:
    """The text of the lines that no cut holds."""
    start = lambda j: F.when(j > 0, F.get(cuts, j - 1)["end"]).otherwise(F.lit(0))
    stop = lambda j: F.when(j < F.size(cuts), F.get(cuts, j)["first"]).otherwise(F.size(lines))
    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda j: F.slice(lines, start(j) + 1, stop(j) - start(j)))), "")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, repeated passages taken out of ``text``.

    The first place is the one with the smallest doc_id (null before all), then the smallest
    hash of its text, then the earliest in the text. Rows equal in doc_id and text are one
    document: they change alike. Null and empty texts stay. n_chars follows the new text where
    there is such a column and the text changed.
    """
    spans = repeated_spans(docs, min_words)
    cuts = _merged(spans).select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), "cuts")
    cuts = staged(cuts, "cuts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("mark"))
    joined = rows.join(cuts.hint("merge"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")), "left")
    kept = _let(lines_of(F.col("row.text")), lambda lines: _without(lines, F.col("cuts")))
    new = joined.select("row", F.when(F.col("cuts").isNotNull(), kept).alias("new"))
    changed = {"text": F.coalesce("new", "row.text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.length("new").cast(docs.schema["n_chars"].dataType), "row.n_chars")
    return new.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every document without repeated passages, and how many characters went."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    before = docs.select("doc_id", "text", F.length("text").alias("n_before"))
    return dedup(before).select(
        "doc_id", "text", (F.coalesce("n_before", F.lit(0)) - F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_removed")
    )
