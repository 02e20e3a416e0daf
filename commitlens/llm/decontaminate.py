"""Benchmark decontamination by template windows, in DataFrame operations only.

Texts are canonicalised: numbers (digits or number words), units after numbers and names (capitalised words
within a sentence) become typed placeholders, case and punctuation go; digits are read without the
points and commas between them, and letters behind them are a word of their own.  Other capitalised words,
such as those that begin a sentence, may be names or not, unless they are in STARTERS: windows with
such words have a key for either reading.  Windows of ``WINDOW`` template words are hash-joined with the
benchmark's, so that a question with other numbers or names still meets its original.

A first pass forms only hashes of windows and looks for documents that hold enough windows of
an item; slots are formed for those documents alone.  Slots must then be consistent: along one alignment
of document and item, each value of the item stands for the value that it stands for in most windows
(of ties for itself, else for the least); two values of the item may stand for the same one.  A window counts if all
its slots agree with that or if it is verbatim.  An item has leaked into a document if at least LEAST_WINDOWS of its
windows, or half of them if that is less, count in some alignment.

Null and empty texts have no windows.  Items of fewer than ``WINDOW`` words match nothing, and neither do empty tables.
Equal rows count once.  A null id is reported as null.  Only ids and texts are read, so other columns' names
can't clash.  The benchmark's windows are a table of known size: Spark broadcasts it below its threshold and
shuffles both sides beyond it.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitlens.session import cut

WINDOW = 8
LEAST_WINDOWS = 6
#: Units of measure that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb lbs oz t ml l s ms min h hr hrs seconds minutes hours days weeks months years "
    "meters metres kilometers kilometres miles inches feet yards grams kilograms pounds ounces liters litres gallons "
    "dollars euros cents percent degrees mph kph hz khz mhz ghz kb mb gb tb w kw v a"
)
#: Number words.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
)
#: Function words that often begin a sentence and are no names.
STARTERS = (
    "After All Also An And Any As At Because Before Both But By Can Could Do Does During Each Every Find For From Given Had Has Have He Her "
    "His How However If In Into Is It Its Let Many More Most No Not Now Of On One Or Our She Since So Some Than That The Their Then There "
    "These They This Those To Two Under Until Was We Were What When Where Which While Who Why Will With Would You Your"
)
#: Before a name, and before a capitalised word that may be one; their code points tell them from other words.
NAME, MAYBE = "\u0001", "\u0002"


def template(text):
    """The words of a text as an array, without case; names stand behind NAME, words that may be names behind MAYBE."""
    t = F.regexp_replace(text, r"(\d)[.,](?=\d)", "$1")
    t = F.regexp_replace(t, r"(\d)(?=\p{L})", "$1 ")
    t = F.regexp_replace(t, r"\p{Lu}(?<=[\p{Ll},;] .)\p{Ll}+", f"{NAME}$0")
    t = F.regexp_replace(t, r"\p{Lu}(?<![\p{L}\p{N}" + NAME + r"].)\p{Ll}+", f"{MAYBE}$0")
    return F.array_remove(F.split(F.lower(t), rf"[^\p{{L}}\p{{N}}{NAME}{MAYBE}]+"), "")


def _rest(x):
    return F.substring(x, 2, (1 << 31) - 1)


def _is_number(x):
    return F.ascii(x).between(48, 57) | x.isin(*NUMBERS.split())


def _is_unit(x, before):
    return x.isin(*UNITS.split()) & _is_number(before)


def _is_maybe(x):
    return (F.ascii(x) == 2) & ~_rest(x).isin(*STARTERS.lower().split())


def _placeholder(kind):
    return F.xxhash64(F.lit(NAME + kind))


def _once(column, name):
    """``explode(array(...))`` keeps the optimizer from writing an array's expression into what reads it twice."""
    return F.explode(F.array(column)).alias(name)


def _hashed(texts, key):
    """(key columns, tie, words, plain, named) of texts with a window or more: hashes of template words, read
    with words that may be names as words, and as names (null if there are none)."""
    words = texts.select(*key, F.xxhash64("text").alias("tie"), _once(template(F.col("text")), "words")).filter(F.size("words") >= WINDOW)
    plain = F.transform(
        "words",
        lambda x, i: F.when(F.ascii(x) == 1, _placeholder("p"))
        .when(F.ascii(x) == 2, F.xxhash64(_rest(x)))
        .when(_is_number(x), _placeholder("n"))
        .when(_is_unit(x, F.get("words", i - 1)), _placeholder("u"))
        .otherwise(F.xxhash64(x)),
    )
    named = F.zip_with("words", "plain", lambda x, h: F.when(_is_maybe(x), _placeholder("p")).otherwise(h))
    hashed = words.select("*", _once(plain, "plain"))
    return hashed.select("*", F.when(F.exists("words", _is_maybe), named).alias("named"))


def _eights(df, column, *others):
    """``df`` with the hashes of all windows of eight in place of hashes of words: of pairs, of pairs of pairs, of pairs of these."""
    assert WINDOW == 8
    for step in (1, 2, 4):
        h = F.col(column)
        longer = F.zip_with(F.slice(h, 1, F.size(h) - step), F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))
        df = df.select(*others, _once(longer, column))
    return df


def windows(texts: DataFrame, key) -> DataFrame:
    """(key columns, tie, n, at, window, reading, slots) of every window; ``n`` is the number of windows of the text.

    A window with words that may be names has two rows: in reading 1 they are words, in reading 2
    names.  Others have reading 0.  Slots are the placeholders' types and values.
    """
    hashed = _hashed(texts, key).withColumn("named", F.coalesce("named", "plain"))
    others = [*key, "tie", "words"]
    both = _eights(_eights(hashed, "plain", *others, "named"), "named", *others, "plain")

    def slots(names_too):
        value = lambda x, i: (
            F.when(F.ascii(x) == 1, F.concat(F.lit("p"), _rest(x)))
            .when(_is_maybe(x), F.concat(F.lit("p"), _rest(x)) if names_too else F.lit(None).cast("string"))
            .when(_is_number(x), F.concat(F.lit("n"), x))
            .when(_is_unit(x, F.get("words", i - 1)), F.concat(F.lit("u"), x))
        )
        return F.transform("words", value)

    found = both.select(*key, "tie", "plain", "named", "words", _once(slots(False), "as_words"))
    found = found.select(*key, "tie", "plain", "named", "as_words", _once(slots(True), "as_names"))

    def reading(k, i, hashes, values):
        inside = F.array_compact(F.slice(values, i + 1, WINDOW))
        return F.struct(k.alias("reading"), F.get(hashes, i).alias("window"), inside.alias("slots"))

    def readings(i):
        unsure = F.get("plain", i) != F.get("named", i)
        one = reading(F.when(unsure, 1).otherwise(0), i, "plain", "as_words")
        return F.struct((i + 1).alias("at"), F.when(unsure, F.array(one, reading(F.lit(2), i, "named", "as_names"))).otherwise(F.array(one)).alias("r"))

    every = F.transform(F.sequence(F.lit(0), F.size("plain") - 1), readings)
    each = found.select(*key, "tie", F.size("plain").alias("n"), F.explode(every).alias("w"))
    return each.select(*key, "tie", "n", "w.at", F.explode("w.r").alias("r")).select(*key, "tie", "n", "at", "r.window", "r.reading", "r.slots")


def _least(windows_of_item):
    return F.least(F.lit(LEAST_WINDOWS), F.ceil(windows_of_item / 2))


def suspects(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, tie) of documents that hold enough template windows of one of the ``items``, whatever their slots."""
    hashed = _hashed(docs.select("doc_id", "text"), ["doc_id"])
    read = hashed.select("doc_id", "tie", F.explode(F.array_compact(F.array("plain", "named"))).alias("h"))
    met = _eights(read, "h", "doc_id", "tie").select("doc_id", "tie", F.explode(F.array_distinct("h")).alias("window"))
    places = items.select("window", "item_id", "item_at", "item_windows").distinct()
    held = met.join(places, "window").groupBy("doc_id", "tie", "item_id", "item_windows").agg(F.count_distinct("item_at").alias("n"))
    return held.filter(F.col("n") >= _least(F.col("item_windows"))).select("doc_id", "tie").distinct()


def _same_text(docs, found):
    return docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_tie"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, tie, item_id, n_windows, item_windows, reworded) per document and item that has leaked into it.

    ``tie`` is a hash of the document's text; ``reworded`` says that windows were found with other slot values alone.
    """
    items = cut(
        windows(benchmark.select("item_id", "text").distinct(), ["item_id"]).select(
            "item_id", F.col("n").alias("item_windows"), F.col("at").alias("item_at"), "window",
            F.col("reading").alias("item_reading"), F.col("slots").alias("item_slots"),
        ),
        "items",
    )
    held = cut(suspects(docs, items).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")), "suspects")
    docs = docs.select("doc_id", "text")
    found = windows(docs.join(held, _same_text(docs, held), "left_semi"), ["doc_id"]).drop("n")
    # Alignments are tried with and without the windows in which words that may be names are names.
    tried = F.when((F.col("reading") == 2) | (F.col("item_reading") == 2), F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))
    text = ["doc_id", "tie", "item_id", "item_windows"]
    place = [*text, "shift", "tried"]
    hits = found.join(items, "window").select(
        *text, (F.col("at") - F.col("item_at")).alias("shift"), F.explode(tried).alias("tried"), "item_at",
        F.explode_outer(F.arrays_zip(F.col("slots").alias("theirs"), F.col("item_slots").alias("ours"))).alias("p"),
    )
    pairs = cut(hits.select(*place, "item_at", F.col("p.ours").alias("ours"), F.col("p.theirs").alias("theirs")).distinct(), "hits")
    times = F.count(F.lit(1)).over(Window.partitionBy(*place, "ours", "theirs"))
    changed = ~F.col("ours").eqNullSafe(F.col("theirs"))
    meant = F.min(F.struct(-F.col("times"), "changed", "theirs")).over(Window.partitionBy(*place, "ours"))
    judged = pairs.withColumn("times", times).withColumn("changed", changed).withColumn("meant", meant)
    counted = (
        judged.groupBy(*place, "item_at")
        .agg(F.max("changed").alias("changed"), F.bool_and(F.col("theirs").eqNullSafe(F.col("meant.theirs"))).alias("agrees"))
        .filter("agrees OR NOT changed")
        .groupBy(*text, "item_at")
        .agg(F.min("changed").alias("changed"))
    )
    return (
        counted.groupBy(*text)
        .agg(F.count(F.lit(1)).alias("n_windows"), F.max("changed").alias("reworded"))
        .filter(F.col("n_windows") >= _least(F.col("item_windows")))
        .select("doc_id", "tie", "item_id", "n_windows", "item_windows", "reworded")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, into which no item has leaked."""
    dirty = cut(leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).distinct(), "leaks")
    return docs.join(dirty, _same_text(docs, dirty), "left_anti")
