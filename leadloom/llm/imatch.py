"""I-Match fingerprints with DataFrame functions only.

Terms are the distinct lower-case words of a text, hashed; the low bits of a hash are the
term's slot in a lexicon of fixed size. One aggregate counts the distinct texts of every
slot, and the lexicon keeps the slots whose frequency among them lies in a band (no words
that are everywhere, none that hardly anyone uses). A text's terms in the lexicon are
sorted, and several random subsets of the lexicon, at several rates, each hash the terms
that fall into them. The same is done with all terms of the text. The fingerprint is the
row of these hashes, lexicon first; a subset without terms is blank, and the lexicon's part
is blank as a whole where too few of the text's terms are in it.

Two fingerprints are compared by their lexicon parts, or if one of these is blank, by the
parts of all terms: so both sides are always told in the same words. They are as alike as
the share of equal hashes at the rate where most agree; blanks on both sides do not count.
Equal fingerprints are alike by 1.

Defined results: null text is empty text; only texts without words have the blank
fingerprint, and two of them are alike by 1 if the texts are equal, else by 0. The next
document is that of the next larger id, then of the next digest of the text (null ids first); the last one's is the
first. A table of one document is its own successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import texts
from leadloom.llm.graph import discard, written

SLOT_BITS = 20             # lexicon slots; the bitmap has a quarter of a megabyte, whatever the data
LOW_SHARE, HIGH_SHARE = 0.002, 0.1     # band of document frequency, as shares of the distinct texts
RATES = (16, 64, 256, 1024)     # a subset of rate r holds one lexicon term in r; powers of two up to 1024
ALL_RATES = (8, 32, 128, 512)   # the same of all terms; at the first rate every term is in a subset
ENOUGH_TERMS, ENOUGH_SHARE = 8, 4      # so many terms, and one in so many of the text's, must be in the lexicon
SUBSETS = 8                # of each rate
HEX = 8                    # digits of one hash
LEAST = 3                  # hashes at a rate, for the rate to be compared alone
BLOCK_ROWS = 2_000         # rows that are put in order together
MAX_BLOCKS, KEYS_PER_BLOCK = 8_192, 8
BLANK = "-" * HEX
NO_ID = -(1 << 63)
PART = len(RATES) * SUBSETS * HEX      # digits of the lexicon's part
TOTAL = -1                 # a slot that every text has


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")


def _slot(term: Column) -> Column:
    return term.bitwiseAND((1 << SLOT_BITS) - 1).cast("int")


def fit_lexicon(docs: DataFrame, low: float = LOW_SHARE, high: float = HIGH_SHARE) -> bytes:
    """Four slots a byte, over 64: which slots lie in the band of document frequency.

    Copies count once: they are reduced to one row by their digest, within a task first.
    """
    found = F.array_distinct(F.transform(words(F.col("text")), lambda w: _slot(F.xxhash64(w))))
    once_each = texts(docs).select(F.md5("text").alias("digest"), found.alias("slots")).dropDuplicates(["digest"])
    slots = once_each.select(F.explode(F.concat(F.array(F.lit(TOTAL)), F.col("slots"))).alias("slot"))
    counts, path = written(slots.groupBy("slot").count(), "slot-counts")      # at most one row per slot
    whole = counts.where(F.col("slot") == TOTAL).first()
    total = whole["count"] if whole else 0
    inside = counts.where((F.col("slot") != TOTAL) & (F.col("count") >= F.lit(low * total)) & (F.col("count") >= 2)
                          & (F.col("count") <= F.lit(high * total)))
    quads = inside.groupBy(F.shiftright("slot", 2).alias("quad")).agg(
        F.sum(F.call_function("shiftleft", F.lit(1), F.col("slot").bitwiseAND(3))).cast("int").alias("bits"))
    found = quads.toArrow()        # at most one row per four slots
    discard(docs.sparkSession, path)
    out = bytearray(b"@" * (1 << (SLOT_BITS - 2)))
    for quad, bits in zip(found.column("quad").to_pylist(), found.column("bits").to_pylist()):
        out[quad] = 64 + bits
    return bytes(out)


def in_lexicon(lexicon: bytes):
    """Whether a hashed term lies in the lexicon."""
    held = F.lit(bytearray(lexicon))

    def test(term: Column) -> Column:
        slot = _slot(term)
        code = F.ascii(F.substr(held, F.shiftright(slot, 2) + 1, F.lit(1)).cast("string"))
        return F.call_function("shiftright", code, slot.bitwiseAND(3)).bitwiseAND(1) == 1
    return test


def once(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def subset_hashes(terms: Column, rates: tuple[int, ...]) -> Column:
    """The hashes of sorted terms in every subset, one after another.

    At rate r the terms fall into r random parts, by bits of their hashes that
    the slot does not use; the first parts are the subsets.
    """
    def hashed(chosen: Column) -> Column:
        digits = F.lower(F.lpad(F.hex(F.xxhash64(chosen)), 16, "0"))
        return F.when(F.size(chosen) > 0, F.substring(digits, 1, HEX)).otherwise(F.lit(BLANK))

    def at_rate(k: int, rate: int) -> Column:
        part = lambda t: F.shiftright(t, SLOT_BITS + 10 * k).bitwiseAND(rate - 1)
        each = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
        return once(F.filter(terms, lambda t: part(t) < SUBSETS),
                    lambda few: F.transform(each, lambda j: once(F.filter(few, lambda t: part(t) == j), hashed)))

    return F.array_join(F.concat(*[at_rate(k, rate) for k, rate in enumerate(rates)]), "")


def fingerprint(text: Column, lexicon: bytes) -> Column:
    terms = F.sort_array(F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w))))

    def chosen(kept: Column, every: Column) -> Column:
        enough = (F.size(kept) >= ENOUGH_TERMS) & (F.size(kept) * ENOUGH_SHARE >= F.size(every))
        return F.when(enough, subset_hashes(kept, RATES)).otherwise(F.lit("-" * PART))

    return once(terms, lambda every: F.concat(
        once(F.filter(every, in_lexicon(lexicon)), lambda kept: chosen(kept, every)), subset_hashes(every, ALL_RATES)))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """How alike two fingerprints are; ``same``: whether the texts are equal."""
    lexical = (F.substr(a, F.lit(1), F.lit(PART)) != "-" * PART) & (F.substr(b, F.lit(1), F.lit(PART)) != "-" * PART)
    alike = F.when(lexical, _agreement(a, b, 0, RATES)).otherwise(_agreement(a, b, len(RATES), ALL_RATES))
    blank = F.replace(a, F.lit("-"), F.lit("")) == ""
    return F.when(same | ((a == b) & ~blank), F.lit(1.0)).otherwise(alike).cast("double")


def _agreement(a: Column, b: Column, level: int, rates: tuple[int, ...]) -> Column:
    """The share of equal hashes at the rate where most agree; the rates begin at ``level`` in the fingerprint."""
    piece = lambda c, i: F.substr(c, i * HEX + 1, F.lit(HEX))
    levels = []
    for k in range(level, level + len(rates)):
        spots = F.sequence(F.lit(k * SUBSETS), F.lit((k + 1) * SUBSETS - 1))
        levels.append(F.aggregate(
            spots, F.struct(F.lit(0).alias("equal"), F.lit(0).alias("used")),
            lambda s, i: F.struct(
                (s["equal"] + ((piece(a, i) == piece(b, i)) & (piece(a, i) != BLANK)).cast("int")).alias("equal"),
                (s["used"] + ((piece(a, i) != BLANK) | (piece(b, i) != BLANK)).cast("int")).alias("used"))))
    alone = [F.when(x["used"] >= LEAST, x["equal"] / x["used"]) for x in levels]
    equal, used = (sum((x[n] for x in levels[1:]), levels[0][n]) for n in ("equal", "used"))
    together = F.when(used > 0, equal / used).otherwise(F.lit(0.0))
    return F.coalesce(F.greatest(*alone), together)


def _search(cuts: list[tuple], key: Column) -> Column:
    """How many of the sorted ``cuts`` lie at or before ``key``, by bisection."""
    held = F.array(*[F.struct(F.lit(i).cast("long"), F.lit(d), F.lit(r).cast("long")) for i, d, r in cuts])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(s, _):
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        found = F.element_at(held, mid + 1) <= key
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & found, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(open_ & ~found, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    return F.aggregate(steps, start, halve)["lo"]


def with_next(docs: DataFrame, columns: list[str], rows_per_block: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``next_<column>`` of the document that follows by (id, digest of the text, row).

    The order is cut into blocks at keys that a sample of the rows gives, so that equal and
    missing ids are split as well; the texts are shuffled once, by block. The first row of a
    block goes, as a copy, to the block before too, where it closes the row of documents.
    ``docs`` must be a table's rows: the row number breaks ties between equal rows.
    """
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("i"), F.md5("text").alias("d"), F.col("_row").alias("r"))
    keys = docs.withColumn("_row", F.monotonically_increasing_id()).select(key.alias("_key"))
    total = docs.count()
    blocks = min(MAX_BLOCKS, -(-total // rows_per_block))
    cuts: list[tuple] = []
    if blocks > 1:
        share = max(1, total // (blocks * KEYS_PER_BLOCK))
        seen = keys.where(F.pmod(F.xxhash64("_key"), F.lit(share)) == 0).select("_key.*")      # MAX_BLOCKS * KEYS_PER_BLOCK rows or so
        found = sorted(zip(*seen.toArrow().to_pydict().values()))
        cuts = sorted({found[len(found) * k // blocks] for k in range(1, blocks)}) if found else []
    block = _search(cuts, F.col("_key")) if cuts else F.lit(0)
    rows = docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_key", key).withColumn("_block", block)
    firsts = rows.groupBy("_block").agg(F.min("_key").alias("_first"))             # one row per block
    order = Window.orderBy("_block")
    last = F.max("_block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = firsts.select("_block", "_first", F.coalesce(F.lag("_block").over(order), last).alias("_before"))
    spots = F.array(F.struct(F.col("_block").alias("at"), F.lit(False).alias("carried")),
                    F.struct(F.col("_before").alias("at"), F.lit(True).alias("carried")))
    told = rows.join(F.broadcast(before), "_block").withColumn("_spots", F.when(
        F.col("_key") == F.col("_first"), spots).otherwise(F.slice(spots, 1, 1)))
    line = Window.partitionBy("_at").orderBy("_carried", "_key")
    return (told.select(*docs.columns, "_key", F.inline("_spots").alias("_at", "_carried"))
            .select(*docs.columns, "_carried", *[F.lead(c).over(line).alias(f"next_{c}") for c in columns])
            .where(~F.col("_carried")).drop("_carried"))


def fingerprint_edits(docs: DataFrame, lexicon: bytes | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the start of the next document."""
    lexicon = lexicon if lexicon is not None else fit_lexicon(docs)
    rows = texts(docs).withColumn("fingerprint", fingerprint(F.col("text"), lexicon))
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - tail), F.substr("next_text", F.lit(1), tail))
    paired = with_next(rows, ["text", "fingerprint"]).select(
        "doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"),
        (edited == F.col("text")).alias("unchanged"), (F.col("next_text") == F.col("text")).alias("repeated"))
    return paired.withColumn("edited_fingerprint", fingerprint(F.col("edited"), lexicon)).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("unchanged")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), F.col("repeated")).alias("near_next"))
