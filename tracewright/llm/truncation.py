"""Texts that were cut off, found by what their last words usually do.

In plain SQL over all texts: words are brought to a form (numbers, names of files, hosts and paths, and hashes to classes), the trigrams,
pairs and single words inside texts and those at ends are counted, and the final ones of each text are joined with the counts. A text is cut
(``inside``) if its final trigram is frequent inside texts and almost never final. A word that was itself cut in two makes a trigram that
occurs nowhere, so for the texts that this leaves the same counts are asked how often trigrams with the same two words go on with that word:
almost never, and it is ``broken``. Counts are of distinct texts, so copies of a text are no witnesses of its end. They are kept for 64-bit
hashes, and only for those that a Bloom filter of the asked ones lets through, so the shuffle holds little more than what is asked for (the
filter grows with the number of ends up to the engine's 8 MB; beyond, more keys pass it and are summed before the shuffle).
The constants are weights of evidence: a share is mixed with so many occurrences of the more general one, so that few observations don't
decide. A text of which a small corpus holds too few like ones is left alone there, and is judged once there are enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.bloom import bloom_filter, might_contain
from tracewright.session import cut, lookup, spread

#: A text whose last words are final in less than this share of their occurrences doesn't end there.
FINAL_SHARE = 0.012
#: A share is that of the trigram, mixed with this many occurrences of the share of its last pair, and that with the one of its last word;
#: first for words, then for marks and numbers.
MIXED = (10, 60)
#: So many occurrences are left out of each count: a text is no witness of its own end, nor are a few copies of it.
LEFT_OUT = (3, 1)
#: Two words of which at least this share of the occurrences in other texts stand before the last word belong to a closing line, if so many
#: other texts end with them.
CLOSING_SHARE = 0.25
CLOSING_TEXTS = 2
#: A last word that follows the words before it less often than this is broken. The share is that after two words, mixed with one occurrence of
#: the share after one, and that with one of whether the last word occurs elsewhere at all; in closing lines with the latter alone, once for each other end that they have. The text's
#: own end is left out.
FOLLOW_SHARE = 0.005
#: All words of a text with more words than this count together as so many, so that a few very long texts don't outvote the others.
LONG = 500
#: The last four words are looked for in so many last characters and what stands before them up to white space, as classes of words depend on
#: what is to the left; if there are fewer than eight words, in the whole text.
TAIL = 300

# Classes of words, applied in this order to the lower-cased text.
_CLASSES = (
    (r"\b(?:0x)?(?=[a-f]*[0-9])[0-9a-f]{8}(?:[0-9a-f]{24}(?:[0-9a-f]{8}(?:[0-9a-f]{24})?)?)?\b", " hash "),
    (r"(?<![\w])(?:[a-z]:)?[\\/][^\s,;\"“”)\]]*[^\s,;\"“”)\].:!?]", " path "),
    (r"(?<![\p{L}\d])\p{L}[\p{L}\d+\-]*(?:[._@][\p{L}\d+\-]+)+", " thing "),
    (r"\d+(?:[.:\-]\d+)*", "0"),
)
_TOKENS = r"\p{L}[\p{L}\p{M}]*|0|[^\s\p{L}\p{M}\p{Cf}]"
#: Dots that were put behind a break.
_DOTS = r"\s*(?:\.{2,}|…)\s*$"
_KEYS = ("k3", "k2", "k1", "p2", "p1")


def tokens(text: Column) -> Column:
    """The words and marks of a text by class; dots behind the end are dropped."""
    plain = F.lower(F.regexp_replace(text, _DOTS, ""))
    for pattern, name in _CLASSES:
        plain = F.regexp_replace(plain, pattern, name)
    return F.regexp_extract_all(plain, F.lit(_TOKENS), F.lit(0))


def final_keys(frame: DataFrame, row: str, text: str) -> DataFrame:
    """(row, h, i, word, mark, k3, k2, k1, p2, p1): two hashes of the text, whether the last word is a word or closes a sentence, the hashes of the last three, two and one words, and those of the two
    and the one before the last."""
    read = frame.filter(F.col(text).rlike(r"\S")).select(F.col(row).alias("row"), F.col(text).alias("text"))
    read = read.select("row", "text", F.xxhash64("text").alias("h"), F.hash("text").alias("i"))
    trimmed = F.rtrim("text")
    before = F.reverse(F.left(trimmed, F.greatest(F.length(trimmed) - TAIL, F.lit(0))))
    tail = tokens(F.right(trimmed, TAIL + F.length(F.regexp_extract(before, r"^\S*+", 0))))
    # explode(array(x)) keeps the optimiser from evaluating x once for each use
    read = read.select("row", "h", "i", "text", F.explode(F.array(tail)).alias("tail"))
    read = read.select("row", "h", "i", F.explode(F.array(F.when(F.size("tail") >= 8, F.col("tail")).otherwise(tokens(F.col("text"))))).alias("tail"))
    read = read.withColumn("w", F.concat(F.array(F.lit("^"), F.lit("^"), F.lit("^")), F.slice("tail", F.greatest(F.size("tail") - 3, F.lit(1)), F.lit(4))))
    read = read.select("row", "h", "i", F.explode(F.array("w")).alias("w"))
    a, b, c = (F.element_at("w", -i) for i in (3, 2, 1))
    return read.select("row", "h", "i", c.rlike(r"^\p{L}").alias("word"), c.rlike(r"^(?:[.!?。\"”“»)\]]|\p{So})").alias("mark"), F.xxhash64(a, b, c).alias("k3"), F.xxhash64(b, c).alias("k2"), F.xxhash64(c).alias("k1"), F.xxhash64(a, b).alias("p2"), F.xxhash64(b).alias("p1"))


def once(frame: DataFrame, text: str, ends: DataFrame) -> DataFrame:
    """(text): each distinct non-blank text. Only texts whose hash a Bloom filter knows as a repeated one are shuffled, equal ones as one."""
    again = bloom_filter(ends.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "h")
    texts = frame.filter(F.col(text).rlike(r"\S")).select(F.col(text).alias("text"), might_contain(again, F.xxhash64(text)).alias("again"))
    return texts.filter("not again").select("text").union(texts.filter("again").select("text").distinct())


def all_keys(frame: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(k, weight): the hashes of each trigram, pair and word of every text that ``wanted`` (a Bloom filter) lets through, and what each counts."""
    words = F.concat(F.array(F.lit("^"), F.lit("^"), F.lit("^")), tokens(F.col(text)), F.array(F.lit(""), F.lit("")))
    read = frame.filter(F.col(text).rlike(r"\S")).select(words.alias("w")).withColumn("n", F.size("w") - 2)
    parts = F.arrays_zip(F.slice("w", F.lit(1), F.col("n")).alias("a"), F.slice("w", F.lit(2), F.col("n")).alias("b"), F.slice("w", F.lit(3), F.col("n")).alias("c"))
    each = read.select(F.least(F.lit(1.0), LONG / F.col("n")).alias("weight"), F.inline(parts).alias("a", "b", "c"))
    keys = each.select("weight", F.explode(F.array(F.xxhash64("a", "b", "c"), F.xxhash64("a", "b"), F.xxhash64("a"))).alias("k"))
    return keys.filter(might_contain(wanted, F.col("k")))


def find_truncated(frame: DataFrame, row: str, text: str, final_share: float = FINAL_SHARE, follow_share: float = FOLLOW_SHARE) -> DataFrame:
    """(row, rule): the rows whose text breaks off; rule is ``inside`` (mid-sentence, tried first) or ``broken`` (mid-word).

    Null, empty and blank texts are no cases, and an empty table has none. Every text counts once in the statistics, however many copies
    it has; the verdict holds for all of them.
    Texts of fewer than three words are padded. Whole texts are counted. Ends are judged by the corpus: where an end is nothing but a
    sentence that all texts hold over eighty times for each time that they end with it, it counts as mid-text.
    """
    frame = spread(frame.select(row, text))
    ends = cut(final_keys(frame, row, text))
    keys = ends.select(F.explode(F.array(*_KEYS)).alias("k"))
    wanted = bloom_filter(keys, "k", items=len(_KEYS) * ends.count())
    counts = all_keys(once(frame, text, ends), "text", wanted).groupBy("k").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("m"))
    shape = ("word", "mark", *_KEYS)
    texts = ends.select("h", "i", *shape).distinct()
    final = texts.select(F.explode(F.array("k3", "k2", "k1")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("f"))
    nearly = texts.groupBy(F.col("p2").alias("k"), "k3").agg(F.count(F.lit(1)).alias("c")).groupBy("k").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("t"))
    zero = F.lit(0)
    table = counts.join(final, "k", "left").join(nearly, "k", "left").select("k", "n", "m", F.coalesce("f", zero).alias("f"), F.coalesce("c", zero).alias("c"), F.coalesce("t", zero).alias("t"))
    # Equal ends are judged once, so a last word that a third of the texts share is one row here.
    distinct = ends.select(*shape).distinct()
    long = distinct.select(F.struct(*shape).alias("key"), F.explode(F.array(*(F.struct(F.lit(name).alias("which"), F.col(name).alias("k")) for name in _KEYS))).alias("x"))
    joined = long.select("key", "x.which", "x.k").join(table, "k", "left")
    wide = joined.groupBy("key").agg(*(F.coalesce(F.max(F.when(F.col("which") == name, F.col(c))), zero).alias(f"{c}_{name}") for name in _KEYS for c in "nmfct"))
    word = F.col("key.word")
    out, mixed = (F.when(word, F.lit(x[0])).otherwise(F.lit(x[1])) for x in (LEFT_OUT, MIXED))
    less = lambda c: F.greatest(F.col(c) - out, zero)
    single = F.when(word, F.lit(0.0)).otherwise(less("f_k1") / (less("n_k1") + mixed))
    pair = (less("f_k2") + mixed * single) / (less("n_k2") + mixed)
    usual = (less("f_k3") + mixed * pair) / (less("n_k3") + mixed)
    other = lambda c: F.greatest(F.col(c) - 1, zero)
    seen = F.when(word & (other("m_k1") == 0), F.lit(0.0)).otherwise(F.lit(1.0))
    after_one = (other("m_k2") + seen) / (other("m_p1") + 1)
    closing = (other("c_p2") >= CLOSING_TEXTS) & (other("c_p2") >= CLOSING_SHARE * other("n_p2"))
    # where a closing line takes many words (a name, say), another one that is a word elsewhere is none too many
    kinds = F.greatest(other("t_p2"), F.lit(1))
    follow = F.when(closing, (other("m_k3") + kinds * seen) / (other("m_p2") + kinds)).otherwise((other("m_k3") + after_one) / (other("m_p2") + 1))
    # numbers and marks after words that occur nowhere else are left alone: most are signatures
    known = word | (other("m_p2") > 0)
    rule = F.when((usual < final_share) & ~closing & known, "inside").when(~F.col("key.mark") & (follow < follow_share), "broken")
    judged = wide.select("key.*", rule.alias("rule")).filter("rule is not null")
    # an end that a third of the texts share is spread over salts
    return lookup(ends, judged, list(shape), "row", "inner", rows=0).select(F.col("row").alias(row), "rule")


def truncation_report(frame: DataFrame, found: DataFrame, row: str, source: str, text: str) -> DataFrame:
    """(source, texts, cut, inside, broken, share) over the non-blank texts of each source; a null source is a source of its own."""
    marked = frame.filter(F.col(text).rlike(r"\S")).select(row, source).join(found.select(row, F.col("rule").alias("_rule")), row, "left")
    of = lambda rule: F.count(F.when(F.col("_rule") == rule, 1)).alias(rule)
    per = marked.groupBy(source).agg(F.count(F.lit(1)).alias("texts"), F.count("_rule").alias("cut"), of("inside"), of("broken"))
    return per.withColumn("share", F.round(F.col("cut") / F.col("texts"), 6))
