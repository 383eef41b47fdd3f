"""Plain-text tokenization as native column expressions.

For text without markup these equal the page scanner's rules: digits joined over , and .,
apostrophes and other characters that are neither alphanumeric nor a break dropped with the
breaks that follow them (so their neighbours glue), ASCII lower case, split at breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inside of a character class: what ends a word.
BREAKS = r""" \t\n\r\x0b\x0c,.:;!?()"\[\]{}\-+"""


def nbsp_to_space(t: Column) -> Column:
    return F.regexp_replace(t, " ", " ")


def join_numbers(t: Column) -> Column:
    """1,000 -> 1000. Twice, as matches that share a digit don't overlap."""
    pattern = "([0-9])[,.]([0-9])"
    return F.regexp_replace(F.regexp_replace(t, pattern, "$1$2"), pattern, "$1$2")


def fold_apostrophes(t: Column) -> Column:
    return F.regexp_replace(t, "&rsquo;|&apos;|['’]", "")


def entities_to_space(t: Column) -> Column:
    return F.regexp_replace(t, r"&[^;<\s]*;?", " ")


def glue(t: Column, trailing: bool = True) -> Column:
    """Drops characters that are neither alphanumeric nor breaks; with trailing also the breaks behind them."""
    return F.regexp_replace(t, f"[^A-Za-z0-9{BREAKS}]+" + (f"[{BREAKS}]*" if trailing else ""), "")


def count_breaks(t: Column) -> Column:
    return F.length(t) - F.length(F.regexp_replace(t, f"[{BREAKS}]", ""))


def words_of(t: Column, glue_trailing: bool = True) -> Column:
    """Array of the words of a text, in order."""
    flat = F.lower(glue(join_numbers(nbsp_to_space(t)), glue_trailing))
    return F.filter(F.split(flat, f"[{BREAKS}]+"), lambda w: w != "")


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", glue_trailing: bool = True) -> DataFrame:
    """(doc_id, term, loc): every word with its 1-based place. No shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words_of(F.col(text_col), glue_trailing)).alias("loc", "term")).select(
        "doc_id", "term", (F.col("loc") + 1).alias("loc")
    )


def stem(w: Column) -> Column:
    """Suffix stripper: the first suffix that fits goes; after -ing and -ed a doubled last consonant does too."""
    n = F.length(w)

    def cut(k: int) -> Column:
        return w.substr(F.lit(1), n - k)

    def undouble(s: Column) -> Column:
        last = s.substr(F.length(s), F.lit(1))
        before = s.substr(F.length(s) - 1, F.lit(1))
        return F.when((last == before) & ~last.isin("l", "s", "z"), s.substr(F.lit(1), F.length(s) - 1)).otherwise(s)

    rules = [("ing", 6), ("ed", 5), ("ly", 5), ("ful", 6), ("ness", 7), ("es", 5), ("s", 4), ("er", 7)]
    out = None
    for suffix, least in rules:
        s = cut(len(suffix))
        s = undouble(s) if suffix in ("ing", "ed") else s
        hit = w.endswith(suffix) & (n >= least)
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return out.otherwise(w)


def sanitize_query(q: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(q, r"[^\x00-\x7f]", "")), r"""[^a-z0-9 "|()\-]""", "")


def html_escape(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def url_decode(t: Column) -> Column:
    """Percent decoding with + for space; text with a bad escape is kept as it is."""
    return F.coalesce(F.try_url_decode(t), t)


def page_number(request: Column, name: str = "p") -> Column:
    """The value of the request's parameter name, at least 1."""
    return F.greatest(F.coalesce(F.regexp_extract(request, rf"[?&]{name}=([0-9]{{1,9}})", 1).try_cast("int"), F.lit(1)), F.lit(1))


def rarest_first(words: Column, n_docs: Column) -> Column:
    """The distinct words of a query, those in the fewest documents first, equal ones in word order. n_docs: map from word to documents."""
    pairs = F.transform(F.array_distinct(words), lambda w: F.struct(F.coalesce(n_docs[w], F.lit(0)).cast("long").alias("n"), w.alias("w")))
    return F.transform(F.sort_array(pairs), lambda x: x["w"])


def place_in_sorted(values: Column, value: Column) -> Column:
    """0-based place of value in an ascending array, -1 if it isn't there."""
    return F.array_position(values, value).cast("int") - 1


def english_cut(tok: DataFrame, known: DataFrame, run: int = 20) -> DataFrame:
    """tok without what follows run words in a row that aren't in known (words of one or two letters neither
    count nor end a run; those over 30 letters are unknown). The word that completes the run is the last one kept."""
    w = Window.partitionBy("doc_id").orderBy("loc")
    long = F.octet_length("term") > 2
    marked = tok.join(known.select(F.col("word").alias("term"), F.lit(1).alias("k")).hint("broadcast"), "term", "left")
    bad = F.when(long & (F.col("k").isNull() | (F.octet_length("term") > 30)), 1).otherwise(0)
    good = F.when(long & (F.col("k") == 1) & (F.octet_length("term") <= 30), 1).otherwise(0)
    part = marked.withColumn("bad", bad).withColumn("part", F.sum(good).over(w))
    length = part.withColumn("run", F.sum("bad").over(Window.partitionBy("doc_id", "part").orderBy("loc")))
    dead = F.min(F.when((F.col("run") >= run) & (F.col("bad") == 1), F.col("loc"))).over(Window.partitionBy("doc_id"))
    return length.withColumn("dead", dead).where("dead is null or loc <= dead").select("doc_id", "term", "loc")
