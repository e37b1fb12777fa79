"""Entities, terms, keywords and mood of texts."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clean_text, entity_token

MAX_CHARS, KEYWORD_CHARS, TOP_KEYWORDS = 30_000, 8_000, 10
#: Labels whose names votes may move; labels from the name list are trusted.
VOTING = ("PERSON", "ORG", "PLACE", "VENUE", "EVENT")
TOKEN = "[a-z][a-z0-9]+"
# A small mood lexicon for sports reports.
GOOD = ("win", "won", "wins", "best", "brave", "clinical", "proud", "happy", "calm", "fine", "grateful", "relieved", "stubborn", "steadied", "revived", "prize", "great", "superb")
BAD = ("lose", "lost", "loss", "injury", "injured", "dropped", "worst", "ragged", "scruffy", "nervy", "sore", "miss", "missed", "trouble", "troubled", "poor", "untidy", "stalled", "dearly")


def stop_words() -> list[str]:
    """English stop words as the ML library lists them."""
    return StopWordsRemover.loadDefaultStopWords("english")


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits that start with a letter."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def is_term(token: Column, stops: list[str], least: int = 3) -> Column:
    """Whether a token counts: long enough and no stop word. Meant for exploded tokens, where it compiles to a set lookup."""
    return (F.length(token) >= least) & ~token.isin(stops)


def fold_entities(text: Column, names: list[str]) -> Column:
    """The text with each name written as one token."""
    for n in sorted(names, key=len, reverse=True):
        text = F.replace(text, F.lit(n), entity_token(F.lit(n)))
    return text


def mentions(df: DataFrame, key: str, text: str, gazetteer: DataFrame, most_chars: int | None = MAX_CHARS) -> DataFrame:
    """(id, label, name, n): how often each document names an entry of the name list (alias, label, name).

    Texts are cut into runs of capitalised words, as many as the longest alias has, and these
    are joined with the aliases, so a long list costs a join and not a search per name; the
    longest alias at a place counts. ``most_chars`` is as far as texts are read; None is whole.
    """
    longest_alias = gazetteer.agg(F.max(F.size(F.split("alias", " "))).alias("k")).first()["k"] or 1
    whole = F.col(text) if most_chars is None else F.left(F.col(text), F.lit(most_chars))
    word = r"[\p{Lu}][\p{L}\p{N}'’-]*"
    spans = df.select(F.col(key).alias("id"), F.explode(F.regexp_extract_all(whole, F.lit(f"({word}(?: {word})*)"), F.lit(1))).alias("span"))
    grams = spans.select("id", "span", F.posexplode(F.split("span", " ")).alias("i", "_"), F.size(F.split("span", " ")).alias("len"))
    grams = grams.select("id", "span", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest_alias), F.col("len") - F.col("i")))).alias("k"))
    named = grams.select("id", "i", "k", F.xxhash64("span").alias("s"), F.array_join(F.slice(F.split("span", " "), F.col("i") + 1, F.col("k")), " ").alias("alias"))
    hit = named.join(gazetteer, "alias")
    # a span repeated in a document is counted through its multiplicity
    longest = hit.groupBy("id", "s", "i").agg(F.max(F.struct("k", "label", "name")).alias("m"), (F.count("*") / F.countDistinct("k", "label", "name")).cast("long").alias("n"))
    # an alias inside or across the end of one that begins before it is part of that
    before = Window.partitionBy("id", "s").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    longest = longest.withColumn("_end", F.max(F.col("i") + F.col("m.k")).over(before)).where("_end is null or _end <= i")
    return longest.groupBy("id", F.col("m.label").alias("label"), F.col("m.name").alias("name")).agg(F.sum("n").alias("n"))


def as_persons(ents: DataFrame) -> DataFrame:
    """(id, label, name, n) with names that a document has as PERSON anywhere, or longer names with a person's last word, made PERSON."""
    last = F.element_at(F.split("name", " "), -1)
    persons = ents.where("label = 'PERSON'").groupBy("id").agg(F.collect_set("name").alias("p"), F.collect_set(last).alias("surnames"))
    j = ents.join(persons, "id", "left")
    is_person = F.array_contains("p", F.col("name")) | ((F.size(F.split("name", " ")) >= 2) & F.array_contains("surnames", last))
    label = F.when(F.col("label").isin("ORG", "PLACE", "VENUE", "EVENT") & F.coalesce(is_person, F.lit(False)), F.lit("PERSON")).otherwise(F.col("label"))
    return j.select("id", label.alias("label"), "name", "n").groupBy("id", "label", "name").agg(F.sum("n").alias("n"))


def fold_surnames(ents: DataFrame) -> DataFrame:
    """One-word persons merged into the document's only full name that ends with them."""
    last = F.element_at(F.split("name", " "), -1)
    p = ents.where("label = 'PERSON'")
    full = p.where(F.size(F.split("name", " ")) > 1).groupBy("id", last.alias("surname")).agg(F.count("*").alias("c"), F.min("name").alias("full")).where("c = 1")
    one = F.size(F.split("name", " ")) == 1
    to = F.when((F.col("label") == "PERSON") & one & F.col("full").isNotNull(), F.col("full")).otherwise(F.col("name"))
    j = ents.join(full.select("id", F.col("surname").alias("name"), "full"), ["id", "name"], "left")
    return j.select("id", "label", to.alias("name"), "n").groupBy("id", "label", "name").agg(F.sum("n").alias("n"))


def votes(ents: DataFrame) -> DataFrame:
    """(name, label, articles): documents that give a name a label, of the labels that vote."""
    return ents.where(F.col("label").isin(*VOTING)).groupBy("name", "label").agg(F.countDistinct("id").alias("articles"))


def harmonise(ents: DataFrame, by: DataFrame) -> DataFrame:
    """(id, label, name, n) with names moved to the label most documents give them; a tie moves nothing."""
    w = Window.partitionBy("name").orderBy(F.desc("articles"), "label")
    ranked = by.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("articles").over(w))
    win = ranked.where((F.col("r") == 1) & (F.col("next").isNull() | (F.col("next") < F.col("articles")))).select("name", F.col("label").alias("winner"))
    j = ents.join(win, "name", "left")
    label = F.when(F.col("label").isin(*VOTING), F.coalesce("winner", "label")).otherwise(F.col("label"))
    return j.select("id", label.alias("label"), "name", "n").groupBy("id", "label", "name").agg(F.sum("n").alias("n"))


def entity_map(ents: DataFrame) -> DataFrame:
    """(id, entities): {label: {name: n}}, names by count."""
    inner = ents.groupBy("id", "label").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "name", "n"))), lambda s: F.struct(s["name"], s["n"]))).alias("names"))
    return inner.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "names")).cast("array<struct<label:string,names:map<string,bigint>>>"), lambda a, b: F.when(a["label"] < b["label"], -1).otherwise(1))).alias("entities"))


def keywords(df: DataFrame, key: str, text: str, stops: list[str], n: int = TOP_KEYWORDS) -> DataFrame:
    """(id, keywords): a document's commonest terms, ties by first place then term; words don't repeat over terms."""
    t = df.select(F.col(key).alias("id"), F.posexplode(tokens(F.left(clean_text(F.col(text)), F.lit(KEYWORD_CHARS)))).alias("pos", "term")).where(is_term(F.col("term"), stops))
    c = t.groupBy("id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "first", "term")
    top = c.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return top.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "term"))), lambda s: s["term"]).alias("keywords"))


def key_phrases(df: DataFrame, key: str, text: str, stops: list[str], n: int = TOP_KEYWORDS, longest: int = 3, pool: int = 60) -> DataFrame:
    """(id, phrases): phrases of one to three words by count times length, no word twice.

    A phrase neither begins nor ends with a stop word or a short word, and longer ones occur
    twice or more. Of the ``pool`` best of a document, each is taken whose words none before
    it has; ties go to the first place in the text.
    """
    ts = tokens(F.left(clean_text(F.col(text)), F.lit(KEYWORD_CHARS)))
    words = df.select(F.col(key).alias("id"), ts.alias("ts")).select("id", "ts", F.posexplode("ts").alias("pos", "w")).where(is_term(F.col("w"), stops))
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("ts") - F.col("pos"))))
    grams = words.select("id", "pos", F.col("ts"), size.alias("k")).select("id", "pos", "k", F.slice("ts", F.col("pos") + 1, F.col("k")).alias("g"))
    grams = grams.where(is_term(F.element_at("g", -1), stops))
    c = grams.groupBy("id", "g").agg(F.count("*").alias("c"), F.min("pos").alias("first"), F.max("k").alias("k")).where("k = 1 or c >= 2")
    w = Window.partitionBy("id").orderBy(F.desc(F.col("c") * F.col("k")), "first", F.desc("k"))
    best = c.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= pool).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rn", "g"))).alias("l"))
    none = F.array().cast("array<array<string>>")
    kept = F.aggregate("l", none, lambda acc, x: F.when((F.size(acc) < n) & ~F.arrays_overlap(F.flatten(acc), x["g"]), F.concat(acc, F.array(x["g"]))).otherwise(acc))
    return best.select("id", F.transform(kept, lambda g: F.array_join(g, " ")).alias("phrases"))


def sentiment(text: Column, good=GOOD, bad=BAD) -> Column:
    """Mean over sentences of three words or more of (good - bad) / sqrt((good - bad)^2 + 15); 0 without sentences."""
    g, b = F.array(*map(F.lit, good)), F.array(*map(F.lit, bad))
    sentences = F.filter(F.transform(F.split(F.lower(text), r"[.!?]+\s+|\n+"), lambda s: F.filter(F.split(s, r"[^a-z0-9'-]+"), lambda w: w != "")), lambda ws: F.size(ws) >= 3)
    score = lambda ws: (F.size(F.filter(ws, lambda w: F.array_contains(g, w))) - F.size(F.filter(ws, lambda w: F.array_contains(b, w)))).cast("double")
    each = F.transform(sentences, lambda ws: score(ws) / F.sqrt(score(ws) * score(ws) + 15))
    return F.coalesce(F.round(F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(each), F.lit(0)), 4), F.lit(0.0))


# Words that make a place name a ground.
VENUE = (
    r"(?i)\b(stadium|ground|oval|park|gardens?|arena|cricket club|sports? (?:city|complex)|academy|lord's|wankhede|chinnaswamy|chepauk|mcg|scg|"
    r"gabba|waca|wanderers|kingsmead|centurion|newlands|headingley|edgbaston|trent bridge|old trafford)\b"
)
# What a tagger's labels are called here, and openings that are no name.
TAGGER = {"PERSON": "PERSON", "ORG": "ORG", "FAC": "VENUE", "GPE": "PLACE", "LOC": "PLACE", "EVENT": "EVENT"}
NO_NAME = ("follow", "read", "watch", "also", "click", "subscribe")


def tagged(ents: DataFrame, stoplist: list[str] = []) -> DataFrame:  # noqa: B006
    """(id, label, name, n) of a tagger's (id, label, name, n): labels renamed, and names dropped that are none.

    Dropped are unknown labels, names of the stop list, of under three or over sixty
    characters or with a digit, footer phrases, and venues without a word for a ground.
    """
    label = F.coalesce(*[F.when(F.col("label") == a, F.lit(b)) for a, b in TAGGER.items()])
    low = F.lower("name")
    good = (
        label.isNotNull() & F.length("name").between(3, 60) & ~F.col("name").rlike(r"\d") & ~F.element_at(F.split(low, " "), 1).isin(*NO_NAME)
        & ((label != "VENUE") | F.col("name").rlike(VENUE))
    )
    if stoplist:
        good = good & ~low.isin(*[s.lower() for s in stoplist])
    return ents.where(good).select("id", label.alias("label"), "name", "n").groupBy("id", "label", "name").agg(F.sum("n").alias("n"))
