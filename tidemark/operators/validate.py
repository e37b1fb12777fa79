"""Whether a record is fit to keep, and why not."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import slug_words, strip, word_count

MIN_WORDS = 100
BODY_MENTIONS = 3
# Words that make a record relevant.
KEYWORDS = (
    "t20", "ipl", "indian premier league", "big bash", "bbl", "psl", "pakistan super league", "sa20",
    "cpl", "caribbean premier league", "wpl", "ilt20", "mlc", "t20i", "twenty20",
)


def keyword_pattern(keywords=KEYWORDS) -> str:
    return r"(?i)\b(" + "|".join(re.escape(k).replace(r"\ ", " ") for k in keywords) + r")\b"


def relevant(title: Column, url: Column, body: Column, keywords=KEYWORDS, mentions: int = BODY_MENTIONS) -> Column:
    """A keyword in the title or the words of the address, or several mentions in the body."""
    pattern = keyword_pattern(keywords)
    head = F.concat_ws(" ", F.coalesce(title, F.lit("")), slug_words(url))
    return head.rlike(pattern) | (F.coalesce(F.regexp_count(body, F.lit(pattern)), F.lit(0)) >= mentions)


def reason(title: Column, published: Column, url: Column, body: Column, min_words: int = MIN_WORDS, keywords=KEYWORDS) -> Column:
    """NULL for a fit record, else the first of missing_title, missing_date, too_short, off_topic."""
    return (
        F.when(strip(F.coalesce(title, F.lit(""))) == "", F.lit("missing_title"))
        .when(published.isNull(), F.lit("missing_date"))
        .when(word_count(body) < min_words, F.lit("too_short"))
        .when(~relevant(title, url, body, keywords), F.lit("off_topic"))
    )
