"""Text columns: normalising, hashing, counting, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and what is no word character, for Java's regex engine.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def normalise(c: Column) -> Column:
    """Lower case, no punctuation, single blanks. NULL stays NULL."""
    return collapse(F.regexp_replace(F.lower(c), NOT_WORD, ""))


def content_hash(title: Column, body: Column) -> Column:
    """SHA-256 (hex) of the normalised title and body; a missing part counts as empty."""
    none = F.lit("")
    return F.sha2(normalise(F.concat(F.coalesce(title, none), F.lit(" "), F.coalesce(body, none))), 256)


def words(c: Column) -> Column:
    """Pieces between white space, without empty ones."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of words; NULL text has 0."""
    return F.coalesce(F.size(words(F.coalesce(c, F.lit("")))), F.lit(0))


def summary(c: Column, length: int = 280) -> Column:
    """The first characters with white space collapsed, not trimmed."""
    return F.left(F.regexp_replace(c, r"\s+", " "), F.lit(length))


# The line openings that mark site furniture for the cleaner.
FURNITURE_OPENINGS = (
    r"also read|read more|read also|follow us|click here|subscribe|download the|sign up|"
    r"watch:|watch video|image credit|photo credit|(?:\()?with inputs from|first published|"
    r"get the latest|for more cricket news|follow [\p{L}\p{N}_]+(?: [\p{L}\p{N}_]+)? (?:on|for)\b"
)


def clean_text(c: Column) -> Column:
    """Without links, mail addresses and furniture lines; plain apostrophes; blank lines collapsed."""
    steps = [
        (r"https?://\S+|www\.\S+", " "),
        (r"\S+@\S+\.\w+", " "),
        (rf"(?imd)^\s*(?:{FURNITURE_OPENINGS}).*$", ""),
        (" ", " "),
        ("[‘’]", "'"),
        (r"[ \t]+", " "),
        (r"\n\s*\n+", "\n"),
    ]
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def embedding_text(title: Column, body: Column, n: int = 200) -> Column:
    """Title, then the first words of the cleaned body."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.array_join(F.slice(words(clean_text(F.coalesce(body, F.lit("")))), 1, n), " "))


def slug_words(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), "[-_/]+", " ")


def like_pattern(text: str) -> str:
    """A contains-pattern with the wildcards of LIKE escaped."""
    out = text
    for ch in ("\\", "%", "_"):
        out = out.replace(ch, "\\" + ch)
    return f"%{out}%"


def entity_token(c: Column) -> Column:
    """One token of a name: lower case, other characters become single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def pretty(c: Column) -> Column:
    """Display form of a token: upper case if it holds a digit, else title case."""
    return F.when(c.rlike(r"\d"), F.upper(c)).otherwise(F.initcap(F.regexp_replace(c, "_", " ")))


def normalise_name(c: Column) -> Column:
    """A name without quotes, possessive and leading article."""
    quotes = "[\"'“”‘’]"
    c = F.regexp_replace(strip(c), f"^{quotes}+|{quotes}+$", "")
    c = F.regexp_replace(c, "['’]s$", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?i)^the\s+", ""), r"\s+", " ")


def clean_author(c: Column) -> Column:
    """NULL for blank names, placeholders and links."""
    t = strip(c)
    bad = F.lower(t).isin("", "null", "none", "unknown", "n/a") | F.lower(t).startswith("http")
    return F.when(~bad, t)


def ago(time: Column, now: Column) -> Column:
    """How long before ``now`` in words: minutes under an hour, hours under a day, else days."""
    s = F.unix_timestamp(now) - F.unix_timestamp(time)
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, "just now").when(s < 3600, part(60, " min ago")).when(s < 86400, part(3600, " h ago")).otherwise(part(86400, " days ago"))
