"""Problem 10: text decoded with the wrong character encoding.

Garbled forms of every distinct clean piece of the corpus are made under all encoding chains;
document pieces are hash-joined with that table, and verified originals put back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import one_row_per_id
from tidemark.session import Scratch, spread

# Encodings a text may be stored in, and those it may wrongly be read with.
WRITTEN = ("utf-8", "cp1252", "cp1251", "koi8-r", "cp866", "mac_roman", "cp850", "cp1250", "iso8859-5")
READ = ("latin-1", "cp1252", "cp1250", "cp1251", "mac_roman", "cp850", "cp437", "cp866", "koi8-r", "iso8859-2", "iso8859-15", "cp1254", "cp1253", "utf-8")

LOST = "�"
#: A clean original must be this many times as common as its garbled form, where the form could pass as a word.
MORE = 5
_RUN = re.compile(r"[^\x00-\x7f]+")
#: A last run with an ASCII letter or two behind it, as in a possessive.
_TAIL = re.compile(r"(?<=[a-z])[^\x00-\x7f]{1,3}[a-z]{1,2}$")
_BLANK = re.compile(r"[ \t-\r\x1c-\x1f]+")
_CONTROL = re.compile("[\x80-\x9f]")
#: The chain that leaves a lone letter of a curly quote: only what stands behind it tells.
TIDIED = "utf-8>latin-1-controls"
_EDGE = "\"'()[]{}<>.,;:!?*_-/|\\&%#=+~^`$@"


def _read(raw: bytes, encoding: str) -> str:
    """Bytes read with an encoding; those it doesn't define become control characters, as browsers do."""
    if encoding == "utf-8":
        return raw.decode("utf-8", "replace")
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in raw)


def garbled_forms(piece: str, written: tuple[str, ...] = WRITTEN, read: tuple[str, ...] = READ, steps: int = 2) -> Iterator[tuple[str, str, bool]]:
    """(form, chain, lossy): what a piece turns into, read wrongly once, or up to ``steps`` times as UTF-8.

    Also without the control characters and with a plain blank for the hard one, as pages are
    often tidied afterwards. A form is lossy if the piece can't be had back from it.
    """
    seen = {piece}

    def variants(text: str, chain: str, lossy: bool) -> Iterator[tuple[str, str, bool]]:
        if text not in seen and not text.isascii():
            seen.add(text)
            yield text, chain, lossy
        bare = "".join(ch for ch in text if not ("\x7f" <= ch <= "\x9f" or ch == "\xad"))
        for v, how in ((bare, "-controls"), (text.replace("\xa0", " ").strip(), "-blanks"), (bare.replace("\xa0", " ").strip(), "-both")):
            if v not in seen and v and not v.isascii() and " " not in v:
                seen.add(v)
                yield v, chain + how, True

    for w in written:
        try:
            raw = piece.encode(w)
        except UnicodeEncodeError:
            continue
        for r in read:
            if r == w:
                continue
            once = _read(raw, r)
            lossy = LOST in once
            yield from variants(once, f"{w}>{r}", lossy)
            text, chain = once, f"{w}>{r}"
            for _ in range(steps - 1):
                if w != "utf-8" or lossy:
                    break
                raw_again = text.encode("utf-8", "surrogatepass")
                for r2 in ("cp1252", "latin-1", r) if r in ("cp1252", "latin-1") else (r,):
                    yield from variants(_read(raw_again, r2), f"{chain}>{w}>{r2}", False)
                text, chain = _read(raw_again, r), f"{chain}>{w}>{r}"
        if w == "utf-8":
            yield from variants(LOST * len(raw), "utf-8>ascii", True)
            yield from variants(LOST, "utf-8>lost", True)


def pieces(text: str) -> tuple[set[str], set[str]]:
    """The words with a character beyond ASCII, and the runs of such characters and their parts.

    Only ASCII white space ends a word, as wrong decoding also makes hard blanks and control
    characters. Parts of two to four characters are taken of runs that could not be clean.
    """
    if text.isascii():
        return set(), set()
    words = {w.strip(_EDGE) for w in set(_BLANK.split(text)) if not w.isascii()}
    runs = {r for w in words for r in _RUN.findall(w)}
    parts = {r[i : i + k] for r in runs if len(r) > 2 and not plausible(r) for k in (2, 3, 4) for i in range(len(r) - k + 1)}
    tails = {w[m.start() :] for w in words for m in _TAIL.finditer(w)}
    return words, runs | parts | tails


def _near_letters(ch: str) -> bool:
    return ch in "’‘“”„«»—–…।"


def plausible(piece: str) -> bool:
    """Whether a piece could be clean.

    Characters beyond ASCII are letters or marks of one script, quotes and dashes, or emoji;
    other usual signs may stand in a piece, but not beside a letter of Latin, Greek or Cyrillic
    beyond ASCII.
    """
    if not piece:
        return False
    scripts, before = set(), ""
    for ch in piece:
        o = ord(ch)
        kind = ""
        if o < 128 or _near_letters(ch) or o >= 0x1F000:
            pass
        elif ch in "€£°½¼¾©®™¿¡•§·×÷":
            kind = "sign"
        elif 0xC0 <= o < 0x250:
            scripts.add("latin")
            kind = "letter"
        elif 0x900 <= o < 0x980:
            scripts.add("indic")
        elif ch.isalpha() and o >= 0x370:
            scripts.add(o >> 8)
            kind = "letter" if o < 0x530 else ""
        else:
            return False
        if {kind, before} == {"sign", "letter"}:
            return False
        before = kind
    return len(scripts) <= 1 and not (scripts == {4} and any(ch.isascii() and ch.isalpha() for ch in piece))


def alphabet() -> list[str]:
    """Letters and signs that any text may hold, whether or not this corpus has them clean: by Unicode range."""
    ranges = ((0xA1, 0x180), (0x391, 0x3CA), (0x401, 0x460), (0x905, 0x970), (0x2013, 0x2027))
    return [chr(o) for lo, hi in ranges for o in range(lo, hi) if o != 0xAD] + ["€", "™", "\u2039", "\u203a"]


@dataclass
class Damage:
    """pieces: (doc_id, copy, piece, word) of all documents; table: (piece, original, chain, lossy, sure)."""

    pieces: DataFrame
    table: DataFrame
    docs: DataFrame


def find_damage(df: DataFrame, key: str, text: str, scratch: Scratch | None = None, written: tuple[str, ...] = WRITTEN, read: tuple[str, ...] = READ, steps: int = 2) -> Damage:
    """Pieces of the corpus, and the garbled ones with their originals.

    The chains are those of every ``written`` encoding read as every other one in ``read``, and
    of UTF-8 read so up to ``steps`` times.

    Pieces are words that hold a character beyond ASCII and, so that rare names count too, the
    runs of such characters inside them. Counts are over all documents (once per document) and
    over distinct texts, so that copies of a garbled text don't make it common. Originals are
    pieces that could be clean, and the alphabet, whose counts are 0. A piece is garbled
    (``sure``) if it is a form of an original and could not be clean itself (two characters at
    least, or a control character), if it is three letters that a quote, dash or other sign
    turns into, or if the original is MORE times as common by either count. A whole word, be it
    of one such character only, is garbled if its original is a word of MORE times as many
    texts; if it could not be clean, any word with another letter in its place will do, and any
    commoner word. Anything that holds the replacement character is garbled. Null, empty and
    plain ASCII texts have no pieces. Repeated rows of an id count once.
    """
    scratch = scratch or Scratch(df.sparkSession, "damage")
    docs = spread(one_row_per_id(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id"), "doc_id")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, copies, out, kind = [], [], [], []
            for i, c, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "copy", "text"))):
                if not t:
                    continue
                words, runs = pieces(t)
                for group, is_word in ((words, True), (runs - words, False)):
                    ids += [i] * len(group)
                    copies += [c] * len(group)
                    out += group
                    kind += [is_word] * len(group)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "copy": pa.array(copies, pa.int64()), "piece": pa.array(out, pa.string()), "word": pa.array(kind, pa.bool_())})

    found = scratch.put(docs.withColumn("copy", F.xxhash64("text")).mapInArrow(split, "doc_id long, copy long, piece string, word boolean"), "pieces")
    once = found.groupBy("piece", "copy").agg(F.count("*").alias("n"), F.max("word").alias("word"))
    counts = scratch.put(once.groupBy("piece").agg(F.sum("n").alias("n"), F.count("*").alias("n_text"), F.count_if("word").alias("n_word"), F.max("word").alias("word")), "counts")

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (form, p, n, n_text, n_word, chain, lossy)
                for p, n, n_text, n_word in zip(*(b.column(c).to_pylist() for c in ("piece", "n", "n_text", "n_word")))
                if plausible(p)
                for form, chain, lossy in garbled_forms(p, written, read, steps)
            ]
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_pydict(
                {"piece": pa.array(cols[0], pa.string()), "original": pa.array(cols[1], pa.string()), "m": pa.array(cols[2], pa.int64()), "m_text": pa.array(cols[3], pa.int64()), "m_word": pa.array(cols[4], pa.int64()), "chain": pa.array(cols[5], pa.string()), "lossy": pa.array(cols[6], pa.bool_())}
            )

    schema = "piece string, original string, m long, m_text long, m_word long, chain string, lossy boolean"
    letters = df.sparkSession.createDataFrame([(ch, 0, 0, 0) for ch in alphabet()], "piece string, n long, n_text long, n_word long")
    clean = counts.select("piece", "n", "n_text", "n_word").unionByName(letters.join(counts, "piece", "left_anti").coalesce(1))
    table = clean.mapInArrow(forms, schema)
    # only forms that some document holds go on; each keeps its commonest original
    hit = table.join(counts, "piece")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sure = []
            names = ("piece", "original", "n", "m", "n_text", "m_text", "n_word", "m_word", "chain", "lossy", "word")
            for p, o, n, m, n_text, m_text, n_word, m_word, chain, lossy, word in zip(*(b.column(c).to_pylist() for c in names)):
                more = m >= MORE * n or m_text >= MORE * n_text
                letters = sum(not ch.isascii() for ch in p)
                whole = n_word > 0 and m_word > 0 and len(p) > letters  # words that stand for words
                if LOST in p or not plausible(p):
                    other = whole and (m_word > n_word or any(ch.isalpha() and not ch.isascii() for ch in o))
                    sure.append(letters >= 2 or LOST in p or bool(_CONTROL.search(p)) or other)
                elif letters >= 3 and chain.startswith("utf-8>") and not lossy and not any(map(str.isalnum, o)):
                    sure.append(True)  # three letters that a sign turns into, as letters of words don't stand together
                elif len(p) > letters and not word:
                    sure.append(more and chain == TIDIED)
                elif whole and m_word >= MORE * n_word:
                    sure.append(True)
                elif word and len(p) > letters:
                    sure.append((m >= n or m_text >= n_text) and chain == TIDIED and bool(_TAIL.search(p)) or letters >= 2 and not lossy and more)
                else:
                    sure.append(letters >= 2 and more and (letters >= 3 or not lossy))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sure, pa.bool_())], names=[*b.schema.names, "sure"])

    judged_schema = "piece string, original string, m long, m_text long, m_word long, chain string, lossy boolean, n long, n_text long, n_word long, word boolean, sure boolean"
    best = (
        hit.select("piece", "original", "m", "m_text", "m_word", "chain", "lossy", "n", "n_text", "n_word", "word")
        .mapInArrow(judged, judged_schema)
        .groupBy("piece")
        .agg(F.max("sure").alias("sure"), F.max(F.struct("sure", (~F.col("lossy")).alias("whole"), "m", "original", "chain")).alias("o"))
        .select("piece", F.col("o.original").alias("original"), F.col("o.chain").alias("chain"), (~F.col("o.whole")).alias("lossy"), "sure", F.col("o.m").alias("m"))
    )
    # pieces that hold the replacement character and are no form of a known original
    lost = counts.where(F.col("piece").contains(LOST)).select("piece", F.lit(None).cast("string").alias("original"), F.lit("lost").alias("chain"), F.lit(True).alias("lossy"), F.lit(True).alias("sure"), F.lit(0).cast("long").alias("m"))
    best = scratch.put(best, "forms")
    return Damage(found, scratch.put(best.unionByName(lost.join(best.select("piece"), "piece", "left_anti")), "table"), docs)


def damaged_documents(d: Damage) -> DataFrame:
    """(doc_id): documents that hold a garbled piece, restorable or not."""
    return d.pieces.join(d.table.where("sure").select("piece"), "piece", "left_semi").select("doc_id").distinct()


def restored(d: Damage) -> DataFrame:
    """(doc_id, text, n_restored, n_lost): damaged documents with verified originals put back.

    Longer pieces are put back first. A form that lost characters is put back only for a whole
    word whose original the corpus has twice or more; other lost pieces stay as they are.
    """
    bad = damaged_documents(d)
    fixes = (
        d.pieces.join(d.table, "piece")
        .where("(sure or not lossy) and original is not null")
        .join(bad, "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("piece", "original", "lossy", "sure", F.col("word").alias("word"), "m")).alias("fixes"))
    )
    work = d.docs.join(bad, "doc_id", "left_semi").join(fixes, "doc_id", "left").select("doc_id", "text", "fixes")

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, done, lost = [], [], []
            for t, fx in zip(b.column("text").to_pylist(), b.column("fixes").to_pylist()):
                fx = fx or []
                to = {f["piece"]: f["original"] for f in fx if f["sure"] and (not f["lossy"] or f["word"] and f["m"] >= 2 and len(f["piece"]) > 2)}
                n = Counter()
                if to:
                    any_of = re.compile("|".join(map(re.escape, sorted(to, key=lambda p: (-len(p), p)))))

                    def swap(m, to=to, n=n):
                        n["done"] += 1
                        return to[m[0]]

                    t = any_of.sub(swap, t)
                texts.append(t)
                done.append(n["done"])
                lost.append(t.count(LOST) + sum(t.count(f["piece"]) for f in fx if f["sure"] and f["piece"] not in to and LOST not in f["piece"]))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string()), "n_restored": pa.array(done, pa.int64()), "n_lost": pa.array(lost, pa.int64())})

    return work.mapInArrow(put_back, "doc_id long, text string, n_restored long, n_lost long")
