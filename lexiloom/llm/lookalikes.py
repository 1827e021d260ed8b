"""One form for texts that look the same (problem 5).

Cleaning is character by character: invisible characters go, any blank becomes an ordinary one, full-width forms,
ligatures and hyphen forms become their counterparts, accents are composed. Tabs and line ends stay: they show.

Letters of other alphabets are a matter of whole words. The dominant script of a word is the one whose letters have no
look-alike in another; its look-alikes from other scripts are replaced if the result is a word of the corpus: it stands
there by itself, or two different writings lead to it. A word of nothing but look-alikes has no script of its own; for
comparison it is written in Latin letters under the same condition. Texts are compared by what comes out, and by nothing else.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import cut, join_small

#: Letters of other alphabets and the Latin letter each looks like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХасеһіјорѕухԁԛԝ", "ABESIJKMHOPCTYXacehijopsyxdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανιορυχ", "ABEZHIKMNOPTYXaviopux"))
TO_LATIN = CYRILLIC | GREEK
TO_CYRILLIC = {v: k for k, v in CYRILLIC.items()}
TO_GREEK = {v: k for k, v in GREEK.items()}
HYPHENS = "‐‑﹣－"
IGNORED = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


class _Clean(dict):
    """What each character becomes; filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind, category = unicodedata.decomposition(c).partition(" ")[0], unicodedata.category(c)
        if category == "Zs":
            out = " "
        elif c.isspace():
            out = c
        elif code in IGNORED or category in ("Cf", "Cc"):
            out = ""
        elif c in HYPHENS:
            out = "-"
        elif kind in ("<wide>", "<narrow>", "<font>") or 0xFB00 <= code <= 0xFB06:
            out = unicodedata.normalize("NFKC", c)
        else:
            out = c
        self[code] = out
        return out


_CLEAN = _Clean()
_WORD = re.compile("(?:[^\\W\\d_]|[\u0300-\u036f])+")
_OTHER = re.compile("[Ͱ-ԯἀ-῿]")
_GOALS = (("latin", {}), ("cyrillic", TO_CYRILLIC), ("greek", TO_GREEK))


def clean(text: str) -> str:
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFC", text.translate(_CLEAN))


def script(c: str) -> str | None:
    code = ord(c)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "latin"
    if 0x400 <= code < 0x530:
        return "cyrillic"
    return "greek" if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000 else None


def _in_script(parts: str, goal: str, table: dict[str, str]) -> str:
    """The letters in one script, by way of their Latin look-alikes; those of no look-alike stay."""
    out = []
    for c in parts:
        if c.isalpha() and script(c) not in (goal, None):
            latin = TO_LATIN.get(c, c)
            c = latin if goal == "latin" else table.get(latin, c)
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def _possible(letters: list[str]) -> list[tuple[str, dict[str, str]]]:
    """The scripts in which a word can be written whole."""
    fits = lambda c, goal, table: script(c) in (goal, None) or (c in TO_LATIN if goal == "latin" else TO_LATIN.get(c, c) in table)
    return [(goal, table) for goal, table in _GOALS if all(fits(c, goal, table) for c in letters)]


def target(word: str) -> str:
    """The one writing of all words that look like ``word``: Latin if it can be, else the script that alone is left.

    A word with letters that stand for two scripts alone can't be written in one; its look-alikes become Latin letters.
    """
    parts = unicodedata.normalize("NFD", word)
    can = _possible([c for c in parts if c.isalpha()])
    return _in_script(parts, *(can[0] if can else _GOALS[0]))


def dominant(word: str) -> str | None:
    """A word of mixed script in its dominant one: most letters that stand for this script alone, then most letters."""
    parts = unicodedata.normalize("NFD", word)
    letters = [c for c in parts if c.isalpha()]
    have = {script(c) for c in letters} - {None}
    if len(have) < 2:
        return None
    alone = lambda c, goal: script(c) == goal and (c not in TO_CYRILLIC and c not in TO_GREEK if goal == "latin" else c not in TO_LATIN)
    can = [(sum(alone(c, g) for c in letters), sum(script(c) == g for c in letters), g, t) for g, t in _possible(letters) if g in have]
    return _in_script(parts, *max(can, key=lambda x: x[:2])[2:]) if can else None


def suspects(text: str) -> list[tuple[str, str, str | None]]:
    """``word, target, dominant`` of the words of a cleaned text that have letters of an alphabet they needn't be of."""
    if text.isascii() or not _OTHER.search(text):
        return []
    words = (w for w in dict.fromkeys(_WORD.findall(text)) if not w.isascii() and _OTHER.search(w))
    return [(w, t, dominant(w)) for w in words if (t := target(w)) != w]


_SUSPECT = pa.struct([("word", pa.string()), ("target", pa.string()), ("dominant", pa.string())])
_SCAN = "field string, row_id bigint, raw bigint, key binary, text string, suspects array<struct<word:string,target:string,dominant:string>>, word string"
_SCAN_KIND = pa.schema([("field", pa.string()), ("row_id", pa.int64()), ("raw", pa.int64()), ("key", pa.binary()), ("text", pa.string()), ("suspects", pa.list_(_SUSPECT)), ("word", pa.string())])


def _key(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _scanned(with_text: bool):
    """One pass over the raw texts: a row for each text, and one without ``row_id`` for each word met for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[str] = set()
        for b in batches:
            raw = b.column("raw").to_pylist()
            texts = [clean(t) for t in raw]
            odd = [suspects(t) for t in texts]
            hashes = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in raw]
            keys = [None if o else _key(t) for t, o in zip(texts, odd)]
            kept = texts if with_text else [t if o else None for t, o in zip(texts, odd)]
            lists = pa.array([[{"word": w, "target": t, "dominant": d} for w, t, d in o] for o in odd], pa.list_(_SUSPECT))
            none = lambda n, i: pa.nulls(n, _SCAN_KIND[i].type)
            n = len(raw)
            yield pa.RecordBatch.from_arrays([b.column("field"), b.column("row_id"), pa.array(hashes, pa.int64()), pa.array(keys, pa.binary()), pa.array(kept, pa.string()), lists, none(n, 6)], schema=_SCAN_KIND)
            if len(met) > 500_000:
                met.clear()
            new: set[str] = set()
            for t, o in zip(texts, odd):
                wrong = {w for w, *_ in o}
                new.update(w for w in _WORD.findall(t) if w not in met and w not in wrong)
            met |= new
            yield pa.RecordBatch.from_arrays([*[none(len(new), i) for i in range(6)], pa.array(list(new), pa.string())], schema=_SCAN_KIND)

    return run


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("form", T.StringType()), T.StructField("key", T.BinaryType())]))
def _repaired(texts, found):
    import pandas as pd

    out = []
    for t, ws in zip(texts, found):
        read, form = ({w["word"]: w[c] for w in ws if w[c]} for c in ("read", "form"))
        swap = lambda table: _WORD.sub(lambda m: table.get(m.group(), m.group()), t)  # noqa: B023, E731
        f = swap(form)
        out.append((swap(read), f, _key(f)))
    return pd.DataFrame(out, columns=["text", "form", "key"])


def canonical(df: DataFrame, with_text: bool = True) -> DataFrame:
    """``field, row_id, raw`` (a hash), ``text, form, key``: the readable canonical text, the form that is equal for all texts
    that look like it, and the hash of that. Takes ``field, row_id, raw``; null texts are left out.

    ``text`` has words of mixed script in their dominant one, if that is a word of the corpus; ``form`` has each word with
    look-alikes in one writing, if two writings, or a word of the corpus, lead to it. Without ``with_text`` both are null where no
    word is suspect. One pass over the texts; only rows with suspect words, and words, are shuffled.
    """
    scanned = cut(df.select("field", F.col("row_id").cast("bigint").alias("row_id"), "raw").filter("raw is not null").mapInArrow(_scanned(with_text), _SCAN))
    rows = scanned.filter("row_id is not null")
    odd = rows.filter("size(suspects) > 0")
    each = odd.select("field", "row_id", F.explode("suspects").alias("m")).select("field", "row_id", "m.*")
    pairs_ = each.select("word", "target", "dominant").distinct()
    vocabulary = scanned.select(F.col("word").alias("w")).filter("w is not null").distinct()
    asked = pairs_.select(F.col("target").alias("w"), "word").unionByName(pairs_.filter("dominant is not null").select(F.col("dominant").alias("w"), F.lit(None).cast("string").alias("word")))
    writings = asked.groupBy("w").agg(F.count_distinct("word").alias("n"))
    known = writings.join(vocabulary.withColumn("there", F.lit(True)), "w", "left").filter("there or n >= 2").select("w", F.coalesce("there", F.lit(False)).alias("there"))
    j = pairs_.join(known.select(F.col("w").alias("target"), F.lit(True).alias("_t")), "target", "left").join(known.filter("there").select(F.col("w").alias("dominant"), F.lit(True).alias("_d")), "dominant", "left")
    accepted = cut(j.filter("_t or _d").select("word", F.when(F.col("_t"), F.col("target")).alias("form"), F.coalesce(F.when(F.col("_d"), F.col("dominant")), F.when(F.col("_t") & F.col("dominant").isNotNull(), F.col("target"))).alias("read")))
    words = join_small(each.select("field", "row_id", "word"), accepted, "word").groupBy("field", "row_id").agg(F.collect_list(F.struct("word", "form", "read")).alias("words"))
    fixed = odd.join(words, ["field", "row_id"], "left").select("field", "row_id", "raw", _repaired("text", F.coalesce("words", F.array().cast("array<struct<word:string,form:string,read:string>>"))).alias("r")).select("field", "row_id", "raw", "r.*")
    return rows.filter("size(suspects) = 0").select("field", "row_id", "raw", "text", F.col("text").alias("form"), "key").unionByName(fixed)


def forms(df: DataFrame) -> DataFrame:
    """``field_name, row_id, text, form``: see :func:`canonical`."""
    return canonical(df).select(F.col("field").alias("field_name"), "row_id", "text", "form")


def fields(sentences: DataFrame, library: DataFrame) -> DataFrame:
    """Both text fields of the project as ``field, row_id, raw``."""
    return sentences.select(F.lit("sentences.english").alias("field"), F.col("row_id").cast("bigint").alias("row_id"), F.col("english").alias("raw")).unionByName(
        library.select(F.lit("course_library.title").alias("field"), F.col("row_id").cast("bigint").alias("row_id"), F.col("title").alias("raw"))
    )


#: Rows of one class that a task of the join of :func:`pairs` gets.
SHARE = 2000


def _several(df: DataFrame) -> DataFrame:
    """``field, key, row_id, raw, n, first`` of the rows of classes with two or more spellings.

    Classes are first reduced to the least and the largest hash of their raw texts; only rows of classes in which these differ
    go on, so a class of any size with one spelling costs nothing.
    """
    keyed = cut(canonical(df, with_text=False).select("field", "row_id", "key", "raw"))
    several = keyed.groupBy("field", "key").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first")).filter("lo != hi").select("field", "key", "n", "first")
    return cut(join_small(keyed, cut(several), ["field", "key"]))


def classes(df: DataFrame) -> DataFrame:
    """``field_name, row_id, class_id, n_spellings``: one row for each row whose text looks like that of another row written
    otherwise; ``class_id`` is the smallest row of the class. Linear in the rows, whatever the size of a class."""
    few = _several(df)
    n = few.select("field", "key", "raw").distinct().groupBy("field", "key").agg(F.count(F.lit(1)).alias("n_spellings"))
    return join_small(few, cut(n), ["field", "key"]).select(F.col("field").alias("field_name"), "row_id", F.col("first").alias("class_id"), "n_spellings")


def pairs(df: DataFrame) -> DataFrame:
    """``field_name, row_id_a, row_id_b`` of rows of one field that look the same but differ in characters.

    Empty texts look the same as texts of nothing but invisible characters. The definition asks for all pairs of different
    spellings; equal spellings aren't paired (see :func:`classes` for a linear form). Both sides are joined by a salt too, of
    which a class has one for each ``SHARE`` of its rows.
    """
    few = _several(df).withColumn("salts", F.ceil(F.col("n") / SHARE).cast("int"))
    a = few.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.col("salts")).cast("int")).alias("a")
    b = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("b")
    on = (F.col("a.field") == F.col("b.field")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.row_id") < F.col("b.row_id")) & (F.col("a.raw") != F.col("b.raw"))
    return a.join(b, on).select(F.col("a.field").alias("field_name"), F.col("a.row_id").alias("row_id_a"), F.col("b.row_id").alias("row_id_b"))
