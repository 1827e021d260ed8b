"""Text functions as Column expressions, so that they stay inside code generation. Null in, null out, unless said otherwise.

Java's regular expressions are used throughout; ``(?U)`` where white space means any Unicode blank.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values ---------------------------------------------------------------------------------------------------------

#: Words: of extracted text, of the library builder, of dictation.
WORD = r"[A-Za-z0-9]+(?:[’'][A-Za-z]+)*(?:-[A-Za-z0-9]+)*"
BUILDER_WORD = r"[A-Za-z0-9]+(?:[-’'][A-Za-z0-9]+)*"
DICTATION_WORD = r"[A-Za-z]+(?:[.'’\-‑][A-Za-z]+)*"
TRANSCRIPT_WORD = r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*"
#: A final mark, with closing quotes.
FINAL_MARK = r"[.!?][\"'’”)]*\z"
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
ABBREVIATIONS = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "St.", "Mt.", "e.g.", "i.e.", "a.m.", "p.m.", "vs.", "etc.", "U.S.", "U.K."]
ARTIFACTS = ["[non-text]", "ground truth", "quick brown fox", "the image contains", "www.", "http://", "https://", "�", "||"]
DISPUTE_ARTIFACTS = ["[non-text]", "the ground truth", "the image", "quick brown fox", "||"]
IMPLAUSIBLE = ["i cannot", "i can't", "the image", "ground truth", "no text", "transcription"]
UNUSABLE = ["the image contains no text", "stylistic or background element", "must be ignored according to the rules"]
MINOR_WORDS = "a an and as at by for from in of on or the to with".split()
SUPPLEMENTS = ["Fire Safety Tips", "Discussion Questions", "Extension Activity", "Think About It", "Try This"]
FAILURE_REASONS = [
    ("No timestamp anchor", "missing-timestamp-anchor"),
    ("post-cut validation failed", "post-cut-validation"),
    ("quality gate failed", "quality-gate"),
    ("No matching source", "missing-source-audio"),
]
LEVELS = ["aa", *"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]

#: Stand-ins from the private use area: a protected full stop, a sentence's blank, a full stop before a closing quote.
_STOP, _GAP, _QUOTED = "\uE000", "\uE002", "\uE003"
_STRING = T.StringType()


# Normal forms ---------------------------------------------------------------------------------------------------------


def _normalizer(form: str):
    @F.pandas_udf(_STRING)
    def normal(s):
        return s.map(lambda x: x if x.isascii() else unicodedata.normalize(form, x), na_action="ignore")

    return normal


nfc, nfkc, _nfkd = _normalizer("NFC"), _normalizer("NFKC"), _normalizer("NFKD")


def unaccented(c: Column) -> Column:
    """Compatibility form without combining marks."""
    return F.regexp_replace(_nfkd(c), r"\p{M}", "")


def squeezed(c: Column) -> Column:
    """Each run of blanks as one, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"\A | \z", "")


def normalize_line(c: Column, compose: bool = True) -> Column:
    """Composed accents, no soft hyphens, U+FFFD as a full stop, single blanks, none before marks or inside curly quotes."""
    x = nfc(c) if compose else c
    x = squeezed(F.replace(F.replace(x, F.lit("\u00ad"), F.lit("")), F.lit("�"), F.lit(".")))
    for pattern, to in ((r"\s+([,.;:!?])", "$1"), (r"([“‘])\s+", "$1"), (r"\s+([”’])", "$1")):
        x = F.regexp_replace(x, pattern, to)
    return x


def repair_dotted_spacing(c: Column) -> Column:
    """Text whose blanks came out as full stops, which shows by two or more of them between letters."""
    letter = "A-Za-zÀ-ÿ"
    encoded = F.regexp_count(c, F.lit(rf"(?<=[{letter},;:])\.(?=[{letter}“‘])")) >= 2
    x = F.regexp_replace(c, r"\A\.{3,}", "")
    x = F.regexp_replace(x, r"\.(?=[”’\"'])", _QUOTED)
    x = F.regexp_replace(F.regexp_replace(x, r"\.{2,}\s*(?=[A-ZÀ-Þ“‘\"'])", _GAP), r"\.{2,}", " ")
    x = F.replace(F.replace(F.replace(x, F.lit("."), F.lit(" ")), F.lit(_GAP), F.lit(". ")), F.lit(_QUOTED), F.lit("."))
    x = normalize_line(x, compose=False)
    x = F.when(c.endswith(".") & ~x.rlike(FINAL_MARK), F.concat(x, F.lit("."))).otherwise(x)
    return F.when(encoded, x).otherwise(c)


# Words and sentences --------------------------------------------------------------------------------------------------


def words(c: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def count_words(c: Column, pattern: str = WORD) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def has_final_mark(c: Column) -> Column:
    return c.rlike(FINAL_MARK)


def protect_abbreviations(c: Column) -> Column:
    """Full stops of abbreviations, initials and decimals as a stand-in, which :func:`split_sentences` puts back."""
    x = c
    for a in ABBREVIATIONS:
        x = F.replace(x, F.lit(a), F.lit(a.replace(".", _STOP)))
    # initials before a name: any full stop behind a lone capital that further initials or a name follow
    x = F.regexp_replace(x, r"(?<=\b[A-Z])\.(?=\s*(?:[A-Z]\.\s*)+[A-Z][a-z])", _STOP)
    x = F.regexp_replace(x, rf"(?<={_STOP}\s{{0,9}}[A-Z])\.(?=\s*[A-Z][a-z])", _STOP)
    # of other rows of initials all full stops but the last
    x = F.regexp_replace(x, r"(?<=\b[A-Z])\.(?=[A-Z]\.)", _STOP)
    return F.regexp_replace(x, r"(?<=\d)\.(?=\d)", _STOP)


def split_sentences(c: Column, protect: bool = True) -> Column:
    """The sentences of a text as an array: up to a final mark with its closing quotes, unless a small letter or one of
    ``,;:`` follows. Text behind the last mark is left out, and so are sentences without a word."""
    x = protect_abbreviations(c) if protect else c
    cut = F.regexp_replace(x, r"([.!?]++[\"'’”)]*+)(?=\s*\z|\s*[^\s,;:\p{Ll}])", "$1\u0001")
    parts = F.split(cut, "\u0001")
    whole = F.slice(parts, 1, F.size(parts) - 1)
    out = F.transform(whole, lambda s: normalize_line(F.replace(s, F.lit(_STOP), F.lit(".")), compose=False))
    return F.filter(out, lambda s: s.rlike(WORD))


def normalize_word(c: Column) -> Column:
    """Small letters and digits only; numbers up to twenty as words."""
    bare = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    table = F.create_map(*[x for i, w in enumerate(NUMBER_WORDS) for x in (F.lit(str(i)), F.lit(w))])
    return F.coalesce(F.try_element_at(table, bare), bare)


def transcript_words(c: Column) -> Column:
    return F.filter(F.transform(words(c, TRANSCRIPT_WORD), normalize_word), lambda w: w != "")


def dictation_words(c: Column) -> Column:
    """``array<struct<word,before,after>>``; before and after are what stands around a word, without blanks.

    Together they give the sentence without its blanks. ``before`` is empty but for the first word.
    """
    solid = F.transform(F.split(c, DICTATION_WORD), lambda x: F.regexp_replace(x, r"(?U)\s", ""))
    zipped = F.zip_with(words(c, DICTATION_WORD), F.slice(solid, 2, F.greatest(F.size(solid) - 1, F.lit(0))), lambda w, a: F.struct(w.alias("word"), F.lit("").alias("before"), F.coalesce(a, F.lit("")).alias("after")))
    first = F.transform(F.slice(zipped, 1, 1), lambda x: x.withField("before", F.get(solid, F.lit(0))))
    return F.concat(first, F.slice(zipped, 2, F.greatest(F.size(zipped) - 1, F.lit(0))))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z]", "")


def dash_hint(c: Column) -> Column:
    return F.regexp_replace(c, "[A-Za-z]", "-")


def masked_hint(c: Column) -> Column:
    """The first letter, dashes for the rest."""
    return F.concat(F.left(c, F.lit(1)), F.repeat(F.lit("-"), F.greatest(F.length(c) - 1, F.lit(0))))


# Keys, titles, paths --------------------------------------------------------------------------------------------------


def title_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def vote_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def title_tokens(c: Column) -> Column:
    """Words of a title for matching: unaccented, ``&`` as "and", a title given twice in a row once."""
    t = F.regexp_extract_all(F.replace(F.lower(unaccented(c)), F.lit("&"), F.lit(" and ")), F.lit("[a-z0-9]+"), F.lit(0))
    half = (F.size(t) / 2).cast("int")
    twice = (F.size(t) > 0) & (F.size(t) % 2 == 0) & (F.slice(t, 1, F.greatest(half, F.lit(1))) == F.slice(t, half + 1, F.greatest(half, F.lit(1))))
    return F.when(twice, F.slice(t, 1, F.greatest(half, F.lit(1)))).otherwise(t)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"(?<=.)\.[^.]*\z", "")


def clean_file_title(path: Column) -> Column:
    """A lesson's title from its file name."""
    x = nfc(file_stem(path))
    for pattern in (r"(?i)\A[A-Z][ -]?\d+[ -]*", r"(?i)[- ]*raz_[a-z0-9_]+?(?:_clr)?\z", r"(?i)[- ]*S?书本\z", "书本"):
        x = F.regexp_replace(x, pattern, "")
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"\A[ _-]+|[ _-]+\z", "")


def audio_title(path: Column) -> Column:
    x = F.trim(nfkc(file_stem(path)))
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)\A[A-Z]\s*[-_ ]\s*\d{1,4}\s*[-_. ]*", ""), r"\A\d{1,4}\s*[-_. ]*", "")
    return F.regexp_replace(x, r"\A[ ._-]+|[ ._-]+\z", "")


def level_from_parent(path: Column) -> Column:
    """The first letter of the folder, else of the file, else ``?``."""
    folder = F.regexp_extract(F.upper(path), r"(?:\A|/)([A-Z])[^/]*/[^/]*\z", 1)
    file = F.regexp_extract(F.upper(path), r"(?:\A|/)([A-Z])[^/]*\z", 1)
    return F.when(folder != "", folder).when(file != "", file).otherwise("?")


def level_from_marker(path: Column) -> Column:
    """The letter of a path part that reads like "A级"; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(path, "(?i)/([A-Z])级", 1)), F.lit(""))


def level_from_folder(path: Column) -> Column:
    x = F.regexp_extract(F.upper(path), r"(?:\A|/)([A-Z])[^/]*/[^/]*\z", 1)
    return F.when(x != "", x).otherwise("?")


def source_number(path: Column) -> Column:
    return F.regexp_extract(F.upper(file_stem(path)), r"\A[A-Z][ -]?(\d+)", 1).try_cast("int")


def trailing_number(c: Column, missing: int = 9999) -> Column:
    return F.coalesce(F.regexp_extract(c, r"(\d+)\z", 1).try_cast("bigint"), F.lit(missing))


def expected_words(c: Column) -> Column:
    """The number behind "Word Count:", thousands separated by commas."""
    return F.replace(F.regexp_extract(c, r"(?i)Word Count:\s*([\d,]+)", 1), F.lit(","), F.lit("")).try_cast("int")


def font_family(c: Column) -> Column:
    x = F.regexp_replace(F.substring_index(c, "+", -1), r"(?is)-(?:bold|italic|roman|regular|medium|semibold|cn).*", "")
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def is_title_like(c: Column) -> Column:
    """Has words, each with a capital or minor."""
    w = words(c)
    return (F.size(w) > 0) & F.forall(w, lambda x: F.lower(x).isin(MINOR_WORDS) | F.left(x, F.lit(1)).rlike(r"\A\p{Lu}"))


def is_bold_heading(text: Column, fonts: Column) -> Column:
    """``fonts``: those of the line's words with a letter. At most twelve words, all bold or capitals, no moral."""
    bold = (F.size(fonts) > 0) & F.forall(fonts, lambda f: F.lower(f).contains("bold") | F.lower(f).contains("capitals"))
    return ~F.lower(text).startswith("moral:") & (count_words(text) <= 12) & bold & is_title_like(text)


def footer_title(lines: Column) -> Column:
    """The title in the first line of the kind "Title • Level D"."""
    t = F.filter(F.transform(lines, lambda x: normalize_line(F.regexp_extract(x, r"(?i)\A(.+?)\s*[•·]\s*Level\s+[A-Z]\b", 1), compose=False)), lambda x: (x != "") & ~F.lower(x).contains("leveled book"))
    return F.get(t, F.lit(0))


# Reviews and answers of models ------------------------------------------------------------------------------------------


def contains_any(c: Column, phrases: list[str]) -> Column:
    low = F.lower(c)
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: low.contains(p))


def odd_quotes(c: Column) -> Column:
    return F.regexp_count(c, F.lit('"')) % 2 == 1


def usable_text(c: Column) -> Column:
    x = normalize_line(c, compose=False)
    return (x != "") & ~x.rlike(r"\A\d{1,2}\z") & ~F.lower(x).contains("level d") & ~contains_any(x, UNUSABLE)


def plausible(c: Column) -> Column:
    return F.coalesce((c != "") & c.rlike(r"\p{L}") & ~contains_any(c, IMPLAUSIBLE), F.lit(False))


def clean_transcription(c: Column, title: Column) -> Column:
    """A model's answer without code fences, labels, place-holders and a leading title."""
    x = F.regexp_replace(F.trim(c), r"(?i)\A```(?:text)?\s*|\s*```\z", "")
    x = F.regexp_replace(x, r"(?i)\A(?:transcription|main story text)\s*:\s*", "")
    x = normalize_line(F.replace(F.replace(x, F.lit("[Non-Text]"), F.lit(" ")), F.lit("||"), F.lit(" ")), compose=False)
    lead = F.coalesce(title != "", F.lit(False)) & F.startswith(F.lower(x), F.concat(F.lower(title), F.lit(" ")))
    return F.when(lead, F.ltrim(F.substring(x, F.length(title) + 1, F.length(x)))).otherwise(x)


def is_disputed(title: Column, vision: Column, second: Column, used: Column) -> Column:
    """Whether a page needs a third reading."""
    picked = F.when(used == "unlimited_ocr", second).otherwise(vision)
    lead = (second != "") & F.startswith(F.lower(second), F.concat(F.lower(title), F.lit(" ")))
    return (used == "vision_fallback") | contains_any(second, DISPUTE_ARTIFACTS) | lead | odd_quotes(picked)


def parse_asr_output(c: Column) -> Column:
    """The transcript alone, without the language wrapper of the answer."""
    x = F.trim(F.coalesce(c, F.lit("")))
    head = F.lower(F.regexp_extract(x, r"(?is)\A(.*?)<asr_text>", 1))
    said = F.trim(F.regexp_extract(x, r"(?is)<asr_text>(.*)\z", 1))
    plain = F.trim(F.regexp_replace(x, r"\Alanguage\s+[A-Za-z(), -]+\s*", ""))
    return F.when(x.rlike("(?i)<asr_text>"), F.when(head.contains("language none") & (said == ""), "").otherwise(said)).otherwise(plain)


def parse_blocks(c: Column) -> Column:
    """``array<struct<type,x0,y0,x1,y1,text>>`` out of lines like ``type [x0, y0, x1, y1] text``; text may go over lines."""
    head = r"(?m)^([a-z_]+)\s+\[([0-9,\s]+)\]"
    raw = F.trim(c)
    heads = F.arrays_zip(F.regexp_extract_all(raw, F.lit(head), F.lit(1)).alias("type"), F.regexp_extract_all(raw, F.lit(head), F.lit(2)).alias("at"))
    bodies = F.split(raw, head)
    blocks = F.transform(
        heads,
        lambda h, i: F.struct(
            h["type"].alias("type"),
            F.transform(F.split(h["at"], ","), lambda v: F.trim(F.regexp_replace(v, r"\s", "")).try_cast("int")).alias("at"),
            normalize_line(F.coalesce(F.get(bodies, i + 1), F.lit("")), compose=False).alias("text"),
        ),
    )
    four = F.filter(blocks, lambda b: F.size(b["at"]) == 4)
    return F.transform(four, lambda b: F.struct(b["type"].alias("type"), *[F.get(b["at"], F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))], b["text"].alias("text")))


def failure_reason(c: Column) -> Column:
    out = F.when(F.lit(False), "")
    for phrase, name in FAILURE_REASONS:
        out = out.when(c.contains(phrase), name)
    return out.otherwise("other")


# Identifiers ----------------------------------------------------------------------------------------------------------


def normalize_username(c: Column) -> Column:
    return F.lower(F.trim(c))


def sentence_id(lesson: Column, position: Column) -> Column:
    return F.format_string("%s-S%03d", lesson, position)


def lesson_id(level: Column, position: Column, prefix: str = "RAZ") -> Column:
    return F.format_string(f"{prefix}-%s-%03d", level, position)


def id_part(c: Column, part: int) -> Column:
    return F.split_part(c, F.lit("-"), F.lit(part))


def cookie(c: Column, name: str) -> Column:
    """The value of a cookie out of a header; null if it has none."""
    return F.nullif(F.regexp_extract(c, rf"(?:\A|;\s*){name}=([^;]*)", 1), F.lit(""))


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def base64url(c: Column) -> Column:
    return F.rtrim(F.translate(F.base64(c), "+/", "-_"), F.lit("="))


def short_hash(c: Column) -> Column:
    return F.left(F.sha1(c), F.lit(12))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)
