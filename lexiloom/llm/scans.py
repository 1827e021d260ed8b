"""Continuous story text out of scanned pages (problem 2).

1. Furniture. Lines at a page's edges are page numbers by their form, or headers because they say the book's title, or come
   again on other pages of the book or in many books. Lines are compared by their glyphs (:func:`glyphs`), so a misread
   header is still found.
2. Broken words. A word broken at a line's or page's end is put together unless the corpus spells it with a hyphen.
3. Skip-gram vectors with negative samples, for every word of ``LEAST`` occurrences (:func:`trained`): the expected loss over all
   words and neighbours, minimised in turns over the vectors of words, each by itself, and over those of neighbours, whose sums
   are added up over the tasks. Neighbours share ``BUCKETS`` vectors.
4. Links. A rare word is linked to a far more frequent one that differs by plausible glyph edits only and is used alike by the
   vectors; an unseen word to the one that fits its neighbours best. Names, which are too rare for that, are judged by the letters
   that follow one another in names, and by the other reading of the page.
5. Reflow. Furniture goes, lines join, empty lines part paragraphs.

The vocabulary stays in tables. Each page asks about the words that aren't surely right, and gets the answers by joins; tasks share
only the hashes of at most ``FILTER`` frequent words, the vectors of neighbours and a table of letter sequences. Words beyond the filter
are asked about like others, so the filter saves work and decides nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import cut, join_small

#: Fewest occurrences of a word that is kept and has a vector, buckets of neighbours.
LEAST, BUCKETS = 5, 64
#: Size of vectors, negative samples for each neighbour, rounds and steps of training, weight that keeps vectors small.
SIZE, NEGATIVE, ROUNDS, STEPS, RIDGE = 16, 2.0, 2, 4, 0.02
#: Words whose hashes every task gets, 8 bytes each.
FILTER = 2_000_000
#: A link leads to a word at least so many times as frequent, whose neighbours it fits at most so much worse than that word itself.
RATIO, APART = 15, 1.0
#: Pages of a book, or books, on which a line at the edge must come again to be a header.
PAGES, BOOKS = 2, 5
#: The gain in log likelihood at which a name counts as misread; how much better than a word in brackets one with a letter must fit.
GAIN, MARGIN = 4.0, 0.5

#: What is misread for what, wrong form first.
MISREAD = [
    ("c", "e"), ("é", "e"), ("í", "i"), ("+", "t"), ("†", "t"), ("@", "a"), ("li", "h"), ("ii", "n"), ("ii", "u"), ("cl", "d"), ("0", "o"), ("1", "i"), ("1", "l"),
    ("5", "s"), ("|", "l"), ("6", "b"), ("9", "g"), ("2", "z"), ("(", "c"), ("rn", "m"), ("m", "rn"), ("v", "y"), ("ſ", "f"), ("vv", "w"), ("n", "ri"),
]
_PARTS = {
    "e": "c", "(": "c", "i": "l", "1": "l", "|": "l", "0": "o", "5": "s", "6": "b", "9": "g", "2": "z", "+": "t", "†": "t", "@": "a", "ſ": "f", "y": "v",
    "n": "ll", "u": "ll", "h": "ll", "d": "cl", "w": "vv", "m": "rll", "�": "",
}


class _Glyphs(dict):
    """The shapes of each character; letters without their accents. Characters are added as they are met."""

    def __missing__(self, code: int) -> str:
        plain = (c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        self[code] = out = "".join(_PARTS.get(c, c) for c in plain)
        return out


_GLYPHS = _Glyphs()
HYPHENS = "-‐‑¬\u00ad"
_ODD = re.compile("[0-9@+†|ſ(�]")
_NUMERIC = re.compile(r"[$€£#]?\d[\d.,:/%–-]*")
_EDGE = ".,!?;:…—“”\"'’‘)]}»«[{"
_CHUNK = re.compile(r"\S+")
_HYPHEN = re.compile(f"[{HYPHENS}]")
_BREAK = re.compile(rf"\S[{HYPHENS}](?!\S)")
_BROKEN = re.compile(rf"([^\W\d_][^\s]*?|[^\s]*[^\W\d_])[{HYPHENS}]\s*\Z")
_INNER = re.compile(rf"(\S*[^\W\d_])[{HYPHENS}]\s+(\S+)")
_NUMBER = r"(?:[\[(·•–—-]?\s*(?:[Pp][\w@]{0,3}\.?\s+|[Pp]\.\s*)?\d{1,4}(?:\s*/\s*\d{1,4})?\s*[\])·•–—|-]?)"
_PAGE_NUMBER = re.compile(rf"{_NUMBER}|[ivxlí1|]{{1,6}}")
_NUMBER_FIRST, _NUMBER_LAST = re.compile(rf"\A(?:{_NUMBER}|[ivxl]{{1,6}})\s+(?=\D)"), re.compile(rf"\s+(?:{_NUMBER}|[ivxlí1|]{{1,6}})\Z")
_FIRST_OF_NUMBER, _LAST_OF_NUMBER = set("[(·•–—-Pp0123456789ivxl"), set("0123456789])·•–—|-ivxlí")
_TITLE_SMALL = {"a", "an", "the", "and", "of", "for", "at", "in", "to", "on", "•", "·", "-", ":"}


@lru_cache(200_000)
def glyphs(text: str) -> str:
    """The text as the shapes it is made of: equal for texts that may be read as one another."""
    return text.lower().translate(_GLYPHS)


_LEVEL, _CHAPTER = glyphs("level"), glyphs("chapter")
_LEVEL_END = re.compile(rf"\s*(?:[•·]\s*)?{_LEVEL} \w{{1,4}}\Z")


def _title_case(line: str) -> bool:
    if line[-1:] in (".", ","):
        return False
    letter = False
    for chunk in line.split():
        w = chunk.strip(_EDGE)
        if w and w[0] not in "•·-[|" and w.lower() not in _TITLE_SMALL:
            if w[0].islower():
                return False
            letter = letter or w[0].isalpha()
    return letter


def edge_lines(text: str, title: str | None) -> list[tuple[int, str, bool]]:
    """``line_no, key, sure`` of the lines at the edges that are, or may be, furniture."""
    lines = text.split("\n")
    n = len(lines)
    first = list(islice((i for i in range(n) if lines[i] and not lines[i].isspace()), 2))
    last = list(islice((i for i in range(n - 1, -1, -1) if lines[i] and not lines[i].isspace()), 2))[::-1]
    name = glyphs(" ".join(title.split())) if title else None
    out = []
    for i in dict.fromkeys([*first, *last]):
        s = " ".join(lines[i].split())
        if len(s) < 40 and _PAGE_NUMBER.fullmatch(s):
            out.append((i + 1, "#", True))
            continue
        bare = s  # without a number at either end, which only certain characters can begin or end
        if bare[0] in _FIRST_OF_NUMBER:
            bare = _NUMBER_FIRST.sub("", bare)
        if bare[-1:] in _LAST_OF_NUMBER:
            bare = _NUMBER_LAST.sub("", bare)
        bare = bare or s
        g = glyphs(bare)
        rest = _LEVEL_END.sub("", g) if _LEVEL in g else g
        if rest == "" or name and (rest == name or g == name) or g.startswith(_CHAPTER + " ") and len(bare) < 60 and re.search(r"\d", bare):
            out.append((i + 1, g, True))
        elif _title_case(s):
            out.append((i + 1, glyphs(re.sub(r"\d+", "#", bare)), False))
    return out


def core(chunk: str) -> str:
    """A run of non-blanks without the punctuation around it; an opening bracket stays if it may be a misread letter."""
    return chunk.strip(_EDGE).rstrip("(")


def body(text: str, furniture) -> str:
    """The text without its furniture lines."""
    return "\n".join([x for i, x in enumerate(text.split("\n"), 1) if i not in furniture]) if furniture else text


def story(text: str, furniture: set[int]) -> list[tuple[int, str]]:
    """``line_no, line`` of the lines that are neither blank nor furniture."""
    return [(i, x) for i, x in enumerate(text.split("\n"), 1) if x and i not in furniture and not x.isspace()]


class Spelled(set):
    """The glyphs of words that are spelled with a hyphen, and how those words begin."""

    def __init__(self, words=(), beginnings=()):
        super().__init__(words)
        self.beginnings = set(beginnings)

    def begins(self, part: str) -> bool:
        return part in self.beginnings


class _Asked(Spelled):
    """Notes what is looked up and answers always the same."""

    def __init__(self, answer: bool):
        super().__init__()
        self.answer, self.words = answer, set()

    def __contains__(self, word: str) -> bool:
        self.words.add(word)
        return self.answer

    def begins(self, part: str) -> bool:
        self.beginnings.add(part)
        return self.answer


class Words:
    """The words of a page and where they are: ``word, line, line of its end, length of its first part``, put together when asked for."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.numbers: list[int] = []  # of the lines
        self.ends: list[int] = []  # how many words there are up to the end of each of those lines
        self.joined: dict[int, tuple[int, int, int]] = {}  # for words put together

    def __getitem__(self, i: int) -> tuple[str, int, int, int]:
        word = self.words[i]
        if i in self.joined:
            return (word, *self.joined[i])
        no = self.numbers[bisect_right(self.ends, i)]
        return word, no, no, len(word)

    def __iter__(self) -> Iterator[tuple[str, int, int, int]]:
        at = 0
        for no, end in zip(self.numbers, self.ends):
            for i, word in enumerate(self.words[at:end], at):
                yield (word, *self.joined.get(i, (no, no, len(word))))
            at = end

    def join(self, word: str, line: int, last: int, part: int) -> None:
        self.joined[len(self.words)] = line, last, part
        self.words.append(word)


def tokens(lines: list[tuple[int, str]], spelled: Spelled | None, after: str | None, before: str | None) -> tuple[Words, list[int], bool]:
    """The words of a page, broken ones put together: ``word, line, line of its end, length of its first part``.

    A line 0 is on another page. Also the lines at whose ends (or in which) a word is broken, and whether the last word goes on overleaf. ``spelled``
    has the glyphs of words that are spelled with a hyphen; ``after`` and ``before`` are the first word of the next page and
    the broken word at the end of the page before.
    """
    out, broken = Words(), []
    pending: tuple[str, int] | None = (before, 0) if before else None
    single, overleaf = len(lines) == 1, False

    def close(part: str, at: int, follow: str, line: int) -> None:
        if spelled is not None and glyphs(core(part) + "-" + core(follow)) in spelled:
            out.join(part + "-" + follow, at, line, len(part))
        else:
            out.join(part + follow, at, line, len(part))
            if at:
                broken.append(at)

    for k, (no, line) in enumerate(lines):
        chunks = line.split()
        if pending and chunks:
            close(*pending, chunks.pop(0), no)
            pending = None
        end = len(chunks) - 1
        first = 0 if single else max(end, 0)  # only the last word of a line may be broken, but any of a text of one line
        out.words += chunks[:first]
        for j in range(first, end + 1):
            chunk = chunks[j]
            if pending:
                close(*pending, chunk, no)
                pending = None
            elif chunk[-1] in HYPHENS and len(chunk) > 1 and chunk[-2].isalnum() and any(c.isalpha() for c in chunk):
                part = chunk[:-1]
                if j < end or k < len(lines) - 1:
                    pending = (part, no)
                    continue
                overleaf = True
                if after:
                    close(part, no, after, 0)  # what is wrong in the second part is on the next page
                elif spelled is None or not spelled.begins(glyphs(core(part)) + "-"):
                    broken.append(no)
            else:
                out.words.append(chunk)
        out.numbers.append(no)
        out.ends.append(len(out.words))
    return out, broken, overleaf


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def _bucket(word: str) -> int:
    return _hash(word) >> 7 & BUCKETS - 1


def keys(word: str) -> list[str]:
    """The glyphs that words must have to differ from ``word`` by plausible glyph edits only; "ri" may be read as "n"."""
    return list(dict.fromkeys([glyphs(word), *(glyphs(word[:i] + "ri" + word[i + 1 :]) for i, c in enumerate(word) if c == "n")]))


_NAME_LETTERS = "^$" + "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_LETTER = {c: i for i, c in enumerate(_NAME_LETTERS)}


class Letters:
    """How often three letters follow one another in names: a table over a fixed alphabet."""

    def __init__(self) -> None:
        self.n = np.zeros((len(_LETTER),) * 3, dtype=np.float64)

    def add(self, word: str, by: float = 1.0) -> None:
        at = [_LETTER.get(c) for c in f"^{word}$"]
        if None not in at:
            for x in zip(at, at[1:], at[2:]):
                self.n[x] += by

    def ready(self) -> "Letters":
        self.log, self.none = np.log((self.n + 0.1) / max(1.0, float(self.n.sum()))), math.log(0.1 / max(1.0, float(self.n.sum())))
        return self

    def likelihood(self, word: str) -> float:
        at = [_LETTER.get(c) for c in f"^{word}$"]
        return sum(self.none if None in x else self.log[x] for x in zip(at, at[1:], at[2:]))


class Shared:
    """What every task gets, of a size that doesn't grow with the pages beyond ``FILTER``."""

    def __init__(self, frequent: np.ndarray, contexts: np.ndarray | None = None, letters: Letters | None = None):
        self.frequent, self.contexts, self.letters = frequent, contexts, letters

    def surely(self, low: str) -> bool:
        """Whether a word is frequent and right; a False may be an unknown."""
        h = np.uint64(_hash(low))
        i = int(np.searchsorted(self.frequent, h))
        return i < len(self.frequent) and self.frequent[i] == h


def _plain(low: str) -> bool:
    """Numbers, single letters and marks, which are never misread words."""
    return not low or bool(_NUMERIC.fullmatch(low)) or len(low) == 1 and low.isalnum() or not any(c.isalpha() for c in low)


class Asking:
    """The words that a page asks about; remembers runs of characters that ask nothing."""

    def __init__(self, shared: Shared):
        self.shared, self.memo = shared, {}

    def __call__(self, chunk: str) -> tuple[str, ...]:
        if (m := self.memo.get(chunk)) is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            m = self.memo[chunk] = tuple(self._asks(core(chunk)))
        return m

    def _asks(self, word: str) -> dict[str, None]:
        low = word.lower()
        if _plain(low):
            return {}
        stem = low[:-2] if low.endswith(("'s", "’s")) else None
        if word[0] != "(" and self.shared.surely(stem or low):
            return {}
        out = dict.fromkeys([low, *([stem] if stem else []), *(low.split("-") if "-" in low else [])])
        if word[0] == "(":
            out |= self._asks(word[1:])
        return out


class Answers:
    """What is known of the words that the pages of a batch asked about."""

    def __init__(self, shared: Shared):
        self.shared = shared
        self.counts: dict[str, int] = {}
        self.links: dict[str, str] = {}
        self.nearby: dict[str, list[str]] = {}
        self.vectors: dict[str, np.ndarray] = {}
        self.spelled = Spelled()
        self.memo: dict[str, tuple[str, str, str | None, bool]] = {}
        self.fine: set[str] = set()  # runs of non-blanks that are right whatever stands around them

    def take(self, answers, spelled, beginnings) -> None:
        for r in answers or ():
            if r["n"] is not None:
                self.counts[r["word"]] = r["n"]
            if r["link"] is not None:
                self.links[r["word"]] = r["link"]
            self.nearby[r["word"]] = [f["word"] for f in r["near"] or ()]
            for f in r["near"] or ():
                self.counts[f["word"]] = f["n"]
                if f["word"] not in self.vectors and f["vector"] is not None:
                    self.vectors[f["word"]] = np.frombuffer(f["vector"], dtype=np.float32)
        self.spelled.update(spelled or ())
        self.spelled.beginnings.update(beginnings or ())

    def has(self, low: str) -> bool:
        return low in self.counts or self.shared.surely(low)

    def near(self, word: str) -> list[str]:
        """Frequent words that differ from ``word`` by plausible glyph edits only and aren't misread themselves."""
        return self.nearby.get(word, [])

    def fit(self, word: str, around: list[int]) -> float:
        """How well a word fits its neighbours by the vectors."""
        v = self.vectors.get(word)
        return float((self.shared.contexts[around] @ v).mean()) if v is not None and around else 0.0

    def likelihood(self, word: str) -> float:
        return self.shared.letters.likelihood(word)

    def name(self, word: str) -> str | None:
        """A likelier name one misread glyph away, if it gains enough."""
        low, base = word.lower(), None
        best, at = GAIN, None
        for wrong, right in MISREAD:
            i = low.find(wrong)
            while i >= 0:
                other = low[:i] + right + low[i + len(wrong) :]
                if base is None:
                    base = self.likelihood(low)
                # trigrams of a longer word cost more by themselves
                gain = self.likelihood(other) - base + (len(other) - len(low)) * 6.0
                if gain > best:
                    best, at = gain, other
                i = low.find(wrong, i + 1)
        return at

    def seen(self, chunk: str) -> tuple[str, str, str | None, bool]:
        """``core, low, right, decided`` of a run of non-blanks, as far as its neighbours don't matter; kept for the next time."""
        if (m := self.memo.get(chunk)) is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            word = core(chunk)
            low = word.lower()
            if low.endswith(("'s", "’s")) and self.has(low[:-2]):
                low = low[:-2]
            if _plain(low):
                m = (word, low, None, True)
            elif word[0] != "(" and self.has(low):
                m = (word, low, self.links.get(low), True)
            else:
                m = (word, low, None, False)
            self.memo[chunk] = m
            if m[3] and m[2] is None and "\ufffd" not in chunk:
                self.fine.add(chunk)
        return m

    def correct(self, chunk: str, around: list[int], other: "Other", known: set[str]) -> str | None:
        """What a run of non-blanks was, in lower case, if it seems misread; None if it seems right."""
        word, low, right, decided = self.seen(chunk)
        if decided or low in known:
            return None if low in known else right
        if word[0] == "(":
            inside = word[1:].lower()
            near = self.near(low)
            likely = self.has(inside) and inside not in self.links or inside in known
            if not near or likely and max(self.fit(f, around) for f in near) < self.fit(inside, around) + MARGIN:
                return self.correct(word[1:], around, other, known)
        near = self.near(low)
        if near:
            return max(near, key=lambda f: (self.fit(f, around), self.counts[f]))
        if "-" in low:
            parts = low.split("-")
            fixed = [self.links.get(p) or (p if self.has(p) else max(self.near(p), key=self.counts.get, default=p)) for p in parts]
            if fixed != parts and all(self.has(p) for p in fixed):
                return "-".join(fixed)
        if low not in other:  # the other reading of the page may have the same shapes as another word
            twin = other.twin(low)
            if twin:
                return twin if self.likelihood(twin) > self.likelihood(low) else None
        if _ODD.search(low) and re.search(r"[^\W\d_]", low) and not re.search(r"\d.*[.:/$%].*|^\d+(?:st|nd|rd|th|s)?$|\.\w", low):
            return self.name(low) or low.translate(str.maketrans({w: r for w, r in MISREAD if len(w) == 1 and not w.isalpha()}))
        return self.name(low) if word[:1].isupper() and word.isalpha() else None


_PAGES = "kind string, page_id bigint, book string, place int, title string, a string, b string"
#: The fields of the two readings of a page, by the table it is from.
FIELDS = {"ocr": ("ocr_pages.vision", "ocr_pages.unlimited"), "record": ("page_records.text",)}


def pages(ocr: DataFrame, records: DataFrame, library: DataFrame) -> DataFrame:
    """All pages as one table with their readings ``a`` and ``b``. ``place`` orders the pages of a book."""
    one = ocr.select(F.lit("ocr").alias("kind"), F.col("page_id").cast("bigint").alias("page_id"), F.col("lesson_id").alias("book"), (F.col("page") * 2).cast("int").alias("place"), "title", F.col("vision").alias("a"), F.col("unlimited").alias("b"))
    titles = cut(library.filter("id is not null and title is not null").groupBy(F.col("id").alias("book")).agg(F.min_by("title", "row_id").alias("title")))
    place = F.col("physical_page") * 2 + F.when(F.col("side") == "right", 1).otherwise(0)
    rec = records.select(F.lit("record").alias("kind"), F.col("page_id").cast("bigint").alias("page_id"), F.col("lesson_id").alias("book"), place.cast("int").alias("place"), F.col("text").alias("a"), F.lit(None).cast("string").alias("b")).filter("a is not null")
    named = join_small(rec.filter("book is not null"), titles, "book", "left")
    return one.filter("a is not null or b is not null").unionByName(named).unionByName(rec.filter("book is null").withColumn("title", F.lit(None).cast("string")))


def _readings(b: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """``field, text, values of the columns`` of every reading; a column ``x`` may be two, ``x_a`` and ``x_b``. ``row`` is the row's number."""
    names = set(b.schema.names)
    lists = [[range(b.num_rows)] * 2 if c == "row" else [b.column(c).to_pylist()] * 2 if c in names else [b.column(f"{c}_a").to_pylist(), b.column(f"{c}_b").to_pylist()] for c in columns]
    texts = [b.column("a").to_pylist(), b.column("b").to_pylist()]
    for i, kind in enumerate(b.column("kind").to_pylist()):
        for k, field in enumerate(FIELDS[kind]):
            if texts[k][i] is not None:
                yield (field, texts[k][i], *[x[k][i] for x in lists])


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)


_EDGE_KIND = pa.schema([("field", pa.string()), ("page_id", pa.int64()), ("book", pa.string()), ("place", pa.int32()), ("line_no", pa.int32()), ("key", pa.string()), ("sure", pa.bool_())])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _batch([(f, p, k, o, *e) for f, x, p, k, o, t in _readings(b, "page_id", "book", "place", "title") for e in edge_lines(x, t)], _EDGE_KIND)


def furniture(given: DataFrame) -> DataFrame:
    """``field, page_id, line_no`` of the lines that are only a running header, footer or page number."""
    edges = cut(given.mapInArrow(_edges, "field string, page_id bigint, book string, place int, line_no int, key string, sure boolean"))
    open_ = edges.filter("not sure and book is not null")
    again = open_.select("book", "key", "place").distinct().groupBy("book", "key").count().filter(F.col("count") >= PAGES).select("book", "key")
    common = open_.select("key", "book").distinct().groupBy("key").count().filter(F.col("count") >= BOOKS).select("key")
    line = ["field", "page_id", "line_no"]
    return edges.filter("sure").select(line).unionByName(join_small(open_, again, ["book", "key"], "left_semi").select(line)).unionByName(join_small(open_, common, "key", "left_semi").select(line)).distinct()


def spread(given: DataFrame) -> DataFrame:
    """Pages with the numbers of their furniture lines, ``furn_a`` and ``furn_b``: four at most each."""
    second = F.col("field") == FIELDS["ocr"][1]
    f = furniture(given).groupBy("page_id", F.when(F.col("field") == FIELDS["record"][0], "record").otherwise("ocr").alias("kind"))
    furn = f.agg(F.collect_set(F.when(~second, F.col("line_no"))).alias("furn_a"), F.collect_set(F.when(second, F.col("line_no"))).alias("furn_b"))
    return given.join(furn, ["kind", "page_id"], "left")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw: Counter = Counter()
        whole: list[str] = []
        for _, text, furn in _readings(b, "furn"):
            if len(whole) > 200_000:
                raw.update(whole)
                whole.clear()
            if not _HYPHEN.search(text):
                whole += body(text, furn).split()[1:]
                continue
            tail = True
            for _, line in story(text, set(furn or ())):
                # parts of broken words are no words; neither may be the first of a page
                chunks = line.split()
                if not _HYPHEN.search(line):
                    whole += chunks[1:] if tail else chunks
                    tail = False
                    continue
                for c in chunks:
                    if not tail and c[-1] not in HYPHENS:
                        whole.append(c)
                    tail = c[-1] in HYPHENS and len(c) > 1
        raw.update(whole)
        n: Counter = Counter()
        for c, k in raw.items():
            n[core(c).lower()] += k
        n.pop("", None)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array(np.array([_hash(w) for w in n], dtype=np.uint64).view(np.int64))], names=["word", "n", "h"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def word_vectors(counts: np.ndarray, contexts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The vector of each word (row of ``counts`` by bucket) that minimises the skip-gram loss against fixed vectors of neighbours.

    ``share`` is how often each bucket is drawn as a negative sample. Newton's method, all words at once.
    """
    seen = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    v = np.zeros((len(counts), contexts.shape[1]))
    for _ in range(STEPS):
        p = _sigmoid(v @ contexts.T)
        slope = (seen * (1 - p) - NEGATIVE * share * p) @ contexts - RIDGE * v
        bend = np.einsum("wc,ci,cj->wij", (seen + NEGATIVE * share) * p * (1 - p), contexts, contexts, optimize=True)
        v += np.linalg.solve(bend + RIDGE * np.eye(v.shape[1]), slope[:, :, None])[:, :, 0]
    return v


def _dense(b: pa.RecordBatch) -> np.ndarray:
    """Counts by bucket of the words of a batch."""
    out = np.zeros((b.num_rows, BUCKETS))
    cells = b.column("cells")
    row = np.repeat(np.arange(b.num_rows), np.diff(cells.offsets.to_numpy()))
    flat = cells.flatten()
    np.add.at(out, (row, flat.field("bucket").to_numpy(zero_copy_only=False)), flat.field("n").to_numpy(zero_copy_only=False))
    return out


def _pieces(b: pa.RecordBatch, most: int = 1000) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, most) for i in range(0, b.num_rows, most))


def trained(rows: DataFrame, share: np.ndarray, total: float) -> np.ndarray:
    """The vectors of neighbours, ``BUCKETS`` x ``SIZE``. ``rows``: ``cells`` of every word, at most ``BUCKETS`` each, with ``total`` counts.

    In each round the words' vectors follow from those of neighbours inside the tasks, and the slope and curvature of the loss for
    every neighbour are summed over all words: one Newton step. The driver gets ``BUCKETS`` rows.
    """
    contexts = np.random.default_rng(7).normal(size=(BUCKETS, SIZE))
    for _ in range(ROUNDS):
        shared = contexts

        def run(batches: Iterator[pa.RecordBatch], contexts=shared) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((BUCKETS, SIZE + SIZE * SIZE))
            for whole in batches:
                for b in _pieces(whole):
                    x = _dense(b)
                    v = word_vectors(x, contexts, share)
                    n, p = x.sum(1, keepdims=True), _sigmoid(v @ contexts.T)
                    sums[:, :SIZE] += (x * (1 - p) - NEGATIVE * n * share * p).T @ v
                    weight = (x + NEGATIVE * n * share) * p * (1 - p)
                    sums[:, SIZE:] += np.einsum("wc,wi,wj->cij", weight, v, v, optimize=True).reshape(BUCKETS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["c", "s"])

        parts = rows.select("cells").mapInArrow(run, "c int, s array<double>")
        added = parts.groupBy("c").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(SIZE)], F.array(*[F.sum(F.col("s")[SIZE + i]) for i in range(SIZE * SIZE)]).alias("bend")).collect()
        for r in added:
            slope, bend = np.array(r[1 : SIZE + 1]) / total, np.array(r["bend"]).reshape(SIZE, SIZE) / total
            ridge = RIDGE * max(share[r["c"]], 1.0 / BUCKETS)
            contexts[r["c"]] += np.linalg.solve(bend + ridge * np.eye(SIZE), slope - ridge * contexts[r["c"]])
    return contexts


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys(words):
    return words.map(keys)


@F.pandas_udf(T.StringType())
def _glyphs(words):
    return words.map(glyphs)


_READ_KIND = pa.schema(
    [("h", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("book", pa.string()), ("place", pa.int32())]
    + [(c, pa.string()) for c in ("first_a", "first_b", "last_a", "last_b")]
    + [(c, pa.list_(pa.string())) for c in ("words", "spelled", "begins")]
)
_READ = "h bigint, bucket int, n bigint, kind string, page_id bigint, book string, place int, first_a string, first_b string, last_a string, last_b string, words array<string>, spelled array<string>, begins array<string>"


def _broken_off(chunk: str) -> str | None:
    """The first part of a word that is broken at the end of a page."""
    return chunk[:-1] if len(chunk) > 1 and chunk[-1] in HYPHENS and chunk[-2].isalnum() and any(c.isalpha() for c in chunk) else None


def _read(hashes, sure, whole: bool):
    """One pass over the pages: the neighbours of every kept word, two on either side (``h, bucket, n``), and for each page its first
    words, those broken at its end, and what it asks: ``words, spelled, begins``. ``whole``: the hashes are of all kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_hashes, asking = hashes.value, Asking(sure.value)

        class Places(dict):
            """A number for each run of non-blanks; by number the hash of its word and what it asks."""

            def __init__(self) -> None:
                self.hashes, self.asks = [0], [()]

            def __missing__(self, chunk: str) -> int:
                self[chunk] = n = len(self.hashes)
                self.hashes.append(_hash(core(chunk).lower()))
                self.asks.append(asking(chunk))
                return n

        places = Places()
        for b in batches:
            if len(places) > 300_000:
                places = Places()
            own: list[int] = []
            apart: list[int] = []
            rows: list[int] = []
            size = b.num_rows
            words, spelled, begins = ([set() for _ in range(size)] for _ in range(3))
            ends: dict[str, list[str | None]] = {c: [None] * size for c in _READ_KIND.names[7:11]}
            for field, text, furn, row in _readings(b, "furn", "row"):
                furn = set(furn or ())
                chunks = body(text, furn).split()
                if chunks:
                    side = "b" if field == FIELDS["ocr"][1] else "a"
                    ends["first_" + side][row], ends["last_" + side][row] = chunks[0], _broken_off(chunks[-1])
                if _BREAK.search(text):
                    noted = _Asked(False)
                    read = tokens(story(text, furn), noted, None, None)[0]
                    own += [places[c] for c in read.words]
                    spelled[row] |= noted.words
                    begins[row] |= noted.beginnings
                    # the word may as well be spelled with the hyphen, or nothing may follow
                    other = [c for c in chunks if c[-1] in HYPHENS] + [read.words[i][:part] + "-" + read.words[i][part:] for i, (_, _, part) in read.joined.items()]
                    for c in other:
                        words[row].update(places.asks[places[c]])
                else:
                    own += [places[c] for c in chunks]
                own += (0, 0)  # keeps the texts apart
                apart.append(len(own))
                rows.append(row)
            numbers = np.array(own, dtype=np.int64)
            asks = np.flatnonzero(np.fromiter(map(bool, places.asks), dtype=bool, count=len(places.asks))[numbers])
            for n, k in zip(numbers[asks].tolist(), np.searchsorted(np.array(apart), asks, "right").tolist()):
                words[rows[k]].update(places.asks[n])
            lists = [pa.array([list(x) for x in c], pa.list_(pa.string())) for c in (words, spelled, begins)]
            page = [b.column(c).cast(_READ_KIND.field(c).type) for c in ("kind", "page_id", "book", "place")]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(size, f.type) for f in list(_READ_KIND)[:3]], *page, *[pa.array(x, pa.string()) for x in ends.values()], *lists], schema=_READ_KIND)
            inside = np.ones(len(numbers), dtype=bool)
            at = np.array(apart, dtype=np.int64)
            inside[at - 1] = inside[at - 2] = False
            hashed, word_of = np.unique(np.array(places.hashes, dtype=np.uint64), return_inverse=True)
            number = word_of[numbers]
            near = (hashed >> np.uint64(7) & np.uint64(BUCKETS - 1)).astype(np.int64)[number]
            at = np.minimum(np.searchsorted(kept_hashes, hashed), max(len(kept_hashes) - 1, 0))
            known = (kept_hashes[at] == hashed if len(kept_hashes) else np.zeros(len(hashed), bool)) | (not whole)
            kept = inside & known[number]
            found = []
            for d in (1, 2):
                ok = inside[d:] & inside[:-d]
                for w, k, x in ((number[d:], kept[d:], near[:-d]), (number[:-d], kept[:-d], near[d:])):
                    found.append((w * BUCKETS + x)[ok & k])
            flat, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashed[flat // BUCKETS].view(np.int64)), pa.array((flat % BUCKETS).astype(np.int32)), pa.array(n.astype(np.int64)), *[pa.nulls(len(flat), f.type) for f in list(_READ_KIND)[3:]]], schema=_READ_KIND)

    return run


class Tables:
    """The vocabulary as tables: kept words with their vectors, links, spellings with a hyphen; and what tasks share."""

    def __init__(self, placed: DataFrame, vectors: bool = True):
        narrow = placed.select("kind", "a", "b", "furn_a", "furn_b")
        vocabulary = cut(narrow.mapInArrow(_counted, "word string, n bigint, h bigint").groupBy("word", "h").agg(F.sum("n").alias("n")).filter("n > 0"))
        kept = vocabulary.filter(F.col("n") >= LEAST)
        g = cut(kept.withColumn("g", _glyphs("word")))
        near = g.select("word", "n", F.explode(_keys("word")).alias("g")).join(g.select("g", F.col("word").alias("to"), F.col("n").alias("m")), "g")
        near = cut(near.filter((F.col("word") != F.col("to")) & (F.col("m") >= RATIO * F.col("n"))).select("word", "to", "m"))
        sure = kept.join(near.select("word").distinct(), "word", "left_anti")
        spark = placed.sparkSession
        every, self.sure = _hashes(kept), spark.sparkContext.broadcast(Shared(_hashes(sure)))
        read = cut(placed.select("kind", "page_id", "book", "place", "a", "b", "furn_a", "furn_b").mapInArrow(_read(spark.sparkContext.broadcast(every), self.sure, len(every) < FILTER), _READ))
        by_page = read.filter("kind is not null")
        self.asks = by_page.select("kind", "page_id", "words", "spelled", "begins")
        end = lambda side, field: F.struct(field.alias("field"), F.col(f"first_{side}").alias("first"), F.col(f"last_{side}").alias("last"))
        self.ends = by_page.filter("book is not null").select("kind", "page_id", "book", "place", F.explode(F.array(end("a", F.when(F.col("kind") == "record", FIELDS["record"][0]).otherwise(FIELDS["ocr"][0])), end("b", F.lit(FIELDS["ocr"][1])))).alias("e")).select("e.field", "kind", "page_id", "book", "place", "e.first", "e.last").filter("first is not null")
        if vectors:
            cells = read.filter("kind is null").groupBy("h", "bucket").agg(F.sum("n").alias("n")).groupBy("h").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))  # at most BUCKETS
            contexts = cut(kept.join(cells, "h"))
            shares = {r[0]: r[1] for r in contexts.select(F.explode("cells").alias("c")).groupBy("c.bucket").agg(F.sum("c.n")).collect()}  # BUCKETS
            share = np.array([shares.get(c, 0) for c in range(BUCKETS)], dtype=float) ** 0.75
            share /= max(share.sum(), 1e-9)
            out = trained(contexts, share, float(max(sum(shares.values()), 1)))
        else:
            contexts, share, out = kept.withColumn("cells", F.array().cast("array<struct<bucket:int,n:bigint>>")), np.zeros(BUCKETS), np.zeros((BUCKETS, SIZE))

        def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Vectors, and how well each word fits its own neighbours: mean, deviation."""
            for whole in batches:
                for b in _pieces(whole):
                    x = _dense(b)
                    v = word_vectors(x, out, share) if vectors else np.zeros((b.num_rows, SIZE))
                    fit = v @ out.T
                    own = (x * fit).sum(1) / np.maximum(x.sum(1), 1)
                    yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), b.column("h"), pa.array([x.tobytes() for x in v.astype(np.float32)], pa.binary()), pa.array(own), pa.array(fit.std(1))], names=["word", "n", "h", "vector", "own", "spread"])

        self.words = cut(contexts.select("word", "n", "h", "cells").mapInArrow(described, "word string, n bigint, h bigint, vector binary, own double, spread double").withColumn("g", _glyphs("word")))
        if vectors:
            near = near.join(contexts.select("word", "cells"), "word").join(self.words.select(F.col("word").alias("to"), "vector", "own", "spread"), "to")

            def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for whole in batches:
                    for b in _pieces(whole):
                        x = _dense(b)
                        v = np.frombuffer(b"".join(b.column("vector").to_pylist()), dtype=np.float32).reshape(-1, SIZE).astype(float)
                        n = np.maximum(x.sum(1), 1)
                        fit = (x * (v @ out.T)).sum(1) / n
                        own, spread = b.column("own").to_numpy(), b.column("spread").to_numpy()
                        plain = np.array([w.isalpha() and w.isascii() for w in b.column("word").to_pylist()], dtype=bool)
                        # odd glyphs speak for themselves; a word that stands among other neighbours than ``to`` is a word of its own
                        ok = ~plain | (fit >= own - APART - 2 * spread / np.sqrt(n))
                        yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok)) for c in ("word", "to", "m")], names=["word", "to", "m"])

            near = near.mapInArrow(alike, "word string, to string, m bigint")
        self.links = cut(near.groupBy("word").agg(F.max_by("to", F.struct("m", "to")).alias("link")))
        self.right = self.words.join(self.links, "word", "left_anti")
        self.spelled = cut(self.words.filter("contains(word, '-')").select("g").distinct())
        rare = vocabulary.filter((F.col("n") < LEAST) & (F.length("word") >= 4))
        unlike = rare.select("word", F.explode(_keys("word")).alias("g")).join(self.words.select("g"), "g", "left_semi").select("word").distinct()

        def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = Letters()
            for b in batches:
                for w in b.column("word").to_pylist():
                    if w.isalpha():
                        t.add(w)
            at = np.flatnonzero(t.n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(t.n.ravel()[at])], names=["at", "n"])

        table = Letters()
        for r in rare.select("word").join(unlike, "word", "left_anti").mapInArrow(letters, "at bigint, n double").groupBy("at").agg(F.sum("n")).toLocalIterator():  # letters, cubed
            table.n.ravel()[r[0]] = r[1]
        self.broadcast = spark.sparkContext.broadcast(Shared(self.sure.value.frequent, out, table.ready()))

    def answers(self, words: DataFrame) -> DataFrame:
        """``word, n, link, near`` of the words asked about of which anything is known."""
        asked = words.select("word").distinct()
        near = asked.select("word", F.explode(_keys("word")).alias("g")).join(self.right.select("g", F.struct("word", "n", "vector").alias("f")), "g").filter(F.col("f.word") != F.col("word"))
        lists = near.groupBy("word").agg(F.array_sort(F.collect_list("f")).alias("near"))  # words of the same glyphs
        # vectors only where they decide: between several, or between a letter and a bracket
        lists = lists.withColumn("near", F.when((F.size("near") > 1) | F.col("word").startswith("("), F.col("near")).otherwise(F.transform("near", lambda f: f.withField("vector", F.lit(None).cast("binary")))))
        return asked.join(self.words.select("word", "n"), "word", "left").join(self.links, "word", "left").join(lists, "word", "left").filter("n is not null or near is not null")


def _hashes(words: DataFrame) -> np.ndarray:
    """The hashes of the most frequent words, sorted: ``FILTER`` at most."""
    few = words.select("h", "n").orderBy(F.desc("n"), "h").limit(FILTER).select("h").toArrow()
    return np.sort(few.column("h").to_numpy().view(np.uint64)) if few.num_rows else np.zeros(0, np.uint64)


_ASK_KIND = pa.schema([("kind", pa.string()), ("page_id", pa.int64()), *[(c, pa.list_(pa.string())) for c in ("words", "spelled", "begins")]])
_ASK = "kind string, page_id bigint, words array<string>, spelled array<string>, begins array<string>"


def _overleaf_asks(shared):
    """What pages ask about words that begin on one and end on the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = Asking(shared.value)
        for b in batches:
            rows = []
            for kind, page, part, follow in zip(*[b.column(c).to_pylist() for c in ("kind", "page_id", "part", "follow")]):
                words = dict.fromkeys([*asking(part + follow), *asking(part + "-" + follow)])
                rows.append((kind, page, list(words), [glyphs(core(part) + "-" + core(follow))], []))
            yield _batch(rows, _ASK_KIND)

    return run


@lru_cache(200_000)
def _low(chunk: str) -> str:
    return core(chunk).lower()


def _lows(text: str | None) -> set[str]:
    """The words of a text in small letters, with and without a possessive ending."""
    out = {_low(w) for w in (text or "").split()}
    return out | {w[:-2] for w in out if w.endswith(("'s", "’s"))}


@lru_cache(2_000)
def _titled(title: str | None) -> frozenset[str]:
    return frozenset(_lows(title))


class Other:
    """The words of the other reading of a page; read only when asked for."""

    def __init__(self, text: str | None):
        self.text, self.words, self.shapes = text, None, None

    def __contains__(self, low: str) -> bool:
        if self.words is None:
            self.words = _lows(self.text)
        return low in self.words

    def twin(self, low: str) -> str | None:
        """Another word of the same shapes; to be asked about words that aren't there themselves."""
        if self.shapes is None:
            self.shapes = {}
            for w in sorted(self.words):
                self.shapes[glyphs(w)] = w
        return self.shapes.get(glyphs(low))


def _judge(model: Answers, text: str, furn, title: str | None, other: str | None, after: str | None, before: str | None, with_text: bool = True) -> tuple[list[int], list[int], str | None]:
    """Lines with a broken word, lines with a misread one, and the clean text of a page, if it is wanted."""
    furn = set(furn or ())
    own = None  # where the words are matters only if one is in doubt
    if not with_text and not before and not _BREAK.search(text):
        raw, broken = body(text, furn).split(), []
    else:
        own, broken, _ = tokens(story(text, furn), model.spelled, after, before)
        raw = own.words
    known = rest = None
    misread: set[int] = set()
    cleaned, fine, seen = list(raw), model.fine, model.seen
    lost = "�" in text or "�" in (after or "")
    for i in [i for i, c in enumerate(raw) if c not in fine]:
        bare, _, right, decided = seen(raw[i])
        if right is None and decided:
            if lost and "�" in cleaned[i]:
                own = own or tokens(story(text, furn), None, None, None)[0]
                chunk, line, last, part = own[i]
                misread.add(line if chunk.index("�") < part else last)
                cleaned[i] = chunk.replace("�", ".")
            continue
        own = own or tokens(story(text, furn), None, None, None)[0]
        chunk, line, last, part = own[i]
        if known is None:
            known, rest = _titled(title), Other(other)
        around = [] if decided else [_bucket(seen(raw[j])[1]) for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(raw)]
        right = model.correct(chunk, around, rest, known)
        if "�" in chunk and right is None:
            misread.add(line if chunk.index("�") < part else last)
        if right:
            at, w = 0, chunk.lower()
            lead = max(w.find(bare.lower()), 0)
            while at < len(right) and lead + at < len(w) and w[lead + at] == right[at]:
                at += 1
            where = line if lead + at < part else last
            misread.add(where)
            shown = right.capitalize() if bare[:1].isupper() else right
            chunk = chunk.replace(bare, shown, 1)
        cleaned[i] = chunk.replace("�", ".")
    misread.discard(0)  # on another page
    if not with_text:
        return broken, sorted(misread), None
    gaps: set[int] = set()
    gap = False
    for no, line in enumerate(text.split("\n"), 1):
        if not line.strip():
            gap = True
        elif no not in furn:
            if gap:
                gaps.add(no)
            gap = False
    paragraphs: list[list[str]] = [[]]
    for (_, line, last, _), chunk in zip(own, cleaned):
        start = line or last
        if start in gaps and paragraphs[-1]:
            gaps.discard(start)
            paragraphs.append([])
        if line:  # a word that began overleaf is on the page before
            paragraphs[-1].append(chunk)
    return broken, sorted(misread), "\n\n".join(" ".join(p) for p in paragraphs if p)


_DONE = "field string, page_id bigint, broken array<int>, misread array<int>, furniture array<int>, text string"
_DONE_KIND = pa.schema([("field", pa.string()), ("page_id", pa.int64()), *[(c, pa.list_(pa.int32())) for c in ("broken", "misread", "furniture")], ("text", pa.string())])

def overleaf(ends: DataFrame) -> DataFrame:
    """``field, kind, page_id, after, before, part, follow``: the first word of the next page of pages that end in a broken
    word, or that word for the next page; the two parts of the word. ``ends``: ``first`` and ``last`` of every page that has words. Joined by
    place, so that a book of any length is spread; only the places of broken words and the two behind are looked at."""
    line = ["field", "book", "place"]
    asked = ends.filter("last is not null").select("field", "book", F.col("place").alias("own")).distinct().select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("step")).withColumn("place", F.col("own") + F.col("step"))
    order = F.struct("step", "page_id")
    met = asked.join(ends.select(*line, "page_id", "first", "last"), line).groupBy("field", "book", "own").agg(
        F.min_by("last", order).alias("last"), F.min_by("first", F.when(F.col("step") > 0, order)).alias("after"), F.min(F.when(F.col("step") > 0, F.col("step"))).alias("step")
    )
    none = F.lit(None).cast("string")
    here, next_ = F.struct(F.col("own").alias("place"), "after", none.alias("before"), "step"), F.struct((F.col("own") + F.col("step")).alias("place"), none.alias("after"), F.col("last").alias("before"), "step")
    parts = met.filter("step is not null").select("field", "book", F.explode(F.array(here, next_)).alias("x")).select("field", "book", "x.*").filter("after is not null or before is not null")
    turns = cut(ends.join(parts, line).filter("before is not null or last is not null"))
    page = ["field", "kind", "page_id"]
    after = turns.filter("before is null").groupBy(*page).agg(F.min_by("after", "step").alias("after"), F.first("last").alias("part"))
    return after.select("*", none.alias("before"), F.col("after").alias("follow")).unionByName(turns.filter("before is not null").select(*page, none.alias("after"), "before", F.col("before").alias("part"), F.col("first").alias("follow")))


def restored(ocr: DataFrame, records: DataFrame, library: DataFrame, with_text: bool = True, vectors: bool = True) -> DataFrame:
    """``field, page_id, broken, misread, furniture, text`` of every reading that isn't null.

    ``text`` is the clean page (null without ``with_text``); empty pages come out empty. A page delivered twice is restored twice. The next page is the
    one behind in the same book and field; where it is missing, a word broken at the page's end stays as it is. ``vectors`` off leaves
    everything to glyphs and counts, for comparison.
    """
    placed = cut(spread(pages(ocr, records, library)))
    tables = Tables(placed, vectors)
    shared, page = tables.broadcast, ["kind", "page_id"]
    turns = overleaf(tables.ends)
    both = turns.filter("part is not null and follow is not null").select(*page, "part", "follow").distinct()
    asks = tables.asks.unionByName(cut(both.mapInArrow(_overleaf_asks(tables.sure), _ASK)))
    words = asks.select(*page, F.explode("words").alias("word"))
    answers = join_small(words, cut(tables.answers(words)), "word")
    begins = tables.spelled.select(F.lit("begins").alias("what"), F.explode(F.expr("transform(filter(sequence(1, length(g)), i -> substring(g, i, 1) = '-'), i -> left(g, i))")).alias("word")).distinct()
    there = tables.spelled.select(F.lit("spelled").alias("what"), F.col("g").alias("word")).unionByName(begins)
    parts = F.concat(*[F.expr(f"transform({c}, w -> struct('{c}' as what, w as word))") for c in ("spelled", "begins")])
    spellings = join_small(asks.select(*page, F.explode(parts).alias("x")).select(*page, "x.what", "x.word"), cut(there), ["what", "word"], "left_semi")
    second = F.col("field") == FIELDS["ocr"][1]
    small = answers.select(*page, F.struct("word", "n", "link", "near").alias("answers"))
    small = small.unionByName(spellings.select(*page, *[F.when(F.col("what") == c, F.col("word")).alias(c) for c in ("spelled", "begins")]), allowMissingColumns=True)
    small = small.unionByName(turns.select(*page, *[F.when(second if side == "b" else ~second, F.col(c)).alias(f"{c}_{side}") for c in ("after", "before") for side in "ab"]), allowMissingColumns=True)
    lists = [F.collect_list(c).alias(c) for c in ("answers", "spelled", "begins")]
    facts = small.groupBy(*page).agg(*lists, *[F.max(c).alias(c) for c in ("after_a", "after_b", "before_a", "before_b")])  # about one page's words

    def _once(b: pa.RecordBatch) -> tuple[list, list, list]:
        """What the pages of a batch were told, each word once: it's the same wherever it was asked."""
        answers = b.column("answers").flatten()
        _, at = np.unique(answers.field("word").dictionary_encode().indices.to_numpy(zero_copy_only=False), return_index=True)
        return answers.take(pa.array(at)).to_pylist(), *[b.column(c).flatten().unique().to_pylist() for c in ("spelled", "begins")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = {f: i for i, f in enumerate(FIELDS["ocr"])}
        m = Answers(shared.value)
        for b in batches:
            if len(m.counts) > 300_000:
                m = Answers(shared.value)
            m.take(*_once(b))
            rows = []
            for field, text, a, b_, page_, title, furn, after, before in _readings(b, "a", "b", "page_id", "title", "furn", "after", "before"):
                broken, misread, clean_ = _judge(m, text, furn, title, b_ if others.get(field) == 0 else a if others.get(field) == 1 else None, after, before, with_text)
                rows.append((field, page_, sorted(set(broken)), misread, sorted(furn or ()), clean_))
            yield _batch(rows, _DONE_KIND)

    return placed.join(facts, page, "left").mapInArrow(run, _DONE)


def found(ocr: DataFrame, records: DataFrame, library: DataFrame) -> DataFrame:
    """``field_name, page_id, line_no, kind`` of every line that is furniture, ends in a broken word or has a misread one."""
    kinds = F.create_map(F.lit("furniture"), F.col("furniture"), F.lit("hyphen"), F.col("broken"), F.lit("misread"), F.col("misread"))
    return restored(ocr, records, library, with_text=False).select(F.col("field").alias("field_name"), "page_id", F.explode(kinds).alias("kind", "lines")).select("field_name", "page_id", F.explode("lines").alias("line_no"), "kind")


def clean(ocr: DataFrame, records: DataFrame, library: DataFrame) -> DataFrame:
    """``field_name, page_id, text``: every page as continuous paragraphs."""
    return restored(ocr, records, library).select(F.col("field").alias("field_name"), "page_id", "text")
