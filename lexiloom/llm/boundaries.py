"""Sentence boundaries across languages and scripts (problem 6).

The rules are compiled into two finite transducers over character classes: one knows which quotation is open and so which marks
close it, the other where sentences begin. All texts of a batch form one sequence that is cut into chunks; each chunk becomes a
state-transition function, a parallel prefix scan composes them, and a second sweep reads off the result.

What needs words (abbreviations, initials, who speaks) is put into the class of one character. The words are learnt from all texts
(:func:`learnt`); the lists below are only where that starts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.fsm import Machine, code_points, slices
from lexiloom.session import cut

#: Character classes.
UPPER, LOWER, PLAIN, THAI, DIGIT, DOT, FULL, TRAIL, OPEN, CLOSE, QUOTE, BLANK, LINE, COMMA, SIGN, UNSEEN, GOES_ON, END = range(18)
#: States: inside a sentence, behind a mark, behind a mark and a blank (a second one: and a line end), behind an
#: unconditional mark, behind an ellipsis, behind Thai, behind Thai and a blank, behind one line end, behind an empty line.
INSIDE, MARK, GAP, GAP_LINE, MARK_FULL, TRAILING, IN_THAI, THAI_GAP, LINE_ONE, EMPTY_LINE = range(10)

#: Where learning starts: abbreviations that never end a sentence before a name, and those that don't before a number.
BEFORE_NAME = {
    "mr", "mrs", "ms", "dr", "prof", "rev", "gen", "sgt", "capt", "col", "lt", "maj", "cmdr", "gov", "sen", "rep", "hon", "st", "mt", "ft.-lt", "sra",
    "sr.a", "srta", "vs", "e.g", "i.e", "cf", "viz", "approx", "messrs", "mme", "mlle",
}
BEFORE_NUMBER = {
    "no", "nos", "fig", "figs", "p", "pp", "vol", "vols", "ch", "chap", "sec", "art", "eq", "ex", "jan", "feb", "mar", "apr", "jun", "jul", "aug",
    "sep", "sept", "oct", "nov", "dec", "approx", "ca", "ft", "oz", "lb", "lbs", "yd", "hr", "hrs", "min",
}
ENDING = {"a.m", "p.m", "etc"}
SPEAKING = [
    "said", "asked", "cried", "shouted", "whispered", "replied", "answered", "called", "yelled", "murmured", "exclaimed", "screamed", "added",
    "laughed", "sighed", "begged", "told", "muttered", "continued", "explained",
]

_STOPS = set(".!?．؟।॥…｡")
_WIDE = set("。！？｡")
_COMMAS = set(",;:，；：、،؛/")
_OPENS = set("“‘«‹「『（(【[《〈¿¡{")
_CLOSES = set("”’»›」』）)】]》〉}")


def _class_of(c: str) -> int:
    if c in "\n\x0b\x0c\x85\u2028\u2029":
        return LINE
    if c.isspace():
        return BLANK
    if c in _WIDE:
        return FULL
    if c == "…":
        return TRAIL
    if c in _STOPS:
        return DOT
    if c in _COMMAS:
        return COMMA
    if c in _OPENS:
        return OPEN
    if c in _CLOSES:
        return CLOSE
    if c in "\"'＂＇":
        return QUOTE
    kind = unicodedata.category(c)
    if kind in ("Mn", "Mc", "Me", "Cf", "Cc", "Cs"):
        return UNSEEN
    if kind == "Nd":
        return DIGIT
    if "฀" <= c <= "๿":
        return THAI
    return {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Lo": PLAIN, "Lm": PLAIN}.get(kind, SIGN)


_CLASSES = np.full(0x110000, PLAIN, dtype=np.uint8)
_CLASSES[:0x3100] = [_class_of(chr(i)) for i in range(0x3100)]
_CLASSES[0xA640:0xAC00] = [_class_of(chr(i)) for i in range(0xA640, 0xAC00)]
_CLASSES[0xD800:0xE000] = UNSEEN
_CLASSES[0xE000:0xF900] = SIGN
_CLASSES[0xFE00:0x10000] = [_class_of(chr(i)) for i in range(0xFE00, 0x10000)]
_CLASSES[0x1D400:0x1D800] = [_class_of(chr(i)) for i in range(0x1D400, 0x1D800)]
_CLASSES[0x1F000:0x1FB00] = SIGN
_CLASSES[0xE0000:0xE1000] = UNSEEN

_NEXT = np.zeros((10, 18), dtype=np.uint8)
_BEGINS = np.zeros((10, 18), dtype=bool)


def _compile() -> None:
    letters = (UPPER, LOWER, PLAIN, THAI, DIGIT, OPEN, SIGN)
    for s in range(10):
        for c in range(18):  # what holds for most states
            _NEXT[s, c] = {THAI: IN_THAI, DOT: MARK, FULL: MARK_FULL, TRAIL: TRAILING, UNSEEN: s, END: INSIDE}.get(c, INSIDE)

    def begin(state: int, *classes: int) -> None:
        for c in classes:
            _BEGINS[state, c] = True

    def go(state: int, to: int, *classes: int) -> None:
        for c in classes:
            _NEXT[state, c] = to

    go(INSIDE, LINE_ONE, LINE)
    go(LINE_ONE, LINE_ONE, BLANK)
    go(LINE_ONE, EMPTY_LINE, LINE)
    go(EMPTY_LINE, EMPTY_LINE, BLANK, LINE)
    begin(EMPTY_LINE, *letters, QUOTE)
    go(MARK, MARK, CLOSE, QUOTE)
    go(MARK, GAP, BLANK)
    go(MARK, GAP_LINE, LINE)
    begin(MARK, UPPER, PLAIN, THAI, OPEN)
    for s in (GAP, GAP_LINE):
        go(s, s, BLANK)
        go(s, GAP_LINE if s == GAP else EMPTY_LINE, LINE)
        go(s, GAP, CLOSE)
        begin(s, UPPER, PLAIN, THAI, DIGIT, OPEN, QUOTE, SIGN)
    go(MARK_FULL, MARK_FULL, CLOSE, QUOTE, BLANK, LINE, DOT, FULL, TRAIL)
    begin(MARK_FULL, *letters)
    go(TRAILING, TRAILING, TRAIL)
    go(TRAILING, MARK, CLOSE, QUOTE)
    go(TRAILING, GAP, BLANK)
    go(TRAILING, GAP_LINE, LINE)
    begin(TRAILING, UPPER, OPEN)
    go(IN_THAI, THAI_GAP, BLANK, LINE)
    go(THAI_GAP, THAI_GAP, BLANK, LINE)
    begin(THAI_GAP, UPPER, LOWER, PLAIN, THAI, OPEN, QUOTE)


_compile()
TRANSDUCER = Machine(_NEXT)

# Quotations: „…“ ‚…‘ »…« «…» beside “…” ‘…’, whose marks each have one meaning.
_LOW, _LOW_ONE, _LEFT, _LEFT_ONE, _OUT, _OUT_FIRST, _IN, _ELSE, _TEXT_END = range(9)
_NO_QUOTE, _IN_LOW, _IN_LOW_ONE, _IN_OUT, _IN_IN = range(5)
_QUOTES = np.tile(np.arange(5, dtype=np.uint8)[:, None], (1, 9))
_QUOTES[:, _TEXT_END] = _NO_QUOTE
_QUOTES[:, _LOW], _QUOTES[:, _LOW_ONE] = _IN_LOW, _IN_LOW_ONE
_QUOTES[_NO_QUOTE, [_OUT_FIRST, _IN]] = [_IN_OUT, _IN_IN]
_QUOTES[_IN_LOW, _LEFT] = _QUOTES[_IN_LOW_ONE, _LEFT_ONE] = _QUOTES[_IN_OUT, _IN] = _NO_QUOTE
_QUOTES[_IN_IN, [_OUT, _OUT_FIRST]] = _NO_QUOTE
QUOTATIONS = Machine(_QUOTES)
_QUOTE_OF = {0x201E: _LOW, 0x201A: _LOW_ONE, 0x201C: _LEFT, 0x2018: _LEFT_ONE, 0xBB: _OUT, 0xAB: _IN}


def _paired(codes: np.ndarray, classes: np.ndarray) -> None:
    """Puts right the classes of marks that open or close according to which quotation is open."""
    if not np.isin(codes, [0x201E, 0x201A, 0xBB, 0xAB]).any():
        return
    symbols = np.full(len(codes), _ELSE, dtype=np.uint8)
    for code, symbol in _QUOTE_OF.items():
        symbols[codes == code] = symbol
    symbols[classes == END] = _TEXT_END
    out = np.flatnonzero(symbols == _OUT)  # one before a word and behind none opens, if nothing is open
    word = lambda at: (at >= 0) & np.isin(classes[np.clip(at, 0, len(classes) - 1)], (UPPER, LOWER, PLAIN, DIGIT, DOT, TRAIL))
    symbols[out[word(out + 1) & ~word(out - 1)]] = _OUT_FIRST
    before = QUOTATIONS.before(symbols)
    closes = (before == _IN_LOW) & (symbols == _LEFT) | (before == _IN_LOW_ONE) & (symbols == _LEFT_ONE) | (before == _IN_OUT) & (symbols == _IN)
    classes[closes] = CLOSE
    classes[(before == _NO_QUOTE) & (symbols == _OUT_FIRST)] = OPEN


class Words:
    """Abbreviations before a name and before a number, and verbs of speaking."""

    def __init__(self, names: set[str] = frozenset(), numbers: set[str] = frozenset(), verbs: set[str] = frozenset()):
        self.names, self.numbers, self.verbs = BEFORE_NAME | names, BEFORE_NUMBER | numbers, set(SPEAKING) | verbs
        said, titles = "|".join(map(re.escape, sorted(self.verbs))), "|".join(map(re.escape, sorted(w.capitalize() for w in self.names if w.isalpha())))
        self.speaker = re.compile(rf"\s*((?:(?:{titles})\.\s+)?[^\W\d_a-z][\w'’-]*(?:\s+[^\W\d_a-z][\w'’-]*)?\s+(?:{said})\b(?!\s*[,:]))")


_START = Words()
_CUT_SPEAKER = re.compile(r"\s*([^\W\d_a-z]\w*)(?:\s+([a-z]*))?\Z")
_HAN_SPEAKER = re.compile(r"[㐀-鿿]{1,10}?[说道问喊叫答](?=[。，！？…,]|\Z)")
_CUT_HAN_SPEAKER = re.compile(r"[㐀-鿿]{1,3}大?声?\Z")


def _continues(text: str, at: int, known: Words) -> bool:
    """Whether what follows a quotation that ends with a mark says who speaks."""
    if at < len(text) and "㐀" <= text[at] <= "鿿":
        return bool(_HAN_SPEAKER.match(text, at) or text[at - 2 : at - 1] == "！" and _CUT_HAN_SPEAKER.match(text, at))
    if at < len(text) and text[at] == "と":
        return True
    if known.speaker.match(text, at):
        return True
    m = _CUT_SPEAKER.match(text, at)
    return bool(m and text[at - 2 : at - 1] in "!?" and any(v.startswith(m.group(2) or "") for v in known.verbs))


def _goes_on(text: str, a: int, dot: int, known: Words) -> bool:
    """Whether the full stop at ``dot`` belongs to an abbreviation, initial or number, begun at ``a``, that the sentence goes on after."""
    word = text[a:dot]
    if not word:
        return False
    b = dot + 1
    while b < len(text) and text[b].isspace():
        b += 1
    after = text[b : b + 1]
    low = word.lower()
    if low in ENDING:
        return False
    if low in known.names:
        return True
    if low in known.numbers and after.isdigit():
        return True
    if word.isdigit() and b > dot + 1 and (a == 0 or text[a - 1] == "\n"):
        return True  # the number of a list item
    if len(word) == 1 and word.isalpha() and word.isupper():
        return after.isupper() or after == ""
    return bool(re.fullmatch(r"(?:\w\.)+\w", word)) and word.replace(".", "").isalpha() and after[:1].isupper()


def starts(texts: list[str], known: Words = _START) -> list[list[int]]:
    """For each text, the positions at which its second and later sentences begin."""
    codes, begins = code_points(texts)
    classes = _CLASSES[codes]
    ends = begins[1:] - 1
    classes[ends] = END
    _paired(codes, classes)
    dots = np.flatnonzero((codes == ord(".")) | (codes == 0xFF0E))
    if len(dots):
        after = np.minimum(dots + 1, len(codes) - 1)
        inner = (classes[np.maximum(dots - 1, 0)] == DIGIT) & (classes[after] == DIGIT)
        classes[dots[inner]] = GOES_ON
        dots = dots[~inner]
        # a dot in a row of dots, or before a small letter, needs no word list
        plain = (classes[np.minimum(dots + 1, len(codes) - 1)] != END) & (codes[np.minimum(dots + 1, len(codes) - 1)] != ord(".")) & (codes[np.maximum(dots - 1, 0)] != ord("."))
        dots = dots[plain]
        # a word goes back to the blank before it; if the stop stands inside a word, to the stop before it
        places = np.arange(len(codes))
        edge = np.isin(classes, (BLANK, LINE, END, OPEN)) | (classes == QUOTE)
        whole = np.concatenate([[0], np.maximum.accumulate(np.where(edge, places + 1, 0))[:-1]])
        part = np.concatenate([[0], np.maximum.accumulate(np.where(edge | (codes == ord(".")), places + 1, 0))[:-1]])
        inside = ~np.isin(classes[np.minimum(dots + 1, len(codes) - 1)], (BLANK, LINE, END, CLOSE, QUOTE))
        begun = np.where(inside, part[dots], whole[dots])
        for i, a, t in zip(dots.tolist(), begun.tolist(), (np.searchsorted(begins, dots, "right") - 1).tolist()):
            base = int(begins[t])
            if _goes_on(texts[t], max(a - base, 0), i - base, known):
                classes[i] = GOES_ON
    closing = np.flatnonzero((classes == CLOSE) & np.isin(codes, (0x201D, 0x201C, 0x300D, 0x300F, 0xBB, 0xAB)) | (codes == 0x22))
    if len(closing):
        before = classes[np.maximum(closing - 1, 0)]
        closing = closing[(before == DOT) | (before == FULL) | (before == TRAIL)]
        for i, t in zip(closing.tolist(), (np.searchsorted(begins, closing, "right") - 1).tolist()):
            base, text = int(begins[t]), texts[t]
            if _continues(text, i - base + 1, known):
                j = i + 1
                while classes[j] in (BLANK, LINE):
                    j += 1
                if classes[j] != END:
                    classes[j] = GOES_ON
    state = TRANSDUCER.before(classes)
    found = np.flatnonzero(_BEGINS[state, classes])
    edge = np.searchsorted(found, begins)
    return [(found[edge[i] : edge[i + 1]] - begins[i]).tolist() for i in range(len(texts))]


#: A word is learnt if it is met so often, and for one in so many full stops: what is learnt has at most that many words.
LEAST, ONE_IN = 5, 100_000
#: An abbreviation stands at a text's end, or without its stop, at most this often; so often a name or a number follows it,
#: of as many different ones at least; a verb of speaking stands beside a quotation at least this often.
STRAY, FOLLOWED, DIFFERENT, SPOKEN = 0.1, 0.8, 3, 0.05

_LETTERS = r"[^\W\d_]+"
_COUNTED = re.compile(_LETTERS)
_DOTTED = re.compile(rf"({_LETTERS})\.")
_AT_END = re.compile(rf"({_LETTERS})\.[”’\"'»“)\]]*\s*(?:\Z|\n)")
_FOLLOWED = re.compile(rf"({_LETTERS})\.[ \u00a0]+((?=[^\Wa-z_])\w+)")
_BESIDE = re.compile(rf",[”\"“]\s+[^\W\d_a-z][\w'’-]*(?:\s+[^\W\d_a-z][\w'’-]*)?\s+([a-z]+)\b|\b([a-z]+)(?: [a-z]+)?[,:]\s+[“\"„]")
_HELD = 200_000


def _noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``kind, word, next, n``: words, words with a stop, those at an end, those before a capital or digit, words beside
    quotations (behind one that ends in a comma, or before one)."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(held)
        done = pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys], pa.string()) for i in range(3)], pa.array(list(held.values()), pa.int64())], names=["kind", "word", "next", "n"])
        held.clear()
        return done

    for b in batches:
        text = "\n".join(b.column("text").to_pylist())  # each text ends a line
        for kind, words in (("all", _COUNTED.findall(text)), ("dot", map(str.lower, _DOTTED.findall(text))), ("end", map(str.lower, _AT_END.findall(text)))):
            for w, n in Counter(words).items():
                held[kind, w, ""] += n
        for (w, x), n in Counter(_FOLLOWED.findall(text)).items():
            held["next", w.lower(), "0" if x[0].isdigit() else x] += n
        for (v, w), n in Counter(_BESIDE.findall(text)).items():
            held["say", v or w, ""] += n
        if len(held) > _HELD:
            yield out()
    yield out()


def learnt(df: DataFrame, text: str = "english") -> Words:
    """Abbreviations and verbs of speaking of all texts. What comes to the driver is bounded by ``ONE_IN`` words of each kind."""
    given = df.select(F.col(text).alias("text")).filter("text is not null")
    noted = cut(given.mapInArrow(_noted, "kind string, word string, next string, n bigint").groupBy("kind", "word", "next").agg(F.sum("n").alias("n")))
    of = lambda kind: noted.filter(F.col("kind") == kind)
    least = max(LEAST, (of("dot").agg(F.sum("n")).first()[0] or 0) // ONE_IN)
    small = F.col("word") == F.lower("word")
    words = of("all").groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n_all"), F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("n_small"))
    dots = of("dot").filter(F.col("n") >= least).select("word", F.col("n").alias("n_dot")).join(of("end").select("word", F.col("n").alias("n_end")), "word", "left").join(words, "word")
    few = dots.filter((F.coalesce("n_end", F.lit(0)) <= STRAY * F.col("n_dot")) & (F.col("n_all") - F.col("n_dot") <= STRAY * F.col("n_dot"))).select("word")
    after = of("next").join(few, "word", "left_semi").select("word", "next", "n").join(words.select(F.col("word").alias("low"), "n_all", "n_small"), F.lower("next") == F.col("low"), "left")
    name = (F.col("next") != "0") & (F.coalesce("n_small", F.lit(0)) <= STRAY * F.coalesce("n_all", F.lit(1)))
    g = after.groupBy("word").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(name, F.col("n"))), F.lit(0)).alias("names"), F.coalesce(F.sum(F.when(F.col("next") == "0", F.col("n"))), F.lit(0)).alias("numbers"), F.count_if(name).alias("different"))
    found = g.filter(F.col("n") >= least).select("word", ((F.col("names") >= FOLLOWED * F.col("n")) & (F.col("different") >= DIFFERENT)).alias("name"), (F.col("numbers") >= FOLLOWED * F.col("n")).alias("number")).filter("name or number").collect()
    said = of("say").filter(F.col("n") >= least).join(words, "word").filter(F.col("n") >= SPOKEN * F.col("n_all")).select("word").collect()
    return Words({r[0] for r in found if r[1]} - ENDING, {r[0] for r in found if r[2]}, {r[0] for r in said})


def _batches(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in slices(texts):
                yield pa.RecordBatch.from_arrays([b.column("row_id").slice(i, j - i), b.column("text").slice(i, j - i), pa.array(starts(texts[i:j], known.value), pa.list_(pa.int32()))], names=["row_id", "text", "starts"])

    return run


def marked(df: DataFrame, row: str = "row_id", text: str = "english") -> DataFrame:
    """``row_id, text, starts`` of every text that isn't null. A pass that learns words and one that splits; texts of any length."""
    known = df.sparkSession.sparkContext.broadcast(learnt(df, text))
    return df.select(F.col(row).cast("bigint").alias("row_id"), F.col(text).alias("text")).filter("text is not null").mapInArrow(_batches(known), "row_id bigint, text string, starts array<int>")


def found(df: DataFrame) -> DataFrame:
    """``row_id, start_pos`` of every sentence but the first of each text."""
    return marked(df).select("row_id", F.explode("starts").alias("start_pos"))


def units(df: DataFrame, row: str = "row_id", text: str = "english") -> DataFrame:
    """``row_id, seq, start_pos, sentence``: every sentence of every text, trimmed. Blank texts have none."""
    m = marked(df, row, text).select("row_id", "text", F.concat(F.array(F.lit(0)), F.col("starts")).alias("b"))
    e = m.select("row_id", F.posexplode(F.expr("transform(b, (p, i) -> struct(p as start_pos, substring(text, p + 1, coalesce(get(b, i + 1), length(text)) - p) as s))")).alias("seq", "u"))
    return e.select("row_id", (F.col("seq") + 1).alias("seq"), "u.start_pos", F.regexp_replace("u.s", r"(?U)\A\s+|\s+\z", "").alias("sentence")).filter("sentence != ''")
