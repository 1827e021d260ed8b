import pytest
from pyspark.sql import functions as F

from lexiloom.functions import fuzzy
from lexiloom.functions import numeric as N
from lexiloom.functions import text as X


@pytest.mark.parametrize(
    "f, given, expected",
    [
        (X.normalize_line, " a\u00a0 b ,c “ d ” é\u00ad�", "a b,c “d” é."),
        (X.repair_dotted_spacing, "The.cat.sat.down.", "The cat sat down."),
        (X.repair_dotted_spacing, "One dot.only", "One dot.only"),
        (X.count_words, "It’s a well-known 3-day test", 5),
        (X.has_final_mark, 'He said "no."', True),
        (X.has_final_mark, "no", False),
        (X.normalize_word, "Twelve!", "twelve"),
        (X.normalize_word, "12", "twelve"),
        (X.normalize_word, "21", "21"),
        (X.transcript_words, "It's 3, well-known --", ["its", "three", "wellknown"]),
        (X.letters_only, "a1-b", "ab"),
        (X.dash_hint, "it's", "--'-"),
        (X.masked_hint, "cat", "c--"),
        (X.masked_hint, "", ""),
        (X.title_key, "The Cat's 2!", "thecats2"),
        (X.vote_key, " The  cat? ", "the cat"),
        (X.title_tokens, "Café & Co Café & Co", ["cafe", "and", "co"]),
        (X.title_tokens, "One", ["one"]),
        (X.title_tokens, "", []),
        (X.clean_file_title, "/b/C 12 - The_Book_raz_c12_clr.pdf", "The_Book"),
        (X.audio_title, "/x/B-07 The ﬁsh.mp3", "The fish"),
        (X.level_from_parent, "/lib/bigs/x.pdf", "B"),
        (X.level_from_parent, "/lib/1/x.pdf", "X"),
        (X.level_from_parent, "1.pdf", "?"),
        (X.level_from_marker, "/a/d级/x.mp3", "D"),
        (X.level_from_marker, "/a/b/x.mp3", None),
        (X.source_number, "/x/L-031 name.pdf", 31),
        (X.expected_words, "Word Count: 1,234", 1234),
        (X.font_family, "ABC+Foo-BoldItalic", "foo"),
        (X.is_title_like, "The Cat of the Hill", True),
        (X.is_title_like, "The cat", False),
        (X.odd_quotes, 'a "b', True),
        (X.usable_text, "12", False),
        (X.usable_text, "The image contains no text.", False),
        (X.usable_text, "A cat.", True),
        (X.plausible, "I cannot read", False),
        (X.plausible, "A cat.", True),
        (X.parse_asr_output, "language English<asr_text> Hello ", "Hello"),
        (X.parse_asr_output, "language None<asr_text>", ""),
        (X.parse_asr_output, "language English Hi", ""),
        (X.parse_asr_output, None, ""),
        (X.failure_reason, "x: quality gate failed", "quality-gate"),
        (X.failure_reason, "?", "other"),
        (X.normalize_username, " Ab ", "ab"),
        (N.duration_seconds, "01:02:03.5", 3723.5),
        (N.duration_seconds, "x", None),
    ],
)
def test_functions(one, f, given, expected):
    assert one(f, given) == expected


def test_null_stays_null(one):
    for f in (X.normalize_line, X.count_words, X.split_sentences, X.title_key, X.title_tokens, X.dictation_words, X.has_final_mark, X.parse_blocks):
        assert one(f, None) is None


def test_sentences(one):
    text = 'Mr. Fox ran 3.5 miles. "Stop!" he said. J. K. Row sat, e.g. there. U.S. troops came! Really? no'
    assert one(X.split_sentences, text) == ["Mr. Fox ran 3.5 miles.", '"Stop!" he said.', "J. K. Row sat, e.g. there.", "U.S. troops came!"]
    assert one(X.split_sentences, "Wait... what? !! Yes. ... ") == ["Wait... what?", "Yes."]
    assert one(X.split_sentences, "One., two. Three") == ["One., two."]


def test_dictation(one):
    got = one(X.dictation_words, '"It’s 3 o\'clock," she said.')
    assert [tuple(x) for x in got] == [("It’s", '"', "3"), ("o'clock", "", ',"'), ("she", "", ""), ("said", "", ".")]


def test_blocks(one):
    raw = "title [1, 2, 3, 4] Cover\ntext [0,0,400,400] First\nline\ntext [1,2,3] bad"
    assert [tuple(b) for b in one(X.parse_blocks, raw)] == [("title", 1, 2, 3, 4, "Cover"), ("text", 0, 0, 400, 400, "First line")]


def test_transcription_and_dispute(one):
    assert one(X.clean_transcription, "```text\nThe Cat A cat ran.[Non-Text]\n```", "The Cat") == "A cat ran."
    assert one(X.is_disputed, "T", "v", "ok", "unlimited_ocr") is False
    assert one(X.is_disputed, "T", "v", 'say "x', "unlimited_ocr") is True
    assert one(X.is_disputed, "T", "v", "", "vision_fallback") is True


def test_similarity_is_not_symmetric(one):
    assert one(fuzzy.similarity, "tide", "diet") == 0.25 and one(fuzzy.similarity, "diet", "tide") == 0.5
    assert one(fuzzy.similarity, None, "a") is None and one(fuzzy.similarity, "", "") == 1.0


def test_title_scores(one):
    assert one(fuzzy.title_score, "The Cat", "The Cat") == 1.0
    assert one(fuzzy.title_score, "The Big Cat", "Big Cat") == pytest.approx(0.9 + 0.1 * 2 / 3)
    assert one(fuzzy.title_score, "", "x") == 0.0
    assert one(fuzzy.consensus, "A cat ran.", "A cat ran.") is True and one(fuzzy.consensus, "A cat ran.", "A cat ran!") is False


def test_numbers(one):
    assert one(N.percent, 1, 8, kinds=["int"] * 2) == 13 and one(N.percent, 1, 0, kinds=["int"] * 2) == 0
    assert one(N.quadrant, 0, 600, 400, 900, kinds=["int"] * 4) == 2
    assert one(N.merged_map, {"a": 1, "b": 2}, {"b": 3}, kinds=["map<string,int>"] * 2) == {"a": 1, "b": 3}
    assert one(lambda a: N.spliced(a, F.lit(2), F.array(F.lit(8), F.lit(9))), [1, 2, 3], kinds=["array<int>"]) == [1, 8, 9, 3]
    assert one(lambda a: N.added_once(a, F.lit(2), lambda x: x == 2), [1, 2], kinds=["array<int>"]) == [1, 2]
    assert one(lambda t: N.day_key(t.cast("timestamp")), "2025-01-02 03:04:05") == "2025-1-2"
    assert str(one(N.day_of, "2025-1-2")) == "2025-01-02" and one(N.day_of, "x") is None
