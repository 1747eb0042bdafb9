"""Column functions on text. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The characters that count as white space when text is stripped.
SPACE_CHARS = (
    r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Line and paragraph separators removed before counting characters.
SEPARATORS = "\u2028\u2029"
# Tone digits and their circled forms.
TONE_DIGITS = "1234"
CIRCLED_TONES = "①②③④"


def py_strip(text: Column) -> Column:
    """Strip Unicode white space at both ends (`trim` only knows the space).

    Only a text that begins or ends with white space is searched for its runs.
    """
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(
        F.regexp_like(ends, F.lit(f"[{SPACE_CHARS}]")),
        F.regexp_replace(text, rf"\A[{SPACE_CHARS}]+|[{SPACE_CHARS}]+\z", ""),
    ).otherwise(text)


def has_ink(text: Column) -> Column:
    """True when some character is not white space; stops at the first one."""
    return F.coalesce(F.regexp_like(text, F.lit(rf"[^{SPACE_CHARS}]")), F.lit(False))


def last_mark_index(text: Column, mark: str = "。", limit: int = 256) -> Column:
    """0-based index of the last `mark` that ends before `limit`, else -1."""
    head = F.substring(text, 1, limit)
    back = F.instr(F.reverse(head), mark[::-1])
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(head) - back - (len(mark) - 1))


def drop_separators(text: Column) -> Column:
    for mark in SEPARATORS:
        text = F.replace(text, F.lit(mark))
    return text


def char_tokens(text: Column) -> Column:
    """Array of code points as strings; an empty text gives an empty array."""
    return F.array_remove(F.split(text, ""), "")


def code_points(text: Column, of: Callable[[Column], Column] = lambda cp: cp) -> Column:
    """Array of Unicode code points, or of a function of each."""
    return F.transform(char_tokens(text), lambda c: of(F.ascii(c)))


def latin1_text(text: Column) -> Column:
    """Each UTF-8 byte of the text as one character U+0000..U+00FF."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def text_of_latin1(text: Column) -> Column:
    """The text whose bytes the characters U+0000..U+00FF are; bytes that are no text become U+FFFD."""
    return F.make_valid_utf8(F.encode(text, "ISO-8859-1").cast("string"))


def byte_tokens(text: Column, of: Callable[[Column], Column] = lambda b: b) -> Column:
    """Array of the UTF-8 byte values, or of a function of each."""
    return code_points(latin1_text(text), of)


def bytes_to_text(values: Column) -> Column:
    """UTF-8 text of an array of byte values."""
    joined = F.array_join(F.transform(values, lambda b: F.char(b)), "")
    return F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8")


def circle_tone(syllable: Column) -> Column:
    """A final tone digit 1..4 becomes its circled form."""
    last = F.right(syllable, F.lit(1))
    return F.when(
        last.isin(*TONE_DIGITS),
        F.concat(
            F.substring(syllable, F.lit(1), F.length(syllable) - 1),
            F.translate(last, TONE_DIGITS, CIRCLED_TONES),
        ),
    ).otherwise(syllable)


def rename_by_rules(name: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply literal replacements in the given order."""
    for old, new in rules:
        name = F.replace(name, F.lit(old), F.lit(new))
    return name


def classify_by_rules(name: Column, rules: list[tuple[str, str]], other: str = "Other") -> Column:
    """Class of the first rule whose substring occurs in the name."""
    out = None
    for part, label in rules:
        test = name.contains(part)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return F.lit(other) if out is None else out.otherwise(F.lit(other))
