"""Writing characters in other codes through dictionary tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lookup as L, text as T

JOINER = "#"

# The component each key of the two input methods stands for.
FIVE_STROKE_COMPONENTS = {
    "a": "工", "b": "子", "c": "又", "d": "大", "e": "月", "f": "土", "g": "王",
    "h": "目", "i": "水", "j": "日", "k": "口", "l": "田", "m": "山", "n": "已",
    "o": "火", "p": "之", "q": "金", "r": "白", "s": "木", "t": "禾", "u": "立",
    "v": "女", "w": "人", "x": "纟", "y": "言", "z": "Ⓩ",
}
SHAPE_CODE_COMPONENTS = {
    "a": "日", "b": "月", "c": "金", "d": "木", "e": "水", "f": "火", "g": "土",
    "h": "竹", "i": "戈", "j": "十", "k": "大", "l": "中", "m": "一", "n": "弓",
    "o": "人", "p": "心", "q": "手", "r": "口", "s": "尸", "t": "廿", "u": "山",
    "v": "女", "w": "田", "x": "難", "y": "卜", "z": "重", "'": "'",
}
# Method names, and the fields a dictionary line's codes stand in,
# by its number of fields (0-based).
READING_METHODS = {
    "pinyin_tone_above": "marked", "pinyin_tone_after": "numbered", "zhuyin": "bopomofo",
}
DICTIONARY_METHODS = ("wubi", "cangjie")
FIVE_STROKE_FIELDS = {2: (1,), 3: (1,), 4: (1, 3)}
SHAPE_CODE_FIELDS = {2: (1,), 3: (1, 2)}
# Fixed value: one Han character, or a run of anything else.
ITEM_PATTERN = r"\p{IsHan}|[^\p{IsHan}]+"
_CIRCLES = str.maketrans(T.TONE_DIGITS, T.CIRCLED_TONES)
# Texts that a Python task turns into strings and hands on together.
_TEXTS_AT_ONCE = 64


def first_wins(entries: DataFrame, key: str = "ch", value: str = "code",
               order: str = "line_no") -> DataFrame:
    """The first value per key."""
    return entries.groupBy(key).agg(F.min_by(value, order).alias(value))


def lookup_codes(chars: DataFrame, codes: DataFrame, char: str = "ch") -> DataFrame:
    """Add `code` to a table of characters: the dictionary's, or the character itself."""
    table = codes.select(F.col("ch").alias("_ch"), F.col("code").alias("_code"))
    return (
        chars.join(table, F.col(char) == F.col("_ch"), "left")
        .withColumn("code", F.coalesce("_code", F.col(char)))
        .drop("_ch", "_code")
    )


def codes_joined(text: Column, codes: DataFrame, char: str = "ch", code: str = "code") -> Column:
    """Every character's code or itself, joined with `#`, in the order of the text."""
    table = L.char_table(codes, char, code, "", "string", L.CODE_POINTS)
    items = F.transform(T.char_tokens(text), lambda c: L.text_at(table, F.ascii(c), c))
    return F.array_join(items, JOINER)


def readings_joined(text: Column, readings: DataFrame, reading: str, circled: bool = False,
                    phrases: DataFrame | None = None) -> Column:
    """Readings of Han characters, other text in runs, joined with `#`.

    `readings` is (ch, <reading>), `phrases` (phrase, <reading> with `#` between
    characters); the longest phrase at a place wins over single readings. With
    `circled`, a final tone digit of any item is written as a circled digit.
    """
    if phrases is not None:
        return phrases_joined(text, readings, reading, phrases, circled)
    items = F.regexp_extract_all(text, F.lit(ITEM_PATTERN), F.lit(0))
    # Tones are circled in the table, once per character, and per item only elsewhere.
    mark = T.circle_tone if circled else (lambda item: item)
    written = readings.select("ch", mark(F.col(reading)).alias("reading"))
    table = L.char_table(written, "ch", "reading", "", "string", L.CODE_POINTS)

    def convert(item: Column) -> Column:
        return F.when(F.length(item) == 1, L.text_at(table, F.ascii(item), mark(item))).otherwise(
            mark(item)
        )

    return F.array_join(F.transform(items, convert), JOINER)


def phrases_joined(text: Column, readings: DataFrame, reading: str, phrases: DataFrame,
                   circled: bool = False) -> Column:
    """`readings_joined` with phrases. The texts are written in Python tasks, which hold the items of
    one text at a time and hand on whole texts."""
    rows = L.small_rows(phrases.select("phrase", F.col(reading).alias("r")), 1_000_000)
    chars = L.small_rows(readings.where(F.length("ch") == 1).select("ch", F.col(reading).alias("r")))
    mark = _circled if circled else str
    single = {row.ch: mark(row.r) for row in chars if row.r is not None}
    known = {row.phrase: row.r.split(JOINER) for row in rows}

    @F.arrow_udf("string")
    def write(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        write_text = _phrase_writer(known, single, mark)
        for batch in batches:
            for start in range(0, len(batch), _TEXTS_AT_ONCE):
                texts = batch.slice(start, _TEXTS_AT_ONCE).to_pylist()
                yield pa.array([None if t is None else write_text(t) for t in texts], pa.string())

    return write(text)


def _circled(item: str) -> str:
    return item[:-1] + item[-1].translate(_CIRCLES) if item else item


def _phrase_writer(known: dict[str, list[str]], single: dict[str, str],
                   mark: Callable[[str], str]) -> Callable[[str], str]:
    """A function that writes one text: phrases, single Han characters, runs of anything else."""
    import regex

    def written(item: str) -> str:
        found = single.get(item)
        return mark(item) if found is None else found

    spelled = {p: JOINER.join(map(written, r)) for p, r in known.items() if regex.match(r"\p{Han}", p)}
    sizes: dict[str, list[int]] = {}
    for size in sorted({len(p) for p in spelled}, reverse=True):
        for head in {p[0] for p in spelled if len(p) == size}:
            sizes.setdefault(head, []).append(size)
    # A run of anything else, a run of Han characters that begin no phrase, or one that may.
    scan = regex.compile(rf"(\P{{Han}}+)|([^\P{{Han}}{''.join(sizes)}]+)|.", regex.DOTALL).match

    def write(text: str) -> str:
        out, i = [], 0
        while i < len(text):
            found = scan(text, i)
            part, kind, i = found.group(), found.lastindex, found.end()
            if kind == 1:
                out.append(written(part))
            elif kind == 2:
                out.extend(map(written, part))
            else:
                start = i - 1
                size = next((n for n in sizes[part] if text[start:start + n] in spelled), 0)
                out.append(spelled[text[start:start + size]] if size else written(part))
                i = start + (size or 1)
        return JOINER.join(out)

    return write


def check_method(method: str) -> None:
    """Raise for a name that is no input method."""
    if method not in DICTIONARY_METHODS and method not in READING_METHODS:
        raise ValueError(f"unknown input method: {method!r}")


def convert_text(text: Column, method: str, codes: DataFrame | None = None,
                 phrases: DataFrame | None = None) -> Column:
    """The text in the form named by `method`; an empty name leaves it as it is."""
    if method == "":
        return text
    check_method(method)
    if codes is None:
        raise ValueError(f"input method {method!r} needs a dictionary table")
    if method in DICTIONARY_METHODS:
        return codes_joined(text, codes)
    return readings_joined(
        text, codes, READING_METHODS[method], method == "pinyin_tone_after", phrases
    )


def keys_to_components(code: Column, components: dict[str, str]) -> Column:
    """Each key's component; an unknown key k becomes `[k]`."""
    table = L.dense_array({ord(k): v for k, v in components.items()}, "", "string")
    return F.array_join(
        F.transform(
            T.char_tokens(code),
            lambda k: L.text_at(table, F.ascii(k), F.concat(F.lit("["), k, F.lit("]"))),
        ),
        "",
    )


def convert_dict_lines(lines: DataFrame, components: dict[str, str],
                       fields: dict[int, tuple[int, ...]], order: list[str],
                       value: str = "value") -> DataFrame:
    """Dictionary lines with keys turned into components.

    Header lines up to `...`, comments and empty lines are kept. Adds `malformed`
    for body lines whose number of fields is not in `fields`; those are kept too.
    """
    rows = mark_body(lines, order, value)
    parts = F.split(F.col("_line"), "\t")
    is_body = F.col("in_body") & (F.col("_line") != "") & ~F.col("_line").startswith("#")
    converted = None
    for size, where in fields.items():
        cells = [
            keys_to_components(F.get("_parts", F.lit(i)), components) if i in where
            else F.get("_parts", F.lit(i))
            for i in range(size)
        ]
        test, cell = F.size("_parts") == size, F.concat_ws("\t", *cells)
        converted = F.when(test, cell) if converted is None else converted.when(test, cell)
    return (
        rows.withColumn("_line", T.py_strip(F.col(value)))
        .withColumn("_parts", parts)
        .withColumn("malformed", is_body & ~F.size("_parts").isin(*fields))
        .withColumn(value, F.when(is_body & ~F.col("malformed"), converted).otherwise(F.col(value)))
        .drop("_line", "_parts", "in_body")
    )


def mark_body(lines: DataFrame, order: list[str], value: str = "value") -> DataFrame:
    """Add `in_body`: the line comes after the first `...` line."""
    place = F.struct(*order)
    start = lines.where(T.py_strip(F.col(value)) == "...").agg(F.min(place))
    return lines.withColumn("in_body", F.coalesce(place > start.scalar(), F.lit(False)))


def parse_code_dict(lines: DataFrame, order: list[str], value: str = "value") -> DataFrame:
    """(ch, code) of a dictionary file's lines; the first entry per character wins."""
    fields = F.split(T.py_strip(F.col(value)), rf"[{T.SPACE_CHARS}]+")
    body = (
        mark_body(lines, order, value)
        .where("in_body")
        .select(fields.alias("f"), F.struct(*order).alias("place"))
        .where((F.size("f") >= 2) & ~F.get("f", F.lit(0)).startswith("#"))
    )
    return body.groupBy(F.get("f", F.lit(0)).alias("ch")).agg(
        F.min_by(F.get("f", F.lit(1)), "place").alias("code")
    )
