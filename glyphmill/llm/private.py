"""Personal data: fixed patterns, and more found through the contexts they stand in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Written so that a search never goes over a run twice: a match
# starts where its run does, or where the last match ended; what cannot help is not given back.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A character without which there is no match.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

# A candidate: tokens with a digit or an @, one space apart.
_TOKEN = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_CANDIDATE = rf"(?:\G|(?<=[\x20\x09-\x0D])){_TOKEN}(?:\x20{_TOKEN})*+"
_OPENING, _CLOSING = r"^[(\[<{\"']+", r"[)\]>}\"'.,;:!?]+$"

ROUNDS = 3
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.9

# What a token must look like to be taken for a kind, once its context has named it.
_SHAPES = {
    "email": r"^[^@]+@[^@]+$", "ip": r"^[0-9]+([.:][0-9A-Fa-f]*){3,7}$",
    "card": r"^([0-9][ -]?){12,19}$", "phone": r"^\+?([0-9][ ().-]{0,2}){7,15}$",
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits of the match pass the check sum of card numbers."""
    digits = F.split(F.reverse(_digits(match)), "")
    sums = F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
        )), F.lit(0), lambda a, x: a + x,
    )
    return sums % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    n = F.length(_digits(match))
    small = F.forall(F.split(match, r"\."), lambda p: F.coalesce(
        F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.lit(False)
    ) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    return (
        F.when(kind == KINDS.index("ip"), small)
        .when(kind == KINDS.index("card"), F.when(n.between(16, 19), luhn(match)).otherwise(False))
        .when(kind == KINDS.index("phone"), n.between(8, 15))
        .otherwise(True)
    )


def _found(text: Column, pattern: str, needs: str | None, extra: str = "") -> Column:
    """(gap, match) of every match in order: `gap` is the text between it and the one before. With
    `extra`, the text behind the last match follows as a gap with an empty match."""
    gaps = F.split(text, pattern, -1)
    found = F.zip_with(
        gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")),
    )
    if extra:
        found = F.transform(found, lambda x: F.struct(x["gap"].alias("gap"), F.coalesce(x["match"], F.lit("")).alias("match")))
    else:
        found = F.filter(found, lambda x: x["match"].isNotNull())
    none = F.array().cast("array<struct<gap:string,match:string>>")
    has = F.rlike(text, F.lit(f"[0-9{extra}]")) if needs is None else F.instr(text, needs) > 0
    return F.when(has, found).otherwise(none)


def _context(word: Column) -> Column:
    """A context word as patterns know it: no marks at its ends, digits all alike; `^` for none."""
    bare = F.regexp_replace(C.lower_ascii(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.coalesce(F.regexp_replace(bare, "[0-9]", "0"), F.lit("^"))


def _matches(text: Column) -> Column:
    """Every base pattern's and every candidate's matches, as one array; `kind` by number."""
    def plain(n: int):
        return lambda x, i: F.struct(
            F.lit(n).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["match"].alias("match"),
            *[F.lit(None).cast("string").alias(c) for c in ("left2", "left", "behind")],
        )

    def candidate(x: Column, i: Column) -> Column:
        words = F.array_remove(F.split(x["gap"], C.SPACE), "")
        return F.struct(
            F.lit(len(KINDS)).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["match"].alias("match"),
            F.try_element_at(words, F.lit(-2)).alias("left2"), F.try_element_at(words, F.lit(-1)).alias("left"),
            F.nullif(F.regexp_extract(x["gap"], r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1), F.lit("")).alias("behind"),
        )

    return F.concat(
        *[F.transform(_found(text, _PATTERNS[k], _NEEDS[k]), plain(n)) for n, k in enumerate(KINDS)],
        F.transform(_found(text, _CANDIDATE, None, "@"), candidate),
    )


def marks(rows: DataFrame) -> DataFrame:
    """(_row, kind, start, stop, core, left2, left, right, label) of (_row, _text).

    Base matches that pass their checks, `kind` 0 to 3, and candidates, `kind` 4, whose `label` is the
    kind of a base match that they touch, or null. Places are running sums over a row's
    matches; one shuffle by row does all of it, and no text is in it.
    """
    # An outer explode: the plain one is given a filter that searches the text a second time.
    found = rows.select("_row", F.explode_outer(_matches(F.col("_text"))).alias("m")).where("m is not null").select(
        "_row", "m.*")
    order = Window.partitionBy("_row", "kind").orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = found.repartition("_row").select(
        "*", F.sum(F.col("gap") + F.length("match")).over(upto).alias("_end"),
        F.lead("behind").over(order).alias("right"),
    )
    other = F.col("kind") == len(KINDS)
    opening = F.when(other, F.length(F.regexp_extract("match", _OPENING, 0))).otherwise(0)
    core = F.when(other, F.regexp_replace(F.regexp_replace("match", _OPENING, ""), _CLOSING, "")).otherwise(F.col("match"))
    placed = placed.where(F.when(other, F.col("match") != "").otherwise(_valid(F.col("kind"), F.col("match")))).select(
        "_row", "kind", (F.col("_end") - F.length("match") + opening).cast("bigint").alias("start"),
        core.alias("core"), "left2", "left", "right",
    ).withColumn("stop", F.col("start") + F.length("core"))
    by_place = Window.partitionBy("_row").orderBy("start", "stop", "kind")
    before = F.max(F.when(~other, F.struct("stop", "kind"))).over(
        by_place.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(~other, F.struct("start", "kind"))).over(
        by_place.rowsBetween(0, Window.unboundedFollowing))
    placed = placed.select("*", before.alias("_before"), after.alias("_after"))
    label = F.when(F.col("_before.stop") > F.col("start"), F.col("_before.kind")).when(
        F.col("_after.start") < F.col("stop"), F.col("_after.kind"))
    return placed.withColumn("label", F.when(other, label)).drop("_before", "_after")


def discover(found: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT,
             min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(instance, kind, score) of the unlabelled candidates that their contexts name.

    A pattern is two words before, one before, or one on either side; an instance a candidate's text in
    lower case. A labelled instance counts 1 for its kind and 0 for the others. A round sets a
    pattern's confidence in a kind to the sum of its instances' scores over their number and one
    more, if it has `min_support` labelled instances of that kind, else 0; then each other instance's
    score to 1 - the product of (1 - confidence) over its patterns. Instances that end at
    `min_confidence` or more, in their best kind, and look like that kind are returned. An instance
    labelled with several kinds keeps the first.
    """
    cases = found.where(F.col("kind") == len(KINDS)).select(
        F.lower("core").alias("instance"), "label",
        *[_context(F.col(c)).alias(c) for c in ("left2", "left", "right")],
    ).where(F.col("instance") != "")
    edges = C.staged(cases.select("instance", "label", F.explode(F.array(
        F.concat_ws(" ", "left2", "left", F.lit("_")), F.concat_ws(" ", "left", F.lit("_")),
        F.concat_ws(" ", "left", F.lit("_"), "right"),
    )).alias("pattern")).groupBy("pattern", "instance").agg(F.min("label").alias("label")), "contexts")
    known = edges.groupBy("instance").agg(F.min("label").alias("label"))
    scores = known.select("instance", "label", *[
        F.coalesce((F.col("label") == n).cast("double"), F.lit(0.0)).alias(f"s{n}") for n in range(len(KINDS))
    ])
    scores = C.staged(scores, "scores")
    for _ in range(rounds):
        patterns = edges.select("pattern", "instance").join(scores, "instance").groupBy("pattern").agg(
            F.count("*").alias("n"),
            *[F.sum(f"s{k}").alias(f"t{k}") for k in range(len(KINDS))],
            *[F.count_if(F.col("label") == k).alias(f"m{k}") for k in range(len(KINDS))],
        ).select("pattern", *[
            F.when(F.col(f"m{k}") >= min_support, F.col(f"t{k}") / (F.col("n") + 1)).otherwise(0.0).alias(f"c{k}")
            for k in range(len(KINDS))
        ]).where(" or ".join(f"c{k} > 0" for k in range(len(KINDS))))
        learned = edges.select("pattern", "instance").join(
            scores.where("label is null").select("instance"), "instance", "left_semi"
        ).join(patterns, "pattern").groupBy("instance").agg(*[
            (1 - F.exp(F.sum(F.log(1 - F.col(f"c{k}"))))).alias(f"l{k}") for k in range(len(KINDS))
        ])
        scores = C.staged(scores.join(learned, "instance", "left").select("instance", "label", *[
            F.when(F.col("label").isNull(), F.coalesce(f"l{k}", F.lit(0.0))).otherwise(F.col(f"s{k}")).alias(f"s{k}")
            for k in range(len(KINDS))
        ]), "scores")
    best = F.greatest(*[F.col(f"s{k}") for k in range(len(KINDS))])
    kind = F.coalesce(*[F.when(F.col(f"s{k}") == best, F.lit(k)) for k in range(len(KINDS))])
    shape = F.coalesce(*[
        F.when(F.col("kind") == k, F.rlike("instance", F.lit(_SHAPES[name]))) for k, name in enumerate(KINDS)
    ])
    return scores.where("label is null").select("instance", kind.alias("kind"), best.alias("score")).where(
        (F.col("score") >= min_confidence) & shape
    )


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): per document row, an array of (kind, start, stop, base) in order of kind, as in
    KINDS, then start. Places are code points, the end exclusive; `base` tells fixed patterns
    from what contexts added. An added span never touches a base one.

    Null and empty texts have no spans. Rows that repeat a key, or have none, each have the spans of
    their own text. Texts are searched whole; a text's matches, not its words, are moved.
    """
    rows = C.identified(docs, key, "_row", text)
    texts = rows.select("_row", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    found = C.staged(marks(texts), "marks")
    base = found.where(F.col("kind") < len(KINDS)).select("_row", "kind", "start", "stop", F.lit(True).alias("base"))
    free = found.where((F.col("kind") == len(KINDS)) & F.col("label").isNull())
    added = free.select("_row", F.lower("core").alias("instance"), "start", "stop").join(
        discover(found), "instance"
    ).select("_row", "kind", "start", "stop", F.lit(False).alias("base"))
    spans = base.unionByName(added).groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("kind", "start", "stop", "base"))).alias("spans")
    )
    names = F.array(*map(F.lit, KINDS))
    named = F.transform(F.coalesce("spans", F.array().cast("array<struct<kind:int,start:bigint,stop:bigint,base:boolean>>")),
                        lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"),
                                           s["stop"].alias("stop"), s["base"].alias("base")))
    return rows.select("_row", F.col(f"`{key}`")).join(spans, "_row", "left").select(
        F.col(f"`{key}`"), named.alias("spans"))


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with every span of its text written as its kind in brackets, `[email]`.

    Rows are matched to their spans by key and text; of spans that overlap,
    the first is masked and the others are left out. Columns, rows and nulls are kept.
    """
    row, held = C.free_name(docs, "_row"), C.free_name(docs, "_held")
    rows = C.identified(docs, key, row, *[c for c in docs.columns if c != key])
    spans = find(rows, row, text).where(F.size("spans") > 0).withColumnRenamed("spans", held)
    body, start = F.col(f"`{text}`"), F.lit(0).cast("bigint")
    by_place = F.array_sort(F.transform(held, lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    apart = F.aggregate(
        by_place, F.slice(by_place, F.lit(1), F.lit(0)),
        lambda kept, s: F.when(
            s["start"] >= F.coalesce(F.try_element_at(kept, F.lit(-1))["stop"], start), F.concat(kept, F.array(s))
        ).otherwise(kept),
    )
    rows = rows.join(spans, row, "left").withColumn(held, F.when(F.col(held).isNotNull(), apart))
    ends = F.concat(F.array(start), F.transform(held, lambda s: s["stop"]))
    pieces = F.zip_with(held, F.slice(ends, F.lit(1), F.size(held)), lambda s, place: F.concat(
        F.substring(body, (place + 1).cast("int"), (s["start"] - place).cast("int")), F.lit("["), s["kind"], F.lit("]")))
    rest = F.substring(body, (F.element_at(ends, -1) + 1).cast("int"), F.length(body))
    changed = F.when(F.col(held).isNull(), body).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return rows.select(*[
        changed.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns
    ])
