"""Column functions on token-id and number arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def pad_truncate(ids: Column, size: int, pad: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), size)), 1, size)


def attention_mask(ids: Column, size: int) -> Column:
    kept = F.least(F.size(ids), F.lit(size))
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(size) - kept))


def cut_count(ids: Column, size: int) -> Column:
    """How many ids a cut to `size` leaves out."""
    return F.greatest(F.size(ids) - size, F.lit(0))


def labels_copy(padded: Column, mask: Column | None = None, ignore: int = -100) -> Column:
    """Labels equal the padded ids; with `mask`, padding becomes `ignore`."""
    if mask is None:
        return padded
    return F.zip_with(padded, mask, lambda x, m: F.when(m == 1, x).otherwise(F.lit(ignore)))


def wrap_specials(ids: Column, start: int, end: int) -> Column:
    return F.concat(F.array(F.lit(start)), ids, F.array(F.lit(end)))


def prepend_start(first: Column, second: Column | None = None, start: int | None = None) -> Column:
    """One or two sequences in a row, each behind `start` when it is given."""
    parts = []
    for ids in (first, second):
        if ids is None:
            continue
        if start is not None:
            parts.append(F.array(F.lit(start)))
        parts.append(ids)
    return F.concat(*parts)


def argmax(values: Column) -> Column:
    """0-based index of the first largest value."""
    return F.array_position(values, F.array_max(values)) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once.

    A plain column named inside a lambda is computed anew for every element; a
    lambda's own variable is not. So the value becomes the one element of an array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _shifted_exp(values: Column, top: Column) -> Column:
    return F.transform(values, lambda x: F.exp(x - top))


def softmax(values: Column) -> Column:
    return let(
        values.cast("array<double>"),
        lambda v: let(
            F.array_max(v),
            lambda top: let(
                _shifted_exp(v, top),
                lambda scaled: let(_sum(scaled), lambda all_: F.transform(scaled, lambda x: x / all_)),
            ),
        ),
    )


def centered_log(values: Column, eps: float = 1e-10) -> Column:
    """Logarithm of the clamped values minus its mean."""
    return let(
        F.transform(values.cast("array<double>"), lambda x: F.log(F.greatest(x, F.lit(eps)))),
        lambda logs: let(
            _sum(logs) / F.size(logs), lambda mean: F.transform(logs, lambda x: x - mean)
        ),
    )


def token_nll(logits: Column, index: Column) -> Column:
    """Cross entropy in nats of the 0-based class `index` under `logits`."""
    return let(
        logits.cast("array<double>"),
        lambda v: let(
            F.array_max(v),
            lambda top: F.log(_sum(_shifted_exp(v, top))) + top - F.get(v, index),
        ),
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
