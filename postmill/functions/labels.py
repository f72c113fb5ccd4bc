"""Label vocabularies as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import fixed


def _lookup(mapping: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())]), key)


def _col(label: Column | str) -> Column:
    return F.col(label) if isinstance(label, str) else label


def remap_labels(label: Column | str, mapping: dict[int, int] = fixed.GENERAL_TO_CANONICAL, strict: bool = True) -> Column:
    """Map codes to codes. A code outside the map fails the job, or becomes NULL when not strict."""
    label = _col(label)
    mapped = _lookup(mapping, label)
    if not strict:
        return mapped
    unknown = F.raise_error(F.concat(F.lit("label outside the map: "), label.cast("string"))).cast("int")
    return F.when(label.isNull(), None).otherwise(F.coalesce(mapped, unknown))


def encode_labels(label: Column | str, vocab: dict[str, int] = fixed.SENTIMENT_CODES) -> Column:
    """Map class names to codes; an unknown name becomes NULL."""
    return _lookup(vocab, _col(label))


def decode_labels(label: Column | str, vocab: dict[str, int] = fixed.SENTIMENT_CODES) -> Column:
    """Map codes back to class names; an unknown code becomes NULL."""
    return _lookup({code: name for name, code in vocab.items()}, _col(label))


def harmonise_predictions(label: Column | str) -> Column:
    """Lower-case a predicted class and express it as positive, negative or neutral."""
    name = F.lower(_col(label))
    return F.coalesce(_lookup(fixed.TO_POLARITY, name), name)
