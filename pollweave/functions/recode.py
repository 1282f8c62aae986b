"""Value maps."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from .names import named


def _literal_map(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def recode(value: Column, mapping: Mapping, keep_unmapped: bool = True) -> Column:
    """Replace values by a small map; unmapped values stay unless told otherwise."""
    mapped = F.try_element_at(_literal_map(mapping), value)
    return F.coalesce(mapped, value) if keep_unmapped else mapped


def recode_frame(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Apply one map to every text cell of a frame."""
    return df.select(
        *[
            recode(named(f.name), mapping).alias(f.name) if isinstance(f.dataType, StringType) else named(f.name)
            for f in df.schema.fields
        ]
    )


def collapse_other(value: Column, keep: Collection[str], other: str = "Other") -> Column:
    """Keep the listed categories, call the rest ``other``; NULL counts as the rest."""
    return F.when(value.isin(*keep), value).otherwise(other)


def null_tokens(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Turn marker texts such as ``"/"`` into NULL in every text column."""
    return df.select(
        *[
            F.when(~named(f.name).isin(*tokens), named(f.name)).alias(f.name)
            if isinstance(f.dataType, StringType)
            else named(f.name)
            for f in df.schema.fields
        ]
    )
