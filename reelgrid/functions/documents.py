"""Nested and encoded fields: lists in text, profile documents, service answers, packed vectors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_field(text: Column) -> Column:
    """A JSON array of strings, or else a comma-separated list, trimmed; empty if null."""
    as_json = F.from_json(text, "array<string>")
    as_csv = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    is_json = F.trim(text).startswith("[") & as_json.isNotNull()
    return F.coalesce(F.when(is_json, as_json).otherwise(as_csv), F.array().cast("array<string>"))


def non_empty(new: Column, old: Column) -> Column:
    """The new text if it says something, else the old one."""
    return F.coalesce(F.nullif(F.trim(new), F.lit("")), old)


def non_empty_list(new: Column, old: Column) -> Column:
    return F.when(F.size(new) > 0, new).otherwise(old)


# Answers of a catalogue service, already parsed into structs.


def directors_of(crew: Column) -> Column:
    return F.transform(F.filter(crew, lambda x: (x["job"] == "Director") & x["name"].isNotNull()), lambda x: x["name"])


def leading_cast(cast: Column, n: int = 5) -> Column:
    """Names of the first n entries; an entry without a name takes its place all the same."""
    return F.filter(F.transform(F.slice(cast, 1, n), lambda x: x["name"]), lambda x: x.isNotNull() & (x != ""))


def us_certification(results: Column) -> Column:
    """Of each US block the first certification that isn't empty; of several blocks the last."""
    blocks = F.filter(results, lambda x: x["iso_3166_1"] == "US")
    firsts = F.transform(blocks, lambda b: F.get(F.filter(F.transform(b["release_dates"], lambda r: r["certification"]), lambda c: c.isNotNull() & (c != "")), F.lit(0)))
    known = F.filter(firsts, lambda x: x.isNotNull())
    return F.get(known, F.size(known) - 1)


def names_of(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: x["name"]), lambda x: x.isNotNull() & (x != ""))


PROFILE = (
    "user_id string, lambda double, watch_history array<bigint>, watchlist array<bigint>, highly_rated array<bigint>, poorly_rated array<bigint>, "
    "genre_affinity map<string,double>, director_affinity map<string,double>, actor_affinity map<string,double>, tag_affinity map<string,double>, "
    "era_affinity map<string,double>, dealbreakers array<string>, query_history array<string>"
)


def profile_document(fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def parsed_profile(document: Column) -> Column:
    """A profile document with every missing list and map empty and the slider at 0.7; null if it is no JSON object.

    Fields are taken inside a function of the parsed document: outside, each of them would parse the text again.
    """
    empty = lambda kind: F.from_json(F.lit("[]" if kind.startswith("array") else "{}"), kind)

    def filled(raw: Column) -> Column:
        parts = []
        for field in PROFILE.split(", "):
            name, kind = field.split(" ", 1)
            value = raw.getField(name)
            if name == "lambda":
                value = F.coalesce(value, F.lit(0.7))
            elif kind != "string":
                value = F.coalesce(value, empty(kind))
            parts.append(value.alias(name))
        return F.struct(*parts)

    raw = F.from_json(document, PROFILE, {"mode": "PERMISSIVE"})
    return F.when(is_document(document), F.get(F.transform(F.array(raw), filled), F.lit(0)))


def is_document(document: Column) -> Column:
    """Whether the text is a JSON object."""
    return F.try_parse_json(document).isNotNull() & F.trim(document).startswith("{")


def unpacked_vector(packed: Column) -> Column:
    """Little-endian 32-bit floats as an array; Arrow batches through numpy, at ingest only."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for some in batches:
            yield pa.array([None if x is None else np.frombuffer(x[: len(x) // 4 * 4], "<f4") for x in some.to_pylist()], pa.list_(pa.float32()))

    from pyspark.sql.functions import ArrowUDFType

    return F.arrow_udf(run, "array<float>", ArrowUDFType.SCALAR_ITER)(packed)


def packed_vector(vector: Column) -> Column:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for some in batches:
            yield pa.array([None if x is None else np.array(x, "<f4").tobytes() for x in some.to_pylist()], pa.binary())

    from pyspark.sql.functions import ArrowUDFType

    return F.arrow_udf(run, "binary", ArrowUDFType.SCALAR_ITER)(vector)


def cache_key(address: Column) -> Column:
    """The name under which what lies at an address is kept."""
    return F.md5(address.cast("binary"))
