"""Column functions of the domain: normalisation, gender and age rules, text, numbers, dates."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfold.functions import values as V


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    """A value of a small fixed dictionary."""
    found = F.element_at(F.create_map(*[x if isinstance(x, Column) else F.lit(x) for x in chain(*table.items())]), F.coalesce(key, F.lit("")))
    return found if default is None else F.coalesce(found, default)


def weight(kind: Column, scheme: str = "pipeline") -> Column:
    return lookup(V.WEIGHTS[scheme], kind, F.lit(V.DEFAULT_WEIGHT))


def age_group(age: Column) -> Column:
    return F.when(age <= 12, "kid").when(age <= 19, "teen").when(age.isNotNull(), "adult")


def allowed_genders(age: Column, gender: Column) -> Column:
    """Product genders that fit a user: all without age or gender; a child's own for under 13; Unisex from 13 on."""
    def of(*names: str) -> Column:
        return F.array(*[F.lit(n) for n in names])

    g = F.lower(F.trim(gender))
    child = F.when(g == "male", of("Boys")).when(g == "female", of("Girls")).otherwise(of("Boys", "Girls"))
    grown = F.when(g == "male", of("Men", "Unisex")).when(g == "female", of("Women", "Unisex")).otherwise(of("Men", "Women", "Unisex"))
    return F.when(age.isNull() | gender.isNull(), of(*V.ALL_GENDERS)).when(age < 13, child).otherwise(grown)


def normal_gender(gender: Column) -> Column:
    g = F.lower(F.trim(gender))
    return (
        F.when(g.isin("male", "man", "men", "boy", "boys", "m"), "male")
        .when(g.isin("female", "woman", "women", "girl", "girls", "f"), "female")
        .when(g.isin("unisex", "u"), "unisex")
    )


def gender_fits(product: Column, user: Column) -> Column:
    p, u = normal_gender(product), normal_gender(user)
    return F.coalesce((p == "unisex") | (p == u), F.lit(False))


def slug(text: Column, joint: str = "_") -> Column:
    out = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", joint)
    return F.regexp_replace(out, f"^{joint}+|{joint}+$", "")


def escaped(term: str) -> str:
    """A term as a literal regular expression."""
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term)


def contains(column: Column, term: str) -> Column:
    """Case-insensitive substring."""
    return F.contains(F.lower(column), F.lit(term.lower()))


def same_text(column: Column, value: str) -> Column:
    return F.lower(column) == value.lower()


def normal_id(column: Column) -> Column:
    """An integer's digits if it is one, else the trimmed text; blank is null."""
    text = F.trim(column)
    return F.when(text == "", None).otherwise(F.coalesce(text.try_cast("bigint").cast("string"), text))


def round4(column: Column) -> Column:
    return F.round(column, 4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(F.try_divide(dot(a, b), n))


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scaled to [0, 1]; a range of 0 counts as 1."""
    return (x - low) / F.when(high == low, 1.0).otherwise(high - low)


def blend(graph: Column, content: Column, alpha: float) -> Column:
    return alpha * graph + (1 - alpha) * content


def inverse_sqrt(degree: Column) -> Column:
    return F.when(degree > 0, 1 / F.sqrt(degree)).otherwise(0.0)


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(slope * x)


def log_sigmoid(x: Column) -> Column:
    """-log(1 + exp(-x)), without overflow for large negative x."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def parsed_time(text: Column) -> Column:
    """The first of the known formats that fits; null if none does."""
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def combinations(items: Column, k: int) -> Column:
    """All ways to take k elements of a short array, in its order: array of arrays. The array must be
    bounded (a top list), as the result grows with its length to the k."""
    grown = F.aggregate(items, F.array(F.slice(items, 1, 0)), lambda done, x: F.concat(done, F.transform(F.filter(done, lambda d: F.size(d) < k), lambda d: F.concat(d, F.array(x)))))
    return F.filter(grown, lambda d: F.size(d) == k)


def iso_time(text: Column, now: Column) -> Column:
    """A time in ISO form, by its own zone (`Z`, an offset, or none: UTC); what is blank or none gets `now`.
    The session's zone must be UTC."""
    fits = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{3}(\d{3})?)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    zone = F.nullif(F.regexp_extract(text, r"[T ].*?([+-]\d{2}:?\d{2})$", 1), F.lit(""))
    zone = F.regexp_replace(F.coalesce(zone, F.lit("+00:00")), r"^(...):?(..)$", "$1:$2")
    clock = F.regexp_replace(F.nullif(F.regexp_extract(text, r"^.{10}[T ]([0-9:.,]+)", 1), F.lit("")), ",", ".")
    parts = F.coalesce(clock, F.lit("00"))
    whole = F.when(F.length(parts) == 2, F.concat(parts, F.lit(":00:00"))).when(F.length(parts) == 5, F.concat(parts, F.lit(":00"))).otherwise(parts)
    return F.coalesce(F.when(fits, F.try_to_timestamp(F.concat(F.substring(text, 1, 10), F.lit(" "), whole, zone))), now)


def first_image(images: Column, literal: Column) -> Column:
    """The first image of a cell: of a list literal its first element (`literal`: the cell's literals as JSON), else the
    trimmed cell itself if it begins with http; null if there is none."""
    text = F.trim(images)
    listed = F.when(text.startswith("["), F.try_variant_get(F.try_parse_json(literal), "$[0]", "string"))
    return F.coalesce(listed, F.when(text.startswith("http"), text))
