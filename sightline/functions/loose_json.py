"""Reading of untyped JSON (variant) values with the source system's truthiness rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whole numbers with more digits may lose some in a double, as they do in the source system.
_EXACT_CHARS = 15
# Exponents outside this range are written as such.
_LEAST_PLAIN, _MOST_PLAIN = -6, 20
_DOUBLE_TEXT = r"\A(-?)(\d+)\.(\d+)(?:E(-?\d+))?\z"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, as a step that filters are not pushed through.

    Spark would push a filter on a parsed field below the parsing, substituting the whole
    chain of expressions for each use of a field. Predicates on generated columns stay put.
    """
    return df.select(F.inline_outer(F.array(F.struct(*df.columns))))


def parse_strict(df: DataFrame, body: str, out: str, wanted: Column) -> DataFrame:
    """Add the variant of a JSON text; null if the text is not exactly one JSON value.

    The parser stops at the end of the first value, so the text is parsed as the first item
    of an array that ends with a marker only this row can know. Parsing is a step of its own
    so that the text is read once however often the result is used.
    """
    mark = F.hex(F.xxhash64(body, F.octet_length(body)))
    text = F.concat(F.lit("["), F.col(body), F.lit(',"'), mark, F.lit('"]'))
    wrapped = df.withColumn("_wrapped", F.try_parse_json(F.when(wanted, text)))
    closed = (
        F.try_variant_get("_wrapped", "$[1]", "string") == mark
    ) & F.try_variant_get("_wrapped", "$[2]", "variant").isNull()
    return wrapped.withColumn(
        out, F.when(closed, F.try_variant_get("_wrapped", "$[0]", "variant"))
    ).drop("_wrapped")


def at(value, path: str) -> Column:
    """Nested value as a variant; null where the path does not exist."""
    return F.try_variant_get(value, path, "variant")


def items(value, path: str) -> Column:
    """Array at a path as array<variant>; anything else is an empty array."""
    return F.coalesce(
        F.try_variant_get(value, path, "array<variant>"),
        F.array().cast("array<variant>"),
    )


def typed(values: Column, paths: dict[str, str], keep: str | None = None) -> Column:
    """For each variant of an array a struct of (kind, text) pairs, one per path.

    Chained `transform`s bind every extracted value once; writing the same as nested
    expressions would repeat the extraction in each use. `keep` adds the variant itself.
    """
    pulled = F.transform(
        values,
        lambda v: F.struct(v.alias("_v"), *[at(v, path).alias(n) for n, path in paths.items()]),
    )

    def pairs(r: Column) -> Column:
        own = [r["_v"].alias(keep)] if keep else []
        return F.struct(
            *own,
            *[
                F.struct(
                    F.schema_of_variant(r[n]).alias("kind"),
                    F.try_variant_get(r[n], "$", "string").alias("text"),
                ).alias(n)
                for n in paths
            ],
        )

    return F.transform(pulled, pairs)


def typed_one(value: Column, paths: dict[str, str]) -> Column:
    """The struct of (kind, text) pairs of a single variant."""
    return F.get(typed(F.array(value), paths), F.lit(0))


def strict_string(pair: Column) -> Column:
    """The value if it is a JSON string, else null."""
    return F.when(pair["kind"] == "STRING", pair["text"])


def number(pair: Column) -> Column:
    """The value as a double if it is a JSON number, else null."""
    k = pair["kind"]
    return F.when(
        (k == "BIGINT") | (k == "DOUBLE") | k.startswith("DECIMAL"), pair["text"].try_cast("double")
    )


def number_text(pair: Column) -> Column:
    """Text of a JSON number: all digits of the double, an exponent only for very small or large ones."""
    short = (pair["kind"] == "BIGINT") & (F.length(pair["text"]) <= _EXACT_CHARS)
    return F.when(short, pair["text"]).otherwise(double_text(number(pair)))


def double_text(value: Column) -> Column:
    """A double as the source system writes it; Spark's own text is taken apart and put together anew."""
    text = F.when(value == 0, "0.0").otherwise(value.cast("string"))
    part = lambda i: F.regexp_extract(text, _DOUBLE_TEXT, i)
    sign, whole = part(1), part(2)
    fraction = F.regexp_replace(part(3), r"\A0\z", "")
    point = F.when(fraction != "", ".").otherwise("")
    exponent = F.coalesce(F.nullif(part(4), F.lit("")).try_cast("int"), F.lit(0))
    digits = F.concat(whole, fraction)
    plus = F.when(exponent > 0, "e+").otherwise("e")
    return (
        F.when(~text.rlike(_DOUBLE_TEXT), text)
        .when(exponent == 0, F.concat(sign, whole, point, fraction))
        .when(
            ~exponent.between(_LEAST_PLAIN, _MOST_PLAIN),
            F.concat(sign, whole, point, fraction, plus, exponent.cast("string")),
        )
        .when(exponent < 0, F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
        .when(F.length(digits) <= exponent + 1, F.concat(sign, F.rpad(digits, exponent + 1, F.lit("0"))))
        .otherwise(
            F.concat(
                sign,
                F.substring(digits, F.lit(1), exponent + 1),
                F.lit("."),
                F.substring(digits, exponent + 2, F.length(digits)),
            )
        )
    )


def truthy_text(pair: Column) -> Column:
    """Text of a value, or null if it counts as empty (missing, null, '', 0, false)."""
    k, text = pair["kind"], pair["text"]
    listed = F.transform(F.from_json(text, "array<string>"), lambda x: F.coalesce(x, F.lit("")))
    return (
        F.when(k == "STRING", F.nullif(text, F.lit("")))
        .when(k.isNull() | (k == "VOID"), None)
        .when(k == "BOOLEAN", F.when(text == "true", text))
        .when(k.startswith("OBJECT"), F.lit("[object Object]"))
        .when(k.startswith("ARRAY"), F.array_join(listed, ","))
        .when(number(pair) != 0, number_text(pair))
    )
