"""Text, cast and scaling helpers; every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabet and length of a study reference suffix, default prefix.
REF_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
REF_LENGTH = 6
REF_DEFAULT = "PFM"

BLANKS = " \t\n\r\x0b\x0c"


def study_prefix(title: Column) -> Column:
    """Upper-cased text of the first ``[...]`` of a title, ``PFM`` when there is none."""
    bracket = r"\[([^\]]+)\]"
    found = F.upper(F.btrim(F.regexp_extract(title, bracket, 1), F.lit(BLANKS)))
    return F.when(title.rlike(bracket), found).otherwise(F.lit(REF_DEFAULT))


def study_ref(title: Column, seed: Column | None = None) -> Column:
    """``PREFIX_XXXXXX``.

    With ``seed`` (say title and criterion) the suffix is a function of it, so storing a study
    again replaces its rows; without, it is random.
    """
    digest = F.md5((F.rand().cast("string") if seed is None else seed).cast("string"))
    letters = []
    for i in range(REF_LENGTH):
        number = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters.append(F.substring(F.lit(REF_ALPHABET), number % len(REF_ALPHABET) + 1, F.lit(1)))
    return F.concat(study_prefix(title), F.lit("_"), *letters)


def chan_title(nom: Column, net: Column, channel: Column) -> Column:
    """``CAN@<net>@<frame as 3 hex digits>@<channel>``; the frame is the third ``:`` field."""
    frame = F.try_element_at(F.split(nom, ":"), F.lit(3)).try_cast("int")
    return F.concat(F.lit("CAN@"), net, F.lit("@"), F.format_string("%03X", frame), F.lit("@"), channel)


def run_line(line: Column) -> Column:
    """Struct of the five leading ``;`` fields of a run-list line."""
    parts = F.split(line, ";")
    names = ("conducteur", "pret", "cpg", "vis", "run")
    return F.struct(*(F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)))


def storage_name(run: Column, roulage: Column, root: str = "") -> Column:
    """Archive path of one run, from a ``run_line`` struct and the rolling number."""
    campaign = F.concat_ws("_", run["cpg"], run["vis"], run["conducteur"], run["pret"])
    leaf = F.concat_ws("_", run["run"], roulage)
    return F.concat(F.lit(root + "/Archive/"), campaign, F.lit(".ess/"), leaf, F.lit(".mas"))


def trip_token(tcid: Column, runid: Column) -> Column:
    return F.concat_ws("_", tcid.cast("string"), runid.cast("string"))


def list_text(items: Column) -> Column:
    """Array to comma-joined text."""
    return F.concat_ws(",", items.cast("array<string>"))


# A number as text: digits with an exponent if any, or one of the words for NaN and infinity. A cast alone
# would also take a type suffix, as in "12f".
NUMBER = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))\s*$"
NUMERIC_KINDS = ("double", "float", "int", "integer", "bigint", "long", "smallint", "tinyint")


def as_number(text: Column) -> Column:
    """Double that a text reads as, or null."""
    return F.when(text.cast("string").rlike(NUMBER), text.try_cast("double"))


def safe_cast(value: Column, kind: str) -> Column:
    """Typed value, or null where the text does not read as one."""
    if kind.lower() not in NUMERIC_KINDS:
        return value.try_cast(kind)
    text = value.cast("string")
    return F.when(text.rlike(NUMBER) | text.isin("true", "false"), value.try_cast(kind))


def number_json(x: Column) -> Column:
    """JSON text of a double: all digits in place from 1e-4 to below 1e16, an exponent elsewhere; NaN and infinity in quotes."""
    text = x.cast("string")
    placed = F.regexp_replace(x.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    powers = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit(".0E"), F.lit("E")), r"E(\d)", "e+$1"), r"E-(\d+)$", "e-$1")
    powers = F.regexp_replace(powers, r"e-(\d)$", "e-0$1")
    return (F.when(x.isNull(), F.lit("null")).when(~text.rlike("[0-9]"), F.concat(F.lit('"'), text, F.lit('"')))
            .when(~F.contains(text, F.lit("E")), text).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), placed).otherwise(powers))


def stats_json(low: Column, high: Column, mean: Column) -> Column:
    """``[min,max,mean]`` as JSON text; ``[]`` if any value present is not a number."""
    cols = (low, high, mean)
    numbers = [as_number(c) for c in cols]
    broken = None
    for raw, number in zip(cols, numbers):
        bad = raw.isNotNull() & number.isNull()
        broken = bad if broken is None else broken | bad
    return F.when(broken, F.lit("[]")).otherwise(F.concat(F.lit("["), F.concat_ws(",", *map(number_json, numbers)), F.lit("]")))


def study_date(text: Column) -> Column:
    """Typed view of a period date kept as ``DD/MM/YYYY`` or ISO text."""
    return F.coalesce(
        F.try_to_date(text, "dd/MM/yyyy"),
        F.try_to_date(text, "yyyy-MM-dd"),
    )


def minmax_clip(x: Column, low: Column, high: Column, eps: float = 1e-6) -> Column:
    """Scale to [0, 1] and keep strictly inside it; null where the range is empty."""
    scaled = F.try_divide(x - low, high - low)
    return F.greatest(F.least(scaled, F.lit(1.0 - eps)), F.lit(eps))


def plotting_position(i: Column, n: Column) -> Column:
    """Median rank of the i-th of n values."""
    return (i - F.lit(0.3)) / (n + F.lit(0.4))
