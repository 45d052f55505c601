"""Scalar rules on texts, paths, symbols, failures and metrics."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, StructType

#: Names that a value which nobody should read stands after.
SECRET_NAMES = ("access key", "api key", "authorization", "bearer", "cookie", "credential", "passphrase", "passwd", "password", "private key", "secret", "session id", "token")
_NAME = "|".join(n.replace(" ", "[ _-]?") for n in SECRET_NAMES)
#: A name, quoted or not, its separator, and a value: in quotes to their end, or as far as no blank, comma or bracket comes.
SECRET = rf"""(?i)\b((?:{_NAME})s?["']?\s*[:=]\s*)((?:bearer|basic)\s+)?("(?:[^"\\]|\\.)*"?|'(?:[^'\\]|\\.)*'?|[^\s,;&}})\]"']+)"""


def redact(text: Column, limit: int = 240) -> Column:
    """A text with the values after secret-like names masked whole, quoted ones with their quotes, cut to a length."""
    return F.left(F.regexp_replace(text, SECRET, "$1<redacted>"), F.lit(limit))


def split_symbol(symbol: Column) -> tuple[Column, Column]:
    """Base and quote of a pair written as six letters or with a separator; null otherwise."""
    clean = F.regexp_replace(F.upper(F.trim(symbol)), "[/_-]", "")
    ok = clean.rlike("^[A-Z]{6}$")
    return F.when(ok, F.substring(clean, 1, 3)), F.when(ok, F.substring(clean, 4, 3))


def path_value(path: Column, key: str) -> Column:
    """The value of ``key=value`` in a partitioned path; empty if the path has no such key."""
    return F.regexp_extract(path, f"(?:^|/){key}=([^/]*)", 1)


def failure_category(error: Column, http_status: Column | None = None) -> Column:
    """Name what failed: a timeout, the network, an HTTP answer, a broken contract of the data, or else something internal."""
    answered = error.isin("HTTPError", "RateLimited") if http_status is None else error.isin("HTTPError", "RateLimited") | (http_status.isNotNull() & (error == "Other"))
    return (
        F.when(error.isNull(), "unknown").when(error.isin("TimeoutError", "Timeout"), "timeout").when(error == "ConnectionError", "network")
        .when(answered, "http").when(error.isin("ValidationError", "SchemaError", "ValueError"), "contract").otherwise("internal")
    )


def retryable(error: Column, http_status: Column | None = None) -> Column:
    """Whether trying again at once can help: timeouts, the network, and answers that blame the server."""
    category = failure_category(error, http_status)
    server = F.coalesce(http_status >= 500, F.lit(False)) if http_status is not None else F.lit(False)
    return F.coalesce(category.isin("timeout", "network") | ((category == "http") & server), F.lit(False))


def capacity_class(free_ratio: Column) -> Column:
    """Free share of a resource: unknown without a sample, critical under 5 %, a warning under 15 %."""
    return F.when(free_ratio.isNull() | F.isnan(free_ratio), "unknown").when(free_ratio < 0.05, "critical").when(free_ratio < 0.15, "warning").otherwise("ok")


# JSON text of each ASCII character inside a string.
_ASCII = [json.dumps(chr(i))[1:-1] for i in range(128)]


def json_string(text: Column) -> Column:
    """A JSON string in ASCII: quotes, backslashes and control characters are escaped, and so is all beyond ASCII, in UTF-16 units."""
    plain = F.concat(F.lit('"'), text, F.lit('"'))
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    table = F.array(*[F.lit(x) for x in _ASCII])
    escaped = F.transform(units, lambda u: F.when(u < "0080", F.element_at(table, F.conv(u, 16, 10).cast("int") + 1)).otherwise(F.concat(F.lit("\\u"), F.lower(u))))
    return F.when(text.rlike(r'\A[ !#-\[\]-~]*\z'), plain).otherwise(F.concat(F.lit('"'), F.array_join(escaped, ""), F.lit('"')))


def json_double(x: Column) -> Column:
    """A double as the shortest decimal that tells it: with an exponent below 1e-4 and from 1e16 on."""
    s = F.abs(x).cast("string")
    sign = F.when(s.startswith("-") | (x < 0) | x.cast("string").startswith("-"), "-").otherwise("")
    n, whole = F.substring_index(s, "E", -1).cast("int"), F.substring_index(s, "E", 1)
    digits = F.regexp_replace(F.regexp_replace(whole, r"\.0$", ""), r"\.", "")
    size = F.length(digits)
    power = F.concat(F.when(n < 0, "e-").otherwise("e+"), F.when(F.abs(n) < 10, "0").otherwise(""), F.abs(n).cast("string"))
    point = F.when(size > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), digits.substr(F.lit(2), size))).otherwise(digits)
    large = F.concat(F.rpad(digits, 32, "0").substr(F.lit(1), n + 1), F.lit("."), F.when(size > n + 1, digits.substr(n + 2, size)).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -n - 1), digits)
    written = F.when((n >= 16) | (n < -4), F.concat(point, power)).when(n > 0, large).otherwise(small)
    finite = F.concat(sign, F.when(s.contains("E"), written).otherwise(s))
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(finite)


def canonical_json(value: Column, kind: DataType) -> Column:
    """JSON without blanks, with the keys of all structures in order; null is null. Kinds that JSON lacks become strings."""
    if isinstance(kind, StructType):
        parts = [F.concat(F.lit(json.dumps(f.name) + ":"), canonical_json(value.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, BooleanType | IntegralType):
        out = value.cast("string")
    elif isinstance(kind, DoubleType | FloatType):
        out = json_double(value.cast("double"))
    else:
        out = json_string(value.cast("string"))
    return F.coalesce(out, F.lit("null"))


def config_digest(value: Column, kind: DataType) -> Column:
    """SHA-256 of a value's canonical JSON."""
    return F.sha2(canonical_json(value, kind), 256)


def label_of(values: Column) -> Column:
    """One value, 'mixed' or 'unknown', from the set of values of a group."""
    return F.when(F.size(values) == 0, "unknown").when(F.size(values) == 1, F.element_at(values, 1)).otherwise("mixed")
