"""Vector expressions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Node types in the order of their slots; a last slot is for the report and anything else.
NODE_TYPES = [
    "IP", "DOMAIN", "EMAIL", "HASH_MD5", "HASH_SHA1", "HASH_SHA256", "MITRE_TECH", "CVE", "URL", "FILE_PATH", "REGISTRY", "PORT", "PROCESS", "SERVICE",
    "USER_AGENT", "FILE_EXT", "OPERATION", "CAMPAIGN", "SSL_CERT", "CWE", "INDUSTRY", "CITY", "HOSTNAME", "USER_ACCOUNT", "THREAT_INTEL_SOURCE", "MALWARE", "TOOL", "ORG", "COUNTRY",
]
DIM = 64


def type_index(label: Column) -> Column:
    at = F.array_position(F.lit(NODE_TYPES), label)
    return F.when(at > 0, at - 1).otherwise(len(NODE_TYPES)).cast("int")


def type_one_hot(label: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(len(NODE_TYPES))), lambda i: F.when(i == type_index(label), 1.0).otherwise(0.0))


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bucket(token: Column, dim: int = DIM) -> Column:
    """The 128-bit md5 number of token modulo dim, from four parts of 32 bits."""

    def fold(h: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(3 if (1 << 32) % dim == 0 else 0, 4):  # parts that are multiples of dim add nothing
            out = F.pmod(out * ((1 << 32) % dim) + F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long"), F.lit(dim))
        return out.cast("int")

    return let(F.md5(token.cast("binary")), fold)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-zA-Z0-9]+", -1), lambda t: t != "")


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def l2_normalized(x: Column) -> Column:
    return let(x, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda e: e / n)).otherwise(v)))


def hash_vector(text: Column, dim: int = DIM) -> Column:
    """Counts of the tokens by bucket, of length 1; zeros for a text without tokens."""
    # the buckets as a string of one character each; a bucket's count is what the string loses without it
    held = F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.char(bucket(t, dim) + 48))
    whole = F.concat(F.array_join(held, ""), F.lit(""))
    counts = let(whole, lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.length(h) - F.length(F.replace(h, F.char(i + 48), F.lit("")))).cast("double")))
    return l2_normalized(counts)


def text_stats(text: Column) -> Column:
    """Length up to 100 as a share, share of digits, share of letters."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.array(F.least(F.length(text) / 100.0, F.lit(1.0)), F.regexp_count(text, F.lit(r"\p{Nd}")) / n, F.regexp_count(text, F.lit(r"\p{L}")) / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for missing vectors, unequal lengths and zero vectors."""
    size = norm(F.transform(a, lambda v: v.cast("double"))) * norm(F.transform(b, lambda v: v.cast("double")))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)
