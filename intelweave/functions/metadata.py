"""Report metadata from file names: pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern of a date in a name, and how its digits are read, in the order they are tried.
DATE_PATTERNS = [
    (r"\((\d{2})-(\d{2})-(\d{4})\)", "mdY"),
    (r"\((\d{4})-(\d{2})-(\d{2})\)", "Ymd"),
    (r"\((\d{2})-(\d{2})-(\d{2})\)", "mdy"),
    (r"_(\d{4})(\d{2})(\d{2})_", "Ymd"),
    (r"(\d{4})-(\d{2})-(\d{2})", "Ymd"),
    (r"(\d{2})-(\d{2})-(\d{4})", "mdY"),
]
# Vendor names, in the order they are tried.
VENDOR_HINTS = [
    "kaspersky", "mandiant", "paloalto", "paloaltonetworks", "symantec", "trendmicro", "microsoft", "proofpoint", "cisco", "cisctal",
    "sentinelone", "eset", "ahnlab", "drweb", "checkpoint", "fortinet", "nccgroup", "crowdstrike", "fireeye", "recordedfuture", "qianxin",
    "qax", "cert", "trellix", "group-ib", "hvconsulting", "lab52", "nsfocus", "telsy", "thedfirreport", "zscaler", "malwarebytes",
    "inquest", "netskope", "cyble", "avast", "alyac",
]
# Words for an unknown group, and words that are no tags.
UNKNOWN_GROUPS = ["未知", "APT", "GROUP"]
NO_TAGS = ["REPORT", "FINAL", "SUMMARY"]


# The characters that Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends, in the Unicode sense; looks at the ends only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def extract_group(name: Column) -> Column:
    first = F.upper(F.split(strip(name), r"(?U)[\s_\-]+", -1)[0])
    number = F.regexp_replace(first, "^APT", "")
    return F.when(first.isin(UNKNOWN_GROUPS) | (first == ""), "UNKNOWN").when(first.rlike(r"^(APT)?\d{1,3}$"), F.concat(F.lit("APT"), number)).otherwise(first)


def extract_date(name: Column) -> Column:
    """The first pattern whose first match is a real date; two-digit years from 69 on are of the 1900s."""
    tries = []
    for pattern, order in DATE_PATTERNS:
        at = {c: F.regexp_extract(strip(name), pattern, k + 1) for k, c in enumerate(order)}
        year = at.get("Y") if "Y" in at else F.concat(F.when(at["y"] >= "69", "19").otherwise("20"), at["y"])
        tries.append(F.to_date(F.try_to_timestamp(F.concat_ws("-", year, at["m"], at["d"]), F.lit("yyyy-MM-dd"))))
    return F.coalesce(*tries)


def extract_vendor(name: Column, group: Column) -> Column:
    lowered = F.lower(strip(name))
    hint = F.coalesce(*[F.when(F.contains(lowered, F.lit(h)), h.upper()) for h in VENDOR_HINTS])
    parts = F.split(strip(name), r"(?U)[()\s]+", -1)
    later = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    named = F.filter(later, lambda p: ~F.startswith(F.upper(p), group) & p.rlike(r"(?U)^\p{L}+$") & (p == F.upper(p)) & (p != F.lower(p)) & (F.length(p) > 2))
    return F.coalesce(hint, F.get(named, F.lit(0)))


def extract_extra_tags(name: Column, group: Column, vendor: Column) -> Column:
    technique = lambda p: F.upper(p).rlike(r"^T\d{4}(\.\d{3})?$")
    stays = lambda p: (p != "") & (F.upper(p) != group) & ~F.upper(p).eqNullSafe(vendor) & (technique(p) | (~F.upper(p).isin(NO_TAGS) & (F.length(p) > 2)))
    return F.transform(F.filter(F.split(strip(name), r"(?U)[()\s_]+", -1), stays), lambda p: F.when(technique(p), F.upper(p)).otherwise(p))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def build_report_id(group: Column, date: Column, vendor: Column, raw_name: Column) -> Column:
    named = F.when(F.coalesce(group, F.lit("")) == "", "UNKNOWN").otherwise(group)
    slug = slugify(F.concat_ws("_", named, F.date_format(date, "yyyyMMdd"), F.when(vendor != "", vendor)))
    return F.concat(F.when(slug == "", "report").otherwise(slug), F.lit("_"), F.substring(F.md5(raw_name.cast("binary")), 1, 8))


def join_tags(tags: Column) -> Column:
    return F.array_join(tags, "|")


def split_tags(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, r"\|", -1))


def with_metadata(df, name: str = "raw_name"):
    """Adds apt_group, published_date, source_vendor, extra_tags and report_id to rows with a raw name."""
    df = df.withColumn("apt_group", extract_group(F.col(name))).withColumn("published_date", extract_date(F.col(name)))
    df = df.withColumn("source_vendor", extract_vendor(F.col(name), F.col("apt_group")))
    df = df.withColumn("extra_tags", extract_extra_tags(F.col(name), F.col("apt_group"), F.col("source_vendor")))
    return df.withColumn("report_id", build_report_id(F.col("apt_group"), F.col("published_date"), F.col("source_vendor"), F.col(name)))
