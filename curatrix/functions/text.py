"""Text rules of the catalog as native column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def fold(text: Column, ascii_only: bool = False) -> Column:
    """Compatibility form, lower case, single blanks. Spark has no NFKC, so text that is not ASCII goes
    through pandas; with ``ascii_only`` the caller vouches that there is none."""
    x = text if ascii_only else F.when(text.rlike(r"[^\x00-\x7F]"), _compatible(text)).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def title_norm(text: Column, ascii_only: bool = False) -> Column:
    """Folded, without punctuation other than hyphens. Null for what is empty then."""
    x = F.regexp_replace(fold(text, ascii_only), r"(?U)[^\w\s-]", "")
    return F.nullif(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit(""))


def title_tokens(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


#: License labels in the order in which they are tried. Fixed values.
LICENSES = (
    ("cc0", r"\bcc0\b|\bcco\b|creative commons 0|cc 0 universal|public domain \(cc0\)"),
    ("pddl", r"\bpddl\b|\bppdl\b|public domain dedication|opendatacommons\.org/licenses/pddl|odc-pddl"),
    ("cc-by-nc-4.0", r"cc[- ]by[- ]nc|creative commons (attribution[- ]non[ -]commercial|noncommercial)"),
    ("cc-by-4.0", r"cc by\b|cc[- ]by[- ]4|creative commons attribution|creative commons by\b"),
    ("pddl", r"^public domain$|^pd$|\bpublic domain\b"),
)
NO_LICENSE = r"not specified|unspecified|n/?a\b|unknown|no license|none"


def license_label(raw: Column, ascii_only: bool = False) -> Column:
    """The canonical license; null for absent, unknown and explicitly missing ones."""
    x = fold(raw, ascii_only)
    out = F.when(x.rlike(NO_LICENSE) & (F.length(x) < 40), F.lit(None).cast("string"))
    for label, pattern in LICENSES:
        out = out.when(x.rlike(pattern), label)
    return out


UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def size_label(n: Column) -> Column:
    """Bytes in the largest fitting unit with one decimal, which is left out where it is 0."""
    out = F.when(n.isNull() | (n <= 0), F.lit(None).cast("string"))
    for i, unit in enumerate(UNITS):
        value = n / float(1024**i)
        label = F.concat(n.cast("long").cast("string"), F.lit(" B")) if i == 0 else F.regexp_replace(F.concat(F.format_string("%.1f", F.round(value, 1)), F.lit(" " + unit)), r"\.0 ", " ")
        out = out.when(value < 1024, label) if unit != "PB" else out.otherwise(label)
    return out


def publication_year(*dates: Column) -> Column:
    """The first year from 1900 to 2099 in the first date that has one."""
    return F.coalesce(*[F.regexp_extract(F.coalesce(d, F.lit("")), r"\b(19[0-9]{2}|20[0-9]{2})\b", 1).try_cast("int") for d in dates])


#: Age groups, both ends included; ages between two groups belong to none. Fixed values.
AGE_GROUPS = ((0, 12, "Children"), (13, 17, "Adolescents"), (18, 64, "Adults"), (65, 10_000, "Older Adults"))


def age_groups(ages: Column) -> Column:
    """Groups of an array of ages, first seen first; null where no age falls in one."""

    def one(age: Column) -> Column:
        out = F.lit(None).cast("string")
        for lo, hi, label in AGE_GROUPS:
            out = F.when((age >= lo) & (age <= hi), F.lit(label)).otherwise(out)
        return out

    groups = F.array_distinct(F.array_compact(F.transform(ages, one)))
    return F.when(F.size(groups) > 0, groups)


def html_text(html: Column) -> Column:
    """Tags become blanks, common entities characters, white space single blanks."""
    x = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))
