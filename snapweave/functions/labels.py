"""Ids with suffixes and group labels: parsing, classifying changes, suggesting lifts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known suffixes, country renames, droppable prefixes, and the classes of change in order.
SUFFIXES = ("AG", "DG", "SG", "HO", "TW", "BY", "AA", "EC", "WGC")
COUNTRY_RENAMES = {"Czech": "Czechia"}
DROPPED_PREFIXES = ("Patterson",)
CHANGE_CLASSES = (
    "convention_restructure_suffix",
    "convention_restructure_country",
    "convention_restructure_prefix_drop",
    "convention_restructure_order",
    "convention_restructure_punct",
    "partial",
    "substantive_regroup",
)

_GID = rf"^(.+?)\.({'|'.join(SUFFIXES)})$"
_TAIL = rf"\.({'|'.join(SUFFIXES)})$"


def suffix(gid: Column) -> Column:
    """The last known suffix, NULL if there is none."""
    return F.nullif(F.regexp_extract(gid, _GID, 2), F.lit(""))


def stem(gid: Column) -> Column:
    """The id without that suffix."""
    return F.when(suffix(gid).isNull(), gid).otherwise(F.regexp_extract(gid, _GID, 1))


def without_suffix(label: Column) -> Column:
    return F.regexp_replace(label, _TAIL, "")


def _renamed_country(old: Column, new: Column) -> Column:
    found = F.lit(False)
    for a, b in COUNTRY_RENAMES.items():
        found = found | ((old == a) & (new == b)) | (old.startswith(f"{a}_") & (F.concat(F.lit(b), F.substr(old, F.lit(len(a) + 1))) == new))
    return found


def change_class(old: Column, new: Column) -> Column:
    """How a label changed; the first rule that holds names the class."""
    so, sn = without_suffix(old), without_suffix(new)
    a, b = F.split(so, "_", -1), F.split(sn, "_", -1)
    dropped = F.lit(False)
    for p in DROPPED_PREFIXES:
        dropped = dropped | (so == F.concat(F.lit(f"{p}_"), sn))
    extra_a, extra_b = F.size(F.array_except(a, b)), F.size(F.array_except(b, a))
    rules = (
        (so == sn) & (old != new),
        _renamed_country(so, sn),
        dropped,
        (F.array_sort(a) == F.array_sort(b)) & (a != b),
        (F.translate(so, "-", "_") == F.translate(sn, "-", "_")) & (so != sn),
        (extra_a + extra_b > 0) & ((extra_a == 0) | (extra_b == 0)),
    )
    out = F.when(rules[0], CHANGE_CLASSES[0])
    for rule, name in zip(rules[1:], CHANGE_CLASSES[1:], strict=False):
        out = out.when(rule, name)
    return out.otherwise(CHANGE_CLASSES[-1])


def suggested_lift(label: Column) -> Column:
    """The label without suffix and droppable prefix; NULL if it has no such prefix."""
    bare, out = without_suffix(label), F.lit(None).cast("string")
    for p in reversed(DROPPED_PREFIXES):
        out = F.when(bare.startswith(f"{p}_"), F.substr(bare, F.lit(len(p) + 2))).otherwise(out)
    return out


def normalized_header(header: Column) -> Column:
    """A header up to its first bracket, semicolon or colon, without punctuation, lower-cased, blanks as underscores."""
    text = F.trim(F.regexp_replace(header, r"(?s)[(\[;:].*$", ""))
    text = F.lower(F.trim(F.regexp_replace(text, r"(?U)[^\w\s]", "")))
    return F.regexp_replace(text, r"(?U)\s+", "_")
