"""A layout proposed for a header that no known layout fits, to be checked by eye and added."""

from __future__ import annotations

from .layouts import FIELDS, Layout, normalized

# How the normalized headers of a field begin, the likeliest first.
BEGINNINGS = {
    "genetic_id": ("genetic_id", "version_id"),
    "persistent_genetic_id": ("persistent_genetic_id",),
    "individual_id": ("individual_id", "master_id"),
    "skeletal_code": ("skeletal_code",),
    "skeletal_element": ("skeletal_element",),
    "publication": ("publication",),
    "date_method": ("method_for_determining_date",),
    "date_mean_bp": ("date_mean_in_bp",),
    "date_sd_bp": ("date_standard_deviation_in_bp",),
    "full_date": ("full_date",),
    "group_id": ("group_id", "groupid", "group_label"),
    "locality": ("locality",),
    "country_or_political_entity": ("political_entity", "country"),
    "latitude": ("lat",),
    "longitude": ("long",),
    "pulldown_strategy": ("pulldown_strategy",),
    "data_source_or_type": ("data_source", "data_type"),
    "n_libraries": ("no_libraries",),
    "snps_hit_1240k": ("snps_hit_on_autosomal_targets",),
    "snps_hit_ho": ("snps_hit_on_autosomal_targets",),
    "coverage_1240k": ("1240k_coverage", "mean_coverage", "coverage_on_autosomal_targets"),
    "molecular_sex": ("molecular_sex", "sex"),
    "y_haplogroup_isogg": ("y_haplogroup",),
    "mtdna_haplogroup": ("mtdna_haplogroup",),
    "mtdna_coverage": ("mtdna_coverage",),
    "damage_rate": ("damage_rate",),
    "sex_ratio_yx": ("sex_ratio",),
    "library_type": ("library_type",),
    "assessment": ("assessment",),
    "assessment_warnings": ("assessment_warning",),
}


def propose(header: list[str], name: str = "?") -> Layout:
    """A field's column is the first free one that is called by its likeliest beginning, exactly if any is."""
    names = [normalized(h) for h in header]
    taken: dict[str, int] = {}
    for exact in (True, False):
        for field in FIELDS:
            for start in BEGINNINGS[field]:
                free = (k for k, n in enumerate(names, 1) if k not in taken.values() and (n == start if exact else n.startswith(start)))
                if field not in taken and (k := next(free, None)):
                    taken[field] = k
    return Layout(name, (), (len(header),), (names[0], names[1]), {f: taken[f] for f in FIELDS if f in taken})


def as_text(layout: Layout) -> str:
    """The proposal as lines of the column table."""
    return "".join(f"{n:<28} {layout.columns.get(n, '-')}\n" for n in FIELDS)
