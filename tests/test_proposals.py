from snapweave.sources.proposals import as_text, propose

HEADER = ["Genetic ID (suffixes)", "Master ID", "Skeletal code", "Sex ratio [Y/X]", "Molecular Sex", "SNPs hit on autosomal targets (1240k)", "SNPs hit on autosomal targets (HO)", "Lat.", "Long.", "Group ID", "ASSESSMENT WARNINGS", "ASSESSMENT", "odd"]


def test_fields_are_proposed_by_their_headers():
    x = propose(HEADER)
    assert x.columns == {
        "genetic_id": 1, "individual_id": 2, "skeletal_code": 3, "group_id": 10, "latitude": 8, "longitude": 9, "snps_hit_1240k": 6, "snps_hit_ho": 7, "molecular_sex": 5, "sex_ratio_yx": 4, "assessment": 12, "assessment_warnings": 11,
    }
    assert (x.widths, x.signature) == ((13,), ("genetic_id", "master_id"))
    assert "group_id                     10\n" in as_text(x) and "full_date                    -\n" in as_text(x)
