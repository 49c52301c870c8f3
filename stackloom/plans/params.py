"""Settings of an assembly and their defaults."""

from __future__ import annotations

#: names and defaults that must agree with the project's settings files (fixed values)
DEFAULTS: dict[str, object] = {
    "assembly_name": None, "project_dir": "./", "raw_fastq_path": None, "barcodes_path": None, "sorted_fastq_path": None, "assembly_method": "denovo", "reference_sequence": None, "datatype": "rad",
    "restriction_overhang": ("TGCAG", ""), "max_low_qual_bases": 5, "phred_Qscore_offset": 33, "mindepth_statistical": 6, "mindepth_majrule": 6, "maxdepth": 10000, "clust_threshold": 0.85, "max_barcode_mismatch": 0,
    "filter_adapters": 2, "filter_min_trim_len": 35, "max_alleles_consens": 2, "max_Ns_consens": 0.05, "max_Hs_consens": 0.05, "min_samples_locus": 4, "max_SNPs_locus": 0.20, "max_Indels_locus": 8, "max_shared_Hs_locus": 0.5,
    "trim_reads": (0, 0, 0, 0), "trim_loci": (0, 0, 0, 0), "output_formats": ("p", "s", "l"), "pop_assign_file": None, "reference_as_filter": None,
}

DATATYPES = ("rad", "gbs", "ddrad", "pairddrad", "pairgbs", "2brad", "pair3rad")


def check(values: dict[str, object]) -> dict[str, object]:
    """The settings with defaults filled in; an unknown name or a value that cannot be is an error."""
    unknown = set(values) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
    out = DEFAULTS | values
    if out["datatype"] not in DATATYPES:
        raise ValueError(f"datatype must be one of {', '.join(DATATYPES)}")
    if not 0 < float(out["clust_threshold"]) <= 1:
        raise ValueError("clust_threshold must lie in (0, 1]")
    if int(out["mindepth_statistical"]) < int(out["mindepth_majrule"]):
        raise ValueError("mindepth_statistical must not be below mindepth_majrule")
    return out
