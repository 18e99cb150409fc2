"""The queries of this subpackage and the SQL that some of them must equal."""

from __future__ import annotations

from . import decontamination, fingerprints, jaccard, language, lines, mixing, periods, search, secrets, substrings, suffixes, toxicity, warc


def queries() -> dict:
    return {
        "op1_warc_revisits": warc.op1_warc_revisits,
        "op2_benchmark_leaks": decontamination.op2_benchmark_leaks,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_source_mix": mixing.op5_source_mix,
        "op6_substring_dedup": substrings.op6_substring_dedup,
        "op7_suffix_dedup": suffixes.op7_suffix_dedup,
        "op8_line_dedup": lines.op8_line_dedup,
        "op9_fingerprints": fingerprints.op9_fingerprints,
        "op10_language": language.op10_language,
        "op11_secrets": secrets.op11_secrets,
        "op12_ranked_search": search.op12_ranked_search,
        "op13_periodic_runs": periods.op13_periodic_runs,
    }


def oracle_sql() -> dict:
    return {
        "op1_warc_revisits": warc.ORACLE,
        "op2_benchmark_leaks": decontamination.ORACLE,
        "op3_jaccard_join": jaccard.ORACLE,
        "op5_source_mix": mixing.oracle(),
        "op6_substring_dedup": substrings.ORACLE,
        "op7_suffix_dedup": suffixes.ORACLE,
        "op8_line_dedup": lines.oracle(),
        "op12_ranked_search": search.ORACLE,
        "op13_periodic_runs": periods.ORACLE,
    }
