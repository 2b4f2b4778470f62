"""Queries and SQL of the operators in this package."""

from __future__ import annotations

from pagewright.llm import languages, lookalike, mixing, overlap, packing, residue, scans, splits, tokens

QUERIES = {
    f.__name__: f
    for f in (
        scans.p1_found, scans.p1_pages,
        splits.p2_found, splits.p2_splits, splits.p2_shares,
        tokens.p3_found, tokens.p3_tokens, tokens.p3_budget, tokens.p3_pages, tokens.p3_accuracy,
        languages.p4_found, languages.p4_documents, languages.p4_segments,
        lookalike.p5_found, lookalike.p5_canonical,
        overlap.p6_found, overlap.p6_report,
        packing.p7_containers, packing.p7_fill, packing.p7_invariants,
        mixing.p8_mixture, mixing.p8_shares, mixing.p8_invariants,
        residue.p9_found, residue.p9_marked, residue.p9_kept, residue.p9_hosts,
    )
}

ORACLE_SQL = {
    "p2_found": splits.P2_FOUND_SQL, "p2_splits": splits.P2_SPLITS_SQL, "p2_shares": splits.P2_SHARES_SQL, "p3_found": tokens.P3_FOUND_SQL, "p3_accuracy": tokens.P3_ACCURACY_SQL, "p5_found": lookalike.found_sql(),
    "p7_invariants": packing.P7_INVARIANTS_SQL, "p8_invariants": mixing.P8_INVARIANTS_SQL,
}
