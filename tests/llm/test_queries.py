"""All queries of the subpackage on the smallest tables: columns, types, distinct rows."""

import pytest

from scriptorium.llm import registry

DATA = "/root/testdata/sf0.001"
FOUND = {
    "p1_found": "catalog_id bigint, match_id bigint",
    "p2_found": "lang_row_id bigint, raw_value string, canonical_code string",
    "p3_found": "page_id string, lang string",
    "p4_found": "page_id string, field string",
    "p5_found": "page_id string, line_no int, kind string",
    "p6_found": "page_id string, ocr_sent int, trans_sent int",
    "p9_found": "doc_id_a bigint, doc_id_b bigint",
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in FOUND:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == FOUND[name]
        assert len(set(rows)) == len(rows) and not any(v is None for r in rows for v in r)
        assert name == "p9_found" or rows
    if name == "p9_found":
        assert all(r.doc_id_a < r.doc_id_b for r in rows)
    if name == "p1_found":
        assert all(r.catalog_id < r.match_id for r in rows)
    if name == "p7_fill":
        assert all(0 <= r.unused and r.used <= r.capacity for r in rows)
    if name == "p8_shares":
        for mix in {r.mix_name for r in rows}:
            assert abs(sum(r.actual_share for r in rows if r.mix_name == mix) - 1) < 1e-4
