"""The registered queries: those with SQL against DuckDB, the others by their columns."""

import duckdb
import pytest

from ledgerline.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "fingerprint", "component_id"],
    2: ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    4: ["doc_id", "start", "n_tokens", "ids_crc32"],
    5: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    6: ["page_id", "host", "path", "rule", "verdict"],
    9: ["doc_id", "size", "source_size", "target", "taken"],
    10: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}


def numbered(name):
    """N of opN_<name>; 0 for what only serves a comparison."""
    return int(name[2:].split("_")[0]) if name.startswith("op") else 0


@pytest.mark.parametrize("name", queries.queries())
def test_query(name, spark):
    df = queries.queries()[name](spark, SF)
    assert df.columns[: len(COLUMNS.get(numbered(name), []))] == COLUMNS.get(numbered(name), [])
    rows = df.collect()
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "conversations"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(sql)
        at = [want.columns.index(c) for c in df.columns]
        plain = lambda r: tuple(round(x, 2) if isinstance(x, float) else x for x in r)
        assert sorted(map(repr, map(plain, rows))) == sorted(repr(plain(r[i] for i in at)) for r in want.fetchall())
    else:
        assert rows


def test_all_ten_are_there():
    assert sorted(n for n in map(numbered, queries.queries()) if n) == list(range(1, 11))
