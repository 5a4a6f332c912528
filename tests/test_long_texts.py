"""Queries against their SQL where texts are longer than the sources' bound on a body."""

import duckdb

from docketry.plans import catalogue
from docketry.sources.messages import MAX_BODY_CHARS


def test_headers_of_long_texts(spark, tmp_path):
    """The SQL of ``hdr_rfc`` counts all of a body, that of ``row_judged`` the part within the bound."""
    long = "first\nline " + "w " * (MAX_BODY_CHARS // 2)
    rows = [(1, "short", "en", "web"), (2, long, "de", "web"), (3, long + "x", "fr", "web"), (4, "line\n" + long * 2, "es", "web")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    con.execute("create view labels as select 1 as doc_id, 1 as quality, 0 as toxic")
    con.execute("create view conversations as select 1 as conv_id, 0 as turn, 'a' as text")
    for name, columns in (("hdr_rfc", ["from_addr", "recipients", "subject", "n"]), ("row_judged", ["doc_id", "token_estimate", "subject_norm", "truncated"])):
        want = con.execute(f"select {', '.join(columns)} from ({catalogue.ORACLE[name]})").fetchall()
        assert sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).select(columns).collect())) == sorted(want)
