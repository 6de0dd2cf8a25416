import random
from pathlib import Path

import pytest

import corpus_pipeline
from quillmatch.llm.queries import ORACLE, QUERIES

TABLES = Path("/root/testdata/sf0.001")


def corpus(spark, folder):
    r = random.Random(8)
    text = lambda: "\n".join(" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(8, 25))) for _ in range(r.randint(2, 6)))
    rows = [(i, text(), "en", f"s{i % 5}", 0, "x") for i in range(120)]
    rows += [(200 + i, rows[3][1], "en", "s1", 0, "x") for i in range(5)] + [(300, rows[4][1] + " tail", "en", "s2", 0, "x"), (301, None, None, None, None, None), (302, "too short", "en", "s1", 9, None), (None, text(), None, "s3", 0, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{folder}/documents.parquet")
    return rows


def test_stages(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        seen.append({r["doc_id"] for r in docs.collect()})
    clean = set(range(120))
    assert clean <= seen[0] and not {301, 302} & seen[0]
    assert clean <= seen[1] and not set(range(200, 205)) & seen[1]
    assert clean <= seen[2]
    assert seen[3] <= seen[2]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == seen[3]
    assert len({r["sequence_id"] for r in out}) >= -(-sum(r["length"] for r in out) // 2048)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "packing"]


@pytest.mark.skipif(not TABLES.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    import duckdb

    got = sorted(str(tuple(r[c] for c in sorted(r.asDict()))) for r in QUERIES[name](spark, str(TABLES)).collect())
    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.sql(ORACLE[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert got == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
