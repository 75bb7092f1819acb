"""Queries against their SQL on small tables of odd values."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__


def both(spark, folder, name, **tables):
    """(rows of the query, rows of its SQL) over ``tables``."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, folder / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    want = con.execute(__spark_entry__.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in df.columns]
    return sorted(map(tuple, df.collect())), sorted(tuple(r[i] for i in at) for r in want.fetchall())


def _conversations():
    """Words that begin, as ASCII has them, behind a letter of another script or with an accent."""
    many = " ".join(f"w{i}" for i in range(14))
    texts = [f"Mañana {many} fin", f"y, él {many}", f"ñthe the {many}", "éwhy is it", "día 2024é ß1999 are", f"é {many} é", "été (a) b (c)", "what is ñdo", many, ""]
    return pa.table({
        "conv_id": pa.array([i // 4 for i in range(24)], pa.int64()), "turn": pa.array([i % 4 for i in range(24)], pa.int32()),
        "role": ["user", "assistant"] * 12, "text": [texts[i % len(texts)] for i in range(24)],
    })


@pytest.mark.parametrize("name", ["qq4_fluency", "qq6_quality", "qq2_type_consistency", "qq3_answerability"])
def test_word_boundaries_of_question_quality(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, conversations=_conversations())
    assert [r[0] for r in got] == [r[0] for r in want] and [r[1] for r in got] == pytest.approx([float(r[1]) for r in want])


def test_small_negative_values_keep_their_sign(spark, tmp_path):
    """Rounded, they are a zero below zero; equal as numbers, so spellings are compared."""
    values = [-1e-6, 1e-6, -4.9e-6, 0.0, -0.0, -5.1e-6, 0.015625, -0.015625]
    vectors = [[values[(i + j) % len(values)] for j in range(64)] for i in range(30)]
    table = pa.table({"vec_id": pa.array(range(30), pa.int64()), "label": pa.array([i % 3 for i in range(30)], pa.int32()), "embedding": pa.array(vectors, pa.list_(pa.float32()))})
    got, want = both(spark, tmp_path, "snk5_batches", embeddings=table)
    assert len(got) == 20 and [(i, repr(list(v))) for i, v in got] == [(i, repr(list(v))) for i, v in want]
