"""A query's rows beside those of its SQL in DuckDB."""

import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries without SQL that tests/test_models.py holds against NumPy.
NUMPY = {"ALN2_svd_basis", "ALN4_procrustes", "ALN5_project", "ALN6_hybrid_rotations", "ALN7_strict_rotations", "ALN8_fingerprint_template", "ALN9_shared_space",
         "ALN10_zero_shot", "ALN11_few_shot", "ENC4_predict_voxels", "SNK1_save_load", "EXP1_zero_shot", "EXP1_few_shot", "EXP2_fewshot_ablation", "EXP4_loso_sweep",
         "EXP4_sweep_trials", "EXP19_train"}
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else int(v) if v == int(v) and abs(v) < 1e15 else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(sql, data=DATA):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    r = con.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(c) for c in cols]
    return cols, sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
