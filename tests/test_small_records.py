"""Records of a single radial, shorter than a frame, have bytes like any other."""

from squall.plans import registry


def test_a_tilt_of_one_radial(spark, tmp_path):
    rows = [(k, [0.1] * 64, 0 if k else 1) for k in range(4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for r in registry.QUERIES["b05_opened_records"](spark, str(tmp_path)).collect():
        assert r.has_bytes and r.n_records == 2 and r.n_compressed == 0
    saved = registry.QUERIES["l01_save_records"](spark, str(tmp_path)).first()
    assert (saved.n_written, saved.n_read, saved.has_bytes) == (4, 4, True)
