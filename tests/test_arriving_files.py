"""Files of a stream keep their size as the tables grow."""

import glob

from bookmark_lake.checks import streams


def test_arriving_files_keep_their_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    for n, files in ((300, 6), (1000, 24)):
        folder = str(tmp_path / str(n))
        streams._arriving(spark.range(n), "id", folder, 3)
        assert len(glob.glob(f"{folder}/*.parquet")) == files
        assert spark.read.parquet(folder).count() == n
