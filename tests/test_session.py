import pytest

from eventlake.errors import SharedFolderUnset
from eventlake.session import complete, delete, shared_dir, store_text


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    def __init__(self, master, folder=None):
        self.conf = Conf({"spark.checkpoint.dir": folder} if folder else {})
        self.sparkContext = type("Context", (), {"master": master})


def test_only_a_local_master_gets_a_folder_of_its_own():
    assert shared_dir(Fake("local[4]")) == shared_dir(Fake("local")) and shared_dir(Fake("local")).startswith("file:///")
    for master in ("local-cluster[2,1,1024]", "yarn", "k8s://x", "spark://x:7077"):
        assert shared_dir(Fake(master, "s3a://bucket/shared/")) == "s3a://bucket/shared"
        with pytest.raises(SharedFolderUnset):
            shared_dir(Fake(master))


def test_complete_and_delete(spark, tmp_path):
    top = f"file://{tmp_path}/t"
    assert complete(spark, top) == []
    spark.range(3).write.parquet(f"{top}/1")
    (tmp_path / "t" / "2").mkdir()
    assert complete(spark, top) == ["1"]
    delete(spark, f"{top}/1", f"{top}/none")
    assert complete(spark, top) == []


def test_small_texts(spark, tmp_path):
    folder = f"file://{tmp_path}/x/7"
    for text in ("one\ntwo \u00e9\u4e2d", ""):
        store_text(spark, folder, text)
        assert complete(spark, f"file://{tmp_path}/x") == ["7"]
        assert [r["value"] for r in spark.read.text(folder).collect()] == text.splitlines()
