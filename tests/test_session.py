from pathlib import Path

from poseweave.session import new_path, pin, pinned_paths, release, shared_dir


def test_pinned_tables_stand_in_the_shared_folder_until_released(spark):
    before = pinned_paths()
    df = pin(spark.range(5), "five")
    (path,) = [p for p in pinned_paths() if p not in before]
    assert path.startswith(shared_dir(spark)) and df.count() == 5
    folder = Path(path.removeprefix("file:"))
    assert folder.exists()
    release(spark, [path])
    assert not folder.exists() and path not in pinned_paths()
    assert new_path(spark, "a") != new_path(spark, "a")
