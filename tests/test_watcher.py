import os

from marlstone.sources.watcher import WatchedTree, listing


def test_changes_are_told_once_over_restarts(spark, tmp_path):
    spark.dataSource.register(WatchedTree)
    root, out = tmp_path / "tree", []

    def look():
        seen = []
        stream = spark.readStream.format("watched_tree").option("root", str(root)).option("manifests", f"file://{tmp_path}/manifests").option("suffix", ".txt").load()
        stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).start().awaitTermination()
        out.extend(seen)
        return sorted((path, change, size) for path, change, size, _ in seen)

    assert look() == []  # no folder yet
    (root / "a").mkdir(parents=True)
    for name, text in (("a/x.txt", "one"), ("a/y.txt", "two"), ("z.txt", "three"), ("z.md", "no")):
        (root / name).write_text(text)
    assert look() == [("a/x.txt", "added", 3), ("a/y.txt", "added", 3), ("z.txt", "added", 5)]
    assert look() == []
    (root / "a/x.txt").write_text("longer")
    os.utime(root / "a/y.txt", ns=(1, 1))  # of the same size
    (root / "z.txt").unlink()
    (root / "b.txt").write_text("")
    assert look() == [("a/x.txt", "changed", 6), ("a/y.txt", "changed", 3), ("b.txt", "added", 0), ("z.txt", "removed", None)]
    assert look() == [] and len(out) == 7 and set(listing(str(root), ".txt")) == {"a/x.txt", "a/y.txt", "b.txt"}
