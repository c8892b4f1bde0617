"""Looks at a folder that changes between them."""

import os
import shutil

from lamella.streaming import looks as lk


def put(path, size, mtime):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"x" * size)
    os.utime(path, (mtime, mtime))


def told(df):
    return {(r.path.rsplit("/", 1)[1], r.size) for r in df.collect()}


def test_changes_between_looks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lk, "FOLDERS_PER_TASK", 2)
    root, kept = f"{tmp_path}/in", f"{tmp_path}/looks"
    for k in range(9):
        put(f"{root}/d{k % 3}/e{k}/f{k}.tif", k + 1, 1000)
    put(f"{root}/notes.txt", 4, 1000)
    one = lk.take_look(spark, root, kept, 1, (".tif",))
    assert told(lk.changes(lk.look(spark, kept, 0), one)) == {(f"f{k}.tif", k + 1) for k in range(9)}
    os.remove(f"{root}/d0/e0/f0.tif")
    put(f"{root}/d1/e1/f1.tif", 9, 1000)  # other size
    put(f"{root}/d2/e2/f2.tif", 3, 900)  # copied in with an older time
    put(f"{root}/deep/a/b/c/new.tif", 1, 1000)
    two = lk.take_look(spark, root, kept, 2, (".tif",))
    expected = {("f0.tif", -1), ("f1.tif", 9), ("f2.tif", 3), ("new.tif", 1)}
    assert told(lk.changes(lk.look(spark, kept, 1), two)) == expected
    assert told(lk.changes(lk.look(spark, kept, 1), lk.look(spark, kept, 2))) == expected
    assert told(lk.changes(two, lk.take_look(spark, root, kept, 3, (".tif",)))) == set()
    shutil.rmtree(f"{root}/deep")
    again = lk.take_look(spark, root, kept, 3, (".tif",))  # taken again, with fewer levels than before
    assert told(lk.changes(lk.look(spark, kept, 2), again)) == {("new.tif", -1)}


def test_empty_folder_and_none(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    assert lk.take_look(spark, f"{tmp_path}/in", f"{tmp_path}/looks", 1).count() == 0
    assert lk.take_look(spark, f"{tmp_path}/none", f"{tmp_path}/looks", 2).count() == 0
