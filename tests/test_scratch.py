"""Scopes of intermediate tables."""

import os
import threading

import pytest

from tacit.scratch import release, scope, store


def test_scopes_of_two_threads_stay_apart(spark):
    begun, result = threading.Barrier(2, timeout=120), {}

    def work(name):
        with scope() as made:
            begun.wait()
            kept = store(spark.range(3), name)
            store(spark.range(4), f"{name}-gone")
            begun.wait()
            result[name] = (sorted(table.rows for table in made), kept, [t.path for t in made])
            begun.wait()
        release(made, kept.frame)

    threads = [threading.Thread(target=work, args=(name,)) for name in ("one", "two")]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    for name in ("one", "two"):
        rows, kept, paths = result[name]
        assert rows == [3, 4] and all(name in path for path in paths)
        assert kept.frame.count() == 3
        assert [os.path.exists(path.removeprefix("file:")) for path in paths] == [True, False]


def test_tables_kept_inside_pass_to_the_enclosing_scope(spark):
    with scope() as outer:
        with scope() as inner:
            kept = store(spark.range(2), "kept")
            store(spark.range(5), "gone")
        release(inner, kept.frame)
        assert [table.rows for table in outer] == [2]
    release(outer)
    assert not os.path.exists(kept.path.removeprefix("file:"))


def test_a_failing_scope_drops_its_tables(spark):
    paths = []
    with pytest.raises(ZeroDivisionError), scope():
        paths.append(store(spark.range(2), "lost").path)
        raise ZeroDivisionError
    assert not os.path.exists(paths[0].removeprefix("file:"))
    with scope() as made:
        assert made == []
