"""Tables in scratch folders, of several threads at once."""

import os
import threading

from tracelake import storage


def test_scratch_folders_of_threads_are_their_own(spark):
    """What one thread's block deletes at its end isn't what another one still reads."""
    first_saved, second_done = threading.Event(), threading.Event()
    found = {}

    def first():
        with storage.scratch(spark):
            table = storage.saved(spark.range(5), "first")
            first_saved.set()
            second_done.wait(60)
            found["first"] = table.count()

    def second():
        first_saved.wait(60)
        with storage.scratch(spark):
            with storage.scratch(spark):
                found["inner"] = storage.saved(spark.range(7), "inner").count()
            found["second"] = storage.saved(spark.range(3), "second").count()
        second_done.set()

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == {"first": 5, "inner": 7, "second": 3}
    base = storage.scratch_dir(spark).removeprefix("file:")
    assert not [d for d in os.listdir(base) if d.startswith("scratch-")]


def test_a_result_is_kept_alone(spark):
    base = storage.scratch_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    out = storage.saved_alone(spark, "result", lambda: storage.saved(spark.range(4), "step").where("id > 1"))
    (new,) = set(os.listdir(base)) - before
    assert new.startswith("result-") and out.count() == 2
