from pathlib import Path

import pytest

from orbweave.sources.store import discard, materialise, scratch, shared_dir


def test_scratch_deletes_what_is_not_kept(spark):
    folder = Path(shared_dir(spark).removeprefix("file://")) / "orbweave"
    names = lambda: {p.name.split("-")[0] for p in folder.iterdir()}
    before = materialise(spark.range(3), "before")
    with scratch(spark):
        inner = materialise(before.where("id > 0"), "inner")
        with scratch(spark):
            middle = materialise(inner, "middle", keep=True)
            materialise(middle, "innermost")
        assert "middle" in names() and "innermost" not in names()
        kept = materialise(middle, "kept", keep=True)
    assert {"before", "kept"} <= names() and not {"inner", "middle"} & names()
    assert kept.count() == 2
    discard(before)
    discard(before)
    discard(spark.range(1))
    assert "before" not in names() and "kept" in names()


def test_scratch_deletes_after_an_error(spark):
    folder = Path(shared_dir(spark).removeprefix("file://")) / "orbweave"
    with pytest.raises(ZeroDivisionError), scratch(spark):
        materialise(spark.range(1), "lost")
        1 / 0
    assert not list(folder.glob("lost-*"))
